"""Platform plans and the quality gate."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cliploom.functions.text import strip

#: Longest video of each platform in seconds, and the picture it wants (fixed values).
PRESETS = {"douyin": 180, "bilibili": 600, "youtube_shorts": 60}
RESOLUTIONS = {"douyin": "1080x1920", "bilibili": "1920x1080", "youtube_shorts": "1080x1920"}
MAX_PARTS = 1000


def clip_boundaries(clips: DataFrame) -> DataFrame:
    """Ends of clips on the edited timeline, those over half a second from both its ends."""
    order = Window.partitionBy("job_id").orderBy("start_ms", "end_ms")
    run = F.sum(F.col("end_ms") - F.col("start_ms"))
    b = clips.select(
        "job_id",
        run.over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("at_ms"),
        run.over(Window.partitionBy("job_id")).alias("_all"),
    )
    return b.filter("at_ms > 500 and at_ms < _all - 500").select("job_id", "at_ms").distinct()


def split_parts(duration: int, bounds: list[int], longest: int) -> list[tuple[int, int]]:
    """Parts of at most `longest`: up to the last boundary far enough in, else a hard cut; a tail within
    half a second joins. Stops behind MAX_PARTS parts."""
    if longest <= 0:
        raise ValueError("a platform's limit must be positive")
    if duration <= longest + 500:
        return [(0, duration)] if duration > 0 else []
    out, at = [], 0
    while at < duration and len(out) <= MAX_PARTS:
        if duration - at <= longest + 500:
            out.append((at, duration))
            break
        low = at + min(longest * 35 // 100, 60_000)
        fit = [b for b in bounds if low <= b <= at + longest]
        end = fit[-1] if fit else at + longest
        out.append((at, end))
        at = end
    return out


def platform_segments(durations: DataFrame, boundaries: DataFrame, presets: dict[str, int] = PRESETS) -> DataFrame:
    """(job_id, platform, part, start_ms, end_ms, error) for every job and platform.

    One row with an error and no part for jobs without a duration and plans of over MAX_PARTS parts.
    """
    b = boundaries.groupBy("job_id").agg(F.sort_array(F.collect_list("at_ms")).alias("bounds"))
    p = F.explode(F.array(*[F.struct(F.lit(k).alias("platform"), F.lit(v * 1000).alias("longest")) for k, v in presets.items()]))
    j = durations.join(b, "job_id", "left").select("job_id", "duration_ms", "bounds", p.alias("p")).select("job_id", "duration_ms", "bounds", "p.platform", "p.longest")

    @F.pandas_udf("array<struct<start_ms:bigint,end_ms:bigint>>")
    def parts(duration: pd.Series, bounds: pd.Series, longest: pd.Series) -> pd.Series:
        out = []
        for d, x, m in zip(duration, bounds, longest, strict=True):
            found = split_parts(0 if pd.isna(d) else int(d), list(x) if x is not None else [], int(m))
            out.append(None if len(found) > MAX_PARTS else [{"start_ms": a, "end_ms": z} for a, z in found])
        return pd.Series(out)

    error = F.when(F.coalesce("duration_ms", F.lit(0)) <= 0, "no duration").when(F.col("parts").isNull(), "too many parts")
    return j.withColumn("parts", parts("duration_ms", "bounds", "longest")).select(
        "job_id", "platform", F.posexplode_outer("parts").alias("part", "x"), error.alias("error")
    ).select("job_id", "platform", "part", "x.start_ms", "x.end_ms", "error")


def platform_checks(jobs: DataFrame, parts: DataFrame, limits: dict[str, int | None] = PRESETS, resolutions: dict[str, str] = RESOLUTIONS) -> DataFrame:
    """(job_id, platform, name, ok, message): what to look at before a job goes to each platform.

    jobs (job_id, duration_ms, video, has_video, title, cover); parts (job_id, platform, start_ms, end_ms). The
    duration is checked where it and a limit are known, parts where there are any; the picture is advice
    and the review a reminder, both always fine.
    """
    row = lambda k: F.struct(F.lit(k).alias("platform"), F.lit(limits[k]).cast("bigint").alias("limit"), F.lit(resolutions.get(k, "source")).alias("picture"))
    longest = parts.groupBy("job_id", "platform").agg(F.max(F.col("end_ms") - F.col("start_ms")).alias("longest"))
    j = jobs.select("*", F.explode(F.array(*[row(k) for k in limits])).alias("l")).select("*", "l.*").join(longest, ["job_id", "platform"], "left")
    check = lambda n, c, text: F.struct(F.lit(n).alias("name"), F.coalesce(c, F.lit(False)).alias("ok"), text.alias("message"))
    bound = F.concat(F.lit("max "), F.col("limit"), F.lit("s"))
    limited = F.coalesce(F.col("limit"), F.lit(0)) != 0
    # tenths of a second, the last one rounded
    seconds = F.format_string("%.1f", F.col("duration_ms") / 1000)
    checks = F.array(
        F.when(limited & (F.coalesce("duration_ms", F.lit(0)) != 0), check("duration_limit", F.col("duration_ms") <= F.col("limit") * 1000, F.concat(seconds, F.lit("s / "), bound))),
        F.when(limited & F.col("longest").isNotNull(), check("segment_duration", F.col("longest") <= F.col("limit") * 1000, bound)),
        check("video_exists", F.col("has_video"), F.coalesce("video", F.lit(""))),
        check("metadata_ready", strip(F.col("title")) != "", F.lit("title available")),
        check("cover_ready", F.col("cover"), F.lit("cover_vertical/landscape or selected cover")),
        check("resolution_advice", F.lit(True), F.concat(F.lit("target "), F.col("picture"))),
        check("manual_review", F.lit(True), F.lit("Review platform policy and copyright before upload.")),
    )
    return j.select("job_id", "platform", F.inline(F.array_compact(checks)))


_KIT = (
    "aspect string, subtitle_style struct<max_lines:int,max_chars_per_line:int>, cover_style struct<required:boolean>, metadata_style struct<quality_gate:struct<aspect:string,"
    "subtitle_max_lines:int,subtitle_max_chars_per_line:int,cover_required:boolean,duration_min_seconds:double,duration_max_seconds:double,loudness_min_lufs:double,loudness_max_lufs:double>>"
)


def gate_policy(jobs: DataFrame, snapshots: DataFrame) -> DataFrame:
    """The policy of each job: the gate settings of its kit snapshot's JSON, then the kit's own styles, then
    the defaults (two lines of 18 characters, no cover, no bounds)."""
    k = F.from_json("payload_json", _KIT)
    own = lambda c: F.col(f"k.metadata_style.quality_gate.{c}")
    s = snapshots.select("snapshot_id", k.alias("k")).select(
        "snapshot_id",
        F.coalesce(own("aspect"), "k.aspect").alias("aspect"),
        F.coalesce(own("subtitle_max_lines"), "k.subtitle_style.max_lines").alias("max_lines"),
        F.coalesce(own("subtitle_max_chars_per_line"), "k.subtitle_style.max_chars_per_line").alias("max_chars"),
        F.coalesce(own("cover_required"), "k.cover_style.required").alias("cover_required"),
        *[own(c).alias(c) for c in ("duration_min_seconds", "duration_max_seconds", "loudness_min_lufs", "loudness_max_lufs")],
    )
    return jobs.join(s, "snapshot_id", "left").withColumns(
        {
            "aspect": F.trim(F.coalesce("aspect", F.lit(""))),
            # no limit, or zero, means two
            "max_lines": F.greatest(F.lit(1), F.coalesce(F.nullif("max_lines", F.lit(0)), F.lit(2))),
            "max_chars": F.coalesce("max_chars", F.lit(18)),
            "cover_required": F.coalesce("cover_required", F.lit(False)),
        }
    )


def quality_gate(jobs: DataFrame) -> DataFrame:
    """(job_id, blocking, advisory, status): the codes of what stands against a job, in the order of the checks.

    jobs: gate_policy() columns beside measured values: refinement (status of the clip refinement, null if there
    was none), render_bytes (null if there is no video), duration_seconds, width, height, lines (most lines of a rendered
    subtitle, null if none was rendered), segments (number in the transcript), cover, loudness. An unknown
    measure blocks where the check needs it (duration, aspect) and is advice for subtitles and loudness;
    a loudness bound counts alone, and without any nothing is asked.
    """
    ratio = F.split("aspect", ":", 2)
    want = F.try_divide(ratio[0].try_cast("double"), F.try_element_at(ratio, F.lit(2)).try_cast("double"))
    seen = F.when((F.col("width") > 0) & (F.col("height") > 0), F.col("width") / F.col("height"))
    near = F.coalesce((want != 0) & (F.try_divide(F.abs(seen - want), want) <= 0.03), F.lit(False))
    duration = F.coalesce("duration_seconds", F.lit(0.0))
    bound = lambda c: F.nullif(c, F.lit(0.0))
    low, high, loud = (F.col(c) for c in ("loudness_min_lufs", "loudness_max_lufs", "loudness"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    # false | null is null, so each half counts alone
    wrong = yes(loud < low) | yes(loud > high)
    over = yes(F.col("lines") > F.col("max_lines"))

    def codes(*checks):
        return F.array_compact(F.array(*[F.when(c, code) for code, c in checks]))

    blocking = codes(
        ("clip_refinement_required", F.col("refinement").isNotNull() & (F.col("refinement") != "accepted")),
        ("render_missing", F.coalesce("render_bytes", F.lit(0)) < 1),
        ("duration_invalid", duration <= 0),
        ("duration_limit", (duration > 0) & (yes(duration < bound("duration_min_seconds")) | yes(duration > bound("duration_max_seconds")))),
        ("aspect_ratio", (F.col("aspect") != "") & ~near),
        ("subtitle_overflow", over),
        ("cover_missing", F.col("cover_required") & ~yes(F.col("cover"))),
        ("audio_loudness", wrong),
    )
    advisory = codes(
        ("subtitles_unverified", F.col("lines").isNull() & (F.coalesce("segments", F.lit(0)) > 0)),
        ("audio_loudness_missing", (low.isNotNull() | high.isNotNull()) & loud.isNull()),
    )
    status = F.when(F.size("blocking") > 0, "blocked").when(F.size("advisory") > 0, "advisory").otherwise("passed")
    return jobs.select("job_id", blocking.alias("blocking"), advisory.alias("advisory")).withColumn("status", status)


#: Filter chains of the three ways to an upright picture (fixed values); w, h, x, y are the cut, tw and th the picture.
FILTERS = {
    "crop": "crop={w}:{h}:{x}:{y},scale={tw}:{th}",
    "pad": "scale={tw}:{th}:force_original_aspect_ratio=decrease,pad={tw}:{th}:(ow-iw)/2:(oh-ih)/2:black",
    "blur": "split=2[fg][bg];[bg]scale={tw}:{th}:force_original_aspect_ratio=increase,crop={tw}:{th},gblur=sigma=28,eq=brightness=-0.08:saturation=0.9[bgv];"
    "[fg]scale={tw}:{th}:force_original_aspect_ratio=decrease[fgv];[bgv][fgv]overlay=(W-w)/2:(H-h)/2,setsar=1",
}


def _filled(form: str, **values: Column) -> Column:
    """A form whose {names} are columns."""
    parts = re.split(r"\{(\w+)\}", form)
    return F.concat(*[values[x].cast("string") if i % 2 else F.lit(x) for i, x in enumerate(parts)])


def vertical_crop_plan(frames: DataFrame, anchor: float = 0.5, anchor_y: float | None = None, mode: str = "crop", target: tuple[int, int] = (1080, 1920)) -> DataFrame:
    """(job_id, crop_w, crop_h, crop_x, crop_y, filter): how a frame becomes an upright picture of the target's shape.

    frames (job_id, width, height[, content_w, content_h, content_x, content_y: what content_crop() found]). Mode `crop`
    cuts the content around the anchor (shares of its width and height, held to 0 to 1), `pad` and `blur`
    keep all of it. Places of a cut count from the content's corner. Without a frame's size all is null.
    """
    if mode not in FILTERS:
        raise ValueError(f"unknown mode {mode}")
    known = (F.col("width") > 0) & (F.col("height") > 0)
    own = "content_w" in frames.columns
    cw, ch, cx, cy = (F.coalesce(f"content_{c}", d) if own else d for c, d in zip("whxy", (F.col("width"), F.col("height"), F.lit(0), F.lit(0)), strict=True))
    tw, th = target
    if mode == "crop":
        # the side that is too long is cut
        w, h = (x.cast("int") for x in (F.least(cw, F.bround(ch * tw / th)), F.least(ch, F.bround(cw * th / tw))))
        share = lambda a: min(max(a, 0.0), 1.0)
        place = lambda size, cut, at: F.bround(F.least(F.greatest(size * share(at) - cut / 2, F.lit(0)), size - cut)).cast("int")
        x, y = place(cw, w, anchor), place(ch, h, anchor if anchor_y is None else anchor_y)
    else:
        w, h, x, y = cw.cast("int"), ch.cast("int"), cx.cast("int"), cy.cast("int")
    whole = (cx == 0) & (cy == 0) & (cw == F.col("width")) & (ch == F.col("height"))
    before = F.when(whole, "").otherwise(_filled("crop={w}:{h}:{x}:{y},", w=cw, h=ch, x=cx, y=cy))
    chain = F.concat(before, _filled(FILTERS[mode], w=w, h=h, x=x, y=y, tw=F.lit(tw), th=F.lit(th)))
    out = {"crop_w": w, "crop_h": h, "crop_x": x, "crop_y": y, "filter": chain}
    return frames.select("job_id", *[F.when(known, c).alias(n) for n, c in out.items()])


def publish_queue(jobs: DataFrame, packages: DataFrame) -> DataFrame:
    """Jobs that have a package, newest first."""
    return jobs.join(packages.select("job_name").distinct(), "job_name", "left_semi").orderBy(F.col("updated_at").desc(), "job_name")


#: The longest title of the one platform that takes fewer characters (fixed values).
TITLE_LENGTHS = {"douyin": 55}


def metadata_preview(metadata: DataFrame, title_length: int = 80) -> DataFrame:
    """(job_id, platform, title, description, tags, hashtags, notes): what a form shows.

    metadata (job_id, platform, titles, cover_titles, descriptions, tags, hashtags, platform_notes: arrays).
    Blank items don't count; the first title, else the first cover title, is cut with an ellipsis; twelve
    tags and hashtags, eight notes; a hashtag gets its sign unless it has one.
    """
    said = lambda c: F.filter(F.transform(c, lambda x: strip(x)), lambda x: x != "")
    first = lambda c: F.get(said(c), F.lit(0))
    longest = F.lit(title_length)
    for platform, n in TITLE_LENGTHS.items():
        longest = F.when(F.col("platform") == platform, n).otherwise(longest)
    title = F.coalesce(first("titles"), first("cover_titles"), F.lit(""))
    cut = F.concat(F.regexp_replace(F.substring(title, F.lit(1), longest - 1), r"\s+$", ""), F.lit("…"))
    upto = lambda c, n: F.coalesce(F.slice(said(c), 1, n), F.array().cast("array<string>"))
    return metadata.select(
        "job_id",
        "platform",
        F.when(F.length(title) <= longest, title).otherwise(cut).alias("title"),
        F.coalesce(first("descriptions"), F.lit("")).alias("description"),
        upto("tags", 12).alias("tags"),
        F.transform(upto("hashtags", 12), lambda x: F.when(x.startswith("#"), x).otherwise(F.concat(F.lit("#"), x))).alias("hashtags"),
        upto("platform_notes", 8).alias("notes"),
    )
