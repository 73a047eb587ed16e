"""Subtitles on the edited timeline: kept clips, remapping, wrapping and events."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cliploom.functions.arrays import bytes_of, characters, spaces, widths
from cliploom.functions.folds import running
from cliploom.functions.text import ass_time, char_width, escape_ass, narrow, srt_time, strip

BREAKS = "，。！？；、,.!?;: "


def kept_timeline(clips: DataFrame) -> DataFrame:
    """Clips in order with offset_ms, the sum of the durations before."""
    order = Window.partitionBy("job_id").orderBy("start_ms", "end_ms").rowsBetween(Window.unboundedPreceding, -1)
    return clips.filter("end_ms > start_ms").withColumn(
        "offset_ms", F.coalesce(F.sum(F.col("end_ms") - F.col("start_ms")).over(order), F.lit(0))
    )


def remap_segments(segments: DataFrame, timeline: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Segments on the edited timeline: each overlap with a clip, shifted; jobs without clips unchanged.
    Columns of segments named in keep come along.

    timeline may have subtitle_override (text): such a clip gives one row with it (none if blank).
    """
    t = timeline.select("job_id", "idx", "start_ms", "end_ms", "offset_ms", *(["subtitle_override"] if "subtitle_override" in timeline.columns else []))
    if "subtitle_override" not in t.columns:
        t = t.withColumn("subtitle_override", F.lit(None).cast("string"))
    s = segments.select("job_id", "seg_idx", F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"), "text", *keep)
    # jobs without clips are told by a mark, so that the segments, which may be costly to make, are made once
    s = s.join(t.select("job_id").distinct().withColumn("_edited", F.lit(True)), "job_id", "left")
    clip = t.filter("subtitle_override is null").select(F.col("job_id").alias("_job"), "idx", "start_ms", "end_ms", (F.col("offset_ms") - F.col("start_ms")).alias("_shift"))
    meets = (F.col("job_id") == F.col("_job")) & (F.col("start_ms") < F.col("r_end")) & (F.col("r_start") < F.col("end_ms"))
    met = F.col("_job").isNotNull()
    cut = s.join(clip, meets, "left").filter(met | F.col("_edited").isNull()).select(
        "job_id",
        "idx",
        "seg_idx",
        F.when(met, F.greatest("start_ms", "r_start") + F.col("_shift")).otherwise(F.col("r_start")).alias("out_start"),
        F.when(met, F.least("end_ms", "r_end") + F.col("_shift")).otherwise(F.col("r_end")).alias("out_end"),
        "text",
        *keep,
    )
    own = t.filter(strip(F.col("subtitle_override")) != "").select(
        "job_id",
        "idx",
        F.lit(None).cast("int").alias("seg_idx"),
        F.col("offset_ms").alias("out_start"),
        (F.col("offset_ms") + F.col("end_ms") - F.col("start_ms")).alias("out_end"),
        strip(F.col("subtitle_override")).alias("text"),
        *[F.lit(None).cast(segments.schema[c].dataType).alias(c) for c in keep],
    )
    return cut.unionByName(own)


def clips_beside(segments: DataFrame, timeline: DataFrame) -> DataFrame:
    """Segments that overlap a clip, with `clips`, an array of those; null in jobs without clips, whose segments all stay.

    What is made of a segment later and lies within its time is remapped by remap_beside() without a join of its own.
    """
    clip = F.struct("start_ms", "end_ms", "idx", (F.col("offset_ms") - F.col("start_ms")).alias("shift"))
    per = timeline.groupBy("job_id").agg(F.array_sort(F.collect_list(clip)).alias("_every"))
    meets = F.filter("_every", lambda c: (c["start_ms"] < F.col("end_ms")) & (F.col("start_ms") < c["end_ms"]))
    return segments.join(per, "job_id", "left").withColumn("clips", meets).drop("_every").filter("clips is null or size(clips) > 0")


def remap_beside(segments: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """remap_segments() of segments that carry their `clips`, see clips_beside()."""
    each = segments.select("job_id", "seg_idx", "start_ms", "end_ms", "text", *keep, F.explode_outer("clips").alias("_c"))
    c, alone = F.col("_c"), F.col("_c").isNull()
    met = (c["start_ms"] < F.col("end_ms")) & (F.col("start_ms") < c["end_ms"])
    return each.filter(alone | met).select(
        "job_id",
        c["idx"].alias("idx"),
        "seg_idx",
        F.when(alone, F.col("start_ms")).otherwise(F.greatest(c["start_ms"], F.col("start_ms")) + c["shift"]).alias("out_start"),
        F.when(alone, F.col("end_ms")).otherwise(F.least(c["end_ms"], F.col("end_ms")) + c["shift"]).alias("out_end"),
        "text",
        *keep,
    )


def wrap(text: str, units: int) -> list[str]:
    """Lines of at most `units` visual units: at the last break mark past 45 % of it, else hard."""
    lines, rest = [], text
    plain, bound = units > 0 and narrow(text), max(1, int(units * 0.45))
    while True:
        total, hard, least = (len(rest), units, bound) if plain else (0, len(rest), None)
        for i, c in enumerate("" if plain else rest):
            total += char_width(c)
            if least is None and total > bound:
                least = i
            if total > units:
                hard = i
                break
        if total <= units:
            break
        hard = max(1, hard)
        at = max(rest.rfind(m, 0, hard + 1) for m in BREAKS)
        at = at + 1 if at >= max(1, least or 0) else hard
        if rest[:at].strip():
            lines.append(rest[:at].strip())
        rest = rest[at:].strip()
    return [*lines, rest] if rest else lines


def plain_text(c: Column) -> Column:
    """A text on one line: literal break marks and runs of white space become one blank."""
    c = F.replace(F.replace(c, F.lit(r"\N"), F.lit(" ")), F.lit(r"\n"), F.lit(" "))
    # blanks that stand alone aren't matched, so a text without other white space isn't rewritten
    return strip(F.regexp_replace(c, r"[\t-\r]\s*| \s+", " "))


def wrap_lines(c: Column, units: int) -> Column:
    """Lines of a text, in one Arrow pass."""

    @F.pandas_udf("array<string>")
    def split(s: pd.Series) -> pd.Series:
        return s.map(lambda t: wrap(t, units) if t else [])

    # marked nondeterministic so that the optimizer keeps one call a row
    return split.asNondeterministic()(plain_text(c))


def wrapped(text: pa.StringArray, units: int, max_lines: int) -> pa.Array:
    """The events of a batch of plain texts, wrap() of all at once: lists of at most max_lines lines each as
    (text, width, upto), upto being the width up to the event's end.

    The texts' lines are ranges of one array of characters; every round takes the next line of all texts that have one.
    """
    kind = [pa.field("text", pa.string()), pa.field("width", pa.int32()), pa.field("upto", pa.int32())]
    data, offsets = bytes_of(pc.fill_null(text.cast(pa.string()), ""))
    points, at = characters(data)
    n = len(points)
    byte = np.append(at, len(data))
    wide = widths(points)
    even = bool((wide == 1).all())
    upto = np.concatenate([[0], np.cumsum(wide, dtype=np.int64)])
    here = np.arange(n)
    marks = np.maximum.accumulate(np.where(np.isin(points, [ord(c) for c in BREAKS]), here, -1))  # the last break mark up to here
    shown = ~spaces(points)
    onward = np.minimum.accumulate(np.append(np.where(shown, here, n), n)[::-1])[::-1]  # the first visible character from here on
    back = np.maximum.accumulate(np.append(0, np.where(shown, here + 1, 0)))  # the end of the last visible one before
    bound = max(1, int(units * 0.45))
    begins = np.searchsorted(at, offsets)
    row, a, z = np.arange(len(text)), begins[:-1], begins[1:]
    found = []
    while len(row):
        rest = z > a
        row, a, z = row[rest], a[rest], z[rest]
        fits = upto[z] - upto[a] <= units
        found.append((row[fits], a[fits], z[fits]))
        row, a, z = row[~fits], a[~fits], z[~fits]
        if even and units > 0:
            hard, least = a + units, a + bound
        else:
            over = np.searchsorted(upto, upto[a] + units, "right") - 1
            least = np.searchsorted(upto, upto[a] + bound, "right") - 1
            least, hard = np.where(least <= over, least, a), np.maximum(a + 1, over)
        mark = marks[np.minimum(hard, z - 1)]
        cut = np.where(mark >= np.maximum(a + 1, least), mark + 1, hard)
        first, last = onward[a], back[cut]
        line = last > first
        found.append((row[line], first[line], last[line]))
        a, z = np.minimum(onward[cut], z), back[z]
    row, a, z = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3
    order = np.argsort(row, kind="stable")
    row, a, z = row[order], a[order], z[order]
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    opens = nth % max_lines == 0
    # a further line of an event takes the byte before it too, which then becomes the line break
    more = (~opens).astype(np.int64)
    size = byte[z] - byte[a] + more
    to = np.cumsum(size) - size
    made = data[np.repeat(byte[a] - more - to, size) + np.arange(size.sum())]
    made[to[~opens]] = ord("\n")
    event = np.flatnonzero(opens)
    width = np.maximum(1, np.add.reduceat(upto[z] - upto[a] + more, event)) if len(event) else np.empty(0, np.int64)
    total, own = np.cumsum(width), row[event]
    before = (total - width)[np.searchsorted(own, own)] if len(event) else total
    ends = np.append(to[event], len(made)).astype(np.int32)
    columns = [pa.StringArray.from_buffers(len(event), pa.py_buffer(ends), pa.py_buffer(made)), pa.array(width.astype(np.int32)), pa.array((total - before).astype(np.int32))]
    shares = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=len(text)))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(shares), pa.StructArray.from_arrays(columns, fields=kind))


def subtitle_events(segments: DataFrame, units: int, max_lines: int = 2) -> DataFrame:
    """Segments (job_id, seg_idx, out_start, out_end, text) as events of at most max_lines lines, sharing
    the segment's time by width; the last ends exactly where the segment does.

    One Arrow pass wraps a batch of texts and measures their events; nothing is shuffled.
    """

    @F.arrow_udf("array<struct<text:string,width:int,upto:int>>")
    def events(text: pa.Array) -> pa.Array:
        return wrapped(text, units, max_lines)

    # marked nondeterministic so that the optimizer keeps one call a row
    made = segments.select("job_id", "seg_idx", "out_start", "out_end", events.asNondeterministic()(plain_text(F.col("text"))).alias("_all"))
    each = made.select("*", F.element_at(F.col("_all.upto"), -1).alias("_total"), F.posexplode("_all").alias("event_idx", "e"))
    span = F.greatest(F.lit(10), F.col("out_end") - F.col("out_start"))
    at = lambda x: F.least(F.col("out_end"), F.col("out_start") + F.floor(span * x / F.col("_total") + 0.5))
    last = F.col("e.upto") == F.col("_total")
    return each.select(
        "job_id",
        "seg_idx",
        "event_idx",
        at(F.col("e.upto") - F.col("e.width")).alias("start_ms"),
        F.when(last, F.col("out_end")).otherwise(at(F.col("e.upto"))).alias("end_ms"),
        F.col("e.text").alias("text"),
    ).filter("end_ms > start_ms")


#: Looks of two platforms beside the plain one, and what a document says before its events (fixed values).
STYLES = {
    "": {"font_name": "Arial", "font_size": 52, "primary_color": "&H00FFFFFF", "outline_color": "&H00000000", "back_color": "&H64000000", "outline": 3, "shadow": 1, "alignment": 2, "margin_v": 80},
    "douyin": {"font_size": 52, "primary_color": "&H00FFFFFF", "outline_color": "&H00000000", "back_color": "&H00000000", "outline": 3, "shadow": 0, "alignment": 2, "margin_v": 180},
    "bilibili": {"font_size": 48, "primary_color": "&H00FFFFFF", "outline_color": "&H00643B16", "back_color": "&H64000000", "outline": 3, "shadow": 1, "alignment": 2, "margin_v": 80},
}
_STYLE_FORMAT = (
    "Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding"
)
_EVENT_FORMAT = "Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text"


def play_resolution(jobs: DataFrame) -> DataFrame:
    """jobs (job_id, crop_w, crop_h, width, height) -> (job_id, play_w, play_h): the crop's target, else the first
    video's size, else 1920 by 1080; a pair counts only if both are positive."""
    both = lambda w, h: (F.col(w) > 0) & (F.col(h) > 0)
    crop, own = both("crop_w", "crop_h"), both("width", "height")
    return jobs.select(
        "job_id",
        F.when(crop, F.col("crop_w")).when(own, F.col("width")).otherwise(1920).alias("play_w"),
        F.when(crop, F.col("crop_h")).when(own, F.col("height")).otherwise(1080).alias("play_h"),
    )


def ass_documents(events: DataFrame, sizes: DataFrame, preset: str = "", vertical_font_size: int = 0) -> DataFrame:
    """(job_id, document): an Advanced SubStation document for each job of sizes (play_resolution()), also those
    without events. Upright pictures have their own font size (if any) and a margin of 150 at least."""
    look = STYLES[""] | STYLES.get(preset.strip().lower(), {})
    upright = (F.col("play_h") > F.col("play_w")) & F.lit(vertical_font_size > 0)
    font = F.when(upright, vertical_font_size).otherwise(look["font_size"]).cast("string")
    margin = F.when(upright, max(look["margin_v"], 150)).otherwise(look["margin_v"]).cast("string")
    head = ["[Script Info]", "ScriptType: v4.00+", F.concat(F.lit("PlayResX: "), "play_w"), F.concat(F.lit("PlayResY: "), "play_h"), "WrapStyle: 0", "ScaledBorderAndShadow: yes", "YCbCr Matrix: TV.709", ""]
    style = F.concat(
        F.lit(f"Style: Default,{look['font_name']},"), font, F.lit(f",{look['primary_color']},&H000000FF,{look['outline_color']},{look['back_color']},-1,0,0,0,100,100,0,0,1,{look['outline']:g},{look['shadow']:g},{look['alignment']},80,80,"), margin, F.lit(",1")
    )
    head += ["[V4+ Styles]", f"Format: {_STYLE_FORMAT}", style, "", "[Events]", f"Format: {_EVENT_FORMAT}"]
    lines = F.array(*[F.lit(x) if isinstance(x, str) else x for x in head])
    item = F.struct("start_ms", "seg_idx", "event_idx", "line")
    per = dialogue_line(events).groupBy("job_id").agg(F.array_sort(F.collect_list(item)).alias("_all"))
    own = F.coalesce(F.col("_all.line"), F.array().cast("array<string>"))
    return sizes.join(per, "job_id", "left").select("job_id", F.concat(F.array_join(F.concat(lines, own), "\n"), F.lit("\n")).alias("document"))


def dialogue_line(events: DataFrame, style: str = "Default") -> DataFrame:
    line = F.concat(
        F.lit("Dialogue: 0,"), ass_time(F.col("start_ms")), F.lit(","), ass_time(F.col("end_ms")), F.lit(f",{style},,0,0,0,,"), escape_ass(F.col("text"))
    )
    return events.withColumn("line", line)


def subtitle_documents(events: DataFrame, form: str = "srt") -> DataFrame:
    """One document per job, in time order."""
    item = F.struct("start_ms", "seg_idx", "event_idx", "end_ms", "text")
    per = events.groupBy("job_id").agg(F.array_sort(F.collect_list(item)).alias("_all"))
    block = {
        "srt": lambda x, i: F.concat((i + 1).cast("string"), F.lit("\n"), srt_time(x["start_ms"]), F.lit(" --> "), srt_time(x["end_ms"]), F.lit("\n"), x["text"], F.lit("\n")),
        "txt": lambda x, i: x["text"],
    }[form]
    return per.select("job_id", F.array_join(F.transform("_all", block), "\n").alias("document"))


def max_units(style_width: Column, font: Column) -> Column:
    return F.least(F.greatest(F.floor((style_width - 160) / (font * 0.45)), F.lit(16)), F.lit(52)).cast("int")


def translation_batches(segments: DataFrame, max_segments: int = 24, max_chars: int = 6000) -> DataFrame:
    """Adds batch: segments packed in order under both limits; an oversize one stands alone."""
    per = segments.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("seg_idx", F.length("text").alias("n")))).alias("_all"))

    def step(acc, x):
        new = (acc["rows"] > 0) & ((acc["rows"] >= max_segments) | (acc["chars"] + x["n"] > max_chars))
        batch = F.when(new, acc["batch"] + 1).otherwise(acc["batch"])
        rows, chars = (F.when(new, 0).otherwise(acc[c]) for c in ("rows", "chars"))
        after = F.struct(batch.alias("batch"), (rows + 1).alias("rows"), (chars + x["n"]).alias("chars"))
        return after, F.struct(x["seg_idx"].alias("seg_idx"), batch.alias("batch"))

    zero = F.struct(F.lit(0).alias("batch"), F.lit(0).alias("rows"), F.lit(0).alias("chars"))
    out = running("_all", zero, step, "struct<batch:int,rows:int,chars:int>", "struct<seg_idx:bigint,batch:int>")
    return per.select("job_id", F.explode(out).alias("x")).select("job_id", "x.seg_idx", "x.batch")


def translation_workload(segments: DataFrame, max_segments: int = 1200, max_chars: int = 240_000) -> DataFrame:
    """(job_id, segments, chars, error): what a translation of each job would send; an error where it is too much for one run."""
    per = segments.groupBy("job_id").agg(F.count(F.lit(1)).alias("segments"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"))
    return per.withColumn("error", F.when(F.col("segments") > max_segments, "too many segments").when(F.col("chars") > max_chars, "too many characters"))


def merge_translations(source: DataFrame, translated: DataFrame) -> DataFrame:
    """Source rows with their translation by exact times; the last of repeated ones; without one the
    source text stays; an empty one drops the row. translated (job_id, start_ms, end_ms, seq, text)."""
    t = translated.groupBy("job_id", "start_ms", "end_ms").agg(F.max_by("text", "seq").alias("_t"))
    return (
        source.join(t, ["job_id", "start_ms", "end_ms"], "left")
        .withColumn("text", F.coalesce("_t", "text"))
        .filter(strip(F.col("text")) != "")
        .drop("_t")
    )


def cut_clip_frames(clips: DataFrame, fps: Column) -> DataFrame:
    """Adds timebase, ntsc and the clips' frames, at least one."""
    base = F.when(F.abs(fps - 23.976) < 0.05, 24).when(F.abs(fps - 29.97) < 0.05, 30).when(F.abs(fps - 59.94) < 0.05, 60).otherwise(F.bround(fps)).cast("int")
    frames = lambda c: F.bround(c * base / 1000).cast("long")
    return clips.select(
        "job_id",
        "idx",
        base.alias("timebase"),
        frames(F.col("start_ms")).alias("in_frame"),
        F.greatest(F.lit(1), frames(F.col("end_ms") - F.col("start_ms"))).alias("frames"),
    )
