"""Cut plans: what lies in a clip, its scores, ranks and selection. Clips: (job_id, idx, start_ms, end_ms, reason)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cliploom.functions.folds import running
from cliploom.functions.text import half_up, strip, truncate_text
from cliploom.operators.intervals import gathered, overlap_join
from cliploom.operators.transcript import words_of


def valid_marks(scenes: DataFrame, durations: DataFrame) -> DataFrame:
    """Marks (job_id, time_ms) inside their recording, both ends included."""
    return scenes.join(durations, "job_id").filter("time_ms >= 0 and time_ms <= duration_ms").select("job_id", "time_ms")


def scenes_per_clip(clips: DataFrame, scenes: DataFrame, durations: DataFrame | None = None, bucket_ms: int | None = None, long_ms: int = 0) -> DataFrame:
    """Adds scene_count and scene_times: marks inside the recording with start <= time < end.

    Without durations the marks are valid_marks() already. A mark is a range of one millisecond, so with
    time buckets it lies in exactly one.
    """
    marks = scenes if durations is None else valid_marks(scenes, durations)
    points = marks.select("job_id", F.col("time_ms").alias("r_start"), (F.col("time_ms") + 1).alias("r_end"))
    pairs = overlap_join(clips, points, "left", bucket_ms, long_ms)
    return gathered(pairs, clips.columns, F.count("r_start").alias("scene_count"), F.sort_array(F.collect_list("r_start")).alias("scene_times"))


def transcript_per_clip(
    clips: DataFrame, segments: DataFrame, words: DataFrame | None = None, longest: int = 160, bucket_ms: int | None = None, long_ms: int = 0, listed: int | None = None, spread: bool = False
) -> DataFrame:
    """Adds transcript_text: of every overlapping segment the words inside the clip, else its text.

    Which words lie in a clip is decided on the array beside the segment: segments carry it as `words`
    (see transcript.with_words), or it is gathered from a table of words, or (spread) made of the texts of
    the pairs of clip and segment, so that neither joins nor sorts hold words. A clip with a text of its own
    (column transcript_override, not blank) has that. `listed` adds clip_segments: the first so many
    parts with their segments' times, cut to the clip.
    """
    if words is not None:
        item = F.struct("word_idx", "w_start", "w_end", "word")
        w = words.groupBy("job_id", "seg_idx").agg(F.array_sort(F.collect_list(item)).alias("words"))
        segments = segments.join(w, ["job_id", "seg_idx"], "left")
    s = segments.select("job_id", "seg_idx", F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"), "text", *[c for c in segments.columns if c == "words"])
    part = strip(F.col("text"))
    met = lambda pairs: pairs.withColumn("words", words_of("text", "r_start", "r_end")) if spread else pairs
    if spread or "words" in s.columns:
        inside = F.filter("words", lambda x: (x["w_end"] > F.col("start_ms")) & (x["w_start"] < F.col("end_ms")))
        spoken = F.array_join(F.transform(inside, lambda x: strip(x["word"])), "")
        part = F.when(F.size(inside) > 0, spoken).otherwise(part)
    one = F.struct("r_start", "seg_idx", "part", F.greatest("start_ms", "r_start").alias("from_ms"), F.least("end_ms", "r_end").alias("to_ms"))
    every = F.array_sort(F.collect_list(F.when(F.col("part") != "", one))).alias("_all")
    if bucket_ms is None:
        found = gathered(met(overlap_join(clips, s, "left")).withColumn("part", part), clips.columns, every)
    else:  # the parts are taken where clip and segment meet: of a pair nothing else goes on to its clip
        pairs = overlap_join(clips.select("job_id", "idx", "start_ms", "end_ms"), s, "inner", bucket_ms, long_ms)
        parts = met(pairs).withColumn("part", part).groupBy("job_id", "idx").agg(every)
        found = clips.join(parts, ["job_id", "idx"], "left").withColumn("_all", F.coalesce("_all", F.array()))
    text = truncate_text(strip(F.array_join(F.transform("_all", lambda x: x["part"]), " ")), longest)
    if "transcript_override" in clips.columns:
        own = strip(F.col("transcript_override"))
        text = F.when(own != "", own).otherwise(text)
    found = found.withColumn("transcript_text", text)
    if listed is not None:
        shown = F.transform(F.slice("_all", 1, listed), lambda x: F.struct(x["from_ms"].alias("start_ms"), x["to_ms"].alias("end_ms"), x["part"].alias("text")))
        found = found.withColumn("clip_segments", shown)
    return found.drop("_all")


def recommendation(score: Column) -> Column:
    return F.when(score >= 70, "strong_keep").when(score >= 42, "review").otherwise("trim_candidate")


def content_score(clips: DataFrame) -> DataFrame:
    """Adds content_score (0 to 100) from speech, scenes and length, and a recommendation."""
    seconds = F.greatest(F.lit(0.001), (F.col("end_ms") - F.col("start_ms")) / 1000)
    speech = F.least(F.lit(1.0), F.length("transcript_text") / F.greatest(F.lit(28.0), seconds * 7.0))
    scene = F.least(F.lit(1.0), F.col("scene_count") / F.greatest(F.lit(1.0), seconds / 18.0))
    balance = F.when(seconds.between(8, 75), 1.0).when(seconds.between(4, 120), 0.55).otherwise(0.25)
    score = half_up((speech * 0.55 + scene * 0.3 + balance * 0.15) * 100)
    return clips.withColumn("content_score", score).withColumn("recommendation", recommendation(F.col("content_score")))


def rank_clips(clips: DataFrame, score: str, out: str) -> DataFrame:
    """Adds the rank of each clip in its job by score; ties keep the order of the timeline."""
    return clips.withColumn(out, F.row_number().over(Window.partitionBy("job_id").orderBy(F.col(score).desc(), "idx")))


def clean_highlights(highlights: DataFrame) -> DataFrame:
    start = F.greatest(F.lit(0), F.col("start_ms")).cast("long")
    return highlights.filter("start_ms is not null and end_ms is not null").select(
        "job_id",
        "idx",
        start.alias("start_ms"),
        F.greatest(start, F.col("end_ms")).alias("end_ms"),
        half_up(F.least(F.greatest(F.coalesce(F.col("score"), F.lit(0.0)), F.lit(0.0)), F.lit(100.0))).alias("score"),
        strip(F.coalesce("reason", F.lit(""))).alias("reason"),
        strip(F.coalesce("recommended_use", F.lit(""))).alias("recommended_use"),
    ).filter("end_ms > start_ms")


def semantic_score(clips: DataFrame, highlights: DataFrame) -> DataFrame:
    """Adds semantic_score, up to three reasons and uses, final_score, final_rank and recommendation.

    A job's highlights are few; they lie beside each of its clips as one array, best first, of which the
    clip's own are filtered.
    """
    own = F.struct((-F.col("score")).alias("s"), F.col("start_ms").alias("h_start"), F.col("idx").alias("h_idx"), F.col("end_ms").alias("h_end"), "reason", "recommended_use")
    jobs = clean_highlights(highlights).groupBy("job_id").agg(F.array_sort(F.collect_list(own)).alias("_every"))
    meets = F.filter("_every", lambda x: (F.col("start_ms") < x["h_end"]) & (x["h_start"] < F.col("end_ms")))
    found = F.coalesce(meets, F.array().cast("array<struct<s:double,h_start:bigint,h_idx:bigint,h_end:bigint,reason:string,recommended_use:string>>"))
    best = lambda c: F.slice(F.filter(F.transform("_all", lambda x: x[c]), lambda x: x != ""), 1, 3)
    scored = (
        clips.join(jobs, "job_id", "left")
        .withColumn("_all", found)
        .withColumns({"semantic_score": F.when(F.size("_all") > 0, -F.get("_all", F.lit(0))["s"]).otherwise(0.0), "semantic_reasons": best("reason"), "semantic_uses": best("recommended_use")})
        .withColumn("final_score", F.when(F.col("_every").isNotNull(), half_up(F.col("content_score") * 0.4 + F.col("semantic_score") * 0.6)).otherwise(F.col("content_score")))
        .withColumn("recommendation", recommendation(F.col("final_score")))
        .drop("_every", "_all")
    )
    return rank_clips(scored, "final_score", "final_rank")


def validate_edited_clips(clips: DataFrame, durations: DataFrame) -> DataFrame:
    """Clips of an editor (start, end in seconds), clamped and sorted; `error` where a clip is empty."""
    given = lambda c: F.floor(F.col(c).try_cast("double") * 1000 + 0.5)
    # least and greatest pass over nulls; a time that is no number stays null
    start = F.when(given("start").isNotNull(), F.greatest(F.lit(0), given("start"))).cast("long")
    end = F.when(given("end").isNotNull(), F.least(F.col("duration_ms"), given("end")))
    out = clips.join(durations, "job_id").select(
        "job_id",
        start.alias("start_ms"),
        end.alias("end_ms"),
        F.coalesce("keep", F.lit(True)).alias("keep"),
        F.coalesce("reason", F.lit("edited")).alias("reason"),
    )
    bad = F.col("start_ms").isNull() | F.col("end_ms").isNull() | (F.col("end_ms") <= F.col("start_ms"))
    order = Window.partitionBy("job_id").orderBy("start_ms", "end_ms")
    return out.withColumn("error", F.when(bad, "empty clip")).withColumn("idx", F.row_number().over(order))


def highlight_cut(clips: DataFrame, target_ms: int = 60_000) -> DataFrame:
    """Kept clips taken by score within a time budget: (job_id, idx, start_ms, end_ms, selection_rank).

    The best is always taken; one that doesn't fit is passed over; nothing more once the target is
    reached. A fold with a running total over a job's ranked clips.
    """
    length = F.col("end_ms") - F.col("start_ms")
    item = F.struct((-F.col("final_score")).alias("s"), (-length).alias("d"), "idx", "start_ms", "end_ms")
    per = clips.groupBy("job_id").agg(F.array_sort(F.collect_list(item)).alias("_all"))
    ranked = per.select("job_id", F.transform("_all", lambda x, i: x.withField("rank", i + 1)).alias("_all"))

    def step(total, x):
        d = x["end_ms"] - x["start_ms"]
        take = (x["rank"] == 1) | ((total < target_ms) & (total + d <= target_ms))
        one = F.struct(x["idx"].alias("idx"), x["start_ms"].alias("start_ms"), x["end_ms"].alias("end_ms"), x["rank"].alias("rank"))
        return F.when(take, total + d).otherwise(total), F.when(take, one)

    out = running("_all", F.lit(0), step, "bigint", "struct<idx:bigint,start_ms:bigint,end_ms:bigint,rank:int>")
    done = ranked.select("job_id", F.explode(out).alias("c"))
    return done.select("job_id", "c.idx", "c.start_ms", "c.end_ms", F.col("c.rank").alias("selection_rank"))


def top_clips(clips: DataFrame, k: int = 8) -> DataFrame:
    return rank_clips(clips, "content_score", "_r").filter(F.col("_r") <= k).drop("_r")


def cut_summary(clips: DataFrame, invalid: DataFrame, scenes: DataFrame, durations: DataFrame) -> DataFrame:
    """One row per job: source label, numbers of invalid segments, scenes and clips, kept time."""
    i = invalid.groupBy("job_id").agg(F.count(F.lit(1)).alias("invalid_count"), F.min("reason").alias("cut_source"))
    s = scenes.groupBy("job_id").agg(F.count(F.lit(1)).alias("scene_total"))
    c = clips.groupBy("job_id").agg(F.count(F.lit(1)).alias("clip_count"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("kept_ms"))
    zero = lambda n: F.coalesce(n, F.lit(0)).alias(n)
    return (
        durations.join(i, "job_id", "left")
        .join(s, "job_id", "left")
        .join(c, "job_id", "left")
        .select("job_id", "duration_ms", F.coalesce("cut_source", F.lit("full_media")).alias("cut_source"), zero("invalid_count"), zero("scene_total"), zero("clip_count"), zero("kept_ms"))
    )


def cut_documents(clips: DataFrame) -> DataFrame:
    """One cut plan per job: JSON in time order, and the rows of its table."""
    item = F.struct("idx", "start_ms", "end_ms", "reason")
    row = lambda x: F.format_string("| %d | %d | %d | %s |", x["idx"], x["start_ms"], x["end_ms"], x["reason"])
    per = clips.groupBy("job_id").agg(F.array_sort(F.collect_list(item)).alias("clips"))
    return per.select("job_id", F.to_json("clips").alias("cuts_json"), F.array_join(F.transform("clips", row), "\n").alias("table_md"))
