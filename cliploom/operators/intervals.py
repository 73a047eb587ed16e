"""Interval algebra on ranges (job_id, start_ms, end_ms) of recordings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cliploom.functions.folds import running


def overlap_join(left: DataFrame, right: DataFrame, how: str = "inner", bucket_ms: int | None = None, long_ms: int = 0, key: tuple[str, ...] = ("job_id", "idx")) -> DataFrame:
    """Pairs of left (job_id, start_ms, end_ms, ...) and right (job_id, r_start, r_end, ...) that overlap.

    The job is the equality key, so both sides are dealt by it once. `bucket_ms` adds a time bucket as
    second key, for jobs whose measured end lies behind `long_ms`: each side goes to the buckets it
    touches and a pair counts in the one where its later start lies, so nothing is found twice and one
    very long recording is shared by many tasks. Other jobs have one bucket. With how="left" rows
    without a partner stay; `key` then names left rows apart.
    """
    meets = (F.col("start_ms") < F.col("r_end")) & (F.col("r_start") < F.col("end_ms"))
    right = right.withColumnRenamed("job_id", "_job")
    same = F.col("job_id") == F.col("_job")
    if bucket_ms is None:
        return left.join(right, same & meets, how).drop("_job")
    if how == "left":
        found = overlap_join(left.select(*key, "start_ms", "end_ms"), right.withColumnRenamed("_job", "job_id"), "inner", bucket_ms, long_ms)
        return left.join(found.drop("start_ms", "end_ms"), list(key), "left")
    ends = left.select("job_id", "end_ms").union(right.select("_job", "r_end")).groupBy("job_id").agg(F.max("end_ms").alias("_last"))
    long_ = ends.filter(F.col("_last") > long_ms).select("job_id", F.lit(True).alias("_long"))

    def touched(a: str, b: str) -> Column:
        every = F.sequence(F.floor(F.col(a) / bucket_ms), F.floor((F.col(b) - 1) / bucket_ms))
        return F.explode(F.when(F.col("_long"), every).otherwise(F.array(F.lit(0).cast("bigint"))))

    a = left.filter("end_ms > start_ms").join(long_, "job_id", "left").withColumn("_b", touched("start_ms", "end_ms"))
    b = right.filter("r_end > r_start").join(long_.select(F.col("job_id").alias("_job"), "_long"), "_job", "left").withColumn("_c", touched("r_start", "r_end")).drop("_long")
    own = F.col("_b") == F.when(F.col("_long"), F.floor(F.greatest("start_ms", "r_start") / bucket_ms)).otherwise(F.lit(0))
    return a.join(b, same & (F.col("_b") == F.col("_c")) & meets & own).drop("_job", "_b", "_c", "_long")


def gathered(pairs: DataFrame, left: list[str], *aggregates: Column) -> DataFrame:
    """Aggregates of a left overlap_join for each left row (job_id, idx), with its other columns `left`."""
    own = [c for c in left if c not in ("job_id", "idx")]
    found = pairs.groupBy("job_id", "idx").agg(F.first(F.struct(*own)).alias("_own"), *aggregates)
    return found.select("job_id", "idx", "_own.*", *[c for c in found.columns if c not in ("job_id", "idx", "_own")])


def valid_ranges(ranges: DataFrame, durations: DataFrame) -> DataFrame:
    """Ranges cut to [0, duration] of their recording; empty and null ones go."""
    return (
        ranges.filter("start_ms is not null and end_ms is not null")
        .join(durations, "job_id")
        .select(
            "job_id",
            F.greatest(F.lit(0), F.col("start_ms")).cast("long").alias("start_ms"),
            F.least("duration_ms", "end_ms").alias("end_ms"),
        )
        .filter("end_ms > start_ms")
    )


def intersect_ranges(left: DataFrame, right: DataFrame, bucket_ms: int | None = None) -> DataFrame:
    """All overlaps of a left with a right range of one job."""
    r = right.select("job_id", F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"))
    return overlap_join(left.select("job_id", "start_ms", "end_ms"), r, bucket_ms=bucket_ms).select(
        "job_id", F.greatest("start_ms", "r_start").alias("start_ms"), F.least("end_ms", "r_end").alias("end_ms")
    )


def merge_ranges(ranges: DataFrame, gap_ms: int = 120, min_ms: int = 350) -> DataFrame:
    """Unions of ranges no more than gap_ms apart, those shorter than min_ms left out (gaps and islands)."""
    order = Window.partitionBy("job_id").orderBy("start_ms", "end_ms")
    reached = F.max("end_ms").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(F.col("start_ms") <= F.col("_reached") + gap_ms, 0).otherwise(1)
    return (
        ranges.withColumn("_reached", reached)
        .withColumn("_island", F.sum(opens).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("job_id", "_island")
        .agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
        .filter(F.col("end_ms") - F.col("start_ms") >= min_ms)
        .select("job_id", "start_ms", "end_ms")
    )


def invalid_segments(silences: DataFrame, freezes: DataFrame, durations: DataFrame) -> DataFrame:
    """Parts to drop: where silence and freeze meet if a job has both, else its silences."""
    s, f = valid_ranges(silences, durations), valid_ranges(freezes, durations)
    frozen = f.select("job_id").distinct()
    both = merge_ranges(intersect_ranges(s, f)).withColumn("reason", F.lit("silence+freeze"))
    alone = merge_ranges(s.join(frozen, "job_id", "left_anti")).withColumn("reason", F.lit("silence"))
    return both.union(alone)


def keep_clips(invalid: DataFrame, durations: DataFrame, min_gap_ms: int = 350, min_ms: int = 350) -> DataFrame:
    """The complement of the invalid segments, each padded by half the gap: (job_id, idx, start_ms, end_ms, reason)."""
    pad = min_gap_ms // 2
    order = Window.partitionBy("job_id").orderBy("start_ms", "end_ms")
    i = invalid.join(durations, "job_id").withColumn("_end", F.least("duration_ms", F.col("end_ms") + pad))
    before = i.select(
        "job_id",
        F.coalesce(F.lag("_end").over(order), F.lit(0)).alias("_from"),
        F.greatest(F.lit(0), F.col("start_ms") - pad).alias("_to"),
        F.concat(F.lit("before "), "reason").alias("reason"),
    )
    tail = i.groupBy("job_id").agg(F.max_by("_end", F.struct("start_ms", "end_ms")).alias("_from"), F.max("duration_ms").alias("_to"))
    tail = tail.withColumn("reason", F.lit("tail"))
    pieces = before.unionByName(tail).filter((F.col("_to") > F.col("_from")) & (F.col("_to") - F.col("_from") >= min_ms))
    whole = (
        durations.filter("duration_ms > 0")
        .join(invalid.select("job_id").distinct(), "job_id", "left_anti")
        .select("job_id", F.lit(0).alias("_from"), F.col("duration_ms").alias("_to"), F.lit("full media").alias("reason"))
    )
    return indexed(
        pieces.unionByName(whole).select(
            "job_id", F.col("_from").cast("long").alias("start_ms"), F.col("_to").cast("long").alias("end_ms"), "reason"
        )
    )


def indexed(clips: DataFrame) -> DataFrame:
    """Clips with idx, their number from 1 in time order."""
    order = Window.partitionBy("job_id").orderBy("start_ms", "end_ms")
    return clips.withColumn("idx", F.row_number().over(order))


def join_reasons(parts: Column) -> Column:
    """An array's distinct non-blank texts in first-seen order, joined."""
    kept = F.array_distinct(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))
    return F.when(F.size(kept) > 0, F.array_join(kept, " / ")).otherwise("merged clip")


def merge_short_gaps(clips: DataFrame, gap_ms: int = 1500) -> DataFrame:
    """Neighbouring clips no more than gap_ms apart as one: it ends where its LAST clip ends."""
    order = Window.partitionBy("job_id").orderBy("idx")
    gap = F.greatest(F.lit(0), F.col("start_ms") - F.lag("end_ms").over(order))
    note = F.concat(F.lit("merged gap "), F.format_string("%.2f", F.col("_gap") / 1000), F.lit("s"))
    opens = F.when(F.col("_gap") <= gap_ms, 0).otherwise(1)
    grouped = (
        clips.withColumn("_gap", gap)
        .withColumn("_open", opens)
        .withColumn("_group", F.sum("_open").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("job_id", "_group")
        .agg(
            F.min("start_ms").alias("start_ms"),
            F.max_by("end_ms", "idx").alias("end_ms"),
            F.array_sort(F.collect_list(F.struct("idx", "reason", note.alias("note")))).alias("_all"),
        )
    )
    # each step joins what is there with the next clip's reason and a note on the gap
    joined = F.aggregate(
        F.slice("_all", 2, F.size("_all")),
        F.element_at("_all", 1)["reason"],
        lambda acc, x: join_reasons(F.array(acc, x["reason"], x["note"])),
    )
    return indexed(grouped.select("job_id", "start_ms", "end_ms", joined.alias("reason")))


def _together(*reasons: Column) -> Column:
    """Reasons that aren't null or blank, each once, in order."""
    kept = F.array_distinct(F.filter(F.transform(F.array(*reasons), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))
    return F.array_join(kept, " / ")


def absorb_short(clips: DataFrame, min_ms: int = 2000, merge_gap_ms: int = 1500) -> DataFrame:
    """Clips shorter than min_ms joined to a neighbour within reach, the nearer one (left on ties).

    What one clip takes changes the next, so this is a fold over a job's clips: it carries the clip put
    out last and a start left to the next one, and gives the state of the last one after each clip; the
    final state of each is taken.
    """
    max_gap = max(merge_gap_ms, min_ms * 3 // 2)
    note = F.lit("absorbed short clip")
    following = F.lead("start_ms").over(Window.partitionBy("job_id").orderBy("idx"))
    item = F.struct("idx", "start_ms", "end_ms", "reason", "_next")
    per = clips.withColumn("_next", following).groupBy("job_id").agg(F.array_sort(F.collect_list(item)).alias("_all"))

    def step(last: Column, x: Column) -> tuple[Column, Column]:
        held = last["held"].isNotNull()
        start = F.coalesce(last["held"], x["start_ms"])
        reason = F.when(held, _together(last["held_reason"], x["reason"], note)).otherwise(x["reason"])
        short = x["end_ms"] - start < min_ms
        before, after = start - last["end_ms"], x["_next"] - x["end_ms"]
        left = short & (last["n"] > 0) & (after.isNull() | (before <= after)) & (before <= max_gap)
        right = short & ~left & F.coalesce(after <= max_gap, F.lit(False))
        state = F.struct(
            (last["n"] + F.when(left | right, 0).otherwise(1)).alias("n"),
            F.when(left | right, last["start_ms"]).otherwise(start).alias("start_ms"),
            F.when(right, last["end_ms"]).otherwise(x["end_ms"]).alias("end_ms"),
            F.when(left, _together(last["reason"], reason, note)).when(right, last["reason"]).otherwise(reason).alias("reason"),
            F.when(right, start).alias("held"),
            F.when(right, reason).alias("held_reason"),
        )
        return state, state

    kind = "struct<n:int,start_ms:bigint,end_ms:bigint,reason:string,held:bigint,held_reason:string>"
    nothing = F.struct(F.lit(0).alias("n"), *[F.lit(None).alias(c) for c in ("start_ms", "end_ms", "reason", "held", "held_reason")])
    each = per.select("job_id", F.posexplode(running("_all", nothing, step, kind, kind)).alias("i", "s")).filter("s.n > 0")
    last = each.groupBy("job_id", F.col("s.n").alias("idx")).agg(F.max_by("s", "i").alias("s"))
    return last.select("job_id", "s.start_ms", "s.end_ms", "s.reason", "idx")


def stable_clips(invalid: DataFrame, durations: DataFrame, min_gap_ms: int = 350, min_clip_ms: int = 2000, merge_gap_ms: int = 1500) -> DataFrame:
    """Keep clips with short gaps merged and short clips absorbed."""
    raw = keep_clips(invalid, durations, min_gap_ms)
    return merge_short_gaps(absorb_short(merge_short_gaps(raw, merge_gap_ms), min_clip_ms, merge_gap_ms), merge_gap_ms)
