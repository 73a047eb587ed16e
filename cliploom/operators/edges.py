"""Clip-edge quality: windows (job_id, idx, start_ms, end_ms) against words and excluded parts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cliploom.functions.lineage import checkpointed
from cliploom.operators.intervals import overlap_join
from cliploom.operators.transcript import words_of

MAX_SHIFT_MS, TOLERANCE_MS, LEAST_MS = 750, 80, 2000


def window_issues(windows: DataFrame, durations: DataFrame, least_ms: int = LEAST_MS) -> DataFrame:
    """(job_id, idx, code): invalid, overlapping and too short windows, and jobs without any."""
    bad = (F.col("start_ms") < 0) | (F.col("end_ms") <= F.col("start_ms")) | (F.col("end_ms") > F.col("duration_ms") + 1)
    before = Window.partitionBy("job_id").orderBy("start_ms", "idx").rowsBetween(Window.unboundedPreceding, -1)
    w = windows.join(durations, "job_id").withColumn("_bad", bad).withColumn("_end", F.when(~bad, F.col("end_ms")))
    w = w.withColumn("_prev", F.last("_end", ignorenulls=True).over(before))
    codes = F.when(F.col("_bad"), F.array(F.lit("invalid_window"))).otherwise(
        F.array_compact(
            F.array(
                F.when(F.col("start_ms") < F.col("_prev") - 1, "overlapping_clips"),
                F.when(F.col("end_ms") - F.col("start_ms") < least_ms, "clip_too_short"),
            )
        )
    )
    none = durations.join(windows, "job_id", "left_anti").select("job_id", F.lit(None).cast("int").alias("idx"), F.lit("no_kept_clips").alias("code"))
    return w.select("job_id", "idx", F.explode(codes).alias("code")).unionByName(none)


def window_edges(windows: DataFrame, durations: DataFrame, tolerance_ms: int = TOLERANCE_MS) -> DataFrame:
    """(job_id, idx, edge, at_ms, start_ms, end_ms, low_ms, high_ms): both edges of each window with its
    times and how far its neighbours let it go. Edges at the very ends of the source are exempt."""
    order = Window.partitionBy("job_id").orderBy("idx")
    sides = F.array(F.struct(F.lit("start").alias("edge"), F.col("start_ms").alias("at_ms")), F.struct(F.lit("end").alias("edge"), F.col("end_ms").alias("at_ms")))
    w = windows.select("job_id", "idx", "start_ms", "end_ms").join(durations, "job_id").withColumns(
        {"low_ms": F.coalesce(F.lag("end_ms").over(order), F.lit(0)), "high_ms": F.coalesce(F.lead("start_ms").over(order), F.col("duration_ms"))}
    )
    each = w.select("*", F.explode(sides).alias("s")).filter((F.col("s.at_ms") > tolerance_ms) & (F.col("s.at_ms") < F.col("duration_ms") - tolerance_ms))
    return each.select("job_id", "idx", "s.edge", "s.at_ms", "start_ms", "end_ms", "low_ms", "high_ms")


def edge_in_word(
    windows: DataFrame, words: DataFrame, durations: DataFrame, tolerance_ms: int = TOLERANCE_MS, bucket_ms: int | None = None, long_ms: int = 0
) -> DataFrame:
    """window_edges() that lie inside a word, with the first such word as w_start, w_end.

    words: a table of words, or segments that carry theirs as an array, or segments whose words follow
    from their texts (transcript.with_words); of segments only those that reach around an edge are
    joined, and their words are searched (or made first) beside the edge.
    """
    e = window_edges(windows, durations, tolerance_ms)
    inside = lambda x: (x["w_start"] + tolerance_ms < F.col("at_ms")) & (F.col("at_ms") < x["w_end"] - tolerance_ms)
    first = F.array_min(F.transform(F.filter("words", inside), lambda x: F.struct(x["w_start"].alias("w_start"), x["w_end"].alias("w_end"))))
    spread = "words" not in words.columns and "w_start" not in words.columns
    if spread:
        w = words.select("job_id", F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"), "text")
    elif "words" in words.columns:
        w = words.filter(F.size("words") > 0).select(
            "job_id", F.array_min(F.transform("words", lambda x: x["w_start"])).alias("r_start"), F.array_max(F.transform("words", lambda x: x["w_end"])).alias("r_end"), "words"
        )
    else:
        w = words.select("job_id", F.col("w_start").alias("r_start"), F.col("w_end").alias("r_end"))
        first = F.when((F.col("r_start") + tolerance_ms < F.col("at_ms")) & (F.col("at_ms") < F.col("r_end") - tolerance_ms), F.struct(F.col("r_start").alias("w_start"), F.col("r_end").alias("w_end")))
    # an edge is a range of one millisecond here; its window's times wait under other names
    points = e.withColumnsRenamed({"start_ms": "_from", "end_ms": "_to"}).withColumns({"start_ms": F.col("at_ms"), "end_ms": F.col("at_ms") + 1})
    key = ["job_id", "idx", "edge", "at_ms", "_from", "_to", "low_ms", "high_ms"]
    # the optimizer puts a filter before a join's own condition; so the search asks for the cheap one itself
    near = (F.col("start_ms") < F.col("r_end")) & (F.col("r_start") < F.col("end_ms"))
    pairs = overlap_join(points, w, "inner", bucket_ms, long_ms)
    if spread:
        pairs = pairs.withColumn("words", words_of("text", "r_start", "r_end"))
    hit = pairs.withColumn("w", F.when(near, first)).filter("w is not null")
    return hit.groupBy(*key).agg(F.min("w").alias("w")).select(
        "job_id", "idx", "edge", "at_ms", F.col("_from").alias("start_ms"), F.col("_to").alias("end_ms"), "low_ms", "high_ms", "w.w_start", "w.w_end"
    )


def edge_proposal(edges: DataFrame, excluded: DataFrame, max_shift_ms: int = MAX_SHIFT_MS, least_ms: int = LEAST_MS) -> DataFrame:
    """edge_in_word() -> (job_id, idx, edge, at_ms, to_ms): where each edge may go, null if nowhere is safe.

    Candidates are the word's nearer end for the edge, then the other; safe: a small shift, inside the
    neighbours, long enough, and no more overlap with any excluded part than before.
    """
    start = F.col("edge") == "start"
    options = F.when(start, F.array("w_start", "w_end")).otherwise(F.array("w_end", "w_start"))
    c = edges.select("*", F.posexplode(options).alias("nth", "to_ms"))
    c = c.withColumns({"_s": F.when(start, F.col("to_ms")).otherwise(F.col("start_ms")), "_e": F.when(start, F.col("end_ms")).otherwise(F.col("to_ms"))})
    fits = (
        (F.abs(F.col("to_ms") - F.col("at_ms")) <= max_shift_ms)
        & (F.col("_s") >= F.col("low_ms"))
        & (F.col("_e") <= F.col("high_ms"))
        & (F.col("_e") - F.col("_s") >= least_ms)
    )
    c = c.withColumn("_fits", fits)
    x = excluded.select(F.col("job_id").alias("_job"), F.col("start_ms").alias("x_start"), F.col("end_ms").alias("x_end"))
    over = lambda a, b: F.greatest(F.lit(0), F.least(b, F.col("x_end")) - F.greatest(a, F.col("x_start")))
    near = (F.col("job_id") == F.col("_job")) & F.col("_fits") & (F.col("x_start") < F.col("_e")) & (F.col("_s") < F.col("x_end"))
    # least and greatest pass over nulls, so candidates without any excluded part are told apart
    grows = F.col("x_start").isNotNull() & (over(F.col("_s"), F.col("_e")) > over(F.col("start_ms"), F.col("end_ms")) + 1)
    key = ["job_id", "idx", "edge", "at_ms"]
    tried = c.join(x, near, "left").groupBy(*key, "nth", "to_ms", "_fits").agg(F.bool_or(F.coalesce(grows, F.lit(False))).alias("_bad"))
    best = F.min(F.when(F.col("_fits") & ~F.col("_bad"), F.struct("nth", "to_ms")))
    return tried.groupBy(*key).agg(best.alias("b")).select(*key, "b.to_ms")


def quality_report(issues: DataFrame, repairable: DataFrame, windows: DataFrame) -> DataFrame:
    """One row per job of windows: score 100 - 25 per blocking issue - 5 per repairable edge."""
    b = issues.groupBy("job_id").agg(F.count(F.lit(1)).alias("blocking"))
    r = repairable.groupBy("job_id").agg(
        F.count_if(F.col("to_ms").isNotNull()).alias("repairable"), F.count_if(F.col("to_ms").isNull()).alias("stuck")
    )
    w = windows.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("windows"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("kept_ms"), F.min(F.col("end_ms") - F.col("start_ms")).alias("shortest_ms")
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    blocking = zero("blocking") + zero("stuck")
    return (
        w.join(b, "job_id", "left")
        .join(r, "job_id", "left")
        .select(
            "job_id",
            "windows",
            "kept_ms",
            "shortest_ms",
            blocking.alias("blocking"),
            zero("repairable").alias("repairable"),
            F.greatest(F.lit(0), 100 - 25 * blocking - 5 * zero("repairable")).alias("score"),
            ((blocking == 0) & (zero("repairable") == 0)).alias("passed"),
        )
    )


def refine_boundaries(
    windows: DataFrame, words: DataFrame, excluded: DataFrame, durations: DataFrame, max_attempts: int = 3, tolerance_ms: int = TOLERANCE_MS, max_shift_ms: int = MAX_SHIFT_MS, least_ms: int = LEAST_MS
) -> DataFrame:
    """Windows after up to max_attempts moves of each job's first repairable edge, with its outcome.

    Every round looks only at jobs that are still open. Outcomes: accepted; needs_review (a blocking
    issue); no_progress_or_oscillation (the move would give windows the job had before, and isn't made);
    attempt_budget_exhausted (still not clean after the last move); regression_rolled_back (a lower
    score or more blocking issues than at first: the job has its first windows again). The rounds are
    bounded, so the plan is unrolled; each is cut from its lineage, and so is a table of words.
    """
    if "w_start" in words.columns:  # else a written table
        words = checkpointed(words)
    open_ = windows.withColumns({"_start": F.col("start_ms"), "_end": F.col("end_ms")}).join(
        window_fingerprint(windows).select("job_id", F.array("fingerprint").alias("_seen")), "job_id"
    )
    open_ = checkpointed(open_.withColumns({"_score": F.lit(None).cast("int"), "_blocking": F.lit(None).cast("long")}))
    done = []
    for attempt in range(max_attempts + 1):
        last = attempt == max_attempts
        hits = edge_in_word(open_, words, durations, tolerance_ms)
        moves = checkpointed(edge_proposal(hits, excluded, max_shift_ms, least_ms))  # a few rows a job, used twice
        issues = window_issues(open_, durations.join(open_, "job_id", "left_semi"), least_ms)
        report = quality_report(issues, moves, open_).select("job_id", F.col("score").alias("_now"), F.col("blocking").alias("_b"), F.col("passed").alias("_ok"))
        first = moves.filter("to_ms is not null").groupBy("job_id").agg(F.min(F.struct("idx", (F.col("edge") == "end").alias("late"), "to_ms")).alias("m"))
        state = open_.join(report, "job_id").join(first, "job_id", "left")
        hit = F.col("idx") == F.col("m.idx")
        state = state.withColumns(
            {
                "_score": F.coalesce("_score", "_now"),
                "_blocking": F.coalesce("_blocking", "_b"),
                "_s": F.when(hit & ~F.col("m.late"), F.col("m.to_ms")).otherwise(F.col("start_ms")),
                "_e": F.when(hit & F.col("m.late"), F.col("m.to_ms")).otherwise(F.col("end_ms")),
            }
        )
        moved = window_fingerprint(state.select("job_id", "idx", F.col("_s").alias("start_ms"), F.col("_e").alias("end_ms")))
        stop = F.when(F.col("_ok"), "accepted")
        stop = stop.otherwise("attempt_budget_exhausted") if last else stop.when(F.col("_b") > 0, "needs_review").when(F.array_contains("_seen", F.col("fingerprint")), "no_progress_or_oscillation")
        worse = (F.col("_now") < F.col("_score")) | (F.col("_b") > F.col("_blocking"))
        state = state.join(moved, "job_id").withColumn("outcome", stop)
        state = checkpointed(state.withColumn("outcome", F.when(F.col("outcome").isNotNull() & worse, "regression_rolled_back").otherwise(F.col("outcome"))))
        back = F.col("outcome") == "regression_rolled_back"
        own = {"start_ms": F.when(back, F.col("_start")).otherwise(F.col("start_ms")), "end_ms": F.when(back, F.col("_end")).otherwise(F.col("end_ms"))}
        done.append(
            state.filter("outcome is not null").select(
                *[own.get(c, F.col(c)).alias(c) for c in windows.columns], "outcome", F.lit(min(attempt + 1, max_attempts)).alias("attempts")
            )
        )
        if last or state.filter("outcome is null").isEmpty():
            break
        next_ = {"start_ms": F.col("_s"), "end_ms": F.col("_e"), "_seen": F.concat("_seen", F.array("fingerprint"))}
        open_ = state.filter("outcome is null").select(*[next_.get(c, F.col(c)).alias(c) for c in open_.columns])
    return reduce(DataFrame.unionByName, done)


def window_fingerprint(windows: DataFrame) -> DataFrame:
    """A digest of each job's windows, to pass over unchanged jobs."""
    per = windows.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("idx", "start_ms", "end_ms"))).alias("_all"))
    text = F.array_join(F.transform("_all", lambda x: F.concat_ws(",", x["idx"], x["start_ms"], x["end_ms"])), ";")
    return per.select("job_id", F.sha2(text, 256).alias("fingerprint"))
