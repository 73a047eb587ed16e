"""Detector, decoder and error logs, line by line: (job_id, line_no, line)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_MS = r"([0-9]+(?:\.[0-9]+)?)"


def _ms(line: str, pattern: str, group: int = 1) -> Column:
    found = F.regexp_extract(line, pattern, group)
    return F.when(found != "", F.floor(found.cast("double") * 1000 + 0.5))


def parse_range_log(lines: DataFrame, kind: str = "silence") -> DataFrame:
    """Ranges of a detector log (silence, freeze): an end takes the oldest start that is still open, else
    end - duration. An end line without its duration is no event.

    A queue in window form: with S and E the starts and ends so far and U the greatest E - S so far
    (ends without a start), an end that raises U has no start, any other takes start number E - U.
    """
    order = Window.partitionBy("job_id").orderBy("line_no")
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    ended = rf"{kind}_end:\s*{_MS}\s*\|\s*{kind}_duration:\s*{_MS}"
    marked = lines.select(
        "job_id",
        "line_no",
        _ms("line", rf"{kind}_start:\s*{_MS}").alias("s"),
        _ms("line", ended, 1).alias("e"),
        _ms("line", ended, 2).alias("d"),
    ).filter("s is not null or e is not null")
    counted = (
        marked.withColumn("n_starts", F.count("s").over(run))
        .withColumn("n_ends", F.count("e").over(run))
        .withColumn("surplus", F.greatest(F.lit(0), F.max(F.col("n_ends") - F.col("n_starts")).over(run)))
        .withColumn("surplus_before", F.coalesce(F.lag("surplus").over(order), F.lit(0)))
    )
    starts = counted.filter("s is not null").select("job_id", F.col("n_starts").alias("no"), F.col("s").alias("from_start"))
    ends = counted.filter("e is not null").withColumn(
        "no", F.when(F.col("surplus") == F.col("surplus_before"), F.col("n_ends") - F.col("surplus"))
    )
    return (
        ends.join(starts, ["job_id", "no"], "left")
        .select(
            "job_id",
            "line_no",
            F.coalesce("from_start", F.greatest(F.lit(0), F.col("e") - F.coalesce("d", F.lit(0)))).alias("start_ms"),
            F.col("e").alias("end_ms"),
        )
    )


def parse_scene_log(lines: DataFrame, max_events: int = 10_000) -> DataFrame:
    """Distinct scene times in first-seen order; `error` marks jobs with too many."""
    t = lines.select("job_id", "line_no", _ms("line", rf"pts_time:\s*{_MS}").alias("time_ms")).filter("time_ms is not null")
    first = t.groupBy("job_id", "time_ms").agg(F.min("line_no").alias("line_no"))
    return first.withColumn(
        "error", F.when(F.count(F.lit(1)).over(Window.partitionBy("job_id")) > max_events, "too many scene marks")
    )


#: What a decoder's error lines hold where the source is damaged (fixed values).
DECODE_ERRORS = ("error while decoding", "invalid data", "left block unavailable", "reference", "bytestream", "corrupt")


def integrity_status(runs: DataFrame, lines: DataFrame, progress: DataFrame, max_errors: int = 40) -> DataFrame:
    """(job_id, status, error_count, truncated, completed_ms): one row for each run of a decoder.

    runs (job_id, returncode; null: it ran out of time), lines (job_id, line_no, line) of its errors,
    progress (job_id, line) of its progress. The first max_errors error lines that aren't blank decide
    between corrupt and what the return code says; they are ranked, never gathered in one row. A job's
    last progress is the largest it reports.
    """
    first = Window.partitionBy("job_id").orderBy("line_no")
    marks = F.lit(False)
    for mark in DECODE_ERRORS:
        marks = marks | F.contains(F.lower("line"), F.lit(mark))
    errors = (
        lines.filter(F.trim("line") != "")
        .select("job_id", marks.alias("_bad"), F.row_number().over(first).alias("_n"))
        .groupBy("job_id")
        .agg(F.count(F.lit(1)).alias("_count"), F.max(F.col("_bad") & (F.col("_n") <= max_errors)).alias("_corrupt"))
    )
    micros = F.regexp_extract("line", r"out_time_(?:us|ms)=(\d+)", 1)
    part = lambda i: F.regexp_extract("line", r"out_time=(\d+):(\d+):([\d.]+)", i)
    clock = part(1).cast("double") * 3600 + part(2).cast("double") * 60 + part(3).cast("double")
    reached = F.when(micros != "", micros.cast("double") / 1_000_000).when(part(1) != "", clock)
    done = progress.groupBy("job_id").agg(F.max(reached).alias("_done"))
    status = (
        F.when(F.col("returncode").isNull(), "timeout")
        .when(F.coalesce("_corrupt", F.lit(False)), "corrupt")
        .when(F.col("returncode") == 0, "ok")
        .otherwise("failed")
    )
    count = F.coalesce("_count", F.lit(0))
    return (
        runs.join(errors, "job_id", "left")
        .join(done, "job_id", "left")
        .select(
            "job_id",
            status.alias("status"),
            count.alias("error_count"),
            (count >= max_errors).alias("truncated"),
            F.floor(F.col("_done") * 1000 + 0.5).cast("long").alias("completed_ms"),
        )
    )


def severe_corruption(status: DataFrame, limit: int = 40) -> DataFrame:
    return status.filter((F.col("status") == "corrupt") & (F.col("error_count") >= limit))


def progress_percent(lines: DataFrame, durations: DataFrame) -> DataFrame:
    """Rows on which the whole percent of a job's progress rises, from time=H:M:S marks."""
    part = lambda i: F.regexp_extract("line", r"time=(\d+):(\d+):(\d+(?:\.\d+)?)", i)
    seconds = part(1).cast("double") * 3600 + part(2).cast("double") * 60 + part(3).cast("double")
    p = lines.filter(part(1) != "").join(durations, "job_id").withColumn(
        "percent", F.floor(F.least(F.greatest(seconds * 100_000 / F.col("duration_ms"), F.lit(0.0)), F.lit(100.0)))
    )
    before = Window.partitionBy("job_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return (
        p.withColumn("_b", F.max("percent").over(before))
        .filter(F.col("_b").isNull() | (F.col("percent") > F.col("_b")))
        .select("job_id", "line_no", "percent")
    )


def content_crop(lines: DataFrame, frames: DataFrame) -> DataFrame:
    """The crop of each job: last mark of each sample, upper median of each axis, kept if it is worth it.

    lines (job_id, sample, line_no, line); frames (job_id, width, height). Worth it: inside the frame,
    at least 3 % off one axis and at least half of both left; else the whole frame.
    """
    num = lambda i: F.regexp_extract("line", r"crop=(\d+):(\d+):(\d+):(\d+)", i).cast("int")
    last = (
        lines.filter(F.col("line").rlike(r"crop=\d+:\d+:\d+:\d+"))
        .groupBy("job_id", "sample")
        .agg(F.max_by(F.struct(num(1).alias("w"), num(2).alias("h"), num(3).alias("x"), num(4).alias("y")), "line_no").alias("c"))
    )
    upper = lambda c: F.element_at(F.sort_array(F.collect_list(f"c.{c}")), (F.floor(F.count(F.lit(1)) / 2) + 1).cast("int")).alias(f"_{c}")
    m = last.groupBy("job_id").agg(*[upper(c) for c in "whxy"])
    j = frames.join(m, "job_id", "left")
    fits = (F.col("_x") + F.col("_w") <= F.col("width")) & (F.col("_y") + F.col("_h") <= F.col("height"))
    worth = (F.col("_w") <= 0.97 * F.col("width")) | (F.col("_h") <= 0.97 * F.col("height"))
    enough = (F.col("_w") >= 0.5 * F.col("width")) & (F.col("_h") >= 0.5 * F.col("height"))
    use = F.coalesce(fits & worth & enough, F.lit(False))
    pick = lambda c, whole: F.when(use, F.col(f"_{c}")).otherwise(whole).alias(c)
    return j.select("job_id", pick("w", F.col("width")), pick("h", F.col("height")), pick("x", F.lit(0)), pick("y", F.lit(0)))


#: Error classes in order of precedence: code and the pattern in an error's lower-cased text (fixed values).
ERROR_RULES = (
    ("gpu_memory", r"cuda out of memory|cublas|cudnn|vram|gpu memory|outofmemory|显存"),
    ("nvenc_unavailable", r"openencodesessionex|incompatible client key|no capable devices|nvenc.*(?:unavailable|failed)"),
    ("missing_ffmpeg", r"(ffmpeg|ffprobe).*(not found|winerror 2|no such file|cannot find)|winerror 2.*(ffmpeg|ffprobe)"),
    ("empty_transcript", r"empty transcript|empty segments|no speech|未检测到语音|转写.*空|transcription returned empty"),
    ("disk_space", r"no space left|not enough space|disk full|磁盘空间不足"),
)


def classify_error(text: Column) -> Column:
    """The code of the first rule that an error's text meets, else generic. A dot stops at line feeds."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit("generic")
    for code, pattern in reversed(ERROR_RULES):
        out = F.when(low.rlike("(?d)" + pattern), code).otherwise(out)
    return out


def subtitle_line_counts(lines: DataFrame) -> DataFrame:
    """Visual lines of each Dialogue row: breaks in its tenth field and one. The word counts in any case and
    behind white space; rows of fewer fields are no events."""
    fields = F.split("line", ",", 10)
    rows = lines.filter(F.col("line").rlike(r"(?i)^\s*dialogue:") & (F.size(fields) == 10))
    return rows.select("job_id", "line_no", (F.regexp_count(F.try_element_at(fields, F.lit(10)), F.lit(r"\\[Nn]")) + 1).alias("lines"))
