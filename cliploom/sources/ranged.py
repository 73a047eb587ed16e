"""Byte ranges of files, read inside executors: sampled fingerprints and long WAV files.

Paths are those of Spark's listings (file:, hdfs:, s3:, gs: and what else Arrow's file systems open). No row
and no task holds more than a range of a file.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 4 << 20


@contextmanager
def opened(path: str):
    """A file that can be read at any place."""
    from pyarrow import fs

    # Spark writes file:/a, Arrow reads file:///a
    system, own = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path) if ":" in path else f"file://{path}")
    with system.open_input_file(own) as file:
        yield file


def sample_starts(size: int, sample: int) -> list[int]:
    """Where the head, middle and tail blocks of a file begin; a file of up to three blocks has its head only."""
    return [0] if size <= 3 * sample else [0, (size - sample) // 2, size - sample]


def sampled_fingerprints(catalog: DataFrame, sample: int = SAMPLE, with_mtime: bool = True) -> DataFrame:
    """catalog (path, size[, mtime_ns]) -> the same with fingerprint and error.

    A fingerprint is the XXH3-128 of the size, the time of change and up to three blocks; without
    with_mtime copies of other times have the same. Files that can't be read have an error and no fingerprint.
    """
    names = [f.name for f in catalog.schema]
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in catalog.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            rows = batch.to_pylist()
            marks, errors = [], []
            for r in rows:
                try:
                    h = xxhash.xxh3_128(str(r["size"]).encode())
                    if with_mtime:
                        h.update(str(r["mtime_ns"]).encode())
                    with opened(r["path"]) as file:
                        for at in sample_starts(r["size"], sample):
                            h.update(file.read_at(min(sample, r["size"] - at), at))
                    marks.append(h.hexdigest())
                    errors.append(None)
                except (OSError, pa.ArrowException) as e:
                    marks.append(None)
                    errors.append(str(e)[:200])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks, pa.string()), pa.array(errors, pa.string())], names=[*names, "fingerprint", "error"])

    return catalog.mapInArrow(run, ", ".join([*kinds, "fingerprint string", "error string"]))


# ---- WAV files in ranges ----


def wav_header(file, size: int) -> tuple[int, int, int, int, int]:
    """(rate, channels, bits, first byte of the samples, their bytes) of a PCM WAV file; only chunk headers are read."""
    if file.read_at(min(12, size), 0)[:4] != b"RIFF" or file.read_at(4, 8) != b"WAVE":
        raise ValueError("not a WAV file")
    at, form = 12, None
    while at + 8 <= size:
        name, length = struct.unpack("<4sI", file.read_at(8, at))
        if name == b"fmt ":
            form = struct.unpack("<HHIIHH", file.read_at(16, at + 8))
        elif name == b"data" and form is not None:
            if form[0] != 1 or form[5] not in (8, 16):
                break
            return form[2], form[1], form[5], at + 8, min(length, size - at - 8)
        at += 8 + length + length % 2
    raise ValueError("not 8- or 16-bit PCM")


def wav_files(catalog: DataFrame) -> DataFrame:
    """catalog (path, size) -> (path, rate, channels, bits, start, bytes, error)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                try:
                    with opened(r["path"]) as file:
                        out.append((r["path"], *wav_header(file, r["size"]), None))
                except (ValueError, OSError, struct.error, pa.ArrowException) as e:
                    out.append((r["path"], *[None] * 5, str(e)[:200]))
            columns = list(zip(*out, strict=True)) or [()] * 7
            kinds = [pa.string(), *[pa.int32()] * 3, pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["path", "rate", "channels", "bits", "start", "bytes", "error"])

    return catalog.select("path", "size").mapInArrow(run, "path string, rate int, channels int, bits int, start long, bytes long, error string")


def wav_range_buckets(files: DataFrame, per_second: int = 20, range_bytes: int = 32 << 20) -> DataFrame:
    """wav_files() -> (path, bucket, low, high, sample_rate, duration_ms, error), scaled to -128..127.

    A file is cut in ranges of whole frames that any task may read; a bucket on a border is made of both
    sides' extremes. Unreadable files have one row with their error. Any range size gives the same.
    """
    good = files.filter("error is null").withColumn("frame", (F.col("channels") * F.col("bits") / 8).cast("int"))
    good = good.withColumn("frames", F.expr("bytes div frame")).withColumn("per", F.expr(f"greatest(1L, {range_bytes} div frame)"))
    ranges = good.filter("frames > 0").select("*", F.explode(F.expr("sequence(0L, (frames - 1) div per)")).alias("part"))
    n = max(8, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranges = ranges.select("path", "rate", "channels", "bits", "start", "frame", F.expr("part * per").alias("first"), F.expr("least(per, frames - part * per)").alias("many")).repartition(n, "path", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                with opened(r["path"]) as file:
                    raw = file.read_at(r["many"] * r["frame"], r["start"] + r["first"] * r["frame"])
                v = np.frombuffer(raw, np.uint8).astype(np.int64) - 128 if r["bits"] == 8 else np.frombuffer(raw, "<i2").astype(np.int64)
                v = v.reshape(-1, r["channels"]).sum(axis=1) // r["channels"]
                bucket = (r["first"] + np.arange(len(v))) // max(1, r["rate"] // per_second)
                at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["path"]] * len(at)), pa.array(bucket[at].astype(np.int32)), pa.array(np.minimum.reduceat(v, at)), pa.array(np.maximum.reduceat(v, at))],
                    names=["path", "bucket", "low", "high"],
                )

    parts = ranges.mapInArrow(run, "path string, bucket int, low long, high long").groupBy("path", "bucket").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    scaled = lambda c: F.least(F.greatest(F.bround(F.col(c) * 128 / F.when(F.col("bits") == 8, 128).otherwise(32768)), F.lit(-128)), F.lit(127)).cast("int")
    about = good.select("path", "bits", F.col("rate").alias("sample_rate"), F.expr("frames * 1000 div rate").alias("duration_ms"))
    none = F.lit(None)
    made = parts.join(about, "path").select("path", "bucket", scaled("low").alias("low"), scaled("high").alias("high"), "sample_rate", "duration_ms", none.cast("string").alias("error"))
    bad = files.filter("error is not null").select("path", *[none.cast("int").alias(c) for c in ("bucket", "low", "high", "sample_rate")], none.cast("long").alias("duration_ms"), "error")
    return made.unionByName(bad)
