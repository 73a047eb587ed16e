"""Streams with state: what they hold, what they let go, and that a drained stream equals the batch form."""

from datetime import datetime, timedelta

import pytest

from cliploom.streaming import jobs as batch_form
from cliploom.streaming import state


def batches(spark, folder, schema, *files):
    """Rows in files that a stream takes one by one, in this order."""
    for n, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/b{n}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
    return stream.parquet(f"{folder}/*"), spark.read.schema(schema).parquet(f"{folder}/*")


def values_of(spark, folder, name):
    return spark.read.format("statestore").option("stateVarName", name).load(f"{folder}/checkpoint").collect()


def test_latest_states_equal_batch_and_end(spark, tmp_path):
    folder = str(tmp_path)
    stream, table = batches(
        spark,
        f"{folder}/in",
        "job long, version long, status string",
        [(1, 1, "queued"), (2, 5, "transcribing"), (3, 1, "queued")],
        [(1, 3, "done"), (2, 4, "queued"), (2, 5, "queued")],  # job 2: lower versions, and an equal one
        [(2, 6, "transcribing"), (3, 1, "queued")],
        [(2, 7, "transcribing")],
    )
    with state.rocksdb(spark, idle_batches=False):
        rows = state.drained(state.latest_states(stream, linger_seconds=0), folder, "update")
    got = {}
    for r in sorted(rows.collect(), key=lambda r: r["batch"]):
        assert r["job"] not in got or (r["version"], r["status"]) > got[r["job"]]  # never falls
        got[r["job"]] = (r["version"], r["status"])
    assert got == {r["job"]: (r["version"], r["status"]) for r in batch_form.latest_state(table).collect()}
    assert len([r for r in rows.collect() if r["job"] == 2]) == 3  # the late lower version told nothing
    held = {r["key"]["job"]: (r["value"]["version"], r["value"]["status"]) for r in values_of(spark, folder, "latest")}
    assert held == {2: (7, "transcribing"), 3: (1, "queued")}  # job 1 is done, so its state is gone


def test_a_straggler_within_the_linger_is_still_told_apart(spark, tmp_path):
    stream, _ = batches(spark, f"{tmp_path}/in", "job long, version long, status string", [(1, 3, "done")], [(1, 2, "transcribing")])
    with state.rocksdb(spark, idle_batches=False):
        rows = state.drained(state.latest_states(stream, linger_seconds=3600), str(tmp_path), "update").collect()
    assert [(r["version"], r["status"]) for r in rows] == [(3, "done")]


def test_lost_jobs_by_the_next_sign_or_the_watermark(spark, tmp_path):
    t = datetime(2024, 1, 1)
    at = lambda s: t + timedelta(seconds=s)
    stream, _ = batches(spark, f"{tmp_path}/in", "job long, at timestamp", [(1, at(0)), (1, at(20)), (2, at(0)), (3, at(0))], [(1, at(60)), (2, at(31))], [(1, at(100))])
    with state.rocksdb(spark):
        rows = state.drained(state.lost_jobs(stream.withWatermark("at", "1 second"), 30), str(tmp_path)).collect()
    # 20 + 30 and 60 + 30 by the next sign, 0 + 30 by the next sign and 31 + 30 by the watermark, 0 + 30 by the watermark
    assert sorted((r["job"], (r["lost_at"] - t).seconds) for r in rows) == [(1, 50), (1, 90), (2, 30), (2, 61), (3, 30)]
    assert {r["key"]["job"] for r in values_of(spark, str(tmp_path), "last")} == {1}


def test_a_file_that_grows_is_told_once_it_stopped(spark, tmp_path):
    stream, _ = batches(
        spark,
        f"{tmp_path}/in",
        "path string, size long, mtime long, seen_at long",
        [("a.mp4", 1, 1, 1), ("b.mp4", 9, 1, 1)],
        [("a.mp4", 2, 1, 2), ("b.mp4", 9, 1, 2)],
        [("a.mp4", 2, 2, 3), ("b.mp4", 9, 1, 3)],
        [("a.mp4", 2, 2, 4), ("b.mp4", 9, 1, 4)],
        [("a.mp4", 2, 2, 5), ("b.mp4", 10, 1, 5), ("b.mp4", 10, 1, 6)],
    )
    with state.rocksdb(spark):
        rows = state.drained(state.stable_files(stream), str(tmp_path)).collect()
    assert sorted((r["path"], r["size"], r["seen_at"]) for r in rows) == [("a.mp4", 2, 4), ("b.mp4", 9, 2)]


def test_sightings_of_a_folder(spark, tmp_path):
    media = tmp_path / "media"
    (media / "deep").mkdir(parents=True)
    (media / "deep" / "x.MP4").write_bytes(b"123")
    (media / "note.txt").write_text("no")
    for _ in range(2):
        state.record_sighting(spark, str(media), f"{tmp_path}/seen")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/seen").schema).parquet(f"{tmp_path}/seen")
    with state.rocksdb(spark):
        (row,) = state.drained(state.stable_files(stream), str(tmp_path / "q")).collect()
    assert row["path"].endswith("deep/x.MP4") and row["size"] == 3


@pytest.mark.parametrize("keep", [3, 500])
def test_a_batch_that_runs_twice_is_there_once(spark, tmp_path, keep):
    files = [[(i, f"t{i}") for i in range(n, n + 4)] for n in (1, 5, 9)]
    stream, table = batches(spark, f"{tmp_path}/in", "id long, type string", *files)
    path = f"{tmp_path}/tail"
    state.tail_table(stream, path, f"{tmp_path}/checkpoint", keep).awaitTermination()
    # the same batch again, as after a failure between write and commit
    state.into(path)(spark.createDataFrame(files[2], "id long, type string"), 2)
    got = state.read_tail(spark, path, after=2, keep=keep).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, batch_form.tail_events(table, 2, keep).collect()))
    left = {r["batch"] for r in spark.read.parquet(path).select("batch").distinct().collect()}
    assert left == ({2} if keep == 3 else {0, 1, 2})
