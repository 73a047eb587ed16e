"""Golden rows of the rules, plans without exchanges, time buckets, ranged reads and incremental reports."""

import os
import random
import re
import struct
import wave
from datetime import datetime

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cliploom.functions.arrays import characters, spaces, widths
from cliploom.functions.text import char_width, text_width
from cliploom.operators import cuts, edges, intervals, library, logs, platform, subtitles, transcript, waveform
from cliploom.plans import registry
from cliploom.sources import compaction, incremental, ranged
from cliploom.sources.library import write_library

SF = "/root/testdata/sf0.001"

# ---- gate ----

MEASURED = "job_id int, refinement string, render_bytes long, duration_seconds double, width int, height int, lines int, segments int, cover boolean, loudness double"
POLICY = "aspect string, max_lines int, cover_required boolean, duration_min_seconds double, duration_max_seconds double, loudness_min_lufs double, loudness_max_lufs double"
GOOD = (None, 10, 30.0, 1080, 1920, 1, 1, True, None)
FREE = ("", 2, False, None, None, None, None)


@pytest.mark.parametrize(
    ("measured", "policy", "blocking", "advisory", "status"),
    [
        (GOOD, FREE, [], [], "passed"),
        ((None, 10, 120.0, 1920, 1080, 3, 1, False, -30.0), ("9:16", 2, True, None, None, -20.0, -10.0), ["aspect_ratio", "subtitle_overflow", "cover_missing", "audio_loudness"], [], "blocked"),
        ((None, 10, 30.0, 1080, 1920, 2, 1, True, None), ("9:16", 2, True, None, None, -20.0, None), [], ["audio_loudness_missing"], "advisory"),
        # one bound counts alone; without any nothing is asked
        ((None, 10, 30.0, 1080, 1920, 1, 1, True, -5.0), ("", 2, False, None, None, None, -10.0), ["audio_loudness"], [], "blocked"),
        ((None, 10, 30.0, 1080, 1920, 1, 1, True, -25.0), ("", 2, False, None, None, -20.0, None), ["audio_loudness"], [], "blocked"),
        ((None, 10, 30.0, 1080, 1920, 1, 1, True, -99.0), FREE, [], [], "passed"),
        # unknown or zero sizes fail an aspect, and so does an aspect that is none
        ((None, 10, 30.0, None, 1920, 1, 1, True, None), ("9:16", 2, False, None, None, None, None), ["aspect_ratio"], [], "blocked"),
        ((None, 10, 30.0, 1080, 0, 1, 1, True, None), ("9:16", 2, False, None, None, None, None), ["aspect_ratio"], [], "blocked"),
        ((None, 10, 30.0, 1080, 1920, 1, 1, True, None), ("9:0", 2, False, None, None, None, None), ["aspect_ratio"], [], "blocked"),
        ((None, 10, 30.0, 1080, 1920, 1, 1, True, None), ("tall", 2, False, None, None, None, None), ["aspect_ratio"], [], "blocked"),
        ((None, 10, 30.0, 1080, 1910, 1, 1, True, None), ("9:16", 2, False, None, None, None, None), [], [], "passed"),
        # durations
        ((None, 10, None, 1080, 1920, 1, 1, True, None), FREE, ["duration_invalid"], [], "blocked"),
        ((None, 10, 3.0, 1080, 1920, 1, 1, True, None), ("", 2, False, 5.0, None, None, None), ["duration_limit"], [], "blocked"),
        ((None, 10, 61.0, 1080, 1920, 1, 1, True, None), ("", 2, False, 0.0, 60.0, None, None), ["duration_limit"], [], "blocked"),
        ((None, 10, 61.0, 1080, 1920, 1, 1, True, None), ("", 2, False, 0.0, 0.0, None, None), [], [], "passed"),
        # subtitles that weren't rendered, refinement, video
        ((None, 10, 30.0, 1080, 1920, None, 3, True, None), FREE, [], ["subtitles_unverified"], "advisory"),
        ((None, 10, 30.0, 1080, 1920, None, 0, True, None), FREE, [], [], "passed"),
        (("accepted", 10, 30.0, 1080, 1920, 1, 1, True, None), FREE, [], [], "passed"),
        (("needs_review", 0, 30.0, 1080, 1920, 1, 1, True, None), FREE, ["clip_refinement_required", "render_missing"], [], "blocked"),
        ((None, None, 30.0, 1080, 1920, 1, 1, True, None), FREE, ["render_missing"], [], "blocked"),
    ],
)
def test_quality_gate(spark, measured, policy, blocking, advisory, status):
    jobs = spark.createDataFrame([(1, *measured, *policy)], f"{MEASURED}, {POLICY}")
    row = platform.quality_gate(jobs).first()
    assert (row["blocking"], row["advisory"], row["status"]) == (blocking, advisory, status)


def test_policy_of_a_kit(spark):
    kits = spark.createDataFrame(
        [("a", '{"aspect": "9:16", "subtitle_style": {"max_lines": 3}, "metadata_style": {"quality_gate": {"aspect": "1:1"}}}'), ("b", '{"aspect": " 16:9 ", "cover_style": {"required": true}}'), ("c", "{}")],
        "snapshot_id string, payload_json string",
    )
    jobs = spark.createDataFrame([(i, s) for i, s in enumerate(["a", "b", "c", None])], "job_id int, snapshot_id string")
    got = [(r["aspect"], r["max_lines"], r["max_chars"], r["cover_required"]) for r in platform.gate_policy(jobs, kits).orderBy("job_id").collect()]
    assert got == [("1:1", 3, 18, False), ("16:9", 2, 18, True), ("", 2, 18, False), ("", 2, 18, False)]


# ---- retention, runtime, preview, logs ----


def test_retention(spark):
    old, new = datetime(2024, 1, 1), datetime(2024, 2, 1)
    jobs = spark.createDataFrame(
        [("done", "done", old), ("bare", "done", old), ("review", "needs_review", old), ("busy", "running", old), ("odd", " ", old), ("young", "done", new), ("null", None, old), ("caps", " Failed ", old)], "job_name string, status string, updated_at timestamp"
    )
    names = ["final.mp4", "audio.wav", "deep/AUDIO_HQ.flac", "song.wav", "p.tmp.mp4", "x.uploading", "y.tmp", "audio.wav.bak"]
    rows = [("done", n, 10) for n in names] + [("bare", "audio.wav", 10), ("review", "final.mp4", 5), ("caps", "a", 7)]
    files = spark.createDataFrame(rows, "job_name string, name string, size_bytes long")
    cutoff = F.lit(datetime(2024, 1, 15))
    got = lambda mode: {r["job_name"]: (r["reason"], r["files"], r["bytes"]) for r in library.retention_plan(jobs, files, cutoff, mode).collect()}
    stay = {"busy": ("active_job", None, None), "odd": ("unknown_status", None, None), "young": ("retention_not_reached", None, None), "null": ("unknown_status", None, None)}
    assert got("all") == stay | {"done": (None, None, 80), "bare": (None, None, 10), "review": (None, None, 5), "caps": (None, None, 7)}
    final = ("final_output_required", None, None)
    assert got("intermediates") == stay | {"done": (None, 5, 50), "bare": final, "review": final, "caps": final}
    with pytest.raises(ValueError):
        library.retention_plan(jobs, files, cutoff, "some")


def test_runtime_state(spark):
    jobs = spark.createDataFrame([(n, s) for n, s in [("stale", "transcribing"), ("queued", "done"), ("paused", "created"), ("cancel", "rendering"), ("live", "rendering"), ("over", "done"), ("fresh", "created")]], "job_name string, status string")
    queue = spark.createDataFrame([("queued", "running", False), ("paused", "paused", False), ("cancel", "pending", True), ("over", "done", False)], "job_name string, queue_status string, cancel_requested boolean")
    runs = spark.createDataFrame([("live", 1, 1, "failed", False), ("live", 2, 2, "running", True), ("over", 1, 1, "running", True), ("stale", 1, 1, "running", True), ("stale", 2, 2, "running", False)], "job_name string, run_id int, started_at int, status string, alive boolean")
    got = {r[0]: tuple(r)[1:] for r in library.runtime_state(jobs, queue, runs).collect()}  # active, stale, can_cancel, can_delete
    assert got == {
        "stale": (False, True, True, True),
        "queued": (True, False, False, False),
        "paused": (True, False, True, False),
        "cancel": (True, False, False, False),
        "live": (True, False, True, False),
        "over": (False, False, False, True),
        "fresh": (False, True, True, True),
    }


def test_preview(spark):
    schema = "job_id int, platform string, titles array<string>, cover_titles array<string>, descriptions array<string>, tags array<string>, hashtags array<string>, platform_notes array<string>"
    rows = [
        (1, "douyin", [" ", " " + "x" * 53 + " yz"], ["c"], ["", " d "], ["t", " "] * 20, ["#a", " b ", ""], ["n"] * 9),
        (2, "bilibili", None, [" cover "], None, None, None, None),
        (3, "bilibili", ["x" * 81], [], [], [], [], []),
    ]
    one, two, three = platform.metadata_preview(spark.createDataFrame(rows, schema)).orderBy("job_id").collect()
    assert (one["title"], one["description"], len(one["tags"]), one["hashtags"], len(one["notes"])) == ("x" * 53 + "…", "d", 12, ["#a", "#b"], 8)
    assert (two["title"], two["description"], two["tags"], two["hashtags"], two["notes"]) == ("cover", "", [], [], [])
    assert three["title"] == "x" * 79 + "…"


def test_logs_of_odd_lines(spark):
    lines = ["Dialogue: 0,a,b,c,,0,0,0,,one\\Ntwo\\nthree", "  dialogue: 0,a,b,c,,0,0,0,,x, y", "Dialogue: 0,a,b", "Comment: 0,a,b,c,,0,0,0,,z"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "job_id int, line_no int, line string")
    assert sorted((r["line_no"], r["lines"]) for r in logs.subtitle_line_counts(df).collect()) == [(0, 3), (1, 1)]
    lines = ["freeze_start: 10.0", "freeze_end: 13.25 | freeze_duration: 3.25", "freeze_end: 20.0", "silence_end: 5.0 | silence_duration: 1.0"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "job_id int, line_no int, line string")
    assert [(r["start_ms"], r["end_ms"]) for r in logs.parse_range_log(df, "freeze").collect()] == [(10_000, 13_250)]


# ---- transcripts and subtitles ----


def test_untimed_behind_timed(spark):
    e = spark.createDataFrame([(1, 0, "aa"), (1, 1, "bb"), (2, 0, "c")], "job_id int, seg_idx int, text string")
    d = spark.createDataFrame([(1, 10_000), (2, 4_000)], "job_id int, duration_ms long")
    s = spark.createDataFrame([(1, 6_000)], "job_id int, from_ms long")
    got = transcript.allocate_untimed(e, d, starts=s).orderBy("job_id", "seg_idx").collect()
    assert [(r["start_ms"], r["end_ms"]) for r in got] == [(6_000, 8_000), (8_000, 10_000), (0, 4_000)]


def test_bounds_and_chances(spark):
    words = "array<struct<word_idx:int,w_start:bigint,w_end:bigint,word:string>>"
    df = spark.createDataFrame([(1, i, 0, 5000, " " + "x" * 5000, [(k, k, k + 1, " " + "w" * 200) for k in range(300)]) for i in range(201)], f"job_id int, seg_idx int, start_ms long, end_ms long, text string, words {words}")
    got = transcript.bound_segments(df).collect()
    assert len(got) == 200 and {len(r["text"]) for r in got} == {4096} and {len(r["words"]) for r in got} == {200} and {len(w["word"]) for r in got[:2] for w in r["words"]} == {128}
    s = spark.createDataFrame([(i, 0, 0, 2000, "clear words here", p) for i, p in enumerate([0.2, 0.9, None])], "job_id int, seg_idx int, start_ms long, end_ms long, text string, avg_probability double")
    assert sorted(r["job_id"] for r in transcript.filter_subtitles(s, least_probability=0.4).collect()) == [1, 2]
    assert transcript.filter_subtitles(s).count() == 3


def test_words_beside_their_segment_are_those_of_the_table(spark):
    s = spark.createDataFrame([(1, 0, 0, 999, "a  bb ccc"), (1, 1, 1000, 2001, " lead 漢字 é "), (1, 2, 3, 4, "")], "job_id int, seg_idx int, start_ms long, end_ms long, text string")
    flat = [(r["seg_idx"], *w) for r in transcript.with_words(s).collect() for w in r["words"]]
    table = [(r["seg_idx"], r["word_idx"], r["w_start"], r["w_end"], r["word"]) for r in transcript.spread_words(s).collect()]
    assert sorted(flat) == sorted(table)


def test_documents_have_their_head(spark):
    e = spark.createDataFrame([(1, 0, 0, 62_345, 70_000, "a{b}\\c\nd")], "job_id int, seg_idx int, event_idx int, start_ms long, end_ms long, text string")
    jobs = spark.createDataFrame([(1, 1080, 1920, None, None), (2, 1080, 0, 640, 480), (3, None, None, None, None)], "job_id int, crop_w int, crop_h int, width int, height int")
    sizes = subtitles.play_resolution(jobs)
    assert [tuple(r)[1:] for r in sizes.orderBy("job_id").collect()] == [(1080, 1920), (640, 480), (1920, 1080)]
    one, two, _ = [r["document"] for r in subtitles.ass_documents(e, sizes, "DouYin", 66).orderBy("job_id").collect()]
    assert "PlayResX: 1080\nPlayResY: 1920\n" in one and ",66,&H00FFFFFF" in one and ",80,80,180,1" in one
    assert one.endswith("Dialogue: 0,0:01:02.34,0:01:10.00,Default,,0,0,0,,a\\{b\\}\\\\c\\Nd\n")
    assert two.endswith("Effect, Text\n") and ",52,&H00FFFFFF" in two


# ---- plans ----


@pytest.mark.parametrize("name", ["c8_scenes_per_clip", "c9_transcript_per_clip", "c11_flagship_cut_plan", "c13_semantic_score", "c15_highlight_cut", "b2_edge_in_word", "b3_edge_proposal"])
def test_bucketed_tables_need_no_exchange(spark, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Exchange" not in plan and "SortMergeJoin" in plan and plan.count("FileScan") <= 4


def test_queue_places_without_one_task(spark):
    rows = [(i, i * 7919 % 5, i * 31 % 3, i % 2, "pending" if i % 10 else "done") for i in range(2000)]
    q = spark.createDataFrame(rows, "id int, priority int, position int, created_at int, status string").repartition(5)
    ranked = library.queue_order(q)
    want = sorted((r for r in rows if r[4] == "pending"), key=lambda r: (-r[1], r[2], r[3], r[0]))
    assert [r["id"] for r in ranked.orderBy("place").collect()] == [r[0] for r in want]
    assert sorted(r["place"] for r in ranked.collect()) == list(range(1, len(want) + 1))
    assert "SinglePartition" not in ranked._jdf.queryExecution().toString()
    assert library.queue_order(q.limit(0)).count() == 0


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("long_ms", [0, 400_000, 10**9])
def test_time_buckets_change_nothing(spark, how, long_ms):
    r = random.Random(how + str(long_ms))
    left = [(j := r.randint(1, 4), i, a := r.randint(0, 300_000 * j // 2), a + r.randint(1, 90_000)) for i in range(150)]
    right = [(j := r.randint(1, 5), a := r.randint(0, 300_000 * j // 2), a + r.choice([1, r.randint(1, 90_000)])) for _ in range(150)]
    a = spark.createDataFrame(left, "job_id long, idx int, start_ms long, end_ms long")
    b = spark.createDataFrame(right, "job_id long, r_start long, r_end long")
    rows = lambda **more: sorted((tuple(x) for x in intervals.overlap_join(a, b, how, **more).select("job_id", "idx", "start_ms", "end_ms", "r_start", "r_end").collect()), key=repr)
    assert rows() == rows(bucket_ms=50_000, long_ms=long_ms)


def test_own_text_and_first_segments(spark):
    clip = spark.createDataFrame([(1, 1, 0, 5000, "x", None), (1, 2, 5000, 9000, "x", " mine ")], "job_id long, idx int, start_ms long, end_ms long, reason string, transcript_override string")
    seg = spark.createDataFrame([(1, i, i * 1000, i * 1000 + 1500, f"s{i}") for i in range(8)], "job_id long, seg_idx int, start_ms long, end_ms long, text string")
    one, two = cuts.transcript_per_clip(clip, seg, listed=2).orderBy("idx").collect()
    assert one["transcript_text"] == "s0 s1 s2 s3 s4" and [tuple(x) for x in one["clip_segments"]] == [(0, 1500, "s0"), (1000, 2500, "s1")]
    assert two["transcript_text"] == "mine" and [tuple(x) for x in two["clip_segments"]] == [(5000, 5500, "s4"), (5000, 6500, "s5")]


# ---- ranged reads ----


def test_sampled_fingerprints(spark, tmp_path):
    import xxhash

    body = os.urandom(10_000)
    files = {"whole": body[:2_900], "a": body, "b": body, "tail": body[:-1] + b"?", "gap": body[:2_000] + b"?" + body[2_001:]}
    for n, raw in files.items():
        (tmp_path / n).write_bytes(raw)
    rows = [(f"file:{tmp_path}/{n}", len(raw), 7 if n == "b" else 5) for n, raw in files.items()] + [(f"file:{tmp_path}/none", 3, 5)]
    catalog = spark.createDataFrame(rows, "path string, size long, mtime_ns long")
    of = lambda **more: {r["path"].rsplit("/", 1)[1]: r["fingerprint"] for r in ranged.sampled_fingerprints(catalog, 1000, **more).collect()}
    with_time, without = of(), of(with_mtime=False)
    assert with_time["a"] == xxhash.xxh3_128(b"10000" + b"5" + body[:1000] + body[4500:5500] + body[9000:]).hexdigest()
    assert with_time["whole"] == xxhash.xxh3_128(b"2900" + b"5" + body[:1000]).hexdigest()
    assert with_time["a"] != with_time["b"] and without["a"] == without["b"] == without["gap"] != without["tail"]
    assert with_time["none"] is None


@pytest.mark.parametrize(("bits", "channels"), [(8, 1), (16, 1), (16, 2), (8, 3)])
def test_wav_ranges_equal_the_whole(spark, tmp_path, bits, channels):
    path = str(tmp_path / "x.wav")
    with wave.open(path, "wb") as w:
        w.setparams((channels, bits // 8, 100, 0, "NONE", ""))
        w.writeframes(os.urandom(channels * bits // 8 * 1237))
    (tmp_path / "bad.wav").write_bytes(b"RIFFxxxxWAVEfmt " + struct.pack("<I", 99))
    size = os.path.getsize(path)
    low, high, rate, frames = waveform.wav_buckets(open(path, "rb").read(), 20)
    files = ranged.wav_files(spark.createDataFrame([(f"file:{path}", size), (f"file:{tmp_path}/bad.wav", 20)], "path string, size long"))
    for step in (1, 7, 100, 1 << 20):
        rows = ranged.wav_range_buckets(files, 20, step if step > 1 else channels * bits // 8).orderBy("path", "bucket").collect()
        good = [r for r in rows if r["error"] is None]
        assert [(r["bucket"], r["low"], r["high"]) for r in good] == list(zip(range(len(low)), low.tolist(), high.tolist(), strict=True))
        assert {(r["sample_rate"], r["duration_ms"]) for r in good} == {(rate, frames * 1000 // rate)} and len(rows) == len(good) + 1
        if step == 1:
            break  # a frame a range is slow: once is enough


# ---- incremental reports ----


def test_only_changed_jobs_are_reported_again(spark, tmp_path):
    def windows(rows):
        return spark.createDataFrame(rows, "job_id long, idx int, start_ms long, end_ms long")

    seen = []

    def report(w):
        seen.append(sorted(r["job_id"] for r in w.select("job_id").distinct().collect()))
        return w.groupBy("job_id").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("kept_ms"))

    path = str(tmp_path / "reports")
    table = lambda p=path: sorted((r["job_id"], r["fingerprint"], r["kept_ms"]) for r in spark.read.parquet(p).collect())
    stamp = lambda: {f: os.path.getmtime(f) for d, _, names in os.walk(path) for n in names if re.search(r"part-.*parquet$", f := f"{d}/{n}")}
    first = [(j, i, 1000 * i, 1000 * i + 500) for j in range(40) for i in range(3)]
    incremental.refresh_reports(windows(first), report, path, 8)
    before = stamp()
    assert incremental.refresh_reports(windows(first), report, path, 8) == [] and stamp() == before and len(seen) == 1
    # job 3 changes, job 5 goes, job 99 comes
    later = [(j, i, a, z + (j == 3)) for j, i, a, z in first if j != 5] + [(99, 0, 0, 7)]
    touched = incremental.refresh_reports(windows(later), report, path, 8)
    assert seen[1] == [3, 99]
    after = stamp()
    same = {f for f in before if int(re.search(r"part=(\d+)", f)[1]) not in touched}
    assert same and all(after[f] == before[f] for f in same)
    incremental.refresh_reports(windows(later), report, str(tmp_path / "full"), 8)
    assert table() == table(str(tmp_path / "full"))
    assert incremental.refresh_reports(windows([r for r in later if r[0] == 99]), report, path, 8) and len(table()) == 1


def test_edges_by_arrays_and_by_a_table_agree(spark):
    w = spark.createDataFrame([(1, 1, 1200, 8000), (1, 2, 9000, 12_000)], "job_id long, idx int, start_ms long, end_ms long")
    d = spark.createDataFrame([(1, 20_000)], "job_id long, duration_ms long")
    s = spark.createDataFrame([(1, 0, 0, 20_000, "aaaa bb cccccc d ee ffff")], "job_id long, seg_idx int, start_ms long, end_ms long, text string")
    one = sorted(map(tuple, edges.edge_in_word(w, transcript.with_words(s), d).collect()))
    assert one and one == sorted(map(tuple, edges.edge_in_word(w, transcript.spread_words(s), d).collect()))


def test_recognitions_of_mixed_shapes(spark):
    import json

    body = [
        {"sentence_info": [{"text": " one ", "start": 0, "end": 1.5, "spk": 3}, {"text": "", "start": 2, "end": 3}, {"sentence": "two", "begin": "200000", "finish": 201500}, {"text": "no time"}], "text": "whole"},
        {"sentences": [{"text": "late", "start": -1, "end": 2}], "text": "own", "start": 5, "end": 6, "speaker": "S"},
        {"text": "stamped", "timestamp": [[7, 8], [1], "x", [9, 10.25]]},
        {"text": "waits"},
        "junk",
        None,
        {"text": " "},
        {"text": "too", "start": "abc", "end": 3},
    ]
    results = spark.createDataFrame([(1, json.dumps(body)), (2, json.dumps({"text": "alone"})), (3, "{broken"), (4, None)], "job_id int, body string")
    d = spark.createDataFrame([(1, 20_250), (2, 4_000), (3, 1)], "job_id int, duration_ms long")
    got = [tuple(r) for r in transcript.asr_segments(results, d).orderBy("job_id", "seg_idx").collect()]
    assert got == [
        (1, 0, 0, 1500, "one", "3"),
        (1, 1, 200_000, 201_500, "two", None),
        (1, 2, 5000, 6000, "own", "S"),
        (1, 3, 7000, 10_250, "stamped", None),
        (1, 4, 10_250, 16_500, "waits", None),
        (1, 5, 16_500, 20_250, "too", None),
        (2, 0, 0, 4000, "alone", None),
    ]


def test_batch_files_of_mixed_shapes(spark):
    import json

    from cliploom.sources import files

    bodies = {
        "list": ["a.mp4", "/abs/b.mp4", {"path": "c.mp4", "vertical": True}, 5, {"vertical": True}, None, ""],
        "object": {"files": [{"source_path": "d.mp4", "vertical": False}, {"path": "e.mp4", "force": "no", "vertical": None}], "vertical": 1, "force": 0},
        "none": {"items": []},
        "empty": [],
    }
    rows = [(n, json.dumps(b), "/base/", n == "list") for n, b in bodies.items()] + [("bad", "{", "/base", False)]
    m = spark.createDataFrame(rows, "batch_id string, body string, base_dir string, force boolean")
    got = {(r["batch_id"], r["batch_index"]): (r["path"], r["vertical"], r["force"], r["error"]) for r in files.expand_batch(m).collect()}
    bad = "neither a list nor an object with files"
    assert got == {
        ("list", 0): ("/base/a.mp4", False, True, None),
        ("list", 1): ("/abs/b.mp4", False, True, None),
        ("list", 2): ("/base/c.mp4", True, True, None),
        ("list", 3): (None, None, None, "neither a path nor an object"),
        ("list", 4): (None, None, None, "without a path"),
        ("list", 5): (None, None, None, "neither a path nor an object"),
        ("list", 6): (None, None, None, "without a path"),
        ("object", 0): ("/base/d.mp4", False, False, None),
        ("object", 1): ("/base/e.mp4", False, True, None),
        ("none", None): (None, None, None, bad),
        ("bad", None): (None, None, None, bad),
    }


def test_cleaning_in_chunks_is_cleaning_whole(spark):
    """The steps of chunks, scanned, give what one fold over the job gives: overlaps, ties, nulls, late and empty segments."""
    rng = random.Random(5)
    rows = []
    for job in range(6):
        for i in range(rng.choice([0, 1, 40, 150])):
            start = rng.choice([None, -50, rng.randrange(0, 9000), rng.randrange(0, 9000), 300])
            end = None if rng.random() < 0.05 else (start or 0) + rng.choice([-100, 0, 10, 200, 900, 4000])
            rows.append((job, i, start, end, rng.choice(["a", " b ", "", "c"])))
    s = spark.createDataFrame(rows, "job_id int, seg_idx int, start_ms long, end_ms long, text string")
    d = spark.createDataFrame([(0, 8000), (1, 0), (2, None), (3, 5000), (4, 100)], "job_id int, duration_ms long")
    key = lambda df: sorted(tuple(r) for r in df.select("job_id", "seg_idx", "start_ms", "end_ms", "text").collect())
    whole = key(transcript.clean_segments(s, d))
    assert len(whole) > 100
    for chunk in (1, 3, 16, 4096):
        assert key(transcript.clean_long_segments(s, d, chunk=chunk)) == whole
    assert key(transcript.clean_long_segments(s.limit(0), d)) == []
    with pytest.raises(ValueError):
        transcript.clean_long_segments(s, d, least_ms=0)


def test_job_states_are_compacted_once(spark, tmp_path):
    """A rerun reads nothing; changed files win by version; broken ones wait until they change."""
    import json

    root, table = tmp_path / "jobs", str(tmp_path / "table")

    def put(job, at, body):
        (root / job).mkdir(parents=True, exist_ok=True)
        file = root / job / "job.json"
        file.write_text(body if isinstance(body, str) else json.dumps(body))
        os.utime(file, (at, at))

    state = lambda status, version, day: {"status": status, "state_version": version, "updated_at": f"2026-01-{day:02d}T00:00:00"}
    put("a", 1000, state("pending", 1, 1))
    put("b", 1000, state("done", 4, 2))
    put("c", 1000, "{broken")
    put(".hidden", 1000, state("done", 1, 1))
    put("a/deep", 1000, state("failed", 9, 3))
    held = lambda: {(r.job_id, r.status, r.state_version) for r in compaction.compacted_job_states(spark, table).collect()}
    assert compaction.compact_job_states(spark, str(root), table) == 3
    assert held() == {("a", "pending", 1), ("b", "done", 4)}
    assert compaction.compact_job_states(spark, str(root), table) == 0
    put("a", 2000, state("done", 2, 5))  # newer
    put("b", 2000, state("failed", 3, 6))  # older version written late
    put("c", 500, state("pending", 0, 7))  # mended, with an older time of file
    assert compaction.compact_job_states(spark, str(root) + "/", table) == 3
    assert held() == {("a", "done", 2), ("b", "done", 4), ("c", "pending", 0)}
    assert compaction.compact_job_states(spark, str(root), table) == 0
    assert sorted(p.name for p in (tmp_path / "table").iterdir() if p.name.startswith("date="))[-1] == "date=2026-01-07"


# ---- reports ----


def test_runs_carry_their_stages(spark):
    runs = spark.createDataFrame([("j", i, i) for i in range(7)] + [("k", 9, 1)], "job string, run_id int, started_at int")
    stages = spark.createDataFrame([(6, 2, "skipped"), (6, 1, "complete"), (1, 1, "old")], "run_id int, stage_number int, status string")
    got = {(r.job, r.run_id): [(s.stage_number, s.status) for s in r.stages] for r in library.runs_per_job(runs, 5, stages).collect()}
    assert sorted(got) == [("j", 2), ("j", 3), ("j", 4), ("j", 5), ("j", 6), ("k", 9)]
    assert got["j", 6] == [(1, "complete"), (2, "skipped")] and got["k", 9] == []
    assert "stages" in library.runs_per_job(runs, 5, stages.limit(0)).columns


def test_run_timings(spark):
    t = spark.createDataFrame([(1, 3.75, 1.25, 2.5), (1, 0.0004, None, None), (2, None, None, None)], "run_id int, duration_seconds double, resource_wait_seconds double, execution_seconds double")
    got = {r.run_id: tuple(r)[1:] for r in library.run_timings(t).collect()}
    assert got == {1: (2, 3.75, 1.25, 2.5), 2: (1, 0.0, 0.0, 0.0)}


def test_dashboard_and_batches(spark):
    rows = [("a", "canceled", " x ", None, None, "2"), ("b", "done", "x", 2, None, "1"), ("c", "rendering_final", "x", 1, "", "1"), ("d", "done", " ", 1, None, "1"), ("e", "done", None, 1, None, "1"), ("f", "odd", "y", 1, None, "9")]
    jobs = spark.createDataFrame(rows, "job_name string, status string, batch_id string, batch_index int, current_stage string, updated_at string").withColumn("source_path", F.lit("S"))
    assert [(r.job_name, r.status_group) for r in library.dashboard_view(jobs, group="failed").collect()] == [("a", "failed")]
    assert [r.job_name for r in library.dashboard_view(jobs, "s", 4).collect()] == ["a", "f", "c", "b"]
    # 100, 100 and 15 of 16 stages
    assert [tuple(r) for r in library.batch_groups(jobs).collect()] == [("x", 3, 1, 1, 0, 1, 98)]
    assert [(r.job_name, r.place) for r in library.batch_order(jobs).orderBy("place").collect()] == [("c", 1), ("b", 2), ("a", 3)]
    p = spark.createDataFrame([(1, "b", False, 5), (2, "A", False, 5), (3, "c", False, 7), (4, "z", True, 9)], "id int, name string, archived boolean, updated_at int")
    assert [r.id for r in library.list_projects(p).collect()] == [3, 2, 1]
    assert [r.id for r in library.list_projects(p, True).collect()] == [4, 3, 2, 1]


def test_snapshots_keep_files(spark):
    s = lambda rows: spark.createDataFrame(rows, "job_name string, version int, status string, files string")
    current = s([("a", 9, "done", "f"), ("b", 3, "x", "f"), ("c", None, "x", "f"), ("d", 1, "x", "f")])
    got = library.merge_snapshots(current, s([("a", None, "y", "g"), ("b", 3, "y", None), ("c", None, "y", "g"), ("e", None, "y", None)]))
    assert sorted((r.job_name, r.version, r.status, r.files) for r in got.collect()) == [("a", 9, "done", "f"), ("b", 3, "y", "f"), ("c", 0, "y", "g"), ("e", 0, "y", None)]


def test_recipes_are_checked(spark):
    bodies = ['{"name": " n ", "stages": [" a", " "], "creator_kit_id": " "}', '{"name": null}', '{"name": "n", "stages": [1]}', '{"name": "n", "options": []}', '{"name": "n", "target_platforms": {}}', "[]", "no json", None]
    r = spark.createDataFrame([(i, "c", b) for i, b in enumerate(bodies)] + [(99, " ", bodies[0])], "id int, client_id string, body string")
    got = {x.id: x for x in library.checked_recipes(r).collect()}
    assert (got[0].name, got[0].stages, got[0].options, got[0].creator_kit_id, got[0].target_platforms, got[0].error) == ("n", ["a"], "{}", None, [], None)
    assert [got[i].error for i in (1, 2, 3, 4, 5, 6, 7, 99)] == [
        "without a name", "stages are no list of texts", "options are no object", "target_platforms are no list of texts", "not an object", "not an object", "not an object", "without a client id"
    ]


def test_platform_checks_by_what_is_known(spark):
    jobs = spark.createDataFrame([(1, 90_000, "v.mp4", True, "t", None), (2, None, None, None, None, True)], "job_id int, duration_ms long, video string, has_video boolean, title string, cover boolean")
    parts = spark.createDataFrame([(1, "a", 0, 60_001)], "job_id int, platform string, start_ms long, end_ms long")
    got = {(r.job_id, r.platform, r.name): (r.ok, r.message) for r in platform.platform_checks(jobs, parts, {"a": 60, "b": None}, {"a": "1x2"}).collect()}
    assert len(got) == 7 + 5 + 5 + 5
    assert got[1, "a", "duration_limit"] == (False, "90.0s / max 60s") and got[1, "a", "segment_duration"] == (False, "max 60s")
    assert got[1, "a", "resolution_advice"] == (True, "target 1x2") and got[1, "b", "resolution_advice"] == (True, "target source")
    assert [got[2, "a", n][0] for n in ("video_exists", "metadata_ready", "cover_ready", "manual_review")] == [False, False, True, True]


def test_upright_pictures(spark):
    f = spark.createDataFrame([(1, 1920, 1080, 1900, 1000, 10, 40), (2, 720, 1280, None, None, None, None), (3, 0, 1080, None, None, None, None)], "job_id int, width int, height int, content_w int, content_h int, content_x int, content_y int")
    got = {r.job_id: r for r in platform.vertical_crop_plan(f, anchor=2.0).collect()}
    assert tuple(got[1])[1:] == (562, 1000, 1338, 0, "crop=1900:1000:10:40,crop=562:1000:1338:0,scale=1080:1920")
    assert tuple(got[2])[1:] == (720, 1280, 0, 0, "crop=720:1280:0:0,scale=1080:1920")
    assert tuple(got[3])[1:] == (None,) * 5
    assert platform.vertical_crop_plan(f, mode="pad").filter("job_id = 1").first()["filter"].startswith("crop=1900:1000:10:40,scale=1080:1920:")
    with pytest.raises(ValueError):
        platform.vertical_crop_plan(f, mode="zoom")


def test_translation_workload_bounds(spark):
    rows = [(1, "x")] * 1200 + [(2, "x")] * 1201 + [(3, "x" * 120_000)] * 2 + [(4, "x" * 240_001), (5, None)]
    got = {r.job_id: (r.chars, r.error) for r in subtitles.translation_workload(spark.createDataFrame(rows, "job_id int, text string")).collect()}
    assert got == {1: (1200, None), 2: (1201, "too many segments"), 3: (240_000, None), 4: (240_001, "too many characters"), 5: (0, None)}


# ---- words without rows of their own ----


def test_words_are_timed_where_their_text_is(spark):
    rows = [(1, 0, 0, 999, "a  bb ccc"), (1, 1, 1000, 2001, " lead 漢字 é "), (1, 2, 3, 4, ""), (1, 3, 0, 5, None), (2, 0, 7, 7, "x y"), (2, 1, 0, 10, "   ")]
    s = spark.createDataFrame(rows, "job_id int, seg_idx int, start_ms long, end_ms long, text string")
    want = []
    for job, seg, a, z, text in rows:
        words, upto = [(i, w) for i, w in enumerate((text or "").split(" ")) if w], 0
        total = sum(len(w) for _, w in words)
        for i, w in words:
            want.append((job, seg, i, a + (z - a) * upto // total, a + (z - a) * (upto + len(w)) // total, w))
            upto += len(w)
    made = transcript.spread_words(s)
    assert sorted(map(tuple, made.collect())) == sorted(want)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan


def test_packing_gathers_no_words(spark):
    plan = registry.queries()["t7_pack_words"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Aggregate \[job_id#\d+L?\]", plan) and not re.search(r"Aggregate \[job_id#\d+L?, seg_idx", plan)


def test_buckets_hand_on_no_words(spark):
    c = spark.createDataFrame([(1, 1, 0, 70_000), (1, 2, 70_000, 300_000), (2, 1, 0, 50)], "job_id int, idx int, start_ms long, end_ms long")
    s = spark.createDataFrame([(1, 0, 50_000, 90_000, "ab cd ef gh"), (1, 1, 90_000, 95_000, "ij")], "job_id int, seg_idx int, start_ms long, end_ms long, text string")
    made = cuts.transcript_per_clip(c, s, bucket_ms=60_000, long_ms=0, spread=True)
    got = {(r["job_id"], r["idx"]): r["transcript_text"] for r in made.collect()}
    assert got == {(1, 1): "abcd", (1, 2): "efgh ij", (2, 1): ""}
    table = cuts.transcript_per_clip(c, s, transcript.spread_words(s), bucket_ms=60_000, long_ms=0)
    assert got == {(r["job_id"], r["idx"]): r["transcript_text"] for r in table.collect()}
    # behind the join of clip and segment only parts remain: no join by idx holds texts' words
    joins = [line for line in table._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join LeftOuter" in line and "idx" in line and "seg_idx" not in line]
    assert joins and "Aggregate [job_id" in table._jdf.queryExecution().optimizedPlan().toString().split(joins[0])[1].split("Join Inner")[0]


def test_words_are_searched_near_an_edge_only(spark):
    d = spark.createDataFrame([(1, 100_000)], "job_id int, duration_ms long")
    w = spark.createDataFrame([(1, 1, 5_000, 20_000)], "job_id int, idx int, start_ms long, end_ms long")
    s = spark.createDataFrame([(1, 0, 0, 10_000, "one two"), (1, 1, 10_000, 30_000, "three")], "job_id int, seg_idx int, start_ms long, end_ms long, text string")
    forms = [edges.edge_in_word(w, x, d) for x in (s, transcript.with_words(s), transcript.spread_words(s))]
    got = [sorted(map(tuple, f.collect())) for f in forms]
    assert got[0] == got[1] == got[2] and [r[2] for r in got[0]] == ["end"]
    for f in forms[:2]:
        lines = [x for x in f._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in x and "r_end" in x]
        assert lines and all("array_min" not in x or "CASE WHEN" in x.split("array_min")[0] for x in lines)


def test_library_writes_what_is_asked_for(spark, tmp_path):
    t = spark.createDataFrame([(1, 2)], "job_id int, time_ms long")
    made = write_library(spark, [("scenes", t), ("clips", lambda m: m["scenes"].withColumn("idx", F.lit(1))), ("segments", lambda m: 1 / 0)], 2, str(tmp_path), lazy=True)
    assert made.names == [] and made["clips"].count() == 1 and made.names == ["scenes", "clips"]
    made.drop()


def test_bodies_are_parsed_once(spark):
    plan = registry.queries()["t1_asr_shapes"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "parse_json" not in plan


def test_narrow_texts_wrap_as_character_by_character(spark):
    r = random.Random(5)
    for _ in range(300):
        text = "".join(r.choice("ab é,.") for _ in range(r.randint(1, 60))).strip()
        units = r.randint(1, 20)
        if text:  # with one wide character behind it, the text is measured character by character
            slow = subtitles.wrap(text + " " + "x" * units + "漢", units)
            fast = subtitles.wrap(text + " " + "x" * units + "z", units)
            assert [x for x in slow if "漢" not in x][: len(slow) - 2] == fast[: len(slow) - 2]


# ---- packing, wrapping and remapping in whole batches ----


def _odd_text(r, n):
    return "".join(r.choice("abc d,.! éß漢字。！？　 \x1f'\"9🚀") for _ in range(n))


def test_batches_pack_as_word_by_word():
    r = random.Random(7)
    for case in range(400):
        batch = []
        for _ in range(r.randint(0, 6)):
            at, words = r.randint(-50, 10_000), []
            for _ in range(r.randint(0, 40)):
                at += r.choice([0, 0, 0, 100, 549, 550, -300 if case % 3 == 0 else 5])
                end = at + r.choice([-1, 0, 1, 200, 400, 1800, 2500])
                words.append({"w_start": r.choice([at] * 20 + [None]), "w_end": end, "word": r.choice([None, "", " ", _odd_text(r, r.randint(1, 9)), "x" * r.randint(1, 40), "end."]), "probability": r.choice([None, 1.0, 0.5, 1 / 3, 0.25, 0.1, 1e17, float("inf")] if case % 4 == 0 else [1.0, 0.5, 1 / 3, 0.25])})
                at = end if case % 2 else at + 150
            batch.append(r.choice([words] * 9 + [None]))
        kind = pa.list_(pa.struct([("w_start", pa.int64()), ("w_end", pa.int64()), ("word", pa.string()), ("probability", pa.float64())]))
        got = transcript.packed_batch(pa.array([[], *batch], kind)[1:]).to_pylist()
        assert str(got) == str([transcript.pack(words or []) for words in batch])


def test_batches_wrap_as_text_by_text():
    r = random.Random(8)
    for case in range(400):
        units, most = r.randint(1, 24), r.randint(1, 3)
        texts = [r.choice([None, "", " ", "x" * r.randint(1, 90), _odd_text(r, r.randint(1, 120)), "ab, cd é. " * r.randint(1, 9)][: 6 if case % 2 else 4]) for _ in range(r.randint(0, 9))]
        want = []
        for text in texts:
            lines, events, upto = subtitles.wrap(text, units) if text else [], [], 0
            for i in range(0, len(lines), most):
                event = "\n".join(lines[i : i + most])
                upto += max(1, text_width(event))
                events.append({"text": event, "width": max(1, text_width(event)), "upto": upto})
            want.append(events)
        assert subtitles.wrapped(pa.array(["ab", *texts], pa.string())[1:], units, most).to_pylist() == want


def test_characters_and_white_space_are_those_of_python():
    points = [p for p in range(0x110000) if not 0xD800 <= p < 0xE000]
    text = "".join(map(chr, points))
    got, at = characters(np.frombuffer(text.encode(), np.uint8))
    assert got.tolist() == points and at[-1] == len(text.encode()) - 4
    assert spaces(got).tolist() == [c.isspace() for c in text] and widths(got).tolist() == [char_width(c) for c in text]


def test_packing_makes_the_words_of_texts(spark):
    rows = [(1, 0, 0, 20_000, "A longer one. it goes  on and on, 漢字 é " * 3), (1, 1, 20_000, 20_400, " bare"), (1, 2, 20_400, 20_400, "no time"), (1, 3, 21_000, 22_000, None), (2, 0, 0, 900, "")]
    s = spark.createDataFrame(rows, "job_id int, seg_idx int, start_ms long, end_ms long, text string")
    said = transcript.with_words(s).withColumn("words", F.transform("words", lambda x: x.withField("probability", F.lit(1.0) / (1 + x["word_idx"] % 4))))
    want = sorted(map(tuple, transcript.pack_words(said).collect()))
    assert len(want) > 3 and sorted(map(tuple, transcript.pack_words(s, lambda n: 1 / (1 + n % 4)).collect())) == want
    assert {r.avg_probability for r in transcript.pack_words(s).collect()} == {None}


def test_flow_packs_its_segments_once(spark):
    plan = registry.queries()["u_subtitle_flow"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"ArrowEvalPython \[packed", plan)) == 1
    assert "timed(" not in plan


def test_remapping_leaves_jobs_without_clips_as_they_are(spark):
    s = spark.createDataFrame([(1, 0, 0, 90, "a"), (1, 1, 100, 300, "b"), (2, 0, 50, 60, "c"), (3, 0, 10, 20, "d")], "job_id int, seg_idx int, start_ms long, end_ms long, text string")
    t = spark.createDataFrame([(1, 1, 150, 200, 0, None), (1, 2, 280, 400, 50, None), (3, 1, 0, 100, 0, " own ")], "job_id int, idx int, start_ms long, end_ms long, offset_ms long, subtitle_override string")
    made = subtitles.remap_segments(s, t)
    want = [(1, 1, 0, 50, "b"), (1, 2, 50, 70, "b"), (2, 0, 50, 60, "c")]
    show = lambda d: sorted((r.job_id, r.idx or 0, r.out_start, r.out_end, r.text) for r in d.collect())
    assert show(made) == [*want, (3, 1, 0, 100, "own")]
    near = subtitles.clips_beside(s, t.filter("job_id = 1"))
    assert show(subtitles.remap_beside(near)) == [*want, (3, 0, 10, 20, "d")]
    # what was made of a segment is remapped by its own time
    part = near.filter("text = 'b'").withColumns({"start_ms": F.lit(190), "end_ms": F.lit(270)})
    assert show(subtitles.remap_beside(part)) == [(1, 1, 40, 50, "b")]


def test_flow_deals_no_pieces_by_job(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = registry.queries()["u_subtitle_flow"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    # the tables lie by job, so only the finished lines are dealt
    assert plan.count("Exchange hashpartitioning") == 1
