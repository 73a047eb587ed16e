"""Small cases of the operators, and every registered query against its SQL."""

import struct
from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from cliploom.functions import text as X
from cliploom.operators import cuts, edges, intervals, library, logs, platform, subtitles, transcript, waveform
from cliploom.plans import registry
from cliploom.sources import files
from cliploom.streaming import jobs as streams

SF = "/root/testdata/sf0.001"


def ms(*pairs):
    return [(1, int(a * 1000), int(b * 1000)) for a, b in pairs]


@pytest.fixture
def rng(spark):
    return lambda rows: spark.createDataFrame(rows, "job_id long, start_ms long, end_ms long")


@pytest.fixture
def dur(spark):
    return lambda s: spark.createDataFrame([(1, int(s * 1000))], "job_id long, duration_ms long")


def spans(df):
    return [(r.start_ms / 1000, r.end_ms / 1000) for r in df.orderBy("start_ms").collect()]


def test_invalid_segments_are_where_both_meet(rng, dur):
    got = intervals.invalid_segments(rng(ms((2, 8), (12, 15))), rng(ms((5, 10), (14, 18))), dur(20))
    assert spans(got) == [(5, 8), (14, 15)] and {r.reason for r in got.collect()} == {"silence+freeze"}
    assert spans(intervals.invalid_segments(rng(ms((2, 8))), rng([]), dur(20))) == [(2, 8)]
    assert intervals.invalid_segments(rng([]), rng(ms((2, 8))), dur(20)).count() == 0


def test_short_clips_are_absorbed(rng, dur):
    bad = rng(ms((3, 3.4), (6, 6.4))).withColumn("reason", F.lit("silence"))
    assert spans(intervals.stable_clips(bad, dur(12), min_gap_ms=0, min_clip_ms=2000, merge_gap_ms=1000)) == [(0, 12)]


def test_recording_without_invalid_parts_is_one_clip(rng, dur):
    none = rng([]).withColumn("reason", F.lit(""))
    assert [r.reason for r in intervals.keep_clips(none, dur(0.2)).collect()] == ["full media"]


def test_bucketed_join_equals_plain(spark):
    import random

    random.seed(1)
    make = lambda: [(random.randint(1, 3), a := random.randint(0, 500_000), a + random.randint(1, 200_000)) for _ in range(300)]
    l, r = (spark.createDataFrame(make(), "job_id long, start_ms long, end_ms long") for _ in "lr")
    assert sorted(intervals.intersect_ranges(l, r).collect()) == sorted(intervals.intersect_ranges(l, r, bucket_ms=60_000).collect())


def test_words_inside_the_clip(spark):
    clip = spark.createDataFrame([(1, 1, 1000, 3000, "x")], "job_id long, idx int, start_ms long, end_ms long, reason string")
    seg = spark.createDataFrame([(1, 0, 0, 4000, "a b c")], "job_id long, seg_idx int, start_ms long, end_ms long, text string")
    w = spark.createDataFrame([(1, 0, 0, 200, 800, "a"), (1, 0, 1, 1200, 1600, "b"), (1, 0, 2, 3200, 3600, "c")], "job_id long, seg_idx int, word_idx int, w_start long, w_end long, word string")
    assert cuts.transcript_per_clip(clip, seg, w).first().transcript_text == "b"


def test_highlight_cut_passes_over_what_does_not_fit(spark):
    rows = [(1, 1, 0, 20_000, 40.0), (1, 2, 22_000, 40_000, 95.0), (1, 3, 45_000, 70_000, 82.0)]
    clips = spark.createDataFrame(rows, "job_id long, idx int, start_ms long, end_ms long, final_score double")
    got = cuts.highlight_cut(clips, 45_000).orderBy("start_ms").collect()
    assert [(r.start_ms, r.selection_rank) for r in got] == [(22_000, 1), (45_000, 2)]


def test_edited_clips(spark, dur):
    rows = [(1, "4", "9", None, None), (1, "-1", "2", None, None), (1, "3", "3", None, None), (1, "x", "4", None, None)]
    got = cuts.validate_edited_clips(spark.createDataFrame(rows, "job_id long, start string, end string, keep boolean, reason string"), dur(5))
    assert sorted((r.start_ms, r.end_ms) for r in got.filter("error is null").collect()) == [(0, 2000), (4000, 5000)]
    assert got.filter("error is not null").count() == 2


@pytest.mark.parametrize(
    ("clip", "word", "excluded", "shift", "want"),
    [
        ((1200, 8000), (1000, 1500), None, 750, ("accepted", 1000, 2)),
        ((1200, 8000), (1000, 1500), (900, 1100), 750, ("accepted", 1500, 2)),
        ((1500, 8000), (0, 2000), None, 200, ("needs_review", 1500, 1)),
        ((0, 10_000), (2000, 3000), (4000, 4500), 750, ("accepted", 0, 1)),
    ],
)
def test_boundary_refinement(spark, rng, dur, clip, word, excluded, shift, want):
    w = spark.createDataFrame([(1, 1, *clip)], "job_id long, idx int, start_ms long, end_ms long")
    words = spark.createDataFrame([(1, *word)], "job_id long, w_start long, w_end long")
    out = edges.refine_boundaries(w, words, rng([(1, *excluded)] if excluded else []), dur(10), tolerance_ms=50, max_shift_ms=shift)
    (r,) = out.collect()
    assert (r.outcome, r.start_ms, r.attempts) == want


def test_refinement_stops_at_its_budget(spark, rng, dur):
    # four edges to move and one move a round
    w = spark.createDataFrame([(1, 1, 1200, 5000), (1, 2, 6200, 9000)], "job_id long, idx int, start_ms long, end_ms long")
    words = spark.createDataFrame([(1, a, a + 400) for a in (1000, 4800, 6000, 8800)], "job_id long, w_start long, w_end long")
    go = lambda n: edges.refine_boundaries(w, words, rng([]), dur(20), n, 50).orderBy("idx").collect()
    assert {(r.outcome, r.attempts) for r in go(3)} == {("attempt_budget_exhausted", 3)}
    out = go(4)
    assert {(r.outcome, r.attempts) for r in out} == {("accepted", 4)}
    assert [(r.start_ms, r.end_ms) for r in out] == [(1000, 5200), (6000, 9200)]


def test_refinement_rolls_back_what_made_it_worse(spark, rng, dur):
    # the nearer end of the edge's word lies deep in another word, from where no move is short enough
    w = spark.createDataFrame([(1, 1, 3000, 9000)], "job_id long, idx int, start_ms long, end_ms long")
    words = spark.createDataFrame([(1, 2700, 3200), (1, 2300, 3003)], "job_id long, w_start long, w_end long")
    (r,) = edges.refine_boundaries(w, words, rng([]), dur(20), 3, 5, max_shift_ms=300).collect()
    assert (r.outcome, r.start_ms, r.attempts) == ("regression_rolled_back", 3000, 2)


def test_subtitle_filter_and_remap(spark, rng):
    seg = spark.createDataFrame([(1, 0, 0, 100, "x"), (1, 1, 1000, 2000, "bad old word")], "job_id long, seg_idx int, start_ms long, end_ms long, text string")
    assert [r.text for r in transcript.filter_subtitles(seg, {"old": "new"}, ["bad"], "***").collect()] == ["*** new word"]
    seg = spark.createDataFrame([(1, 0, 10_000, 15_000, "a"), (1, 1, 20_000, 22_000, "b")], "job_id long, seg_idx int, start_ms long, end_ms long, text string")
    clips = spark.createDataFrame([(1, 1, 12_000, 14_000), (1, 2, 20_000, 21_000)], "job_id long, idx int, start_ms long, end_ms long")
    got = subtitles.remap_segments(seg, subtitles.kept_timeline(clips)).orderBy("out_start").collect()
    assert [(r.out_start, r.out_end) for r in got] == [(0, 2000), (2000, 3000)]


def test_texts_and_times(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first().x
    assert get(X.ass_time(F.lit(62_345))) == "0:01:02.34" and get(X.srt_time(F.lit(62_345))) == "00:01:02,345"
    assert get(X.escape_ass(F.lit("a{b}\\c\nd"))) == r"a\{b\}\\c\Nd"
    assert get(X.visual_width(F.lit("abc"))) == 3 and get(X.visual_width(F.lit("汉字"))) == 4
    assert get(X.truncate_text(F.lit("abcdef  xyz"), 10)) == "abcdef..." and get(X.truncate_text(F.lit("short"), 10)) == "short"
    assert get(X.join_words(F.array(F.lit("it"), F.lit("is"), F.lit("汉"), F.lit("ok")))) == "it is汉ok"


def test_events_keep_all_text_and_time(spark):
    text = "这是一个很长的句子需要被分开。" * 12
    seg = spark.createDataFrame([(1, 0, 0, 24_000, text)], "job_id long, seg_idx int, out_start long, out_end long, text string")
    got = subtitles.subtitle_events(seg, 39).orderBy("event_idx").collect()
    assert len(got) > 1 and all(r.text.count("\n") < 2 for r in got)
    assert "".join(r.text.replace("\n", "") for r in got) == text
    assert got[0].start_ms == 0 and got[-1].end_ms == 24_000 and all(a.end_ms == b.start_ms for a, b in zip(got, got[1:], strict=False))


def test_range_logs(spark):
    lines = ["silence_start: 1.234", "silence_end: 2.345 | silence_duration: 1.111", "silence_end: 5.0 | silence_duration: 0.5"]
    got = logs.parse_range_log(spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "job_id long, line_no int, line string"))
    assert spans(got) == [(1.234, 2.345), (4.5, 5.0)]
    scenes = logs.parse_scene_log(spark.createDataFrame([(1, 1, "pts_time:12.345"), (1, 2, "pts_time:12.345"), (1, 3, "pts_time:18.9")], "job_id long, line_no int, line string"), 1)
    assert scenes.count() == 2 and scenes.filter("error is null").count() == 0


def test_platform_parts(spark, dur, rng):
    none = spark.createDataFrame([], "job_id long, at_ms long")
    got = platform.platform_segments(dur(125), none, {"short": 60}).orderBy("part").collect()
    assert [(r.start_ms, r.end_ms) for r in got] == [(0, 60_000), (60_000, 120_000), (120_000, 125_000)]
    assert platform.platform_segments(dur(100_000), none, {"short": 60}).first().error == "too many parts"
    assert platform.split_parts(100_000, [30_000, 58_000, 70_000], 60_000) == [(0, 58_000), (58_000, 100_000)]


def test_waveform(spark):
    def wav(bits, channels, rate, data):
        fmt = struct.pack("<HHIIHH", 1, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
        return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<I", 16) + fmt + b"data" + struct.pack("<I", len(data)) + data

    low, high, rate, frames = waveform.wav_buckets(wav(8, 1, 4, bytes([0, 255, 128, 138])), 2)
    assert (low.tolist(), high.tolist(), frames / rate) == ([-128, 0], [127, 10], 1.0)
    got = waveform.decode_pcm(spark.createDataFrame([("a", wav(8, 1, 4, bytes([0, 255, 128, 138]))), ("b", b"junk")], "path string, content binary"), 2)
    assert {(r.path, r.low, r.high, r.error) for r in got.collect()} == {("a", -128, 127, None), ("a", 0, 10, None), ("b", 0, 0, "not a WAV file")}


def test_index_and_snapshots(spark):
    j = lambda rows: spark.createDataFrame(rows, "job_name string, status string, project string")
    once = library.upsert_index(j([]), j([("a", "queued", None)]), "job_name", ["status"])
    assert [r.is_new for r in once.collect()] == [True]
    again = library.upsert_index(j([("a", "queued", "p")]), j([("a", "done", None)]), "job_name", ["status"]).collect()
    assert [(r.status, r.project, r.is_new) for r in again] == [("done", "p", False)]
    s = lambda rows: spark.createDataFrame(rows, "job_name string, version int, status string")
    got = library.merge_snapshots(s([("a", 9, "x"), ("b", 8, "x"), ("c", 1, "x")]), s([("a", 8, "y"), ("b", 9, "y")]), True)
    assert {(r.job_name, r.version) for r in got.collect()} == {("a", 9), ("b", 9), ("c", 1)}


def test_sources(spark, tmp_path):
    import json

    for name, body in (("a", json.dumps({"status": "done", "updated_at": "2"})), ("b", "{broken"), (".c", json.dumps({"status": "done"}))):
        (tmp_path / name).mkdir()
        (tmp_path / name / "job.json").write_text(body)
    (tmp_path / "a" / "silence.json").write_text(json.dumps({"silences": [{"start": 1.0, "end": 2.5}]}))
    (tmp_path / "a" / "x.MP4").write_bytes(b"123")
    root = str(tmp_path)
    assert [(r.job_id, r.status) for r in files.read_job_states(spark, root).collect()] == [("a", "done")]
    assert [(r.start_ms, r.end_ms) for r in files.artifact_ranges(files.read_artifact(spark, root, "silence"), "silences").collect()] == [(1000, 2500)]
    assert [(r.name, r["size"]) for r in files.media_catalog(spark, root).collect()] == [("x.MP4", 3)]
    batch = json.dumps({"vertical": True, "files": ["a.mp4", {"path": "b.mp4", "vertical": False}]})
    got = files.expand_batch(spark.createDataFrame([("x", batch, False)], "batch_id string, body string, vertical boolean")).collect()
    assert [(r.path, r.vertical) for r in got] == [("a.mp4", True), ("b.mp4", False)]
    files.write_documents(spark.createDataFrame([("a", "one\ntwo")], "job_id string, document string"), f"{root}/out")
    assert [r.value for r in spark.read.text(f"{root}/out").select("value").collect()] == ["one", "two"]


def drained(df, mode, tmp_path):
    q = df.writeStream.format("memory").queryName("drained").outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.sql("select * from drained")


def test_streams_equal_batch(spark, tmp_path):
    rows = [(k, i, s) for k in (1, 2) for i, s in enumerate(["draft", "published", "validating", "uploading", "published"])]
    spark.createDataFrame(rows, "key long, seq long, status string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key long, seq long, status string").parquet(str(tmp_path / "in"))
    got = drained(streams.accepted_transitions(stream), "append", tmp_path).collect()
    assert {(r.key, r.seq): r.allowed for r in got} == {(k, i): i != 1 for k in (1, 2) for i in range(5)}


def test_latest_state_stream(spark, tmp_path):
    rows = [(1, 3, "c"), (1, 2, "b"), (2, 1, "a")]
    spark.createDataFrame(rows, "job long, version long, status string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("job long, version long, status string").parquet(str(tmp_path / "in"))
    got = drained(streams.latest_state(stream), "complete", tmp_path)
    assert {(r.job, r.version, r.status) for r in got.collect()} == {(1, 3, "c"), (2, 1, "a")}


def test_heartbeats_run_out(spark, tmp_path):
    from datetime import timedelta

    base = datetime(2024, 1, 1)
    for n, rows in enumerate([[(1, base)], [(2, base + timedelta(minutes=5))], [(2, base + timedelta(minutes=6))]]):
        spark.createDataFrame(rows, "job long, at timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"b{n}"))
    stream = spark.readStream.schema("job long, at timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    got = drained(streams.heartbeat_timeout(stream.withWatermark("at", "1 second")), "append", tmp_path)
    assert 1 in {r.job for r in got.collect()}


def test_plans_have_no_cartesian_products(spark):
    q = registry.queries()
    for name in ("c2_intersect_ranges", "c9_transcript_per_clip", "b2_edge_in_word", "u3_remap_segments"):
        assert "CartesianProduct" not in q[name](spark, SF)._jdf.queryExecution().toString()


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v):.6f}"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents conversations".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    found = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())


# ---- rules against known rows ----


def test_classify_error(spark):
    known = {
        "RuntimeError: CUDA out of memory while transcribing": "gpu_memory",
        "cudnn error": "gpu_memory",
        "out of memory": "generic",
        "h264_nvenc listed": "generic",
        "OpenEncodeSessionEx failed: incompatible client key (21)": "nvenc_unavailable",
        "nvenc init failed": "nvenc_unavailable",
        "nvenc\nfailed": "generic",
        "[WinError 2] The system cannot find the file specified: ffmpeg": "missing_ffmpeg",
        "transcription returned empty segments": "empty_transcript",
        "OSError: No space left on device": "disk_space",
        "not enough space": "disk_space",
        "HTTP Error 403: Forbidden": "generic",
        None: "generic",
    }
    rows = spark.createDataFrame([(t,) for t in known], "text string")
    assert {r.text: r.code for r in rows.select("text", logs.classify_error(F.col("text")).alias("code")).collect()} == known


def test_integrity_status(spark):
    runs = spark.createDataFrame([(1, 0), (2, 1), (3, None), (4, 1), (5, 0)], "job_id int, returncode int")
    lines = spark.createDataFrame(
        [(2, 1, "x"), (2, 2, " "), (2, 3, "CORRUPT frame"), (4, 1, "a"), (4, 2, "b"), (4, 3, "corrupt, but too late"), (5, 1, "invalid data")],
        "job_id int, line_no int, line string",
    )
    progress = spark.createDataFrame([(1, "out_time_us=1500000"), (1, "out_time=00:00:09.25"), (1, "out_time_ms=2000000"), (2, "frame=1")], "job_id int, line string")
    got = {r.job_id: tuple(r)[1:] for r in logs.integrity_status(runs, lines, progress, 2).collect()}
    assert got == {
        1: ("ok", 0, False, 9250),
        2: ("corrupt", 2, True, None),
        3: ("timeout", 0, False, None),
        4: ("failed", 3, True, None),
        5: ("corrupt", 1, False, None),
    }


def test_moves_of_both_machines(spark):
    steps = [("a", 1, "draft"), ("a", 2, "validating"), ("a", 3, "published"), ("b", 1, "failed"), ("b", 2, "uploading"), ("b", 3, "processing")]
    got = streams.check_transitions(spark.createDataFrame(steps, "k string, n int, status string"), "k", ["n"]).collect()
    assert {(r.k, r.n): r.allowed for r in got} == {("a", 1): True, ("a", 2): True, ("a", 3): False, ("b", 1): True, ("b", 2): True, ("b", 3): True}
    steps = [("a", 1, "pending"), ("a", 2, "queued"), ("a", 3, "pending"), ("b", 1, "canceling"), ("b", 2, "failed"), ("b", 3, "done")]
    got = streams.check_transitions(spark.createDataFrame(steps, "k string, n int, status string"), "k", ["n"], streams.JOB_EDGES).collect()
    assert {(r.k, r.n): r.allowed for r in got} == {("a", 1): True, ("a", 2): True, ("a", 3): False, ("b", 1): True, ("b", 2): True, ("b", 3): False}


def test_preference_summary(spark):
    rows = [
        (1, "clip_feedback", "accepted", None, None, None, 1),
        (2, "clip_feedback", "clear", None, None, None, 1),
        (3, "subtitle_correction", None, " teh ", "the", None, 1),
        (4, "subtitle_correction", None, "teh", "ten", None, 2),
        (5, "subtitle_correction", None, "same", "same ", None, 3),
        (6, "publish_selection", None, None, None, "a", 1),
        (7, "publish_selection", None, None, None, " ", 1),
    ]
    e = spark.createDataFrame(rows, "id int, kind string, action string, before string, after string, platform string, created_at int")
    assert {tuple(r) for r in library.preference_summary(e).collect()} == {
        ("events", None, None, 7),
        ("clip_feedback", "accepted", None, 1),
        ("clip_feedback", "rejected", None, 0),
        ("clip_feedback", "cleared", None, 1),
        ("replacement", "teh", "ten", None),
        ("platform", "a", None, 1),
    }


def test_width_of_every_character(spark):
    points = [p for p in range(1, 0x30000) if not 0xD800 <= p < 0xE000]
    rows = spark.createDataFrame([(chr(p),) for p in points], "c string")
    got = {r.c: r.w for r in rows.select("c", X.visual_width(F.col("c")).alias("w")).collect()}
    assert all(got[chr(p)] == X.char_width(chr(p)) for p in points)
    assert got["🚀"] == got["⌚"] == 2 and got["\U0001f321"] == 1


def test_pack_words():
    w = lambda a, z, t, p=None: {"w_start": a, "w_end": z, "word": t, "probability": p}
    got = transcript.pack([w(0, 400, "Hello", 0.5), w(400, 900, " world", 1.0), w(900, 900, "gone"), w(1450, 5000, "again"), w(3800, 3900, "far")])
    assert [(p["start_ms"], p["end_ms"], p["text"], p["word_count"], p["avg_probability"]) for p in got] == [
        (0, 900, "Hello world", 2, 0.75),
        (1450, 3250, "again", 1, None),  # a word lasts 1.8 s at most, so what follows is a gap
        (3800, 3900, "far", 1, None),
    ]
    assert [p["text"] for p in transcript.pack([w(i * 300, i * 300 + 300, "你好吗") for i in range(7)])] == ["你好吗" * 5, "你好吗" * 2]
    sentence = ["A longer one.", "Next"]  # behind a sentence's end from width 16 on
    assert [p["text"] for p in transcript.pack([w(i * 300, i * 300 + 300, t) for i, t in enumerate(sentence)])] == sentence
    assert len(transcript.pack([w(0, 300, "Short."), w(300, 600, "Next")])) == 1
    assert [p["text"] for p in transcript.pack([w(i * 1000, i * 1000 + 1000, f"w{i}") for i in range(7)])] == ["w0 w1 w2 w3 w4", "w5 w6"]


def test_pack_words_keeps_segments_without_words(spark):
    kind = "job_id int, seg_idx int, start_ms long, end_ms long, text string, words array<struct<w_start:bigint,w_end:bigint,word:string,probability:double>>"
    rows = [(1, 0, 0, 900, "a b", [(0, 400, "a", None), (400, 900, "b", None)]), (1, 1, 900, 1500, " bare ", None), (1, 2, 1500, 1500, "empty", None), (1, 3, 1600, 1700, "bad words", [(5, 5, "x", None)])]
    got = {(r.seg_idx, r.text, r.word_count) for r in transcript.pack_words(spark.createDataFrame(rows, kind)).collect()}
    assert got == {(0, "a b", 2), (1, "bare", None), (3, "bad words", None)}


def test_parts_of_odd_durations(spark):
    j = spark.createDataFrame([(1, None), (2, 0), (3, 1000)], "job_id int, duration_ms long")
    none = spark.createDataFrame([], "job_id int, at_ms long")
    assert {(r.job_id, r.part, r.error) for r in platform.platform_segments(j, none, {"x": 60}).collect()} == {(1, None, "no duration"), (2, None, "no duration"), (3, 0, None)}


def absorbed_by_hand(clips, least, reach):
    """Left to right; reasons in first-seen order."""
    both = lambda *r: " / ".join(dict.fromkeys(x.strip() for x in r if x and x.strip()))
    out, held = [], None
    for i, (start, end, reason) in enumerate(clips):
        if held:
            start, reason, held = held[0], both(held[1], reason, "absorbed short clip"), None
        right = clips[i + 1][0] - end if i + 1 < len(clips) else None
        left = start - out[-1][1] if out else None
        if end - start < least and left is not None and (right is None or left <= right) and left <= reach:
            out[-1] = (out[-1][0], end, both(out[-1][2], reason, "absorbed short clip"))
        elif end - start < least and right is not None and right <= reach:
            held = (start, reason)
        else:
            out.append((start, end, reason))
    return out


def test_absorbed_clips_equal_a_plain_fold(spark):
    import random

    jobs = {0: [(0, 3000, None), (3100, 3200, " "), (3300, 9000, "c")], 1: [(0, 500, "only")], 2: [(0, 500, "a"), (600, 700, "b"), (5000, 5100, "c"), (9900, 9950, "d")]}
    for j in range(3, 60):
        r, at, own = random.Random(j), 0, []
        for _ in range(r.randint(1, 200 if j == 3 else 12)):
            at += r.choice([0, 300, 1500, 3000, 3001, 9000])
            end = at + r.choice([1, 900, 1999, 2000, 7000])
            own.append((at, end, r.choice(["a", "b", " a ", None, ""])))
            at = end
        jobs[j] = own
    rows = [(j, i + 1, *c) for j, own in jobs.items() for i, c in enumerate(own)]
    df = spark.createDataFrame(rows, "job_id long, idx int, start_ms long, end_ms long, reason string")
    got = {j: [] for j in jobs}
    for x in intervals.absorb_short(df, 2000, 1500).orderBy("job_id", "idx").collect():
        got[x.job_id].append((x.start_ms, x.end_ms, x.reason))
    assert got[0] == [(0, 3200, "absorbed short clip"), (3300, 9000, "c")]
    assert got == {j: absorbed_by_hand(own, 2000, 3000) for j, own in jobs.items()}


def test_running_gives_a_value_for_each_element_across_parts(spark):
    from cliploom.functions.folds import running

    numbers = [(i * 37) % 11 - 4 for i in range(301)]
    rows = [(1, numbers), (2, []), (3, None), (4, numbers[:8])]
    df = spark.createDataFrame(rows, "id int, xs array<int>")

    # a sum that never falls below zero; nothing is given where it is zero
    def step(acc, x):
        total = F.greatest(F.lit(0), acc + x)
        return total, F.when(total > 0, total)

    for part in (4, 8, 128, 500):
        got = {r.id: r.out for r in df.select("id", running("xs", F.lit(0), step, "int", "int", part).alias("out")).collect()}
        for i, xs in rows:
            want, total = [], 0
            for x in xs or []:
                total = max(0, total + x)
                want += [total] if total > 0 else []
            assert got[i] == want
