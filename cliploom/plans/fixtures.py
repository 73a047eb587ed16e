"""Views of the test tables as recordings, transcripts and job tables, for the registered queries."""

from __future__ import annotations

from threading import Lock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom.operators import cuts, intervals, transcript
from cliploom.sources.library import Library, write_library

RECORDING_MS = 720_000
ARTIFACTS = ("job.json", "cuts.json", "transcript.json", "audio_16k.wav", "final.mp4", "render.tmp")
TRIGGERS = (
    "CUDA out of memory",
    "h264_nvenc failed to open",
    "ffmpeg was not found",
    "empty transcript",
    "No space left on device",
    "Error while decoding stream #0:0",
)


#: Libraries that a session has written, by application and folder.
_WRITTEN: dict[tuple[str, str], Library] = {}
_LOCK = Lock()


class Views:
    """The derived views of one folder of tables; each is a plan, nothing is computed here."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def events(self) -> DataFrame:
        us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
        return self.table("events").select(
            "event_id",
            F.col("user_id").alias("job_id"),
            "event_type",
            "value",
            "props",
            "ts",
            us.alias("us"),
            F.floor(us / 3_600_000).alias("start_ms"),
            F.round(F.col("value") * 250).cast("long").alias("len_ms"),
        )

    def _ranges(self, *kinds: str) -> DataFrame:
        e = self.events().filter(F.col("event_type").isin(*kinds))
        return e.select("job_id", "start_ms", (F.col("start_ms") + F.col("len_ms")).alias("end_ms"))

    def durations(self) -> DataFrame:
        return self.events().select("job_id").distinct().withColumn("duration_ms", F.lit(RECORDING_MS).cast("long"))

    def silences(self) -> DataFrame:
        return self._ranges("error", "signup")

    def freezes(self) -> DataFrame:
        return self._ranges("view", "click")

    def scenes(self) -> DataFrame:
        return self.events().filter("event_type = 'click'").select("job_id", F.col("start_ms").alias("time_ms"))

    def highlights(self) -> DataFrame:
        return (
            self.events()
            .filter("event_type = 'purchase'")
            .select(
                "job_id",
                F.col("event_id").alias("idx"),
                "start_ms",
                (F.col("start_ms") + F.col("len_ms")).alias("end_ms"),
                F.col("value").alias("score"),
                F.col("props").alias("reason"),
                F.col("event_type").alias("recommended_use"),
            )
        )

    def untimed(self) -> DataFrame:
        jobs = self.table("events").agg((F.max("user_id") + 1).alias("jobs"))
        lines = self.table("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
        return lines.join(F.broadcast(jobs)).select(
            F.pmod("doc_id", "jobs").alias("job_id"),
            (F.col("doc_id") * 100_000 + F.col("line")).alias("seg_idx"),
            "text",
        )

    def segments(self) -> DataFrame:
        return transcript.clean_segments(transcript.allocate_untimed(self.untimed(), self.durations()), self.durations())

    def library(self) -> Library:
        """The recordings of this folder as bucketed tables, each written once in a session, when a query first asks for it."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir)
        with _LOCK:
            if key not in _WRITTEN:
                _WRITTEN[key] = write_library(
                    self.spark,
                    [
                        ("durations", self.durations()),
                        ("scenes", lambda made: cuts.valid_marks(self.scenes(), made["durations"])),
                        ("highlights", self.highlights()),
                        ("invalid", lambda made: intervals.invalid_segments(self.silences(), self.freezes(), made["durations"])),
                        ("clips", lambda made: intervals.keep_clips(made["invalid"], made["durations"])),
                        ("segments", self.segments()),
                        ("spoken", lambda made: (made["segments"], transcript.with_words)),
                    ],
                    lazy=True,
                )
        return _WRITTEN[key]

    def words(self) -> DataFrame:
        return transcript.spread_words(self.segments())

    def chat_segments(self) -> DataFrame:
        return self.table("conversations").select(F.col("conv_id").alias("job_id"), F.col("turn").alias("seg_idx"), "text")

    def jobs(self) -> DataFrame:
        status = (
            F.when(F.col("o_orderpriority") == "1-URGENT", "failed")
            .when(F.col("o_orderstatus") == "F", "done")
            .when(F.col("o_orderstatus") == "O", "needs_review")
            .otherwise("transcribing")
        )
        return self.table("orders").select(
            F.concat(F.lit("job-"), "o_orderkey").alias("job_name"),
            F.concat(F.lit("src-"), "o_custkey").alias("source_path"),
            status.alias("status"),
            (F.col("o_custkey") % 500).alias("batch_id"),
            F.col("o_orderdate").alias("updated_at"),
            (F.col("o_orderkey") % 7).alias("state_version"),
        )

    def projects(self) -> DataFrame:
        return self.table("nation").select(
            F.col("n_nationkey").alias("id"),
            F.col("n_name").alias("name"),
            (F.col("n_regionkey") == 0).alias("archived"),
            F.col("n_regionkey").alias("default_kit_id"),
        )

    def revisions(self) -> DataFrame:
        return self.table("lineitem").select(
            F.concat(F.lit("job-"), "l_orderkey").alias("job_name"),
            F.when(F.col("l_returnflag") == "R", "cuts").otherwise("transcript").alias("kind"),
            F.col("l_shipdate").alias("created_at"),
            "l_linenumber",
            "l_partkey",
            "l_suppkey",
            "l_quantity",
            "l_extendedprice",
        )

    def stage_runs(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("run_id"),
            F.concat(F.lit("stage-"), "l_linenumber").alias("stage"),
            F.col("l_quantity").alias("duration_seconds"),
            F.col("l_returnflag").alias("status"),
            F.col("l_shipdate").alias("started_at"),
            F.col("l_partkey").alias("seq"),
        )

    def preference_events(self) -> DataFrame:
        kind = (
            F.when(F.col("event_type").isin("click", "view", "error"), "clip_feedback")
            .when(F.col("event_type") == "signup", "subtitle_correction")
            .otherwise("publish_selection")
        )
        action = (
            F.when(F.col("event_type") == "click", "accepted")
            .when(F.col("event_type") == "view", "rejected")
            .when(F.col("event_type") == "error", "clear")
        )
        return self.events().select(
            F.col("event_id").alias("id"),
            kind.alias("kind"),
            "job_id",
            action.alias("action"),
            F.get_json_object("props", "$.k").alias("key"),
            F.col("ts").alias("created_at"),
            F.concat(F.lit(" word-"), F.get_json_object("props", "$.k")).alias("before"),
            F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("word-"), F.get_json_object("props", "$.k"))).otherwise(F.concat(F.lit("fix-"), F.col("event_id") % 7)).alias("after"),
            F.element_at(F.array(*[F.lit(p) for p in ("", " a", "b ", "c")]), (F.col("event_id") % 4 + 1).cast("int")).alias("platform"),
        )

    def publish_steps(self) -> DataFrame:
        states = F.array(*[F.lit(s) for s in ("draft", "validating", "uploading", "processing", "published", "failed")])
        return self.table("lineitem").select(
            F.col("l_partkey").alias("attempt_id"),
            F.col("l_orderkey").alias("seq"),
            "l_linenumber",
            "l_suppkey",
            F.element_at(states, (F.col("l_linenumber") % 6 + 1).cast("int")).alias("status"),
            F.col("l_quantity").cast("long").alias("uploaded_bytes"),
            F.lit(40).cast("long").alias("total_bytes"),
        )

    def files(self) -> DataFrame:
        names = F.array(*[F.lit(a) for a in ARTIFACTS])
        return self.table("part").select(
            F.concat(F.lit("job-"), F.col("p_partkey") % 400).alias("job_name"),
            F.element_at(names, (F.col("p_partkey") % 6 + 1).cast("int")).alias("name"),
            (F.col("p_size") * 1000).cast("long").alias("size_bytes"),
            F.col("p_partkey").alias("modified_at"),
        )

    def errors(self) -> DataFrame:
        phrase = F.when(F.col("doc_id") % 7 == 6, "").otherwise(
            F.element_at(F.array(*[F.lit(t) for t in TRIGGERS]), (F.col("doc_id") % 7 % 6 + 1).cast("int"))
        )
        return self.table("documents").select("doc_id", F.concat("text", F.lit("\n"), phrase).alias("text"))

    def log_lines(self) -> DataFrame:
        """Detector logs printed from the silences: a start line, and an end line with the duration;
        the start lines of rows whose k is a multiple of ten are missing."""
        e = self.events().filter("event_type in ('error', 'signup')").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
        sec = lambda c: F.format_string("%d.%03d", (c / 1000).cast("long"), (c % 1000))
        end = F.col("start_ms") + F.col("len_ms")
        starts = e.filter("k % 10 <> 0").select(
            "job_id", (F.col("start_ms") * 2).alias("at"), "event_id", F.concat(F.lit("[silencedetect @ 0x1] silence_start: "), sec(F.col("start_ms"))).alias("line")
        )
        ends = e.select(
            "job_id",
            (end * 2 + 1).alias("at"),
            "event_id",
            F.concat(F.lit("[silencedetect @ 0x1] silence_end: "), sec(end), F.lit(" | silence_duration: "), sec(F.col("len_ms"))).alias("line"),
        )
        from pyspark.sql import Window

        order = Window.partitionBy("job_id").orderBy("at", "event_id")
        return starts.union(ends).select("job_id", F.row_number().over(order).alias("line_no"), "line")

    def samples(self) -> DataFrame:
        from pyspark.sql import Window

        order = Window.partitionBy("l_orderkey", F.col("l_suppkey") % 2).orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
        value = F.least(F.greatest(F.floor("l_extendedprice") - 32768, F.lit(-32768)), F.lit(32767))
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("job_id"),
            (F.row_number().over(order) - 1).cast("long").alias("frame"),
            (F.col("l_suppkey") % 2).cast("int").alias("channel"),
            value.cast("int").alias("value"),
        )
