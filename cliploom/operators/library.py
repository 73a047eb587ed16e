"""Tables about jobs: index, revisions, runs, queue, preferences, retention and views on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cliploom.functions.lineage import checkpointed
from cliploom.functions.text import strip

FINISHED = ("needs_review", "done", "canceled")
#: Statuses at which a job has come to an end, and names of extracted audio (fixed values).
TERMINAL = ("needs_review", "done", "failed", "canceled")
INTERMEDIATES = ("audio.wav", "audio_hq.flac")


def upsert_index(current: DataFrame, incoming: DataFrame, key: str, state: list[str]) -> DataFrame:
    """Rows of both sides: state columns from incoming where it has the key, all others kept; `is_new`."""
    new = incoming.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in state], F.lit(True).alias("_in"))
    j = current.withColumn("_old", F.lit(True)).join(new, F.col(key) == F.col("_k"), "full_outer")
    merged = {c: F.when(F.col("_in"), F.col(f"_{c}")).otherwise(F.col(c)) for c in state}
    return j.select(
        F.coalesce(key, "_k").alias(key),
        *[merged[c].alias(c) if c in state else F.col(c) for c in current.columns if c != key],
        F.col("_old").isNull().alias("is_new"),
    )


def existing_job_per_source(jobs: DataFrame) -> DataFrame:
    """One job for each source path: the last by name."""
    return jobs.groupBy("source_path").agg(F.max("job_name").alias("job_name"), F.max_by("status", "job_name").alias("status"))


def resume_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.filter(~F.col("status").isin(*FINISHED))


def number_revisions(revisions: DataFrame, *order: str) -> DataFrame:
    """Adds revision, 1..n in each job by arrival."""
    return revisions.withColumn("revision", F.row_number().over(Window.partitionBy("job_name").orderBy(*order)))


def job_contexts(jobs: DataFrame, revisions: DataFrame, requested: DataFrame) -> DataFrame:
    """Requested jobs with the number of their latest revision, or 0."""
    latest = revisions.groupBy("job_name").agg(F.count(F.lit(1)).alias("latest"))
    return (
        jobs.join(requested, "job_name", "left_semi")
        .join(latest, "job_name", "left")
        .select("job_name", "status", F.coalesce("latest", F.lit(0)).alias("latest_revision"))
    )


def resolve_creator_kit(jobs: DataFrame, projects: DataFrame, kits: DataFrame) -> DataFrame:
    """jobs (job_name, project_id, kit_id) with the kit that holds: their own, else the project's; `error` if unknown."""
    j = jobs.join(projects.select(F.col("id").alias("project_id"), "default_kit_id"), "project_id", "left")
    j = j.withColumn("kit", F.coalesce("kit_id", "default_kit_id"))
    known = kits.select(F.col("id").alias("kit"), F.lit(True).alias("_known"))
    return j.join(known, "kit", "left").select(
        "job_name", "kit", F.when(F.col("kit").isNotNull() & F.col("_known").isNull(), "unknown kit").alias("error")
    )


def list_projects(projects: DataFrame, include_archived: bool = False) -> DataFrame:
    """Projects, those updated last first, then by name whatever its case."""
    p = projects if include_archived else projects.filter(~F.col("archived"))
    return p.orderBy(F.col("updated_at").desc(), F.lower("name"), "id")


def runs_per_job(runs: DataFrame, n: int = 5, stages: DataFrame | None = None) -> DataFrame:
    """runs (job, run_id, started_at): the newest n of each job.

    With stages (run_id, stage_number, more columns) each run has its stages in order, as an array of structs; a
    run without any has an empty one.
    """
    order = Window.partitionBy("job").orderBy(F.col("started_at").desc(), F.col("run_id").desc())
    newest = runs.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= n)
    if stages is None:
        return newest
    item = F.struct("stage_number", *[c for c in stages.columns if c not in ("run_id", "stage_number")])
    kept = stages.join(newest.select("run_id").distinct(), "run_id", "left_semi")
    nested = kept.groupBy("run_id").agg(F.array_sort(F.collect_list(item)).alias("stages"))
    return newest.join(nested, "run_id", "left").withColumn("stages", F.coalesce("stages", F.array().cast(nested.schema["stages"].dataType)))


def latest_stage_state(updates: DataFrame) -> DataFrame:
    """updates (run_id, stage, status, started_at, seq): one row for each run and stage, the newest wins."""
    return updates.groupBy("run_id", "stage").agg(
        F.max_by("status", F.struct("seq", "status")).alias("status"),
        F.min("started_at").alias("started_at"),
        F.count(F.lit(1)).alias("updates"),
    )


def stage_timings(stages: DataFrame) -> DataFrame:
    return stages.groupBy("stage").agg(
        F.count(F.lit(1)).alias("runs"), F.sum("duration_seconds").alias("total_seconds"), F.max("duration_seconds").alias("longest")
    )


def run_timings(stages: DataFrame) -> DataFrame:
    """(run_id, stages, total_seconds, wait_seconds, execution_seconds): where each run's time went, to the millisecond.

    stages (run_id, duration_seconds, resource_wait_seconds, execution_seconds); unknown times count as none.
    """
    total = lambda c: F.round(F.sum(F.coalesce(F.col(c).cast("double"), F.lit(0.0))), 3)
    return stages.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("stages"),
        total("duration_seconds").alias("total_seconds"),
        total("resource_wait_seconds").alias("wait_seconds"),
        total("execution_seconds").alias("execution_seconds"),
    )


def global_rank(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """df with each row's place from 1 by `order`, without one task for all rows.

    Rows are range-partitioned and sorted; a row's place is its place in its partition and the rows of the
    partitions before, of which the driver sees one number a partition.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    # the upper bits of this id are the partition, the lower 33 count its rows in order
    at = checkpointed(dealt.withColumn("_at", F.monotonically_increasing_id()))
    per = dict(at.groupBy(F.shiftright("_at", 33).cast("int").alias("p")).count().collect())
    before = [0]
    for p in range(max(per, default=-1) + 1):
        before.append(before[-1] + per.get(p, 0))
    base = F.array(*[F.lit(x).cast("long") for x in before])
    place = F.get(base, F.shiftright("_at", 33).cast("int")) + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return at.withColumn(out, place).drop("_at")


def queue_order(queue: DataFrame) -> DataFrame:
    """Place of each pending row, by priority, position, creation; for queues of any length."""
    return global_rank(queue.filter("status = 'pending'"), [F.col("priority").desc(), F.col("position"), F.col("created_at"), F.col("id")], "place")


def stale_running(queue: DataFrame, cutoff: Column) -> DataFrame:
    stale = (F.col("status") == "running") & (F.col("heartbeat_at").isNull() | (F.col("heartbeat_at") < cutoff))
    return queue.withColumn("recovered", stale).withColumn("status", F.when(F.col("recovered"), "pending").otherwise(F.col("status")))


def runtime_state(jobs: DataFrame, queue: DataFrame, runs: DataFrame) -> DataFrame:
    """Flags of each job (job_name, active, stale, can_cancel, can_delete).

    queue (job_name, queue_status, cancel_requested), one row a job; runs (job_name, run_id, started_at,
    status, alive), of which the latest counts: alive says whether its worker still runs. A place in the queue
    makes a job active whatever its status says; a run only while the job isn't finished.
    """
    last = runs.groupBy("job_name").agg(F.max_by(F.struct("status", "alive"), F.struct("started_at", "run_id")).alias("_run"))
    j = jobs.join(queue, "job_name", "left").join(last, "job_name", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    terminal = yes(F.col("status").isin(*TERMINAL))
    active = yes(F.col("queue_status").isin("pending", "paused", "running")) | (~terminal & yes((F.col("_run.status") == "running") & F.col("_run.alive")))
    return j.select(
        "job_name",
        active.alias("active"),
        (~terminal & ~active).alias("stale"),
        (~terminal & ~yes(F.col("cancel_requested"))).alias("can_cancel"),
        (~active).alias("can_delete"),
    )


def preference_summary(events: DataFrame) -> DataFrame:
    """(section, key, value, n): what all preference events come to.

    Sections: `events` (their number), `clip_feedback` (accepted, rejected, cleared; also where nobody
    did), `replacement` (the last correction of each text: key becomes value) and `platform` (how often
    each was selected). Corrections that change nothing and blank texts or platforms are left out.
    """
    said = lambda c: F.trim(F.coalesce(c, F.lit("")))
    null = F.lit(None).cast("string")
    row = lambda section, key, value, n: [F.lit(section).alias("section"), key.alias("key"), value.alias("value"), n.cast("long").alias("n")]
    e = events.select("id", "kind", "created_at", *[said(F.col(c)).alias(c) for c in ("action", "before", "after", "platform")])
    every = e.agg(F.count(F.lit(1)).alias("n")).select(*row("events", null, null, F.col("n")))
    given = F.when(F.col("kind") == "clip_feedback", F.when(F.col("action") == "clear", "cleared").otherwise(F.col("action")))
    names = ("accepted", "rejected", "cleared")
    clips = e.agg(*[F.count_if(given == k).alias(k) for k in names]).select(
        F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("n")) for k in names])).alias("x")
    )
    changed = e.filter((F.col("kind") == "subtitle_correction") & (F.col("before") != "") & (F.col("after") != "") & (F.col("before") != F.col("after")))
    last = changed.groupBy("before").agg(F.max_by("after", F.struct("created_at", "id")).alias("after"))
    chosen = e.filter((F.col("kind") == "publish_selection") & (F.col("platform") != "")).groupBy("platform").agg(F.count(F.lit(1)).alias("n"))
    return (
        every.unionByName(clips.select(*row("clip_feedback", F.col("x.key"), null, F.col("x.n"))))
        .unionByName(last.select(*row("replacement", F.col("before"), F.col("after"), F.lit(None))))
        .unionByName(chosen.select(*row("platform", F.col("platform"), null, F.col("n"))))
    )


def clip_feedback_state(events: DataFrame, last: int = 1000) -> DataFrame:
    """The last action on each clip of a job; cleared ones go; the newest of each job."""
    f = (
        events.filter("kind = 'clip_feedback'")
        .groupBy("job_id", "key")
        .agg(F.max_by("action", F.struct("created_at", "id")).alias("action"), F.max("id").alias("id"))
        .filter("action <> 'clear'")
    )
    order = Window.partitionBy("job_id").orderBy(F.col("id").desc())
    return f.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= last).drop("_n")


def is_intermediate(name: Column) -> Column:
    """Whether a file may go once the final video is there: extracted audio, and what was written under a
    temporary name. The path before the name doesn't count, nor does case."""
    own = F.lower(F.regexp_extract(name, r"([^/]*)$", 1))
    return own.isin(*INTERMEDIATES) | own.endswith(".tmp") | own.endswith(".uploading") | own.contains(".tmp.")


def retention_plan(jobs: DataFrame, files: DataFrame, cutoff: Column, mode: str = "all") -> DataFrame:
    """(job_name, reason, files, bytes): what could be removed of each job, and why a job stays. A plan only;
    nothing is deleted.

    Mode `all` removes whole jobs (files is null), `intermediates` only what is_intermediate() of jobs that are
    done and have their final.mp4. Jobs changed since the cutoff, of no status or still at work stay.
    """
    if mode not in ("all", "intermediates"):
        raise ValueError(f"unknown mode {mode}")
    status = F.lower(F.trim(F.coalesce("status", F.lit(""))))
    reason = (
        F.when(F.col("updated_at") >= cutoff, "retention_not_reached")
        .when(status == "", "unknown_status")
        .when(~status.isin(*TERMINAL), "active_job")
    )
    gone = is_intermediate(F.col("name")) if mode == "intermediates" else F.lit(True)
    per = files.groupBy("job_name").agg(
        F.count_if(gone).alias("n"), F.sum(F.when(gone, F.col("size_bytes"))).alias("b"), F.bool_or(F.col("name") == "final.mp4").alias("_final")
    )
    if mode == "intermediates":
        reason = reason.when((status != "done") | ~F.coalesce("_final", F.lit(False)), "final_output_required")
    none = F.col("reason").isNotNull()
    many = F.coalesce("n", F.lit(0)) if mode == "intermediates" else F.lit(None).cast("bigint")
    return jobs.join(per, "job_name", "left").withColumn("reason", reason).select(
        "job_name", "reason", F.when(none, None).otherwise(many).alias("files"), F.when(none, None).otherwise(F.coalesce("b", F.lit(0))).alias("bytes")
    )


def artifact_inventory(files: DataFrame) -> DataFrame:
    return files.groupBy("job_name").agg(
        F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes"), F.max("modified_at").alias("newest")
    )


#: Stages of a run in order, and the statuses that name one in another form (fixed values).
STAGES = (
    "probe", "detect_corruption", "extract_audio", "transcribe", "detect_silence", "detect_freeze", "detect_scenes", "plan_cuts",
    "refine_cuts", "style_subtitles", "plan_crop", "plan_uvr", "plan_render", "render_review", "render_final", "render_web_preview",
)
STAGE_OF_STATUS = {
    "probing": "probe", "detecting_corruption": "detect_corruption", "extracting_audio": "extract_audio", "transcribing": "transcribe",
    "detecting_silence": "detect_silence", "detecting_freeze": "detect_freeze", "detecting_scenes": "detect_scenes", "planning_cuts": "plan_cuts",
    "refining_cuts": "refine_cuts", "styling_subtitles": "style_subtitles", "planning_crop": "plan_crop", "planning_uvr": "plan_uvr",
    "planning_render": "plan_render", "rendering_review": "render_review", "rendering_final": "render_final", "rendering_web_preview": "render_web_preview",
}


def status_group(status: Column) -> Column:
    return F.when(status.isin("failed", "canceled"), "failed").when(status == "done", "done").when(status == "needs_review", "review").otherwise("processing")


def progress_of(status: Column, stage: Column) -> Column:
    """Percent of its stages that a job has reached: all where it has ended, none in an unknown stage."""
    named = F.create_map(*[F.lit(x) for pair in STAGE_OF_STATUS.items() for x in pair])
    at = F.array_position(F.array(*[F.lit(x) for x in STAGES]), F.coalesce(F.nullif(stage, F.lit("")), F.try_element_at(named, status), F.lit("")))
    return F.when(status.isin(*TERMINAL), 100).otherwise(F.floor(at * 100 / len(STAGES) + 0.5)).cast("int")


def dashboard_view(jobs: DataFrame, search: str = "", n: int = 100, group: str = "all") -> DataFrame:
    """The first n jobs for a dashboard, of one status group or all: review, failed, processing, done, each
    newest first."""
    own = status_group(F.col("status"))
    rank = F.when(own == "review", 0).when(own == "failed", 1).when(own == "processing", 2).otherwise(3)
    hit = F.contains(F.lower(F.concat_ws(" ", "source_path", "job_name")), F.lit(search.lower()))
    return (
        jobs.filter(hit if group == "all" else hit & (own == group))
        .select("job_name", "source_path", own.alias("status_group"), "updated_at", rank.alias("sort_key"))
        .orderBy("sort_key", F.col("updated_at").desc(), "job_name")
        .limit(n)
    )


def _in_batches(jobs: DataFrame) -> DataFrame:
    return jobs.withColumn("batch_id", strip(F.col("batch_id").cast("string"))).filter("batch_id <> ''")


def batch_groups(jobs: DataFrame) -> DataFrame:
    """Batches of two or more jobs with their numbers by status group and their jobs' mean progress in percent.

    jobs (batch_id, status[, current_stage]); jobs of no or a blank batch are in none.
    """
    group = status_group(F.col("status"))
    count = lambda g: F.count_if(group == g).alias(g)
    stage = F.col("current_stage") if "current_stage" in jobs.columns else F.lit(None).cast("string")
    return (
        _in_batches(jobs)
        .groupBy("batch_id")
        .agg(
            F.count(F.lit(1)).alias("jobs"), count("failed"), count("done"), count("review"), count("processing"),
            F.floor(F.avg(progress_of(F.col("status"), stage)) + 0.5).cast("int").alias("progress"),
        )
        .filter("jobs >= 2")
    )


def batch_order(jobs: DataFrame) -> DataFrame:
    """jobs (job_name, batch_id, batch_index, updated_at) of batches of two or more, with their place from 1 in it:
    by index, those without one last, then newest first."""
    batch = Window.partitionBy("batch_id")
    order = batch.orderBy(F.col("batch_index").asc_nulls_last(), F.col("updated_at").desc(), "job_name")
    placed = _in_batches(jobs).withColumn("place", F.row_number().over(order)).withColumn("_n", F.count(F.lit(1)).over(batch))
    return placed.filter("_n >= 2").drop("_n")


def merge_snapshots(current: DataFrame, following: DataFrame, preserve_missing: bool = False) -> DataFrame:
    """(job_name, version, status[, files], missing) by job: current stays if its version is above 0 and the next one's is
    0 or lower; else the next one holds, with current's files (if the tables have that column) where it has
    none. Jobs missing from the next snapshot go unless preserved. No version counts as 0."""
    with_files = "files" in current.columns and "files" in following.columns
    version = lambda: F.coalesce("version", F.lit(0))
    n = following.select(F.col("job_name").alias("_k"), version().alias("_v"), F.col("status").alias("_s"), *([F.col("files").alias("_f")] if with_files else []))
    j = current.withColumn("version", version()).join(n, F.col("job_name") == F.col("_k"), "full_outer")
    stays = (F.col("version") > 0) & ((F.col("_v") == 0) | (F.col("_v") < F.col("version")))
    use = F.when(F.col("_k").isNull() | F.coalesce(stays, F.lit(False)), True).otherwise(False)
    out = j.select(
        F.coalesce("job_name", "_k").alias("job_name"),
        F.when(use, F.col("version")).otherwise(F.col("_v")).alias("version"),
        F.when(use, F.col("status")).otherwise(F.col("_s")).alias("status"),
        *([F.when(use, F.col("files")).otherwise(F.coalesce("_f", "files")).alias("files")] if with_files else []),
        F.col("_k").isNull().alias("missing"),
    )
    return out if preserve_missing else out.filter(~F.col("missing"))


def drop_deleted(tables: dict[str, DataFrame], deleted: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of deleted jobs."""
    return {name: t.join(deleted.select("job_name"), "job_name", "left_anti") for name, t in tables.items()}


def checked_recipes(recipes: DataFrame) -> DataFrame:
    """recipes (client_id, body JSON[, more]) -> (..., name, stages, options, creator_kit_id, target_platforms, error).

    A recipe needs a client id and a name (cut to 120 characters); stages and target_platforms are lists of texts,
    options an object; members that aren't there are empty, blank items go. What is wrong first is its error,
    and its fields are null then.
    """
    v = F.try_parse_json("body")
    many = "array<variant>"
    kind = lambda c: F.regexp_extract(F.schema_of_variant(c), r"^[A-Z]+", 0)
    member = lambda n: F.try_variant_get(v, f"$.{n}", "variant")
    said = lambda n: strip(F.coalesce(F.try_variant_get(v, f"$.{n}", "string"), F.lit("")))
    items = lambda n: F.coalesce(F.try_variant_get(v, f"$.{n}", many), F.array().cast(many))
    texts_only = lambda n: F.coalesce((kind(member(n)) == "ARRAY") & F.forall(items(n), lambda x: kind(x) == "STRING"), F.lit(True))
    texts = lambda n: F.filter(F.transform(items(n), lambda x: strip(F.try_variant_get(x, "$", "string"))), lambda x: x != "")
    error = (
        F.when(strip(F.coalesce("client_id", F.lit(""))) == "", "without a client id")
        .when(F.coalesce(kind(v), F.lit("")) != "OBJECT", "not an object")
        .when(said("name") == "", "without a name")
        .when(~texts_only("stages"), "stages are no list of texts")
        .when(F.coalesce(kind(member("options")), F.lit("OBJECT")) != "OBJECT", "options are no object")
        .when(~texts_only("target_platforms"), "target_platforms are no list of texts")
    )
    good = lambda c: F.when(error.isNull(), c)
    return recipes.withColumn("client_id", strip("client_id")).select(
        *[c for c in recipes.columns if c != "body"],
        good(F.substring(said("name"), 1, 120)).alias("name"),
        good(texts("stages")).alias("stages"),
        good(F.coalesce(F.to_json(member("options")), F.lit("{}"))).alias("options"),
        good(F.nullif(said("creator_kit_id"), F.lit(""))).alias("creator_kit_id"),
        good(texts("target_platforms")).alias("target_platforms"),
        error.alias("error"),
    )


def import_recipes(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Recipes by client_id: existing rows win, the first of repeated new ones is taken."""
    order = Window.partitionBy("client_id").orderBy("id")
    first = incoming.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")
    return current.unionByName(first.join(current.select("client_id"), "client_id", "left_anti").select(*current.columns))


def asr_attempts(attempts: DataFrame, last: int = 20) -> DataFrame:
    """(job, backend[, model], ok, seconds, at, id): successes and seconds by backend (and model) over each job's last attempts."""
    order = Window.partitionBy("job").orderBy(F.col("at").desc(), F.col("id").desc())
    return (
        attempts.withColumn("_n", F.row_number().over(order))
        .filter(F.col("_n") <= last)
        .groupBy("backend", *(["model"] if "model" in attempts.columns else []))
        .agg(F.count(F.lit(1)).alias("attempts"), F.count_if("ok").alias("succeeded"), F.sum("seconds").alias("seconds"))
    )


def duplicate_media(catalog: DataFrame) -> DataFrame:
    """catalog (path, fingerprint, size): fingerprints of more than one file."""
    return (
        catalog.groupBy("fingerprint")
        .agg(F.count(F.lit(1)).alias("files"), F.min("path").alias("first_path"), F.sum("size").alias("bytes"))
        .filter("files > 1")
    )


def union_all(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)
