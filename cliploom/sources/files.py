"""Files of jobs as tables, and tables as files of jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: File name endings of media (fixed values).
MEDIA = ("mp4", "mov", "mkv", "avi", "flv", "webm", "m4v", "ts", "mp3", "wav")
JOB_STATE = (
    "source_path string, job_dir string, batch_id string, batch_index int, batch_size int, status string, error string, "
    "created_at string, updated_at string, current_stage string, stage_progress double, state_version int"
)
ARTIFACTS = {
    "transcript": "text string, language string, duration double, segments array<struct<id:int,start:double,end:double,text:string,speaker:string,"
    "words:array<struct<start:double,end:double,word:string,probability:double>>>>",
    "silence": "silences array<struct<start:double,end:double>>",
    "freeze": "freezes array<struct<start:double,end:double>>",
    "scene": "scenes array<struct<time:double,reason:string>>",
    "highlights": "highlights array<struct<start:double,end:double,score:double,reason:string,recommended_use:string>>",
    "cuts": "clips array<struct<start:double,end:double,keep:boolean,reason:string>>",
}


def _documents(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """One row per readable */name of root; the directory is the job. Dot directories are left out."""
    raw = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad")
    found = raw.schema(schema + ", _bad string").json(f"{root.rstrip('/')}/*/{name}")
    job = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)
    return found.select(job.alias("job_id"), "*").filter("_bad is null and job_id not like '.%'").drop("_bad")


def read_job_states(spark: SparkSession, root: str) -> DataFrame:
    """All jobs' states, newest first; unreadable files are left out."""
    return _documents(spark, root, "job.json", JOB_STATE).orderBy(F.col("updated_at").desc(), "job_id")


def read_artifact(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One kind of artifact of all jobs; jobs without a valid file have no row."""
    return _documents(spark, root, f"{name}.json", ARTIFACTS[name])


def artifact_ranges(artifact: DataFrame, field: str) -> DataFrame:
    """Ranges (job_id, start_ms, end_ms) of a silence, freeze or highlight artifact, from seconds."""
    ms = lambda c: F.floor(F.col(c) * 1000 + 0.5)
    return (
        artifact.select("job_id", F.explode(field).alias("r"))
        .select("job_id", ms("r.start").alias("start_ms"), ms("r.end").alias("end_ms"))
        .filter("start_ms is not null and end_ms is not null")
    )


def media_catalog(spark: SparkSession, root: str) -> DataFrame:
    """Media files below root: path, name, size, modified_at; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select(
        "path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified_at")
    ).filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*MEDIA))


def newest_media(catalog: DataFrame, n: int = 200) -> DataFrame:
    return catalog.orderBy(F.col("modified_at").desc(), "path").limit(n)


#: Options of a batch file, its items or its caller (fixed values).
BATCH_OPTIONS = ("force", "detect_silence", "detect_freeze", "detect_scenes", "render_review", "render_final", "vertical", "burn_subtitles", "plan_crop", "plan_uvr", "skip_transcribe")


def _truth(v: Column) -> Column:
    """Whether a JSON value counts as yes: not null, false, zero, or an empty text, list or object."""
    text = F.to_json(v)
    return ~text.isin("null", "false", '""', "[]", "{}") & (F.coalesce(F.try_variant_get(v, "$", "double"), F.lit(1.0)) != 0)


def expand_batch(manifests: DataFrame, options: tuple[str, ...] = BATCH_OPTIONS) -> DataFrame:
    """manifests (batch_id, body[, base_dir][, options of the caller]) -> (batch_id, batch_index, path, *options, error).

    A body is a JSON list, or an object with `files`; an item a path or an object with path or source_path. An
    item's own option wins, else the caller's or the file's has to say yes. Relative paths lie below base_dir.
    A body or item that is neither has a row with its error instead (batch_index null for a body).
    """
    many = "array<variant>"
    has = lambda c: c in manifests.columns
    v = F.try_parse_json("body")
    kind = lambda c: F.regexp_extract(F.schema_of_variant(c), r"^[A-Z]+", 0)
    is_object = F.coalesce(kind(v) == "OBJECT", F.lit(False))
    items = F.when(is_object, F.try_variant_get(v, "$.files", many)).otherwise(F.try_variant_get(v, "$", many))

    def default(name: str) -> Column:
        file = F.when(is_object, _truth(F.try_variant_get(v, f"$.{name}", "variant")))
        caller = F.coalesce(F.col(name), F.lit(False)) if has(name) else F.lit(False)
        return F.coalesce(file, F.lit(False)) | caller

    top = manifests.select("batch_id", (F.col("base_dir") if has("base_dir") else F.lit(None).cast("string")).alias("_base"), items.alias("_items"), *[default(o).alias(f"_{o}") for o in options])
    bad = top.filter("_items is null").select("batch_id", F.lit(None).cast("int").alias("batch_index"), F.lit(None).cast("string").alias("path"), *[F.lit(None).cast("boolean").alias(o) for o in options], F.lit("neither a list nor an object with files").alias("error"))
    each = top.filter("_items is not null").select("*", F.posexplode("_items").alias("batch_index", "item")).withColumn("_kind", kind(F.col("item")))
    member = lambda n: F.try_variant_get("item", f"$.{n}", "string")
    path = F.when(F.col("_kind") == "STRING", F.try_variant_get("item", "$", "string")).when(
        F.col("_kind") == "OBJECT", F.coalesce(F.nullif(member("path"), F.lit("")), F.nullif(member("source_path"), F.lit("")))
    )
    error = F.when(~F.col("_kind").isin("STRING", "OBJECT"), "neither a path nor an object").when(F.coalesce(path, F.lit("")) == "", "without a path")
    below = F.when(path.startswith("/") | F.col("_base").isNull(), path).otherwise(F.concat_ws("/", F.rtrim("_base", F.lit("/")), path))
    own = lambda o: F.when(F.col("_kind") == "OBJECT", _truth(F.try_variant_get("item", f"$.{o}", "variant")))
    rows = each.select(
        "batch_id", "batch_index", F.when(error.isNull(), below).alias("path"), *[F.when(error.isNull(), F.coalesce(own(o), F.col(f"_{o}"))).alias(o) for o in options], error.alias("error")
    )
    return rows.unionByName(bad)


def write_documents(documents: DataFrame, path: str) -> None:
    """documents (job_id, document): one text file in a directory for each job."""
    documents.select("job_id", F.col("document").alias("value")).repartition("job_id").write.mode("overwrite").partitionBy("job_id").text(path)


def project_bundle(projects: DataFrame, jobs: DataFrame, recipes: DataFrame, project_id, allowed: tuple[str, ...], files: DataFrame) -> DataFrame:
    """(id, kind, name): a project's manifest as rows: itself, its jobs, the recipes they use, the kits they were
    made with (where jobs have kit_snapshot_id) and their allowed files. A sink may nest them.

    jobs (job_name, project_id, recipe_id[, kit_snapshot_id]); files (job_name, name)."""
    own = jobs.filter(F.col("project_id") == project_id)
    row = lambda kind, name: [F.lit(project_id).cast(projects.schema["id"].dataType).alias("id"), F.lit(kind).alias("kind"), name.cast("string").alias("name")]
    used = recipes.join(own.select(F.col("recipe_id").alias("id")).distinct(), "id", "left_semi")
    kept = files.filter(F.col("name").isin(*allowed)).join(own.select("job_name").distinct(), "job_name", "left_semi")
    parts = [
        projects.filter(F.col("id") == project_id).select(*row("project", F.col("name"))),
        own.select(*row("job", F.col("job_name"))),
        used.select(*row("recipe", F.col("id"))),
        kept.select(*row("file", F.concat_ws("/", "job_name", "name"))),
    ]
    if "kit_snapshot_id" in jobs.columns:
        parts.append(own.filter("kit_snapshot_id is not null").select(*row("kit", F.col("kit_snapshot_id"))))
    return reduce(DataFrame.unionByName, parts).distinct()


def watch_media(spark: SparkSession, root: str) -> DataFrame:
    """A stream of media files below root, each path once."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).load(root)
    return (
        files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
        .filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*MEDIA))
        .dropDuplicates(["path"])
    )
