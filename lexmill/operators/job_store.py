"""The job store as append-only logs: commands are appended, and states are views over them.

A log is a table of commands, never updated, so a lost executor or a second writer can't tear a row; what a store would
hold after them is an aggregate. A job's lease needs its commands one after another: they are folded in a job's own row,
which holds as many as the job has claims, beats and changes. Null kinds change nothing; commands of equal time follow their ids.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .jobs import stage_plan, stale

#: States of jobs that a claim leaves alone, that it may take, and that end a job.
DONE = ("succeeded", "attention", "cancelled")
CLAIMABLE = ("queued", "running", "interrupted", "waiting_secret", "partial_failed", "failed")
ENDED = ("succeeded", "attention", "partial_failed", "failed", "cancelled")
STATE = "struct<status:string,started_at:timestamp,finished_at:timestamp,updated_at:timestamp,heartbeat_at:timestamp,lease_owner:string,cancel_requested:boolean,resume_count:int,refused:int>"


def job_states(commands: DataFrame) -> DataFrame:
    """One row per job after its ``commands`` (job_id, at, command_id, kind, owner, status, clear_lease).

    ``claim`` and ``resume`` take a job's lease unless another owner runs it or its cancellation is asked for, which counts
    as ``refused``; of a finished job they change nothing. ``heartbeat`` counts from the lease's owner, or from any where
    either has none. ``cancel`` asks an unfinished job to stop. ``status`` sets a state, and may give the lease back.
    """
    row = F.struct("at", "command_id", "kind", "owner", "status", F.coalesce("clear_lease", F.lit(False)).alias("clear_lease"))
    log = commands.groupBy("job_id").agg(F.array_sort(F.collect_list(row)).alias("_log"))
    none = lambda t: F.lit(None).cast(t)
    start = F.struct(F.lit("queued").alias("status"), *(none("timestamp").alias(c) for c in ("started_at", "finished_at", "updated_at", "heartbeat_at")), none("string").alias("lease_owner"), F.lit(False).alias("cancel_requested"), F.lit(0).alias("resume_count"), F.lit(0).alias("refused")).cast(STATE)

    def step(s: Column, c: Column) -> Column:
        kind, at = F.coalesce(c["kind"], F.lit("")), c["at"]
        asks = kind.isin("claim", "resume")
        held = (s["status"] == "running") & s["lease_owner"].isNotNull() & ~s["lease_owner"].eqNullSafe(c["owner"])
        refused = asks & (held | ~s["status"].isin(*DONE, *CLAIMABLE))
        takes = asks & ~refused & s["status"].isin(*CLAIMABLE)
        beats = (kind == "heartbeat") & (c["owner"].isNull() | s["lease_owner"].isNull() | (c["owner"] == s["lease_owner"]))
        cancels = (kind == "cancel") & ~s["status"].isin(*DONE)
        sets = (kind == "status") & c["status"].isNotNull()
        frees = sets & c["clear_lease"]
        return F.struct(
            F.when(takes, "running").when(cancels, "cancel_requested").when(sets, c["status"]).otherwise(s["status"]).alias("status"),
            F.when(takes, F.coalesce(s["started_at"], at)).otherwise(s["started_at"]).alias("started_at"),
            F.when(sets & c["status"].isin(*ENDED), at).otherwise(s["finished_at"]).alias("finished_at"),
            F.when(takes | beats | cancels | sets, at).otherwise(s["updated_at"]).alias("updated_at"),
            F.when(takes | beats, at).when(frees, none("timestamp")).otherwise(s["heartbeat_at"]).alias("heartbeat_at"),
            F.when(takes, c["owner"]).when(frees, none("string")).otherwise(s["lease_owner"]).alias("lease_owner"),
            F.when(takes, False).when(cancels, True).otherwise(s["cancel_requested"]).alias("cancel_requested"),
            (s["resume_count"] + (takes & (kind == "resume")).cast("int")).alias("resume_count"),
            (s["refused"] + refused.cast("int")).alias("refused"),
        ).cast(STATE)

    return log.select("job_id", F.aggregate("_log", start, step).alias("_s")).select("job_id", "_s.*")


def _last(value: Column, among: Column) -> Column:
    """The value, which may be null, at the last command of those ``among``."""
    return F.max(F.when(among, F.struct("at", "command_id", F.struct(value.alias("v")).alias("s"))))["s"]["v"]


def stage_states(commands: DataFrame) -> DataFrame:
    """One row per stage after its ``commands`` (stage_id, at, command_id, kind, progress, artifact_id, error_code); partial aggregates only.

    ``start`` counts an attempt and clears what the last one left, ``progress`` is held between 0 and 1, ``complete`` and
    ``skip`` set it to 1, ``fail`` and ``wait`` leave it.
    """
    kind = F.col("kind")
    ends = kind.isin("complete", "fail", "wait", "skip")
    states = {"start": "running", "complete": "succeeded", "fail": "failed", "wait": "waiting_secret", "skip": "skipped"}
    status = reduce(lambda c, kv: c.when(kind == kv[0], kv[1]), states.items(), F)
    progress = F.when(kind == "start", 0.0).when(kind.isin("complete", "skip"), 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("progress"))))
    error = F.when(kind == "fail", F.col("error_code")).when(kind == "wait", "secret_required")
    return commands.groupBy("stage_id").agg(
        F.coalesce(_last(status, kind.isin(*states)), F.lit("pending")).alias("status"),
        F.count_if(kind == "start").alias("attempt"),
        F.coalesce(_last(progress, kind.isin("start", "complete", "skip") | ((kind == "progress") & F.col("progress").isNotNull())), F.lit(0.0)).alias("progress"),
        _last(F.col("at"), kind == "start").alias("started_at"),
        _last(F.when(ends, F.col("at")), ends | (kind == "start")).alias("finished_at"),
        _last(F.when(kind == "complete", F.col("artifact_id")), kind.isin("start", "complete")).alias("artifact_id"),
        _last(error, ends | (kind == "start")).alias("error_code"),
    )


def stage_beats(commands: DataFrame) -> DataFrame:
    """The heartbeats that progress and completion of a stage are for its job (commands with job_id), as rows for ``job_states``."""
    none = lambda c: F.lit(None).cast("string").alias(c)
    return commands.where(F.col("kind").isin("progress", "complete")).select("job_id", "at", "command_id", F.lit("heartbeat").alias("kind"), none("owner"), none("status"), F.lit(False).alias("clear_lease"))


def item_states(updates: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Partial updates (keys, at, command_id, columns): each column has its last value that is not null."""
    return updates.groupBy(*keys).agg(*(_last(F.col(c), F.col(c).isNotNull()).alias(c) for c in columns))


def insert_job(jobs: DataFrame, items: DataFrame, **steps: bool) -> dict[str, DataFrame]:
    """Rows that new jobs (job_id, created_at) and their items (job_id, item_id, ordinal) append to the four tables."""
    stages = stage_plan(items, **steps).withColumn("stage_id", F.concat_ws("/", F.col("job_id").cast("string"), "item_id", "stage_name"))
    events = jobs.select("job_id", F.col("created_at").alias("at"), F.lit(1).alias("sequence"), F.lit("job_created").alias("kind"), F.lit("queued").alias("status"))
    return {"jobs": jobs.withColumn("status", F.lit("queued")), "items": items, "stages": stages, "events": events}


def append(df: DataFrame, path: str) -> None:
    """Appends rows to a log of Parquet files; the commit of the job shows all of them or none."""
    df.write.mode("append").parquet(path)


def lookup(wanted: DataFrame, table: DataFrame, key: str, strict: bool = True) -> DataFrame:
    """The rows of ``table`` with the wanted keys; a key that has none is an error, or with ``strict`` off no row."""
    keys = wanted.select(F.col(key).alias("_wanted")).distinct()
    if not strict:
        return table.join(keys, F.col(key) == F.col("_wanted"), "left_semi")
    found = keys.join(table.withColumn("_there", F.lit(True)), F.col(key) == F.col("_wanted"), "left")
    missing = F.raise_error(F.concat(F.lit("no such "), F.lit(key), F.lit(": "), F.coalesce(F.col("_wanted").cast("string"), F.lit("null"))))
    return found.where(F.when(F.col("_there"), True).otherwise(missing.cast("boolean"))).drop("_wanted", "_there")


def in_order(table: DataFrame, group: str, *by: str) -> DataFrame:
    """Adds ``place`` from 1 in each group: items by ordinal, artifacts by time and id."""
    return table.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*by)))


def reconcile(jobs: DataFrame, stages: DataFrame, cutoff: str) -> tuple[DataFrame, DataFrame]:
    """Jobs whose lease is stale become interrupted, and their running stages with them; all other rows stay as they are."""
    gone = stale(jobs, cutoff).select("job_id").distinct().withColumn("_gone", F.lit(True))

    def marked(df: DataFrame) -> DataFrame:
        hit = F.coalesce("_gone", F.lit(False)) & (F.col("status") == "running")
        return df.join(gone, "job_id", "left").withColumn("status", F.when(hit, "interrupted").otherwise(F.col("status"))).drop("_gone")

    return marked(jobs), marked(stages)


def valid_stages(stages: DataFrame, artifacts: DataFrame, files: DataFrame, *, password: bool = False) -> DataFrame:
    """The stages (job_id, item_id, stage_name, status, artifact_id) that a resumed job need not run again.

    They succeeded, and their artifact's file (``files``: path, sha256, size_bytes) is there with its digest and size; with a
    password, masking also needs the file of a mapping of the same job and item ('' and null are the job's own).
    """
    sound = artifacts.join(files.select("path", "sha256", "size_bytes"), ["path", "sha256", "size_bytes"], "left_semi").select("artifact_id")
    good = stages.where("status = 'succeeded'").join(sound, "artifact_id", "left_semi")
    if not password:
        return good
    item = F.coalesce("item_id", F.lit("")).alias("_item")
    maps = artifacts.where("kind = 'mapping'").join(files.select("path"), "path", "left_semi").select(F.col("job_id").alias("_job"), item).distinct().withColumn("_map", F.lit(True))
    joined = good.join(maps, (F.col("job_id") == F.col("_job")) & (F.coalesce("item_id", F.lit("")) == F.col("_item")), "left")
    return joined.where((F.col("stage_name") != "mask") | F.col("_map").isNotNull()).drop("_job", "_item", "_map")
