"""Queries of the job store: logs of commands made from events, items and files made from lineitem and orders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.operators import job_store as S
from lexmill.operators import jobs as J

from .job_queries import ITEMS, JOBS, STAGES, jobs, read, stages

KINDS = ("claim", "heartbeat", "resume", "status", "claim", "cancel", "heartbeat", "status")
SET = ("waiting_secret", "failed", "interrupted", "partial_failed", "succeeded", "attention")
STEPS = ("start", "progress", "complete", "start", "fail", "progress", "wait", "skip")


def _pick(words, by):
    return F.element_at(F.array(*map(F.lit, words)), (by % len(words) + 1).cast("int"))


def job_log(spark, d):
    k = F.col("event_id")
    kind = _pick(KINDS, k)
    return read(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("ts").cast("timestamp").alias("at"), k.alias("command_id"), kind.alias("kind"), F.when(k % 13 > 0, F.concat(F.lit("w"), (k % 3).cast("string"))).alias("owner"), F.when(kind == "status", _pick(SET, F.floor(k / 8))).alias("status"), (k % 5 == 0).alias("clear_lease"))


def stage_log(spark, d):
    k = F.col("event_id")
    stage = F.concat(F.col("user_id").cast("string"), F.lit("/"), (k % 7).cast("string"))
    return read(spark, d, "events").select("user_id", stage.alias("stage_id"), F.col("user_id").alias("job_id"), F.col("ts").cast("timestamp").alias("at"), k.alias("command_id"), _pick(STEPS, F.floor(k / 7)).alias("kind"), F.when(k % 11 > 0, F.col("value") / 50 - 0.5).alias("progress"), F.concat(F.lit("a"), k.cast("string")).alias("artifact_id"), F.concat(F.lit("e"), (k % 4).cast("string")).alias("error_code"))


def _stamp(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def q_leases(spark, d):
    return S.job_states(job_log(spark, d)).select("job_id", "status", *map(_stamp, ("started_at", "finished_at", "updated_at", "heartbeat_at")), "lease_owner", "cancel_requested", F.col("resume_count").cast("long").alias("resume_count"), F.col("refused").cast("long").alias("refused"))


LOG = f"""log AS (SELECT user_id AS job_id, ts AS tm, event_id AS command_id, {list(KINDS)}[event_id % 8 + 1] AS kind, CASE WHEN event_id % 13 > 0 THEN 'w' || event_id % 3 END AS owner,
  CASE WHEN event_id % 8 IN (3, 7) THEN {list(SET)}[event_id // 8 % 6 + 1] END AS status, event_id % 5 = 0 AS frees, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)"""
LEASES_SQL = f"""WITH RECURSIVE {LOG},
s(job_id, n, status, started, finished, updated, beat, owner, cancelled, resumed, refused) AS (
  SELECT DISTINCT user_id, CAST(0 AS BIGINT), 'queued', CAST(NULL AS TIMESTAMP), CAST(NULL AS TIMESTAMP), CAST(NULL AS TIMESTAMP), CAST(NULL AS TIMESTAMP), CAST(NULL AS VARCHAR), false, CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM events
  UNION ALL
  SELECT job_id, n, CASE did WHEN 'take' THEN 'running' WHEN 'cancel' THEN 'cancel_requested' WHEN 'set' THEN new ELSE status END,
    CASE WHEN did = 'take' AND started IS NULL THEN tm ELSE started END, CASE WHEN did = 'set' AND new IN ('succeeded', 'attention', 'partial_failed', 'failed', 'cancelled') THEN tm ELSE finished END,
    CASE WHEN did IN ('take', 'beat', 'cancel', 'set') THEN tm ELSE updated END, CASE WHEN did IN ('take', 'beat') THEN tm WHEN did = 'set' AND frees THEN NULL ELSE beat END,
    CASE WHEN did = 'take' THEN who WHEN did = 'set' AND frees THEN NULL ELSE owner END, CASE did WHEN 'take' THEN false WHEN 'cancel' THEN true ELSE cancelled END,
    resumed + CASE WHEN did = 'take' AND kind = 'resume' THEN 1 ELSE 0 END, refused + CASE WHEN did = 'refuse' THEN 1 ELSE 0 END
  FROM (SELECT s.* EXCLUDE (n), l.n, l.tm, l.kind, l.owner AS who, l.status AS new, l.frees,
      CASE WHEN l.kind IN ('claim', 'resume') THEN CASE WHEN s.status = 'running' AND s.owner IS NOT NULL AND s.owner IS DISTINCT FROM l.owner THEN 'refuse' WHEN s.status IN ('succeeded', 'attention', 'cancelled') THEN 'none' WHEN s.status = 'cancel_requested' THEN 'refuse' ELSE 'take' END
        WHEN l.kind = 'heartbeat' THEN CASE WHEN l.owner IS NULL OR s.owner IS NULL OR l.owner = s.owner THEN 'beat' ELSE 'none' END
        WHEN l.kind = 'cancel' THEN CASE WHEN s.status IN ('succeeded', 'attention', 'cancelled') THEN 'none' ELSE 'cancel' END ELSE 'set' END AS did
    FROM s JOIN log l ON l.job_id = s.job_id AND l.n = s.n + 1))
SELECT job_id, status, strftime(started, '%Y-%m-%d %H:%M:%S') AS started_at, strftime(finished, '%Y-%m-%d %H:%M:%S') AS finished_at, strftime(updated, '%Y-%m-%d %H:%M:%S') AS updated_at, strftime(beat, '%Y-%m-%d %H:%M:%S') AS heartbeat_at,
  owner AS lease_owner, cancelled AS cancel_requested, resumed AS resume_count, refused FROM s QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY n DESC) = 1"""


def q_stage_states(spark, d):
    return S.stage_states(stage_log(spark, d)).select("stage_id", "status", "attempt", F.round("progress", 6).alias("progress"), _stamp("started_at"), _stamp("finished_at"), "artifact_id", "error_code")


STEPS_SQL = f"""WITH c AS (SELECT user_id || '/' || event_id % 7 AS stage_id, ts AS tm, event_id AS k, {list(STEPS)}[event_id // 7 % 8 + 1] AS kind, CASE WHEN event_id % 11 > 0 THEN value / 50 - 0.5 END AS p FROM events),
t AS (SELECT *, count(*) FILTER (kind = 'start') OVER w AS attempt, max(CASE WHEN kind = 'start' THEN tm END) OVER w AS begun,
  count(*) FILTER (kind IN ('start', 'complete', 'fail', 'wait', 'skip')) OVER w AS g, count(*) FILTER (kind IN ('start', 'complete', 'skip') OR (kind = 'progress' AND p IS NOT NULL)) OVER w AS h, count(*) FILTER (kind IN ('start', 'complete')) OVER w AS a
  FROM c WINDOW w AS (PARTITION BY stage_id ORDER BY tm, k)),
m AS (SELECT stage_id, max(attempt) AS attempt, max(begun) AS begun, max(g) AS g, max(h) AS h, max(a) AS a FROM t GROUP BY stage_id)
SELECT m.stage_id, coalesce(CASE x.kind WHEN 'start' THEN 'running' WHEN 'complete' THEN 'succeeded' WHEN 'fail' THEN 'failed' WHEN 'wait' THEN 'waiting_secret' WHEN 'skip' THEN 'skipped' END, 'pending') AS status, m.attempt,
  round(coalesce(CASE WHEN y.kind = 'start' THEN 0 WHEN y.kind IN ('complete', 'skip') THEN 1 ELSE greatest(0, least(1, y.p)) END, 0), 6) AS progress, strftime(m.begun, '%Y-%m-%d %H:%M:%S') AS started_at,
  CASE WHEN x.kind <> 'start' THEN strftime(x.tm, '%Y-%m-%d %H:%M:%S') END AS finished_at, CASE WHEN z.kind = 'complete' THEN 'a' || z.k END AS artifact_id, CASE x.kind WHEN 'fail' THEN 'e' || x.k % 4 WHEN 'wait' THEN 'secret_required' END AS error_code
FROM m LEFT JOIN t x ON x.stage_id = m.stage_id AND x.g = m.g AND x.kind IN ('start', 'complete', 'fail', 'wait', 'skip') LEFT JOIN t y ON y.stage_id = m.stage_id AND y.h = m.h AND (y.kind IN ('start', 'complete', 'skip') OR (y.kind = 'progress' AND y.p IS NOT NULL))
  LEFT JOIN t z ON z.stage_id = m.stage_id AND z.a = m.a AND z.kind IN ('start', 'complete')"""


def q_item_updates(spark, d):
    e, k = read(spark, d, "events"), F.col("event_id")
    log = e.select(F.col("user_id").alias("job_id"), (k % 3).alias("item_id"), F.col("ts").alias("at"), k.alias("command_id"), F.when(k % 4 == 0, F.col("event_type")).alias("status"), F.when(k % 5 == 0, k % 9).alias("audit_issues"))
    return S.item_states(log, ["job_id", "item_id"], ["status", "audit_issues"])


def q_insert(spark, d):
    n = J.parts(read(spark, d, "orders"))
    held = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.concat(F.lit("i"), F.col("l_linenumber").cast("string")).alias("item_id")).repartition(n, "job_id").distinct()
    made = S.insert_job(jobs(spark, d).select("job_id", "created_at").repartition(n, "job_id"), held.withColumn("ordinal", F.substring("item_id", 2, 9).cast("int")), ocr=False, organize=True, merge=True, mask=True, audit=False)
    # Each table is counted by job before they meet, so that a task holds one row a job and table.
    names = ("jobs", "items", "stages", "events")
    counts = reduce(DataFrame.unionByName, (made[t].groupBy("job_id").agg(F.count(F.lit(1)).alias("n")).withColumn("name", F.lit(t)) for t in names))
    return counts.repartition(n, "job_id").groupBy("job_id").agg(*(F.coalesce(F.sum(F.when(F.col("name") == t, F.col("n"))), F.lit(0)).alias(t) for t in names))


def q_reconcile(spark, d):
    held, parts = S.reconcile(jobs(spark, d), stages(spark, d), "1995-06-17 00:00:00")
    return held.select("job_id", F.lit("").alias("stage_name"), "status").unionByName(parts.select("job_id", "stage_name", "status"))


def artifacts(spark, d):
    l = read(spark, d, "lineitem")
    n = F.col("l_linenumber")
    return l.select(F.col("l_orderkey").alias("job_id"), F.when(n % 3 > 0, F.concat(F.lit("i"), (n % 2).cast("string"))).alias("item_id"), F.when(n % 4 == 1, "mapping").otherwise("text").alias("kind"), F.concat_ws("-", F.col("l_orderkey").cast("string"), n.cast("string"), F.col("l_partkey").cast("string")).alias("artifact_id"), F.col("l_shipdate").alias("created_at"), n.alias("n"), F.col("l_partkey").alias("size_bytes"))


def q_artifacts(spark, d):
    return S.in_order(artifacts(spark, d).select("job_id", "artifact_id", "created_at").distinct(), "job_id", "created_at", "artifact_id").select("job_id", "artifact_id", F.col("place").cast("long").alias("place"))


def q_valid(spark, d):
    # A line's artifact may be shipped on several days: it is one artifact.
    a = artifacts(spark, d).drop("created_at").withColumn("path", F.col("artifact_id")).withColumn("sha256", F.sha2("artifact_id", 256)).distinct()
    files = a.where("n % 5 > 0").select("path", "sha256", F.when(F.col("size_bytes") % 3 == 0, F.col("size_bytes") + 1).otherwise(F.col("size_bytes")).alias("size_bytes"))
    held = a.where("kind = 'text'").select("job_id", "item_id", F.when(F.col("n") % 2 == 0, "mask").otherwise("ocr").alias("stage_name"), F.when(F.col("size_bytes") % 7 == 0, "failed").otherwise("succeeded").alias("status"), "artifact_id")
    return S.valid_stages(held, a, files, password=True).select("job_id", "item_id", "stage_name", "artifact_id")


VALID_SQL = """WITH a AS (SELECT DISTINCT l_orderkey AS job_id, CASE WHEN l_linenumber % 3 > 0 THEN 'i' || l_linenumber % 2 END AS item_id, l_linenumber % 4 = 1 AS mapped, l_orderkey || '-' || l_linenumber || '-' || l_partkey AS artifact_id, l_linenumber AS n, l_partkey AS size FROM lineitem)
SELECT job_id, item_id, CASE WHEN n % 2 = 0 THEN 'mask' ELSE 'ocr' END AS stage_name, artifact_id FROM a WHERE NOT mapped AND size % 7 > 0 AND n % 5 > 0 AND size % 3 > 0
  AND (n % 2 = 1 OR EXISTS (SELECT 1 FROM a b WHERE b.mapped AND b.n % 5 > 0 AND b.job_id = a.job_id AND b.item_id IS NOT DISTINCT FROM a.item_id))"""


def q_lookup(spark, d):
    wanted = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("job_id"))
    return S.lookup(wanted, jobs(spark, d), "job_id").select("job_id", "status")


QUERIES = {
    "job_leases": (q_leases, LEASES_SQL),
    "stage_states": (q_stage_states, STEPS_SQL),
    "item_updates": (q_item_updates, "SELECT user_id AS job_id, event_id % 3 AS item_id, arg_max(event_type, {'t': ts, 'k': event_id}) FILTER (event_id % 4 = 0) AS status, arg_max(event_id % 9, {'t': ts, 'k': event_id}) FILTER (event_id % 5 = 0) AS audit_issues FROM events GROUP BY ALL"),
    "insert_jobs": (
        q_insert,
        f"WITH {ITEMS}, n AS (SELECT job_id, count(DISTINCT item_id) AS items FROM items GROUP BY job_id) SELECT o_orderkey AS job_id, 1 AS jobs, coalesce(items, 0) AS items, CASE WHEN items > 0 THEN 2 * items + 2 ELSE 0 END AS stages, 1 AS events FROM orders LEFT JOIN n ON n.job_id = o_orderkey",
    ),
    "reconcile_leases": (
        q_reconcile,
        f"WITH {JOBS}, {STAGES}, g AS (SELECT job_id FROM jobs WHERE status = 'running' AND coalesce(try_strptime(heartbeat, '%Y-%m-%d %H:%M:%S') < TIMESTAMP '1995-06-17', true)), u AS (SELECT job_id, '' AS stage_name, status FROM jobs UNION ALL SELECT job_id, stage_name, status FROM stages) SELECT job_id, stage_name, CASE WHEN status = 'running' AND job_id IN (FROM g) THEN 'interrupted' ELSE status END AS status FROM u",
    ),
    "artifact_order": (q_artifacts, "SELECT job_id, artifact_id, row_number() OVER (PARTITION BY job_id ORDER BY l_shipdate, artifact_id) AS place FROM (SELECT DISTINCT l_orderkey AS job_id, l_orderkey || '-' || l_linenumber || '-' || l_partkey AS artifact_id, l_shipdate FROM lineitem)"),
    "valid_stages": (q_valid, VALID_SQL),
    "job_lookup": (q_lookup, f"WITH {JOBS} SELECT job_id, status FROM jobs WHERE job_id IN (SELECT l_orderkey FROM lineitem)"),
    "list_jobs": (lambda s, d: J.newest(jobs(s, d), 0, status="failed").select("job_id", "status"), f"WITH {JOBS} SELECT job_id, status FROM jobs WHERE status = 'failed' ORDER BY created_at DESC, job_id DESC LIMIT 1"),
}
