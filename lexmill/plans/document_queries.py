"""Queries of document assembly over documents and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.operators import documents as D

from .job_queries import read

CONFIG = {"entities": {"PERSON": True, "类型": [1, 2]}, "custom": []}


def q_markdown(spark, d):
    k = F.col("doc_id")
    items = read(spark, d, "documents").select(F.col("source").alias("project"), F.lpad(k.cast("string"), 12, "0").alias("path"), F.concat(F.lit(" \n<!-- image -->"), F.coalesce("text", F.lit("")), F.lit("\n\n")).alias("text"), F.when(k % 9 == 0, "failed").otherwise("succeeded").alias("status"))
    return D.merged_markdown(items, status="status").select("project", F.sha2("markdown", 256).alias("sha256"), F.col("n_items").cast("long").alias("n_items"))


MARKDOWN_SQL = r"""WITH i AS (SELECT source AS project, lpad(CAST(doc_id AS VARCHAR), 12, '0') AS path, regexp_replace(coalesce(text, ''), '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g') AS t FROM documents WHERE doc_id % 9 <> 0)
SELECT project, sha256('# document-project-' || left(sha256(project), 12) || chr(10) || chr(10) || string_agg('# ---- document-' || left(sha256(path), 12) || ' ----' || chr(10) || chr(10) || t || chr(10), chr(10) ORDER BY path)) AS sha256, count(*) AS n_items FROM i GROUP BY project"""


def q_log(spark, d):
    k = F.col("event_id")
    records = read(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("time"), F.col("user_id").alias("job_id"), F.col("event_type").alias("event"), F.when(k % 3 == 0, k % 11).alias("count"), F.when(k % 5 == 0, F.lit("e5")).alias("error_code"), F.col("props").alias("text"))
    return D.log_lines(records)


LOG_SQL = """SELECT '{' || CASE WHEN event_id % 3 = 0 THEN '"count":' || event_id % 11 || ',' ELSE '' END || CASE WHEN event_id % 5 = 0 THEN '"error_code":"e5",' ELSE '' END
  || '"event":"' || event_type || '","job_id":' || user_id || ',"time":"' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '"}' AS line FROM events"""

QUERIES = {
    "merged_markdown": (q_markdown, MARKDOWN_SQL),
    "job_log": (q_log, LOG_SQL),
    "mask_job_id": (
        lambda s, d: read(s, d, "documents").select("doc_id", D.mask_job_id(F.col("text"), CONFIG).alias("job_id")),
        """SELECT doc_id, left(sha256(sha256(text) || sha256('{"custom":[],"entities":{"PERSON":true,"类型":[1,2]}}')), 12) AS job_id FROM documents""",
    ),
}
