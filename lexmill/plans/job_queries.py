"""Queries of the job store, document assembly and sources over tables derived from orders, events and lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.operators import jobs as J


def read(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


STATUS = ("running", "succeeded", "failed", "waiting", "cancelled")


def jobs(spark, d):
    o = read(spark, d, "orders")
    status = F.element_at(F.array(*map(F.lit, STATUS)), (F.col("o_orderkey") % 5000 / 5 % 5 + 1).cast("int"))
    beat = F.when(F.col("o_orderkey") % 35 == 0, "unknown").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    return o.select(F.col("o_orderkey").alias("job_id"), status.alias("status"), F.col("o_orderdate").alias("created_at"), beat.alias("heartbeat"))


JOBS = f"""jobs AS (SELECT o_orderkey AS job_id, {list(STATUS)}[CAST(floor(o_orderkey % 5000 / 5) AS BIGINT) % 5 + 1] AS status, o_orderdate AS created_at,
  CASE WHEN o_orderkey % 35 = 0 THEN 'unknown' ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS heartbeat FROM orders)"""


def stages(spark, d, parts=None):
    """The stages; with ``parts`` dealt out by job before they are told apart."""
    l = read(spark, d, "lineitem")
    l = l if parts is None else l.select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_discount").repartition(parts, "l_orderkey")
    item = F.when(F.col("l_linenumber") % 3 == 0, "").otherwise(F.concat(F.lit("item-"), F.col("l_linenumber").cast("string")))
    return l.select(F.col("l_orderkey").alias("job_id"), item.alias("item_id"), F.lower(F.concat(F.lit("stage-"), "l_returnflag", "l_linestatus", F.lit("-"), F.col("l_linenumber").cast("string"))).alias("stage_name"), F.when(F.col("l_returnflag") == "N", "running").otherwise("succeeded").alias("status"), F.round(F.col("l_discount") * 10, 2).alias("progress")).distinct()


STAGES = """stages AS (SELECT DISTINCT l_orderkey AS job_id, CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE 'item-' || l_linenumber END AS item_id, lower('stage-' || l_returnflag || l_linestatus || '-' || l_linenumber) AS stage_name,
  CASE WHEN l_returnflag = 'N' THEN 'running' ELSE 'succeeded' END AS status, round(l_discount * 10, 2) AS progress FROM lineitem)"""


def q_sequence(spark, d):
    return J.with_sequence(read(spark, d, "events"), "user_id", "ts", "event_id").select("event_id", "user_id", F.col("sequence").cast("long").alias("sequence"), F.round("relative_ms", 3).alias("relative_ms"))


def q_order(spark, d):
    return J.ordered_stages(stages(spark, d)).select("job_id", "item_id", "stage_name", F.col("place").cast("long").alias("place"))


def q_snapshot(spark, d):
    held = jobs(spark, d).select("job_id", "status")
    return J.snapshot(held, stages(spark, d, J.parts(held))).select("job_id", "status", "stages", "n_stages", "n_done")


def items(spark, d):
    return read(spark, d, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.concat(F.lit("i"), F.col("l_linenumber").cast("string")).alias("item_id"), F.when(F.col("l_quantity") > 48, "failed").otherwise("done").alias("status"), F.when(F.col("l_tax") > 0.07, 1).otherwise(0).alias("audit_issues")).distinct()


ITEMS = "items AS (SELECT DISTINCT l_orderkey AS job_id, 'i' || l_linenumber AS item_id, CASE WHEN l_quantity > 48 THEN 'failed' ELSE 'done' END AS status, CASE WHEN l_tax > 0.07 THEN 1 ELSE 0 END AS audit_issues FROM lineitem)"


def q_plan(spark, d):
    return J.stage_plan(items(spark, d).select("job_id", "item_id").distinct(), ocr=False, organize=True, merge=True, mask=True, audit=True)


def q_status(spark, d):
    return J.final_status(items(spark, d)).select("job_id", "failed", F.col("issues").cast("long").alias("issues"), "status")


def q_merge(spark, d):
    m = J.merged_texts(read(spark, d, "documents"), "source", "doc_id", "text")
    return m.select("source", "n_parts", F.sha2("merged", 256).alias("sha256"))


def q_resume(spark, d):
    done = read(spark, d, "labels").select("doc_id").distinct()
    return read(spark, d, "documents").join(done, "doc_id", "left_anti").select("doc_id", "source")


def q_rename(spark, d):
    files = read(spark, d, "supplier").select(F.col("s_suppkey").alias("file_id"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("Report"), (F.col("s_suppkey") % 7).cast("string"), F.lit(".md"))).otherwise(F.concat(F.lit("report"), (F.col("s_suppkey") % 7).cast("string"), F.lit(".MD"))).alias("name"))
    return J.rename_plan(files, "name", "file_id").select("file_id", "name", "target", "clashes")


RENAME_SQL = r"""WITH f AS (SELECT s_suppkey AS file_id, CASE WHEN s_suppkey % 2 = 0 THEN 'Report' || s_suppkey % 7 || '.md' ELSE 'report' || s_suppkey % 7 || '.MD' END AS name FROM supplier),
n AS (SELECT *, row_number() OVER (PARTITION BY lower(name) ORDER BY file_id) AS k, count(*) OVER (PARTITION BY lower(name)) AS clashes FROM f)
SELECT file_id, name, CASE WHEN k = 1 THEN name ELSE regexp_replace(name, '\.[^.]*$', '') || '-' || k || regexp_extract(name, '\.[^.]*$') END AS target, clashes FROM n"""


def q_json(spark, d):
    e = read(spark, d, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$.page").alias("page"))


def pages(spark, d):
    l = read(spark, d, "lineitem")
    return l.select(F.col("l_orderkey").alias("doc_id"), (F.col("l_quantity") * 2).cast("int").alias("text_chars"), (F.col("l_discount") * 10).alias("image_area_fraction"))


def q_csv(spark, d):
    n = read(spark, d, "nation")
    return n.select("n_nationkey", F.concat(F.lit("| "), F.concat_ws(" | ", F.col("n_nationkey").cast("string"), "n_name", F.col("n_regionkey").cast("string")), F.lit(" |")).alias("row"))


def q_code(spark, d):
    p = read(spark, d, "pages")
    return p.select("page_id", F.sha2(F.concat(F.lit("```html\n"), "html", F.lit("\n```\n")), 256).alias("sha256"))


def q_split_isolation(spark, d):
    e = read(spark, d, "conversations").select("conv_id", F.when(F.col("turn") % 7 == 6, "dev").otherwise("train").alias("split"))
    return e.groupBy("conv_id").agg(F.count_distinct("split").alias("n")).where("n > 1").select("conv_id")


def q_totals(spark, d):
    e = read(spark, d, "events")
    staged = e.select(F.explode(F.create_map(F.col("event_type"), F.col("value"), F.lit("all"), F.col("value"))).alias("stage", "ms"))
    return staged.groupBy("stage").agg(F.round(F.sum("ms"), 3).alias("total"), F.count(F.lit(1)).alias("n"))


def q_throughput(spark, d):
    c = read(spark, d, "documents")
    return c.groupBy("lang").agg(F.round(F.expr("percentile(n_chars, 0.5)"), 3).alias("median_chars"), F.sum("n_chars").alias("chars"))


def q_html(spark, d):
    from lexmill.sources.html import html_text

    return html_text(read(spark, d, "pages"), "page_id", "html")


QUERIES = {
    "page_ocr": (
        lambda s, d: read(s, d, "part").select("p_partkey", J.page_needs_ocr(F.col("p_size") * 2, F.when(F.col("p_partkey") % 5 > 0, F.col("p_retailprice") - 1000), F.col("p_retailprice") * F.col("p_size") / 10).alias("ocr")),
        "SELECT p_partkey, p_size * 2 < 64 AND p_partkey % 5 > 0 AND greatest(p_retailprice - 1000, 0) / greatest(p_retailprice * p_size / 10, 1) > 0.05 AS ocr FROM part",
    ),
    "event_seq": (
        q_sequence,
        "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence, round(CAST(epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id) AS DOUBLE) / 1000, 3) AS relative_ms FROM events",
    ),
    "stage_order": (q_order, f"WITH {STAGES} SELECT job_id, item_id, stage_name, row_number() OVER (PARTITION BY job_id ORDER BY CASE WHEN item_id = '' THEN 1 ELSE 0 END, item_id, stage_name) AS place FROM stages"),
    "job_progress": (lambda s, d: J.job_progress(stages(s, d)), f"WITH {STAGES} SELECT job_id, round(avg(progress), 4) AS progress FROM stages GROUP BY job_id"),
    "stale_jobs": (
        lambda s, d: J.stale(jobs(s, d), "1995-06-17 00:00:00").select("job_id", "status", "heartbeat"),
        f"WITH {JOBS} SELECT job_id, 'interrupted' AS status, heartbeat FROM jobs WHERE status = 'running' AND (try_strptime(heartbeat, '%Y-%m-%d %H:%M:%S') IS NULL OR try_strptime(heartbeat, '%Y-%m-%d %H:%M:%S') < TIMESTAMP '1995-06-17')",
    ),
    "top_jobs": (lambda s, d: J.newest(jobs(s, d), 700).select("job_id", "status"), f"WITH {JOBS} SELECT job_id, status FROM jobs ORDER BY created_at DESC, job_id DESC LIMIT 500"),
    "job_snapshot": (
        q_snapshot,
        f"WITH {JOBS}, {STAGES}, h AS (SELECT job_id, string_agg(stage_name || ':' || status, ',' ORDER BY CASE WHEN item_id = '' THEN 1 ELSE 0 END, item_id, stage_name) AS stages, count(*) AS n_stages, count(*) FILTER (status = 'succeeded') AS n_done FROM stages GROUP BY job_id) SELECT job_id, status, coalesce(stages, '') AS stages, coalesce(n_stages, 0) AS n_stages, coalesce(n_done, 0) AS n_done FROM jobs LEFT JOIN h USING (job_id)",
    ),
    "stage_plan": (
        q_plan,
        f"WITH {ITEMS}, i AS (SELECT DISTINCT job_id, item_id FROM items) SELECT job_id, item_id, unnest(['input', 'organize']) AS stage_name FROM i UNION ALL SELECT job_id, '' AS item_id, unnest(['merge', 'mask', 'audit']) AS stage_name FROM (SELECT DISTINCT job_id FROM i)",
    ),
    "job_status": (
        q_status,
        f"WITH {ITEMS} SELECT job_id, count(*) FILTER (status = 'failed') AS failed, CAST(sum(audit_issues) AS BIGINT) AS issues, CASE WHEN count(*) FILTER (status = 'failed') > 0 THEN 'partial_failed' WHEN sum(audit_issues) > 0 THEN 'attention' ELSE 'succeeded' END AS status FROM items GROUP BY job_id",
    ),
    "merge_docs": (q_merge, "SELECT source, count(*) AS n_parts, sha256(string_agg(text, chr(10) || chr(10) ORDER BY doc_id)) AS sha256 FROM documents GROUP BY source"),
    "resume_antijoin": (q_resume, "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"),
    "rename_plan": (q_rename, RENAME_SQL),
    "json_lookup": (q_json, "SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.page') AS page FROM events"),
    "pdf_route": (
        lambda s, d: J.page_route(pages(s, d)),
        "SELECT l_orderkey AS doc_id, NOT bool_or(CAST(l_quantity * 2 AS INT) >= 64) AND bool_or(l_discount * 10 >= 0.6) AND avg(CASE WHEN l_discount * 10 >= 0.6 THEN 1.0 ELSE 0.0 END) >= 0.8 AS scan FROM lineitem GROUP BY l_orderkey",
    ),
    "scan_csv_md": (q_csv, "SELECT n_nationkey, '| ' || n_nationkey || ' | ' || n_name || ' | ' || n_regionkey || ' |' AS row FROM nation"),
    "code_wrap": (q_code, "SELECT page_id, sha256('```html' || chr(10) || html || chr(10) || '```' || chr(10)) AS sha256 FROM pages"),
    "split_isolation": (q_split_isolation, "SELECT conv_id FROM (SELECT conv_id, CASE WHEN turn % 7 = 6 THEN 'dev' ELSE 'train' END AS split FROM conversations) GROUP BY conv_id HAVING count(DISTINCT split) > 1"),
    "stage_totals": (q_totals, "SELECT stage, round(sum(value), 3) AS total, count(*) AS n FROM (SELECT unnest([event_type, 'all']) AS stage, value FROM events) GROUP BY stage"),
    "throughput": (q_throughput, "SELECT lang, round(CAST(quantile_cont(n_chars, 0.5) AS DOUBLE), 3) AS median_chars, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY lang"),
    "html_text": (q_html, None),
}
