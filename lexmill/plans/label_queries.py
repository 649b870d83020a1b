"""Queries of sequence labels, chunks, splits and metrics over spans derived from ``lineitem`` and ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.operators import labels as L


def read(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def spans(spark, d):
    """Disjoint spans of made-up documents: line k of an order spans 10k to 10k + quantity % 7."""
    l = read(spark, d, "lineitem").where("CAST(l_quantity AS INT) % 7 > 0")
    start = F.col("l_linenumber") * 10
    return l.groupBy(F.col("l_orderkey").alias("doc_id"), start.alias("start")).agg(F.max(start + F.col("l_quantity").cast("int") % 7).alias("end"), F.min("l_returnflag").alias("label"))


SPANS = 'spans AS (SELECT l_orderkey AS doc_id, l_linenumber * 10 AS start, max(l_linenumber * 10 + CAST(l_quantity AS INT) % 7) AS "end", min(l_returnflag) AS label FROM lineitem WHERE CAST(l_quantity AS INT) % 7 > 0 GROUP BY ALL)'


def labelled(spark, d, scheme):
    per = spans(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "label"))).alias("spans"))
    return per.select("doc_id", "spans", L.spans_to_labels(F.lit(85), "spans", scheme).alias("labels"))


def q_labels(scheme):
    return lambda spark, d: labelled(spark, d, scheme).select("doc_id", F.array_join("labels", " ").alias("labels"))


def _labels_join_sql(single, last):
    return f"""WITH {SPANS}, p AS (SELECT doc_id, unnest(range(0, 85)) AS i FROM (SELECT DISTINCT doc_id FROM spans)),
j AS (SELECT p.doc_id, p.i, s.start, s."end", s.label FROM p LEFT JOIN spans s ON s.doc_id = p.doc_id AND s.start <= p.i AND p.i < s."end")
SELECT doc_id, string_agg(CASE WHEN label IS NULL THEN 'O' WHEN "end" - start = 1 THEN '{single}-' || label WHEN i = start THEN 'B-' || label WHEN i = "end" - 1 THEN '{last}-' || label ELSE 'I-' || label END, ' ' ORDER BY i) AS labels FROM j GROUP BY doc_id"""


def predicted(spark, d):
    """Spans that miss some and add others."""
    s = spans(spark, d)
    kept = s.where("(doc_id + start) % 7 <> 0")
    return kept.withColumn("end", F.when((F.col("doc_id") + F.col("start")) % 11 == 0, F.col("end") + 1).otherwise(F.col("end")))


PREDICTED = f'{SPANS}, predicted AS (SELECT doc_id, start, CASE WHEN (doc_id + start) % 11 = 0 THEN "end" + 1 ELSE "end" END AS "end", label FROM spans WHERE (doc_id + start) % 7 <> 0)'
KEYS = ["doc_id", "start", "end", "label"]
COUNTS = f"""{PREDICTED}, f AS (SELECT label, doc_id % 3 AS part, e.doc_id IS NOT NULL AS x, p.doc_id IS NOT NULL AS y FROM (SELECT *, 1 AS u FROM spans) e FULL JOIN predicted p USING (doc_id, start, "end", label)),
c AS (SELECT label, count(*) FILTER (x AND y) AS tp, count(*) FILTER (y AND NOT x) AS fp, count(*) FILTER (x AND NOT y) AS fn FROM f GROUP BY label)"""


def counts(spark, d, by):
    e, p = (x.withColumn("part", F.col("doc_id") % 3) for x in (spans(spark, d), predicted(spark, d)))
    return L.exact_metrics(e, p, [*KEYS, "part"], [by])


def _report_sql(by):
    rate = lambda a, b: f"round(coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0), 0), 6)"
    return f"""WITH {COUNTS}, r AS (SELECT coalesce({by}, 'overall') AS {by}, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM c GROUP BY ROLLUP ({by}))
SELECT *, {rate("tp", "tp + fp")} AS precision, {rate("tp", "tp + fn")} AS recall, {rate("2 * tp", "2 * tp + fp + fn")} AS f1, {rate("fn", "tp + fn")} AS miss_rate, {rate("fp", "tp + fp")} AS false_rate FROM r"""


def q_chunks(spark, d):
    return L.chunks(read(spark, d, "documents"), 800, 100).select("doc_id", "chunk", "start", F.col("end").cast("long").alias("end"))


CHUNKS = """chunks AS (SELECT doc_id, c AS chunk, c * 700 AS start, least(c * 700 + 800, length(text)) AS "end" FROM (SELECT doc_id, text, unnest(range(0, CAST(greatest(ceil((length(text) - 800) / 700.0), 0) AS BIGINT) + 1)) AS c FROM documents WHERE length(text) > 0))"""


def q_owner(spark, d):
    w = L.chunks(read(spark, d, "documents"), 800, 100)
    s = w.select("doc_id", (F.col("start") + 690).alias("start")).withColumn("end", F.col("start") + 40)
    return L.window_owners(s, w)


def q_split(spark, d):
    return L.grouped_split(read(spark, d, "customer"), "c_nationkey", {"train": 0.8, "dev": 0.1, "test": 0.1})


def q_summary(spark, d):
    return spans(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n_spans"), F.count_distinct("doc_id").alias("n_documents"), F.sum(F.col("end") - F.col("start")).alias("n_chars"))


def q_tags(spark, d):
    tagged = F.regexp_replace("text", "(?<![A-Za-z])the(?![A-Za-z])", "<DET>the</DET>")
    return read(spark, d, "documents").select("doc_id", (L.parse_tags(tagged) == F.col("text")).alias("same"))


def q_label_map(spark, d):
    known = F.create_map(*map(F.lit, ("A", "ADDRESS", "N", "ORG", "R", "PERSON")))
    return spans(spark, d).groupBy(F.element_at(known, F.col("label")).alias("entity_type")).agg(F.count(F.lit(1)).alias("n"))


def q_grammar(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    made = F.concat(F.substring(F.lit("BILOUESXO"), (F.col("o_orderkey") % 9 + 1).cast("int"), F.lit(1)), F.when(F.col("o_orderkey") % 4 > 0, F.concat(F.lit("-"), F.regexp_replace("o_orderpriority", "^[1-3]-", ""))).otherwise(""))
    return o.select("o_orderkey", L.label_parts(made, strict=False).alias("_p")).select("o_orderkey", "_p.prefix", "_p.entity")


GRAMMAR_SQL = """WITH m AS (SELECT o_orderkey, substr('BILOUESXO', o_orderkey % 9 + 1, 1) || CASE WHEN o_orderkey % 4 > 0 THEN '-' || regexp_replace(o_orderpriority, '^[1-3]-', '') ELSE '' END AS l FROM orders)
SELECT o_orderkey, CASE WHEN ok THEN left(l, 1) END AS prefix, CASE WHEN ok AND l <> 'O' THEN substr(l, 3) END AS entity FROM (SELECT *, regexp_full_match(l, 'O|[BILUES]-[A-Za-z][A-Za-z0-9_.:-]*') AS ok FROM m)"""


QUERIES = {
    "label_grammar": (q_grammar, GRAMMAR_SQL),
    "spans_to_labels": (q_labels("BIO"), _labels_join_sql("B", "I")),
    "spans_to_labels_bioes": (q_labels("BIOES"), _labels_join_sql("S", "E")),
    "spans_to_labels_bilou": (q_labels("BILOU"), _labels_join_sql("U", "L")),
    "labels_to_spans": (lambda s, d: L.labels_to_spans(labelled(s, d, "BILOU")), f'WITH {SPANS} SELECT doc_id, start, "end", label FROM spans'),
    "exact_metrics": (lambda s, d: counts(s, d, "label"), f"WITH {COUNTS} SELECT label, tp, fp, fn FROM c"),
    "metrics_rollup": (lambda s, d: L.metrics_report(counts(s, d, "label"), "label"), _report_sql("label")),
    "subset_metrics": (lambda s, d: counts(s, d, "part"), f"WITH {COUNTS} SELECT part, count(*) FILTER (x AND y) AS tp, count(*) FILTER (y AND NOT x) AS fp, count(*) FILTER (x AND NOT y) AS fn FROM f GROUP BY part"),
    "chunk_text": (q_chunks, f"WITH {CHUNKS} SELECT * FROM chunks"),
    "window_owner": (q_owner, f'WITH {CHUNKS}, s AS (SELECT doc_id, start + 690 AS start, start + 730 AS "end" FROM chunks) SELECT s.doc_id, s.start, s."end", min(c.chunk) AS owner FROM s JOIN chunks c ON c.doc_id = s.doc_id AND c.start <= s.start AND s."end" <= c."end" GROUP BY ALL'),
    "doc_split": (q_split, "WITH g AS (SELECT c_nationkey, row_number() OVER (ORDER BY c_nationkey) AS n, count(*) OVER () AS t FROM (SELECT DISTINCT c_nationkey FROM customer)) SELECT c_nationkey, CASE WHEN n <= 20 THEN 'train' WHEN n <= 23 THEN 'dev' ELSE 'test' END AS split FROM g"),
    "dataset_summary": (q_summary, f'WITH {SPANS} SELECT label, count(*) AS n_spans, count(DISTINCT doc_id) AS n_documents, CAST(sum("end" - start) AS BIGINT) AS n_chars FROM spans GROUP BY label'),
    "tag_parse": (q_tags, "SELECT doc_id, true AS same FROM documents"),
    "label_map": (q_label_map, f"WITH {SPANS} SELECT CASE label WHEN 'A' THEN 'ADDRESS' WHEN 'N' THEN 'ORG' ELSE 'PERSON' END AS entity_type, count(*) AS n FROM spans GROUP BY ALL"),
}
