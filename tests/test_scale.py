"""What keeps large tables within bounds: rows are dealt out, nothing is exploded that need not be, and results stay the same."""

from datetime import datetime

from lexmill.functions import px
from lexmill.operators import labels, normalize, recognize
from lexmill.plans import job_queries, store_queries, zh_queries
from pyspark.sql import functions as F


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_valid_stages_takes_an_artifact_shipped_twice_once(spark, tmp_path):
    day = datetime(1995, 1, 1)
    lines = [(1, 1, 14008, day), (1, 1, 14008, day.replace(day=2)), (1, 2, 7, day)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(2, 7, 5002, day), (2, 7, 5002, day.replace(day=3))], "l_orderkey long, l_linenumber int, l_partkey long, l_shipdate timestamp").write.mode("append").parquet(f"{tmp_path}/lineitem.parquet")
    assert [tuple(r) for r in store_queries.q_valid(spark, str(tmp_path)).collect()] == [(2, "i1", "ocr", "2-7-5002")]


def test_organize_is_local_to_a_row(spark):
    rows = [(1, "```\n a \n```\n|  x |\n\n\n\n\nb  c\n"), (1, "中 文 ,"), (2, "<!-- image -->"), (3, "　第 2 页\x85\n\n\x0b\n\nz"), (4, None), (5, "\n```")]
    made = normalize.organize(spark.createDataFrame(rows, "doc_id long, text string"), 1)
    assert "Exchange" not in plan(made)
    want = [(1, "```\n a\n```\n|x|\n\nb c\n"), (1, "中文,\n"), (2, ""), (3, "---\n\nz\n"), (5, "```\n")]
    assert sorted(map(tuple, made.collect())) == sorted(want)


def test_labels_are_not_exploded(spark):
    rows = [(1, ["I-A", "O", "B-A", "I-B", "I-A", None, "I-A", "U-C", "O", "L-C"]), (1, ["B-A", "B-A"]), (2, []), (3, None)]
    made = labels.labels_to_spans(spark.createDataFrame(rows, "doc_id long, labels array<string>"))
    assert "Exchange" not in plan(made) and "posexplode" not in plan(made)
    want = [(1, 0, 1, "A"), (1, 2, 7, "A"), (1, 3, 4, "B"), (1, 7, 8, "C"), (1, 9, 10, "C"), (1, 0, 1, "A"), (1, 1, 2, "A")]
    assert sorted((r.doc_id, r.start, r.end, r.label) for r in made.collect()) == sorted(want)


def test_a_small_dictionary_leaves_texts_where_they_are(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "甲乙丙丁"), (2, "乙丙乙丙"), (None, "丙")], "doc_id long, text string")
    names = spark.createDataFrame([(w,) for w in ("甲乙", "乙丙", "丙", "乙丙丁", "乙丙")], "name string")
    want = [(1, 0, 2, "甲乙"), (1, 1, 3, "乙丙"), (1, 1, 4, "乙丙丁"), (2, 0, 2, "乙丙"), (2, 2, 4, "乙丙")]
    small = recognize.dictionary_spans(docs, names)
    assert sorted(map(tuple, small.collect())) == want and "BroadcastHashJoin" in plan(small) and "SortMergeJoin" not in plan(small)
    monkeypatch.setattr(recognize, "FEW_NAMES", 2)
    assert sorted(map(tuple, recognize.dictionary_spans(docs, names).collect())) == want


def test_jobs_are_dealt_out_by_their_number(spark, tmp_path, monkeypatch):
    day = datetime(1995, 1, 1)
    spark.createDataFrame([(i, day) for i in range(40)], "o_orderkey long, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(i, n, "N", "O", 0.01, 1) for i in range(39) for n in (1, 2, 2)], "l_orderkey long, l_linenumber int, l_returnflag string, l_linestatus string, l_discount double, l_quantity int").write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(job_queries.J.parts, "__defaults__", (5,))
    made = store_queries.q_insert(spark, str(tmp_path))
    assert {tuple(r) for r in made.collect()} == {(i, 1, 2, 6, 1) for i in range(39)} | {(39, 1, 0, 0, 1)}
    assert "hashpartitioning(job_id" in plan(made) and ", 8)" in plan(made)
    held = job_queries.q_snapshot(spark, str(tmp_path))
    assert {(r.job_id, r.stages, r.n_stages) for r in held.collect()} == {(i, "stage-no-1:running,stage-no-2:running", 2) for i in range(39)} | {(39, "", 0)}
    assert "Window" not in plan(held) and ", 8)" in plan(held)


def test_texts_of_customers_are_dealt_out(spark, tmp_path):
    spark.range(12_000).withColumnRenamed("id", "c_custkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    for made in (zh_queries.zh_docs, zh_queries.zh_people, zh_queries.zh_parties, zh_queries.leaky):
        assert made(spark, str(tmp_path)).rdd.getNumPartitions() == 3
    assert zh_queries.customers(spark, str(tmp_path)).distinct().count() == 12_000


def test_positions_compile_no_pattern_for_a_row(spark):
    df = spark.createDataFrame([("a1b22\u0001c3",), ("x7",), ("",)], "t string")
    got = df.select("t", px.positions(F.col("t"), "[0-9]+").alias("p"), px.literal_positions(F.col("t"), F.lit("b2")).alias("w")).collect()
    assert {r.t: [(x.start, x.surface) for x in r.p] for r in got} == {"a1b22\u0001c3": [(1, "1"), (3, "22"), (7, "3")], "x7": [(1, "7")], "": []}
    assert [[x.start for x in r.w] for r in got] == [[2], [], []]
    assert "split(regexp_replace(" in plan(df.select(px.positions(F.col("t"), "[0-9]+")))
