"""The job queries against plain Python over all orders."""

from collections import Counter
from datetime import datetime

from lexmill.plans import job_queries as Q


def expected(orders):
    for key, date in orders:
        yield key, Q.STATUS[key % 5000 // 5 % 5], date, "unknown" if key % 35 == 0 else date.strftime("%Y-%m-%d %H:%M:%S")


def test_every_order_is_a_job(spark, tmp_path):
    orders = [(i, datetime(1992 + i % 7, 1 + i % 12, 1 + i % 28)) for i in range(1, 1201)]
    lines = [(i, 1 + i % 7, "NRA"[i % 3], "OF"[i % 2], 0.05) for i in range(1, 1201, 2)]
    spark.createDataFrame(orders, "o_orderkey long, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_returnflag string, l_linestatus string, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    run = lambda name: Q.QUERIES[name][0](spark, str(tmp_path)).collect()
    jobs = list(expected(orders))
    stale = {(k, b) for k, s, _, b in jobs if s == "running" and (b == "unknown" or b < "1995-06-17")}
    assert {(r.job_id, r.heartbeat) for r in run("stale_jobs")} == stale
    newest = sorted(jobs, key=lambda j: (j[2], j[0]), reverse=True)
    got = run("top_jobs")
    assert [(r.job_id, r.status) for r in got] == [j[:2] for j in newest[: len(got)]] and len(got) >= 500
    per = Counter(k for k, *_ in lines)
    assert {(r.job_id, r.status, r.n_stages) for r in run("job_snapshot")} == {(k, s, per[k]) for k, s, _, _ in jobs}
