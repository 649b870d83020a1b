"""The job store's views on a few logs whose outcome is known."""

import pytest

from lexmill.operators import job_store as S

LOG = "job_id long, at timestamp, command_id long, kind string, owner string, status string, clear_lease boolean"


def commands(spark, rows):
    from datetime import datetime

    return spark.createDataFrame([(j, datetime(2024, 1, 1, 0, t), n, k, o, s, f) for n, (j, t, k, o, s, f) in enumerate(rows)], LOG)


def test_leases(spark):
    rows = [
        (1, 1, "claim", "a", None, None), (1, 2, "claim", "b", None, None), (1, 3, "heartbeat", "b", None, None), (1, 4, "resume", "a", None, None), (1, 5, "status", None, "succeeded", True), (1, 6, "claim", "b", None, None),
        (2, 1, "cancel", None, None, None), (2, 2, "claim", "a", None, None), (2, 3, None, None, None, None),
        (3, 1, "status", None, "failed", None), (3, 2, "resume", None, None, None), (3, 3, "claim", "c", None, None),
    ]
    got = {r.job_id: r for r in S.job_states(commands(spark, rows)).collect()}
    one, two, three = got[1], got[2], got[3]
    assert (one.status, one.lease_owner, one.refused, one.resume_count, one.heartbeat_at, one.finished_at.minute) == ("succeeded", None, 1, 1, None, 5)
    assert (two.status, two.cancel_requested, two.refused) == ("cancel_requested", True, 1)
    assert (three.status, three.lease_owner, three.resume_count, three.started_at.minute, three.finished_at.minute) == ("running", "c", 1, 2, 1)
    assert S.job_states(commands(spark, [])).count() == 0


def test_insert_lookup_and_append(spark, tmp_path):
    jobs = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02")], "job_id long, created_at string")
    made = S.insert_job(jobs, spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "job_id long, item_id string, ordinal int"), ocr=True, organize=False, merge=False, mask=True, audit=True)
    assert {(r.item_id, r.stage_name) for r in made["stages"].collect()} == {(i, s) for i in "xy" for s in ("ocr", "mask", "audit")}
    for _ in range(2):
        S.append(made["events"], f"{tmp_path}/events")
    assert spark.read.parquet(f"{tmp_path}/events").count() == 4
    assert [r.job_id for r in S.lookup(jobs.where("job_id = 2"), jobs, "job_id").collect()] == [2]
    wanted = spark.createDataFrame([(2,), (3,)], "job_id long")
    assert S.lookup(wanted, jobs, "job_id", strict=False).count() == 1
    with pytest.raises(Exception, match="no such job_id: 3"):
        S.lookup(wanted, jobs, "job_id").collect()
