"""Permissions through roles and the log of decisions, on small fixtures."""

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import permissions as P
from tallyspark.sources import store as S


def tables(spark):
    df = spark.createDataFrame
    user_roles = df([(1, 10), (1, 10), (1, 11), (2, 12), (3, 13), (None, 10), (4, None)], "user_id long, role_id long")
    roles = df([(10, True), (11, True), (12, False), (13, None), (14, True)], "role_id long, is_active boolean")
    role_permissions = df([(10, 100), (10, 101), (11, 100), (12, 100), (13, 100), (14, 102), (10, 999), (None, 100)], "role_id long, permission_id long")
    permissions = df([(100, "report.view", True), (101, "report.edit", False), (102, "report.send", True), (103, None, True)], "permission_id long, code string, is_active boolean")
    return user_roles, roles, role_permissions, permissions


def test_only_active_roles_and_permissions_count(spark):
    rows = sorted(((r.user_id, r.permission_code) for r in P.held(*tables(spark)).collect()), key=repr)
    assert rows == [(1, "report.view"), (None, "report.view")]


def test_without_rows(spark):
    assert P.held(*(t.limit(0) for t in tables(spark))).count() == 0


def decided(spark):
    asked = spark.createDataFrame(
        [(1, 1, "report.view", "2024-01-01"), (2, 1, "report.edit", "2024-01-01"), (3, 2, "report.view", "2024-01-02"), (4, None, "report.view", "2024-01-02"), (5, 1, None, "2024-01-02")],
        "request_id long, user_id long, permission_code string, day string",
    )
    return P.authorized(asked, P.held(*tables(spark)))


def test_one_decision_a_request(spark):
    rows = {r.request_id: (r.access_granted, r.reason) for r in decided(spark).collect()}
    no = (False, P.MISSING)
    assert rows == {1: (True, P.GRANTED), 2: no, 3: no, 4: no, 5: no}


def logged(spark, log):
    return sorted((r.request_id, r.user_id, r.access_granted) for r in S.read(spark, log).filter("user_id is not null").collect())


def test_the_log_only_grows_and_holds_a_request_once(spark, tmp_path):
    log = P.audit_log(f"file://{tmp_path}/log")
    P.record(spark, log, decided(spark).filter("request_id < 3"), "check")
    first = {f: f.read_bytes() for f in (tmp_path / "log").rglob("*.parquet")}
    assert logged(spark, log) == [(1, 1, True), (2, 1, False)]
    # again, with more: what a call that broke off left is not added twice, nor changed by a later decision
    later = decided(spark).withColumn("access_granted", F.lit(False))
    P.record(spark, log, later.unionByName(later), "check")
    assert logged(spark, log) == [(1, 1, True), (2, 1, False), (3, 2, False), (5, 1, False)]
    assert S.read(spark, log).count() == 5
    assert all(f.read_bytes() == was for f, was in first.items())
    P.record(spark, log, decided(spark).limit(0), "check")
    assert S.read(spark, log).count() == 5


def test_a_request_without_an_id_or_day_is_an_error(spark, tmp_path):
    for name in ("request_id", "day"):
        log = P.audit_log(f"file://{tmp_path}/{name}")
        with pytest.raises(Exception, match=f"has no {name}"):
            P.record(spark, log, decided(spark).withColumn(name, F.lit(None).cast(decided(spark).schema[name].dataType)), "check")


def test_a_broken_batch_leaves_the_log(spark, tmp_path):
    log = P.audit_log(f"file://{tmp_path}/log")
    P.record(spark, log, decided(spark).filter("request_id = 1"), "check")
    broken = decided(spark).withColumn("reason", F.when(F.col("request_id") == 3, F.raise_error(F.lit("broken"))).otherwise(F.col("reason")))
    with pytest.raises(Exception, match="broken"):
        P.record(spark, log, broken, "check")
    assert logged(spark, log) == [(1, 1, True)]
    P.record(spark, log, decided(spark), "check")
    assert S.read(spark, log).count() == 5
