"""Larger tables are dealt to more tasks."""

from __future__ import annotations

from ringledger.plans import serving
from ringledger.plans.contest import contests

SF = "/root/testdata/sf0.001"


def test_snapshots_are_dealt_to_the_tasks_of_the_log(spark, monkeypatch):
    monkeypatch.setattr(serving, "parts_for", lambda table: 37)
    found = serving._snapshots(spark, SF)
    assert "hashpartitioning(system" in (plan := found._jdf.queryExecution().executedPlan().toString()) and ", 37)" in plan
    key = lambda r: (r["system"], r["contestant"], r["day"], r["rating"], r["rd"])
    assert sorted(map(key, found.collect())) == sorted(map(key, serving.snapshots(contests(spark, SF)).collect()))
