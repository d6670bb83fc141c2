"""Profiles write what they need of the folds, and number the line of ratings once."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ringledger.operators import analytics, folds, profiles
from ringledger.plans.contest import contests, sides
from ringledger.session import cut

SF = "/root/testdata/sf0.001"


def test_the_folds_are_not_written_whole(spark, monkeypatch):
    log, written, numbered = cut(contests(spark, SF)), [], []
    deltas = cut(folds.fold(log))
    for name in ("cut", "stored"):
        monkeypatch.setattr(profiles, name, lambda df, *by, f=getattr(profiles, name, cut): written.append(df.columns) or f(df, *by))
    blocks = analytics.in_blocks
    monkeypatch.setattr(analytics, "in_blocks", lambda *a: numbered.append(1) or blocks(*a))
    profiles.profiles(sides(log), deltas)
    assert not [c for c in written if {"rd", "target", "latent"} & set(c)] and len(numbered) == 1


def test_the_shape_of_a_line_is_that_of_its_parts(spark, monkeypatch):
    day = F.date_add(F.lit("2001-03-01").cast("date"), (F.col("i") * F.col("i") * (1 + F.col("contestant") % 5)).cast("int"))
    line = cut(spark.range(600).select((F.col("id") % 12).alias("contestant"), F.floor(F.col("id") / 12).alias("i")).where("i < contestant * 5 + 1").select("contestant", day.alias("day"), (1400 + F.pmod(F.xxhash64("contestant", "i"), F.lit(500))).cast("double").alias("v")))
    blocks = analytics.in_blocks
    monkeypatch.setattr(analytics, "in_blocks", lambda df, group, order, back, block=4: blocks(df, group, order, back, min(block, 4)))  # many blocks
    found = {r["contestant"]: r.asDict() for r in profiles.line_shape(line, 1650.0).collect()}
    parts = [analytics.rolling_peak(line, "contestant", "v", ("day",)).withColumnRenamed("peak", "peak_three"), analytics.window_peak(line, "contestant", "v", "day").withColumnRenamed("peak", "peak_year"), analytics.capped_area(line, "contestant", "v", "day", 1500.0, 180, 1650.0)]
    wanted = parts[0].join(parts[1], "contestant").join(parts[2], "contestant").collect()
    assert found.keys() == {r["contestant"] for r in wanted} - {0}  # contestant 0 has one point
    for r in wanted:
        if r["contestant"]:
            assert found[r["contestant"]] == pytest.approx(r.asDict(), abs=1e-9)
