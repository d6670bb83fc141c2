"""Slices cost one numbering of the log and stay closed until they are read; components are found from far fewer rows than contests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ringledger.operators import folds
from ringledger.plans.contest import contests
from ringledger.session import cut

SF = "/root/testdata/sf0.001"


def test_a_component_has_no_more_slices_than_it_needs(spark):
    rows = cut(folds.numbers(folds.prepared(contests(spark, SF))))
    n = rows.count()
    bound = n // 3 + 1  # halves of halves made four
    parts = folds.sliced(rows, bound)
    assert {r["slice"] for r in parts.select("slice").distinct().collect()} == {0, 1, 2} and parts.count() == n
    spans = parts.withColumn("at", folds.order_of(parts)).groupBy("slice").agg(F.min("at").alias("low"), F.max("at").alias("high")).orderBy("slice").collect()
    assert all(x["high"] < y["low"] for x, y in zip(spans, spans[1:], strict=False))


def test_components_are_found_from_a_row_a_contestant_and_task(spark, monkeypatch):
    rows = cut(spark.range(20_000).select(F.col("id").alias("contest_id"), (F.col("id") % 40).alias("a"), (F.col("id") % 40 + 40 * (1 + F.col("id") % 3)).alias("b")).repartition(4))
    seen, components = [], folds.components
    monkeypatch.setattr(folds, "components", lambda edges, *names: seen.append(edges.count()) or components(edges, *names))
    found = folds.labelled(rows)
    assert found.count() == 20_000 and found.where("component != a").isEmpty() and max(seen) <= 4 * 160


def test_slices_write_packs_and_not_rows(spark):
    log = contests(spark, SF)
    found = folds.fold(log, ("elo",), bound=400)
    folder = found.inputFiles()[0].rsplit("/slice=", 1)[0]
    packs = spark.read.parquet(folder)
    assert packs.columns == ["task", "number", "system", "kept", "rows", "slice"] and packs.where("not kept").count() < found.count() / 10
    key = lambda r: (r["contest_id"], r["contestant"])
    whole = {key(r): r for r in folds.fold(log, ("elo",)).collect()}
    rows = found.collect()
    assert len(rows) == len(whole) and all(r == whole[key(r)] for r in rows)
