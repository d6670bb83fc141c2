"""Components of pairs are not sliced before the bound of folds."""

from __future__ import annotations

from ringledger.operators import folds, joins


def test_pairs_of_a_component_are_sliced_by_the_bound_of_folds(spark, monkeypatch):
    pairs = spark.range(300).selectExpr("id % 23 l", "id % 31 r", "id * 7919 % 101 w")
    wanted = {(r["l"], r["r"]) for r in joins.greedy_match(pairs, "l", "r", "w").collect()}
    bounds, sliced = [], folds.sliced
    monkeypatch.setattr(folds, "sliced", lambda rows, bound, depth=0: bounds.append(bound) or sliced(rows, bound, depth))
    assert {(r["l"], r["r"]) for r in joins.greedy_match(pairs, "l", "r", "w", one_task=20).collect()} == wanted and not bounds
    assert {(r["l"], r["r"]) for r in joins.greedy_match(pairs, "l", "r", "w", one_task=20, bound=100).collect()} == wanted and bounds == [100]
