"""Stores whose tables change together, ratings in loads with late contests, replacement of one system's rows."""

import json

import pytest
from pyspark.sql import functions as F

from ringledger.operators import folds, loads
from ringledger.plans.contest import contests, sides
from ringledger.session import cut
from ringledger.sources.store import Store

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def log(spark):
    return cut(contests(spark, SF))


def test_drafts_take_effect_as_a_whole(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.manifest()["version"] == 0 and store.read("t") is None
    draft = store.begin()
    draft.put("t", "x", spark.range(3))
    draft.put("u", "x", spark.range(5))
    assert store.read("t") is None
    assert draft.commit() == 1 and store.read("t").count() == 3
    with pytest.raises(Exception, match="(?i)divide|zero"):
        failed = store.begin()
        failed.put("t", "x", spark.range(100))
        failed.put("u", "x", spark.range(10).selectExpr("assert_true(id < 5, 'divide') is null x", "id"))
        failed.commit()
    assert (store.read("t").count(), store.read("u").count(), store.manifest()["version"]) == (3, 5, 1)
    one, two = store.begin(), store.begin()
    one.put("t", "y", spark.range(10, 12))
    two.drop("t")
    one.commit()
    with pytest.raises(RuntimeError, match="version 2"):
        two.commit()
    assert sorted(r["id"] for r in store.read("t").collect()) == [0, 1, 2, 10, 11] and store.read("t", ["y"]).count() == 2
    three = store.begin()
    three.drop("t", "x")
    three.commit()
    assert store.read("t").count() == 2 and store.read("t", version=1).count() == 3
    store.clean(keep=1)
    assert store.read("t").count() == 2 and store.read("u").count() == 5 and store._versions() == [3]
    assert len([p for p in (tmp_path / "s").iterdir() if p.name.startswith("parts-")]) == 2


def test_loads_equal_the_fold_of_the_whole_log(spark, log, tmp_path):
    """Three loads; the last has late contests, also such on days that are known, and some that are there already."""
    store, systems = Store(spark, str(tmp_path / "s")), ("elo", "unified")
    days = [r["day"] for r in log.select("day").distinct().orderBy("day").collect()]
    one, two = days[len(days) // 2], days[3 * len(days) // 4]
    late = (F.col("contest_id") % 7 == 0) & (F.col("day") > days[5 * len(days) // 8])
    assert loads.load_contests(store, log.where((F.col("day") <= one) & ~late), systems) == 1
    assert loads.load_contests(store, log.where((F.col("day") > one) & (F.col("day") <= two) & ~late), systems) == 2
    first = store.manifest()
    assert loads.load_contests(store, log.where(late | (F.col("day") > two) | (F.col("contest_id") % 5 == 0)), systems) == 3
    assert loads.load_contests(store, log, systems) == 3  # nothing new
    now = store.manifest()
    assert "00000001" in now["tables"]["deltas"] and now["tables"]["deltas"]["00000001"] == first["tables"]["deltas"]["00000001"] and "00000002" not in now["tables"]["deltas"]
    whole, states = folds.fold_on(log, systems)
    key = lambda r: (r["system"], r["contest_id"], r["contestant"])
    wanted, found = ({key(r): r.asDict() for r in df.collect()} for df in (whole, store.read("deltas")))
    assert wanted.keys() == found.keys() and store.read("contests").count() == log.count()
    for k, row in wanted.items():
        assert found[k] == pytest.approx(row, abs=1e-9, nan_ok=True)
    ends = {(r["system"], r["contestant"]): r["state"] for r in states.collect()}
    kept = {(r["system"], r["contestant"]): r["state"] for r in store.read("states", [max(now["tables"]["states"])]).collect()}
    assert ends.keys() == kept.keys() and all(kept[k] == pytest.approx(v, abs=1e-9, nan_ok=True) for k, v in ends.items())


def test_profiles_replace_their_own_snapshots_only(spark, log, tmp_path):
    store, deltas = Store(spark, str(tmp_path / "s")), cut(folds.fold(log))
    draft = store.begin()
    elo = loads.system_id(draft, "elo", "1", "Elo", {"k": 24})
    assert loads.system_id(draft, "elo", "1", "other words", {}) == elo
    loads.replace_system(draft, "elo", loads.rating_snapshots(deltas, "elo", elo))
    draft.commit()
    before = store.read("snapshots").count()
    rows = []
    for _ in range(2):
        loads.store_profiles(store, sides(log), deltas)
        assert store.read("systems").count() == 2 and store.read("snapshots", ["elo"]).count() == before
        rows.append(sorted(map(tuple, store.read("snapshots", ["goat"]).collect())))
    assert rows[0] == rows[1] and len({r[0] for r in rows[0]}) == 1 and rows[0][0][0] != elo
    _, who, day, rating, rd, extra = rows[0][0]
    record, mine = json.loads(extra), [r for r in sides(log.where("sport = 'mma'")).collect() if r["contestant"] == who]
    assert set(record) == {*loads.RECORD, "composite_score"} and rd is None and day == log.agg(F.max("day")).first()[0]
    assert record["record"] == {k: sum(r["result"] == v for r in mine) for k, v in (("wins", "W"), ("losses", "L"), ("draws", "D"), ("nc", "NC"))} | {
        "finish_wins": sum(r["result"] == "W" and r["method"] in ("KO", "TKO", "SUB") for r in mine), "decision_wins": sum(r["result"] == "W" and r["method"] == "DEC" for r in mine)}
    assert rating == pytest.approx(record["composite_score"], abs=6e-5) and {"raw", "z", "peak_dynamic"} <= set(record["peak"])
