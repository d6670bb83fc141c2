"""Every registered query of the ratings side against its SQL, and what SQL cannot express against plain code."""

import datetime
import math

import duckdb
import pandas as pd
import pytest

from ringledger.operators import folds
from ringledger.plans import catalogue
from ringledger.plans.contest import contests
from ringledger.sources import exports
from ringledger.streaming import activity

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events pages".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def cell(v) -> str:
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return "null"
    v = v.item() if hasattr(v, "item") else v
    if isinstance(v, datetime.date):
        return str(v)[:10]
    return str(v) if isinstance(v, (bool, str)) else f"{float(v):.6g}" if isinstance(v, (int, float)) else str(v)


def rows(frame: pd.DataFrame) -> list[tuple]:
    return sorted(tuple(map(cell, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, duck, name):
    mine, theirs = catalogue.QUERIES[name](spark, SF).toPandas(), duck.execute(catalogue.ORACLES[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)


def test_elo_fold_equals_a_plain_loop(spark):
    log = contests(spark, SF)
    ready = sorted(folds.prepared(log).collect(), key=lambda r: (r["day"], r["contest_id"]))
    rating, fights, last, expected = {}, {}, {}, {}
    for c in ready:
        a, b = c["a"], c["b"]
        x, y = rating.get(a, 1500.0), rating.get(b, 1500.0)
        if c["sport"] != "mma" or c["outcome"] in ("NC", "D"):
            continue
        e = 1 / (1 + math.exp(-(x - y) / 400))
        t = min(1, max(c["base"], 0.5, e + 0.01)) if c["outcome"] == "W" else max(0, min(c["base"], 0.5, e - 0.01))
        for who, change in ((a, t - e), (b, e - t)):
            n, before = fights.get(who, 0), last.get(who)
            career = (1.15 if n < 5 else 1 if n < 12 else 0.92) * (0.9 if before and (c["day"] - before).days > 540 else 1.03)
            rating[who] = rating.get(who, 1500.0) + c["k"] * career * change
            fights[who], last[who] = n + 1, c["day"]
            expected[who, c["contest_id"]] = rating[who]
    found = {(r["contestant"], r["contest_id"]): r["post_rating"] for r in folds.fold(log, ("elo",)).where("k != 0").collect()}
    assert found.keys() == expected.keys()
    assert all(found[k] == pytest.approx(v, abs=1e-9) for k, v in expected.items())


def test_profiles_and_ratings_are_whole(spark):
    found = catalogue.QUERIES["alltime_profiles"](spark, SF).toPandas()
    assert found["contestant"].is_unique and found["score"].notna().all()
    assert sorted(found["place"]) == list(range(1, len(found) + 1)) and found.sort_values("place")["score"].is_monotonic_decreasing
    rank = catalogue.QUERIES["pagerank"](spark, SF).toPandas()
    assert rank["rank"].sum() == pytest.approx(1, abs=1e-4)


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    stream = activity.windowed_counts(spark.readStream.schema(events.schema).parquet(f"{SF}/events.parque[t]"))
    run = stream.writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, activity.windowed_counts(events).collect()))


def test_exports(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,url,name\n0123456789ABCDEF,,"  A ""b"" "\n,http://x/f/00000000000000aa,\n')
    found = exports.with_resolved_ids(exports.read_export(spark, str(tmp_path / "a.csv"), ["id", "url", "name", "missing"]), "id", "url").collect()
    assert [r["id"] for r in found] == ["0123456789abcdef", "00000000000000aa"] and found[0]["name"] == 'A "b"' and found[1]["name"] is None is found[0]["missing"]
    exports.write_table(spark.range(4).selectExpr("id", "id % 2 k"), str(tmp_path / "t"), ["k"])
    exports.write_table(spark.range(9, 10).selectExpr("id", "1 k"), str(tmp_path / "t"), ["k"])
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [0, 2, 9]


def test_empty_catalogue_entries():
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES)
