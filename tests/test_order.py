"""The order within a day, from exports to folds, loads and snapshots, and the reads on top of real ratings."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ringledger.operators import folds, loads, stacking
from ringledger.plans import serving
from ringledger.plans.contest import contests, sides
from ringledger.plans.dimensions import same_day_order
from ringledger.session import cut, parts_for
from ringledger.sources.store import Store

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def log(spark):
    """Weeks count as days, so contestants have several contests a day; within it they stand in falling order of ids."""
    return cut(contests(spark, SF).withColumn("day", F.date_trunc("week", "day").cast("date")).withColumn("seq", 10**9 - F.col("contest_id")))


@pytest.fixture(scope="module")
def deltas(log):
    return cut(folds.fold(log, ("elo", "glicko")))


def last_rows(rows, of):
    found = {}
    for r in sorted(rows, key=lambda r: (r["day"], r["seq"], r["contest_id"])):
        found[of(r)] = r
    return found


def test_last_states_and_snapshots_follow_the_given_order(spark, deltas):
    rows = deltas.collect()
    assert max(sum(1 for r in rows if (r["system"], r["contestant"], r["day"]) == k) for k in {(r["system"], r["contestant"], r["day"]) for r in rows[:50]}) > 1
    last = last_rows(rows, lambda r: (r["system"], r["contestant"]))
    assert {(r["system"], r["contestant"]): (r["rating"], r["fights"]) for r in folds.latest(deltas).collect()} == {k: (r["post_rating"], r["fights"]) for k, r in last.items()}
    daily = last_rows([r for r in rows if r["system"] == "elo"], lambda r: (r["contestant"], r["day"]))
    assert {(r["contestant"], r["day"]): r["rating"] for r in loads.rating_snapshots(deltas, "elo", "x").collect()} == {k: r["post_rating"] for k, r in daily.items()}
    month = lambda day: day.replace(day=28)
    marks = deltas.select("contest_id", F.make_date(F.year("day"), F.month("day"), F.lit(28)).alias("checkpoint")).distinct()
    monthly = last_rows([r for r in rows if r["system"] == "elo"], lambda r: (r["contestant"], month(r["day"])))
    assert {(r["contestant"], r["day"]): r["rating"] for r in loads.rating_snapshots(deltas, "elo", "x", marks).collect()} == {k: r["post_rating"] for k, r in monthly.items()}


def test_careers_follow_the_given_order(log):
    wanted, known, last = {}, {}, {}
    for r in sorted(sides(log).collect(), key=lambda r: (r["day"], r["seq"], r["contest_id"])):
        who = r["contestant"]
        wanted[r["contest_id"], who] = ((r["day"] - last[who]).days if who in last else 999, known.get(who, 0))
        known[who], last[who] = known.get(who, 0) + 1, r["day"]
    assert {(r["contest_id"], r["contestant"]): (r["days"], r["known"]) for r in stacking.careers(sides(log)).collect()} == wanted


def test_late_contests_stand_before_known_ones_of_their_day(spark, log, tmp_path):
    """The first load numbers the contests that it has; the second knows all, and its places hold."""
    store, late = Store(spark, str(tmp_path / "s")), F.col("contest_id") % 5 == 0
    loads.load_contests(store, log.where(~late).withColumn("seq", F.col("contest_id")), ("elo",))
    assert loads.load_contests(store, log, ("elo",)) == 2
    wanted = {(r["contest_id"], r["contestant"]): r["post_rating"] for r in folds.fold(log, ("elo",)).collect()}
    assert {(r["contest_id"], r["contestant"]): r["post_rating"] for r in store.read("deltas").collect()} == pytest.approx(wanted, abs=1e-9)
    assert store.read("contests").where("seq != 1000000000 - contest_id or checkpoint != day").count() == 0


def test_tournament_order_within_checkpoints(spark):
    """Plain sort of (checkpoint, stage, fewest, most, names, id); baselines are those of a day and checkpoint."""
    day, none = dt.date(2020, 1, 5), 10**9
    rows = [  # contest, checkpoint, a, b, totals, names
        (1, 7, 1, 2, 5, 3, "zed", "Abe"), (2, 7, 1, 3, 4, 9, "zed", "bob"), (3, 7, 4, 5, None, None, "x", "y"), (4, 6, 1, 4, 9, 9, "zed", "x"), (5, 7, 6, 7, 4, 9, "Abe", "Zed"), (6, 7, 8, 9, 4, 9, "abe", "zed"), (7, 7, 10, 11, None, 2, None, "y")]
    log = spark.createDataFrame([(k, day, dt.date(2020, 1, c), a, b, x, y, n, m) for k, c, a, b, x, y, n, m in rows], "contest_id long, day date, checkpoint date, a long, b long, total_a long, total_b long, name_a string, name_b string")
    base = {}
    for _, c, a, b, x, y, *_ in rows:
        for who, total in ((a, x), (b, y)):
            if total is not None:
                base[c, who] = min(total, base.get((c, who), none))

    def key(r):
        k, c, a, b, x, y, n, m = r
        known = [(w, t) for w, t in ((a, x), (b, y)) if t is not None]
        return c, max([t - base[c, w] for w, t in known], default=0), min([t for _, t in known], default=none), max([t for _, t in known], default=none), " vs ".join(sorted([s for s in (n, m) if s], key=str.lower)), k

    found = [r["contest_id"] for r in same_day_order(log).orderBy("seq").collect()]
    assert found == [r[0] for r in sorted(rows, key=key)] and found[0] == 4


def test_contest_details_have_the_folds_changes(spark):
    log = contests(spark, SF)
    wanted = {}
    for r in folds.fold(log).collect():
        wanted.setdefault(r["contest_id"], []).append((r["system"], r["contestant"], r["pre_rating"], r["post_rating"], r["post_rating"] - r["pre_rating"], r["expected"]))
    seen = 0
    for r in serving.rated_contest_details(spark, SF).collect():
        parts = [p.split("|") for p in r["changes"].split(";")]
        ordered = sorted(wanted[r["contest_id"]])
        assert [(p[0], int(p[1])) for p in parts] == [(w[0], w[1]) for w in ordered] and len(r["people"].split(";")) == 2
        for p, w in zip(parts, ordered, strict=True):
            assert [float(x.replace(",", "")) for x in p[2:]] == pytest.approx(w[2:], abs=6e-5)
        seen += 1
    assert seen == len(wanted)


def test_cards_profiles_and_pages(spark, deltas):
    history = serving.rated_history(deltas, ("elo", "glicko"))
    last, peak = last_rows(deltas.collect(), lambda r: (r["contestant"], r["system"])), {}
    for r in history.collect():
        peak[r["contestant"], r["system"]] = max(r["rating"], peak.get((r["contestant"], r["system"]), 0))
    people = spark.createDataFrame([(1, "One", "US", 180.0), (2, "Two", "UNK", None), (10**6, "Nobody", "UNK", None)], "fighter_id long, name string, country string, height_cm double")
    cards = {r["fighter_id"]: r for r in serving.fighter_cards(people, history).collect()}
    assert list(cards[1].asDict()) == [*serving.CARD, "ratings"] and len(serving.CARD) == 14 and cards[10**6]["ratings"] == []
    for k in (1, 2):
        assert [tuple(x) for x in cards[k]["ratings"]] == [(s, last[k, s]["post_rating"], last[k, s]["rd"], peak[k, s]) for s in ("elo", "glicko")]
    assert (cards[1]["display_name"], cards[1]["country_code"], cards[1]["height_cm"], cards[2]["stance"]) == ("One", "US", 180.0, None)
    assert [r["fighter_id"] for r in serving.fighter_cards(people, history, 2).collect()] == [2]
    line = serving.series(history, "elo", 1)
    days = sorted(r["day"] for r in line.collect())
    assert [r["day"] for r in serving.series_page(line, 3, 2).collect()] == days[2:5]
    with pytest.raises(ValueError, match="5000"):
        serving.series_page(line, 5001)
    meta = lambda limit, offset: tuple(serving.pagination(line, limit, offset).first())
    n = len(days)
    assert meta(3, 2) == (n, 3, 2, n > 5, True) and meta(n, 0) == (n, n, 0, False, False) and serving.pagination(line.where("1 = 0"), 5).first()["total"] == 0


def test_larger_tables_are_dealt_to_more_tasks(spark, tmp_path):
    """The share of a task does not grow with the table; small tables keep the session's number, and so does one whose size is not known."""
    table = spark.range(200_000).withColumn("x", F.rand(1))
    table.write.parquet(str(tmp_path / "t"))
    read, fewest = spark.read.parquet(str(tmp_path / "t")), int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert parts_for(read) == fewest
    assert parts_for(read, 1 << 14) > 4 * fewest and parts_for(read.unionByName(read), 1 << 14) > 1.9 * parts_for(read, 1 << 14)
