"""The chained load of the 15 exports: made files, a load that fails midway, its repetition, and ratings on top."""

import csv
import datetime

import pytest

from pyspark.sql import functions as F

from ringledger.operators import folds, loads
from ringledger.plans import serving, warehouse
from ringledger.sources import exports
from ringledger.sources.store import Store

H = {k: f"{k:016x}" for k in range(1, 40)}
FILES = {
    "sport_translation": (["sport", "translation_to_mma"], [["mma", "1.00"], ["boxing", "0.40"], ["boxing", "0.35"], ["nonsense", "0.1"]]),
    "promotions_with_sports": (["id", "name", "tapology_slug", "tapology_promotion_id", "sport_type", "baseline_strength"], [["", "Big", "1-big", "1", "mma", "0.9"], ["", "Big again", "1-big", "", "mma", "0.95"], ["", "Small", "", "", "boxing", "0.4"], ["", "No strength", "2-none", "", "mma", ""]]),
    "tapology_events": (["event_tapology_slug", "event_tapology_url", "event_date", "event_name", "promotion_tapology_url", "promotion_name"], [["e1", "", "2020-01-04", "", "http://t/promotions/1-big", "Big"], ["e2", "", "2020-02-01", "Second", "", ""]]),
    "tapology_bouts": (["tapology_bout_id", "event_tapology_url", "event_date", "event_date_raw", "sport", "is_title_fight", "is_amateur", "weight_class", "weight_lbs", "method", "method_details", "promotion_tapology_url", "promotion_name"], [
        ["b1", "http://t/events/e1", "2020-01-04", "", "mma", "true", "", "Lightweight", "155", "SUB", "Choke, R2 1:30", "http://t/promotions/1-big", "Big"],
        ["b2", "http://t/events/e1", "2020-01-04", "", "mma", "", "", "", "", "DEC", "Decision - Unanimous", "http://t/promotions/1-big", "Big"],
        ["b3", "http://t/events/e3", "2020-01-10", "", "boxing", "", "true", "Heavyweight", "", "KO", "R1 0:10", "", ""],
        ["b4", "http://t/events/e2", "", "2020-Feb 01", "mma", "", "", "Catchweight (150 lbs)", "", "TKO", "overturned by the commission", "", ""],
        ["b5", "http://t/events/e9", "2031-01-01", "", "nonsense", "", "", "", "", "", "", "", ""]]),
    "tapology_fighters": (["tapology_fighter_id", "name", "height_in", "dob", "fetched_at", "profile_image_url"], [["f1", "One", "70", "1990-01-05", "2020-01-01T00:00:00Z", "http://i/1"], ["f2", "", "0", "", "", ""], ["f3", "Three", "", "", "", ""], ["f4", "Takes no part", "", "", "", ""]]),
    "tapology_bout_fighters": (["tapology_bout_id", "tapology_fighter_id", "opponent_tapology_slug", "result", "fighter_record_before_raw"], [
        ["b1", "f1", "f2", "W", "3-0"], ["b2", "f2", "f3", "L", ""], ["b2", "f3", "f2", "W", "9-9"], ["b3", "f1", "f3", "W", ""], ["b4", "f1", "f3", "W", ""], ["b5", "f9", "f1", "W", ""]]),
    "ufcstats_fighters": (["ufcstats_fighter_id", "ufcstats_url", "name", "height_in", "record", "stance", "fetched_at"], [[H[1], "", "U One", "71", "3-0-0", "Orthodox", "2021-01-01T00:00:00Z"], ["", f"http://u/fighter-details/{H[2]}", "U Two", "68", "1-1-0", "", ""], [H[5], "", "Unmapped", "", "", "", ""]]),
    "ufcstats_events_2025": (["event_id", "url", "name", "date"], [[H[11], "", "Night 1", "2020-01-05"], [H[12], "", "", "2020-02-01"], [H[13], "", "Far off", "2027-01-01"], [H[11], "", "again", ""]]),
    "ufcstats_fights": (["ufcstats_fight_id", "ufcstats_event_id", "red_fighter_id", "blue_fighter_id", "winner_fighter_id", "gender", "weight_class", "is_title_bout", "scheduled_rounds", "method", "method_detail", "round", "time"], [
        [H[21], H[11], H[1], H[2], H[1], "M", "Lightweight Bout", "true", "5", "Submission", "", "2", "1:30"], [H[22], H[13], H[1], H[2], "", "M", "", "", "3", "", "", "", ""]]),
    "ufcstats_fight_totals": (["ufcstats_fight_id", "ufcstats_fighter_id", "kd", "sig_str_land", "ctrl"], [[H[21], H[1], "1", "12", "1:05"], [H[22], H[1], "1", "1", ""]]),
    "ufcstats_fight_rounds": (["ufcstats_fight_id", "ufcstats_fighter_id", "round", "kd", "sig_str_land", "ctrl"], [[H[21], H[1], "1", "1", "7", "0:30"], [H[21], H[1], "2", "0", "5", "0:35"], [H[21], H[1], "Totals", "1", "12", ""], [H[21], H[5], "1", "1", "1", ""]]),
    "ufcstats_sig_strikes_by_target": (["ufcstats_fight_id", "ufcstats_fighter_id", "round", "head_land"], [[H[21], H[2], "1", "4"]]),
    "ufcstats_sig_strikes_by_position": (["ufcstats_fight_id", "ufcstats_fighter_id", "round", "ground_land"], []),
    "fighter_id_map": (["tapology_fighter_id", "ufcstats_fighter_id"], [["f1", H[1]], ["f2", H[9]], ["f2", H[2]], ["f4", H[5]]]),
    "bout_id_map": (["ufcstats_fight_id", "tapology_bout_id"], [[H[21], "b1"]]),
}


def write(folder, files):
    folder.mkdir(exist_ok=True)
    for name in exports.EXPORTS:
        head, rows = files[name]
        with open(folder / f"{name}.csv", "w", newline="") as f:
            csv.writer(f).writerows([head, *rows])


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    """Fails once, as a contest has no partner, and then loads."""
    where = tmp_path_factory.mktemp("load")
    store = Store(spark, str(where / "store"))
    write(where / "in", FILES | {"bout_id_map": (FILES["bout_id_map"][0], [])})
    with pytest.raises(ValueError, match="1 rows have no partner"):
        warehouse.load_exports(spark, str(where / "in"), store)
    assert store.manifest()["version"] == 0 and store.read("sports") is None
    write(where / "in", FILES)
    assert warehouse.load_exports(spark, str(where / "in"), store) == 1
    store.where = where
    return store


def table(store, name, *columns):
    return sorted((tuple(r) for r in store.read(name).select(*columns).collect()), key=repr)


def test_dimensions(store):
    rate = {r["sport"]: r["translation_to_mma"] for r in store.read("sports").collect()}
    assert {k: v and float(v) for k, v in rate.items()} == {"mma": 1.0, "boxing": 0.35, "unknown": 0.1}
    assert sorted(r["sport_id"] for r in store.read("sports").collect()) == [1, 2, 3]
    assert [(k, n, float(s)) for k, n, s in table(store, "promotions", "key", "name", "strength")] == [("name:small", "Small", 0.4), ("slug:1-big", "Big", 0.95)]
    assert {("mma", "MMA_LW", "M"), ("mma", "MMA_UNKNOWN", "U"), ("boxing", "BOXING_UNKNOWN", "U")} <= set(table(store, "divisions", "sport", "division", "sex"))
    assert {r[0] for r in table(store, "rulesets", "ruleset")} >= {"unified_mma_title_5x5", "unified_mma_3x5", "boxing_unknown"}
    assert len(table(store, "results", "outcome")) == 5 * (7 + 7 * 2)
    assert all(r[0] is not None for r in table(store, "weight_bridge", "division_id"))


def test_people_and_events(store):
    people = {r["tap"]: r for r in store.read("fighters").collect()}
    assert set(people) == {"f1", "f2", "f3"}
    assert (people["f1"]["name"], people["f2"]["name"], people["f3"]["name"]) == ("One", "U Two", "Three")
    assert (float(people["f1"]["height_in"]), float(people["f2"]["height_in"]), people["f3"]["height_in"]) == (70, 68, None) and float(people["f1"]["height_cm"]) == 177.8
    assert (people["f1"]["sex"], people["f3"]["sex"], people["f2"]["record"], people["f1"]["stance"]) == ("M", "U", "1-1-0", "Orthodox")
    assert people["f1"]["fetched_at"] == datetime.datetime(2021, 1, 1) and people["f1"]["birth_date"] == datetime.date(1990, 1, 5)
    known = {(s, i): f for s, i, f in table(store, "fighter_sources", "source", "source_id", "fighter_id")}
    assert known["ufcstats", H[1]] == known["tapology", "f1"] == people["f1"]["fighter_id"] and known["ufcstats", H[9]] == people["f2"]["fighter_id"] and ("ufcstats", H[5]) not in known
    assert table(store, "events", "event_id", "event_name", "event_date") == [(1, "Night 1", datetime.date(2020, 1, 5)), (2, f"UFCStats Event {H[12]}", datetime.date(2020, 2, 1))]
    assert [(s, n, float(c)) for s, n, c in table(store, "event_bridge", "slug", "mapped_contests", "confidence")] == [("e1", 1, 1.0)]
    assert store.manifest()["facts"]["watermark"] == {"newest_day": "2020-02-01", "newest": 2}


def test_contests_and_statistics(store):
    rows = {r["ref"]: r for r in store.read("bouts").collect()}
    assert set(rows) == {"b1", "b2", "b3", "b4", "b5"} and {k: r["event_id"] for k, r in rows.items()} == {"b1": 1, "b2": 1, "b3": 2, "b4": 2, "b5": 2}
    one = rows["b1"]
    assert (one["fight"], one["rounds"], one["title"], one["method"], one["finish_round"], one["finish_seconds"], one["total_seconds"], one["sport"]) == (H[21], 5, True, "SUB", 2, 90, 390, "mma")
    assert (rows["b2"]["method"], rows["b2"]["decision"], rows["b3"]["is_amateur"], rows["b4"]["method"], rows["b5"]["sport"]) == ("DEC", "UD", True, "OVERTURNED", "unknown")
    assert all(r["division_id"] is not None and r["ruleset_id"] is not None for r in rows.values()) and one["promotion_id"] is not None and rows["b3"]["promotion_id"] is None
    who = {r["tap"]: r["fighter_id"] for r in store.read("fighters").collect()}
    found = {(b, f): (o, c, r, i) for b, f, o, c, r, i in table(store, "participants", "bout_id", "fighter_id", "outcome", "corner", "record", "inferred")}
    b = {k: r["bout_id"] for k, r in rows.items()}
    assert found == {
        (b["b1"], who["f1"]): ("W", "red", "3-0", False), (b["b1"], who["f2"]): ("L", "blue", "1-1-0", False), (b["b2"], who["f2"]): ("L", "unknown", None, False), (b["b2"], who["f3"]): ("W", "unknown", "9-9", False),
        (b["b3"], who["f1"]): ("W", "unknown", None, False), (b["b3"], who["f3"]): ("L", "unknown", None, True), (b["b4"], who["f1"]): ("NC", "unknown", None, False), (b["b4"], who["f3"]): ("NC", "unknown", None, True)}
    assert all(r[0] is not None for r in table(store, "participants", "result_id"))
    assert table(store, "round_stats", "fighter_id", "round_num", "sig_landed", "ctrl_seconds") == [(who["f1"], 0, 12, None), (who["f1"], 1, 7, 30), (who["f1"], 2, 5, 35)]
    assert table(store, "fight_totals", "fighter_id", "kd", "ctrl_seconds") == [(who["f1"], 1, 65)] and table(store, "by_target", "fighter_id", "head_landed") == [(who["f2"], 4)] and table(store, "by_position", "fighter_id") == []
    assert [(n, d) for i, n, d in table(store, "rounds", "bout_id", "round_num", "completed") if i == b["b1"]] == [(0, False), (1, True), (2, True), (3, False), (4, False), (5, False)]


def test_ratings_follow(spark, store):
    log, bouts = warehouse.contest_log(store), store.read("bouts")
    assert log.where("day is null").count() == 0 and {r["tier"] for r in log.collect()} == {"A", "C"}
    deltas = folds.fold(log, ("elo",)).where("k != 0").collect()
    assert len(deltas) == 4 and {r["contest_id"] for r in deltas} == {r["bout_id"] for r in bouts.where("ref in ('b1', 'b2')").collect()}
    when = {r["ref"]: (str(r["day"]), str(r["checkpoint"]), r["seq"]) for r in log.join(bouts.select(F.col("bout_id").alias("contest_id"), "ref"), "contest_id").collect()}
    assert when["b1"][2] == 1 and when["b2"] == ("2020-01-04", "2020-01-05", 2)  # records of 3 and 2 contests come before one of 18
    assert when["b4"][:2] == ("2020-02-01", "2020-02-01")
    assert warehouse.contest_log(Store(spark, str(store.where / "empty"))) is None


def test_cards_and_snapshots_of_the_load(spark, store):
    log = warehouse.contest_log(store)
    deltas = folds.fold(log, ("elo",))
    snapshots = loads.rating_snapshots(deltas, "elo", "x", log).withColumn("system", F.lit("elo"))
    events = {r["event_date"] for r in store.read("events").collect()}
    assert {r["day"] for r in snapshots.collect()} <= events and snapshots.count() == snapshots.select("contestant", "day").distinct().count() > 0
    cards = {r["display_name"]: r for r in serving.fighter_cards(store.read("fighters"), snapshots).collect()}
    one = cards["One"]
    assert (one["profile_image_url"], one["height_cm"], str(one["birth_date"]), one["stance"], one["country_code"], one["sex"]) == ("http://i/1", pytest.approx(177.8), "1990-01-05", "Orthodox", "UNK", "M")
    last = max(snapshots.where(F.col("contestant") == one["fighter_id"]).collect(), key=lambda r: r["day"])
    assert [(x["system"], x["rating"]) for x in one["ratings"]] == [("elo", last["rating"])]
