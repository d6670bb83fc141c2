"""Ordered analytics of hot contestants by ranges and blocks, matching as a fold, rounds, and all-time profiles, against plain loops."""

import datetime
import random
from collections import defaultdict
from statistics import median, stdev

import pytest
from pyspark.sql import functions as F

from ringledger.operators import analytics, folds, joins, profiles
from ringledger.plans import performance
from ringledger.plans.contest import contests, sides
from ringledger.session import cut

SF = "/root/testdata/sf0.001"
DAY = datetime.date(2000, 1, 1)


@pytest.fixture(scope="module")
def career(spark):
    """One contestant with 700 contests, spread over all ranges, and 30 others."""
    r = random.Random(9)
    rows, day = [], 0
    for k in range(900):
        day += r.choice((0, 0, 1, 3, 20, 190))
        rows.append((7 if k % 9 < 7 else r.randrange(100, 130), k, DAY + datetime.timedelta(days=day), r.choice(("W", "W", "W", "W", "L", "D", "NC")), r.uniform(1300, 1800)))
    return cut(spark.createDataFrame(rows, "contestant long, contest_id long, day date, result string, v double").repartition(8))


def by_contestant(career):
    out = defaultdict(list)
    for r in sorted(career.collect(), key=lambda r: (r["day"], r["contest_id"])):
        out[r["contestant"]].append(r)
    return out


def streak(results):
    best = now = 0
    for x in results:
        now = now + 1 if x == "W" else now if x == "NC" else 0
        best = max(best, now)
    return best


def rolling(values, size=3):
    return max(sum(values[k : k + size]) / size for k in range(len(values) - size + 1)) if len(values) >= size else sum(values) / len(values)


def window(points, days=365, gap=180):
    best = 0.0
    for k, (start, _) in enumerate(points):
        values, before = [], None
        for day, v in points[k:]:
            if (day - start).days > days:
                break
            if before is None or (day - before).days <= gap:
                values.append(v)
            before = day
        best = max(best, sum(values) / len(values))
    return best


def area(points, base, cap, elite):
    total = long = 0.0
    for (d0, v0), (d1, v1) in zip(points, points[1:], strict=False):
        days, middle = min((d1 - d0).days, cap), (v0 + v1) / 2
        total += max(0.0, middle - base) * days
        long += days if middle >= elite else 0
    return total, long


@pytest.mark.parametrize("block", [2, 5, 64])
def test_hot_contestants_by_ranges_and_blocks(spark, career, block):
    people = by_contestant(career)
    ranges = analytics.by_range(career, ["contestant"], ["day", "contest_id"]).where("contestant = 7").select("_range").distinct().count()
    assert ranges >= 5
    assert {r["contestant"]: r["longest"] for r in analytics.longest_streak(career).collect()} == {k: streak([r["result"] for r in v]) for k, v in people.items()}
    found = {r["contestant"]: r["peak"] for r in analytics.rolling_peak(career, "contestant", "v", ("day", "contest_id"), block=block).collect()}
    assert found == pytest.approx({k: rolling([r["v"] for r in v]) for k, v in people.items()})
    means = {(r["contestant"], r["contest_id"]): (r["n"], r["mean"]) for r in analytics.running_means(career, "contestant", "v", ("day", "contest_id"), 4, block).collect()}
    for k, v in people.items():
        for at, r in enumerate(v):
            last = [x["v"] for x in v[max(0, at - 3) : at + 1]]
            assert means[k, r["contest_id"]] == (len(last), pytest.approx(sum(last) / len(last)))
    line = career.groupBy("contestant", "day").agg(F.max_by("v", "contest_id").alias("v"))
    points = defaultdict(list)
    for r in sorted(line.collect(), key=lambda r: r["day"]):
        points[r["contestant"]].append((r["day"], r["v"]))
    assert {r["contestant"]: r["peak"] for r in analytics.window_peak(line, "contestant", "v", "day", block=block).collect()} == pytest.approx({k: window(v) for k, v in points.items()})
    areas = {r["contestant"]: (r["area"], r["elite_days"]) for r in analytics.capped_area(line, "contestant", "v", "day", block=block).collect()}
    assert areas == {k: pytest.approx(area(v, 1500, 180, 1600)) for k, v in points.items()}


def test_carried_rows_are_fewer_than_ranges(spark, career):
    placed = analytics.by_range(career.withColumn("one", F.lit(1)), ["contestant"], ["day", "contest_id"])
    parts = placed.groupBy("contestant", "_range").agg(F.sum("one").alias("n"))
    carried = analytics.carried(parts, ["contestant"], {"m": F.col("n")})
    assert 0 < carried.count() < placed.select("_range").distinct().count()


def plain_choice(pairs):
    left, right, out = set(), set(), set()
    for a, b, w in sorted(pairs, key=lambda x: (-x[2], x[0], x[1])):
        if a not in left and b not in right:
            left.add(a)
            right.add(b)
            out.add((a, b, w))
    return out


@pytest.mark.parametrize("one_task", [joins.ONE_TASK, 60])
def test_greedy_match_of_chains_and_thickets(spark, one_task):
    r = random.Random(1)
    chain = [(k // 2 + k % 2, 1000 + k // 2, 900 - k) for k in range(500 if one_task > 100 else 60)]  # each pair shares a side with the next
    thicket = list({(2000 + r.randrange(12), 3000 + r.randrange(12)): (0, 0, 0) for _ in range(70)})
    pairs = chain + [(a, b, r.randrange(5)) for a, b in thicket]
    df = spark.createDataFrame(pairs + [(None, 1, 9), (1, None, 9)], "a long, b long, n int")
    group = f"match-{one_task}"
    spark.sparkContext.setJobGroup(group, "")
    found = {tuple(x) for x in joins.greedy_match(df, "a", "b", "n", one_task).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert found == plain_choice(pairs)
    if one_task == joins.ONE_TASK:
        assert jobs < 10


def test_lookup_fallback_with_quotes(spark):
    table = spark.createDataFrame([("it's", "x", 1), ("a", "it's", 2)], "k string, l string, v int")
    rows = spark.createDataFrame([("it's", "x"), ("b", "q")], "k string, l string")
    assert sorted(r["v"] for r in joins.lookup_with_fallback(rows, table, ["k", "l"], "v", {"k": "a", "l": "it's"}).collect()) == [1, 2]
    assert sorted((r["v"] or 0) for r in joins.lookup_with_fallback(rows, table, ["k", "l"], "v", {"k": "none", "l": "x"}).collect()) == [0, 1]


def test_round_table(spark):
    log = spark.createDataFrame([(1, 3, 2, 300), (2, 3, 2, 299), (3, 3, None, None), (4, 3, 1, None), (5, None, 1, 10), (6, 0, 1, 10), (7, 5, 2, 100)], "contest_id long, rounds int, finish_round int, finish_seconds int")
    observed = spark.createDataFrame([(7, 5), (7, 2), (7, 0), (7, 2), (8, 9), (None, 1), (7, None)], "contest_id long, round_num int")
    found = defaultdict(dict)
    for r in performance.round_table(log, observed).collect():
        found[r["contest_id"]][r["round_num"]] = r["completed"]
        assert r["round_seconds"] == 300
    assert found == {1: {1: True, 2: True, 3: False}, 2: {1: True, 2: False, 3: False}, 3: {1: True, 2: True, 3: True}, 4: {1: True, 2: False, 3: False},
                     7: {0: False, 1: True, 2: True, 3: False, 4: False, 5: True}, 8: {9: True}}


def robust(values):
    m = median(values)
    mad = 1.4826 * median([abs(v - m) for v in values])
    scale = mad if mad > 1e-9 else (stdev(values) if len(values) > 1 else 1.0)
    scale = scale if scale > 1e-9 else 1.0
    return [max(-4, min(4, (v - m) / scale)) for v in values]


def nearest(values, p, fallback):
    return sorted(values)[min(len(values) - 1, int(len(values) * p))] if values else fallback


@pytest.mark.parametrize("compat", [True, False])
def test_profiles_equal_a_plain_loop(spark, compat):
    log = cut(contests(spark, SF))
    deltas = cut(folds.fold(log))
    each, bouts, final = deltas.collect(), defaultdict(list), log.agg(F.max("day")).first()[0]
    for r in sorted(sides(log.where("sport = 'mma'")).collect(), key=lambda r: (r["day"], r["contest_id"])):
        bouts[r["contestant"]].append(r)
    snaps = {}
    for r in sorted(each, key=lambda r: (r["day"], r["contest_id"])):
        snaps[r["system"], r["contestant"], r["day"]] = r["post_rating"]
    lines = defaultdict(dict)
    for (system, who, day), v in snaps.items():
        lines[system, who][day] = v
    at = {(r["contest_id"], r["contestant"]): r for r in each if r["system"] == "unified"}
    people = sorted({who for _, who in lines})
    peak = {(s, p): max(lines[s, p].values(), default=0.0) for s in folds.SYSTEMS for p in people}
    elite = nearest([peak["unified", p] for p in people if peak["unified", p] > 1500], 0.9, 1700.0)
    rows = {}
    for p in people:
        line = dict(lines["unified", p])
        if compat and final not in line:
            line[final] = line[max(line)]
        points, own = sorted(line.items()), bouts[p]
        won = [b for b in own if b["result"] == "W"]
        opponents, beaten, changes, upsets = [], [], [], 0
        for b in own:
            d, mine = at[b["contest_id"], b["opponent"]], at[b["contest_id"], p]
            use = d if compat else mine
            opponents.append(d["pre_rating"])
            changes.append(use["post_rating"] - use["pre_rating"])
            if b["result"] == "W":
                beaten.append(d["pre_rating"])
                upsets += use["expected"] < 0.4
        titles = [b for b in own if b["title"]]
        title_wins = sum(b["result"] == "W" for b in titles)
        finished = [b for b in won if b["method"] in ("KO", "TKO", "SUB")]
        total, days = area(points, 1500, 180, elite) if len(points) > 1 else (0.0, 0)
        ps = [(1 + b["edge"]) / 2 for b in own]
        rows[p] = {
            "peak_unified": peak["unified", p], "peak_factor": peak["factor", p], "peak_elo": peak["elo", p], "peak_glicko": peak["glicko", p], "peak_three": rolling([v for _, v in points]) if len(points) > 1 else 0.0,
            "peak_year": window(points) if len(points) > 1 else 0.0, "area": total, "elite_days": days, "span_years": (own[-1]["day"] - own[0]["day"]).days / 365.25 if own else 0.0, "fights": len(own),
            "opponent_rating": sum(opponents) / len(opponents) if opponents else 0.0, "beaten_rating": sum(beaten) / len(beaten) if beaten else 0.0, "upset_wins": upsets, "rating_variance": stdev(changes) if len(changes) >= 3 else 0.0,
            "win_rate": len(won) / max(1, sum(b["result"] in "WL" for b in own)), "finish_rate": len(finished) / len(won) if won else 0.0, "quality_of_win": sum(max(0.0, x - 0.5) for x in ps) / len(ps) if ps else 0.0, "performance": sum(ps) / len(ps) if ps else 0.0,
            "title_wins": title_wins, "defenses": max(0, title_wins - 1), "title_fights": len(titles), "streak": streak([b["result"] for b in own]), "wins": len(won), "_beaten": beaten}
    top = nearest([r["opponent_rating"] for r in rows.values() if r["opponent_rating"] > 0], 0.75, 1600.0)
    for r in rows.values():
        r["top_wins"] = sum(v >= top for v in r.pop("_beaten"))
    whole = {p: r for p, r in rows.items() if r["fights"] >= 8 and r["wins"] > 0}
    names = list(whole)
    score = dict.fromkeys(names, 0.0)
    for pillar, (share, weights) in profiles.PILLARS.items():
        zs = {a: robust([float(whole[p][a]) for p in names]) for a in weights}
        for p, z in zip(names, robust([sum(w * zs[a][k] for a, w in weights.items()) for k in range(len(names))]), strict=True):
            whole[p][f"z_{pillar}"] = z
            score[p] += share * z
    found = {r["contestant"]: r.asDict() for r in profiles.profiles(sides(log), deltas, compat=compat).collect()}
    assert found.keys() == whole.keys() and len(found) >= 5
    for p, r in whole.items():
        assert {k: found[p][k] for k in r} == pytest.approx(r, abs=1e-6), p
        assert found[p]["score"] == pytest.approx(score[p], abs=1e-6)
