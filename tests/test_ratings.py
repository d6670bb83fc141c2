"""What SQL cannot say against plain loops: the folds, stacking, win rates, greedy matching, as-of joins and exports."""

import datetime
import math
import random
import uuid
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
from pyspark.sql import functions as F

from ringledger.functions import attributes, features, text, weights
from ringledger.operators import analytics, attribute_fold, folds, joins, pools, stacking
from ringledger.plans import performance
from ringledger.plans.contest import contests, sides
from ringledger.session import cut
from ringledger.sources import exports

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def log(spark):
    return cut(contests(spark, SF))


@pytest.fixture(scope="module")
def ready(log):
    return sorted(folds.prepared(log).collect(), key=lambda r: (r["day"], r["contest_id"]))


@pytest.fixture(scope="module")
def deltas(log):
    return cut(folds.fold(log, ("elo", "glicko", "factor")))


def anchored(c, e):
    if c["outcome"] == "W":
        return max(c["base"], 0.5, e + 0.01) if max(c["base"], 0.5, e + 0.01) <= 1 or e + 0.01 > 1 else 1.0
    low = min(0.5, e - 0.01)
    return min(max(c["base"], 0.0), low)


def test_volatility_solves_its_equation():
    """The root by plain bisection over a wide interval."""
    r = random.Random(3)
    for _ in range(200):
        phi, sigma, variance, gain = r.uniform(0.2, 2), r.uniform(0.03, 0.2), r.uniform(0.1, 5), r.uniform(-4, 4)

        def slack(x, phi=phi, sigma=sigma, variance=variance, gain=gain):
            e = math.exp(x)
            return e * (gain**2 - phi**2 - variance - e) / (2 * (phi**2 + variance + e) ** 2) - (x - math.log(sigma**2)) / 0.25

        low, high = -30.0, 10.0
        for _ in range(200):
            low, high = ((low + high) / 2, high) if slack((low + high) / 2) > 0 else (low, (low + high) / 2)
        assert folds.volatility(phi, sigma, gain, variance) == pytest.approx(math.exp(low / 2), rel=1e-9)


def test_glicko_fold_equals_a_plain_loop(ready, deltas):
    scale, state, expected = 173.7178, {}, {}
    for c in ready:
        sides_ = []
        for who in (c["a"], c["b"]):
            mu, phi, sigma, last = state.get(who, (0.0, 350 / scale, 0.06, None))
            if last:
                phi = math.sqrt(phi**2 + (c["day"] - last).days / 30 * 0.06**2)
            sides_.append([mu, phi, sigma])
        (ma, pa, _), (mb, pb, _) = sides_
        weigh = lambda p: 1 / math.sqrt(1 + 3 * p * p / math.pi**2)
        e = 1 / (1 + math.exp(-weigh(pb) * (ma - mb)))
        if c["sport"] == "mma" and c["outcome"] in ("W", "L"):
            t = anchored(c, e)
            for k, (m, p, o, q, score) in enumerate(((ma, pa, mb, pb, t), (mb, pb, ma, pa, 1 - t))):
                g = weigh(q)
                own = 1 / (1 + math.exp(-g * (m - o)))
                v = 1 / (g * g * own * (1 - own))
                sigma = folds.volatility(p, sides_[k][2], v * g * (score - own), v)
                phi = 1 / math.sqrt(1 / (p * p + sigma * sigma) + 1 / v)
                sides_[k] = [m + phi * phi * g * (score - own), phi, sigma]
        for who, s in zip((c["a"], c["b"]), sides_, strict=True):
            state[who] = (*s, c["day"])
            expected[who, c["contest_id"]] = (1500 + scale * s[0], scale * s[1])
    found = {(r["contestant"], r["contest_id"]): (r["post_rating"], r["rd"]) for r in deltas.where("system = 'glicko'").collect()}
    assert found.keys() == expected.keys()
    assert all(found[k] == pytest.approx(v, abs=1e-6) for k, v in expected.items())


def test_factor_fold_equals_the_joint_update(ready, deltas):
    """The update of one eight-dimensional state, with what the two sides come to share dropped after each contest."""
    weight = {"mma": [1, 0.35, 0.35, 0.2], "boxing": [0, 1, 0, 0.2], "grappling": [0, 0, 1, 0.2]}
    state, expected = {}, {}
    for c in ready:
        both = []
        for who in (c["a"], c["b"]):
            mean, cov, last = state.get(who, (np.zeros(4), np.diag([1.0, 1.2, 1.2, 1.0]), None))
            days = (c["day"] - last).days if last else 0
            both.append((mean, cov + days * np.diag([0.0007, 0.001, 0.001, 0.0008])))
        w = np.array(weight[c["sport"]])
        gap = w @ (both[0][0] - both[1][0])
        shift = 0.65 * c["margin"] + 0.2 * ((c["promotion"] or 0.5) - 0.5) + (0.05 * (0.35 * abs(c["margin"]) + 0.3 * gap) if c["method"] in ("KO", "TKO", "SUB") else 0)
        e = 1 / (1 + math.exp(-(gap + shift)))
        if c["outcome"] in ("W", "L"):
            t = anchored(c, e) if c["sport"] == "mma" else float(c["outcome"] == "W")
            h = e * (1 - e) * np.concatenate([w, -w])
            joint = np.zeros((8, 8))
            joint[:4, :4], joint[4:, 4:] = both[0][1], both[1][1]
            gain = joint @ h / (h @ joint @ h + max(0.02, e * (1 - e)))
            mean = np.concatenate([both[0][0], both[1][0]]) + gain * (t - e)
            joint = (np.eye(8) - np.outer(gain, h)) @ joint
            joint = (joint + joint.T) / 2
            both = [(mean[:4], joint[:4, :4]), (mean[4:], joint[4:, 4:])]
        for who, (m, p) in zip((c["a"], c["b"]), both, strict=True):
            state[who] = (m, p, c["day"])
            expected[who, c["contest_id"]] = 1500 + 400 * m[0]
    found = {(r["contestant"], r["contest_id"]): r["post_rating"] for r in deltas.where("system = 'factor'").collect()}
    assert all(found[k] == pytest.approx(v, abs=1e-6) for k, v in expected.items())


def test_stacking_and_win_rates_equal_plain_loops(log, deltas):
    mma = sides(log.where("sport = 'mma'"))
    by = {(r["system"], r["contest_id"], r["contestant"]): r for r in deltas.collect()}
    rows, labels, last, count, came = {}, {}, {}, defaultdict(int), {}
    for c in sorted(log.where("sport = 'mma'").collect(), key=lambda r: (r["day"], r["contest_id"])):
        a, b = c["a"], c["b"]
        for who in (a, b):
            came.setdefault(who, len(came))
        if c["outcome"] in ("W", "L"):
            p = [by["elo", c["contest_id"], a]["expected_after"], by["glicko", c["contest_id"], a]["expected_after"], by["factor", c["contest_id"], a]["expected"]]
            days = (c["day"] - last[a]).days if a in last else 999
            rows[c["contest_id"]] = [1.0, *[math.log(q / (1 - q)) for q in p], 0, 0, c["tier"] == "A", c["tier"] == "B", c["rounds"] >= 5, c["title"], min(days / 365, 4), False, c["promotion"] is None, min(count[b] / 20, 3)]
            labels[c["contest_id"]] = float(c["outcome"] == "W")
        for who in (a, b):
            last[who] = c["day"]
            count[who] += 1
    ids = sorted(rows)
    x, y = np.array([rows[k] for k in ids], float), np.array([labels[k] for k in ids])
    w = np.zeros(14)
    for _ in range(1500):
        g = x.T @ (1 / (1 + np.exp(-(x @ w))) - y) / len(y)
        w = w - 0.05 * (g + 1e-3 * np.array([0, *w[1:]]))
    found = {r["contest_id"]: r["p"] for r in stacking.stack(log, mma, deltas).collect()}
    assert found.keys() == rows.keys()
    assert [found[k] for k in ids] == pytest.approx((1 / (1 + np.exp(-(x @ w)))).tolist(), abs=1e-9)
    now = folds.latest(deltas)
    state = {(r["system"], r["contestant"]): r for r in now.collect()}
    pool = sorted(count, key=lambda k: (-count[k], came[k]))[:300]
    for r in stacking.win_rates(log, mma, deltas, now).collect():
        total = []
        for o in pool:
            if o != r["contestant"]:
                me, other = ({s: state[s, k] for s in ("elo", "glicko", "factor")} for k in (r["contestant"], o))
                phi = other["glicko"]["rd"] / 173.7178
                z = [(me["elo"]["rating"] - other["elo"]["rating"]) / 400, (me["glicko"]["rating"] - other["glicko"]["rating"]) / 173.7178 / math.sqrt(1 + 3 * phi**2 / math.pi**2), me["factor"]["latent"] - other["factor"]["latent"]]
                total.append(1 / (1 + math.exp(-float(np.dot(w, [1, *z, 0, 0, 0, 1, 0, 0, 120 / 365, 0, 0, min(count[o] / 20, 3)])))))
        doubt = min(0.49, state["factor", r["contestant"]]["rd"] / 800)
        assert (r["win_rate"], r["adjusted"]) == pytest.approx((np.mean(total), np.mean(total) - doubt), abs=1e-9)


def test_stacking_without_samples_and_without_compat(spark, log, deltas):
    few = log.where("sport = 'mma' and outcome = 'W'").orderBy("contest_id").limit(5)
    found = stacking.stack(few, sides(few), deltas).collect()
    assert len(found) == 5 and all(0 < r["p"] < 1 for r in found)
    assert stacking.fit(stacking.design(few, sides(few), deltas)) is None
    one, other = (stacking.design(log, sides(log.where("sport = 'mma'")), deltas, c) for c in (True, False))
    assert one.count() == other.count() and one.exceptAll(other).count() > 0
    fitted = stacking.fit(other, rounds=3, max_samples=200)
    assert len(fitted) == 14


def test_unified_compat_switch_changes_who_counts_as_winner(log):
    old, new = ({(r["contest_id"], r["contestant"]): r for r in folds.fold(log, ("unified",), compat=c).collect()} for c in (True, False))
    lost = log.where("outcome = 'L' and sport = 'mma'").orderBy("day", "contest_id").first()
    key = (lost["contest_id"], lost["a"])
    assert old[key]["streak"] > 0 > new[key]["streak"]
    assert all(r["finish_rate"] <= 1 for r in new.values())


def test_attribute_fold_equals_a_plain_loop(log):
    """The first 300 contests, each stat by itself."""
    rows = sorted(log.collect(), key=lambda r: (r["day"], r["contest_id"]))[:300]
    some = log.join(log.sparkSession.createDataFrame([(r["contest_id"],) for r in rows], "contest_id long"), "contest_id")
    made = cut(performance.features_of(some))
    feats = {(r["contest_id"], r["contestant"]): r.asDict() for r in made.collect()}
    tau = {k: t for t, keys in attributes.TAU.items() for k in keys}
    stats, career, pools, expected = {}, {}, defaultdict(list), {}
    keys = {k for spec in attributes.TARGETS.values() for k in spec}

    scores, active, runs = defaultdict(lambda: dict.fromkeys(attributes.PERKS, 80.0)), defaultdict(set), defaultdict(int)

    def overall(s, who):
        normal = {k: min(1, max(0, (v - attributes.bounds(k)[0]) / (attributes.bounds(k)[1] - attributes.bounds(k)[0]))) for k, v in s.items()}
        base = 80 + 20 * sum(share * math.exp(sum(w * math.log(0.02 + normal[k]) for k, w in ws.items()) / sum(ws.values())) for share, ws in attributes.BUCKETS.values())
        return min(100, max(80, base + min(1.5, sum(c * normal[a] * normal[b] for a, b, c in attributes.SYNERGIES)) + sum(attributes.STRENGTH[attributes.PERKS[p][0]] for p in active[who])))

    for c in rows:
        who = (c["a"], c["b"])
        for w in who:
            stats.setdefault(w, dict.fromkeys(attributes.STATS, 85.0))
            career.setdefault(w, dict(mma=0, a=0, n=0, ko=0, sub=0, downs=0.0, kept=0.0, minutes=0.0))
        own = [feats.get((c["contest_id"], w)) for w in who]
        for w, f in zip(who, own, strict=True):
            if f and c["tier"] == "A" and career[w]["a"] >= 5:
                for k in keys:
                    v = {"ko_win_rate": 0.0, "sub_win_rate": 0.0, "total_fight_minutes": 0.0, "kd_survival_rate": 1.0}.get(k, f.get(k))
                    if v is not None:
                        insort(pools[c["division"], k], v)
                        insort(pools[None, k], v)
        before = [overall(stats[w], w) for w in who]
        if c["outcome"] != "NC":
            for w, f, other, won in zip(who, own, before[::-1], (c["outcome"] == "W", c["outcome"] == "L"), strict=True):
                s, h = stats[w], career[w]
                k = {"A": 1, "B": 0.6, "C": 0.4}[c["tier"]] / math.sqrt(1 + h["mma"] / 6) * (0.85 + 0.3 / (1 + math.exp(87 - other)))
                strength = c["promotion"]
                k *= ((0.55 if strength is None or strength < 0.6 else 0.8 if strength < 0.9 else 1.0) if c["sport"] == "mma" else 0.35 * math.exp(-h["mma"] / 5))
                if f:
                    f = f | {"ko_win_rate": h["ko"] / max(h["n"], 1), "sub_win_rate": h["sub"] / max(h["n"], 1), "total_fight_minutes": max(h["minutes"], 1e-9), "kd_survival_rate": h["kept"] / h["downs"] if h["downs"] > 0 else 1.0}
                    new = dict(s)
                    for stat, spec in attributes.TARGETS.items():
                        if c["sport"] != "mma" and stat not in attributes.FAMILIES[c["sport"]]:
                            continue
                        total = weight = 0.0
                        for key, part in spec.items():
                            if f[key] is None:
                                continue
                            pool = pools[c["division"], key] if len(pools[c["division"], key]) >= 15 else pools[None, key]
                            t = tau.get(key, 30.0)
                            own_part = h["a"] / (h["a"] + t)
                            share = bisect_left(pool, own_part * f[key] + (1 - own_part) * (sum(pool) / len(pool))) / len(pool) if pool else 0.5
                            total, weight = total + part * (1 - share if key in attributes.LESS_IS_BETTER else share), weight + part
                        if not weight:
                            continue
                        low, high = attributes.bounds(stat)
                        change = attributes.K_BASE[attributes.kind(stat)] * k * (round(low + (high - low) * total / weight, 2) - s[stat])
                        if won:
                            change += {"KO": attributes.KO_BONUS, "TKO": attributes.KO_BONUS, "SUB": attributes.SUB_BONUS}.get(c["method"], {}).get(stat, 0)
                        most = 4 if stat in attributes.HEALTH and change < 0 else 3 if stat in attributes.DIRECT else 2
                        new[stat] = min(high, max(low, s[stat] + min(most, max(-most, change))))
                    stats[w] = new
                    taken = f["kd_abs15"] * f["minutes"] / 15
                    h["downs"], h["kept"], h["minutes"] = h["downs"] + taken, h["kept"] + (taken if won else 0), h["minutes"] + f["minutes"]
                for p, (_, parts) in attributes.PERKS.items():
                    v = scores[w][p] = 0.9 * scores[w][p] + 0.1 * sum(part * stats[w][k] for k, part in parts.items())
                    up = 1 if v >= 88 or (v >= 80 and p in active[w]) else -1 if v < 80 else 0
                    runs[w, p] = runs[w, p] + up if up * runs[w, p] > 0 else up
                    if runs[w, p] >= 3:
                        active[w].add(p)
                    elif runs[w, p] <= -3:
                        active[w].discard(p)
                h["mma"] += c["sport"] == "mma"
                h["a"] += c["tier"] == "A"
                h["n"] += 1
                h["ko"] += won and c["method"] in ("KO", "TKO")
                h["sub"] += won and c["method"] == "SUB"
        for w in who:
            expected[c["contest_id"], w] = list(stats[w].values())
    found = attribute_fold.fold(some, made).collect()
    assert len(found) == 600
    near = [np.abs(np.array(r["stats"]) - expected[r["contest_id"], r["contestant"]]).max() for r in found]
    assert max(near) < 0.02 and np.mean(np.array(near) < 1e-9) > 0.9  # a target on the edge of two places may round either way
    sliced = {(r["contest_id"], r["contestant"]): r for r in attribute_fold.fold(some, made, bound=150, block=64).collect()}
    assert all(np.allclose(sliced[r["contest_id"], r["contestant"]]["stats"], r["stats"], atol=0.02) for r in found)


def test_perks_come_and_go_by_three_in_a_row():
    s = {k: np.array([v], float) for k, v in attribute_fold.START.items()}
    one = np.array([0])
    s["stats"][:], s["scores"][:] = 100.0, 90.0
    on = []
    for step in range(60):
        if step == 20:
            s["stats"][:] = 0.0
        attribute_fold.move_perks(s, one)
        on.append(bool(s["active"][0, 0]))
    assert on[:3] == [False, False, True] and on[20] and not on[-1]
    assert on.index(False, 3) > 22  # it stays until three scores in a row are below 80


def test_pools_do_not_depend_on_blocks(spark):
    """Against a loop over all earlier rows, in one block and in many; ties, nulls, nan and groups too small for a pool of their own."""
    r = random.Random(6)
    value = lambda: r.choice((0.0, 1.0, 1.0, 2.0, r.random(), r.random(), None, float("nan")))
    rows = [(place, 10 * place + side, place, r.choice(("x", "x", "x", "y", None)), r.random() < 0.4, r.random() < 0.7, float(r.choice((0, 3, 20))), [value() for _ in range(10)], [value() for _ in range(10)]) for place in range(1, 160) for side in (0, 1)]
    df = cut(spark.createDataFrame(rows, "contest_id long, contestant long, place long, grp string, enters boolean, asks boolean, n double, pool array<double>, values array<double>"))
    pulls, wanted = [float(k) for k in range(1, 11)], {}
    known = lambda v: v is not None and v == v
    for contest, who, place, grp, _, asks, n, _, values in rows:
        if not asks:
            continue
        out = []
        for k, v in enumerate(values):
            pool = [x[7][k] for x in rows if x[4] and x[2] <= place and known(x[7][k]) and x[3] == grp and grp is not None]
            if len(pool) < 15:
                pool = [x[7][k] for x in rows if x[4] and x[2] <= place and known(x[7][k])]
            w = n / (n + pulls[k])
            out.append(None if not known(v) else 0.5 if not pool else sum(p < w * v + (1 - w) * (math.fsum(pool) / len(pool)) for p in pool) / len(pool))
        wanted[contest, who] = out
    for block in (1000, 40, 7):
        found = {(x["contest_id"], x["contestant"]): x["shares"] for x in pools.growing_shares(df, pulls, 15, block).collect()}
        assert found.keys() == wanted.keys()
        for key, row in wanted.items():
            assert [v is None for v in found[key]] == [v is None for v in row]
            assert [v for v in found[key] if v is not None] == pytest.approx([v for v in row if v is not None], abs=1e-12), (block, key)


def test_pool_values_travel_in_packed_ranges(monkeypatch):
    """Blocks of a pool whose columns have several ranges, without Spark: shares as by a loop, and a row for each column, range and block, not for each value and level."""
    monkeypatch.setattr(pools, "RANGE", 40)
    r = random.Random(8)
    value = lambda: r.choice((0.0, 1.0, 1.0, r.random(), r.random(), r.random(), float("nan")))
    rows = [(p, p % 2, p, p // 20, r.random() < 0.5, r.random() < 0.8, 3.0, [value(), value()], [value(), value()]) for p in range(200)]
    names, pulls = ["contest_id", "contestant", "place", "block", "enters", "asks", "n", "pool", "values"], [2.0, 5.0]
    table = pa.table({n: [x[k] for x in rows] for k, n in enumerate(names)} | {"pool_name": ["gx"] * len(rows)})
    blocks = [table.filter(pa.compute.equal(table["block"], b)) for b in range(10)]
    before = pools.totals_before(pa.concat_tables([pools.block_totals(b) for b in blocks]))
    parts = pa.concat_tables([pools.block_parts(pulls)(b, before.filter(pa.compute.equal(before["block"], k))) for k, b in enumerate(blocks)])
    ranges = len(set(parts.filter(pa.compute.equal(parts["col"], 0))["part"].to_pylist()))
    assert ranges > 2 and len(parts) <= 10 * (2 * (ranges + 2) + 1)
    parts = parts.sort_by([(c, "ascending") for c in ("pool_name", "col", "part", "block")])
    answers = pa.Table.from_batches(list(pools.answered(iter(parts.to_batches(max_chunksize=7)))))
    found = {}
    for b in range(10):
        for x in pools.block_shares(15, pools.lists)(answers.filter(pa.compute.equal(answers["block"], b))).to_pylist():
            found[x["contest_id"]] = (x["whole"], x["shares"] if x["whole"] else x["open"])
    assert found.keys() == {x[0] for x in rows if x[5]}
    for x in (x for x in rows if x[5]):
        for k, v in enumerate(x[8]):
            pool = [y[7][k] for y in rows if y[4] and y[2] <= x[2] and y[7][k] == y[7][k]]
            w, got = 3 / (3 + pulls[k]), found[x[0]][1][k]
            assert got is None if v != v or len(pool) < 15 else got == sum(p < w * v + (1 - w) * math.fsum(pool) / len(pool) for p in pool) / len(pool)


def test_greedy_match_equals_plain_choice(spark):
    r = random.Random(2)
    pairs = {(r.randint(0, 25), r.randint(0, 25)): r.randint(1, 6) for _ in range(200)}
    left, right, expected = set(), set(), set()
    for (a, b), n in sorted(pairs.items(), key=lambda x: (-x[1], x[0])):
        if a not in left and b not in right:
            left.add(a)
            right.add(b)
            expected.add((a, b, n))
    rows = [(a, b, n) for (a, b), n in pairs.items()] + [(None, 3, 9), (4, None, 9)]
    found = joins.greedy_match(spark.createDataFrame(rows, "a int, b int, n int"), "a", "b", "n").collect()
    assert {tuple(x) for x in found} == expected
    assert not joins.greedy_match(spark.createDataFrame([], "a int, b int, n int"), "a", "b", "n").collect()


def test_forward_asof_edges(spark):
    day = datetime.date
    marks = spark.createDataFrame([(day(2020, 1, 5), 2), (day(2020, 1, 5), 1), (day(2020, 3, 1), 3), (None, 4)], "at date, mark int")
    rows = spark.createDataFrame([(1, day(2020, 1, 5)), (2, day(2020, 1, 6)), (3, day(2021, 1, 1)), (4, None), (5, day(1990, 1, 1)), (5, day(1990, 1, 1))], "k int, day date")
    found = sorted((r["k"], r["mark"]) for r in joins.forward_asof(rows, "day", marks, "at", "mark", salts=3).collect())
    assert found == [(1, 1), (2, 3), (3, 3), (4, 3), (5, 1), (5, 1)]


def test_running_totals_and_medians(spark):
    r = random.Random(5)
    rows = [(r.choice("ab") if r.random() > 0.1 else None, r.randint(0, 30), k) for k in range(500)]
    df = spark.createDataFrame(rows, "g string, v int, k int").withColumn("one", F.lit(1))
    found = {(x["g"], x["v"], x["k"]): x["t"] for x in analytics.running_total(df, ["g"], ["v", "k"], "one", "t").collect()}
    for g in ("a", "b", None):
        ordered = sorted((v, k) for h, v, k in rows if h == g)
        assert [found[g, v, k] for v, k in ordered] == list(range(1, len(ordered) + 1))
    wide = spark.createDataFrame([(float(v), None if v % 2 else v * 1.5) for _, v, _ in rows], "x double, y double")
    got = analytics.medians(wide, ["x", "y"]).first()
    assert got["x"] == np.median([float(v) for _, v, _ in rows]) and got["y"] == np.median([v * 1.5 for _, v, _ in rows if v % 2 == 0])


def test_missing_partners_raise(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    with pytest.raises(ValueError, match="1 rows"):
        joins.require_all(left, left.where("k = 1"), "k")


def test_labels(spark):
    assert spark.range(1).select(text.stable_uuid(F.lit("promotion:slug:x")).alias("u")).first()[0] == str(uuid.uuid5(uuid.NAMESPACE_URL, "promotion:slug:x"))
    rows = spark.createDataFrame([("Heavyweight",)], "raw string")
    old, new = (weights.weight_class(rows, F.col("raw"), F.lit("M"), F.lit(None).cast("string"), F.lit("mma"), heavyweight=h).first()["w"]["division"] for h in (False, True))
    assert (old, new) == ("MMA_UNKNOWN", "MMA_HW")


def test_participants_prefer_known_or_not(spark):
    p = spark.createDataFrame([(1, 10, 11, "W", None)], "contest_id int, contestant int, opponent int, outcome string, record string")
    s = spark.createDataFrame([(1, 10, 11, "UNKNOWN", "3-0")], p.schema)
    found = {(r["contestant"], r["outcome"], r["inferred"]) for prefer in (True, False) for r in joins.merge_participants(p, s, prefer).collect()}
    assert found == {(10, "W", False), (10, "UNKNOWN", False), (11, "UNKNOWN", True)}


def test_exports(spark, tmp_path):
    for name in exports.EXPORTS:
        columns = ["note", *{c: None for pair in exports.HEX_IDS.get(name, {}).items() for c in pair if c}]
        line = ['" a, ""b"" "', *["0123456789ABCDEF" if c in exports.HEX_IDS.get(name, {}) else "http://x/fight-details/00000000000000aA" for c in columns[1:]]]
        (tmp_path / f"{name}.csv").write_text(",".join(columns) + "\n" + ",".join(line) + "\n" + ",".join([""] * len(columns)) + "\n")
    frames = exports.load(spark, str(tmp_path))
    assert len(frames) == 15
    fights = sorted(frames["ufcstats_fights"].collect(), key=lambda r: r["note"] is None)
    assert fights[0]["ufcstats_fight_id"] == "00000000000000aa" and fights[0]["red_fighter_id"] == "0123456789abcdef" and fights[0]["note"] == 'a, "b"'
    for name, ids in exports.HEX_IDS.items():
        for r in frames[name].collect():
            assert all(r[c] is None or r[c] in ("0123456789abcdef", "00000000000000aa") for c in ids)


def test_features_of_missing_sides(spark):
    """Contests with neither rounds nor totals give no row; a side without counts leaves the contest out."""
    zero = ", ".join(f"{c} double" for c in features.COUNTS)
    one = [1.0] * len(features.COUNTS)
    rounds = spark.createDataFrame([(1, k, w, *one) for k in (0, 1, 2, 3) for w in (5, 6)] + [(2, 1, 5, *one)], f"contest_id int, round_num int, contestant int, {zero}")
    totals = spark.createDataFrame([(1, 5, *one), (1, 6, *one)], f"contest_id int, contestant int, {zero}")
    log = spark.createDataFrame([(1, 5, 6, 15.0), (2, 5, 6, 15.0), (3, 5, 6, 0.0)], "contest_id int, a int, b int, minutes double")
    found = features.bout_features(rounds, totals, log).collect()
    assert [(r["contest_id"], r["slpm"], r["late_output_ratio"]) for r in found] == [(1, pytest.approx(0.2), pytest.approx(1.0))] * 2
