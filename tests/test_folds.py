"""The wave folds: the unified system against a plain loop, slices of any bound, states that pass on, and waves themselves."""

import datetime
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringledger.operators import folds
from ringledger.plans.contest import contests
from ringledger.session import cut

SF = "/root/testdata/sf0.001"
LOG = "contest_id long, day date, a long, b long, outcome string, sport string, method string, rounds int, title boolean, finish_round int, finish_seconds int, promotion double, tier string, margin double"


def made_log(seed: int, n: int, people: int) -> list[tuple]:
    """Draws, no-contests, other sports, unknown tiers, nulls wherever the log may have them."""
    r = random.Random(seed)
    rows = []
    for k in range(n):
        a, b = r.sample(range(people), 2)
        rows.append((k, datetime.date(2015, 1, 1) + datetime.timedelta(days=k // 3 * r.choice((1, 1, 2))), a, b, r.choice(("W", "W", "L", "L", "D", "NC", "UNKNOWN")), r.choice(("mma", "mma", "mma", "boxing", "judo", "chess")), r.choice(("KO", "TKO", "SUB", "DEC", "OTHER")),
                     r.choice((3, 5)), r.choice((True, False)), r.choice((0, 1, 2, 3, None)), r.choice((10, 299, None)), r.choice((None, 0.0, 0.3, 1.0)), r.choice(("A", "B", "C", "Z")), r.choice((None, r.uniform(-1, 1)))))
    return sorted(rows, key=lambda x: (x[1], x[0]))


@pytest.fixture(scope="module")
def odd(spark):
    return cut(spark.createDataFrame(made_log(3, 500, 24), LOG))


def sigmoid(x):
    return 1 / (1 + math.exp(-x))


def between(v, low, high):
    return max(low, min(v, high)) if low <= high else low if v < low else high


class Fighter:
    def __init__(self):
        self.base, self.rd, self.vol, self.mean = 1500.0, 300.0, 0.06, np.zeros(5)
        self.cov = np.diag([1.0, 1.2, 1.2, 1.0, 1.1])
        self.n = self.streak = self.finishes = 0
        self.last, self.past, self.peak = None, [], 1500.0

    def composite(self):
        return 0.55 * self.base + 0.45 * (1500 + 400 * self.mean[0])

    def rating(self):
        return max(self.composite(), 1500 + 0.35 * (self.peak - 1500)) if self.peak > 1500 else self.composite()


WEIGHTS = {"mma": [1, 0.3, 0.3, 0.2, 0.2], "boxing": [0, 1, 0, 0.2, 0.15], "judo": [0, 0, 1, 0.15, 0.2], "grappling": [0, 0, 1, 0.15, 0.2], "chess": [0.25, 0.45, 0.2, 0.2, 0.15]}


def plain_unified(ready, compat=True) -> dict:
    people, out = {}, {}
    for c in ready:
        x, y = (people.setdefault(p, Fighter()) for p in (c["a"], c["b"]))
        for p in (x, y):
            days = (c["day"] - p.last).days if p.last else 0
            if days > 0:
                p.rd = between(173.7178 * math.sqrt((p.rd / 173.7178) ** 2 + days / 30 * 0.05**2), 30, 350)
                p.cov = p.cov + days * np.diag([0.0007, 0.0010, 0.0010, 0.0008, 0.0009])
        w, finish = np.array(WEIGHTS[c["sport"]], float), c["method"] in ("KO", "TKO", "SUB")
        gap, m = float(w @ (x.mean - y.mean)), c["margin"] or 0.0
        skill = gap + 0.65 * m + 0.2 * ((c["promotion"] or 0.5) - 0.5) + (0.05 * (0.35 * abs(m) + 0.3 * gap) if finish else 0)
        form = between(0.5 + between(0.04 * (x.streak - y.streak), -0.12, 0.12), 0, 1)
        e = between(0.45 * sigmoid((x.base - y.base) / 400) + 0.40 * sigmoid(skill) + 0.15 * form, 1e-6, 1 - 1e-6)
        pre, t, ks = (x.rating(), y.rating()), e, (0.0, 0.0)
        decided, mma = c["outcome"] in ("W", "L"), c["sport"] == "mma"
        if c["outcome"] == "D":
            t = 0.5
        if decided:
            t = float(c["outcome"] == "W")
            if mma:
                t = between(c["base"], max(0.5, e + 0.01), 1.0) if c["outcome"] == "W" else between(c["base"], 0.0, min(0.5, e - 0.01))
        new = []
        if decided and mma:
            for p, q, own_e, own_t, upset in ((x, y, e, t, c["outcome"] == "W"), (y, x, 1 - e, 1 - t, c["outcome"] == ("W" if compat else "L"))):
                k = 28 * {"A": 1, "B": 0.85}.get(c["tier"], 0.7) * (1.1 if c["rounds"] >= 5 or c["title"] else 1) * (1.08 if finish else 1) * (1 + min(0.45 * abs(m), 0.4))
                k *= (1.2 if p.n < 5 else 1.0 if p.n < 12 else 0.9) * (0.88 if p.last and (c["day"] - p.last).days > 540 else 1.05)
                k *= 1 if c["promotion"] is None else between(0.85 + 0.3 * between(c["promotion"], 0, 1), 0.75, 1.12)
                k *= 1 + between(0.6 * (0.5 - own_e if upset else own_e - 0.5), 0, 0.4)
                k *= 1 + between(0.15 * (q.base - 1500) / 400, -0.15, 0.25)
                k *= 1 + 0.1 * max(0.0, 1 - 5 * float(np.std(p.past))) if len(p.past) >= 3 else 1
                k *= between(p.rd / 300, 0.5, 2)
                phi, other, s = p.rd / 173.7178, q.rd / 173.7178, 173.7178
                g = 1 / math.sqrt(1 + 3 * other**2 / math.pi**2)
                own = sigmoid(g * (p.base - q.base) / s)
                v = 1 / max(1e-9, g * g * own * (1 - own))
                vol = float(folds.volatility(phi, p.vol, v * g * (own_t - own), v))
                new.append((k, p.base + k * (own_t - sigmoid((p.base - q.base) / 400)), between(s / math.sqrt(1 / (phi**2 + vol**2) + 1 / v), 30, 350), vol))
            ks = new[0][0], new[1][0]
        if decided or (c["outcome"] == "D" and not mma):
            h = e * (1 - e) * w
            px, py = x.cov @ h, y.cov @ -h
            d = h @ px - h @ py + max(0.35 * 0 + 0.02, e * (1 - e))
            for p, own in ((x, px), (y, py)):
                p.mean = p.mean + own / d * (t - e)
                p.cov = p.cov - np.outer(own, own) / d
        if new:
            for p, (_, base, rd, vol), own, first in ((x, new[0], t, True), (y, new[1], 1 - t, False)):
                p.base, p.rd, p.vol = base, rd, vol
                if compat:
                    won = own != 0.5 and c["outcome"] == ("W" if own > 0.5 else "L")
                    lost = own != 0.5 and not won
                else:
                    won = (c["outcome"] == "W") == first
                    lost = not won
                p.streak = max(1, p.streak + 1) if won else min(-1, p.streak - 1) if lost else 0
                p.finishes += won and finish
                if c["margin"] is not None:
                    shown = (1 + c["margin"]) / 2
                    p.past = [*p.past, shown if (own > 0.5 if compat else first) else 1 - shown][-10:]
                p.peak = max(p.peak - 0.02 * (p.peak - 1500) if lost else p.peak, p.composite())
                p.n, p.last = p.n + 1, c["day"]
        for p, who, k, own_e, own_t, before in ((x, c["a"], ks[0], e, t, pre[0]), (y, c["b"], ks[1], 1 - e, 1 - t, pre[1])):
            out[c["contest_id"], who] = {"pre_rating": before, "post_rating": p.rating(), "expected": own_e, "target": own_t, "k": k, "rd": p.rd, "fights": p.n, "streak": p.streak, "peak": p.peak, "finish_rate": p.finishes / max(p.n, 1)}
    return out


def in_order(log):
    return sorted(folds.prepared(log).collect(), key=lambda r: (r["day"], r["contest_id"]))


@pytest.mark.parametrize("compat", [True, False])
@pytest.mark.parametrize("which", ["odd", "given"])
def test_unified_fold_equals_a_plain_loop(spark, odd, which, compat):
    log = odd if which == "odd" else contests(spark, SF)
    wanted = plain_unified(in_order(log), compat)
    found = {(r["contest_id"], r["contestant"]): r for r in folds.fold(log, ("unified",), compat=compat).collect()}
    assert found.keys() == wanted.keys()
    for key, row in wanted.items():
        assert {c: found[key][c] for c in row} == pytest.approx(row, abs=1e-7), key
        assert found[key]["expected_after"] is None is found[key]["latent"]


@pytest.mark.parametrize("bound", [1, 20, 500])
def test_slices_of_any_bound_give_the_same(spark, odd, bound):
    log, systems = odd.where("contest_id < 80"), ("elo", "unified")
    whole = {(r["system"], r["contest_id"], r["contestant"]): r for r in folds.fold(log, systems).collect()}
    parts = folds.sliced(cut(folds.numbers(folds.prepared(log))), bound)
    sizes = folds.largest_component(parts, "slice").collect()
    assert parts.count() == 80 and all(r["n"] <= bound for r in sizes)
    if bound > 1:  # one contest a slice would be as many jobs
        rows = folds.fold(log, systems, bound=bound).collect()
        assert len(rows) == len(whole)
        for r in rows:
            one = whole[r["system"], r["contest_id"], r["contestant"]].asDict()
            assert r.asDict() == pytest.approx(one, abs=1e-9, nan_ok=True)


def test_states_pass_on(spark, odd):
    whole, states = folds.fold_on(odd)
    middle = odd.agg(F.percentile_approx(F.unix_date("day"), 0.5)).first()[0]
    one, first = folds.fold_on(odd.where(F.unix_date("day") < middle))
    two, second = folds.fold_on(odd.where(F.unix_date("day") >= middle), states=first)
    key = lambda r: (r["system"], r["contest_id"], r["contestant"])
    parted = {key(r): r.asDict() for r in one.unionByName(two).collect()}
    for r in whole.collect():
        assert parted[key(r)] == pytest.approx(r.asDict(), abs=1e-9, nan_ok=True)
    a, b = ({(r["system"], r["contestant"]): r["state"] for r in s.collect()} for s in (states, second))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-9, nan_ok=True) for k in a)


def test_the_order_within_a_day_may_be_given(spark, odd):
    turned = odd.withColumn("seq", -F.col("contest_id"))
    wanted = plain_unified(sorted(folds.prepared(odd).collect(), key=lambda r: (r["day"], -r["contest_id"])))
    found = {(r["contest_id"], r["contestant"]): r["post_rating"] for r in folds.fold(turned, ("unified",)).collect()}
    assert found == pytest.approx({k: v["post_rating"] for k, v in wanted.items()}, abs=1e-7)
    assert found != {(r["contest_id"], r["contestant"]): r["post_rating"] for r in folds.fold(odd, ("unified",)).collect()}


def test_waves_touch_nobody_twice_and_keep_the_order():
    r = random.Random(2)
    for _ in range(30):
        pairs = [r.sample(range(12), 2) for _ in range(r.randint(0, 60))]
        a, b = np.array([p[0] for p in pairs], int), np.array([p[1] for p in pairs], int)
        seen, waves = {}, folds.waves(a, b)
        assert sorted(k for w in waves for k in w.tolist()) == list(range(len(pairs)))
        for wave in waves:
            people = [*a[wave], *b[wave]]
            assert len(people) == len(set(people))
            for k in wave:
                assert all(seen.get(p, -1) < k for p in pairs[k])
                seen |= dict.fromkeys(pairs[k], k)


def test_null_days_and_an_empty_log(spark, odd):
    rows = [(1, None, 1, 2, "W", "mma", "KO", 3, False, 1, 60, None, "A", 0.5), (2, datetime.date(2020, 1, 1), 1, 2, "L", "mma", "DEC", 3, False, None, None, None, "A", None)]
    found = folds.fold(spark.createDataFrame(rows, LOG), ("elo",)).orderBy("contest_id", "contestant").collect()
    assert [str(r["day"]) for r in found] == ["1900-01-01"] * 2 + ["2020-01-01"] * 2 and found[2]["fights"] == 2
    assert folds.fold(odd.where("false")).collect() == [] and folds.fold_on(odd.where(F.lit(False)))[1].collect() == []


def test_rows_of_one_component_are_opened_in_several_tasks(spark):
    """A chain of contests is one component, hence one task of the fold; what follows has its rows in many tasks, and all of them once."""
    n = 12_000
    log = spark.range(n).selectExpr(
        "id contest_id", "date_add(date'2000-01-01', cast(id % 3000 as int)) day", "id % 200 a", "id % 200 + 1 b", "case when id % 3 = 0 then 'W' else 'L' end outcome", "'mma' sport", "'KO' method", "3 rounds", "false title", "1 finish_round",
        "10 finish_seconds", "0.5D promotion", "'A' tier", "0.1D margin")
    found = folds.fold(log, ("elo",))
    assert found.selectExpr("spark_partition_id() p").distinct().count() > 1
    assert found.count() == found.select("contest_id", "contestant").distinct().count() == 2 * n
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == 2**31 - 1
