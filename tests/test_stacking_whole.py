"""The stacking fit takes every labelled contest, however many are brought together."""

from functools import partial

import numpy as np
import pandas as pd
import pytest

from ringledger.operators import folds, stacking
from ringledger.plans.contest import contests, sides
from ringledger.session import cut


def plain(x, y, rounds):
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        w = w - stacking.RATE * (x.T @ (1 / (1 + np.exp(-(x @ w))) - y) / len(y) + stacking.RIDGE * np.array([0, *w[1:]]))
    return w


@pytest.mark.parametrize(("scale", "rounds"), [(1.0, 1500), (3.0, 400), (8.0, 100)])
def test_a_fit_beyond_the_bound_takes_all_samples(spark, scale, rounds):
    """Also where steps overshoot (the last one)."""
    r = np.random.default_rng(5)
    n, s = 3000, r.normal(size=3000) * scale
    x = np.column_stack([np.ones(n), s + r.normal(size=n), 1.3 * s, np.zeros(n), r.random(n) < 0.3, np.minimum(r.exponential(0.5, n), 4)]).astype(float)
    y = (r.random(n) < 1 / (1 + np.exp(-s))).astype(float)
    samples = spark.createDataFrame(pd.DataFrame({"contest_id": np.arange(n), "x": x.tolist(), "won": y})).repartition(5).localCheckpoint()
    found = stacking.fit(samples, rounds=rounds, max_samples=100)
    assert found == pytest.approx(plain(x, y, rounds), abs=1e-9)
    assert stacking.fit(samples, rounds=rounds) == pytest.approx(found, abs=1e-9)


def test_win_rates_beyond_the_bound_are_those_of_all_samples(spark, monkeypatch):
    log = cut(contests(spark, "/root/testdata/sf0.001"))
    mma, deltas = sides(log.where("sport = 'mma'")), cut(folds.fold(log, ("elo", "glicko", "factor")))
    rates = lambda: {r["contestant"]: (r["win_rate"], r["adjusted"]) for r in stacking.win_rates(log, mma, deltas, folds.latest(deltas)).collect()}
    whole = rates()
    monkeypatch.setattr(stacking, "fit", partial(stacking.fit, max_samples=50))
    few = rates()
    assert few.keys() == whole.keys() and len(whole) > 1
    assert all(few[k] == pytest.approx(v, abs=1e-9) for k, v in whole.items())
