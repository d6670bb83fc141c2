"""Contests reach the one task of a component as packs put by waves; what needs no states is done before and after."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ringledger.operators import folds
from ringledger.plans.contest import contests
from ringledger.session import cut

SF = "/root/testdata/sf0.001"


def test_the_one_task_gets_a_row_a_pack(spark):
    rows = cut(folds.numbers(folds.prepared(contests(spark, SF))))
    whole = folds.labelled(rows)
    size = folds.sizes(whole).first()
    reads = {s: [*folds.KEPT, "x", "y", "level", *folds.SYSTEMS[s].reads] for s in ("elo", "unified")}
    dealt = folds._dealt(whole, ("elo", "unified"), None, size, folds.in_waves, reads).withColumn("task", F.spark_partition_id()).collect()
    assert size["components"] == 1 and sorted(r["system"] for r in dealt) == ["elo", "unified"] and len({r["task"] for r in dealt}) == 2
    for r in dealt:
        table = pa.ipc.open_stream(r["rows"]).read_all()
        assert table.schema.names == reads[r["system"]] and table.num_rows == rows.count()
        assert (np.diff(table.column("level").to_numpy()) >= 0).all()
        ids = np.frombuffer(table.schema.metadata[b"ids"], np.int64)
        for own, place in (("a", "x"), ("b", "y")):
            assert (ids[table.column(place).to_numpy()] == table.column(own).to_numpy()).all()


@pytest.mark.parametrize("chunk", [7, 64])
def test_packs_of_any_size_give_the_same(spark, chunk, monkeypatch):
    log, systems = contests(spark, SF).where("contest_id < 400"), tuple(folds.SYSTEMS)
    key = lambda r: (r["system"], r["contest_id"], r["contestant"])
    whole = {key(r): r.asDict() for r in folds.fold(log, systems).collect()}
    monkeypatch.setattr(folds, "CHUNK", chunk)  # the number of ranges follows it here, packs in tasks keep theirs
    parts = {key(r): r.asDict() for r in folds.fold(log, systems).collect()}
    assert parts.keys() == whole.keys()
    for k, row in whole.items():
        assert parts[k] == pytest.approx(row, abs=1e-9, nan_ok=True), k


def test_newton_and_brackets_find_the_same_volatility():
    rng = np.random.default_rng(5)
    n = 20_000
    phi, sigma, variance = rng.uniform(0.1, 2.2, n), rng.uniform(0.03, 0.2, n), 10 ** rng.uniform(-1, 9, n)
    gain = rng.normal(size=n) * np.sqrt(phi * phi + variance) * 10 ** rng.uniform(-2, 3, n)  # most ordinary, some extreme
    found = folds.volatility(phi, sigma, gain, variance)
    fixed = phi * phi + variance
    wanted = np.exp(folds.bracketed(2 * np.log(sigma), fixed, gain * gain - fixed, folds.GLICKO["tau"]) / 2)
    assert found == pytest.approx(wanted, rel=1e-9)
