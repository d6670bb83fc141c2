"""The attribute fold gives the columns and sides that are asked for, and no others, with the values of the whole fold."""

import pytest
from pyspark.sql import functions as F

from ringledger.operators import attribute_fold
from ringledger.plans import performance
from ringledger.plans.contest import contests
from ringledger.session import cut

SF = "/root/testdata/sf0.001"


def test_only_what_is_asked_for_leaves_the_fold(spark):
    """In slices; several contests of a contestant fall on one day."""
    log = cut(contests(spark, SF).withColumn("day", F.trunc("day", "month")))
    given = cut(performance.features_of(log))
    whole = cut(attribute_fold.fold(log, given))
    keyed = lambda rows, *keys: {tuple(r[k] for k in keys): r for r in rows.collect()}
    few = attribute_fold.fold(log, given, 400, columns=("contest_id", "contestant", "post_overall", "change"))
    assert few.columns == ["contest_id", "contestant", "post_overall", "change"]
    wanted, found = (keyed(rows, "contest_id", "contestant") for rows in (whole, few))
    assert found.keys() == wanted.keys()
    assert all((r["post_overall"], r["change"]) == pytest.approx((wanted[k]["post_overall"], sum(wanted[k]["changes"])), abs=1e-9) for k, r in found.items())
    last = attribute_fold.fold(log, given, 400, columns=attribute_fold.OF_DAY, by_day=True)
    snapshots, found = keyed(attribute_fold.snapshots(whole), "contestant", "day"), last.collect()
    assert {(r["contestant"], r["day"]) for r in found} == snapshots.keys() and len(found) == len(snapshots) < len(wanted)
    for r in found:
        s = snapshots[r["contestant"], r["day"]]
        assert all(r[c] == pytest.approx(s[c], abs=1e-9) for c in attribute_fold.OF_DAY if c not in ("contestant", "day"))
