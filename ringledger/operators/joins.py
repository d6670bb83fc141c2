"""Joins that need more than one equality."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..session import cut
from . import analytics, folds


def forward_asof(left: DataFrame, left_time: str, marks: DataFrame, mark_time: str, mark_id: str, salts: int | None = None) -> DataFrame:
    """``left`` with the first mark at or after its time (ties: the smallest id); null times and those past the end get the last mark.

    Marks and rows are merged in one sorted sweep from the last time to the first, in which a running frame carries the mark met last. Rows are dealt
    over salts (as many as shuffle partitions) and the marks (the smaller side) repeated in each, so a time that many rows share does not gather in one task.
    """
    salts = salts or int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    last = marks.agg(F.max_by(F.struct(mark_time, mark_id), F.struct(F.col(mark_time), -F.col(mark_id))).alias("_last"))
    one = marks.where(F.col(mark_time).isNotNull()).groupBy(mark_time).agg(F.min(mark_id).alias("_id"))
    opened = one.select(F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"), F.col(mark_time).alias("_at"), F.lit(1).alias("_mark"), F.struct(F.col(mark_time), F.col("_id").alias(mark_id)).alias("_met"))
    rows = left.select("*", F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int").alias("_salt"), F.col(left_time).alias("_at"), F.lit(0).alias("_mark"))
    back = Window.partitionBy("_salt").orderBy(F.col("_at").desc_nulls_last(), F.desc("_mark")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = rows.unionByName(opened, allowMissingColumns=True).withColumn("_met", F.when(F.col("_at").isNotNull(), F.last("_met", ignorenulls=True).over(back))).where("_mark = 0")
    return met.join(F.broadcast(last)).select(*left.columns, F.coalesce("_met", "_last")[mark_id].alias(mark_id), F.coalesce("_met", "_last")[mark_time].alias(mark_time))


#: Pairs that one task may match by itself.
ONE_TASK = 200_000
MATCH_SCHEMA = pa.schema([("system", pa.string()), ("place", pa.int64()), ("contestant", pa.int64()), ("taken", pa.bool_()), ("state", pa.list_(pa.float64()))])


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs (left, right, weight) in order, those whose sides are both free."""
    lefts, rights = set(), set()
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            free = x not in lefts and y not in rights
            keep.append(free)
            if free:
                lefts.add(x)
                rights.add(y)
        yield batch.filter(pa.array(keep, pa.bool_()))


def _match_rows(name: str, states: folds.States, table: pa.Table) -> pa.RecordBatch:
    """Pairs in waves: a pair is taken if both its sides are free, and then they are not."""
    a, b = table.column("a").to_numpy(), table.column("b").to_numpy()
    both, n = states.rows(np.concatenate([a, b])), len(a)
    used, taken = states.data["fights"], np.zeros(n, bool)
    for at in folds.waves(a, b):
        x, y = both[at], both[at + n]
        taken[at] = free = (used[x] == 0) & (used[y] == 0)
        used[x[free]] = used[y[free]] = 1
    return pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(table.column("contest_id").to_numpy()), pa.nulls(n, pa.int64()), pa.array(taken), pa.nulls(n, pa.list_(pa.float64()))], schema=MATCH_SCHEMA)


def greedy_match(pairs: DataFrame, left: str, right: str, weight: str, one_task: int = ONE_TASK, bound: int = folds.MAX_TASK_CONTESTS) -> DataFrame:
    """One-to-one pairs as greedy choice by (-weight, left, right) gives them; null weights come last, pairs with a null side are left out.

    Up to ``one_task`` pairs are chosen in one pass of one task. More are a fold like that of the ratings: a pair reads and writes whether its two sides are free, so pairs are dealt by
    connected components and run in waves, and where a component has more than ``bound`` pairs, by slices of the order. Chains of falling weights, of any length, need no rounds.
    """
    order = [F.col("_w").desc_nulls_last(), F.col("_l"), F.col("_r")]
    named = pairs.select(F.col(left).alias("_l"), F.col(right).alias("_r"), F.col(weight).alias("_w"))
    rest = cut(named.where("_l is not null and _r is not null"))
    back = [F.col(x).alias(c) for x, c in (("_l", left), ("_r", right), ("_w", weight))]
    if rest.count() <= one_task:
        return rest.repartition(1).sortWithinPartitions(*order).mapInArrow(_choose, rest.schema).select(*back)
    placed = cut(analytics.running_totals(rest.dropDuplicates().withColumn("_one", F.lit(1)), [], order, {"_place": "_one"}).drop("_one"))

    def ids(c: str, odd: int) -> DataFrame:
        numbered = analytics.running_totals(placed.select(c).distinct().withColumn("_one", F.lit(1)), [], [c], {"_id": "_one"})
        return numbered.select(c, (2 * F.col("_id") + odd).cast("long").alias("ab"[odd]))

    rows = placed.select("_l", "_r", F.col("_place").alias("contest_id")).join(ids("_l", 0), "_l").join(ids("_r", 1), "_r").select("contest_id", F.lit(0).alias("day"), "a", "b")
    run = lambda with_states: folds.runner(_match_rows, {"match": {"fights": 0.0}}, MATCH_SCHEMA, with_states)
    found = folds.fold_rows(cut(rows), ("match",), run, "system string, place long, contestant long, taken boolean", None, bound, False)[0]
    return placed.join(found.where("taken").select(F.col("place").alias("_place")), "_place").select(*back)


def merge_sources(primary: DataFrame, secondary: DataFrame, key: str, unknown: str = "UNKNOWN") -> DataFrame:
    """Full outer merge: the secondary source's values win where known, the primary's fill in."""
    shared = [c for c in primary.columns if c in secondary.columns and c != key]
    p, s = primary.alias("p"), secondary.alias("s")
    known = lambda c: F.when(F.col(f"s.{c}").cast("string") != unknown, F.col(f"s.{c}"))
    return p.join(s, F.col(f"p.{key}") == F.col(f"s.{key}"), "full_outer").select(F.coalesce(f"s.{key}", f"p.{key}").alias(key), *[F.coalesce(known(c), F.col(f"p.{c}"), F.col(f"s.{c}")).alias(c) for c in shared])


def require_all(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``left`` if every key has a partner in ``right``; raises otherwise."""
    missing = left.join(right.select(key), key, "left_anti").count()
    if missing:
        raise ValueError(f"{missing} rows have no partner by {key}")
    return left


def latest_per_group(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each group by ``order``, in one partial aggregation."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_s")).select(*keys, "_s.*")


def final_snapshots(history: DataFrame, final_day: Column) -> DataFrame:
    """``history`` and, for every contestant and system without a row on the final day, the last state as of that day."""
    rest = [c for c in history.columns if c not in ("system", "contestant")]
    last = history.groupBy("system", "contestant").agg(F.max_by(F.struct(*rest), F.struct("day")).alias("_s"), F.coalesce(F.bool_or(F.col("day") == final_day), F.lit(False)).alias("_there"))
    missing = last.where("not _there").select("system", "contestant", "_s.*").withColumn("day", final_day)
    return history.unionByName(missing)


def lookup_with_fallback(rows: DataFrame, table: DataFrame, keys: list[str], value: str, fallback: dict[str, object]) -> DataFrame:
    """``rows`` with ``value`` of ``table`` by ``keys``, or by the same keys with some replaced as ``fallback`` says, else null. ``table`` is a small dimension with one row a key."""
    first = table.select(*keys, F.col(value).alias("_first"))
    fixed = F.lit(True)
    for k, v in fallback.items():
        fixed = fixed & (F.col(k) == F.lit(v))
    rest = [k for k in keys if k not in fallback]
    second = table.where(fixed).select(*rest, F.col(value).alias("_second"))
    joined = rows.join(first, keys, "left")
    if rest:
        joined = joined.join(second, rest, "left")
    else:  # one value for all
        one = second.limit(1).collect()
        joined = joined.withColumn("_second", F.lit(one[0]["_second"] if one else None).cast(table.schema[value].dataType))
    return joined.select(*rows.columns, F.coalesce("_first", "_second").alias(value))


def merge_participants(primary: DataFrame, secondary: DataFrame, prefer_known: bool = False) -> DataFrame:
    """One row a (contest, contestant) of two sources; opponents that only the other side names are inferred, with the outcome turned round.

    Both have (contest_id, contestant, opponent, outcome, record). The secondary source's outcome counts where it has a row, even if it is ``UNKNOWN``
    (with ``prefer_known`` only where it is known); other fields are filled from the primary.
    """
    keys = ["contest_id", "contestant"]
    p, s = primary.dropDuplicates(keys), secondary.dropDuplicates(keys)
    theirs = F.when(F.col("s.outcome") != "UNKNOWN", F.col("s.outcome")) if prefer_known else F.col("s.outcome")
    pick = lambda c: F.coalesce(f"s.{c}", f"p.{c}").alias(c)
    both = p.alias("p").join(s.alias("s"), keys, "full_outer").select(*keys, pick("opponent"), F.coalesce(theirs, "p.outcome", "s.outcome").alias("outcome"), pick("record"), F.lit(False).alias("inferred"))
    named = s.where("opponent is not null").select("contest_id", F.col("opponent").alias("contestant"), F.col("contestant").alias("opponent"), text.inverse_result(F.col("outcome")).alias("outcome"), F.lit(None).cast("string").alias("record"), F.lit(True).alias("inferred"))
    missing = named.join(both.select(*keys), keys, "left_anti").groupBy(*keys).agg(F.min_by(F.struct("opponent", "outcome", "record", "inferred"), "opponent").alias("x")).select(*keys, "x.*")
    return both.unionByName(missing)
