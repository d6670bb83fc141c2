"""Percentiles in pools that grow with the log, without a stream.

Values join a pool (of a group, and of all groups) as contests go by, and a row asks how many values of the pool so far lie below one of its own, which is first drawn to the pool's mean. What joins
and what is asked depends on the log alone, so the question is one of dominance: pool values that are earlier *and* smaller. The order is cut into blocks of a bounded number of contests.

* Inside a block, one task for each pool sorts the values step by step and looks the questions up.
* Across blocks, values and questions are dealt by column and range of value, packed as arrays, a row for each block. A task goes through the blocks of its range in order and keeps the range's values so
  far, equal ones as a count; what lies in lower ranges is added as numbers. So every value and question is shuffled once, however many blocks there are.

Only rows whose own group may be too small ask the pool of all, which the groups' counts by block tell; values that enter it after the last such row are left out of it, as nobody asks for them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stored

#: Contests of a block; values that are compared one by one before they are sorted in; values of a pool's column that share a range; bytes of an Arrow batch of packed arrays.
BLOCK, STEP, RANGE, BATCH = 1 << 16, 512, 1 << 20, 64 << 20
ALL = "*"
PLACES = 64

Finish = Callable[[np.ndarray], pa.Array]


def matrix(table: pa.Table, name: str) -> np.ndarray:
    """A column of lists of one length, as rows; nulls are nan."""
    flat = table.column(name).combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(flat), -1) if len(flat) else np.empty((0, 0))


def lists(values: np.ndarray) -> pa.Array:
    """Rows of a matrix; nan is null."""
    return pa.ListArray.from_arrays(np.arange(0, values.size + 1, max(values.shape[1], 1), dtype=np.int32), pa.array(values.reshape(-1), from_pandas=True)) if len(values) else pa.array([], pa.list_(pa.float64()))


def pack(values: np.ndarray) -> bytes:
    raw = np.ascontiguousarray(values).tobytes()
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def unpack(data: bytes, kind: str) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    return np.frombuffer(pa.decompress(data[8:], size, codec="zstd", asbytes=True) if size else b"", kind)


def earlier_and_smaller(values: np.ndarray, upto: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """For each question, how many of the first ``upto`` values lie below ``asked``."""
    out, order = np.zeros(len(asked), np.int64), np.argsort(upto, kind="stable")
    limits, below, start = upto[order], np.empty(0), 0
    for first in range(0, len(values) + 1, STEP):
        end = int(np.searchsorted(limits, first + STEP, "left"))
        here = order[start:end]
        step = values[first : first + STEP]
        if len(here):
            before = np.arange(len(step))[None, :] < (upto[here] - first)[:, None]
            out[here] = np.searchsorted(below, asked[here], "left") + ((step[None, :] < asked[here][:, None]) & before).sum(1)
        below, start = np.sort(np.concatenate([below, step]), kind="stable"), end
    return out


def block_totals(table: pa.Table) -> pa.Table:
    """Count and sum (as two doubles) of every column of a block's pool values, and places among them and the values that are asked."""
    enters, asks = (table.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("enters", "asks"))
    pool, asked = matrix(table, "pool")[enters], matrix(table, "values")[asks]
    sums = np.nansum(pool.astype(np.longdouble), 0)
    high, both = sums.astype(float), np.concatenate([pool, asked])
    known = np.sort(both, 0)  # nan last
    many = (~np.isnan(known)).sum(0)
    spots = (np.linspace(0, 1, PLACES)[:, None] * np.maximum(many - 1, 0)).astype(int)
    places = np.take_along_axis(known, spots, 0) if len(known) else np.full((PLACES, pool.shape[1]), np.nan)
    rows = [lists(v.reshape(1, -1)) for v in ((~np.isnan(pool)).sum(0).astype(float), high, (sums - high).astype(float), many.astype(float), places.T)]
    one = lambda c: table.column(c).slice(0, 1).combine_chunks()
    return pa.Table.from_arrays([one("pool_name"), one("block"), *rows], ["pool_name", "block", "n", "high", "low", "many", "places"])


def totals_before(table: pa.Table) -> pa.Table:
    """Of a pool's ``block_totals``: for each block what the blocks before it come to, and the inner edges of the ranges of each column, one after another, a nan at the end of each."""
    table = table.take(pa.array(np.argsort(table.column("block").to_numpy(), kind="stable")))
    n, sums = matrix(table, "n"), matrix(table, "high").astype(np.longdouble) + matrix(table, "low").astype(np.longdouble)
    before = lambda v: np.cumsum(np.concatenate([np.zeros((1, v.shape[1]), v.dtype), v]), 0)[:-1]
    held, carry, many = before(n), before(sums), matrix(table, "many")
    places, edges = matrix(table, "places").reshape(len(n), n.shape[1], PLACES), []
    for k in range(n.shape[1]):
        ranges = int(-(-many[:, k].sum() // RANGE)) or 1
        spots, weights = places[:, k].reshape(-1), np.repeat(many[:, k] / PLACES, PLACES)
        order = np.argsort(spots, kind="stable")
        order = order[~np.isnan(spots[order])]
        upto = np.cumsum(weights[order])
        at = np.searchsorted(upto, upto[-1] * np.arange(1, ranges) / ranges) if len(order) else []
        edges += [*np.unique(spots[order][at]).tolist(), np.nan]
    high = carry.astype(float)
    columns = [lists(held), lists(high), lists((carry - high).astype(float)), lists(np.tile(np.array(edges), (len(n), 1)))]
    return pa.Table.from_arrays([*[table.column(c).combine_chunks() for c in ("pool_name", "block")], *columns], ["pool_name", "block", "held", "high", "low", "edges"])


PARTS = {"pool_name": pa.string(), "block": pa.int64(), "col": pa.int32(), "part": pa.int64(), "held": pa.int64()} | {c: pa.binary() for c in "xyzuv"}
PART = "pool_name string, block long, col int, part long, held long, x binary, y binary, z binary, u binary, v binary"


def part_rows(rows: list[dict]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r.get(c) for r in rows], t) for c, t in PARTS.items()], list(PARTS))


def block_parts(pulls: list[float]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Of a block's rows and the totals before it: for each column and range the block's values (x) with their counts (y) and the drawn values that are asked (z), and a row (``col`` -1) of what is known of the
    asking rows: contest (x), contestant (y) and, column by column, the pool's size so far (z; -1 where nothing is asked), how many values of the block are earlier and smaller (u), and the range (v)."""

    def run(table: pa.Table, before: pa.Table) -> pa.Table:
        if not len(table):
            return part_rows([])
        table = table.take(pa.array(np.argsort(table.column("place").to_numpy(), kind="stable")))
        place, n = table.column("place").to_numpy(), table.column("n").to_numpy().astype(float)
        enters, asks = (table.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("enters", "asks"))
        pool, values, at = matrix(table, "pool"), matrix(table, "values"), np.flatnonzero(asks)
        row = np.cumsum(asks) - 1
        held, carry = matrix(before, "held")[0], (matrix(before, "high").astype(np.longdouble) + matrix(before, "low"))[0]
        edges = np.split(cut := matrix(before, "edges")[0], np.flatnonzero(np.isnan(cut)) + 1)
        key = {"pool_name": table.column("pool_name")[0].as_py(), "block": table.column("block")[0].as_py()}
        size, below, ranges = (np.full((len(pulls), len(at)), v, t) for v, t in ((-1, np.int64), (0, np.int64), (0, np.uint16)))
        out = []
        for k, pull in enumerate(pulls):
            entered = np.flatnonzero(enters & ~np.isnan(pool[:, k]))
            asking = np.flatnonzero(asks & ~np.isnan(values[:, k]))
            upto, joined = np.searchsorted(place[entered], place[asking], "right"), pool[entered, k]
            sums = np.concatenate([[0], np.cumsum(joined.astype(np.longdouble))])[upto] + carry[k]
            so_far, to = upto + held[k].astype(np.int64), row[asking]
            weight = n[asking] / (n[asking] + pull)
            drawn = weight * values[asking, k] + (1 - weight) * (sums / np.maximum(so_far, 1)).astype(float)
            inner = edges[k][:-1]
            size[k, to], below[k, to] = so_far, earlier_and_smaller(joined, upto, drawn)
            ranges[k, to] = mine = np.searchsorted(inner, drawn, "right")
            different, counts = np.unique(joined, return_counts=True)
            theirs = np.searchsorted(inner, different, "right")
            for p in range(len(inner) + 1):
                here = theirs == p
                if len(asking) or here.any():
                    out.append(key | {"col": k, "part": p, "x": pack(different[here]), "y": pack(counts[here].astype(np.int64)), "z": pack(drawn[mine == p]) if len(asking) else None})
        if len(at):
            ids = [pack(table.column(c).to_numpy()[at].astype(np.int64)) for c in ("contest_id", "contestant")]
            out.append(key | {"col": -1, "part": key["block"], "x": ids[0], "y": ids[1], "z": pack(size), "u": pack(below), "v": pack(ranges)})
        return part_rows(out)

    return run


class Held:
    """Different values in order with the sums of their counts, in runs whose lengths grow, so that one more run costs little."""

    def __init__(self) -> None:
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []
        self.total = 0

    def below(self, asked: np.ndarray) -> np.ndarray:
        out, order = np.zeros(len(asked), np.int64), np.argsort(asked)
        for values, upto in self.runs:
            out[order] += upto[np.searchsorted(values, asked[order], "left")]
        return out

    def add(self, values: np.ndarray, counts: np.ndarray) -> None:
        self.total += int(counts.sum())
        while self.runs and len(self.runs[-1][0]) <= 2 * len(values):
            other, upto = self.runs.pop()
            both, at = np.unique(np.concatenate([other, values]), return_inverse=True)
            values, counts = both, np.bincount(at, np.concatenate([np.diff(upto), counts]), len(both)).astype(np.int64)
        if len(values):
            self.runs.append((values, np.concatenate([[0], np.cumsum(counts)])))


def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of parts in the order of (pool, column, range, block): the questions' answers from the blocks before (x), and how many values the range holds so far. Rows of ``col`` -1 pass."""
    now, held = None, Held()
    for batch in batches:
        for row in batch.to_pylist():
            if row["col"] >= 0:
                key = row["pool_name"], row["col"], row["part"]
                if key != now:
                    now, held = key, Held()
                values, counts, questions = unpack(row["x"], "f8"), unpack(row["y"], "i8"), row["z"]
                row |= {"x": None, "y": None, "z": None}
                if questions is not None:
                    yield from part_rows([row | {"held": held.total, "x": pack(held.below(unpack(questions, "f8")))}]).to_batches()
                held.add(values, counts)
            else:
                yield from part_rows([row]).to_batches()


def block_shares(min_size: int, finish: Finish) -> Callable[[pa.Table], pa.Table]:
    """Of a block's answers: its asking rows with the shares. A row of a group's pool that is too small in some column is not ``whole``: its shares stand in ``open``, null where the pool of all is to be asked."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.select(["col", "part", "held", "x"]).filter(pc.greater_equal(table.column("col"), 0)).to_pylist()
        known = table.filter(pc.equal(table.column("col"), -1)).to_pylist()
        ids, who = (unpack(known[0][c], "i8") for c in "xy") if known else (np.empty(0, np.int64),) * 2
        pool_of_all, shares, whole = False, np.empty((0, 0)), np.ones(0, bool)
        if known:
            size, below, ranges = (unpack(known[0][c], t).reshape(-1, len(ids)) for c, t in (("z", "i8"), ("u", "i8"), ("v", "u2")))
            below, pool_of_all = below.copy(), known[0]["pool_name"] == ALL
            lower: dict[int, int] = {}
            for r in sorted(rows, key=lambda r: (r["col"], r["part"])):
                k = r["col"]
                at = np.flatnonzero((size[k] >= 0) & (ranges[k] == r["part"]))
                below[k, at] += unpack(r["x"], "i8") + lower.get(k, 0)
                lower[k] = lower.get(k, 0) + r["held"]
            asked = size >= 0
            shares = np.where(asked, np.where(size > 0, below / np.maximum(size, 1), 0.5), np.nan)
            if not pool_of_all:
                shares = np.where(size >= min_size, shares, np.nan)
                whole = (~asked | (size >= min_size)).all(0)
            else:
                whole = np.zeros(len(ids), bool)
            shares = shares.T
        done, rest = np.flatnonzero(whole), np.flatnonzero(~whole)
        order = np.concatenate([done, rest])
        made = pa.chunked_array([finish(shares[done]), pa.nulls(len(rest), finish(shares[:0]).type)]).combine_chunks() if len(ids) else finish(shares)
        left = pa.chunked_array([pa.nulls(len(done), pa.list_(pa.float64())), lists(shares[rest])]).combine_chunks() if len(ids) else lists(shares)
        columns = {"contest_id": pa.array(ids[order]), "contestant": pa.array(who[order]), "of_all": pa.array(np.full(len(order), pool_of_all)), "whole": pa.array(whole[order]), "shares": made, "open": left}
        return pa.Table.from_arrays(list(columns.values()), list(columns))

    return run


def growing_shares(rows: DataFrame, pulls: list[float], min_size: int, block: int = BLOCK, finish: Finish = lists, kind: str = "array<double>") -> DataFrame:
    """(contest_id, contestant, shares): for each asking row and column, the share of the pool so far that lies below the drawn value; ``finish`` may make something else (``kind``) of a matrix of shares, nan where null.

    ``rows``, which are read several times, have contest_id, contestant, ``place`` (the contest's number in the order), ``grp``, ``enters`` and ``asks`` (booleans, not null), ``n``, and arrays ``pool`` and ``values`` of ``len(pulls)`` doubles;
    nulls and nan among them neither join nor ask (share null). A contest's own values are in the pools already when it asks. Values are drawn to the mean of the pool by weight pulls / (n + pulls).
    The pool is that of the row's group, or of all groups where the group's has fewer than ``min_size`` values (a null group has none); without any value the share is one half. Groups are few.
    """
    spark, count = rows.sparkSession, len(pulls)
    rows = rows.where("enters or asks").withColumn("block", F.floor(F.col("place") / block).cast("long"))
    known = lambda k: F.count_if(F.col("pool")[k].isNotNull() & ~F.isnan(F.col("pool")[k]) & F.col("enters"))
    by_block = rows.where("grp is not null").groupBy("grp", "block").agg(F.array(*[known(k) for k in range(count)]).alias("n"))
    so_far = Window.partitionBy("grp").orderBy("block")
    enough = F.least(*[F.sum(F.col("n")[k]).over(so_far) for k in range(count)], F.lit(min_size)) >= min_size
    reached = by_block.select("grp", "block", enough.alias("enough")).where("enough").groupBy("grp").agg(F.min("block").alias("reached"))
    marked = rows.join(F.broadcast(reached), "grp", "left").withColumn("asks_all", F.col("asks") & (F.col("reached").isNull() | (F.col("block") <= F.col("reached"))))
    blocks, last = marked.agg(F.max("block"), F.max(F.when(F.col("asks_all"), F.col("block")))).first()
    leaf = ["contest_id", "contestant", "pool_name", "block", "place", "enters", "asks", F.col("n").cast("double").alias("n"), "pool", "values"]
    own = marked.where("grp is not null").withColumn("pool_name", F.concat(F.lit("g"), F.col("grp").cast("string"))).select(*leaf)
    of_all = marked.where(F.col("block") <= F.lit(-1 if last is None else last)).withColumns({"pool_name": F.lit(ALL), "asks": F.col("asks_all")}).where("enters or asks").select(*leaf)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(blocks or 0, 2000))
    dealt = own.unionByName(of_all).repartition(parts, "pool_name", "block")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    key, arrays = ["pool_name", "block"], lambda *c: ", ".join(f"{x} array<double>" for x in c)
    ended = dealt.groupBy(*key).applyInArrow(block_totals, f"pool_name string, block long, {arrays('n', 'high', 'low', 'many', 'places')}")
    before = ended.groupBy("pool_name").applyInArrow(totals_before, f"pool_name string, block long, {arrays('held', 'high', 'low', 'edges')}")
    cut = dealt.groupBy(*key).cogroup(before.groupBy(*key)).applyInArrow(block_parts(pulls), PART)
    by_range = cut.repartition(parts, "pool_name", "col", "part").sortWithinPartitions("pool_name", "col", "part", "block")
    answer = f"contest_id long, contestant long, of_all boolean, whole boolean, shares {kind}, open array<double>"
    found = stored(by_range.mapInArrow(answered, PART).repartition(parts, *key).groupBy(*key).applyInArrow(block_shares(min_size, finish), answer))
    side = lambda of_all, c: F.max(F.when(F.col("of_all") == of_all, F.col("open"))).alias(c)
    two = found.where("not whole").groupBy("contest_id", "contestant").agg(side(False, "own"), side(True, "others"))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), finish(matrix(pa.Table.from_batches([b]), "open"))], ["contest_id", "contestant", "shares"])

    # Rows that their group's pool answered in every column asked the pool of all in vain: these answers are left out.
    joined = two.join(found.where("whole").select("contest_id", "contestant"), ["contest_id", "contestant"], "left_anti")
    merged = joined.select("contest_id", "contestant", F.when(F.col("own").isNull(), F.col("others")).otherwise(F.zip_with("own", "others", lambda x, y: F.coalesce(x, y))).alias("open"))
    return found.where("whole").select("contest_id", "contestant", "shares").unionByName(merged.mapInArrow(close, f"contest_id long, contestant long, shares {kind}"))
