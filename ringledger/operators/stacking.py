"""Stacking of the systems' probabilities, and expected win rates against a reference pool."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import kernels
from ..session import cut
from . import folds, pools

# Fixed values of the stacking fit, and of the neutral contest of the expected win rates.
RATE, RIDGE, ROUNDS, MIN_SAMPLES = 0.05, 1e-3, 1500, 20
NEUTRAL_DAYS, MAX_DOUBT, DOUBT_SCALE = 120.0, 0.49, 800.0
MAX_LOGIT = float(np.log((1 - 1e-6) / 1e-6))
#: The reference pool is a fixed number of contestants, so broadcasting it is safe at any size.
POOL = 300
#: Labelled contests that are brought together for the fit (14 doubles each); the sums over more of them are made where they lie.
MAX_SAMPLES = 200_000
#: Steps of a stretch of the fit whose slopes are computed, those of them whose curvature is too, sweeps over a stretch, and how far slopes may lie from computed ones at these steps and between them.
NODES, BENDS, SWEEPS, MISS, BETWEEN = 16, 4, 12, 1e-13, 1e-11
SYSTEMS = ("elo", "glicko", "factor")


def reference_pool(activity: DataFrame, who: str, n: str, size: int = POOL, ties: tuple[str, ...] = ()) -> DataFrame:
    """The most active contestants; ties by ``ties``, then by id."""
    return activity.orderBy(F.desc(n), *ties, who).limit(size)


def expected_win_rate(contestants: DataFrame, pool: DataFrame, who: str, probability: Column, other: str = "other") -> DataFrame:
    """Mean probability over the pool, the contestant's own place left out; 0.5 where nobody is left. ``pool`` must be bounded (it is broadcast)."""
    met = contestants.join(F.broadcast(pool), F.col(who) != F.col(other), "left").withColumn("_p", probability)
    return met.groupBy(who).agg(F.coalesce(F.avg("_p"), F.lit(0.5)).alias("win_rate"))


def careers(mma_sides: DataFrame) -> DataFrame:
    """(contest_id, contestant, days, known): days since a contestant's last MMA contest (none: 999) and how many there were, in either role."""
    w = Window.partitionBy("contestant").orderBy(folds.order_of(mma_sides))
    return mma_sides.select("contest_id", "contestant", F.coalesce(F.datediff("day", F.lag("day").over(w)), F.lit(999)).alias("days"), (F.row_number().over(w) - 1).alias("known"))


def terms(logits: list[Column], tier: Column, rounds: Column, title: Column, days: Column, no_division: Column, no_promotion: Column, known: Column) -> Column:
    """The 14 terms of the fit; there is no network probability, so its logit and flag are 0."""
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    return F.array(
        F.lit(1.0), *logits, F.lit(0.0), F.lit(0.0), flag(tier == "A"), flag(tier == "B"), flag(rounds >= 5), flag(title),
        kernels.clip(days / 365.0, 0, 4), flag(no_division), flag(no_promotion), kernels.clip(known / 20.0, 0, 3))


def design(log: DataFrame, mma_sides: DataFrame, deltas: DataFrame, compat: bool = True) -> DataFrame:
    """(contest_id, x, won, mean) of every decided MMA contest: the terms of the fit for a, and whether a won.

    ``days`` are those of a and ``known`` the contests of b. With ``compat`` the first two systems' probabilities are those of the ratings after the
    contest, as the reference order has it; without it all are from before.
    """
    took = F.when(F.col("system") != "factor", F.col("expected_after")).otherwise(F.col("expected")) if compat else F.col("expected")
    p = deltas.withColumn("_p", took).groupBy("contest_id", "contestant").pivot("system", list(SYSTEMS)).agg(F.first("_p"))
    past = careers(mma_sides)
    rows = log.where("sport = 'mma' and outcome in ('W', 'L')").select("contest_id", "a", "b", "outcome", "tier", "rounds", "title", "division", "promotion")
    rows = rows.join(past.select("contest_id", F.col("contestant").alias("a"), "days"), ["contest_id", "a"]).join(past.select("contest_id", F.col("contestant").alias("b"), "known"), ["contest_id", "b"])
    rows = rows.join(p.withColumnRenamed("contestant", "a"), ["contest_id", "a"])
    c = F.col
    x = terms([kernels.logit(c(s)) for s in SYSTEMS], c("tier"), c("rounds"), c("title"), c("days"), c("division").isNull(), c("promotion").isNull(), c("known"))
    return rows.select("contest_id", x.alias("x"), F.when(c("outcome") == "W", 1.0).otherwise(0.0).alias("won"), (sum(c(s) for s in SYSTEMS) / 3).alias("mean"))


def summed(x: np.ndarray, y: np.ndarray, slopes_at: np.ndarray, bends_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the loss' gradients at weights (rows of ``slopes_at``) and of its second derivatives (at ``bends_at``), without the penalty."""
    with np.errstate(over="ignore"):
        p, q = (1 / (1 + np.exp(-(x @ w.T))) for w in (slopes_at, bends_at))
    return (p - y[:, None]).T @ x, np.stack([(x * v[:, None]).T @ x for v in (q * (1 - q)).T])


def packed(samples: DataFrame) -> DataFrame:
    """Batches of samples as one value each (``terms`` columns of x and the label)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.column_stack([pools.matrix(pa.Table.from_batches([b]), "x"), b.column("won").to_numpy(zero_copy_only=False)])
                yield pa.RecordBatch.from_arrays([pa.array([x.shape[1] - 1], pa.int32()), pa.array([pools.pack(x.T)], pa.binary())], ["terms", "rows"])

    return cut(samples.select("x", "won").mapInArrow(run, "terms int, rows binary"))


def sums_over(packs: DataFrame) -> Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """``summed`` over all packs: a task adds up its own, and gives one row."""

    def over(slopes_at: np.ndarray, bends_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for b in batches:
                for terms, rows in zip(b.column("terms").to_pylist(), b.column("rows"), strict=True):
                    x = unpacked(rows.as_py(), terms + 1)
                    found = np.concatenate([v.reshape(-1) for v in summed(x[:, :-1], x[:, -1], slopes_at, bends_at)])
                    total = found if total is None else total + found
            if total is not None:
                yield pa.RecordBatch.from_arrays([pools.lists(total[None, :])], ["sums"])

        total = sum(np.array(r["sums"], float) for r in packs.mapInArrow(run, "sums array<double>").collect())
        (k, size), m = slopes_at.shape, len(bends_at)
        return total[: k * size].reshape(k, size), total[k * size :].reshape(m, size, size)

    return over


def unpacked(rows: bytes, columns: int) -> np.ndarray:
    return np.ascontiguousarray(pools.unpack(rows, "f8").reshape(columns, -1).T)


def line_through(at: np.ndarray, length: int) -> np.ndarray:
    """Matrix from values at the steps ``at`` to those of their polynomial at each of ``length`` steps."""
    t = np.arange(length) / max(length - 1, 1)
    return np.stack([np.prod((t[:, None] - np.delete(t[at], j)) / (t[at[j]] - np.delete(t[at], j)), axis=1) for j in range(len(at))], axis=1)


def spread(length: int, most: int) -> np.ndarray:
    """At most ``most`` of ``length`` steps, denser towards both ends as interpolation wants them."""
    return np.arange(length) if length <= most else np.unique(np.rint((1 - np.cos(np.pi * np.arange(most) / (most - 1))) / 2 * (length - 1)).astype(int))


def descended(sums: Callable, n: int, size: int, rounds: int) -> np.ndarray:
    """The weights of ``rounds`` gradient steps from 0, with few passes over the rows.

    Slopes change smoothly from step to step. So of a stretch of steps those at ``NODES`` are computed in one pass, along a guessed path; those between lie on the polynomial through them. The path is
    stepped anew with these slopes, corrected by the curvature, until slopes computed along it are those it was stepped with. A stretch of at most ``NODES`` steps has nothing between; a longer one is
    halved where slopes computed between nodes are not on the polynomial, so the steps taken are those of the plain loop.
    """
    ridge = np.diag(np.concatenate([[0.0], np.full(size - 1, RIDGE)]))
    w, done, length = np.zeros(size), 0, NODES
    while done < rounds:
        length = min(length, rounds - done)
        at = spread(length, NODES)
        bent = at[spread(len(at), BENDS)]
        free = np.setdiff1d(np.arange(length), at)
        probes = free[np.unique(np.linspace(0, len(free) - 1, 3).astype(int))] if len(free) else free
        through, bending = line_through(at, length), line_through(bent, length)
        path, used, good = np.repeat(w[None], length, 0), None, False
        for _ in range(SWEEPS if len(free) else NODES + 2):
            slopes, bends = sums(path[np.concatenate([at, probes])], path[bent])
            slopes, bends = slopes / n + path[np.concatenate([at, probes])] @ ridge, bends / n + ridge
            base = through @ slopes[: len(at)]
            if used is not None and np.abs(used[at] - slopes[: len(at)]).max() <= MISS:
                good = np.abs(base[probes] - slopes[len(at) :]).max(initial=0.0) <= BETWEEN
                break
            bend, steps, used = np.tensordot(bending, bends, 1), [w], np.empty_like(path)
            for i in range(length):
                used[i] = base[i] + bend[i] @ (steps[i] - path[i])
                steps.append(steps[i] - RATE * used[i])
            path, end = np.array(steps[:-1]), steps[-1]
        if good or not len(free):
            w, done, length = end, done + length, 2 * length
        else:
            length //= 2
    return w


def fit(samples: DataFrame, rounds: int = ROUNDS, max_samples: int = MAX_SAMPLES) -> np.ndarray | None:
    """Weights after a fixed number of gradient steps on all samples (the fit is not run to convergence). Null with too few samples.

    Up to ``max_samples`` labelled contests are brought together, in the order of the contests, so that sums do not depend on how they were dealt. More of them stay where they are, and tasks add up their own.
    """
    n = samples.count()
    if n < MIN_SAMPLES:
        return None
    if n > max_samples:
        packs = packed(samples)
        return descended(sums_over(packs), n, packs.first()["terms"], rounds)
    rows = samples.select("contest_id", "x", "won").toPandas().sort_values("contest_id")
    x, y = np.stack(rows["x"].to_numpy()).astype(np.float64), rows["won"].to_numpy(np.float64)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(x @ w)))
        w -= RATE * (x.T @ (p - y) / len(y) + RIDGE * np.concatenate([[0.0], w[1:]]))
    return w


def predicted(x: Column, w: np.ndarray) -> Column:
    weighed = F.zip_with(x, F.array(*[F.lit(float(v)) for v in w]), lambda a, b: a * b)
    return kernels.logistic(F.aggregate(weighed, F.lit(0.0), lambda s, v: s + v))


def stack(log: DataFrame, mma_sides: DataFrame, deltas: DataFrame, compat: bool = True) -> DataFrame:
    """(contest_id, p, won); the mean of the three probabilities where there are too few samples."""
    rows = cut(design(log, mma_sides, deltas, compat))
    w = fit(rows)
    return rows.select("contest_id", (F.col("mean") if w is None else predicted(F.col("x"), w)).alias("p"), "won")


def win_rates(log: DataFrame, mma_sides: DataFrame, deltas: DataFrame, latest: DataFrame, compat: bool = True) -> DataFrame:
    """(contestant, win_rate, doubt, adjusted) of everyone with an MMA contest: mean stacked probability of a neutral contest (tier B, three rounds, a decision) against
    the most active ones, less the doubt that the factor rating leaves.

    ``latest`` has the last state of each contestant and system. The pool is 300 contestants at most, ties by who came first, and is broadcast.
    """
    w = fit(cut(design(log, mma_sides, deltas, compat)))
    came = F.min(F.struct(folds.order_of(mma_sides), F.col("contestant") > F.col("opponent")))
    active = mma_sides.groupBy("contestant").agg(F.count("*").alias("known"), came.alias("_came"))
    state = latest.groupBy("contestant").pivot("system", list(SYSTEMS)).agg(F.first(F.struct("rating", "rd", "latent")))
    now = cut(active.join(state, "contestant", "left").select(
        "contestant", "known", "_came", F.coalesce("elo.rating", F.lit(1500.0)).alias("elo"), F.coalesce("glicko.rating", F.lit(1500.0)).alias("glicko"), F.coalesce("glicko.rd", F.lit(350.0)).alias("glicko_rd"),
        F.coalesce("factor.latent", F.lit(0.0)).alias("latent"), F.least(F.lit(MAX_DOUBT), F.col("factor.rd") / DOUBT_SCALE).alias("doubt")))
    pool = reference_pool(now, "contestant", "known", ties=("_came",))
    theirs = pool.select(F.col("contestant").alias("other"), *[F.col(c).alias(f"{c}_other") for c in ("known", "elo", "glicko", "glicko_rd", "latent")])
    gap = lambda c: F.col(c) - F.col(f"{c}_other")
    dampening = 1 / F.sqrt(1 + 3 * F.pow(F.col("glicko_rd_other") / 173.7178 / F.pi(), 2))
    # The logit of a logistic is its argument, cut where the probability is.
    logits = [kernels.clip(g, -MAX_LOGIT, MAX_LOGIT) for g in (gap("elo") / 400.0, dampening * gap("glicko") / 173.7178, gap("latent"))]
    neutral = terms(logits, F.lit("B"), F.lit(3), F.lit(False), F.lit(NEUTRAL_DAYS), F.lit(False), F.lit(False), F.col("known_other"))
    rate = expected_win_rate(now, theirs, "contestant", sum(map(kernels.logistic, logits)) / 3 if w is None else predicted(neutral, w))
    return rate.join(now.select("contestant", "doubt"), "contestant").select("contestant", "win_rate", "doubt", (F.col("win_rate") - F.coalesce("doubt", F.lit(0.0))).alias("adjusted"))
