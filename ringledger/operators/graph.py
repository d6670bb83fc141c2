"""Graph operators in DataFrame functions: connected components and PageRank.

Components alternate large-star and small-star steps: every step points the nodes of a neighbourhood at its smallest node, and the number of
steps grows with the logarithm of the component's size. Each step's edges are written to the shared checkpoint folder; nothing but one checksum a step
reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..session import cut


def components(edges: DataFrame, left: str = "u", right: str = "v", max_steps: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge; ``component`` is the smallest node reachable.

    Directions, repeated edges and loops do not matter; edges with a null end are ignored. Without edges the result is empty.
    """
    a, b = F.col(left), F.col(right)
    now = cut(edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    before = None
    for _ in range(max_steps):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor, "u")
        now = cut(small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(floor.select("u", F.col("m").alias("v"))).distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {max_steps} steps")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def result_edges(log: DataFrame) -> DataFrame:
    """(src, dst, w): from loser to winner; a draw gives half an edge each way, a contest without result none."""
    a, b, o = F.col("a"), F.col("b"), F.col("outcome")
    half = F.array(F.struct(a.alias("src"), b.alias("dst"), F.lit(0.5).alias("w")), F.struct(b.alias("src"), a.alias("dst"), F.lit(0.5).alias("w")))
    won = F.array(F.struct(b.alias("src"), a.alias("dst"), F.lit(1.0).alias("w")))
    lost = F.array(F.struct(a.alias("src"), b.alias("dst"), F.lit(1.0).alias("w")))
    edges = F.when(o == "W", won).when(o == "L", lost).when(o == "D", half)
    return log.select(F.explode(edges).alias("e")).select("e.*").groupBy("src", "dst").agg(F.sum("w").alias("w"))


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 200, tolerance: float = 1e-9) -> DataFrame:
    """(node, rank) by power iteration; the rank of nodes without ways out is spread evenly. Stops at an L1 change below ``tolerance``.

    Each step's ranks are written; one number a step reaches the driver.
    """
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    out = edges.groupBy("src").agg(F.sum("w").alias("total"))
    shares = cut(edges.join(out, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("share")))
    nodes = cut(nodes.join(out.select(F.col("src").alias("node"), F.lit(True).alias("leads")), "node", "left").select("node", F.coalesce("leads", F.lit(False)).alias("leads")))
    n = max(nodes.count(), 1)
    rank = nodes.withColumn("rank", F.lit(1.0 / n))
    for _ in range(rounds):
        given = shares.join(rank, shares.src == rank.node).groupBy("dst").agg(F.sum(F.col("share") * F.col("rank")).alias("given"))
        loose = rank.agg(F.coalesce(F.sum(F.when(~F.col("leads"), F.col("rank"))), F.lit(0.0)).alias("loose"))
        new = (1 - damping) / n + damping * (F.col("loose") / n + F.coalesce("given", F.lit(0.0)))
        rank = cut(rank.join(given, rank.node == given.dst, "left").join(F.broadcast(loose)).select("node", "leads", new.alias("rank"), F.abs(new - F.col("rank")).alias("change")))
        if (rank.agg(F.sum("change")).first()[0] or 0.0) < tolerance:
            break
        rank = rank.drop("change")
    return rank.select("node", "rank")


def win_probability(a: Column, b: Column) -> Column:
    """From two ranks: the logistic of the difference of their logarithms."""
    log = lambda c: F.ln(F.greatest(c, F.lit(1e-12)))
    return kernels.logistic(log(a) - log(b))


def connectivity(log: DataFrame) -> DataFrame:
    """Contests that touch each contestant."""
    return log.select(F.explode(F.array("a", "b")).alias("contestant")).groupBy("contestant").agg(F.count("*").alias("contests"))
