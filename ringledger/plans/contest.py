"""The contest log: pairs of suppliers that meet in an order, as one row a contest. Every rating operator reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import parts_for, read


def contests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contest_id, day, a, b (a < b), qa, qb, outcome (of a), sport, division, method, rounds, title, finish_round, finish_seconds, promotion, tier, margin.

    One shuffle by order serves the aggregation, the window and the pairing, as all are keyed by the order.
    """
    table = read(spark, sf_dir, "lineitem")
    lines = table.select("l_orderkey", "l_suppkey", "l_linenumber", "l_quantity").repartition(parts_for(table), "l_orderkey")
    sides = lines.groupBy("l_orderkey", "l_suppkey").agg(F.sum("l_quantity").alias("q"), F.min("l_linenumber").alias("line"))
    first = sides.withColumn("place", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("line", "l_suppkey"))).where("place <= 2")
    pair = first.groupBy("l_orderkey").agg(F.min(F.struct("l_suppkey", "q")).alias("x"), F.max(F.struct("l_suppkey", "q")).alias("y"), F.count("*").alias("sides")).where("sides = 2")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    k = F.col("contest_id")
    joined = pair.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("contest_id"), F.to_date("o_orderdate").alias("day"), F.col("x.l_suppkey").alias("a"), F.col("y.l_suppkey").alias("b"), F.col("x.q").alias("qa"), F.col("y.q").alias("qb"))
    rounds = F.when(k % 4 == 0, 5).otherwise(3)
    return joined.select(
        "*",
        F.when(k % 97 == 0, "NC").when(F.col("qa") > F.col("qb"), "W").when(F.col("qa") < F.col("qb"), "L").otherwise("D").alias("outcome"),
        F.when(k % 11 == 0, "boxing").when(k % 13 == 0, "grappling").otherwise("mma").alias("sport"),
        F.concat(F.lit("D"), (F.col("a") % 8).cast("string")).alias("division"),
        F.when(k % 5 == 0, "KO").when(k % 5 == 1, "TKO").when(k % 5 == 2, "SUB").otherwise("DEC").alias("method"),
        rounds.alias("rounds"),
        (k % 10 == 0).alias("title"),
        (1 + k % rounds).cast("int").alias("finish_round"),
        (k % 301).cast("int").alias("finish_seconds"),
        F.when(k % 7 != 0, (k % 10) / 10.0).alias("promotion"),
        F.when(k % 3 == 0, "A").when(k % 3 == 1, "B").otherwise("C").alias("tier"),
        ((F.col("qa") - F.col("qb")) / (F.col("qa") + F.col("qb"))).alias("margin"),
    )


def sides(log: DataFrame) -> DataFrame:
    """Two rows a contest, one for each contestant: contestant, opponent, result and what the contest has; no shuffle."""
    flip = F.create_map(*[F.lit(x) for x in ("W", "L", "L", "W", "D", "D", "NC", "NC")])
    shared = ["contest_id", "day", "sport", "division", "method", "rounds", "title", "finish_round", "finish_seconds", "promotion", "tier", *[c for c in ("seq",) if c in log.columns]]
    one = F.struct(F.col("a").alias("contestant"), F.col("b").alias("opponent"), F.col("qa").alias("q"), F.col("qb").alias("q_other"), F.col("outcome").alias("result"), F.col("margin").alias("edge"))
    two = F.struct(F.col("b").alias("contestant"), F.col("a").alias("opponent"), F.col("qb").alias("q"), F.col("qa").alias("q_other"), flip[F.col("outcome")].alias("result"), (0 - F.col("margin")).alias("edge"))
    return log.select(*shared, F.explode(F.array(one, two)).alias("side")).select(*shared, "side.*")


#: DuckDB text of the same views, put before the oracles' own parts.
CONTESTS_SQL = """
g as (select l_orderkey k, l_suppkey s, sum(l_quantity) q, min(l_linenumber) line from lineitem group by 1, 2),
f as (select *, row_number() over (partition by k order by line, s) place from g),
pr as (select k, min(s) a, max(s) b, arg_min(q, s) qa, arg_max(q, s) qb from f where place <= 2 group by k having count(*) = 2),
contests as (select k contest_id, cast(o_orderdate as date) as day, a, b, qa, qb,
    case when k % 97 = 0 then 'NC' when qa > qb then 'W' when qa < qb then 'L' else 'D' end outcome,
    case when k % 11 = 0 then 'boxing' when k % 13 = 0 then 'grappling' else 'mma' end sport, 'D' || (a % 8)::varchar division,
    case k % 5 when 0 then 'KO' when 1 then 'TKO' when 2 then 'SUB' else 'DEC' end as method,
    case when k % 4 = 0 then 5 else 3 end rounds, k % 10 = 0 title, (1 + k % case when k % 4 = 0 then 5 else 3 end)::int finish_round,
    (k % 301)::int finish_seconds, case when k % 7 <> 0 then (k % 10) / 10.0::double end promotion,
    case k % 3 when 0 then 'A' when 1 then 'B' else 'C' end tier, (qa - qb) / (qa + qb) margin
    from pr join orders on k = o_orderkey),
sides as (select contest_id, day, sport, division, method, rounds, title, finish_round, finish_seconds, promotion, tier, a contestant, b opponent, qa q, qb q_other, outcome result, margin edge from contests
    union all select contest_id, day, sport, division, method, rounds, title, finish_round, finish_seconds, promotion, tier, b, a, qb, qa,
    case outcome when 'W' then 'L' when 'L' then 'W' else outcome end, 0 - margin from contests)"""
