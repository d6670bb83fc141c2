"""Ordered analytics over contest histories: streaks, peaks, areas, robust scores, exact percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut


#: Rows of one group that a window takes at once.
BLOCK = 4096


def in_blocks(df: DataFrame, group: list[str], order: list[str | Column], back: int, block: int = BLOCK) -> tuple[DataFrame, Window]:
    """``df`` for windows that look ``back`` rows behind, without a task that sees a whole group: rows are numbered by ranges (``_n``) and dealt in blocks of consecutive ones. The last ``back`` rows of a
    block also stand, with ``_own`` false, before the next. Compute over the window that is returned, then keep ``_own`` rows.
    """
    block = max(block, back)
    numbered = running_totals(df.withColumn("_one", F.lit(1)), group, order, {"_n": "_one"}).drop("_one")
    own = F.floor((F.col("_n") - 1) / block)
    ends = (F.col("_n") - 1) % block >= block - back
    there = F.when(ends, F.array(F.struct(own.alias("_block"), F.lit(True).alias("_own")), F.struct((own + 1).alias("_block"), F.lit(False).alias("_own")))).otherwise(F.array(F.struct(own.alias("_block"), F.lit(True).alias("_own"))))
    dealt = numbered.withColumn("_b", F.explode(there)).select(*numbered.columns, "_b.*")
    return dealt, Window.partitionBy(*group, "_block").orderBy("_n")


def longest_streak(sides: DataFrame, who: str = "contestant", result: str = "result", order: tuple[str, ...] = ("day", "contest_id")) -> DataFrame:
    """Most wins in a row; losses and draws end a streak, no-contests do not. Streaks are told apart by the breaks before them, counted by ranges."""
    broken = sides.select(who, result, *order, F.when(F.col(result).isin("L", "D"), 1).otherwise(0).alias("_break"))
    islands = running_totals(broken, [who], list(order), {"_island": "_break"})
    return islands.groupBy(who, "_island").agg(F.count_if(F.col(result) == "W").alias("n")).groupBy(who).agg(F.max("n").alias("longest"))


def rolling_peak(series: DataFrame, who: str, value: str, order: tuple[str, ...], size: int = 3, block: int = BLOCK) -> DataFrame:
    """Best mean of ``size`` values in a row; the plain mean where there are fewer."""
    dealt, w = in_blocks(series.select(who, value, *order), [who], list(order), size - 1, block)
    mean = F.when(F.col("_n") >= size, F.avg(value).over(w.rowsBetween(-(size - 1), 0)))
    return dealt.withColumn("_m", mean).where("_own").groupBy(who).agg(F.coalesce(F.max("_m"), F.avg(value)).alias("peak"))


def window_peak(series: DataFrame, who: str, value: str, day: str, days: int = 365, gap: int = 180, block: int = BLOCK) -> DataFrame:
    """Best mean over a forward window of ``days`` from each point (one a day); points that follow a longer gap than ``gap`` count only as a start."""
    dealt, w = in_blocks(series.select(who, value, F.unix_date(day).alias("_d")), [who], ["_d"], 1, block)
    marked = dealt.withColumn("_late", F.coalesce(F.col("_d") - F.lag("_d").over(w) > gap, F.lit(False))).where("_own")
    return ahead_peak(marked, who, value, days)


def ahead_peak(marked: DataFrame, who: str, value: str, days: int = 365) -> DataFrame:
    """``window_peak`` of points with their day as a number (``_d``), and whether they follow a long gap (``_late``).

    Points are dealt in stretches of several windows' days; those that an earlier stretch's windows reach stand in that one too.
    """
    long = 8 * (days + 1)
    own, reached = F.floor(F.col("_d") / long), F.floor((F.col("_d") - days) / long)
    marked = marked.withColumn("_stretch", F.explode(F.array_distinct(F.array(own, reached)))).withColumn("_start", F.col("_stretch") == own)
    ahead = Window.partitionBy(who, "_stretch").orderBy("_d").rangeBetween(0, days)
    use = F.when(~F.col("_late"), F.col(value))
    total = F.sum(use).over(ahead) + F.when(F.col("_late"), F.col(value)).otherwise(0.0)
    n = F.count(use).over(ahead) + F.when(F.col("_late"), 1).otherwise(0)
    return marked.withColumn("_m", F.coalesce(total, F.col(value)) / F.greatest(n, F.lit(1))).where("_start").groupBy(who).agg(F.max("_m").alias("peak"))


def capped_area(series: DataFrame, who: str, value: str, day: str, base: float = 1500.0, cap: int = 180, elite: float = 1600.0, block: int = BLOCK) -> DataFrame:
    """Trapezoid area above ``base`` with gaps capped, and days whose midpoint is elite."""
    dealt, w = in_blocks(series.select(who, value, day), [who], [day], 1, block)
    days = F.least(F.datediff(day, F.lag(day).over(w)), F.lit(cap))
    middle = (F.col(value) + F.lag(value).over(w)) / 2
    parts = dealt.select(who, "_own", (days * F.greatest(F.lit(0.0), middle - base)).alias("_a"), F.when(middle >= elite, days).otherwise(0).alias("_e")).where("_own")
    return parts.groupBy(who).agg(F.coalesce(F.sum("_a"), F.lit(0.0)).alias("area"), F.coalesce(F.sum("_e"), F.lit(0)).alias("elite_days"))


def running_means(df: DataFrame, who: str, value: str, order: tuple[str, ...], size: int = 10, block: int = BLOCK) -> DataFrame:
    """``df`` with ``n`` and ``mean`` of up to ``size`` values of the contestant, up to and with the row's own."""
    dealt, w = in_blocks(df, [who], list(order), size - 1, block)
    last = w.rowsBetween(-(size - 1), 0)
    return dealt.withColumns({"n": F.count(F.lit(1)).over(last), "mean": F.avg(value).over(last)}).where("_own").select(*df.columns, "n", "mean")


def by_range(df: DataFrame, group: list[str], order: list[str | Column]) -> DataFrame:
    """``df`` range-partitioned by group and order and written, with the number of its range (``_range``). Rows that are equal in both share a range."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(parts, *group, *order).withColumn("_range", F.spark_partition_id()))


def carried(parts: DataFrame, group: list[str], columns: dict[str, Column]) -> DataFrame:
    """(group, _range, columns) for the ranges that do not begin their group. Ranges follow one another, so only one group can go on from one
    range into the next: these are fewer rows than there are ranges, whatever the data."""
    first = F.min("_range").over(Window.partitionBy(*group))
    return parts.withColumn("_first", first).withColumns(columns).where("_range > _first").select(*group, "_range", *columns)


def joined_by(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join of the few rows of ``carried``; null keys are equal."""
    extra = [c for c in right.columns if c not in keys]
    both = left.alias("p").join(F.broadcast(right).alias("q"), [F.col(f"p.{c}").eqNullSafe(F.col(f"q.{c}")) for c in keys], "left")
    return both.select("p.*", *[f"q.{c}" for c in extra])


def running_totals(df: DataFrame, group: list[str], order: list[str | Column], sums: dict[str, str], exclusive: bool = False) -> DataFrame:
    """``df`` with the sums of columns (new name -> column) over the rows of its group up to and with those that are equal in ``order``, or before its own row with ``exclusive``.

    No task sees a whole group: rows are range-partitioned and written, each range is summed on its own, and what lies before it comes from one row a
    group and range. Without rows before, an exclusive sum is 0.
    """
    placed = by_range(df, group, order)
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy(*group, "_range").agg(*[F.sum(c).alias(f"_s_{o}") for o, c in sums.items()])
    before = carried(parts, group, {f"_b_{o}": F.sum(f"_s_{o}").over(earlier) for o in sums})
    within = Window.partitionBy("_range", *group).orderBy(*order)
    within = within.rowsBetween(Window.unboundedPreceding, -1) if exclusive else within.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    summed = placed.withColumns({f"_w_{o}": F.sum(c).over(within) for o, c in sums.items()})
    none = lambda c: F.coalesce(c, F.lit(0))
    return joined_by(summed, before, ["_range", *group]).select(*df.columns, *[(none(f"_b_{o}") + none(f"_w_{o}")).alias(o) for o in sums])


def running_total(df: DataFrame, group: list[str], order: list[str | Column], n: str, out: str) -> DataFrame:
    """``running_totals`` of one column; ``order`` must tell rows of a group apart."""
    return running_totals(df, group, order, {out: n})


def medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the exact median of each column, nulls left out, from counts of its distinct values."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns])).alias("x")).select("x.*").where("value is not null")
    counts = running_total(long.groupBy("name", "value").agg(F.count("*").alias("n")), ["name"], ["value"], "n", "upto")
    total = counts.groupBy("name").agg(F.sum("n").alias("all"))
    spot = lambda k: (F.col("upto") > k) & (F.col("upto") - F.col("n") <= k)
    low, high = F.floor((F.col("all") - 1) / 2), F.floor(F.col("all") / 2)
    met = counts.join(F.broadcast(total), "name").where(spot(low) | spot(high))
    middle = met.groupBy("name").agg(((F.min("value") + F.max("value")) / 2).alias("m"))
    return middle.groupBy().pivot("name", columns).agg(F.first("m"))


def nearest_rank(df: DataFrame, value: str, p: float, fallback: float) -> DataFrame:
    """The value at index min(n - 1, floor(n p)) of the sorted values, from counts of the distinct ones."""
    counts = running_total(df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n")), [], [value], "n", "upto")
    total = counts.agg(F.sum("n").alias("all"))
    wanted = F.least(F.col("all") - 1, F.floor(F.col("all") * p))
    return counts.join(F.broadcast(total)).where(F.col("upto") > wanted).agg(F.coalesce(F.min(value), F.lit(fallback)).alias("nearest_rank"))


def robust_z(df: DataFrame, value: str, out: str = "z") -> DataFrame:
    """(x - median) / (1.4826 MAD), or by the sample deviation where the MAD is 0, or by 1; cut at 4."""
    centre = medians(df, [value]).withColumnRenamed(value, "_m").join(df.agg(F.stddev_samp(value).alias("_s")))
    off = df.join(F.broadcast(centre))
    spread = medians(off.select(F.abs(F.col(value) - F.col("_m")).alias("_mad")), ["_mad"])
    scale = F.when(F.col("_mad") > 1e-9, 1.4826 * F.col("_mad")).when(F.col("_s") > 1e-9, F.col("_s")).otherwise(1.0)
    z = (F.col(value) - F.col("_m")) / scale
    return off.join(F.broadcast(spread)).withColumn(out, F.greatest(F.lit(-4.0), F.least(F.lit(4.0), z))).drop("_m", "_s", "_mad")


def strict_percentile(df: DataFrame, group: list[str], value: str, out: str = "percentile") -> DataFrame:
    """Share of the group strictly below, with the row's own group as pool; from counts of the group's distinct values, so no task holds a group."""
    counts = running_total(df.groupBy(*group, value).agg(F.count("*").alias("_n")), group, [value], "_n", "_upto")
    pool = counts.groupBy(*group).agg(F.sum("_n").alias("_all"))
    same = lambda x, y, keys: [F.col(f"{x}.{c}").eqNullSafe(F.col(f"{y}.{c}")) for c in keys]
    shares = counts.alias("c").join(pool.alias("g"), same("c", "g", group)).select(*[f"c.{c}" for c in (*group, value)], ((F.col("_upto") - F.col("_n")) / F.col("_all")).alias("_share"))
    return df.alias("d").join(shares.alias("s"), same("d", "s", [*group, value])).select("d.*", F.col("s._share").alias(out))


def rank_in_group(df: DataFrame, group: list[str], order: list[str | Column], out: str = "rank") -> DataFrame:
    """Row numbers within groups, of which none is sorted in one task; ``order`` must tell rows apart."""
    return running_total(df.withColumn("_one", F.lit(1)), group, order, "_one", out).drop("_one").withColumn(out, F.col(out).cast("int"))


def weighted(parts: dict[str, float]) -> Column:
    return sum((F.col(c) * v for c, v in parts.items()), F.lit(0.0))


def page(df: DataFrame, order: list[Column], limit: int = 25, offset: int = 0, most: int = 200) -> DataFrame:
    """One page of a sorted listing (limit 1..``most``)."""
    if not 1 <= limit <= most or offset < 0:
        raise ValueError(f"limit must be 1..{most} and offset not negative")
    return df.orderBy(*order).offset(offset).limit(limit)
