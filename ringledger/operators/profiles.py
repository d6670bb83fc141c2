"""All-time profiles: six pillars of robust scores over whole careers, and their composite.

Everything is one row a contestant after partial aggregations; medians and deviations are single rows, which are broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..session import cut, stored
from . import analytics, folds, joins

# Fixed values of the composite: each pillar's share, and the weights of its attributes.
PILLARS = {
    "peak": (0.25, {"peak_unified": 0.30, "peak_factor": 0.25, "peak_elo": 0.15, "peak_glicko": 0.10, "peak_three": 0.10, "peak_year": 0.10}),
    "longevity": (0.20, {"area": 0.40, "elite_days": 0.30, "span_years": 0.15, "fights": 0.15}),
    "schedule": (0.15, {"opponent_rating": 0.35, "beaten_rating": 0.30, "top_wins": 0.20, "upset_wins": 0.15}),
    "dominance": (0.20, {"win_rate": 0.30, "finish_rate": 0.25, "quality_of_win": 0.25, "performance": 0.20}),
    "championship": (0.10, {"title_wins": 0.45, "defenses": 0.35, "title_fights": 0.20}),
    "consistency": (0.10, {"rating_variance": -0.50, "streak": 0.50}),
}
#: Further facts of a career.
FACTS = ("wins", "losses", "draws", "ncs", "finish_wins", "decision_wins", "title_win_rate")
BASE, UPSET, ELITE, TOP = 1500.0, 0.40, (0.90, 1700.0), (0.75, 1600.0)


def robust_all(df: DataFrame, columns: list[str]) -> DataFrame:
    """Every column replaced by its robust z; medians of all columns come from one pass, their deviations from a second."""
    named = lambda row, mark: row.select(*[F.col(c).alias(f"{mark}{c}") for c in columns])
    centre = named(analytics.medians(df, columns), "_m_").join(df.agg(*[F.stddev_samp(c).alias(f"_s_{c}") for c in columns]))
    off = df.join(F.broadcast(centre))
    spread = analytics.medians(off.select(*[F.abs(F.col(c) - F.col(f"_m_{c}")).alias(c) for c in columns]), columns)
    off = off.join(F.broadcast(named(spread, "_d_")))
    scale = lambda c: F.when(F.col(f"_d_{c}") > 1e-9, 1.4826 * F.col(f"_d_{c}")).when(F.col(f"_s_{c}") > 1e-9, F.col(f"_s_{c}")).otherwise(1.0)
    return off.withColumns({c: kernels.clip((F.col(c) - F.col(f"_m_{c}")) / scale(c), -4, 4) for c in columns}).select(*df.columns)


def schedule(deltas: DataFrame, compat: bool = True) -> DataFrame:
    """Strength of the opponents: means of their ratings, upsets, spread of rating changes.

    With ``compat`` expectation and change are those of the opponent's side of a contest, so an upset is a win over one who was not expected to win; without it
    they are the contestant's own.
    """
    other = deltas.select("contest_id", F.col("opponent").alias("contestant"), F.col("pre_rating").alias("r"), F.col("expected").alias("e"), (F.col("post_rating") - F.col("pre_rating")).alias("change"))
    own = deltas.select("contest_id", "contestant", "result", F.col("expected").alias("own_e"), (F.col("post_rating") - F.col("pre_rating")).alias("own_change"))
    met = other.where("r > 0").join(own, ["contest_id", "contestant"])
    if not compat:
        met = met.withColumns({"e": F.col("own_e"), "change": F.col("own_change")})
    met = stored(met.select("contestant", "result", "r", "e", "change"))
    won = F.col("result") == "W"
    means = met.groupBy("contestant").agg(
        F.avg("r").alias("opponent_rating"), F.coalesce(F.avg(F.when(won, F.col("r"))), F.lit(0.0)).alias("beaten_rating"), F.count_if(won & (F.col("e") < UPSET)).alias("upset_wins"),
        F.when(F.count("*") >= 3, F.stddev_samp("change")).otherwise(0.0).alias("rating_variance"))
    top = analytics.nearest_rank(means.where("opponent_rating > 0"), "opponent_rating", *TOP)
    wins = met.where(won).join(F.broadcast(top)).groupBy("contestant").agg(F.count_if(F.col("r") >= F.col("nearest_rank")).alias("top_wins"))
    return means.join(wins, "contestant", "left")


def line_shape(line: DataFrame, elite: float) -> DataFrame:
    """(contestant, peak_three, area, elite_days, peak_year) of lines (contestant, day, v) of more than one point: ``analytics.rolling_peak``, ``capped_area`` and ``window_peak`` from one numbering of the points."""
    dealt, w = analytics.in_blocks(line, ["contestant"], ["day"], 2)
    before, gap = F.lag("v").over(w), F.datediff("day", F.lag("day").over(w))
    mean = F.when(F.col("_n") >= 3, F.avg("v").over(w.rowsBetween(-2, 0)))
    points = stored(dealt.withColumns({"_m": mean, "_gap": gap, "_before": before}).where("_own").select("contestant", "v", F.unix_date("day").alias("_d"), "_m", "_gap", "_before"))
    days, middle = F.least("_gap", F.lit(180)), (F.col("v") + F.col("_before")) / 2
    area, high = days * F.greatest(F.lit(0.0), middle - BASE), F.when(middle >= elite, days).otherwise(0)
    shape = points.groupBy("contestant").agg(
        F.count("*").alias("_points"), F.coalesce(F.max("_m"), F.avg("v")).alias("peak_three"), F.coalesce(F.sum(area), F.lit(0.0)).alias("area"), F.coalesce(F.sum(high), F.lit(0)).alias("elite_days"))
    year = analytics.ahead_peak(points.select("contestant", "v", "_d", F.coalesce(F.col("_gap") > 180, F.lit(False)).alias("_late")), "contestant", "v")
    return shape.where("_points > 1").drop("_points").join(year.withColumnRenamed("peak", "peak_year"), "contestant", "left")


def profiles(sides: DataFrame, deltas: DataFrame, min_fights: int = 8, compat: bool = True) -> DataFrame:
    """One row per contestant with at least ``min_fights`` contests and a win: attributes, raw score and z of every pillar, ``score``, and further facts (``FACTS``).

    ``sides`` is the log by contestant, ``deltas`` the folds of all systems. Missing attributes count as 0. Peaks and the line of ratings come from the last rating of
    each day, whatever its sport; with ``compat`` everyone also has their last rating on the log's last day, which adds a flat end to the line. A line of one point has no area and no best mean.
    """
    mma = sides.where("sport = 'mma'")
    won, finish, ps = F.col("result") == "W", kernels.is_finish(F.col("method")), (1 + F.col("edge")) / 2
    career = mma.groupBy("contestant").agg(
        F.count("*").alias("fights"), F.count_if(won).alias("wins"), F.coalesce(F.count_if(won) / F.nullif(F.count_if(F.col("result").isin("W", "L")), F.lit(0)), F.lit(0.0)).alias("win_rate"), F.coalesce(F.count_if(won & finish) / F.nullif(F.count_if(won), F.lit(0)), F.lit(0.0)).alias("finish_rate"),
        F.count_if(F.col("result") == "L").alias("losses"), F.count_if(F.col("result") == "D").alias("draws"), F.count_if(F.col("result") == "NC").alias("ncs"), F.count_if(won & finish).alias("finish_wins"), F.count_if(won & (F.col("method") == "DEC")).alias("decision_wins"),
        F.coalesce(F.count_if(won & F.col("title")) / F.nullif(F.count_if("title"), F.lit(0)), F.lit(0.0)).alias("title_win_rate"),
        F.count_if("title").alias("title_fights"), F.count_if(won & F.col("title")).alias("title_wins"), F.greatest(F.lit(0), F.count_if(won & F.col("title")) - 1).alias("defenses"),
        (F.datediff(F.max("day"), F.min("day")) / 365.25).alias("span_years"), F.avg(ps).alias("performance"), F.avg(F.greatest(F.lit(0.0), ps - 0.5)).alias("quality_of_win"))
    primary = lambda c: F.when(F.col("system") == "unified", F.col(c)).alias(c)
    order = [c for c in ("seq", "contest_id") if c in deltas.columns]
    deltas = stored(deltas.select("system", "contestant", "day", *order, "post_rating", *map(primary, ("opponent", "pre_rating", "expected"))))
    history = stored(deltas.groupBy("system", "contestant", "day").agg(F.max_by("post_rating", F.struct(*order)).alias("rating")))
    peaks = history.groupBy("contestant").pivot("system", ["unified", "factor", "elo", "glicko"]).agg(F.max("rating"))
    peaks = peaks.select("contestant", *[F.col(s).alias(f"peak_{s}") for s in ("unified", "factor", "elo", "glicko")])
    line = history.where("system = 'unified'")
    if compat:
        line = joins.final_snapshots(line, F.lit(sides.agg(F.max("day")).first()[0]))
    elite = analytics.nearest_rank(peaks.where(F.col("peak_unified") > BASE), "peak_unified", *ELITE).first()[0]
    shape = line_shape(line.select("contestant", "day", F.col("rating").alias("v")), elite)
    unified = deltas.where("system = 'unified'").join(mma.select("contest_id", "contestant", "result"), ["contest_id", "contestant"])
    parts = [career, peaks, shape, schedule(unified, compat), analytics.longest_streak(mma).withColumnRenamed("longest", "streak")]
    whole = parts[0].where((F.col("fights") >= min_fights) & (F.col("wins") > 0))
    for part in parts[1:]:
        whole = whole.join(part, "contestant", "left")
    attributes = [a for _, weights in PILLARS.values() for a in weights]
    whole = cut(whole.select("contestant", *FACTS, *[F.coalesce(F.col(a).cast("double"), F.lit(0.0)).alias(a) for a in attributes]))
    z = robust_all(whole.select("contestant", *attributes), attributes).select("contestant", *[analytics.weighted(weights).alias(f"z_{p}") for p, (_, weights) in PILLARS.items()])
    raw = cut(z.select("*", *[F.col(f"z_{p}").alias(f"raw_{p}") for p in PILLARS]))
    z = robust_all(raw, [f"z_{p}" for p in PILLARS]).withColumn("score", analytics.weighted({f"z_{p}": share for p, (share, _) in PILLARS.items()}))
    return whole.join(z, "contestant")
