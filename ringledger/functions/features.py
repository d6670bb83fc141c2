"""Features of one contest for one contestant, from both sides' counts; all Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Counts of a round or of a whole contest.
COUNTS = ("kd", "sig_landed", "sig_attempted", "total_landed", "total_attempted", "td_landed", "td_attempted", "sub_attempts", "rev", "ctrl_seconds", "head_landed", "body_landed", "leg_landed", "distance_landed", "clinch_landed", "ground_landed")
TINY = 1e-9
ROUND_SECONDS = 300.0


def rate(part: Column, whole: Column) -> Column:
    return F.when(whole <= TINY, 0.0).otherwise(part / whole)


def at_least_tiny(c: Column) -> Column:
    return F.greatest(c, F.lit(TINY))


def contest_totals(rounds: DataFrame, keys: tuple[str, ...] = ("contest_id", "contestant")) -> DataFrame:
    """Sums of all counts over the rounds."""
    return rounds.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in COUNTS])


def contest_features(own: Column, other: Column, minutes: Column) -> dict[str, Column]:
    """The features that need no rounds, in the order of the percentile pool. What a contestant absorbs is a rate a minute."""
    m = at_least_tiny(minutes)
    seconds = at_least_tiny(minutes * 60.0)
    per15, landed = lambda c: 15.0 * c / m, at_least_tiny(own["sig_landed"])
    parts = ("head", "body", "leg", "distance", "clinch", "ground")
    short = {"distance": "dist"}
    slpm, sapm = own["sig_landed"] / m, other["sig_landed"] / m
    return (
        {
            "sig_acc": rate(own["sig_landed"], own["sig_attempted"]), "sig_def": 1.0 - rate(other["sig_landed"], other["sig_attempted"]),
            "head_evasion": 1.0 - rate(other["head_landed"], at_least_tiny(other["sig_attempted"])), "slpm": slpm, "sapm": sapm, "str_diff": slpm - sapm,
            "td15": per15(own["td_landed"]), "td_acc": rate(own["td_landed"], own["td_attempted"]), "td_def": 1.0 - rate(other["td_landed"], other["td_attempted"]),
            "sub15": per15(own["sub_attempts"]), "opp_sub15": per15(other["sub_attempts"]), "ctrl_share": own["ctrl_seconds"] / seconds, "opp_ctrl_share": other["ctrl_seconds"] / seconds,
            "rev15": per15(own["rev"]), "opp_rev15": per15(other["rev"]),
        }
        | {f"{short.get(p, p)}_share": own[f"{p}_landed"] / landed for p in parts}
        | {f"{short.get(p, p)}_sig_per_min": own[f"{p}_landed"] / m for p in parts}
        | {"kd15": per15(own["kd"]), "kd_abs15": per15(other["kd"])}
        | {f"{p}_abs15": other[f"{p}_landed"] / m for p in ("head", "body", "leg")}
    )


def output(c: Column) -> Column:
    return c["sig_landed"] + c["td_landed"] + c["sub_attempts"]


def phase_ratios(paired: DataFrame, keys: tuple[str, ...] = ("contest_id", "contestant")) -> DataFrame:
    """Output and absorption a minute after the second round over those before, and the other way; null with fewer than three rounds.

    ``paired`` has one row a round with structs ``own`` and ``other`` and the round's ``place`` among the contest's rounds, from 1.
    """
    early = F.col("place") <= 2
    total = lambda c, when: F.sum(F.when(when, c).otherwise(0.0))
    minutes = lambda when: at_least_tiny(total(F.lit(ROUND_SECONDS), when) / 60.0)
    out, taken = output(F.col("own")), F.col("other.sig_landed")
    pace = {(n, k): total(c, when) / minutes(when) for n, c in (("out", out), ("taken", taken)) for k, when in (("early", early), ("late", ~early))}
    enough = lambda c: F.when(F.count("*") >= 3, c)
    return paired.groupBy(*keys).agg(
        enough(pace["out", "late"] / at_least_tiny(pace["out", "early"])).alias("late_output_ratio"), enough(pace["taken", "late"] / at_least_tiny(pace["taken", "early"])).alias("late_abs_ratio"),
        enough(pace["out", "early"] / at_least_tiny(pace["out", "late"])).alias("early_output_ratio"))


FEATURES = (
    "sig_acc", "sig_def", "head_evasion", "slpm", "sapm", "str_diff", "td15", "td_acc", "td_def", "sub15", "opp_sub15", "ctrl_share", "opp_ctrl_share", "rev15", "opp_rev15", "head_share", "body_share", "leg_share", "dist_share", "clinch_share",
    "ground_share", "head_sig_per_min", "body_sig_per_min", "leg_sig_per_min", "dist_sig_per_min", "clinch_sig_per_min", "ground_sig_per_min", "kd15", "kd_abs15", "head_abs15", "body_abs15", "leg_abs15", "late_output_ratio", "late_abs_ratio", "early_output_ratio",
)


def bout_features(rounds: DataFrame, totals: DataFrame, contests: DataFrame) -> DataFrame:
    """(contest_id, contestant, minutes, FEATURES) of both sides of every contest: from the rounds that both sides have, else from the totals.

    ``rounds`` has (contest_id, round_num, contestant, COUNTS), ``totals`` the same without rounds, ``contests`` (contest_id, a, b, minutes). Contests with
    neither give no row. The rounds of a contest meet by one shuffle.
    """
    own = F.struct(*[F.col(c).cast("double").alias(c) for c in COUNTS])
    sides = contests.select("contest_id", "minutes", F.explode(F.array(F.struct(F.col("a").alias("contestant"), F.col("b").alias("opponent")), F.struct(F.col("b").alias("contestant"), F.col("a").alias("opponent")))).alias("s")).select("contest_id", "minutes", "s.*")
    by_round = rounds.where("round_num > 0").select("contest_id", "round_num", "contestant", own.alias("own"))
    other = by_round.select("contest_id", "round_num", F.col("contestant").alias("opponent"), F.col("own").alias("other"))
    paired = sides.join(by_round, ["contest_id", "contestant"]).join(other, ["contest_id", "round_num", "opponent"])
    numbered = paired.groupBy("contest_id", "contestant").agg(F.array_sort(F.collect_list(F.struct("round_num", "own", "other"))).alias("rounds"))  # a contest has few rounds
    paired = numbered.select("contest_id", "contestant", F.posexplode("rounds").alias("place", "r")).select("contest_id", "contestant", (F.col("place") + 1).alias("place"), "r.own", "r.other")
    sums = [F.struct(*[F.sum(f"{s}.{c}").alias(c) for c in COUNTS]).alias(s) for s in ("own", "other")]
    of_rounds = paired.groupBy("contest_id", "contestant").agg(*sums).join(phase_ratios(paired), ["contest_id", "contestant"])
    whole = totals.select("contest_id", "contestant", own.alias("own"))
    of_totals = sides.join(whole, ["contest_id", "contestant"]).join(whole.select("contest_id", F.col("contestant").alias("opponent"), F.col("own").alias("other")), ["contest_id", "opponent"])
    joined = sides.join(of_rounds.withColumn("_by", F.lit(1)), ["contest_id", "contestant"], "left").join(of_totals.select("contest_id", "contestant", F.col("own").alias("own2"), F.col("other").alias("other2")), ["contest_id", "contestant"], "left")
    joined = joined.withColumns({"own": F.coalesce("own", "own2"), "other": F.coalesce("other", "other2")}).where("own is not null")
    made = contest_features(F.col("own"), F.col("other"), F.col("minutes"))
    return joined.select("contest_id", "contestant", "minutes", *[c.alias(k) for k, c in made.items()], "late_output_ratio", "late_abs_ratio", "early_output_ratio")
