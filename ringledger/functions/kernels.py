"""Numeric kernels as Column expressions: all stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the performance score.
PS = {
    "prior": {"kd": 0.20, "sig": 5.0, "ctrl": 45.0, "sub": 0.40, "td": 1.0, "rev": 0.25, "acc": 6.0, "pace": 20.0},
    "blend": {"damage": 0.70, "dominance": 0.20, "duration": 0.10},
    "target": {"head": 1.00, "body": 0.75, "leg": 0.55},
    "damage": {"kd": 0.45, "tsig": 0.40, "sub": 0.10, "acc": 0.05},
    "dominance": {"ctrl": 0.55, "td": 0.20, "rev": 0.10, "ground": 0.15},
    "duration": {"ctrl": 0.70, "pace": 0.30},
    "threat": {"kd": 2.0, "tsig": 0.10, "sub": 0.50},
    "gate": (1.25, 0.70),
    "finish_boost": 0.35,
    "finish_weight": 0.15,
    "ten_eight": {"margin": (0.16, 0.05), "threat": (1.20, 0.35), "some": (0.80, 0.35), "dominance": (0.66, 0.06), "offense": (2.00, 0.60)},
    "ten_seven": {"margin": (0.28, 0.05), "threat": (2.25, 0.45), "dominance": (0.76, 0.06)},
}
# Fixed values of the target score and of the K factor.
TARGET = {"gap": 0.24, "margin": 0.22, "finish": 0.04, "time": 0.03, "epsilon": 0.01}
ELO = {"k0": 24.0, "tier": {"A": 1.0, "B": 0.85, "C": 0.70}, "title": 1.08, "finish": 1.06, "margin": (0.4, 0.35), "experience": ((5, 1.15), (12, 1.0), 0.92), "layoff_days": 540, "layoff": 0.90, "active": 1.03, "promotion": (0.85, 0.30, 0.75, 1.10)}
FINISHES = ("KO", "TKO", "SUB")


def clip(value: Column, low: Column | float, high: Column | float) -> Column:
    """Where the bounds cross, a value below the lower one becomes the lower one."""
    low, high = (x if isinstance(x, Column) else F.lit(float(x)) for x in (low, high))
    return F.when(value < low, low).when(value > high, high).otherwise(value)


def logistic(x: Column) -> Column:
    """Never overflows: the exponent is not positive."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def logit(p: Column, epsilon: float = 1e-6) -> Column:
    q = clip(p, epsilon, 1 - epsilon)
    return F.ln(q / (1 - q))


def safe_share(a: Column, b: Column, prior: float) -> Column:
    total = a + b + 2 * prior
    return F.when(total <= 0, 0.5).otherwise((a + prior) / total)


def shrink(value: Column, n: Column, tau: float, mean: Column) -> Column:
    """Drawn to a mean by how few observations there are."""
    return n / (n + tau) * value + tau / (n + tau) * mean


def is_finish(method: Column) -> Column:
    return method.isin(*FINISHES)


def outcome_score(outcome: Column) -> Column:
    return F.when(outcome == "W", 1.0).when(outcome == "L", 0.0).otherwise(0.5)


def target_score(outcome: Column, method: Column, margin: Column, finish_round: Column, finish_seconds: Column, rounds: Column, expected: Column) -> Column:
    """What the winner's rating is drawn to: outcome, margin, kind and time of the finish, anchored beyond the expectation."""
    sign = F.when(outcome == "W", 1.0).when(outcome == "L", -1.0).otherwise(0.0)
    elapsed = (finish_round - 1) * 300 + finish_seconds
    early = F.when((finish_round > 0) & finish_seconds.isNotNull(), TARGET["time"] * (1 - clip(elapsed / (F.greatest(rounds, finish_round) * 300), 0, 1))).otherwise(0.0)
    bonus = F.when(is_finish(method), TARGET["finish"]).otherwise(0.0)
    base = clip(0.5 + sign * TARGET["gap"] + TARGET["margin"] * F.coalesce(margin, F.lit(0.0)) + sign * (bonus + early), 0, 1)
    won = clip(base, F.greatest(F.lit(0.5), expected + TARGET["epsilon"]), 1.0)
    lost = clip(base, 0.0, F.least(F.lit(0.5), expected - TARGET["epsilon"]))
    return F.when(outcome == "W", won).when(outcome == "L", lost).otherwise(0.5)


def k_static(tier: Column, rounds: Column, title: Column, method: Column, margin: Column, promotion: Column) -> Column:
    """The factors of K that a contest alone decides."""
    by_tier = F.when(tier == "A", ELO["tier"]["A"]).when(tier == "B", ELO["tier"]["B"]).otherwise(ELO["tier"]["C"])
    low, slope, least, most = ELO["promotion"]
    by_promotion = F.when(promotion.isNull(), 1.0).otherwise(clip(low + slope * clip(promotion, 0, 1), least, most))
    return ELO["k0"] * by_tier * F.when((rounds >= 5) | title, ELO["title"]).otherwise(1.0) * F.when(is_finish(method), ELO["finish"]).otherwise(1.0) * (1 + clip(ELO["margin"][0] * F.abs(F.coalesce(margin, F.lit(0.0))), 0, ELO["margin"][1])) * by_promotion


def k_career(fights: Column, days_since: Column) -> Column:
    """The factors of K from the contestant's past: experience and layoff (null days: no earlier contest)."""
    (few, early), (some, middle), late = ELO["experience"]
    return F.when(fights < few, early).when(fights < some, middle).otherwise(late) * F.when(days_since > ELO["layoff_days"], ELO["layoff"]).otherwise(ELO["active"])


SIDE = ("kd", "sig_landed", "sig_attempted", "total_attempted", "td_landed", "td_attempted", "sub_attempts", "rev", "ctrl", "head", "body", "leg", "ground")
SCORES = ("ps_a", "ps_b", "damage_a", "dominance_a", "duration_a", "p10_9_a", "p10_8_a", "p10_7_a", "p10_9_b", "p10_8_b", "p10_7_b")


def performance(rounds: DataFrame, seconds: float = 300.0) -> DataFrame:
    """``rounds`` (structs ``a`` and ``b`` of SIDE; finish, winner_is_a, elapsed) with SCORES. Steps that are used more than once are columns of their own."""
    prior, weigh = PS["prior"], lambda part, w: sum((w[k] * part(k) for k in w), F.lit(0.0))
    col, above = F.col, lambda v, bound: logistic((v - bound[0]) / bound[1])
    rounds = rounds.withColumns({f"_tsig_{s}": weigh(lambda k: col(f"{s}.{k}"), PS["target"]) for s in "ab"} | {f"_sub_{s}": col(f"{s}.sub_attempts") + 0.5 * col(f"{s}.ground") for s in "ab"} | {f"_acc_{s}": 100 * col(f"{s}.sig_landed") / F.greatest(F.lit(1.0), col(f"{s}.sig_attempted")) for s in "ab"})
    rounds = rounds.withColumns({f"_threat_{s}": PS["threat"]["kd"] * col(f"{s}.kd") + PS["threat"]["tsig"] * col(f"_tsig_{s}") + PS["threat"]["sub"] * col(f"_sub_{s}") for s in "ab"} | {f"_offense_{s}": col(f"_tsig_{s}") + col(f"{s}.kd") + col(f"_sub_{s}") for s in "ab"})
    field = lambda k, p: safe_share(col(f"a.{k}"), col(f"b.{k}"), prior[p])
    made = lambda k, p: safe_share(col(f"_{k}_a"), col(f"_{k}_b"), prior[p])
    pace = [col(f"{s}.sig_attempted") + col(f"{s}.td_attempted") + col(f"{s}.total_attempted") for s in "ab"]
    raw = {
        "_damage": weigh({"kd": field("kd", "kd"), "tsig": made("tsig", "sig"), "sub": made("sub", "sub"), "acc": made("acc", "acc")}.get, PS["damage"]),
        "_dominance": weigh({"ctrl": field("ctrl", "ctrl"), "td": field("td_landed", "td"), "rev": field("rev", "rev"), "ground": field("ground", "sig")}.get, PS["dominance"]),
        "_duration": weigh({"ctrl": field("ctrl", "ctrl"), "pace": safe_share(*pace, prior["pace"])}.get, PS["duration"]),
    }
    rounds = rounds.withColumns(raw | {f"_gate_{s}": above(col(f"_threat_{s}"), PS["gate"]) for s in "ab"})
    used = clip(col("elapsed") / max(1.0, seconds), 0, 1)
    base = F.when(col("winner_is_a"), col("_damage")).otherwise(1 - col("_damage"))
    boosted = clip(0.5 + (1 + PS["finish_boost"] * (1 - used) ** 2) * (base - 0.5), 0, 1)
    rounds = rounds.withColumn("_boosted", boosted)

    def gated(name: str) -> Column:
        p, q = col("_gate_a") * col(name), col("_gate_b") * (1 - col(name))
        return F.when(p + q < 1e-9, 0.5).otherwise(p / (p + q))

    boost = col("finish") & col("winner_is_a").isNotNull() & col("elapsed").isNotNull()
    rounds = rounds.withColumns({"damage_a": F.when(boost, F.when(col("winner_is_a"), col("_boosted")).otherwise(1 - col("_boosted"))).otherwise(col("_damage")), "dominance_a": gated("_dominance"), "duration_a": gated("_duration")})
    blend = PS["blend"]
    rounds = rounds.withColumn("ps_a", clip(blend["damage"] * col("damage_a") + blend["dominance"] * col("dominance_a") + blend["duration"] * col("duration_a"), 0, 1)).withColumn("ps_b", clip(1 - col("ps_a"), 0, 1))
    e, s7 = PS["ten_eight"], PS["ten_seven"]
    for s, o, dominance in (("a", "b", col("dominance_a")), ("b", "a", 1 - col("dominance_a"))):
        threat, margin = col(f"_threat_{s}"), col(f"ps_{s}") - 0.5
        low = logistic((e["offense"][0] - col(f"_offense_{o}")) / e["offense"][1])
        p8 = F.greatest(above(margin, e["margin"]) * above(threat, e["threat"]), above(dominance, e["dominance"]) * above(threat, e["some"]) * low)
        p7 = above(margin, s7["margin"]) * above(threat, s7["threat"]) * above(dominance, s7["dominance"])
        rounds = rounds.withColumns({"_p8": p8, "_p7": p7}).withColumn("_all", F.greatest(col("_p8") + col("_p7"), F.lit(1.0)))
        rounds = rounds.withColumns({f"p10_8_{s}": col("_p8") / col("_all"), f"p10_7_{s}": col("_p7") / col("_all")}).withColumn(f"p10_9_{s}", clip(1 - col(f"p10_8_{s}") - col(f"p10_7_{s}"), 0, 1))
    return rounds.drop(*[c for c in rounds.columns if c.startswith("_")])


def finish_weight(finish: Column, elapsed: Column, seconds: float = 300.0) -> Column:
    used = clip(elapsed / seconds, 0, 1)
    return F.when(finish & elapsed.isNotNull(), 1 + PS["finish_weight"] * (1 - used) ** 2).otherwise(1.0)
