"""Attribute ratings (22 stats and 12 perks of a contestant): fixed tables, and what follows from them as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import kernels

# The stats by bucket, their weights in the bucket's mean, and the buckets' shares.
STATS = (
    "accuracy", "blocking", "footwork", "head_movement", "kick_power", "kick_speed", "punch_power", "punch_speed", "takedown_defence",
    "bottom_game", "clinch_grapple", "clinch_striking", "ground_striking", "submission_defence", "submission_offence", "takedowns", "top_game",
    "body_strength", "cardio", "chin_strength", "legs_strength", "recovery",
)
HEALTH = ("body_strength", "cardio", "chin_strength", "legs_strength", "recovery")
DIRECT = ("accuracy", "blocking", "head_movement", "takedowns", "takedown_defence", "submission_offence", "top_game", "ground_striking", "cardio")
BUCKETS = {
    "standup": (0.40, {"accuracy": 0.15, "blocking": 0.14, "footwork": 0.11, "head_movement": 0.12, "kick_power": 0.07, "kick_speed": 0.06, "punch_power": 0.15, "punch_speed": 0.11, "takedown_defence": 0.09}),
    "grappling": (0.33, {"bottom_game": 0.08, "clinch_grapple": 0.07, "clinch_striking": 0.05, "ground_striking": 0.09, "submission_defence": 0.15, "submission_offence": 0.11, "takedowns": 0.16, "top_game": 0.17, "takedown_defence": 0.12}),
    "health": (0.27, {"body_strength": 0.13, "cardio": 0.23, "chin_strength": 0.24, "legs_strength": 0.11, "recovery": 0.23}),
}
SYNERGIES = [("punch_power", "accuracy", 1.2), ("punch_speed", "accuracy", 0.8), ("footwork", "head_movement", 0.8), ("takedowns", "top_game", 1.0), ("top_game", "submission_offence", 0.8), ("blocking", "chin_strength", 0.7), ("cardio", "recovery", 0.7)]
# Perks: strength, and the stats that are their evidence.
PERKS = {
    "like_glue": ("medium", {"clinch_grapple": 0.45, "takedowns": 0.30, "top_game": 0.25}),
    "slippery": ("medium", {"takedown_defence": 0.40, "bottom_game": 0.30, "submission_defence": 0.30}),
    "to_your_feet": ("medium", {"bottom_game": 0.45, "takedown_defence": 0.35, "cardio": 0.20}),
    "wrestle_clinic": ("major", {"top_game": 0.45, "takedowns": 0.30, "ground_striking": 0.25}),
    "grinder": ("medium", {"cardio": 0.40, "clinch_grapple": 0.30, "top_game": 0.30}),
    "work_horse": ("medium", {"cardio": 0.40, "top_game": 0.35, "ground_striking": 0.25}),
    "marathoner": ("medium", {"cardio": 0.55, "recovery": 0.25, "footwork": 0.20}),
    "out_the_gates": ("minor", {"punch_power": 0.35, "punch_speed": 0.30, "accuracy": 0.20, "kick_power": 0.15}),
    "higher_altitude": ("medium", {"cardio": 0.60, "recovery": 0.25, "blocking": 0.15}),
    "wake_up_call": ("minor", {"recovery": 0.50, "chin_strength": 0.30, "cardio": 0.20}),
    "crafty": ("medium", {"submission_defence": 0.45, "bottom_game": 0.30, "takedown_defence": 0.25}),
    "no_cigar": ("medium", {"submission_defence": 0.50, "chin_strength": 0.25, "recovery": 0.25}),
}
STRENGTH = {"minor": 0.25, "medium": 0.50, "major": 0.90}
# Stats that a sport moves; MMA moves all, sports that are not named none.
FAMILIES = {
    "boxing": ("accuracy", "blocking", "head_movement", "footwork", "punch_speed", "punch_power", "cardio"),
    "kickboxing": ("accuracy", "blocking", "head_movement", "footwork", "punch_speed", "punch_power", "kick_speed", "kick_power", "cardio"),
    "muay": ("accuracy", "blocking", "head_movement", "footwork", "punch_speed", "punch_power", "kick_speed", "kick_power", "clinch_grapple", "clinch_striking", "cardio"),
    "wrestling": ("takedowns", "takedown_defence", "top_game", "clinch_grapple", "bottom_game", "cardio"),
    "grappling": ("submission_offence", "submission_defence", "bottom_game", "top_game", "takedowns", "takedown_defence"),
    "combat_jj": ("submission_offence", "submission_defence", "bottom_game", "top_game"),
    "judo": ("takedowns", "takedown_defence", "clinch_grapple", "top_game"),
    "sambo": ("takedowns", "takedown_defence", "submission_offence", "top_game", "clinch_grapple"),
    "lethwei": ("accuracy", "blocking", "head_movement", "punch_power", "kick_power", "clinch_striking", "chin_strength", "cardio"),
}
SPORT_WEIGHT = {"boxing": 0.35, "boxing_cage": 0.35, "kickboxing": 0.40, "muay": 0.40, "lethwei": 0.40, "wrestling": 0.40, "judo": 0.40, "sambo": 0.40, "grappling": 0.35, "combat_jj": 0.35}
# Features whose percentile makes a stat's target, by weight; features of which less is better; weight of the division's mean in a feature.
TARGETS = {
    "accuracy": {"sig_acc": 1.0},
    "blocking": {"sig_def": 0.70, "head_evasion": 0.30},
    "head_movement": {"head_evasion": 0.60, "sig_def": 0.25, "kd_abs15": 0.15},
    "takedowns": {"td15": 0.45, "td_acc": 0.35, "ctrl_share": 0.20},
    "takedown_defence": {"td_def": 0.45, "opp_ctrl_share": 0.25, "rev15": 0.20, "opp_sub15": 0.10},
    "submission_offence": {"sub15": 0.35, "sub_win_rate": 0.25, "ctrl_share": 0.20, "ground_sig_per_min": 0.20},
    "top_game": {"ctrl_share": 0.45, "ground_sig_per_min": 0.25, "sub15": 0.20, "opp_rev15": 0.10},
    "ground_striking": {"ground_sig_per_min": 0.50, "ctrl_share": 0.30, "ko_win_rate": 0.20},
    "cardio": {"late_output_ratio": 0.40, "late_abs_ratio": 0.25, "total_fight_minutes": 0.20, "slpm": 0.15},
    "footwork": {"dist_share": 0.35, "str_diff": 0.25, "sig_def": 0.20, "late_output_ratio": 0.20},
    "punch_speed": {"head_sig_per_min": 0.40, "sig_acc": 0.25, "dist_sig_per_min": 0.20, "sapm": 0.15},
    "punch_power": {"kd15": 0.35, "ko_win_rate": 0.30, "head_share": 0.20, "head_sig_per_min": 0.15},
    "kick_speed": {"leg_sig_per_min": 0.40, "leg_share": 0.25, "dist_sig_per_min": 0.20, "late_output_ratio": 0.15},
    "kick_power": {"kd15": 0.30, "leg_share": 0.25, "body_share": 0.20, "body_sig_per_min": 0.15, "leg_sig_per_min": 0.10},
    "bottom_game": {"rev15": 0.35, "opp_ctrl_share": 0.25, "sub15": 0.20, "td_def": 0.20},
    "clinch_grapple": {"clinch_share": 0.35, "td15": 0.25, "td_acc": 0.20, "ctrl_share": 0.20},
    "clinch_striking": {"clinch_sig_per_min": 0.55, "clinch_share": 0.25, "sig_acc": 0.20},
    "submission_defence": {"opp_sub15": 0.45, "td_def": 0.25, "opp_ctrl_share": 0.20, "rev15": 0.10},
    "chin_strength": {"kd_abs15": 0.45, "ko_win_rate": 0.15, "head_abs15": 0.15, "kd_survival_rate": 0.25},
    "body_strength": {"body_abs15": 0.50, "late_output_ratio": 0.25, "total_fight_minutes": 0.15, "kd_survival_rate": 0.10},
    "legs_strength": {"leg_abs15": 0.50, "dist_share": 0.20, "late_output_ratio": 0.15, "total_fight_minutes": 0.15},
    "recovery": {"kd_survival_rate": 0.40, "late_output_ratio": 0.25, "total_fight_minutes": 0.20, "kd_abs15": 0.15},
}
CAREER = ("ko_win_rate", "sub_win_rate", "total_fight_minutes", "kd_survival_rate")
LESS_IS_BETTER = ("kd_abs15", "opp_ctrl_share", "opp_sub15", "opp_rev15", "late_abs_ratio", "sapm", "head_abs15", "body_abs15", "leg_abs15")
TAU = {10.0: ("sub15", "opp_sub15", "sub_win_rate"), 15.0: ("td15", "td_acc", "td_def", "rev15", "opp_rev15"), 20.0: ("kd_abs15", "ctrl_share", "opp_ctrl_share", "ground_sig_per_min", "ko_win_rate", "late_output_ratio", "late_abs_ratio", "total_fight_minutes", "kd15", "head_abs15", "body_abs15", "leg_abs15", "kd_survival_rate")}
OTHER_TAU = 30.0
# Constants of an update: ranges, K by kind of stat and tier, caps, bonuses, perk thresholds.
RANGE, HEALTH_RANGE, START, PERK_START = (80.0, 100.0), (84.0, 96.0), 85.0, 80.0
K_BASE = {"direct": 0.35, "health": 0.18, "proxy": 0.25}
TIER = {"A": 1.00, "B": 0.60, "C": 0.40}
PROMOTION = ((0.9, 1.00), (0.6, 0.80), 0.55)
CAPS = {"health_drop": 4.0, "direct": 3.0, "health": 2.0, "proxy": 2.0}
KO_BONUS, SUB_BONUS = {"punch_power": 0.8, "kick_power": 0.4}, {"submission_offence": 0.8, "top_game": 0.5, "bottom_game": 0.5}
QUALITY, USUAL_OVERALL, CAREER_DIVISOR, PRIOR_DECAY = (0.85, 0.30), 87.0, 6.0, 5.0
GEO_EPSILON, SYNERGY_CAP = 0.02, 1.5
PERK_KEEP, PERK_ON, PERK_OFF, PERK_IN_A_ROW = 0.90, 88.0, 80.0, 3
POOL_MIN_TIER_A, POOL_MIN_SIZE = 5, 15


def bounds(stat: str) -> tuple[float, float]:
    return HEALTH_RANGE if stat in HEALTH else RANGE


def kind(stat: str) -> str:
    """Direct comes before health where a stat is both."""
    return "direct" if stat in DIRECT else "health" if stat in HEALTH else "proxy"


def normal(stat: str) -> Column:
    low, high = bounds(stat)
    return kernels.clip((F.col(stat) - low) / (high - low), 0, 1)


def geometric_mean(weights: dict[str, float]) -> Column:
    logs = sum((w * F.ln(GEO_EPSILON + normal(s)) for s, w in weights.items()), F.lit(0.0))
    return F.exp(logs / sum(weights.values()))


def on_scale(share: Column) -> Column:
    return RANGE[0] + (RANGE[1] - RANGE[0]) * share


def bucket_scores() -> dict[str, Column]:
    return {b: on_scale(geometric_mean(weights)) for b, (_, weights) in BUCKETS.items()}


def base_overall() -> Column:
    return on_scale(sum((share * geometric_mean(weights) for share, weights in BUCKETS.values()), F.lit(0.0)))


def synergy_bonus() -> Column:
    return F.least(sum((c * normal(a) * normal(b) for a, b, c in SYNERGIES), F.lit(0.0)), F.lit(SYNERGY_CAP))


def perk_bonus(active: dict[str, Column]) -> Column:
    return sum((F.when(active[p], STRENGTH[tier]).otherwise(0.0) for p, (tier, _) in PERKS.items()), F.lit(0.0))


def perk_evidence(perk: str) -> Column:
    return sum((w * F.col(s) for s, w in PERKS[perk][1].items()), F.lit(0.0))


def effective_overall(base: Column, synergy: Column, perks: Column) -> Column:
    return kernels.clip(base + synergy + perks, *RANGE)


def organisation_weight(promotion: Column, sport: Column) -> Column:
    """MMA by the strength of the promotion (unknown: regional), other sports by the sport."""
    (top, best), (major, middle), least = PROMOTION
    mma = F.when(promotion >= top, best).when(promotion >= major, middle).otherwise(least)
    by_sport = F.create_map(*[F.lit(x) for s, w in SPORT_WEIGHT.items() for x in (s, w)])
    return F.when(sport == "mma", mma).otherwise(F.coalesce(by_sport[sport], F.lit(least * 0.5)))


def moved_by(stat: str, sport: Column) -> Column:
    return sport.isin("mma", *[s for s, family in FAMILIES.items() if stat in family])


def method_bonus(stat: str, method: Column, won: Column) -> Column:
    by_method = F.when(method.isin("KO", "TKO"), KO_BONUS.get(stat, 0.0)).when(method == "SUB", SUB_BONUS.get(stat, 0.0)).otherwise(0.0)
    return F.when(won, by_method).otherwise(0.0)


def cap(stat: str, change: Column) -> Column:
    usual = F.lit(CAPS[kind(stat)])
    return F.when(change < 0, CAPS["health_drop"]).otherwise(usual) if stat in HEALTH else usual


def moved(stat: str, change: Column) -> Column:
    """The stat after a change that is capped, within its bounds."""
    most = cap(stat, change)
    return kernels.clip(F.col(stat) + kernels.clip(change, -most, most), *bounds(stat))
