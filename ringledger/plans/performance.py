"""Round statistics, performance scores and features of contests. The statistics are derived from the contest's numbers, by the same text in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import attributes, features, kernels, text
from ..operators import analytics, attribute_fold
from ..session import cut, read
from .contest import contests, sides
from .registry import query, r6

#: Counts of a round by its number h.
STATS = {"kd": "h % 3", "sig_landed": "h % 17", "sig_attempted": "h % 17 + h % 23", "total_landed": "h % 17 + h % 11", "total_attempted": "h % 17 + h % 11 + h % 29", "td_landed": "h % 4", "td_attempted": "h % 4 + h % 5", "sub_attempts": "h % 2", "rev": "(h + 1) % 2", "ctrl_seconds": "h % 200"}
BY_TARGET = {"head_landed": "h % 13", "body_landed": "h % 6", "leg_landed": "h % 5"}
BY_POSITION = {"distance_landed": "h % 12", "clinch_landed": "h % 7", "ground_landed": "h % 9"}

_list = lambda table: ", ".join(f"({v}) {k}" for k, v in table.items())
_zero = lambda table, when: ", ".join(f"case when {when} then 0 else {v} end {k}" for k, v in table.items())
ROUNDS_SQL = f"""
rb as (select contest_id, method, a, b, unnest(range(1, rounds + 1)) round_num from contests where tier = 'A'),
er as (select contest_id, round_num, a contestant, b opponent, method, contest_id * 31 + round_num * 17 h from rb union all select contest_id, round_num, b, a, method, contest_id * 31 + round_num * 17 + 21 from rb),
rs as (select contest_id, round_num, contestant, opponent, {_list(STATS)}, {_zero(BY_TARGET, "method = 'SUB'")}, {_zero(BY_POSITION, "method = 'KO'")} from er),
et as (select contest_id, a contestant, b opponent, contest_id * 31 + 5 h from contests where tier in ('A', 'B') union all select contest_id, b, a, contest_id * 31 + 26 from contests where tier in ('A', 'B')),
ft as (select contest_id, contestant, opponent, {_list(STATS)}, (h % 17) head_landed, {", ".join(f"0 {k}" for k in [*BY_TARGET, *BY_POSITION] if k != "head_landed")} from et)"""


def _each(log: DataFrame, h: F.Column, *more: str) -> DataFrame:
    """Two rows for each of ``log``; the other side's number is 21 higher."""
    pair = F.array(F.struct(F.col("a").alias("contestant"), h.alias("h")), F.struct(F.col("b").alias("contestant"), (h + 21).alias("h")))
    return log.select("contest_id", *more, F.explode(pair).alias("s")).select("contest_id", *more, "s.*")


def source_tables(log: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(round statistics, by target, by position, totals) as a source has them: rounds of tier A, totals of A and B; splits may be missing."""
    spine = log.where("tier = 'A'").select("*", F.explode(F.sequence(F.lit(1), F.col("rounds"))).alias("round_num"))
    each = _each(spine, F.col("contest_id") * 31 + F.col("round_num") * 17, "round_num", "method")
    keys, pick = ["contest_id", "round_num", "contestant"], lambda table: [F.expr(v).alias(k) for k, v in table.items()]
    totals = _each(log.where("tier in ('A', 'B')"), F.col("contest_id") * 31 + 5).select("contest_id", "contestant", *pick(STATS))
    return each.select(*keys, *pick(STATS)), each.where("method != 'SUB'").select(*keys, *pick(BY_TARGET)), each.where("method != 'KO'").select(*keys, *pick(BY_POSITION)), totals


def joined_rounds(stats: DataFrame, by_target: DataFrame, by_position: DataFrame) -> DataFrame:
    """Round statistics with their splits; round 0 (totals) left out, missing counts 0. All three share the keys, so one shuffle each serves both joins."""
    keys = ["contest_id", "round_num", "contestant"]
    return stats.where("round_num > 0").join(by_target, keys, "left").join(by_position, keys, "left").na.fill(0, list(features.COUNTS))


def totals_as_rounds(totals: DataFrame) -> DataFrame:
    """Totals with all significant strikes to the head and no other split."""
    return totals.withColumns({"head_landed": F.col("sig_landed")} | {c: F.lit(0) for c in features.COUNTS if c not in totals.columns and c != "head_landed"})


def round_table(log: DataFrame, observed: DataFrame) -> DataFrame:
    """(contest_id, round_num, round_seconds, completed): a row for each scheduled round, and for each observed one.

    A round behind the finish is not completed, nor that of the finish if it is known to have ended before its full time; without a finish all are. An observed round
    is completed unless its number is 0 (totals), whatever the schedule says. Contests without scheduled rounds have the observed ones only. Observed rows
    that repeat count once; those without contest or number are left out.
    """
    seconds = int(features.ROUND_SECONDS)
    number, last = F.col("round_num"), F.col("finish_round")
    open_ = F.coalesce(number > last, F.lit(False)) | F.coalesce((number == last) & (F.col("finish_seconds") < seconds), F.lit(False))
    planned = log.where("rounds > 0").select("contest_id", "finish_round", "finish_seconds", F.explode(F.sequence(F.lit(1), F.col("rounds"))).alias("round_num")).select("contest_id", "round_num", (~open_).alias("completed"))
    seen = observed.where("contest_id is not null and round_num is not null").select("contest_id", "round_num").distinct().withColumn("_seen", F.lit(True))
    both = planned.join(seen, ["contest_id", "round_num"], "full_outer")
    return both.select("contest_id", "round_num", F.lit(seconds).alias("round_seconds"), F.when(F.col("_seen"), number != 0).otherwise(F.col("completed")).alias("completed"))


def _log(spark, d):
    return contests(spark, d)


@query(
    f", {ROUNDS_SQL}, fb as (select contest_id, rounds, case when contest_id % 23 = 0 then null else finish_round end fr, finish_seconds fs from contests), "
    "pl as (select contest_id, unnest(range(1, rounds + 1))::int round_num, rounds, fr, fs from fb), "
    "pc as (select contest_id, round_num, not (fr is not null and round_num > fr) and not (fr is not null and round_num = fr and fs is not null and fs < 300) completed from pl), "
    "ob as (select distinct contest_id, round_num::int round_num from rs where contest_id % 2 = 0 union select contest_id, 0 from contests where contest_id % 37 = 0) "
    "select coalesce(p.contest_id, o.contest_id) contest_id, coalesce(p.round_num, o.round_num) round_num, 300 round_seconds, case when o.contest_id is not null then o.round_num <> 0 else completed end completed "
    "from pc p full join ob o on p.contest_id = o.contest_id and p.round_num = o.round_num")
def round_spine(spark, d):
    """Scheduled rounds, overlaid with those that a source reports (of every second contest) and with totals as round 0; some finishes are unknown."""
    log = _log(spark, d)
    known = log.withColumn("finish_round", F.when(F.col("contest_id") % 23 != 0, F.col("finish_round")))
    observed = source_tables(log)[0].where("contest_id % 2 = 0").select("contest_id", "round_num").unionByName(log.where("contest_id % 37 = 0").select("contest_id", F.lit(0).alias("round_num")))
    return round_table(known, observed)


@query(f", {ROUNDS_SQL} select contest_id, round_num::int round_num, contestant, {', '.join(f'{c}::bigint {c}' for c in features.COUNTS)} from rs")
def round_stats(spark, d):
    rows = joined_rounds(*source_tables(_log(spark, d))[:3])
    return rows.select("contest_id", "round_num", "contestant", *[F.col(c).cast("long").alias(c) for c in features.COUNTS])


@query(f", {ROUNDS_SQL} select contest_id, contestant, {', '.join(f'{c}::bigint {c}' for c in features.COUNTS)} from ft")
def fight_totals(spark, d):
    rows = totals_as_rounds(source_tables(_log(spark, d))[3])
    return rows.select("contest_id", "contestant", *[F.col(c).cast("long").alias(c) for c in features.COUNTS])


@query(f", {ROUNDS_SQL} select contest_id, contestant, {', '.join(f'sum({c})::bigint {c}' for c in features.COUNTS)} from rs group by 1, 2")
def round_totals(spark, d):
    rows = features.contest_totals(joined_rounds(*source_tables(_log(spark, d))[:3]))
    return rows.select("contest_id", "contestant", *[F.col(c).cast("long").alias(c) for c in features.COUNTS])


@query(f", {ROUNDS_SQL} select contest_id, case when contest_id in (select contest_id from rs) then 'A' when contest_id in (select contest_id from ft) then 'B' else 'C' end evidence from contests")
def evidence_tier(spark, d):
    """A where there are rounds, B where there are totals, else C."""
    log = _log(spark, d)
    stats, _, _, totals = source_tables(log)
    has = lambda df, name: df.select("contest_id").distinct().withColumn(name, F.lit(True))
    joined = log.select("contest_id").join(has(stats, "r"), "contest_id", "left").join(has(totals, "t"), "contest_id", "left")
    return joined.select("contest_id", F.when(F.col("r"), "A").when(F.col("t"), "B").otherwise("C").alias("evidence"))


# ---- features ----

_F_SQL = {
    "sig_acc": "case when o.sig_attempted <= 1e-9 then 0 else o.sig_landed / o.sig_attempted end", "sig_def": "1 - case when x.sig_attempted <= 1e-9 then 0 else x.sig_landed / x.sig_attempted end", "head_evasion": "1 - x.head_landed / greatest(x.sig_attempted, 1e-9)",
    "slpm": "o.sig_landed / fm", "sapm": "x.sig_landed / fm", "str_diff": "o.sig_landed / fm - x.sig_landed / fm", "td15": "15 * o.td_landed / fm", "td_acc": "case when o.td_attempted <= 1e-9 then 0 else o.td_landed / o.td_attempted end",
    "td_def": "1 - case when x.td_attempted <= 1e-9 then 0 else x.td_landed / x.td_attempted end", "sub15": "15 * o.sub_attempts / fm", "opp_sub15": "15 * x.sub_attempts / fm", "ctrl_share": "o.ctrl_seconds / greatest(minutes * 60, 1e-9)", "opp_ctrl_share": "x.ctrl_seconds / greatest(minutes * 60, 1e-9)",
    "rev15": "15 * o.rev / fm", "opp_rev15": "15 * x.rev / fm",
} | {f"{s}_share": f"o.{p}_landed / greatest(o.sig_landed, 1e-9)" for s, p in (("head", "head"), ("body", "body"), ("leg", "leg"), ("dist", "distance"), ("clinch", "clinch"), ("ground", "ground"))
} | {f"{s}_sig_per_min": f"o.{p}_landed / fm" for s, p in (("head", "head"), ("body", "body"), ("leg", "leg"), ("dist", "distance"), ("clinch", "clinch"), ("ground", "ground"))
} | {"kd15": "15 * o.kd / fm", "kd_abs15": "15 * x.kd / fm", "head_abs15": "x.head_landed / fm", "body_abs15": "x.body_landed / fm", "leg_abs15": "x.leg_landed / fm"}
FEATURES_SQL = f"""
mi as (select contest_id, case when tier = 'B' then rounds * 5.0 else (finish_round - 1) * 5.0 + finish_seconds / 60.0 end as minutes from contests),
ag as (select contest_id, contestant, opponent, {", ".join(f"sum({c})::double {c}" for c in features.COUNTS)} from rs group by 1, 2, 3
    union all select contest_id, contestant, opponent, {", ".join(f"{c}::double {c}" for c in features.COUNTS)} from ft where contest_id not in (select contest_id from rs)),
ph as (select o.contest_id, o.contestant, count(*) n, sum(case when o.round_num <= 2 then o.sig_landed + o.td_landed + o.sub_attempts else 0 end) / 10.0 eo,
    sum(case when o.round_num > 2 then o.sig_landed + o.td_landed + o.sub_attempts else 0 end) / ((count(*) - 2) * 5.0) lo, sum(case when o.round_num <= 2 then x.sig_landed else 0 end) / 10.0 ea, sum(case when o.round_num > 2 then x.sig_landed else 0 end) / ((count(*) - 2) * 5.0) la
    from rs o join rs x on o.contest_id = x.contest_id and o.round_num = x.round_num and o.opponent = x.contestant group by 1, 2),
bf as (select o.contest_id, o.contestant, minutes, {", ".join(f"{v} {k}" for k, v in _F_SQL.items())}, lo / greatest(eo, 1e-9) late_output_ratio, la / greatest(ea, 1e-9) late_abs_ratio, eo / greatest(lo, 1e-9) early_output_ratio
    from ag o join ag x on o.contest_id = x.contest_id and o.opponent = x.contestant join (select *, greatest(minutes, 1e-9) fm from mi) m on m.contest_id = o.contest_id left join ph on ph.contest_id = o.contest_id and ph.contestant = o.contestant)"""


def features_of(log: DataFrame) -> DataFrame:
    """Features of every side. Contests of tier B keep no time of their finish, so their minutes are those of the schedule."""
    stats, by_target, by_position, totals = source_tables(log)
    known = lambda c: F.when(F.col("tier") != "B", F.col(c))
    timed = log.withColumn("minutes", text.fight_minutes(known("finish_round"), known("finish_seconds"), F.col("rounds")))
    return features.bout_features(joined_rounds(stats, by_target, by_position), totals_as_rounds(totals), timed)


@query(f", {ROUNDS_SQL}, {FEATURES_SQL} select contest_id, contestant, round(minutes, 6) as minutes, {', '.join(f'round({c}, 5) {c}' for c in features.FEATURES if 'ratio' not in c)}, {', '.join(f'round(case when {c} > 1e6 then 1e6 else {c} end, 5) {c}' for c in features.FEATURES if 'ratio' in c)} from bf")
def bout_features(spark, d):
    """Features of both sides of every contest; ratios to nothing are cut at a million for comparison."""
    found = features_of(cut(_log(spark, d)))
    short = lambda c: F.round(F.when(F.col(c).isNotNull(), F.least(F.col(c), F.lit(1e6))), 5).alias(c)
    return found.select("contest_id", "contestant", r6("minutes").alias("minutes"), *[short(c) if "ratio" in c else F.round(c, 5).alias(c) for c in features.FEATURES])


_POOL = ("sig_acc", "td15", "kd_abs15")


@query(
    f", {ROUNDS_SQL}, {FEATURES_SQL}, fd as (select division, contestant, bf.contest_id, {', '.join(_POOL)} from bf join contests using (contest_id)) select d.division, "
    + ", ".join(f"round(case when n >= 600 then m_{c} else g_{c} end, 6) {c}" for c in _POOL)
    + f" from (select division, count(*) n, {', '.join(f'avg({c}) m_{c}' for c in _POOL)} from fd group by 1) d, (select {', '.join(f'avg({c}) g_{c}' for c in _POOL)} from fd)")
def division_means(spark, d):
    """Mean features of each division; those of all where a division has fewer than 600 sides."""
    log = cut(_log(spark, d))
    rows = features_of(log).join(log.select("contest_id", "division"), "contest_id")
    mean = lambda mark: [F.avg(c).alias(f"{mark}{c}") for c in _POOL]
    whole = rows.agg(*mean("g_"))
    own = rows.groupBy("division").agg(F.count("*").alias("n"), *mean("m_")).join(F.broadcast(whole))
    return own.select("division", *[r6(F.when(F.col("n") >= 600, F.col(f"m_{c}")).otherwise(F.col(f"g_{c}"))).alias(c) for c in _POOL])


@query("select contest_id, contestant, round(1 - (rank() over (partition by division order by q) - 1) / count(*) over (partition by division), 6) percentile from sides")
def percentile_inverted(spark, d):
    """Percentile where less is better."""
    found = analytics.strict_percentile(sides(_log(spark, d)), ["division"], "q")
    return found.select("contest_id", "contestant", r6(1 - F.col("percentile")).alias("percentile"))


# ---- performance scores ----


def ps_sql(source: str) -> str:
    """The scores of every row of ``source`` (counts as a_<count> and b_<count>, finish, winner_is_a, elapsed) as common table expressions up to ``ps``."""
    c = kernels.PS
    share = lambda a, b, p: f"(case when {a} + {b} + {2 * p} <= 0 then 0.5 else ({a} + {p}) / ({a} + {b} + {2 * p}) end)"
    over = lambda x, bound: f"(1 / (1 + exp(-(({x}) - {bound[0]}) / {bound[1]})))"
    clip = lambda x: f"least(1, greatest(0, {x}))"
    weigh = lambda parts, w: "(" + " + ".join(f"{w[k]} * {v}" for k, v in parts.items()) + ")"
    count = lambda k, p: share(f"a_{k}", f"b_{k}", c["prior"][p])
    one = ", ".join(f"({c['target']['head']} * {s}_head + {c['target']['body']} * {s}_body + {c['target']['leg']} * {s}_leg) tsig_{s}, ({s}_sub_attempts + 0.5 * {s}_ground) sub_{s}, 100.0 * {s}_sig_landed / greatest(1, {s}_sig_attempted) acc_{s}" for s in "ab")
    two = ", ".join(f"({c['threat']['kd']} * {s}_kd + {c['threat']['tsig']} * tsig_{s} + {c['threat']['sub']} * sub_{s}) threat_{s}, (tsig_{s} + {s}_kd + sub_{s}) offense_{s}" for s in "ab")
    pace = [f"({s}_sig_attempted + {s}_td_attempted + {s}_total_attempted)" for s in "ab"]
    damage = weigh({"kd": count("kd", "kd"), "tsig": share("tsig_a", "tsig_b", c["prior"]["sig"]), "sub": share("sub_a", "sub_b", c["prior"]["sub"]), "acc": share("acc_a", "acc_b", c["prior"]["acc"])}, c["damage"])
    dominance = weigh({"ctrl": count("ctrl", "ctrl"), "td": count("td_landed", "td"), "rev": count("rev", "rev"), "ground": count("ground", "sig")}, c["dominance"])
    duration = weigh({"ctrl": count("ctrl", "ctrl"), "pace": share(*pace, c["prior"]["pace"])}, c["duration"])
    gated = lambda x: f"(case when gate_a * {x} + gate_b * (1 - {x}) < 1e-9 then 0.5 else gate_a * {x} / (gate_a * {x} + gate_b * (1 - {x})) end)"
    boosted = clip(f"0.5 + (1 + {c['finish_boost']} * power(1 - {clip('elapsed / 300.0')}, 2)) * ((case when winner_is_a then damage else 1 - damage end) - 0.5)")
    e, s7, points = c["ten_eight"], c["ten_seven"], []
    for s, o, dom in (("a", "b", "dominance_a"), ("b", "a", "(1 - dominance_a)")):
        margin = f"ps_{s} - 0.5"
        p8 = f"greatest({over(margin, e['margin'])} * {over(f'threat_{s}', e['threat'])}, {over(dom, e['dominance'])} * {over(f'threat_{s}', e['some'])} * (1 / (1 + exp(-({e['offense'][0]} - offense_{o}) / {e['offense'][1]}))))"
        points.append(f"{p8} p8_{s}, {over(margin, s7['margin'])} * {over(f'threat_{s}', s7['threat'])} * {over(dom, s7['dominance'])} p7_{s}")
    return f"""
p1 as (select *, {one} from {source}), p2 as (select *, {two} from p1),
p3 as (select *, {damage} damage, {dominance} dominance, {duration} duration, {over('threat_a', c['gate'])} gate_a, {over('threat_b', c['gate'])} gate_b from p2),
p4 as (select *, case when finish and winner_is_a is not null and elapsed is not null then case when winner_is_a then {boosted} else 1 - {boosted} end else damage end damage_a, {gated('dominance')} dominance_a, {gated('duration')} duration_a from p3),
p5 as (select *, {clip(f"{c['blend']['damage']} * damage_a + {c['blend']['dominance']} * dominance_a + {c['blend']['duration']} * duration_a")} ps_a from p4), p6 as (select *, 1 - ps_a ps_b from p5),
p7 as (select *, {", ".join(points)} from p6),
ps as (select *, {", ".join(f"p8_{s} / greatest(p8_{s} + p7_{s}, 1) p10_8_{s}, p7_{s} / greatest(p8_{s} + p7_{s}, 1) p10_7_{s}, {clip(f'1 - (p8_{s} + p7_{s}) / greatest(p8_{s} + p7_{s}, 1)')} p10_9_{s}" for s in "ab")} from p7)"""


def _stats(side: str) -> dict:
    q, k = F.col(f"q{side}"), F.col("contest_id")
    n = lambda m, shift: ((k + shift) % m).cast("double")
    s = 0 if side == "a" else 3
    return {"kd": n(3, s), "sig_landed": q, "sig_attempted": q + n(17, s), "total_attempted": q + n(29, s), "td_landed": n(4, s), "td_attempted": n(4, s) + 1, "sub_attempts": n(2, s), "rev": n(2, s + 1), "ctrl": n(200, 7 * s), "head": q * 0.5, "body": q * 0.3, "leg": q * 0.2, "ground": n(9, s)}


def _stats_sql(k: str) -> str:
    one = lambda s, t: f"(({k} + {t}) % 3)::double {s}_kd, q{s} {s}_sig_landed, q{s} + ({k} + {t}) % 17 {s}_sig_attempted, q{s} + ({k} + {t}) % 29 {s}_total_attempted, (({k} + {t}) % 4)::double {s}_td_landed, ({k} + {t}) % 4 + 1.0 {s}_td_attempted, (({k} + {t}) % 2)::double {s}_sub_attempts, (({k} + {t} + 1) % 2)::double {s}_rev, (({k} + {7 * t}) % 200)::double {s}_ctrl, q{s} * 0.5 {s}_head, q{s} * 0.3 {s}_body, q{s} * 0.2 {s}_leg, (({k} + {t}) % 9)::double {s}_ground"
    return f"{one('a', 0)}, {one('b', 3)}"


@query(f", src as (select contest_id, method in ('KO', 'TKO', 'SUB') finish, outcome = 'W' winner_is_a, finish_seconds::double elapsed, {_stats_sql('contest_id')} from contests), {ps_sql('src')} select contest_id, {', '.join(f'round({c}, 6) {c}' for c in kernels.SCORES)} from ps")
def ps_round(spark, d):
    """Performance scores and ten-point probabilities of every contest, taken as one round."""
    log = contests(spark, d).select("contest_id", kernels.is_finish(F.col("method")).alias("finish"), (F.col("outcome") == "W").alias("winner_is_a"), F.col("finish_seconds").cast("double").alias("elapsed"), F.struct(*[v.alias(k) for k, v in _stats("a").items()]).alias("a"), F.struct(*[v.alias(k) for k, v in _stats("b").items()]).alias("b"))
    scored = kernels.performance(log)
    return scored.select("contest_id", *[r6(F.col(c)).alias(c) for c in kernels.SCORES])


_WEIGHT_SQL = "case when finish and elapsed is not null then 1 + 0.15 * power(1 - least(1, greatest(0, elapsed / 300.0)), 2) else 1 end"
_MEAN_SQL = "round(sum(w * ps_a) / sum(w), 6) ps_a, round(sum(w * ps_b) / sum(w), 6) ps_b, round(sum(w * greatest(0, ps_a - 0.5)), 6) excess_a, round(sum(w * greatest(0, ps_b - 0.5)), 6) excess_b"


@query(
    f", n as (select *, unnest(range(1, rounds + 1)) round_num from contests), src as (select contest_id, method in ('KO', 'TKO', 'SUB') and round_num = finish_round finish, outcome = 'W' winner_is_a, finish_seconds::double elapsed, {_stats_sql('(contest_id + 31 * round_num)')} from n), {ps_sql('src')}, "
    f"wt as (select *, {_WEIGHT_SQL} w from ps) select contest_id, {_MEAN_SQL} from wt group by 1")
def ps_fight(spark, d):
    """Weighted mean of the rounds' scores and the one-sided excess of each contestant, with the finish round weighted up."""
    log = contests(spark, d).select("contest_id", (F.col("outcome") == "W").alias("winner_is_a"), "method", "finish_round", "finish_seconds", "qa", "qb", F.explode(F.sequence(F.lit(1), F.col("rounds"))).alias("round_num"))
    log = log.withColumns({"finish": kernels.is_finish(F.col("method")) & (F.col("round_num") == F.col("finish_round")), "elapsed": F.col("finish_seconds").cast("double"), "contest_key": F.col("contest_id"), "contest_id": F.col("contest_id") + 31 * F.col("round_num")})
    log = log.select("contest_key", "finish", "winner_is_a", "elapsed", F.struct(*[v.alias(k) for k, v in _stats("a").items()]).alias("a"), F.struct(*[v.alias(k) for k, v in _stats("b").items()]).alias("b"))
    scored = kernels.performance(log).withColumn("w", kernels.finish_weight(F.col("finish"), F.col("elapsed")))
    return scored.groupBy(F.col("contest_key").alias("contest_id")).agg(*_means())


def _means() -> list:
    mean = lambda v: r6(F.sum(F.col("w") * v) / F.sum("w"))
    over = lambda v: r6(F.sum(F.col("w") * F.greatest(F.lit(0.0), v - 0.5)))
    return [mean(F.col("ps_a")).alias("ps_a"), mean(F.col("ps_b")).alias("ps_b"), over(F.col("ps_a")).alias("excess_a"), over(F.col("ps_b")).alias("excess_b")]


_SHORT = {"ctrl": "ctrl_seconds", "head": "head_landed", "body": "body_landed", "leg": "leg_landed", "ground": "ground_landed"}


def scored_rounds(log: DataFrame) -> DataFrame:
    """Scores of every round of the contests that have rounds, and of the totals of the others as a round 1: contest_id, round_num, a, b, w, SCORES.

    The finish round is that of the finish where its time is known; a draw in it counts as not won by a.
    """
    stats, by_target, by_position, totals = source_tables(log)
    rounds, whole = joined_rounds(stats, by_target, by_position), totals_as_rounds(totals).withColumn("round_num", F.lit(1))
    whole = whole.join(rounds.select("contest_id").distinct(), "contest_id", "left_anti")
    rows = rounds.unionByName(whole)
    packed = F.struct(*[F.col(_SHORT.get(c, c)).cast("double").alias(c) for c in kernels.SIDE])
    pairs = log.select("contest_id", F.col("a").alias("who_a"), F.col("b").alias("who_b"), "outcome", "finish_round", "finish_seconds")
    side = lambda s: rows.select("contest_id", "round_num", F.col("contestant").alias(f"who_{s}"), packed.alias(s))
    met = pairs.join(side("a"), ["contest_id", "who_a"]).join(side("b"), ["contest_id", "round_num", "who_b"])
    ends = (F.col("round_num") == F.col("finish_round")) & F.col("finish_seconds").isNotNull()
    ready = met.select("contest_id", "round_num", "who_a", "who_b", ends.alias("finish"), F.when(ends, F.col("outcome") == "W").alias("winner_is_a"), F.when(ends, F.col("finish_seconds").cast("double")).alias("elapsed"), "a", "b")
    return kernels.performance(ready).withColumn("w", kernels.finish_weight(F.col("finish"), F.col("elapsed")))


_SCORED_SQL = f"""
al as (select contest_id, round_num, contestant, {', '.join(_SHORT.get(c, c) for c in kernels.SIDE)} from rs union all select contest_id, 1, contestant, {', '.join(_SHORT.get(c, c) for c in kernels.SIDE)} from ft where contest_id not in (select contest_id from rs)),
src as (select contest_id, x.round_num, a who_a, b who_b, x.round_num = finish_round finish, case when x.round_num = finish_round then outcome = 'W' end winner_is_a, case when x.round_num = finish_round then finish_seconds::double end elapsed,
    {', '.join(f'{s}.{_SHORT.get(c, c)}::double {t}_{c}' for s, t in (('x', 'a'), ('y', 'b')) for c in kernels.SIDE)} from contests join al x using (contest_id) join al y using (contest_id, round_num) where x.contestant = a and y.contestant = b),
{ps_sql('src')}, wt as (select *, {_WEIGHT_SQL} w from ps)"""


@query(f", {ROUNDS_SQL}, {_SCORED_SQL} select contest_id, round_num::int round_num, who_a contestant, round(ps_a, 6) ps, round(p10_8_a, 6) p10_8 from wt union all select contest_id, round_num::int, who_b, round(ps_b, 6), round(p10_8_b, 6) from wt")
def ps_round_rows(spark, d):
    """Scores of every round as two rows."""
    pair = F.array(*[F.struct(F.col(f"who_{s}").alias("contestant"), r6(f"ps_{s}").alias("ps"), r6(f"p10_8_{s}").alias("p10_8")) for s in "ab"])
    return scored_rounds(cut(_log(spark, d))).select("contest_id", "round_num", F.explode(pair).alias("s")).select("contest_id", "round_num", "s.*")


@query(
    f", {ROUNDS_SQL}, {_SCORED_SQL}, mf as (select contest_id, {_MEAN_SQL} from wt group by 1), al2 as (select contest_id, a, b, coalesce(ps_a, 0.5) ps_a, coalesce(ps_b, 0.5) ps_b, coalesce(excess_a, 0) excess_a, coalesce(excess_b, 0) excess_b from contests left join mf using (contest_id)) "
    "select contest_id, a contestant, ps_a ps, excess_a quality from al2 union all select contest_id, b, ps_b, excess_b from al2")
def ps_fight_rows(spark, d):
    """A contest's scores as two rows: from rounds (tier A) or totals (tier B); without either one half and no excess."""
    log = cut(_log(spark, d))
    found = scored_rounds(log).groupBy("contest_id").agg(*_means())
    whole = log.select("contest_id", "a", "b").join(found, "contest_id", "left").na.fill({"ps_a": 0.5, "ps_b": 0.5, "excess_a": 0.0, "excess_b": 0.0})
    pair = F.array(*[F.struct(F.col(s).alias("contestant"), F.col(f"ps_{s}").alias("ps"), F.col(f"excess_{s}").alias("quality")) for s in "ab"])
    return whole.select("contest_id", F.explode(pair).alias("s")).select("contest_id", "s.*")


# ---- attributes ----

_STAT_VALUE = {s: f"{attributes.bounds(s)[0] - 1} + (k * {7 + 2 * i} + {i * 13}) % {100 * (int(attributes.bounds(s)[1] - attributes.bounds(s)[0]) + 2)} / 100.0" for i, s in enumerate(attributes.STATS)}


def _attributes_sql() -> str:
    normal = {s: f"least(1, greatest(0, ({s} - {attributes.bounds(s)[0]}) / {attributes.bounds(s)[1] - attributes.bounds(s)[0]}))" for s in attributes.STATS}
    mean = {b: "exp((" + " + ".join(f"{w} * ln(0.02 + {normal[s]})" for s, w in ws.items()) + f") / {sum(ws.values())})" for b, (_, ws) in attributes.BUCKETS.items()}
    base = "80 + 20 * (" + " + ".join(f"{share} * {mean[b]}" for b, (share, _) in attributes.BUCKETS.items()) + ")"
    synergy = "least(1.5, " + " + ".join(f"{c} * {normal[a]} * {normal[b]}" for a, b, c in attributes.SYNERGIES) + ")"
    perks = " + ".join(f"case when {p} >= 90 then {attributes.STRENGTH[t]} else 0 end" for p, (t, _) in attributes.PERKS.items())
    evidence = ", ".join("(" + " + ".join(f"{w} * {s}" for s, w in ws.items()) + f") {p}" for p, (_, ws) in attributes.PERKS.items())
    stats = ", ".join(f"({v})::double {s}" for s, v in _STAT_VALUE.items())
    scores = ", ".join(f"round(80 + 20 * {mean[b]}, 4) {b}_overall" for b in attributes.BUCKETS)
    return (f"with st as (select k, {stats} from (select c_custkey k from customer)), pe as (select *, {evidence} from st), ov as (select *, {base} base, {synergy} synergy, {perks} perks from pe) "
            f"select k, {scores}, round(base, 4) base, round(synergy, 4) synergy, round(perks, 4)::double perks, round(least(100, greatest(80, base + synergy + perks)), 4) overall, {', '.join(f'round({p}, 4) {p}' for p in attributes.PERKS)} from ov")


@query(_attributes_sql(), views=False)
def attribute_overall(spark, d):
    """Bucket scores, base, synergy, perks and the whole of made-up stats of every customer; a perk is active where its evidence is 90 or more."""
    rows = read(spark, d, "customer").select(F.col("c_custkey").alias("k")).select("k", *[F.expr(f"cast({v} as double)").alias(s) for s, v in _STAT_VALUE.items()])
    rows = rows.withColumns({p: attributes.perk_evidence(p) for p in attributes.PERKS})
    rows = rows.withColumns({"base": attributes.base_overall(), "synergy": attributes.synergy_bonus(), "perks": attributes.perk_bonus({p: F.col(p) >= 90 for p in attributes.PERKS})})
    four = lambda c, n: F.round(c, 4).alias(n)
    return rows.select("k", *[four(c, f"{b}_overall") for b, c in attributes.bucket_scores().items()], four(F.col("base"), "base"), four(F.col("synergy"), "synergy"), four(F.col("perks"), "perks"), four(attributes.effective_overall(F.col("base"), F.col("synergy"), F.col("perks")), "overall"), *[four(F.col(p), p) for p in attributes.PERKS])


def _rules_sql() -> str:
    from itertools import chain

    stats = ", ".join(f"({i}, '{s}', {attributes.K_BASE[attributes.kind(s)]}, {attributes.CAPS[attributes.kind(s)]}, {str(s in attributes.HEALTH).lower()})" for i, s in enumerate(attributes.STATS))
    families = ", ".join(f"('{f}', '{s}')" for f, s in chain(((f, s) for f, ss in attributes.FAMILIES.items() for s in ss), (("mma", s) for s in attributes.STATS)))
    return (f", st as (select * from (values {stats}) t(i, stat, k_base, cap, health)), fam as (select * from (values {families}) t(sport, stat)), "
            "x as (select contest_id, sport, method, outcome, promotion, i, stat, k_base, cap, health, 8.0 * margin - 0.1 * i change from contests, st) "
            "select contest_id, x.stat, k_base::double k_base, round(case when x.sport = 'mma' then case when promotion >= 0.9 then 1.0 when promotion >= 0.6 then 0.8 else 0.55 end when x.sport in ('boxing', 'grappling') then 0.35 else 0.275 end, 4)::double organisation, fam.stat is not null moved, "
            "case when outcome <> 'W' then 0 when method in ('KO', 'TKO') then case x.stat when 'punch_power' then 0.8 when 'kick_power' then 0.4 else 0 end when method = 'SUB' then case when x.stat = 'submission_offence' then 0.8 when x.stat in ('top_game', 'bottom_game') then 0.5 else 0 end else 0 end::double bonus, "
            "case when health and change < 0 then 4.0 else cap end::double most, "
            "round(least(case when health then 96 else 100 end, greatest(case when health then 84 else 80 end, 85 + least(case when health and change < 0 then 4.0 else cap end, greatest(-case when health and change < 0 then 4.0 else cap end, change)))), 6) after "
            "from x left join fam on fam.sport = x.sport and fam.stat = x.stat")


@query(_rules_sql())
def attribute_rules(spark, d):
    """For every contest and stat: the base of K, the organisation's weight, whether the sport moves it, the bonus of the finish, the cap, and a stat of 85 after a change."""
    c = F.col
    rows = []
    for i, s in enumerate(attributes.STATS):
        change = 8.0 * c("margin") - 0.1 * i
        one = attributes.moved(s, change)
        rows.append(F.struct(F.lit(s).alias("stat"), F.lit(attributes.K_BASE[attributes.kind(s)]).alias("k_base"), attributes.moved_by(s, c("sport")).alias("moved"), attributes.method_bonus(s, c("method"), c("outcome") == "W").alias("bonus"), attributes.cap(s, change).alias("most"), r6(one).alias("after")))
    log = _log(spark, d).withColumns({s: F.lit(attributes.START) for s in attributes.STATS})
    found = log.select("contest_id", F.round(attributes.organisation_weight(c("promotion"), c("sport")), 4).alias("organisation"), F.explode(F.array(*rows)).alias("r"))
    return found.select("contest_id", "organisation", "r.*")


def attribute_deltas(spark: SparkSession, d: str, columns: tuple[str, ...] = attribute_fold.COLUMNS, by_day: bool = False) -> DataFrame:
    log = cut(contests(spark, d))  # read for rounds, totals and the fold
    return attribute_fold.fold(log, features_of(log), columns=columns, by_day=by_day)


@query()
def attribute_ratings(spark, d):
    """The overall before and after every contest, and the sum of the stats' changes."""
    found = attribute_deltas(spark, d, ("contest_id", "contestant", "pre_overall", "post_overall", "change", "fights"))
    return found.select("contest_id", "contestant", F.round("pre_overall", 2).alias("pre_overall"), F.round("post_overall", 2).alias("post_overall"), F.round("change", 3).alias("change"), "fights")


@query()
def attribute_snapshots(spark, d):
    """Stats, buckets and the overall of every contestant after each day."""
    return attribute_fold.scored(attribute_deltas(spark, d, attribute_fold.OF_DAY, by_day=True)).drop("stats", "perk_scores", "perk_active", "perk_above", "perk_below").withColumn("day", F.col("day").cast("string"))


@query()
def attribute_perks(spark, d):
    last = attribute_deltas(spark, d, ("contestant", "day", "perk_scores", "perk_active", "perk_above", "perk_below"), by_day=True)
    return attribute_fold.perk_rows(last).withColumn("day", F.col("day").cast("string"))
