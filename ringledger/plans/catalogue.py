"""All registered queries of the ratings side, with their SQL. Every query runs over whole tables.

Doubles are rounded to 6 places in both; the order of sums may differ between engines.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import kernels, text, weights
from ..operators import analytics, folds, graph, joins, loads, profiles, stacking
from ..session import cut, read
from ..sources.store import Store
from ..streaming import activity
from . import dimensions, performance, serving  # noqa: F401  they register their queries
from .contest import contests, sides
from .registry import ORACLES, QUERIES, query, r6  # noqa: F401

# ---- scans, filters, paging ----


@query("select s_suppkey::varchar fighter, s_name as name, round(s_acctbal, 2) balance from supplier where s_nationkey in (1, 3, 5)", views=False)
def scan_project_cast(spark, d):
    return read(spark, d, "supplier").where(F.col("s_nationkey").isin(1, 3, 5)).select(F.col("s_suppkey").cast("string").alias("fighter"), F.col("s_name").alias("name"), F.round("s_acctbal", 2).alias("balance"))


@query("select event_id, coalesce(value, 0) as value, coalesce(event_type, 'none') event_type from events where user_id is not null and value > 5", views=False)
def filter_null_coalesce(spark, d):
    return read(spark, d, "events").where("user_id is not null and value > 5").select("event_id", F.coalesce("value", F.lit(0.0)).alias("value"), F.coalesce("event_type", F.lit("none")).alias("event_type"))


@query("select c_custkey, c_name from customer where c_name ilike '%R#0000000_1%' order by c_name, c_custkey limit 25 offset 5", views=False)
def ilike_search(spark, d):
    found = read(spark, d, "customer").where(F.col("c_name").ilike("%R#0000000_1%")).select("c_custkey", "c_name")
    return analytics.page(found, [F.col("c_name"), F.col("c_custkey")], 25, 5)


@query("select count(*) total, count(*) > 30 has_next from customer where c_name ilike '%R#0000000_1%'", views=False)
def search_count(spark, d):
    return read(spark, d, "customer").where(F.col("c_name").ilike("%R#0000000_1%")).agg(F.count("*").alias("total")).select("total", (F.col("total") > 30).alias("has_next"))


@query("select o_orderkey, o_orderstatus from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')", views=False)
def in_list_semi(spark, d):
    return read(spark, d, "orders").join(read(spark, d, "customer").where("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey", "o_orderstatus")


@query("select contest_id, day::varchar as day, a, b, outcome, sport, division, method, rounds::int rounds, title, promotion, tier, round(margin, 6) margin from contests")
def contest_log(spark, d):
    return contests(spark, d).select("contest_id", F.col("day").cast("string").alias("day"), "a", "b", "outcome", "sport", "division", "method", "rounds", "title", "promotion", "tier", r6("margin").alias("margin"))


@query("select contest_id, contestant, opponent, result, round(edge, 6) edge from sides where sport = 'mma'")
def participants(spark, d):
    return sides(contests(spark, d).where("sport = 'mma'")).select("contest_id", "contestant", "opponent", "result", r6("edge").alias("edge"))


# ---- joins ----


@query("select contest_id, s_name contestant, n_name nation, r_name region from contests join supplier on a = s_suppkey left join nation on n_nationkey = coalesce(case when s_nationkey % 2 = 0 then s_nationkey end, 0) left join region on n_regionkey = r_regionkey")
def join_inner_left_computed_key(spark, d):
    key = F.coalesce(F.when(F.col("s_nationkey") % 2 == 0, F.col("s_nationkey")), F.lit(0))
    joined = contests(spark, d).select("contest_id", "a").join(read(spark, d, "supplier"), F.col("a") == F.col("s_suppkey"))
    nation, region = read(spark, d, "nation"), read(spark, d, "region")
    return joined.join(nation, nation.n_nationkey == key, "left").join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("contest_id", F.col("s_name").alias("contestant"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"))


@query("select x.contest_id, x.contestant, y.contestant other, x.result, y.result other_result from sides x left join sides y on x.contest_id = y.contest_id and x.contestant <> y.contestant")
def self_join_opponent(spark, d):
    x = sides(contests(spark, d)).select("contest_id", "contestant", "result")
    y = x.select("contest_id", F.col("contestant").alias("other"), F.col("result").alias("other_result"))
    return x.join(y, "contest_id", "left").where("contestant <> other").select("contest_id", "contestant", "other", "result", "other_result")


@query("select contestant, arg_max(contest_id, (day, contest_id)) contest_id, max(day)::varchar as day, arg_max(result, (day, contest_id)) result from sides group by 1")
def latest_per_group(spark, d):
    log = sides(contests(spark, d)).select("contestant", "day", "contest_id", "result")
    return joins.latest_per_group(log, ["contestant"], [F.col("day"), F.col("contest_id")]).select("contestant", "contest_id", F.col("day").cast("string").alias("day"), "result")


@query("select s_suppkey, l.contest_id, l.title from supplier, lateral (select contest_id, title from sides where contestant = s_suppkey order by day desc, contest_id desc limit 1) l")
def lateral_top1(spark, d):
    w = Window.partitionBy("contestant").orderBy(F.desc("day"), F.desc("contest_id"))
    top = sides(contests(spark, d)).select("contestant", "contest_id", "title", F.row_number().over(w).alias("n")).where("n = 1")
    return read(spark, d, "supplier").join(top, F.col("s_suppkey") == F.col("contestant")).select("s_suppkey", "contest_id", "title")


@query("select c_custkey from customer anti join (select * from orders where o_orderstatus = 'P' and o_orderpriority = '1-URGENT') on c_custkey = o_custkey", views=False)
def anti_join_missing(spark, d):
    """Customers without an urgent order that is pending."""
    urgent = read(spark, d, "orders").where("o_orderstatus = 'P' and o_orderpriority = '1-URGENT'")
    return read(spark, d, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("select c_custkey as k from customer except select o_custkey from orders where o_orderpriority = '1-URGENT'", views=False)
def set_difference(spark, d):
    return read(spark, d, "customer").select(F.col("c_custkey").alias("k")).subtract(read(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select("o_custkey"))


@query("select c_custkey, count(o_orderkey) n from customer join orders on c_custkey = o_custkey where o_orderdate is not null group by 1", views=False)
def require_partners(spark, d):
    """Orders a customer, after the assertion that every order's customer is known (it raises otherwise)."""
    orders, customers = read(spark, d, "orders"), read(spark, d, "customer")
    known = joins.require_all(orders.withColumnRenamed("o_custkey", "c_custkey"), customers, "c_custkey")
    return known.join(customers.select("c_custkey"), "c_custkey").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@query(
    "select coalesce(s.k, p.k) k, coalesce(case when s.label <> 'UNKNOWN' then s.label end, p.label, s.label) label from "
    "(select s_suppkey k, 'S' || (s_nationkey % 5) label from supplier) p full join (select c_custkey k, case when c_custkey % 3 = 0 then 'UNKNOWN' else c_mktsegment end label from customer) s on p.k = s.k", views=False)
def full_outer_merge(spark, d):
    p = read(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.concat(F.lit("S"), (F.col("s_nationkey") % 5).cast("string")).alias("label"))
    s = read(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 3 == 0, "UNKNOWN").otherwise(F.col("c_mktsegment")).alias("label"))
    return joins.merge_sources(p, s, "k")


@query(
    ", m as (select distinct o_orderdate::date checkpoint from orders where o_orderstatus = 'P' and o_orderpriority = '1-URGENT') "
    "select contest_id, coalesce(checkpoint, (select max(checkpoint) from m))::varchar checkpoint from contests asof left join m on contests.day <= m.checkpoint")
def asof_forward_checkpoint(spark, d):
    """The day of the next urgent pending order, at or after each contest's day."""
    marks = read(spark, d, "orders").where("o_orderstatus = 'P' and o_orderpriority = '1-URGENT'").select(F.to_date("o_orderdate").alias("checkpoint"), F.col("o_orderkey").alias("mark"))
    return joins.forward_asof(contests(spark, d).select("contest_id", "day"), "day", marks, "checkpoint", "mark").select("contest_id", F.col("checkpoint").cast("string").alias("checkpoint"))


@query("select distinct o_orderdate::date::varchar checkpoint, (lag(o_orderdate::date) over (order by o_orderdate::date) + 1)::varchar since from (select distinct o_orderdate::date o_orderdate from orders where o_orderstatus = 'P')", views=False)
def checkpoint_schedule(spark, d):
    """The checkpoint days and the first day that each stands for. Days are few whatever the orders, so one task may order them."""
    days = read(spark, d, "orders").where("o_orderstatus = 'P'").select(F.to_date("o_orderdate").alias("checkpoint")).distinct()
    since = F.date_add(F.lag("checkpoint").over(Window.orderBy("checkpoint")), 1)
    return days.select(F.col("checkpoint").cast("string").alias("checkpoint"), since.cast("string").alias("since"))


@query()
def greedy_match(spark, d):
    pairs = contests(spark, d).groupBy("a", "b").agg(F.count("*").alias("n"))
    return joins.greedy_match(pairs, "a", "b", "n")


@query(
    "pool as (select contestant, count(*) n from sides group by 1 order by n desc, contestant limit 300), rate as (select contestant, avg(case result when 'W' then 1.0 when 'L' then 0.0 else 0.5 end) p from sides group by 1) "
    .join([", ", "select x.contestant, round(avg(1 / (1 + exp(-(x.p - y.p)))), 6) win_rate from rate x, rate y semi join pool on y.contestant = pool.contestant where x.contestant <> y.contestant group by 1"]))
def cross_join_pool(spark, d):
    log = sides(contests(spark, d))
    rate = log.groupBy("contestant").agg(F.avg(kernels.outcome_score(F.col("result"))).alias("p"), F.count("*").alias("n"))
    pool = stacking.reference_pool(rate, "contestant", "n").select(F.col("contestant").alias("other"), F.col("p").alias("q"))
    return stacking.expected_win_rate(rate.select("contestant", "p"), pool, "contestant", kernels.logistic(F.col("p") - F.col("q"))).select("contestant", r6("win_rate").alias("win_rate"))


# ---- aggregations ----


@query(
    "select contestant, count(*) fights, count_if(result = 'W')::bigint wins, count_if(result = 'L')::bigint losses, count_if(result = 'D')::bigint draws, count_if(result = 'NC')::bigint no_contests, count_if(result = 'W' and method in ('KO', 'TKO', 'SUB'))::bigint finishes, "
    "count_if(title)::bigint title_fights, greatest(0, count_if(title and result = 'W') - 1)::bigint defenses, round(date_diff('day', min(day), max(day)) / 365.25, 6) as years from sides where sport = 'mma' group by 1")
def conditional_counts(spark, d):
    won = F.col("result") == "W"
    return sides(contests(spark, d).where("sport = 'mma'")).groupBy("contestant").agg(
        F.count("*").alias("fights"), F.count_if(won).alias("wins"), F.count_if(F.col("result") == "L").alias("losses"), F.count_if(F.col("result") == "D").alias("draws"), F.count_if(F.col("result") == "NC").alias("no_contests"),
        F.count_if(won & kernels.is_finish(F.col("method"))).alias("finishes"), F.count_if("title").alias("title_fights"), F.greatest(F.lit(0), F.count_if(won & F.col("title")) - 1).alias("defenses"),
        r6(F.datediff(F.max("day"), F.min("day")) / 365.25).alias("years"))


@query("select contestant, max(case when tier = 'A' then edge end) a_peak, max(case when tier = 'B' then edge end) b_peak, max(case when tier = 'C' then edge end) c_peak from (select contestant, tier, round(edge, 6) edge from sides) group by 1")
def pivot_peak(spark, d):
    log = sides(contests(spark, d)).select("contestant", "tier", r6("edge").alias("edge"))
    return log.groupBy("contestant").pivot("tier", ["A", "B", "C"]).agg(F.max("edge")).select("contestant", *[F.col(t).alias(f"{t.lower()}_peak") for t in "ABC"])


@query("select contestant, tier, round(edge, 6) edge from sides where day = (select max(day) from sides)")
def latest_ratings(spark, d):
    log = sides(contests(spark, d))
    return log.join(F.broadcast(log.agg(F.max("day").alias("day"))), "day").select("contestant", "tier", r6("edge").alias("edge"))


@query("select contestant, round(sum(rounds * (edge + 1) / 2) / sum(rounds), 6) mean, round(sum(rounds * greatest(0, edge / 2)), 6) excess from sides group by 1")
def weighted_mean_excess(spark, d):
    ps = (F.col("edge") + 1) / 2
    return sides(contests(spark, d)).groupBy("contestant").agg(r6(F.sum(F.col("rounds") * ps) / F.sum("rounds")).alias("mean"), r6(F.sum(F.col("rounds") * F.greatest(F.lit(0.0), F.col("edge") / 2))).alias("excess"))


@query("select user_id, arg_min(event_type, event_id) filter (event_type is not null) first_type, arg_min(value, event_id) filter (value > 10) first_large, max(value) strength from events group by 1", views=False)
def first_non_null_merge(spark, d):
    e = F.col("event_id")
    first = lambda c, ok: F.min_by(c, F.when(ok, e))
    return read(spark, d, "events").groupBy("user_id").agg(first("event_type", F.col("event_type").isNotNull()).alias("first_type"), first("value", F.col("value") > 10).alias("first_large"), F.max("value").alias("strength"))


@query("select user_id, event_type, arg_max(event_id, (round(value, 1), event_id)) event_id from events group by 1, 2", views=False)
def best_confidence(spark, d):
    return read(spark, d, "events").groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct(F.round("value", 1), "event_id")).alias("event_id"))


@query("select a, b, n, round(n / sum(n) over (partition by a), 4) confidence from (select a, b, count(*) n from contests group by 1, 2)")
def pair_confidence(spark, d):
    n = contests(spark, d).groupBy("a", "b").agg(F.count("*").alias("n"))
    return n.select("a", "b", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("a")), 4).alias("confidence"))


@query("select coalesce((select e from (select round(edge, 6) e, row_number() over (order by edge) - 1 i, count(*) over () n from sides where edge > 0) where i = least(n - 1, floor(n * 0.9))), 0) nearest_rank")
def nearest_rank_percentile(spark, d):
    return analytics.nearest_rank(sides(contests(spark, d)).where("edge > 0").select(r6("edge").alias("edge")), "edge", 0.9, 0.0)


@query(
    "x as (select contestant, avg(edge) v from sides group by 1), m as (select median(v) m, stddev_samp(v) s from x), mad as (select median(abs(v - m)) mad from x, m) "
    "select contestant, round(greatest(-4, least(4, (v - m) / case when mad > 1e-9 then 1.4826 * mad when s > 1e-9 then s else 1 end)), 6) z from x, m, mad".join([", ", ""]))
def robust_z(spark, d):
    return analytics.robust_z(sides(contests(spark, d)).groupBy("contestant").agg(F.avg("edge").alias("v")), "v").select("contestant", r6("z").alias("z"))


# ---- windows ----


@query(
    "i as (select contestant, result, sum(case when result in ('L', 'D') then 1 else 0 end) over (partition by contestant order by day, contest_id) g from sides) "
    "select contestant, max(n)::bigint longest from (select contestant, g, count_if(result = 'W') n from i group by 1, 2) group by 1".join([", ", ""]))
def streak_islands(spark, d):
    return analytics.longest_streak(sides(contests(spark, d)))


@query(
    "m as (select contestant, edge, case when row_number() over w >= 3 then avg(edge) over (partition by contestant order by day, contest_id rows 2 preceding) end m from sides window w as (partition by contestant order by day, contest_id)) "
    "select contestant, round(coalesce(max(m), avg(edge)), 6) peak from m group by 1".join([", ", ""]))
def rolling3_peak(spark, d):
    return analytics.rolling_peak(sides(contests(spark, d)), "contestant", "edge", ("day", "contest_id")).select("contestant", r6("peak").alias("peak"))


_SERIES = "t as (select contestant, day, 1500 + 400 * avg(edge) v from sides group by 1, 2), "


def _series(spark, d):
    return sides(contests(spark, d)).groupBy("contestant", "day").agg((1500 + 400 * F.avg("edge")).alias("v"))


@query(
    f", {_SERIES} l as (select *, coalesce(day - lag(day) over (partition by contestant order by day) > 180, false) late from t) "
    "select contestant, round(max(m), 6) peak from (select x.contestant, x.day, avg(y.v) m from l x join l y on x.contestant = y.contestant and y.day between x.day and x.day + 365 and (not y.late or y.day = x.day) group by 1, 2) group by 1")
def window365_peak(spark, d):
    return analytics.window_peak(_series(spark, d), "contestant", "v", "day").select("contestant", r6("peak").alias("peak"))


@query(
    f", {_SERIES} p as (select contestant, least(day - lag(day) over w, 180) gap, (v + lag(v) over w) / 2 middle from t window w as (partition by contestant order by day)) "
    "select contestant, round(coalesce(sum(gap * greatest(0, middle - 1500)), 0), 6) area, coalesce(sum(case when middle >= 1600 then gap else 0 end), 0)::bigint elite_days from p group by 1")
def auc_capped(spark, d):
    return analytics.capped_area(_series(spark, d), "contestant", "v", "day").select("contestant", F.round("area", 6).alias("area"), F.col("elite_days").cast("long").alias("elite_days"))


@query("select contest_id, contestant, round((rank() over (partition by division order by q) - 1) / count(*) over (partition by division), 6) percentile from sides")
def percentile_strict(spark, d):
    return analytics.strict_percentile(sides(contests(spark, d)), ["division"], "q").select("contest_id", "contestant", r6("percentile").alias("percentile"))


@query("select contestant, day::varchar as day, arg_max(round(edge, 6), contest_id) edge from sides group by 1, 2")
def last_wins(spark, d):
    return sides(contests(spark, d)).groupBy("contestant", "day").agg(F.max_by(r6("edge"), "contest_id").alias("edge")).withColumn("day", F.col("day").cast("string"))


@query("select contest_id, contestant, count(*) over w n, round(avg(q) over w, 6) mean from sides window w as (partition by contestant order by day, contest_id rows 9 preceding)")
def running_history(spark, d):
    found = analytics.running_means(sides(contests(spark, d)).select("contest_id", "contestant", "day", "q"), "contestant", "q", ("day", "contest_id"))
    return found.select("contest_id", "contestant", "n", r6("mean").alias("mean"))


@query("select contest_id, contestant, coalesce(day - lag(day) over (partition by contestant order by day, contest_id), 999)::int as days from sides")
def days_since_last(spark, d):
    dealt, w = analytics.in_blocks(sides(contests(spark, d)).select("contest_id", "contestant", "day"), ["contestant"], ["day", "contest_id"], 1)
    return dealt.withColumn("days", F.coalesce(F.datediff("day", F.lag("day").over(w)), F.lit(999))).where("_own").select("contest_id", "contestant", "days")


@query("select division, contestant, n::bigint n, (row_number() over (partition by division order by n desc, contestant))::int as rank from (select division, contestant, count_if(result = 'W') n from sides group by 1, 2)")
def rank_by_group(spark, d):
    won = sides(contests(spark, d)).groupBy("division", "contestant").agg(F.count_if(F.col("result") == "W").alias("n"))
    return analytics.rank_in_group(won.withColumn("_down", -F.col("n")), ["division"], ["_down", "contestant"]).drop("_down")


@query("select contestant, count(*) n from sides group by 1 order by n desc, contestant limit 25")
def topk_active(spark, d):
    return sides(contests(spark, d)).groupBy("contestant").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "contestant").limit(25)


# ---- text, dates, labels, JSON ----


@query("select k, case when k % 5 = 4 or k % 5 = 3 then null else (k % 30) + (k % 7) + case when k % 5 = 1 then k % 3 else 0 end end::bigint total from (select s_suppkey k from supplier)", views=False)
def text_parse_record(spark, d):
    k = F.col("k")
    record = F.when(k % 5 == 4, "N/A").when(k % 5 == 3, F.concat((k % 30).cast("string"), F.lit(" (2-1)"))).when(k % 5 == 1, F.format_string("%d-%d-%d (1 NC)", k % 30, k % 7, k % 3)).otherwise(F.format_string(" %d-%d", k % 30, k % 7))
    return read(spark, d, "supplier").select(F.col("s_suppkey").alias("k")).select("k", text.record_total(record).alias("total"))


@query("select k, case when k % 4 = 0 then null else (k % 15) * 60 + k % 60 end::int as seconds, case when k % 4 = 0 then 0 else k % 5 end::int round_num from (select c_custkey k from customer)", views=False)
def parse_mmss(spark, d):
    k = F.col("k")
    clock = F.when(k % 4 == 0, "--").otherwise(F.format_string(" %d:%02d ", k % 15, k % 60))
    label = F.when(k % 4 == 0, "Totals").otherwise((k % 5).cast("string"))
    return read(spark, d, "customer").select(F.col("c_custkey").alias("k")).select("k", text.minutes_seconds(clock).alias("seconds"), text.round_number(label).alias("round_num"))


@query("select page_id, nullif(regexp_extract(rtrim(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), '([^/]*)$', 1), '') slug from pages", views=False)
def parse_slug(spark, d):
    return read(spark, d, "pages").select("page_id", text.last_path_part(F.col("url")).alias("slug"))


@query("select o_orderkey, case when o_orderkey % 4 = 3 then null else o_orderdate::date end::varchar as day from orders", views=False)
def parse_date_multi(spark, d):
    k, t = F.col("o_orderkey"), F.col("o_orderdate")
    raw = F.when(k % 4 == 0, F.date_format(t, "yyyy-MM-dd")).when(k % 4 == 1, F.date_format(t, "yyyy-MMM dd")).when(k % 4 == 2, F.concat(F.lit("  "), F.date_format(t, "yyyy-MMM  dd"), F.lit(" "))).otherwise("soon")
    return read(spark, d, "orders").select("o_orderkey", text.flexible_date(raw).cast("string").alias("day"))


_METHODS = ["KO", "tko", "SUB", "Dec", "DQ", "", "NC"]
_DETAILS = ["", "Unanimous decision", "split", "Doctor stoppage", "result OVERTURNED", "majority draw", "knockout"]


@query(
    f"x as (select contest_id, upper(trim({_METHODS}[contest_id % 7 + 1])) m, lower(trim({_DETAILS}[contest_id // 7 % 7 + 1])) t from contests), y as (select *, m = 'DEC' or contains(t, 'decision') decided from x) "
    "select contest_id, case when contains(t, 'overturned') then 'OVERTURNED' when contains(m, 'SUB') then 'SUB' when m = 'DQ' then 'DQ' when m = 'KO' or contains(t, 'knockout') then 'KO' "
    "when m = 'TKO' or contains(t, 'doctor') or contains(t, 'corner stoppage') or contains(t, 'injury') then 'TKO' when decided then 'DEC' when m <> '' then 'OTHER' else 'UNKNOWN' end as method, "
    "case when contains(t, 'overturned') or contains(m, 'SUB') or m in ('DQ', 'KO', 'TKO') or contains(t, 'knockout') or contains(t, 'doctor') then 'NA' when decided then case when contains(t, 'unanimous') then 'UD' when contains(t, 'split') then 'SD' "
    "when contains(t, 'majority') then 'MD' when contains(t, 'draw') then 'DRAW' else 'NA' end when m <> '' then 'NA' else 'UNKNOWN' end decision from y".join([", ", ""]))
def method_rules(spark, d):
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))
    k = F.col("contest_id")
    found = text.method_group(pick(_METHODS, k % 7), pick(_DETAILS, F.floor(k / 7) % 7))
    return contests(spark, d).select("contest_id", found.alias("m")).select("contest_id", "m.method", "m.decision")


@query(
    "select c_custkey, case c_custkey % 6 when 0 then 'LHW' when 1 then 'LW' when 2 then 'SHW' when 3 then 'OPEN' when 4 then 'FLY' end code, "
    "case greatest(0, least(9, (c_custkey % 6))) when 0 then 'lb' when 1 then 'kg' end unit, case c_custkey % 6 when 0 then (100 + c_custkey % 160)::decimal(10, 2) when 1 then round_even((45 + c_custkey % 70)::decimal(12, 5) * 2.20462, 2)::decimal(10, 2) end::double lbs from customer", views=False)
def weight_class_rules(spark, d):
    k = F.col("c_custkey")
    label = F.when(k % 6 == 0, F.format_string("Light Heavyweight %d lbs", 100 + k % 160)).when(k % 6 == 1, F.format_string("Super Lightweight (%d kg)", 45 + k % 70)).when(k % 6 == 2, "Super heavyweight").when(k % 6 == 3, "Open").when(k % 6 == 4, "Women's Flyweight")
    limit = weights.weight_limit(label, F.lit(None).cast("string"))
    return read(spark, d, "customer").select("c_custkey", weights.division_phrase(label).alias("code"), limit.alias("w")).select("c_custkey", "code", "w.unit", F.col("w.lbs").cast("double").alias("lbs"))


@query(
    "with l as (select * from (values " + ", ".join(f"({k}, '{c}', {v})" for k, (c, v) in enumerate(weights.LIMITS)) + ") t(k, code, lim)) select c_custkey, arg_min(code, abs(lim - (90 + c_custkey % 190)) * 100 + k) code from customer, l group by 1", views=False)
def nearest_division(spark, d):
    return read(spark, d, "customer").select("c_custkey", weights.nearest_division(90 + F.col("c_custkey") % 190).alias("code"))


@query("select event_id, case when event_id % 4 in (0, 1) then null else (props::json->>'k')::double end k from events", views=False)
def json_extract_numeric(spark, d):
    """Numbers that stand as such under a key; not those in quotes, nor those of an inner object."""
    quoted, inner = F.regexp_replace("props", r":\s*(\d+)", ': "$1"'), F.concat(F.lit('{"x": '), F.col("props"), F.lit("}"))
    doc = F.when(F.col("event_id") % 4 == 0, quoted).when(F.col("event_id") % 4 == 1, inner).otherwise(F.col("props"))
    return read(spark, d, "events").select("event_id", text.json_number(doc, "k").alias("k"))


# ---- generators ----


_OUTCOMES, _DECISIONS, _OTHERS = ["W", "L", "D", "NC", "UNKNOWN"], ["UD", "SD", "MD", "TD", "DRAW", "NA", "UNKNOWN"], ["KO", "TKO", "SUB", "DQ", "OVERTURNED", "OTHER", "UNKNOWN"]


@query(f"select o outcome, m as method, d decision from (select unnest({_OUTCOMES}) o), (select unnest({['DEC', *_OTHERS]}) m), (select unnest({_DECISIONS}) d) where m = 'DEC' or d in ('NA', 'UNKNOWN')", views=False)
def ontology_cross(spark, d):
    axis = lambda values, name: F.explode(F.array(*[F.lit(v) for v in values])).alias(name)
    rows = spark.range(1).select(axis(_OUTCOMES, "outcome")).select("outcome", axis(["DEC", *_OTHERS], "method")).select("*", axis(_DECISIONS, "decision"))
    return rows.where("method = 'DEC' or decision in ('NA', 'UNKNOWN')")


# ---- kernels ----

_TARGET_SQL = """
e as (select *, 1 / (1 + exp(-((a - b) / 400.0))) x from contests),
s as (select *, case outcome when 'W' then 1.0 when 'L' then -1.0 else 0.0 end sg from e),
u as (select *, least(1, greatest(0, 0.5 + sg * 0.24 + 0.22 * margin + sg * (case when method in ('KO', 'TKO', 'SUB') then 0.04 else 0 end + 0.03 * (1 - least(1, ((finish_round - 1) * 300 + finish_seconds) / (greatest(rounds, finish_round) * 300.0)))))) base from s),
t as (select *, case outcome when 'W' then case when base < greatest(0.5, x + 0.01) then greatest(0.5, x + 0.01) when base > 1 then 1 else base end
    when 'L' then case when base < 0 then 0 when base > least(0.5, x - 0.01) then least(0.5, x - 0.01) else base end else 0.5 end target from u)"""


@query(f", {_TARGET_SQL} select contest_id, round(x, 6) expected, round(target, 6) target from t")
def target_score(spark, d):
    log = contests(spark, d).withColumn("expected", kernels.logistic((F.col("a") - F.col("b")) / 400.0))
    c = F.col
    return log.select("contest_id", r6("expected").alias("expected"), r6(kernels.target_score(c("outcome"), c("method"), c("margin"), c("finish_round"), c("finish_seconds"), c("rounds"), c("expected"))).alias("target"))


@query(
    ", p as (select contest_id, contestant, row_number() over w - 1 fights, day - lag(day) over w as days, tier, rounds, title, method, edge, promotion from sides where sport = 'mma' and result in ('W', 'L') window w as (partition by contestant order by day, contest_id)) "
    "select contest_id, contestant, round(24 * case tier when 'A' then 1 when 'B' then 0.85 else 0.7 end * case when rounds >= 5 or title then 1.08 else 1 end * case when method in ('KO', 'TKO', 'SUB') then 1.06 else 1 end * (1 + least(0.35, 0.4 * abs(edge))) "
    "* case when promotion is null then 1 else least(1.1, greatest(0.75, 0.85 + 0.3 * promotion)) end * case when fights < 5 then 1.15 when fights < 12 then 1 else 0.92 end * case when days > 540 then 0.9 else 1.03 end, 6) k from p")
def k_factors(spark, d):
    w, c = Window.partitionBy("contestant").orderBy("day", "contest_id"), F.col
    log = sides(contests(spark, d).where("sport = 'mma' and outcome in ('W', 'L')")).withColumns({"fights": F.row_number().over(w) - 1, "days": F.datediff("day", F.lag("day").over(w))})
    return log.select("contest_id", "contestant", r6(kernels.k_static(c("tier"), c("rounds"), c("title"), c("method"), c("edge"), c("promotion")) * kernels.k_career(c("fights"), c("days"))).alias("k"))


# ---- rating systems ----


@query()
def rating_folds(spark, d):
    """Elo, Glicko and factor changes of every contest."""
    found = folds.fold(contests(spark, d))
    return found.select("system", "contest_id", "contestant", *[F.round(c, 4).alias(c) for c in ("pre_rating", "post_rating", "expected", "target", "k", "rd")], "fights")


@query()
def ratings_by_stage(spark, d):
    """Elo changes with the contests of a day in the order of their tournaments' stages."""
    from .dimensions import same_day_order

    log, k = contests(spark, d), F.col("contest_id")
    log = log.withColumns({"total_a": F.when(k % 3 > 0, F.col("qa").cast("long") % 7), "total_b": F.when(k % 4 > 0, F.col("qb").cast("long") % 7), "name_a": F.concat(F.lit("N"), F.col("a").cast("string")), "name_b": F.concat(F.lit("N"), F.col("b").cast("string"))})
    return folds.fold(same_day_order(log), ("elo",)).select("contest_id", "contestant", *[F.round(c, 4).alias(c) for c in ("pre_rating", "post_rating", "expected", "k")])


@query()
def ratings_in_loads(spark, d):
    """Elo changes of three loads into a store, the last of which has late contests; the same as those of the whole log."""
    log = cut(contests(spark, d))
    spans = log.agg(F.percentile_approx(F.unix_date("day"), [0.5, 0.8])).first()[0]
    late, number = F.col("contest_id") % 50 == 0, F.unix_date("day")
    store = Store(spark, f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/ratings-{uuid.uuid4().hex}")
    for part in (log.where((number <= spans[0]) & ~late), log.where((number > spans[0]) & (number <= spans[1]) & ~late), log):
        loads.load_contests(store, part, ("elo",))
    return store.read("deltas").select("contest_id", "contestant", *[F.round(c, 4).alias(c) for c in ("pre_rating", "post_rating", "expected", "k")])


@query()
def profile_snapshots(spark, d):
    """All-time profiles as stored snapshots of one system, with the whole nested record."""
    log = cut(contests(spark, d))
    store = Store(spark, f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/profiles-{uuid.uuid4().hex}")
    loads.store_profiles(store, sides(log), folds.fold(log))
    return store.read("snapshots", ["goat"]).select("system_id", "contestant", F.col("day").cast("string").alias("day"), "rating", "extra")


@query()
def unified_ratings(spark, d):
    """Last composite rating of every contestant, its deviation, and the rating less the deviation."""
    now = folds.latest(folds.fold(contests(spark, d), ("unified",)))
    return now.select("contestant", F.round("rating", 4).alias("rating"), F.round("rd", 4).alias("rd"), F.round(F.col("rating") - F.col("rd"), 4).alias("conservative"), "fights")


@query()
def alltime_profiles(spark, d):
    """Pillars and composite of every qualified career, best first."""
    log = cut(contests(spark, d))
    found = profiles.profiles(sides(log), folds.fold(log)).withColumn("_down", -F.col("score"))
    found = analytics.rank_in_group(found, [], ["_down", "contestant"], "place").drop("_down")
    return found.select("contestant", "place", *[F.round(c, 4).alias(c) for c in found.columns if c.startswith(("z_", "peak_"))], F.round("score", 4).alias("score"))


@query()
def expected_win_rates(spark, d):
    """Mean stacked win probability against the most active contestants, less the doubt of the factor rating; best first."""
    log = cut(contests(spark, d))
    deltas = cut(folds.fold(log, ("elo", "glicko", "factor")))
    found = stacking.win_rates(log, sides(log.where("sport = 'mma'")), deltas, folds.latest(deltas)).withColumn("_down", -F.col("adjusted"))
    ranked = analytics.rank_in_group(found, [], ["_down", "contestant"])
    return ranked.select("contestant", r6("win_rate").alias("win_rate"), r6("doubt").alias("doubt"), r6("adjusted").alias("adjusted"), "rank")


@query("select date_trunc('day', ts)::timestamp::varchar as start, event_type, count(*) n, round(sum(value), 4) total from events group by 1, 2", views=False)
def windowed_activity(spark, d):
    found = activity.windowed_counts(read(spark, d, "events"))
    return found.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query()
def leaderboard(spark, d):
    """Current Elo ranking of all contestants, by the division of the last contest."""
    log = cut(contests(spark, d))
    now = folds.latest(folds.fold(log, ("elo",)))
    last = sides(log).groupBy("contestant").agg(F.max_by("division", F.struct("day", "contest_id")).alias("division"))
    named = now.join(last, "contestant").join(read(spark, d, "supplier").select(F.col("s_suppkey").alias("contestant"), F.col("s_name").alias("name")), "contestant")
    ranked = analytics.rank_in_group(named.withColumn("_down", -F.col("rating")), ["system", "division"], ["_down", "contestant"])
    return ranked.select("system", "division", "rank", "contestant", "name", F.round("rating", 4).alias("rating"), "fights", "day")


@query()
def stacked_predictions(spark, d):
    """Stacked win probabilities from the three systems, fitted on all decided MMA contests."""
    log = cut(contests(spark, d))
    return stacking.stack(log, sides(log.where("sport = 'mma'")), folds.fold(log, ("elo", "glicko", "factor"))).select("contest_id", F.round("p", 6).alias("p"), "won")


_EDGES = "ed as (select src, dst, sum(w)::double w from (select case outcome when 'W' then b else a end src, case outcome when 'W' then a else b end dst, case outcome when 'D' then 0.5 else 1.0 end w from contests where outcome in ('W', 'L', 'D') union all select b, a, 0.5 from contests where outcome = 'D') group by 1, 2)"


@query(
    f", {_EDGES}, nd as (select distinct unnest([src, dst]) node from ed), sh as (select src, dst, w / sum(w) over (partition by src) share from ed), ld as (select node, node in (select src from ed) leads, (select count(*) from nd) n from nd), "
    "pr0 as (with recursive it(k, node, r) as (select 0, node, 1.0::double / n from ld union all select k + 1, ld.node, 0.15 / ld.n + 0.85 * ((select coalesce(sum(i.r), 0) from it i join ld l on l.node = i.node where not l.leads) / ld.n + coalesce(g.r, 0)) "
    "from (select max(k) k from it) kk, ld left join (select dst, sum(share * i.r) r from it i join sh on sh.src = i.node group by 1) g on g.dst = ld.node where k < 60) select * from it where k = 60) select node, round(r, 8) as rank from pr0")
def pagerank(spark, d):
    """Ranks from loser to winner; the SQL makes 60 steps, by which both have settled."""
    found = graph.pagerank(graph.result_edges(contests(spark, d)))
    return found.select("node", F.round("rank", 8).alias("rank"))


@query(f", {_EDGES} select src, dst, w from ed")
def result_edges(spark, d):
    return graph.result_edges(contests(spark, d))


@query("select contestant, count(*) contests from sides group by 1")
def connectivity(spark, d):
    return graph.connectivity(contests(spark, d))


@query("select contest_id, round(1 / (1 + exp(-(ln(greatest(qa / 100, 1e-12)) - ln(greatest(qb / 100, 1e-12))))), 6) p from contests")
def rank_probability(spark, d):
    return contests(spark, d).select("contest_id", r6(graph.win_probability(F.col("qa") / 100, F.col("qb") / 100)).alias("p"))


@query("select contestant, min(contestant) over () component from (select distinct contestant from sides)")
def contest_components(spark, d):
    return graph.components(contests(spark, d), "a", "b").select(F.col("node").alias("contestant"), "component")


@query(
    "with recursive e as (select c_custkey u, lag(c_custkey) over (partition by c_nationkey, c_mktsegment order by c_custkey) v from customer), b as (select u, v from e where v is not null union all select v, u from e where v is not null), "
    "r(u, m) as (select u, u from b union select b.u, r.m from r join b on b.v = r.u where r.m < b.u) select u as customer, min(m) component from r group by 1", views=False)
def chain_components(spark, d):
    """Components of many chains: each customer is tied to the one before in its nation and segment."""
    before = F.lag("c_custkey").over(Window.partitionBy("c_nationkey", "c_mktsegment").orderBy("c_custkey"))
    chains = read(spark, d, "customer").select(F.col("c_custkey").alias("x"), before.alias("y"))
    return graph.components(chains, "x", "y").select(F.col("node").alias("customer"), "component")
