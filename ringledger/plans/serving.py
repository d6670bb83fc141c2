"""The read side: ranking pages, profiles, histories, series, event cards and contest details, as functions of tables and as queries.

Each function takes the tables that it reads and returns rows, or one page of them; an id narrows them. The queries apply them to whole tables
derived from the contest log, in which a contestant's rating on a day comes from the day's margins, so that SQL can say the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..operators import analytics, folds, joins, loads
from ..session import cut, parts_for, read
from .contest import contests, sides
from .registry import query, r6

# The rating systems' keys and what they are, and the columns of a contestant's card.
SYSTEMS = [("dynamic_factor_bt", "Dynamic factor Bradley-Terry with cross-sport."), ("elo_ps", "Elo with tiered evidence."), ("expected_win_rate", "Expected-win-rate pool, uncertainty adjusted."), ("glicko2_ps", "Glicko-2, uncertainty-aware."), ("stacked_logit", "Stacked logistic mixture."), ("stat_builder", "Progressive stat builder."), ("unified_composite", "Unified composite of all signals.")]
CARD = ["fighter_id", "display_name", "nickname", "birth_date", "birth_place", "country_code", "fighting_out_of", "affiliation_gym", "foundation_style", "profile_image_url", "height_cm", "reach_cm", "stance", "sex"]
BY_TIER = {"A": "elo_ps", "B": "glicko2_ps", "C": "unified_composite"}

VIEWS = f"""
sn as (select case tier when 'A' then 'elo_ps' when 'B' then 'glicko2_ps' else 'unified_composite' end system, contestant, day, round(1500 + 400 * avg(edge), 4) rating, round(100.0 / count(*), 4) rd from sides group by 1, 2, 3),
lc as (select contestant, arg_max(division, (day, contest_id)) division, arg_max(sport, (day, contest_id)) sport, max(day) last_day from sides group by 1),
fs as (select system, contestant, arg_max(rating, day) rating, arg_max(rd, day) rd from sn group by 1, 2),
cr as (select system, division, contestant, sport, rating, rd, last_day, row_number() over (partition by system, division order by rating desc, contestant) as rank from fs join lc using (contestant)),
ev as (select day, 'Card ' || day::varchar as name, count(*) contests, case when count(*) % 5 > 0 then count(*) % 25 end promotion from contests group by 1)"""


# ---- tables ----


def snapshots(log: DataFrame, parts: int | None = None) -> DataFrame:
    """(system, contestant, day, rating, rd, extra): one row a contestant, system and day. ``parts``: tasks that the rows are dealt to, where the session's number is too few for them."""
    system = F.create_map(*[F.lit(x) for pair in BY_TIER.items() for x in pair])[F.col("tier")]
    each = sides(log).select(system.alias("system"), "contestant", "day", "edge", "contest_id")
    each = each if parts is None else each.repartition(parts, "system", "contestant", "day")
    rated = each.groupBy("system", "contestant", "day").agg(F.round(1500 + 400 * F.avg("edge"), 4).alias("rating"), F.round(100.0 / F.count("*"), 4).alias("rd"), F.max("contest_id").alias("contest_id"))
    return rated.select("system", "contestant", "day", "rating", "rd")


def current_rankings(history: DataFrame, log: DataFrame) -> DataFrame:
    """The last rating of every system, ranked within the division of the contestant's last contest (by day, then contest); ties by contestant."""
    now = joins.latest_per_group(history, ["system", "contestant"], [F.col("day")]).drop("day")
    last = joins.latest_per_group(sides(log).select("contestant", "day", "contest_id", "division", "sport"), ["contestant"], [F.col("day"), F.col("contest_id")]).where("division is not null")
    met = now.join(last.select("contestant", "division", "sport", F.col("day").alias("last_day")), "contestant").withColumn("_down", -F.col("rating"))
    return analytics.rank_in_group(met, ["system", "division"], ["_down", "contestant"]).drop("_down")


def events_of(log: DataFrame) -> DataFrame:
    """One event a day of the log."""
    counted = log.groupBy("day").agg(F.count("*").alias("contests"))
    return counted.select("day", F.concat(F.lit("Card "), F.col("day").cast("string")).alias("name"), "contests", F.when(F.col("contests") % 5 > 0, (F.col("contests") % 25).cast("int")).alias("promotion"))


def systems_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SYSTEMS, "system string, description string")


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``table`` and those of ``rows`` whose key it lacks."""
    return table.unionByName(rows.join(table.select(key), key, "left_anti"))


# ---- reads ----


def rankings(ranked: DataFrame, names: DataFrame, system: str | None = None, division: str | None = None) -> DataFrame:
    """Rows of a leaderboard with the contestants' names; for one system and division where they are given."""
    rows = ranked.join(names, "contestant")
    for c, v in (("system", system), ("division", division)):
        rows = rows.where(F.col(c) == v) if v is not None else rows
    return rows


def profile(history: DataFrame, contestant: int | None = None) -> DataFrame:
    """(contestant, system, rating, rd, peak): the last rating of each system and its best, by one aggregation."""
    rows = history if contestant is None else history.where(F.col("contestant") == contestant)
    last = F.max_by(F.struct("rating", "rd"), "day").alias("s")
    return rows.groupBy("contestant", "system").agg(last, F.max("rating").alias("peak")).select("contestant", "system", "s.rating", "s.rd", "peak")


def fighter_cards(fighters: DataFrame, history: DataFrame, fighter: int | None = None) -> DataFrame:
    """One contestant, or all: the columns of ``CARD`` and ``ratings``, an array of (system, rating, rd, peak) by system, empty where there are none.

    ``fighters`` is the load's table or one with the card's names; columns that it lacks are null. ``history`` has (contestant, system, day, rating, rd).
    """
    named = fighters.withColumnsRenamed({"name": "display_name", "country": "country_code"})
    named = named.select(*[F.col(c) if c in named.columns else F.lit(None).cast("string").alias(c) for c in CARD]).withColumns({c: F.col(c).cast("double") for c in ("height_cm", "reach_cm")})
    named = named if fighter is None else named.where(F.col("fighter_id") == fighter)
    rated = profile(history, fighter).groupBy("contestant").agg(F.array_sort(F.collect_list(F.struct("system", "rating", "rd", "peak"))).alias("ratings"))  # one a system
    met = named.join(rated.withColumnRenamed("contestant", "fighter_id"), "fighter_id", "left")
    return met.select(*CARD, F.coalesce("ratings", F.array().cast(rated.schema["ratings"].dataType)).alias("ratings"))


def pagination(rows: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """One row about a page: total, limit, offset, has_next, has_previous."""
    total = F.count("*")
    return rows.agg(total.alias("total"), F.lit(limit).alias("limit"), F.lit(offset).alias("offset"), (total > offset + limit).alias("has_next"), F.lit(offset > 0).alias("has_previous"))


def series_page(line: DataFrame, limit: int = 500, offset: int = 0) -> DataFrame:
    """Points of one contestant's line by day (limit 1..5000)."""
    return analytics.page(line, [F.col("day")], limit, offset, 5000)


def rating_changes(deltas: DataFrame) -> DataFrame:
    """What the folds made of each contest, for ``contest_detail``."""
    return deltas.select("contest_id", "system", "contestant", F.col("pre_rating").alias("before"), F.col("post_rating").alias("after"), (F.col("post_rating") - F.col("pre_rating")).alias("change"), "expected")


def with_participants(rows: DataFrame, log_sides: DataFrame, names: DataFrame) -> DataFrame:
    """``rows`` of contests with an array of (contestant, name, result), by contestant."""
    people = log_sides.select("contest_id", "contestant", "result").join(names, "contestant").groupBy("contest_id").agg(F.array_sort(F.collect_list(F.struct("contestant", "name", "result"))).alias("participants"))  # two a contest
    return rows.join(people, "contest_id", "left")


def history_of(log: DataFrame, names: DataFrame, contestant: int | None = None) -> DataFrame:
    """Contests of one contestant, or of all, newest first by (day, contest_id), with both participants."""
    each = sides(log)
    own = each if contestant is None else each.where(F.col("contestant") == contestant)
    rows = own.select(F.col("contestant").alias("of"), "contest_id", "day", "division", "title", "method", "finish_round", "finish_seconds")
    return with_participants(rows, each, names)


def series(history: DataFrame, system: str, contestant: int | None = None) -> DataFrame:
    """The line of one system, of one contestant or all; ``series_page`` is a page of it."""
    rows = history.where(F.col("system") == system)
    return rows if contestant is None else rows.where(F.col("contestant") == contestant)


def event_card(events: DataFrame, promotions: DataFrame, log: DataFrame, names: DataFrame, day: str | None = None) -> DataFrame:
    """Events with their promotion and, for each contest of the card, its participants."""
    some = events if day is None else events.where(F.col("day") == F.lit(day).cast("date"))
    card = some.join(promotions, "promotion", "left").join(log.select("contest_id", "day", "division", "title", "method", "finish_round"), "day")
    return with_participants(card, sides(log), names)


def contest_detail(log: DataFrame, names: DataFrame, totals: DataFrame, scores: DataFrame, changes: DataFrame, contest: int | None = None) -> DataFrame:
    """One row a contest with four arrays: participants, fight totals, performance scores and rating changes by system. Every input is keyed by the contest, so
    each is aggregated where it was shuffled to."""
    pick = lambda df: df if contest is None else df.where(F.col("contest_id") == contest)
    nested = lambda df, name: pick(df).groupBy("contest_id").agg(F.array_sort(F.collect_list(F.struct(*[c for c in df.columns if c != "contest_id"]))).alias(name))
    rows = with_participants(pick(log), sides(pick(log)), names)
    for df, name in ((totals, "totals"), (scores, "scores"), (changes, "changes")):
        rows = rows.join(nested(df, name), "contest_id", "left")
    return rows


# ---- queries ----


def _snapshots(spark, d) -> DataFrame:
    """Those of the contest log, by more tasks for larger tables."""
    return snapshots(contests(spark, d), parts_for(read(spark, d, "lineitem")))


def _names(spark, d) -> DataFrame:
    return read(spark, d, "supplier").select(F.col("s_suppkey").alias("contestant"), F.col("s_name").alias("name"))


def _flat(c: str, parts: list[str]) -> Column:
    """An array of structs as text, for comparison."""
    return F.array_join(F.transform(c, lambda p: F.concat_ws("|", *[p[x].cast("string") for x in parts])), ";")


_day = lambda c="day": F.col(c).cast("string").alias(c)


@query(f", {VIEWS} select system, contestant, day::varchar as day, rating, rd from sn")
def rating_timeseries(spark, d):
    """Every snapshot, as the series table has it."""
    return _snapshots(spark, d).withColumn("day", _day())


@query(f", {VIEWS}, al as (select system, contestant, day, rating, rd from sn union all select system, contestant, (select max(day) from contests), arg_max(rating, day), arg_max(rd, day) from sn group by 1, 2 having max(day) < (select max(day) from contests)) select system, contestant, day::varchar as day, rating, rd from al")
def snapshots_with_final(spark, d):
    """The history with a row for everyone at the last day of the log (1900-01-01 where there is none)."""
    log = cut(contests(spark, d))
    final = log.agg(F.coalesce(F.max("day"), F.to_date(F.lit("1900-01-01")))).first()[0]
    return joins.final_snapshots(snapshots(log), F.lit(final)).withColumn("day", _day())


@query(f", {VIEWS} select system, division, rank::int as rank, contestant, s_name as name, rating, rd, last_day::varchar last_day from cr join supplier on s_suppkey = contestant")
def rankings_all(spark, d):
    log = cut(contests(spark, d))
    found = rankings(current_rankings(snapshots(log), log), _names(spark, d))
    return found.select("system", "division", "rank", "contestant", "name", "rating", "rd", _day("last_day"))


@query(f", {VIEWS} select rank::int as rank, contestant, s_name as name, rating from cr join supplier on s_suppkey = contestant where system = 'elo_ps' and division = 'D1' order by rank limit 25")
def rankings_page(spark, d):
    """The first page of one leaderboard."""
    log = cut(contests(spark, d))
    found = rankings(current_rankings(snapshots(log), log), _names(spark, d), "elo_ps", "D1")
    return analytics.page(found.select("rank", "contestant", "name", "rating"), [F.col("rank")])


@query(f", {VIEWS} select system, division, count(*) total, count(*) > 25 has_next from cr join supplier on s_suppkey = contestant group by 1, 2")
def rankings_count(spark, d):
    log = cut(contests(spark, d))
    return rankings(current_rankings(snapshots(log), log), _names(spark, d)).groupBy("system", "division").agg(F.count("*").alias("total")).withColumn("has_next", F.col("total") > 25)


@query(f", {VIEWS} select contestant, s_name as name, system, rating, rd, peak from (select contestant, system, arg_max(rating, day) rating, arg_max(rd, day) rd, max(rating) peak from sn group by 1, 2) join supplier on s_suppkey = contestant")
def fighter_profiles(spark, d):
    return profile(_snapshots(spark, d)).join(_names(spark, d), "contestant")


@query(f", {VIEWS} select system, rating, rd, peak from (select system, arg_max(rating, day) rating, arg_max(rd, day) rd, max(rating) peak from sn where contestant = 7 group by 1)")
def fighter_profile(spark, d):
    """One contestant's."""
    return profile(_snapshots(spark, d), 7).drop("contestant")


_PEOPLE = "string_agg(s.contestant || '|' || s_name || '|' || s.result, ';' order by s.contestant)"


@query(f", pp as (select contest_id, {_PEOPLE} people from sides s join supplier on s_suppkey = s.contestant group by 1) select x.contestant of, contest_id, x.day::varchar as day, division, title, method, finish_round, finish_seconds, people from sides x join pp using (contest_id)")
def fighter_histories(spark, d):
    found = history_of(cut(contests(spark, d)), _names(spark, d))
    return found.select("of", "contest_id", _day(), "division", "title", "method", "finish_round", "finish_seconds", _flat("participants", ["contestant", "name", "result"]).alias("people"))


@query(f", pp as (select contest_id, {_PEOPLE} people from sides s join supplier on s_suppkey = s.contestant group by 1) select contest_id, x.day::varchar as day, method, people from sides x join pp using (contest_id) where x.contestant = 7 order by x.day desc, contest_id limit 25 offset 25")
def fighter_history_page(spark, d):
    """The second page of one contestant's contests, newest first."""
    found = history_of(cut(contests(spark, d)), _names(spark, d), 7)
    page = analytics.page(found, [F.desc("day"), F.col("contest_id")], 25, 25)
    return page.select("contest_id", _day(), "method", _flat("participants", ["contestant", "name", "result"]).alias("people"))


@query(f", {VIEWS} select contestant, count(*) points, min(day)::varchar since from sn where system = 'unified_composite' group by 1")
def series_counts(spark, d):
    found = series(_snapshots(spark, d), "unified_composite")
    return found.groupBy("contestant").agg(F.count("*").alias("points"), F.min("day").cast("string").alias("since"))


@query(f", {VIEWS} select day::varchar as day, rating, rd from sn where system = 'unified_composite' and contestant = 7")
def fighter_series(spark, d):
    return series(_snapshots(spark, d), "unified_composite", 7).select(_day(), "rating", "rd")


@query(f", {VIEWS} select ev.day::varchar as day, name, contests, promotion::int promotion, n_name promotion_name from ev left join nation on n_nationkey = promotion")
def events_all(spark, d):
    promotions = read(spark, d, "nation").select(F.col("n_nationkey").alias("promotion"), F.col("n_name").alias("promotion_name"))
    return events_of(contests(spark, d)).join(F.broadcast(promotions), "promotion", "left").select(_day(), "name", "contests", "promotion", "promotion_name")


@query(f", {VIEWS} select day::varchar as day, name, contests from ev order by ev.day desc limit 25")
def events_page(spark, d):
    return analytics.page(events_of(contests(spark, d)), [F.desc("day")]).select(_day(), "name", "contests")


@query(f", {VIEWS} select count(*) total, count(*) > 25 has_next from ev")
def events_count(spark, d):
    return events_of(contests(spark, d)).agg(F.count("*").alias("total")).withColumn("has_next", F.col("total") > 25)


@query(f", {VIEWS}, pp as (select contest_id, {_PEOPLE} people from sides s join supplier on s_suppkey = s.contestant group by 1) select c.day::varchar as day, name, n_name promotion_name, contest_id, division, title, method, finish_round, people from contests c join ev on ev.day = c.day left join nation on n_nationkey = ev.promotion left join pp using (contest_id)")
def event_cards(spark, d):
    log = cut(contests(spark, d))
    promotions = read(spark, d, "nation").select(F.col("n_nationkey").alias("promotion"), F.col("n_name").alias("promotion_name"))
    found = event_card(events_of(log), F.broadcast(promotions), log, _names(spark, d))
    return found.select(_day(), "name", "promotion_name", "contest_id", "division", "title", "method", "finish_round", _flat("participants", ["contestant", "name", "result"]).alias("people"))


@query(
    f", pp as (select contest_id, {_PEOPLE} people from sides s join supplier on s_suppkey = s.contestant group by 1), tt as (select contest_id, string_agg(contestant || '|' || q::bigint, ';' order by contestant) totals from sides group by 1), "
    "sc as (select contest_id, string_agg(contestant || '|' || round(100 * (1 + edge))::bigint, ';' order by contestant) scores from sides group by 1), ch as (select contest_id, string_agg('elo_ps|' || contestant || '|' || round(32 * edge)::bigint, ';' order by contestant) changes from sides where result in ('W', 'L') group by 1) "
    "select contest_id, day::varchar as day, sport, division, title, method, finish_round, finish_seconds, rounds::int rounds, people, totals, scores, changes from contests left join pp using (contest_id) left join tt using (contest_id) left join sc using (contest_id) left join ch using (contest_id)")
def contest_details(spark, d):
    log = cut(contests(spark, d))
    each = sides(log)
    whole = lambda c: F.round(c).cast("long")
    totals, scores = each.select("contest_id", "contestant", F.col("q").cast("long").alias("landed")), each.select("contest_id", "contestant", whole(100 * (1 + F.col("edge"))).alias("ps"))
    changes = each.where("result in ('W', 'L')").select("contest_id", F.lit("elo_ps").alias("system"), "contestant", whole(32 * F.col("edge")).alias("change"))
    found = contest_detail(log, _names(spark, d), totals, scores, changes)
    return found.select(
        "contest_id", _day(), "sport", "division", "title", "method", "finish_round", "finish_seconds", "rounds", _flat("participants", ["contestant", "name", "result"]).alias("people"), _flat("totals", ["contestant", "landed"]).alias("totals"),
        _flat("scores", ["contestant", "ps"]).alias("scores"), F.when(F.col("changes").isNotNull(), _flat("changes", ["system", "contestant", "change"])).alias("changes"))


def rated_history(deltas: DataFrame, systems: tuple[str, ...] = tuple(folds.SYSTEMS)) -> DataFrame:
    """(system, contestant, day, rating, rd) of the folds: the last rating of each day."""
    each = [loads.rating_snapshots(deltas, s, s).select(F.lit(s).alias("system"), "contestant", "day", "rating", "rd") for s in systems]
    whole = each[0]
    for part in each[1:]:
        whole = whole.unionByName(part)
    return whole


@query()
def rated_contest_details(spark, d):
    """Contests with participants, and the changes that the four rating systems made, by system and contestant."""
    log = cut(contests(spark, d))
    each = sides(log)
    totals, scores = each.select("contest_id", "contestant", F.col("q").cast("long").alias("landed")), each.select("contest_id", "contestant", F.round(100 * (1 + F.col("edge")), 2).alias("ps"))
    found = contest_detail(log, _names(spark, d), totals, scores, rating_changes(folds.fold(log)))
    shown = F.transform("changes", lambda x: F.concat_ws("|", x["system"], x["contestant"].cast("string"), *[F.format_string("%.4f", x[c]) for c in ("before", "after", "change", "expected")]))
    return found.select("contest_id", _day(), "method", _flat("participants", ["contestant", "name", "result"]).alias("people"), F.array_join(shown, ";").alias("changes"))


@query()
def rated_profiles(spark, d):
    """Every contestant's last rating, deviation and peak in the four systems, from the folds."""
    found = profile(rated_history(cut(folds.fold(contests(spark, d))))).join(_names(spark, d), "contestant")
    return found.select("contestant", "name", "system", *[F.round(c, 4).alias(c) for c in ("rating", "rd", "peak")])


@query()
def rated_series_page(spark, d):
    """The first 500 points of one contestant's unified line, by day."""
    found = series(rated_history(folds.fold(contests(spark, d), ("unified",)), ("unified",)), "unified", 7)
    return series_page(found).select(_day(), F.round("rating", 4).alias("rating"), "rd")


@query("select contest_id, string_agg(contestant || '|' || result, ';' order by contestant) people from sides where contest_id in (select l_orderkey from lineitem where l_returnflag = 'R') group by 1")
def participants_of_many(spark, d):
    """Participants of a list of contests, read by a semi join."""
    log = contests(spark, d)
    wanted = read(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("contest_id"))
    found = sides(log).join(wanted, "contest_id", "left_semi").groupBy("contest_id").agg(F.array_sort(F.collect_list(F.struct("contestant", "result"))).alias("p"))
    return found.select("contest_id", _flat("p", ["contestant", "result"]).alias("people"))


@query(", dv as (select division, case when division in ('D0', 'D3') then null else (100 + 10 * substr(division, 2)::int) end limit_lbs, division <> 'D7' canonical, case when division > 'D4' then 'F' else 'M' end sex from (select distinct division from contests)) select division, limit_lbs::int limit_lbs, sex, (row_number() over (order by sex, limit_lbs nulls last, division))::int place from dv where canonical")
def divisions_listed(spark, d):
    """Canonical divisions by sex, limit (unknown last) and key."""
    k = F.substring("division", 2, 5).cast("int")
    rows = contests(spark, d).select("division").distinct().select("division", F.when(~F.col("division").isin("D0", "D3"), 100 + 10 * k).alias("limit_lbs"), (F.col("division") != "D7").alias("canonical"), F.when(F.col("division") > "D4", "F").otherwise("M").alias("sex"))
    w = Window.orderBy("sex", F.col("limit_lbs").asc_nulls_last(), "division")  # a dimension of some dozen rows
    return rows.where("canonical").select("division", "limit_lbs", "sex", F.row_number().over(w).alias("place"))


@query("select * from (values " + ", ".join(f"('{k}', '{v}')" for k, v in SYSTEMS) + ") t(system, description)", views=False)
def systems_listed(spark, d):
    """The systems' table, to which the last is added only if it is not there."""
    table = systems_table(spark)
    return upsert(upsert(table.where("system != 'unified_composite'"), table.where("system = 'unified_composite'"), "system"), table.limit(1), "system").orderBy("system")


@query(f", {VIEWS}, x as (select system, contestant, day, rating, rd, contestant % 3 g from sn) select system, contestant, day::varchar as day, case when g = 0 then round(rating / 1000, 4) when g = 1 then null end::double strike, greatest(rating, case when g = 0 then 1600 else rating end)::double peak, case when g < 2 then '{{\"win_streak\":' || (contestant % 5) || ',\"mma_fights\":' || case g when 0 then 9 else 0 end || '}}' else '{{}}' end streaks from x".replace("{{", "{").replace("}}", "}"))
def profile_facts(spark, d):
    """Skills, peak and streak out of the snapshots' JSON; numbers in quotes do not count."""
    g, c = F.col("contestant") % 3, F.col
    extra = F.when(g == 0, F.to_json(F.struct(F.round(c("rating") / 1000, 4).alias("striking"), F.lit(1600).alias("peak"), (c("contestant") % 5).alias("streak"), F.lit(9).alias("mma_fights")))).when(
        g == 1, F.to_json(F.struct(c("rating").cast("string").alias("striking"), (c("contestant") % 5).alias("streak")))).otherwise("{}")
    rows = _snapshots(spark, d).withColumn("extra", extra)
    facts = text.profile_facts(c("extra"), c("rating"))
    return rows.select("system", "contestant", _day(), facts["strike"].cast("double").alias("strike"), facts["peak"].cast("double").alias("peak"), facts["streaks"].alias("streaks"))


@query("select max(day)::varchar newest_day, arg_max(contest_id, (day, contest_id)) newest, count(*) contests from contests")
def log_watermark(spark, d):
    """The bookmark of the log: its newest day and the newest contest of it, with the count that is checked after a load."""
    from ..sources import exports

    log = cut(contests(spark, d))
    mark = exports.watermark(log, "day", "contest_id")
    return mark.join(F.broadcast(log.agg(F.count("*").alias("contests")))).select(_day("newest_day"), "newest", "contests")


@query(f"select event_id, ts::date::varchar as day from (select event_id, coalesce(case when event_type = 'error' then null else ts end, timestamp '1900-01-01') ts from events) where ts::date <= (select max(ts)::date - 3 from events)", views=False)
def events_until(spark, d):
    """Events up to a day; those without a date count as of 1900-01-01."""
    events = read(spark, d, "events")
    last = events.agg(F.date_sub(F.max(F.to_date("ts")), 3).alias("last"))
    dated = events.select("event_id", F.coalesce(F.when(F.col("event_type") != "error", F.to_date("ts")), F.to_date(F.lit("1900-01-01"))).alias("day"))
    return dated.join(F.broadcast(last)).where("day <= last").select("event_id", _day())




@query("select contestant, '{\"peak\":{\"raw\":' || printf('%.4f', max(edge)) || '},\"record\":{\"wins\":' || count_if(result = 'W') || ',\"losses\":' || count_if(result = 'L') || '}}' extra from sides group by 1")
def profile_json(spark, d):
    """A nested record a contestant as JSON text."""
    found = sides(contests(spark, d)).groupBy("contestant").agg(F.format_string("%.4f", F.max("edge")).alias("peak"), F.count_if(F.col("result") == "W").alias("wins"), F.count_if(F.col("result") == "L").alias("losses"))
    nested = F.to_json(F.struct(F.struct(F.col("peak").alias("raw")).alias("peak"), F.struct("wins", "losses").alias("record")))
    return found.select("contestant", F.regexp_replace(nested, '"raw":"([^"]*)"', '"raw":$1').alias("extra"))


@query(f", {VIEWS} select system, count(*) as rows, count(distinct contestant) contestants, round(avg(rating), 6) mean from sn group by 1")
def load_counts(spark, d):
    """What is counted after a load."""
    return _snapshots(spark, d).groupBy("system").agg(F.count("*").alias("rows"), F.countDistinct("contestant").alias("contestants"), r6(F.avg("rating")).alias("mean"))
