"""The star schema's dimensions and bridges as queries: sports, promotions, weight classes, rulesets, identities, participants and same-day order.

The sources' raw labels are derived from the given tables, by the same text in both engines.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text, weights
from ..operators import joins
from ..session import read
from .contest import contests
from .registry import query, r6

# How much a sport's results count for MMA.
TRANSLATION = {
    "mma": 1.00, "valetudo": 0.95, "pancrase": 0.92, "sambo": 0.85, "combat_jj": 0.80, "wrestling": 0.78, "grappling": 0.75, "judo": 0.62, "shootboxing": 0.62, "sanda": 0.60, "muay": 0.60, "lethwei": 0.58, "kickboxing": 0.55,
    "boxing": 0.45, "boxing_cage": 0.45, "boxing_raw": 0.45, "karate": 0.35, "knuckle": 0.30, "knuckle_mma": 0.30, "custom": 0.25, "ice_fighting": 0.10, "slap": 0.05,
}
_SPORTS = list(text.SPORTS[:-1]) + ["chess"]


def _pick(values: list, i: F.Column) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (i % len(values) + 1).cast("int"))


def _case(values: list, i: str) -> str:
    text = ", ".join("null" if v is None else repr(v) if '"' not in repr(v) else "'" + v.replace("'", "''") + "'" for v in values)
    return f"([{text}])[{i} % {len(values)} + 1]"


# ---- text, enums, dates ----

#: Raw texts of orders, the same in both engines: identifiers, urls, times, details, flags, numbers, labels and sizes, in several spellings each.
_LABELS2 = ["Decision - Unanimous", " KO/TKO", "Submission", "Could Not Continue", "dq", "Overturned", "S-DEC", "Decision - Majority", "TKO - Doctor's Stoppage", "KO", "Decision", "Decision (draw)", "", "Other thing"]
_RESULTS = [" w", "L", "Draw", "d ", "NC", "no contest", "lost", ""]
_FLAGS = ["true", " T", "1", "Yes", "n", "FALSE", "0", "maybe", ""]
_RAW = {
    "id": ("case k % 5 when 0 then 'urn:uuid:' || upper(dashed) when 1 then '{' || hex || '}' when 2 then dashed when 3 then substr(hex, 1, 20) else ' ' end"),
    "url": ("case k % 3 when 0 then 'https://x.org/fightcenter/fighters/' || k || '-some-one?a=' || c when 1 then '/fighters/' || c || '#top' else 'https://x.org/fighters/' end"),
    "stamp": ("case k % 4 when 0 then day || 'T' || hh || ':' || mm || ':30Z' when 1 then day || 'T' || hh || ':' || mm || ':30+02:00' when 2 then day || ' ' || hh || ':' || mm || ':30' else 'soon ' || day end"),
    "details": ("case k % 3 when 0 then 'Round R' || (k % 5) || ' at ' || (k % 14) || ':' || mm when 1 then 'by ' || (c % 60) || ':' || mm || ' in r' || (c % 7) else 'no time, ' || c end"),
    "sex": ("case c % 3 when 0 then ' ' || lower(status) when 1 then status || ' ' else 'm' end"),
    "whole": ("case k % 3 when 0 then ' ' || c when 1 then price || '' else '-' || k end"),
    "number": ("case k % 3 when 0 then ' ' || price when 1 then status else '-' || c end"),
    "slug": ("case k % 2 when 0 then k || '-some-one' || c else 'some-' || c || '-one' end"),
}


@query(
    "with o as (select o_orderkey k, o_custkey c, o_orderstatus status, o_orderpriority priority, round(o_totalprice)::bigint::varchar || '.5' price, strftime(o_orderdate::date, '%Y-%m-%d') as day, md5(o_orderkey::varchar) hex, lpad((o_custkey % 24)::varchar, 2, '0') hh, lpad((o_orderkey % 60)::varchar, 2, '0') mm from orders), "
    "q as (select *, substr(hex, 1, 8) || '-' || substr(hex, 9, 4) || '-' || substr(hex, 13, 4) || '-' || substr(hex, 17, 4) || '-' || substr(hex, 21) dashed from o), "
    f"r as (select k, c, priority, {', '.join(f'{v} r_{n}' for n, v in _RAW.items())}, {_case(_LABELS2, 'k')} r_label, {_case(_RESULTS, 'k')} r_result, {_case(_FLAGS, 'k')} r_flag from q), "
    "x as (select *, lower(regexp_replace(replace(lower(trim(r_id)), 'urn:uuid:', ''), '[{}-]', '', 'g')) h, lower(trim(coalesce(r_label, ''))) l, upper(trim(r_result)) u, lower(trim(r_flag)) f, (k % 1000) * 635 milli from r) "
    "select k, case when regexp_full_match(h, '[0-9a-f]{32}') then substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21) end id, nullif(regexp_extract(r_url, '/fighters/([^/?#]+)', 1), '') profile, "
    "strftime(case when k % 4 = 1 then strptime(left(r_stamp, 19), '%Y-%m-%dT%H:%M:%S') - interval 2 hour when k % 4 = 0 then strptime(left(r_stamp, 19), '%Y-%m-%dT%H:%M:%S') when k % 4 = 2 then strptime(r_stamp, '%Y-%m-%d %H:%M:%S') end, '%Y-%m-%d %H:%M:%S') fetched, "
    "(try_cast(nullif(regexp_extract(r_details, '(\\d+):(\\d{2})', 1), '') as int) * 60 + try_cast(nullif(regexp_extract(r_details, '(\\d+):(\\d{2})', 2), '') as int))::int as seconds, try_cast(nullif(regexp_extract(r_details, '[Rr](\\d+)', 1), '') as int) as round, "
    "case when upper(trim(r_sex)) in ('M', 'F') then upper(trim(r_sex)) else 'U' end sex, case when regexp_full_match(trim(r_whole), '[+-]?\\d+') then trim(r_whole)::int else -1 end as whole, coalesce(try_cast(trim(r_number) as double), 0.0) number, "
    "case when priority in ('1-URGENT', '2-HIGH') then priority else 'UNKNOWN' end corner, case when f in ('true', 't', '1', 'yes', 'y') then true when f in ('false', 'f', '0', 'no', 'n') then false end flag, "
    "case when u in ('W', 'L') then u when u in ('D', 'DRAW') then 'D' when u in ('NC', 'NO CONTEST', 'NO-CONTEST') then 'NC' else 'UNKNOWN' end outcome, "
    "case when l = '' then 'UNKNOWN/UNKNOWN' when contains(l, 'overturned') then 'OVERTURNED/NA' when contains(l, 'dq') then 'DQ/NA' when contains(l, 'submission') or l = 'sub' then 'SUB/NA' when contains(l, 'ko/tko') or contains(l, 'doctor') then 'TKO/NA' "
    "when l in ('decision - unanimous', 'u-dec') then 'DEC/UD' when l in ('decision - split', 's-dec') then 'DEC/SD' when l in ('decision - majority', 'm-dec') then 'DEC/MD' when l in ('decision', 'decision - technical', 't-dec') then 'DEC/NA' when contains(l, 'decision') and contains(l, 'draw') then 'DEC/DRAW' "
    "when contains(l, 'could not continue') then 'OTHER/NA' when contains(l, 'ko') then 'KO/NA' else 'OTHER/NA' end as method, ((milli // 10 + case when milli % 10 > 5 or (milli % 10 = 5 and (milli // 10) % 2 = 1) then 1 else 0 end) / 100.0)::double cm, "
    "array_to_string(list_transform(string_split(regexp_replace(r_slug, '^\\d+-', ''), '-'), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ') as name from x", views=False)
def text_tokens(spark, d):
    """Identifiers, urls, times, rounds, genders, numbers, labels, flags, results, methods, sizes and names of raw texts of every order."""
    c = F.col
    pad = lambda x: F.lpad(x.cast("string"), 2, "0")
    o = read(spark, d, "orders").select(
        c("o_orderkey").alias("k"), c("o_custkey").alias("c"), c("o_orderstatus").alias("status"), c("o_orderpriority").alias("priority"), F.concat(F.round("o_totalprice").cast("long").cast("string"), F.lit(".5")).alias("price"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
        F.md5(c("o_orderkey").cast("string")).alias("hex"), pad(c("o_custkey") % 24).alias("hh"), pad(c("o_orderkey") % 60).alias("mm"))
    cut_at = lambda start, n: F.substring("hex", start, n)
    o = o.withColumn("dashed", F.concat_ws("-", cut_at(1, 8), cut_at(9, 4), cut_at(13, 4), cut_at(17, 4), cut_at(21, 12)))
    r = o.select("k", "priority", *[F.expr(v).alias(n) for n, v in _RAW.items()], *[_pick(values, c("k")).alias(n) for n, values in (("label", _LABELS2), ("result", _RESULTS), ("flag", _FLAGS))])
    met = text.method_group_second(c("label"), F.lit(None).cast("string"))
    return r.select(
        "k", text.uuid(c("id")).alias("id"), text.profile_id_in_url(c("url")).alias("profile"), F.date_format(text.timestamp(c("stamp")), "yyyy-MM-dd HH:mm:ss").alias("fetched"), text.time_in_details(c("details")).alias("seconds"), text.round_in_details(c("details")).alias("round"),
        text.gender(c("sex")).alias("sex"), text.int_or(c("whole"), -1).alias("whole"), text.double_or(c("number"), 0.0).alias("number"), text.member(c("priority"), ("1-URGENT", "2-HIGH"), None, "UNKNOWN").alias("corner"), text.boolean(c("flag")).alias("flag"),
        text.result(c("result")).alias("outcome"), F.concat_ws("/", met["method"], met["decision"]).alias("method"), text.inches_to_cm((c("k") % 1000 / 4).cast("decimal(10,2)")).cast("double").alias("cm"), text.name_of_slug(c("slug")).alias("name"))


@query("select contest_id, coalesce(case when contest_id % 3 = 0 then day - 1 end, day)::varchar processing, round(case when method = 'DEC' then case when title then rounds * 5.0 else finish_round * 5.0 end else (finish_round - 1) * 5.0 + finish_seconds / 60.0 end, 6) as minutes from contests")
def processing_dates(spark, d):
    """The source's own date of an event where its JSON has one, and the minutes that a contest took: by round and time, by round, or by schedule."""
    k, day = F.col("contest_id"), F.col("day")
    meta = F.when(k % 3 == 0, F.to_json(F.struct(F.date_format(F.date_sub("day", 1), "yyyy-MM-dd").alias("tapology_event_date")))).when(k % 3 == 1, F.lit('{"tapology_event_date": "soon"}'))
    known = F.col("method") != "DEC"
    minutes = text.fight_minutes(F.when(known | ~F.col("title"), F.col("finish_round")), F.when(known, F.col("finish_seconds")), F.col("rounds"))
    return contests(spark, d).select("contest_id", text.processing_date(meta, day).cast("string").alias("processing"), r6(minutes).alias("minutes"))


@query(
    "select contest_id, case when method = 'SUB' then 'NC' when contest_id % 3 = 0 then 'W' when contest_id % 3 = 1 then 'L' else 'D' end red, case when method = 'SUB' then 'NC' when contest_id % 3 = 0 then 'L' when contest_id % 3 = 1 then 'W' else 'D' end blue, "
    "case when outcome = 'D' then 'DRAW' when method <> 'DEC' then 'NA' when contest_id % 2 = 0 then 'NA' else 'UD' end decision, case when outcome in ('W', 'L', 'D', 'NC') then outcome end pair_outcome, "
    "case when contest_id % 7 = 0 then 'UNKNOWN' else method end finish, method in ('KO', 'TKO', 'SUB') early, "
    "case when sport = 'mma' then case when title and rounds = 5 then 'unified_mma_title_5x5' else 'unified_mma_' || case when contest_id % 5 = 0 then case when title then 5 else 3 end else rounds end || 'x5' end when contest_id % 5 = 0 then sport || '_unknown' else sport || '_' || rounds || 'x5' end ruleset "
    "from (select *, case when contest_id % 5 = 0 and title then true else title end t from contests) where not (title and contest_id % 5 = 0 and sport = 'mma') "
    "union all select contest_id, case when method = 'SUB' then 'NC' when contest_id % 3 = 0 then 'W' when contest_id % 3 = 1 then 'L' else 'D' end, case when method = 'SUB' then 'NC' when contest_id % 3 = 0 then 'L' when contest_id % 3 = 1 then 'W' else 'D' end, "
    "case when outcome = 'D' then 'DRAW' when method <> 'DEC' then 'NA' when contest_id % 2 = 0 then 'NA' else 'UD' end, outcome, case when contest_id % 7 = 0 then 'UNKNOWN' else method end, method in ('KO', 'TKO', 'SUB'), 'unified_mma_title_5x5' from contests where title and contest_id % 5 = 0 and sport = 'mma'")
def result_rules(spark, d):
    """Outcomes of both corners, decisions, the pair's outcome, finish methods and rulesets of every contest."""
    k, c = F.col("contest_id"), F.col
    winner = F.when(k % 3 == 0, c("a")).when(k % 3 == 1, c("b"))
    corners = text.corner_results(winner, c("a"), c("b"), F.when(c("method") == "SUB", "OVERTURNED").otherwise(c("method")))
    decision = text.decision_for(c("outcome"), c("method"), F.when(k % 2 == 0, "UNKNOWN").otherwise("UD"))
    other = F.create_map(*[F.lit(x) for x in ("W", "L", "L", "W", "D", "D", "NC", "NC")])[c("outcome")]
    pair = text.pair_outcome(F.when(k % 2 == 0, c("outcome")).otherwise("UNKNOWN"), other)
    rules = text.ruleset(c("sport"), F.when(k % 5 != 0, c("rounds")), c("title"))
    return contests(spark, d).select(
        "contest_id", corners["red"].alias("red"), corners["blue"].alias("blue"), decision.alias("decision"), text.rating_outcome(pair).alias("pair_outcome"), text.finish_method(F.when(k % 7 == 0, "spin").otherwise(F.lower("method"))).alias("finish"), text.ends_early(c("method")).alias("early"), rules["ruleset"].alias("ruleset"))


# ---- dimensions ----


@query(
    f", tr as (select * from (values {', '.join(f'({chr(39)}{s}{chr(39)}, {w})' for s, w in TRANSLATION.items() if s in text.SPORTS)}) t(sport, translation)), sp as (select distinct sport from contests union select case when c_custkey % {len(_SPORTS)} = {len(_SPORTS) - 1} then 'unknown' else {_case(_SPORTS, 'c_custkey')} end from customer where c_mktsegment = 'BUILDING' union select 'mma') "
    "select sport, sport = 'mma' is_mma, case when sport = 'unknown' then 0.45 else translation end::double translation from sp left join tr using (sport)")
def sport_dimension(spark, d):
    """Sports of two sources and MMA, with their translation; a translated label that is no sport becomes that of ``unknown``."""
    first = contests(spark, d).select(text.sport(F.col("sport")).alias("sport"))
    second = read(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(text.sport(_pick(_SPORTS, F.col("c_custkey"))).alias("sport"))
    names = first.union(second).union(spark.range(1).select(F.lit("mma"))).distinct()
    table = spark.createDataFrame([(k, s, w) for k, (s, w) in enumerate(TRANSLATION.items())], "place int, sport string, translation double")
    table = table.groupBy(text.sport(F.col("sport")).alias("sport")).agg(F.max_by("translation", "place").alias("translation"))
    return names.join(F.broadcast(table), "sport", "left").select("sport", (F.col("sport") == "mma").alias("is_mma"), "translation")


@query(
    "with raw as (select p_partkey k, case when p_size % 3 > 0 then lower(p_brand) end slug, p_type as name, case when p_size % 5 > 0 then (p_size / 100.0)::decimal(6, 4) end strength from part), "
    "kd as (select *, case when slug is not null then 'slug:' || slug else 'name:' || lower(name) end key from raw) "
    "select key, arg_min(name, k) as name, max(slug) slug, max(strength)::double strength from kd where strength is not null group by 1", views=False)
def promotion_dimension(spark, d):
    """Promotions by slug or name; first known fields, the greatest strength; those without strength are left out."""
    rows = read(spark, d, "part").select(F.col("p_partkey").alias("k"), F.when(F.col("p_size") % 3 > 0, F.lower("p_brand")).alias("slug"), F.col("p_type").alias("name"), F.when(F.col("p_size") % 5 > 0, (F.col("p_size") / 100.0).cast("decimal(6,4)")).alias("strength"))
    keyed = rows.where("strength is not null").withColumn("key", text.promotion_key(F.col("slug"), F.col("name")))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("k"))).alias(c)
    return keyed.groupBy("key").agg(first("name"), first("slug"), F.max("strength").cast("double").alias("strength"))


@query("select s_suppkey k, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3) || '-' || substr(h, 21, 12) id from (select s_suppkey, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || ('promotion:' || lower(s_name))::blob) h from supplier)", views=False)
def stable_ids(spark, d):
    return read(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), text.stable_uuid(F.concat(F.lit("promotion:"), F.lower("s_name"))).alias("id"))


_LABELS = ["Light Heavyweight 205 lbs", "Super Lightweight (64 kg)", "Women's Flyweight", "Open Weight", "Catchweight 160 lbs", "Heavyweight", "170", "81.5", "Super heavyweight", " ", "Some kg", "pound for pound", "Catch", "155 lb", "Middleweight 84 kg", "Women 52 kg"]
_BY_SPORT = ["mma", "boxing", "kickboxing", "grappling"]


def _weights_sql() -> str:
    phrase = "case " + " ".join(f"when contains(low, '{p}') then '{c}'" for p, c, _ in weights.PHRASES) + " end"
    name = "case " + " ".join(f"when contains(low, '{p}') then '{n}'" for p, _, n in weights.PHRASES) + " end"
    limit = "case {} " + " ".join(f"when '{c}' then {v}" for c, v in weights.LIMITS) + " end"
    near = "(select arg_min(c, abs(v - lbs) * 1000 + i) from (values " + ", ".join(f"({i}, '{c}', {v})" for i, (c, v) in enumerate(weights.LIMITS)) + ") t(i, c, v))"
    edge = lambda j: "case mc " + " ".join(f"when '{c}' then {b[j]}" for c, b in weights.BOUNDS.items()) + " end"
    return (
        f"with r as (select c_custkey k, {_case(_LABELS, 'c_custkey')} raw, {_case(_BY_SPORT, 'c_custkey // 16')} sport, case when c_nationkey < 5 then (100 + c_nationkey * 20)::varchar end given, case when c_nationkey % 3 = 0 then 'F' when c_nationkey % 3 = 1 then 'M' end g from customer), "
        "l as (select *, coalesce(nullif(trim(raw), ''), 'Unknown') label, lower(coalesce(nullif(trim(raw), ''), 'Unknown')) low from r), "
        f"n as (select *, nullif(regexp_extract(low, '(\\d+(?:\\.\\d+)?)', 1), '')::decimal(10, 2) num, {phrase} code, {name} pname from l), "
        "u as (select *, case when contains(low, 'kg') then case when num is not null then 'kg' end when contains(low, 'lb') or contains(low, 'pound') then case when num is not null then 'lb' end when num is not null then case when sport = 'kickboxing' and num <= 120 and num not in (105, 115) then 'kg' else 'lb' end when given is not null then 'lb' end unit, "
        "case when num is not null then num when contains(low, 'kg') or contains(low, 'lb') or contains(low, 'pound') then null else given::decimal(10, 2) end as value from n), "
        "w as (select *, case unit when 'kg' then round_even(value * 2.20462, 2)::decimal(10, 2) else value end lbs, case when contains(low, 'kg') or contains(low, 'lb') or contains(low, 'pound') then case when num is not null then 0.98 else 0.3 end "
        "when num is not null then case when sport = 'kickboxing' then case when unit = 'kg' then 0.7 else 0.45 end when sport = 'boxing' then 0.7 else 0.4 end when given is not null then 0.96 else 0.5 end conf from u), "
        f"m as (select *, case when code in ({', '.join(repr(c) for c in weights.BOUNDS)}) then code when lbs is not null then {near} end mc, contains(low, 'open') op, contains(low, 'catch') ca from w) "
        "select k, case when contains(low, 'women') then 'F' else coalesce(g, 'U') end sex, case when sport = 'mma' then case when op then 'MMA_OPEN' when mc is null then 'MMA_UNKNOWN' else 'MMA_' || mc end when op then upper(sport) || '_OPEN' when ca then upper(sport) || '_CATCHWEIGHT' "
        "when code is not null then upper(sport) || '_' || replace(upper(pname), ' ', '_') else upper(sport) || '_UNKNOWN' end division, "
        f"case when op then 'Open Weight' when sport = 'mma' then case when mc is null then coalesce(pname, label) else case mc {' '.join(f'when {chr(39)}{c}{chr(39)} then {chr(39)}{v}{chr(39)}' for c, v in weights.NAMES.items())} end end when ca then 'Catchweight' when code is not null then pname else label end as name, "
        f"case when op then null when sport = 'mma' then {limit.format('mc')} when ca or code is null then lbs end::double limit_lbs, case when op then null when sport = 'mma' then {edge(0)} when ca or code is null then lbs end::double lbs_min, case when op then null when sport = 'mma' then {edge(1)} when ca or code is null then lbs end::double lbs_max, "
        "unit, value::double as value, lbs::double lbs, case when op then false when sport = 'mma' then ca else ca end is_catchweight, "
        "(case when sport = 'mma' then case when op then 0.98 when mc is null then least(conf, 0.6) when code is not null then greatest(conf, 0.97) else greatest(conf, 0.75) end when op then greatest(conf, 0.9) when ca or code is not null then greatest(conf, 0.85) else least(conf, 0.65) end)::double confidence from m")


def raw_weight_labels(spark, d):
    k = F.col("c_custkey")
    nation = F.col("c_nationkey")
    return read(spark, d, "customer").select(k.alias("k"), _pick(_LABELS, k).alias("raw"), _pick(_BY_SPORT, F.floor(k / 16)).alias("sport"), F.when(nation < 5, (100 + nation * 20).cast("string")).alias("given"), F.when(nation % 3 == 0, "F").when(nation % 3 == 1, "M").alias("g"))


def weight_classes(spark, d):
    c = F.col
    return weights.weight_class(raw_weight_labels(spark, d), c("raw"), c("g"), c("given"), c("sport")).select("k", "w.*")


@query(_weights_sql(), views=False)
def weight_class_divisions(spark, d):
    """The division of every raw weight label, by sport."""
    found = weight_classes(spark, d)
    double = lambda n: F.col(n).cast("double").alias(n)
    return found.select("k", "sex", "division", "name", double("limit_lbs"), double("lbs_min"), double("lbs_max"), "unit", double("value"), double("lbs"), "is_catchweight", double("confidence"))


@query(f"select division, sex, arg_min(name, k) as name, arg_min(limit_lbs, k) limit_lbs, count(*) labels from ({_weights_sql()}) group by 1, 2", views=False)
def division_dimension(spark, d):
    """Divisions by key and sex: the first label's fields, later ones fill what is missing."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("k"))).alias(c)
    return weight_classes(spark, d).groupBy("division", "sex").agg(first("name"), first("limit_lbs"), F.count("*").alias("labels")).withColumn("limit_lbs", F.col("limit_lbs").cast("double"))


@query(f"select unit, value, arg_min(lbs, k) lbs from ({_weights_sql()}) where unit is not null and value is not null and lbs is not null group by 1, 2", views=False)
def weight_limit_dimension(spark, d):
    """Distinct limits by unit and value; the first weight in pounds stays."""
    rows = weight_classes(spark, d).where("unit is not null and value is not null and lbs is not null")
    return rows.groupBy("unit", "value").agg(F.min_by("lbs", "k").cast("double").alias("lbs")).withColumn("value", F.col("value").cast("double"))


_BRIDGE = (f"b as (select sport, label, x.division, x.sex, x.unit, x.v as value, x.confidence from (select sport, label, arg_max({{'division': division, 'sex': sex, 'unit': unit, 'v': value, 'confidence': confidence}}, (confidence, k)) x from (select x.*, {_case(_BY_SPORT, 'x.k // 16')} sport, coalesce(nullif(trim({_case(_LABELS, 'x.k')}), ''), 'Unknown') as label from ({_weights_sql()}) x) group by 1, 2))")


@query(f"with {_BRIDGE}, dv as (select distinct division, sex from ({_weights_sql()})) select b.sport, b.label, b.division, coalesce((select division || '/' || sex from dv where dv.division = b.division and dv.sex = b.sex), b.division || '/U') division_key, b.confidence, unit || ' ' || value::decimal(10, 2)::varchar weight_limit from b", views=False)
def weight_class_bridge(spark, d):
    """Each raw label of a sport with its most certain parse (the last of equals), joined to the division of its sex or of none, and to its limit."""
    parsed = weight_classes(spark, d)
    best = parsed.groupBy("sport", "label").agg(F.max_by(F.struct("division", "sex", "unit", "value", "confidence"), F.struct("confidence", "k")).alias("x")).select("sport", "label", "x.*")
    table = parsed.select("division", "sex").union(parsed.select("division", F.lit("U"))).distinct().withColumn("division_key", F.concat_ws("/", "division", "sex"))
    found = joins.lookup_with_fallback(best, table, ["division", "sex"], "division_key", {"sex": "U"})
    limits = parsed.where("unit is not null").select("unit", "value").distinct().withColumn("weight_limit", F.concat_ws(" ", "unit", F.col("value").cast("string")))
    return found.join(limits, ["unit", "value"], "left").select("sport", "label", "division", "division_key", F.col("confidence").cast("double").alias("confidence"), "weight_limit")


@query("select distinct 'unified_mma_' || case when title and rounds = 5 then 'title_5x5' else rounds || 'x5' end ruleset, rounds::int rounds from contests where sport = 'mma' union select distinct sport || '_' || rounds || 'x5', rounds::int from contests where sport <> 'mma'")
def ruleset_dimension(spark, d):
    found = contests(spark, d).select(text.ruleset(F.col("sport"), F.col("rounds"), F.col("title")).alias("r")).select("r.ruleset", "r.rounds")
    return found.distinct()


@query(
    "with o as (select o outcome, m as method, d decision, o || '/' || m || '/' || d result from (select unnest(['W', 'L', 'D', 'NC', 'UNKNOWN']) o), (select unnest(['KO', 'TKO', 'SUB', 'DEC', 'DQ', 'OVERTURNED', 'OTHER', 'UNKNOWN']) m), (select unnest(['UD', 'SD', 'MD', 'TD', 'DRAW', 'NA', 'UNKNOWN']) d) where m = 'DEC' or d in ('NA', 'UNKNOWN')), "
    "x as (select o_orderkey k, ['W', 'L', 'D', 'NC', 'lost'][o_orderkey % 5 + 1] outcome, ['KO', 'DEC', 'SPIN'][o_orderkey % 3 + 1] as method, ['UD', 'UNKNOWN', 'XX'][o_custkey % 3 + 1] dec from orders), "
    "y as (select k, outcome, method, case when outcome = 'D' then 'DRAW' when method <> 'DEC' or dec = 'UNKNOWN' then 'NA' else dec end decision from x) select k, coalesce(result, 'UNKNOWN/UNKNOWN/UNKNOWN') result from y left join o using (outcome, method, decision)", views=False)
def result_lookup(spark, d):
    """The ontology's row of every outcome, method and decision; UNKNOWN where there is none."""
    axis = lambda values, name: F.explode(F.array(*[F.lit(v) for v in values])).alias(name)
    table = spark.range(1).select(axis(["W", "L", "D", "NC", "UNKNOWN"], "outcome")).select("*", axis(["KO", "TKO", "SUB", "DEC", "DQ", "OVERTURNED", "OTHER", "UNKNOWN"], "method")).select("*", axis(["UD", "SD", "MD", "TD", "DRAW", "NA", "UNKNOWN"], "decision"))
    table = table.where("method = 'DEC' or decision in ('NA', 'UNKNOWN')").withColumn("result", F.concat_ws("/", "outcome", "method", "decision"))
    k = F.col("o_orderkey")
    rows = read(spark, d, "orders").select(k.alias("k"), _pick(["W", "L", "D", "NC", "lost"], k).alias("outcome"), _pick(["KO", "DEC", "SPIN"], k).alias("method"), _pick(["UD", "UNKNOWN", "XX"], F.col("o_custkey")).alias("d"))
    rows = rows.withColumn("decision", text.decision_for(F.col("outcome"), F.col("method"), F.col("d")))
    unknown = {"outcome": "UNKNOWN", "method": "UNKNOWN", "decision": "UNKNOWN"}
    return joins.lookup_with_fallback(rows, F.broadcast(table), ["outcome", "method", "decision"], "result", unknown).select("k", "result")


# ---- identities, participants, order ----


@query(
    "with p as (select s_suppkey k, s_name as name, case when s_nationkey % 2 = 0 then s_acctbal end height, s_nationkey sex_src from supplier where s_suppkey in (select l_suppkey from lineitem)), "
    "mp as (select c_custkey other, c_custkey % (select count(*) from supplier) k from customer where c_mktsegment = 'BUILDING'), lk as (select k, max(other) other from mp group by 1), s as (select c_custkey other, c_name as name, c_acctbal height from customer) "
    "select p.k, coalesce(nullif(p.name, ''), s.name) as name, round(coalesce(nullif(p.height, 0), s.height), 2) height, lk.other, s.other is not null both_sources from p left join lk using (k) left join s on s.other = lk.other", views=False)
def identity_crosswalk(spark, d):
    """Primary identities that took part, each with the last secondary one that the map ties to it; fields come from the primary, then the secondary. Secondary-only ones are dropped."""
    n = read(spark, d, "supplier").agg(F.count("*").alias("n"))
    primary = read(spark, d, "supplier").join(read(spark, d, "lineitem").select("l_suppkey"), F.col("s_suppkey") == F.col("l_suppkey"), "left_semi").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("p_name"), F.when(F.col("s_nationkey") % 2 == 0, F.col("s_acctbal")).alias("p_height"))
    linked = read(spark, d, "customer").where("c_mktsegment = 'BUILDING'").join(F.broadcast(n)).select(F.col("c_custkey").alias("other"), (F.col("c_custkey") % F.col("n")).alias("k")).groupBy("k").agg(F.max("other").alias("other"))
    secondary = read(spark, d, "customer").select(F.col("c_custkey").alias("s_other"), F.col("c_name").alias("s_name2"), F.col("c_acctbal").alias("s_height"))
    met = primary.join(linked, "k", "left").join(secondary, F.col("other") == F.col("s_other"), "left")
    return met.select("k", F.coalesce(F.nullif("p_name", F.lit("")), "s_name2").alias("name"), F.round(F.coalesce(F.nullif("p_height", F.lit(0.0)), "s_height"), 2).alias("height"), "other", F.col("s_other").isNotNull().alias("both_sources"))


@query(
    ", p as (select contest_id, contestant, opponent, result outcome, 'P' || contest_id record from sides where tier <> 'C'), s as (select contest_id, a contestant, b opponent, case when title then 'UNKNOWN' else outcome end outcome, case when rounds = 5 then 'S' || contest_id end record from contests where tier <> 'A'), "
    "b as (select contest_id, contestant, coalesce(s.opponent, p.opponent) opponent, coalesce(case when s.outcome <> 'UNKNOWN' then s.outcome end, p.outcome, s.outcome) outcome, coalesce(s.record, p.record) record, false inferred from p full join s using (contest_id, contestant)) "
    "select * from b union all select contest_id, opponent, contestant, case outcome when 'W' then 'L' when 'L' then 'W' else outcome end, null, true from s where not exists (select 1 from b where b.contest_id = s.contest_id and b.contestant = s.opponent)")
def participants_merged(spark, d):
    """Participants of two sources; the second knows one side of each contest, whose opponent is inferred where nothing else names it."""
    from .contest import sides

    log = contests(spark, d)
    primary = sides(log.where("tier <> 'C'")).select("contest_id", "contestant", "opponent", F.col("result").alias("outcome"), F.concat(F.lit("P"), F.col("contest_id").cast("string")).alias("record"))
    secondary = log.where("tier <> 'A'").select("contest_id", F.col("a").alias("contestant"), F.col("b").alias("opponent"), F.when(F.col("title"), "UNKNOWN").otherwise(F.col("outcome")).alias("outcome"), F.when(F.col("rounds") == 5, F.concat(F.lit("S"), F.col("contest_id").cast("string"))).alias("record"))
    return joins.merge_participants(primary, secondary, prefer_known=True).select("contest_id", "contestant", "opponent", "outcome", "record", "inferred")


def same_day_order(log, totals: tuple[str, str] = ("total_a", "total_b")):
    """``log`` with ``seq``: contests by day and, within a day, by how far a tournament had gone for either side, by the fewest and most earlier contests, and by names.

    A side's baseline is its smallest total of the day; missing totals count for nothing, and a contest without any comes last of its stage. Names are put in order
    without regard to case. Where the log has a ``checkpoint``, the contests of a day stand by it first and each checkpoint of a day has its own baselines. A day is one
    group: its contests are few whatever the history.
    """
    at = ["day", *(["checkpoint"] if "checkpoint" in log.columns else [])]
    pair = log.select(*at, F.explode(F.array(*[F.struct(F.col(s).alias("who"), F.col(t).alias("total")) for s, t in zip("ab", totals, strict=True)])).alias("s")).select(*at, "s.*")
    base = pair.groupBy(*at, "who").agg(F.min("total").alias("base"))
    joined = log
    for s in "ab":
        joined = joined.join(base.select(*at, F.col("who").alias(s), F.col("base").alias(f"_base_{s}")), [*at, s], "left")
    rise = [F.greatest(F.lit(0), F.col(t) - F.col(f"_base_{s}")) for s, t in zip("ab", totals, strict=True)]
    never = F.lit(10**9).cast("long")
    joined = joined.withColumns({"stage": F.coalesce(F.greatest(*rise), F.lit(0)), "_few": F.coalesce(F.least(*totals), never), "_most": F.coalesce(F.greatest(*totals), never), "_label": F.when(F.lower("name_a") <= F.lower("name_b"), F.concat_ws(" vs ", "name_a", "name_b")).otherwise(F.concat_ws(" vs ", "name_b", "name_a"))})
    w = Window.partitionBy("day").orderBy(*at[1:], "stage", "_few", "_most", "_label", "contest_id")
    return joined.withColumn("place", F.row_number().over(w)).withColumn("seq", F.col("place")).drop("_base_a", "_base_b", "_few", "_most", "_label")


@query(
    ", t as (select *, case when contest_id % 3 > 0 then (qa::bigint % 7) end ta, case when contest_id % 4 > 0 then (qb::bigint % 7) end tb from contests), sd as (select day, a who, ta total from t union all select day, b, tb from t), bl as (select day, who, min(total) base from sd group by 1, 2), "
    "j as (select t.*, greatest(greatest(0, ta - x.base), greatest(0, tb - y.base)) s0, x.base xb, y.base yb from t left join bl x on x.day = t.day and x.who = a left join bl y on y.day = t.day and y.who = b), "
    "fo as (select day, contest_id, coalesce(greatest(case when ta is not null then greatest(0, ta - xb) end, case when tb is not null then greatest(0, tb - yb) end), 0) stage, coalesce(least(ta, tb), 1000000000) few, coalesce(greatest(ta, tb), 1000000000) most, least('N' || a, 'N' || b) || ' vs ' || greatest('N' || a, 'N' || b) as label from j) "
    "select contest_id, stage::bigint stage, (row_number() over (partition by day order by stage, few, most, label, contest_id))::int place from fo")
def same_day_places(spark, d):
    """The order of contests within a day."""
    log = contests(spark, d)
    k = F.col("contest_id")
    log = log.withColumns({"total_a": F.when(k % 3 > 0, F.col("qa").cast("long") % 7), "total_b": F.when(k % 4 > 0, F.col("qb").cast("long") % 7), "name_a": F.concat(F.lit("N"), F.col("a").cast("string")), "name_b": F.concat(F.lit("N"), F.col("b").cast("string"))})
    return same_day_order(log).select("contest_id", F.col("stage").cast("long").alias("stage"), "place")
