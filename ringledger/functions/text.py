"""Text, date, label and JSON parsing as Column expressions. Missing or malformed input gives null, unless a default is named."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of the sources' labels.
NO_RECORD = ("n/a", "na", "none", "--")
TRUE_WORDS, FALSE_WORDS = ("true", "t", "1", "yes", "y"), ("false", "f", "0", "no", "n")
SPORTS = ("mma", "grappling", "kickboxing", "boxing", "muay", "knuckle", "custom", "karate", "wrestling", "shootboxing", "knuckle_mma", "sanda", "judo", "boxing_cage", "slap", "combat_jj", "sambo", "lethwei", "valetudo", "ice_fighting", "pancrase", "unknown")
METHODS = ("KO", "TKO", "SUB", "DEC", "DQ", "OVERTURNED")


def clean(c: Column) -> Column:
    """Without white space at the ends; empty is null."""
    return F.nullif(F.regexp_replace(c, r"^\s+|\s+$", ""), F.lit(""))


def to_decimal(c: Column, precision: int = 18, scale: int = 6) -> Column:
    return clean(c).try_cast(f"decimal({precision},{scale})")


def to_int(c: Column) -> Column:
    return clean(c).try_cast("double").try_cast("int")


def minutes_seconds(c: Column) -> Column:
    """``m:ss`` as seconds."""
    m = F.regexp_extract(clean(c), r"^(\d+):(\d+)$", 1)
    return F.when(m != "", m.try_cast("int") * 60 + F.regexp_extract(clean(c), r"^(\d+):(\d+)$", 2).try_cast("int"))


def time_in_details(c: Column) -> Column:
    """The first ``m:ss`` in free text as seconds."""
    return minutes_seconds(F.nullif(F.regexp_extract(c, r"\d+:\d{2}", 0), F.lit("")))


def round_number(c: Column) -> Column:
    """A round label; ``Totals`` is round 0."""
    return F.when(F.lower(clean(c)) == "totals", 0).otherwise(to_int(c))


def round_in_details(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(?i)R(\d+)", 1), F.lit("")).try_cast("int")


def record_total(c: Column) -> Column:
    """Contests in a record ``W-L[-D] (notes)``; null with fewer than two numbers."""
    core = F.trim(F.split_part(F.lower(clean(c)), F.lit("("), F.lit(1)))
    numbers = F.transform(F.regexp_extract_all(core, F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("long"))
    return F.when(~F.lower(clean(c)).isin(*NO_RECORD) & (F.size(numbers) >= 2), F.aggregate(numbers, F.lit(0).cast("long"), lambda s, x: s + x))


def last_path_part(c: Column) -> Column:
    """Last segment of a url's path."""
    path = F.regexp_replace(F.regexp_extract(clean(c), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)", 1), r"/+$", "")
    return F.nullif(F.element_at(F.split(path, "/"), -1), F.lit(""))


def profile_id_in_url(c: Column) -> Column:
    """What follows ``/fighters/`` in a url."""
    return clean(F.nullif(F.regexp_extract(clean(c), r"/fighters/([^/?#]+)", 1), F.lit("")))


def uuid(c: Column) -> Column:
    """A UUID in canonical form; braces, a ``urn:uuid:`` prefix and hyphens may be there or not."""
    bare = F.lower(F.regexp_replace(F.regexp_replace(clean(c), "^(?:urn:)?(?:uuid:)?", ""), "[{}-]", ""))
    return F.when(bare.rlike("^[0-9a-f]{32}$"), F.regexp_replace(bare, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))


def stable_uuid(name: Column) -> Column:
    """UUID of version 5 in the url namespace: the same name has the same id in every run."""
    h = F.sha1(F.concat(F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8")), name.cast("binary")))
    part = lambda start, n: F.substring(h, start, n)
    variant = F.translate(part(17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def promotion_key(slug: Column, name: Column) -> Column:
    """``slug:...`` where there is a slug, else ``name:...`` in lower case."""
    return F.coalesce(F.concat(F.lit("slug:"), slug), F.concat(F.lit("name:"), F.lower(clean(name))))


def hex_id(c: Column) -> Column:
    return F.when(clean(c).rlike("^[0-9a-fA-F]{16}$"), F.lower(clean(c)))


def hex_id_in_url(c: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(c, r"/([0-9a-fA-F]{16})/?(?:[?#].*)?$", 1)), F.lit(""))


def resolve_hex_id(raw: Column, url: Column) -> Column:
    return F.coalesce(hex_id_in_url(url), hex_id(raw))


def name_of_slug(c: Column) -> Column:
    return F.initcap(F.replace(F.regexp_replace(c, r"^\d+-", ""), F.lit("-"), F.lit(" ")))


def key_token(c: Column) -> Column:
    """Upper case, runs of other characters as ``_``; UNKNOWN where nothing is left."""
    token = F.regexp_replace(F.regexp_replace(F.upper(F.trim(c)), "[^A-Z0-9]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(token, F.lit("")), F.lit("UNKNOWN"))


def first_number(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(\d+(?:\.\d+)?)", 1), F.lit("")).try_cast("decimal(18,6)")


def flexible_date(c: Column) -> Column:
    """``2020-01-05`` or ``2020-Jan 05``."""
    one = F.regexp_replace(clean(c), r"\s+", " ")
    return F.coalesce(F.try_to_date(one, "yyyy-MM-dd"), F.try_to_date(one, "yyyy-MMM dd"), F.try_to_date(one, "yyyy-MMM d"))


def timestamp(c: Column) -> Column:
    """An ISO timestamp; ``Z`` and offsets are applied, times without a zone are taken in the session's (UTC)."""
    return F.when(clean(c).rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(F.replace(clean(c), F.lit("Z"), F.lit("+00:00"))))


def processing_date(meta: Column, fallback: Column) -> Column:
    """The source's own event date in the record's JSON, where it can be read, else the event's."""
    return F.coalesce(flexible_date(F.get_json_object(meta, "$.tapology_event_date")), fallback)


def fight_minutes(finish_round: Column, finish_seconds: Column, scheduled: Column) -> Column:
    """Minutes by round and time of the finish, by its round, or by the schedule."""
    whole = F.greatest(finish_round - 1, F.lit(0)) * 5.0 + finish_seconds / 60.0
    return F.coalesce(whole, finish_round * 5.0, scheduled * 5.0)


def int_or(c: Column, default: int) -> Column:
    return F.coalesce(F.when(clean(c).rlike(r"^[+-]?\d+$"), clean(c).try_cast("int")), F.lit(default))


def double_or(c: Column, default: float) -> Column:
    return F.coalesce(clean(c).try_cast("double"), F.lit(float(default)))


def gender(c: Column) -> Column:
    up = F.upper(clean(c))
    return F.when(up.isin("M", "F"), up).otherwise("U")


def member(c: Column, members: tuple[str, ...], default: str | None = None, unknown: str | None = None) -> Column:
    """``c`` if it is one of ``members``. Other texts give ``default``, or ``unknown`` where there is none; missing ones give ``default``."""
    known = clean(c)
    return F.when(known.isin(*members), known).when(known.isNotNull() & F.lit(default is None), F.lit(unknown)).otherwise(F.lit(default))


def sport(c: Column) -> Column:
    return member(c, SPORTS, "unknown")


def boolean(c: Column) -> Column:
    low = F.lower(clean(c))
    return F.when(low.isin(*TRUE_WORDS), True).when(low.isin(*FALSE_WORDS), False)


def result(c: Column) -> Column:
    up = F.upper(F.trim(c))
    return F.when(up.isin("W", "L"), up).when(up.isin("D", "DRAW"), "D").when(up.isin("NC", "NO CONTEST", "NO-CONTEST"), "NC").otherwise("UNKNOWN")


def inverse_result(c: Column) -> Column:
    return F.when(c == "W", "L").when(c == "L", "W").when(c.isin("D", "NC"), c).otherwise("UNKNOWN")


def corner_results(winner: Column, red: Column, blue: Column, method: Column) -> Column:
    """(red, blue): overturned contests have no result, those without a known winner are draws."""
    pair = lambda a, b: F.struct(F.lit(a).alias("red"), F.lit(b).alias("blue"))
    return F.when(method == "OVERTURNED", pair("NC", "NC")).when(winner == red, pair("W", "L")).when(winner == blue, pair("L", "W")).otherwise(pair("D", "D"))


def decision_for(outcome: Column, method: Column, decision: Column) -> Column:
    return F.when(outcome == "D", "DRAW").when((method != "DEC") | (decision == "UNKNOWN"), "NA").otherwise(decision)


def rating_outcome(c: Column) -> Column:
    """What rating knows of a result: anything else is a draw."""
    return F.when(c.isin("W", "L", "D", "NC"), c).otherwise("D")


def pair_outcome(a: Column, b: Column) -> Column:
    """The outcome of a; from b's where a's is not known."""
    return F.coalesce(F.when(a.isin("W", "L", "D", "NC"), a), F.when(b == "W", "L").when(b == "L", "W").otherwise(b))


def finish_method(group: Column) -> Column:
    up = F.upper(group)
    return F.when(up.isin(*METHODS), up).otherwise("UNKNOWN")


def ends_early(group: Column) -> Column:
    """Whether a method group is a finish in the ontology, where disqualifications count."""
    return group.isin("KO", "TKO", "SUB", "DQ")


def ruleset(sport: Column, rounds: Column, title: Column) -> Column:
    """(ruleset, rounds) by sport, scheduled rounds and title."""
    n = F.coalesce(rounds, F.when(sport == "mma", F.when(title, 5).otherwise(3)))
    mma = F.when((n == 5) & title, F.lit("unified_mma_title_5x5")).otherwise(F.concat(F.lit("unified_mma_"), n.cast("string"), F.lit("x5")))
    other = F.concat(sport, F.coalesce(F.concat(F.lit("_"), n.cast("string"), F.lit("x5")), F.lit("_unknown")))
    return F.struct(F.when(sport == "mma", mma).otherwise(other).alias("ruleset"), F.coalesce(n, F.lit(0)).cast("int").alias("rounds"))


def method_group(method: Column, details: Column) -> Column:
    """(method, decision) of the first source's labels; the first rule that fits counts."""
    m, d = F.upper(F.trim(F.coalesce(method, F.lit("")))), F.lower(F.trim(F.coalesce(details, F.lit(""))))
    pair = lambda a, b: F.struct(F.lit(a).alias("method"), F.lit(b).alias("decision"))
    decided = (m == "DEC") | d.contains("decision")
    return (
        F.when(d.contains("overturned"), pair("OVERTURNED", "NA")).when(m.contains("SUB"), pair("SUB", "NA")).when(m == "DQ", pair("DQ", "NA"))
        .when((m == "KO") | d.contains("knockout"), pair("KO", "NA"))
        .when((m == "TKO") | d.contains("doctor") | d.contains("corner stoppage") | d.contains("injury"), pair("TKO", "NA"))
        .when(decided & d.contains("unanimous"), pair("DEC", "UD")).when(decided & d.contains("split"), pair("DEC", "SD")).when(decided & d.contains("majority"), pair("DEC", "MD"))
        .when(decided & d.contains("technical decision"), pair("DEC", "TD")).when(decided & d.contains("draw"), pair("DEC", "DRAW")).when(decided, pair("DEC", "NA"))
        .when(m != "", pair("OTHER", "NA")).otherwise(pair("UNKNOWN", "UNKNOWN"))
    )


def method_group_second(method: Column, details: Column) -> Column:
    """The same of the second source's labels, where the details stand in for a missing method."""
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    t = F.when(low(method) != "", low(method)).otherwise(low(details))
    pair = lambda a, b: F.struct(F.lit(a).alias("method"), F.lit(b).alias("decision"))
    return (
        F.when(t == "", pair("UNKNOWN", "UNKNOWN")).when(t.contains("overturned"), pair("OVERTURNED", "NA")).when(t.contains("dq"), pair("DQ", "NA"))
        .when(t.contains("submission") | (t == "sub"), pair("SUB", "NA")).when(t.contains("ko/tko") | t.contains("doctor"), pair("TKO", "NA"))
        .when(t.isin("decision - unanimous", "u-dec"), pair("DEC", "UD")).when(t.isin("decision - split", "s-dec"), pair("DEC", "SD")).when(t.isin("decision - majority", "m-dec"), pair("DEC", "MD"))
        .when(t.isin("decision", "decision - technical", "t-dec"), pair("DEC", "NA")).when(t.contains("decision") & t.contains("draw"), pair("DEC", "DRAW"))
        .when(t.contains("could not continue"), pair("OTHER", "NA")).when(t.contains("ko"), pair("KO", "NA")).otherwise(pair("OTHER", "NA"))
    )


def inches_to_cm(c: Column) -> Column:
    return F.bround(c * F.lit("2.54").cast("decimal(4,2)"), 2)


def json_number(doc: Column, key: str, kind: str = "double") -> Column:
    """The number under a key of the document itself; strings, booleans and objects there do not count, nor do keys further inside."""
    found = F.try_variant_get(F.try_parse_json(doc), f"$.{key}", "variant")
    return F.when(~F.schema_of_variant(found).isin("STRING", "BOOLEAN", "VOID") & ~F.schema_of_variant(found).rlike("^(ARRAY|OBJECT)"), F.try_variant_get(found, "$", kind))


def profile_facts(extra: Column, rating: Column) -> dict[str, Column]:
    """What the profile table takes of a snapshot's JSON: skills, the peak (at least the rating) and the streak as JSON."""
    facts = {name: json_number(extra, key, "decimal(10,4)") for name, key in (("strike", "striking"), ("grapple", "grappling"), ("durability", "durability"))}
    streak = json_number(extra, "streak")
    known = F.to_json(F.struct(streak.cast("int").alias("win_streak"), F.coalesce(json_number(extra, "mma_fights"), F.lit(0)).cast("int").alias("mma_fights")))
    return facts | {"peak": F.greatest(rating.cast("decimal(10,4)"), json_number(extra, "peak", "decimal(10,4)")), "streaks": F.when(streak.isNotNull(), known).otherwise("{}")}
