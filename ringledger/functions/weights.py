"""Weight-class labels as Column expressions: phrases, limits with units, and the division that both give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text

# Phrases of the labels in order of precedence (phrase, code, name), limits and bounds of the divisions in pounds.
PHRASES = [
    ("super heavyweight", "SHW", "Super Heavyweight"), ("light heavyweight", "LHW", "Light Heavyweight"), ("middleweight", "MW", "Middleweight"), ("welterweight", "WW", "Welterweight"),
    ("super lightweight", "LW", "Super Lightweight"), ("lightweight", "LW", "Lightweight"), ("featherweight", "FW", "Featherweight"), ("bantamweight", "BW", "Bantamweight"), ("flyweight", "FLY", "Flyweight"),
    ("strawweight", "STRAW", "Strawweight"), ("atomweight", "ATOM", "Atomweight"), ("open weight", "OPEN", "Open Weight"), ("openweight", "OPEN", "Open Weight"), ("open", "OPEN", "Open Weight"),
]
LIMITS = [("ATOM", 105), ("STRAW", 115), ("FLY", 125), ("BW", 135), ("FW", 145), ("LW", 155), ("WW", 170), ("MW", 185), ("LHW", 205), ("HW", 265)]
BOUNDS = {"ATOM": (0, 105), "STRAW": (106, 115), "FLY": (116, 125), "BW": (126, 135), "FW": (136, 145), "LW": (146, 155), "WW": (156, 170), "MW": (171, 185), "LHW": (186, 205), "HW": (206, 265), "SHW": (266, 2000)}
NAMES = {"ATOM": "Atomweight", "STRAW": "Strawweight", "FLY": "Flyweight", "BW": "Bantamweight", "FW": "Featherweight", "LW": "Lightweight", "WW": "Welterweight", "MW": "Middleweight", "LHW": "Light Heavyweight", "HW": "Heavyweight", "SHW": "Super Heavyweight"}
IN_KG, IN_LB = ("kickboxing", "shootboxing", "lethwei"), ("boxing", "boxing_cage")
KG_IN_LB = "2.20462"

_two = lambda c: F.bround(c, 2).cast("decimal(10,2)")
_sure = lambda x: F.lit(x).cast("decimal(4,3)")


def _by_phrase(label: Column, place: int) -> Column:
    low, found = F.lower(F.coalesce(label, F.lit(""))), F.lit(None).cast("string")
    for phrase in reversed(PHRASES):
        found = F.when(low.contains(phrase[0]), F.lit(phrase[place])).otherwise(found)
    return found


def division_phrase(label: Column) -> Column:
    """Code of the first phrase that the label holds."""
    return _by_phrase(label, 1)


def phrase_name(label: Column) -> Column:
    return _by_phrase(label, 2)


def nearest_division(lbs: Column) -> Column:
    """The limit nearest to a weight; the lighter of equals."""
    gaps = F.array(*[F.struct(F.abs(F.lit(limit) - lbs).alias("gap"), F.lit(k).alias("k"), F.lit(code).alias("code")) for k, (code, limit) in enumerate(LIMITS)])
    return F.when(lbs.isNotNull(), F.array_min(gaps)["code"])


def in_pounds(kg: Column) -> Column:
    return _two(kg * F.lit(KG_IN_LB).cast("decimal(7,5)"))


def weight_limit(label: Column, lbs: Column, sport: Column | None = None) -> Column:
    """(unit, value, lbs, confidence, note) of a weight label: by its unit, by the sport's habit for a bare number, else by the pounds column."""
    low, number, given = F.lower(F.coalesce(label, F.lit(""))), _two(text.first_number(label)), _two(text.to_decimal(lbs))
    sport = F.lit("mma") if sport is None else sport
    none = F.lit(None)
    row = lambda unit, value, pounds, sure, note: F.struct(F.lit(unit).cast("string").alias("unit"), value.cast("decimal(10,2)").alias("value"), pounds.cast("decimal(10,2)").alias("lbs"), _sure(sure).alias("confidence"), F.lit(note).cast("string").alias("note"))
    kg, lb = low.contains("kg"), low.contains("lb") | low.contains("pound")
    small = (number <= 120) & ~number.isin(*[v for _, v in LIMITS])
    bare = (
        F.when(sport.isin(*IN_KG) & small, row("kg", number, in_pounds(number), 0.7, "heuristic_non_mma_numeric_kg")).when(sport.isin(*IN_KG), row("lb", number, number, 0.45, "heuristic_non_mma_numeric_lb"))
        .when(sport.isin(*IN_LB), row("lb", number, number, 0.7, "boxing_default_lb")).otherwise(row("lb", number, number, 0.4, "generic_numeric_lb_low_confidence"))
    )
    return (
        F.when(kg & number.isNotNull(), row("kg", number, in_pounds(number), 0.98, None)).when(kg, row(None, none, none, 0.3, "kg_token_without_numeric_value"))
        .when(lb & number.isNotNull(), row("lb", number, number, 0.98, None)).when(lb, row(None, none, none, 0.3, "lb_token_without_numeric_value"))
        .when(number.isNotNull(), bare).when(given.isNotNull(), row("lb", given, given, 0.96, "tapology_weight_lbs_column")).otherwise(row(None, none, none, 0.5, None))
    )


def weight_class(rows: DataFrame, label: Column, gender: Column, lbs: Column, sport: Column, heavyweight: bool = False) -> DataFrame:
    """``rows`` with the division of a label as a struct ``w``: sport, label, sex, division, name, limit_lbs, lbs_min, lbs_max, is_open, is_canonical, unit, value, lbs, is_catchweight, confidence, notes.

    Plain ``Heavyweight`` is no phrase of the list, so that it needs a number; with ``heavyweight`` it is one. What is used more than once is a column of its own
    on the way.
    """
    kept = rows.columns
    c = F.col
    rows = rows.withColumns({"_sport": F.coalesce(text.clean(sport), F.lit("unknown")), "_label": F.coalesce(text.clean(label), F.lit("Unknown")), "_given": lbs, "_gender": text.gender(gender)})
    rows = rows.withColumns({"_low": F.lower("_label"), "_limit": weight_limit(c("_label"), c("_given"), c("_sport")), "_code": division_phrase(c("_label")), "_name": phrase_name(c("_label")), "_token": text.key_token(c("_sport"))})
    if heavyweight:
        plain = c("_code").isNull() & c("_low").contains("heavyweight")
        rows = rows.withColumns({"_code": F.when(plain, "HW").otherwise(c("_code")), "_name": F.when(plain, "Heavyweight").otherwise(c("_name"))})
    named = F.coalesce(c("_code").isin(*BOUNDS), F.lit(False))
    mma, is_open, catch, phrase = c("_sport") == "mma", c("_low").contains("open"), c("_low").contains("catch"), c("_code").isNotNull()
    rows = rows.withColumns({"_mma": F.when(mma, F.when(named, c("_code")).otherwise(nearest_division(c("_limit.lbs")))), "_kind": F.when(is_open, "open").when(mma, "mma").when(catch, "catch").when(phrase, "phrase").otherwise("none")})
    by_code = lambda pairs: F.create_map(*[F.lit(x) for k, v in pairs for x in (k, v)])[c("_mma")]
    numeric = F.when(~named & c("_limit.lbs").isNotNull(), "mma_division_from_numeric_limit")
    kind, pounds, sure, code = c("_kind"), c("_limit.lbs"), c("_limit.confidence"), c("_mma")
    at_least = lambda x: F.greatest(sure, _sure(x))
    at_most = lambda x: F.least(sure, _sure(x))
    edge = lambda of_code: F.when(kind == "mma", of_code.cast("decimal(10,2)")).when(kind.isin("catch", "none"), pounds)
    division = (
        F.when(kind == "open", F.concat(c("_token"), F.lit("_OPEN"))).when(kind == "mma", F.concat(F.lit("MMA_"), F.coalesce(code, F.lit("UNKNOWN")))).when(kind == "catch", F.concat(c("_token"), F.lit("_CATCHWEIGHT")))
        .when(kind == "phrase", F.concat_ws("_", "_token", text.key_token(c("_name")))).otherwise(F.concat(c("_token"), F.lit("_UNKNOWN")))
    )
    name = F.when(kind == "open", "Open Weight").when(kind == "catch", "Catchweight").otherwise(F.coalesce(by_code(NAMES.items()), "_name", "_label"))
    confidence = (
        F.when(mma, F.when(kind == "open", _sure(0.98)).when(code.isNull(), at_most(0.6)).when(named, at_least(0.97)).otherwise(at_least(0.75)))
        .when(kind == "open", at_least(0.9)).when(kind.isin("catch", "phrase"), at_least(0.85)).otherwise(at_most(0.65))
    )
    notes = F.when(kind == "open", F.when(mma, "open_weight").otherwise("open_weight_non_mma")).when(mma, F.nullif(F.concat_ws(";", "_limit.note", numeric), F.lit(""))).otherwise(c("_limit.note"))
    made = F.struct(
        c("_sport").alias("sport"), c("_label").alias("label"), F.when(c("_low").contains("women"), "F").otherwise(c("_gender")).alias("sex"), division.alias("division"), name.alias("name"),
        edge(by_code(LIMITS)).alias("limit_lbs"), edge(by_code((k, a) for k, (a, _) in BOUNDS.items())).alias("lbs_min"), edge(by_code((k, b) for k, (_, b) in BOUNDS.items())).alias("lbs_max"), is_open.alias("is_open"),
        F.when(mma, (kind == "open") | code.isNotNull()).otherwise(False).alias("is_canonical"), c("_limit.unit").alias("unit"), c("_limit.value").alias("value"), pounds.alias("lbs"),
        F.when(mma | (kind == "catch"), catch & ~is_open).otherwise(False).alias("is_catchweight"), confidence.alias("confidence"), notes.alias("notes"))
    return rows.select(*kept, made.alias("w"))
