"""One load from the 15 exports to dimensions, facts and bridges: all tables are written beside the old ones, and one switch of the store shows them.

Two sources are joined: the first (``tapology_*``) knows all sports, the second (``ufcstats_*``) the rounds of one promotion; maps tie their people and contests. Every table reads what the
load has already written, so each is computed once and nothing is collected. Keys are numbers by the order of natural keys, counted by ranges. Of records that repeat, the
first known value or the last record holds, as each table says; ``_row`` is the order of a file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, weights
from ..operators import analytics, folds, joins
from ..sources import exports
from ..sources.store import Store
from .dimensions import same_day_order
from .performance import round_table

# The day that stands for a missing one, the last day of the events, seconds of a round, and the outcomes of the ontology.
NO_DAY, CUTOFF, ROUND_SECONDS, STANDARD = "1900-01-01", "2025-12-31", 300, "ABC_UNIFIED"
OUTCOMES, METHODS, DECISIONS = ("W", "L", "D", "NC", "UNKNOWN"), ("KO", "TKO", "SUB", "DEC", "DQ", "OVERTURNED", "OTHER", "UNKNOWN"), ("UD", "SD", "MD", "TD", "DRAW", "NA", "UNKNOWN")
STATISTICS = {
    "ufcstats_fight_rounds": {"kd": "kd", "sig_landed": "sig_str_land", "sig_attempted": "sig_str_att", "total_landed": "total_str_land", "total_attempted": "total_str_att", "td_landed": "td_land", "td_attempted": "td_att", "sub_attempts": "sub_att", "rev": "rev"},
    "ufcstats_fight_totals": {"kd": "kd", "sig_landed": "sig_str_land", "sig_attempted": "sig_str_att", "total_landed": "total_str_land", "total_attempted": "total_str_att", "td_landed": "td_land", "td_attempted": "td_att", "sub_attempts": "sub_att", "rev": "rev"},
    "ufcstats_sig_strikes_by_target": {f"{part}_{how}": f"{part}_{short}" for part in ("head", "body", "leg") for how, short in (("landed", "land"), ("attempted", "att"))},
    "ufcstats_sig_strikes_by_position": {f"{part}_{how}": f"{part}_{short}" for part in ("distance", "clinch", "ground") for how, short in (("landed", "land"), ("attempted", "att"))},
}


def fields(frame: DataFrame, *names: str) -> DataFrame:
    """The named columns, null where the export has none, and ``_row``."""
    return frame.select(*[F.col(n) if n in frame.columns else F.lit(None).cast("string").alias(n) for n in names], F.monotonically_increasing_id().alias("_row"))


def first_known(rows: DataFrame, key: str, columns: list[str], order: str = "_row") -> DataFrame:
    """One row a key, each column the first value that is not null."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns])


def last_record(rows: DataFrame, *keys: str, order: str = "_row") -> DataFrame:
    """One row a key, the last as a whole; keys are not null."""
    rest = [c for c in rows.columns if c not in keys]
    known = rows.where(" and ".join(f"{k} is not null" for k in keys))
    return known.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_x")).select(*keys, *[F.col(f"_x.{c}").alias(c) for c in rest if c != order])


def numbered(rows: DataFrame, key: list[str], out: str) -> DataFrame:
    return analytics.running_totals(rows.withColumn("_one", F.lit(1)), [], key, {out: "_one"}).drop("_one")


def sports(frames: dict[str, DataFrame]) -> DataFrame:
    c = F.col
    rates = fields(frames["sport_translation"], "sport", "translation_to_mma").select(text.sport(c("sport")).alias("sport"), text.to_decimal(c("translation_to_mma")).alias("translation_to_mma"), "_row")
    named = [frames["tapology_bouts"].select(text.sport(c("sport")).alias("sport")), frames["promotions_with_sports"].select(text.sport(c("sport_type")).alias("sport"))]
    keys = named[0].unionByName(named[1]).unionByName(frames["tapology_bouts"].sparkSession.range(1).select(F.lit("mma").alias("sport"))).distinct()
    found = keys.join(last_record(rates.where("translation_to_mma is not null"), "sport"), "sport", "left").withColumn("is_mma", c("sport") == "mma")
    return numbered(found, ["sport"], "sport_id")


def promotions(frames: dict[str, DataFrame], sports: DataFrame) -> DataFrame:
    """By slug, else by name. Those of the list with a strength, which is the greatest given; contests and events of these add fields that are missing."""
    c = F.col
    listed = fields(frames["promotions_with_sports"], "id", "name", "tapology_slug", "tapology_promotion_id", "sport_type", "baseline_strength")
    listed = listed.select(
        text.promotion_key(c("tapology_slug"), c("name")).alias("key"), text.uuid(c("id")).alias("id"), F.coalesce("name", F.lit("Unknown Promotion")).alias("name"), c("tapology_slug").alias("slug"), text.to_int(c("tapology_promotion_id")).alias("source_number"),
        text.sport(c("sport_type")).alias("sport"), text.to_decimal(c("baseline_strength")).alias("strength"), F.lit(None).cast("string").alias("url"), F.struct(F.lit(0).alias("f"), c("_row")).alias("_at")).where("key is not null and strength is not null")
    met = []
    for place, name in enumerate(("tapology_events", "tapology_bouts"), 1):
        rows = fields(frames[name], "promotion_tapology_url", "promotion_name", "promotion_tapology_id").withColumn("slug", text.last_path_part(c("promotion_tapology_url")))
        met.append(rows.where("slug is not null").select(
            text.promotion_key(c("slug"), c("promotion_name")).alias("key"), F.lit(None).cast("string").alias("id"), F.coalesce("promotion_name", F.lit("Unknown Promotion")).alias("name"), "slug", text.to_int(c("promotion_tapology_id")).alias("source_number"),
            F.lit(None).cast("string").alias("sport"), F.lit(None).cast("decimal(18,6)").alias("strength"), c("promotion_tapology_url").alias("url"), F.struct(F.lit(place).alias("f"), c("_row")).alias("_at")))
    seen = met[0].unionByName(met[1]).join(listed.where("slug is not null").select("slug").distinct(), "slug", "left_semi")
    whole = first_known(listed.unionByName(seen), "key", ["id", "name", "slug", "source_number", "sport", "url"], "_at")
    whole = whole.join(listed.groupBy("key").agg(F.max("strength").alias("strength")), "key").join(sports.select("sport", "sport_id"), "sport")
    return whole.select(F.coalesce("id", text.stable_uuid(F.concat(F.lit("promotion:"), c("key")))).alias("promotion_id"), "key", "name", "slug", "source_number", "url", "strength", "sport_id")


def weight_labels(frames: dict[str, DataFrame]) -> DataFrame:
    """Every label of both sources, parsed (``w``); contests of the second are MMA."""
    c = F.col
    one = fields(frames["tapology_bouts"], "sport", "weight_class", "weight_lbs").select(F.lit("tapology").alias("source"), text.sport(c("sport")).alias("sport"), c("weight_class").alias("label"), c("weight_lbs").alias("lbs"), F.lit(None).cast("string").alias("gender"), "_row")
    two = fields(frames["ufcstats_fights"], "weight_class", "gender").select(F.lit("ufcstats").alias("source"), F.lit("mma").alias("sport"), c("weight_class").alias("label"), F.lit(None).cast("string").alias("lbs"), "gender", "_row")
    return weights.weight_class(one.unionByName(two), c("label"), c("gender"), c("lbs"), c("sport")).select("source", "_row", "w.*")


def divisions(labels: DataFrame, sports: DataFrame) -> DataFrame:
    """By sport, key and sex, first known fields; and each sport's division for contests without one."""
    order = F.struct((F.col("source") != "tapology").alias("s"), "_row")
    facts = ["name", "limit_lbs", "lbs_min", "lbs_max", "is_open", "is_canonical"]
    known = labels.withColumn("_at", order).groupBy("sport", "division", "sex").agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_at"))).alias(c) for c in facts])
    unknown = sports.select("sport", F.concat(F.upper("sport"), F.lit("_UNKNOWN")).alias("division"), F.lit("U").alias("sex"), F.lit("Unknown").alias("name"))
    whole = known.unionByName(unknown.join(known, ["sport", "division", "sex"], "left_anti"), allowMissingColumns=True).join(sports.select("sport", "sport_id"), "sport")
    return numbered(whole, ["sport", "division", "sex"], "division_id")


def weight_limits(labels: DataFrame) -> DataFrame:
    rows = labels.where("unit is not null and value is not null and lbs is not null").withColumn("value", F.col("value").cast("decimal(18,2)"))
    return numbered(rows.groupBy("unit", "value").agg(F.min_by("lbs", F.struct((F.col("source") != "tapology").alias("s"), "_row")).alias("lbs")), ["unit", "value"], "weight_limit_id")


def weight_bridge(labels: DataFrame, divisions: DataFrame, limits: DataFrame) -> DataFrame:
    """Each label of a source and sport with its most certain parse, the last of equals."""
    facts = ["division", "sex", "unit", "value", "is_catchweight", "is_open", "confidence", "notes"]
    best = labels.groupBy("source", "sport", "label").agg(F.max_by(F.struct(*facts), F.struct("confidence", "_row")).alias("x")).select("source", "sport", "label", "x.*").withColumn("value", F.col("value").cast("decimal(18,2)"))
    return joins.lookup_with_fallback(best, divisions, ["sport", "division", "sex"], "division_id", {"sex": "U"}).join(limits.drop("lbs"), ["unit", "value"], "left").select("source", "label", "sport", "division_id", "weight_limit_id", "is_catchweight", "is_open", "confidence", "notes")


def rulesets(frames: dict[str, DataFrame], sports: DataFrame) -> DataFrame:
    c, none = F.col, F.lit(None).cast("int")
    title = lambda name: F.coalesce(text.boolean(c(name)), F.lit(False))
    two = fields(frames["ufcstats_fights"], "scheduled_rounds", "is_title_bout").select(F.lit("mma").alias("sport"), text.ruleset(F.lit("mma"), text.to_int(c("scheduled_rounds")), title("is_title_bout")).alias("r"))
    one = fields(frames["tapology_bouts"], "sport", "is_title_fight").select(text.sport(c("sport")).alias("sport"), "is_title_fight").select("sport", text.ruleset(c("sport"), none, title("is_title_fight")).alias("r"))
    title_five = one.select("sport").distinct().where("sport = 'mma'").select("sport", text.ruleset(c("sport"), F.lit(5), F.lit(True)).alias("r"))
    rows = one.unionByName(two).unionByName(title_five).select("sport", "r.*").distinct().join(sports.select("sport", "sport_id"), "sport")
    return numbered(rows.select("ruleset", "sport_id", "rounds", F.lit(ROUND_SECONDS).alias("round_seconds"), F.lit(STANDARD).alias("standard")), ["ruleset"], "ruleset_id")


def fighters(frames: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(people, links): those of the first source who took part and have a profile, each with the last of the second that the map ties to it; the links (tap, ufc) are the last of each ufc id."""
    c = F.col
    taking = frames["tapology_bout_fighters"].select(c("tapology_fighter_id").alias("tap")).where("tap is not null").distinct()
    profile = ["name", "nickname", "dob", "dob_raw", "birth_place", "country", "fighting_out_of", "affiliation_gym", "foundation_style", "profile_image_url", "height_in", "reach_in", "stance", "fetched_at", "source_file"]
    first = last_record(fields(frames["tapology_fighters"], "tapology_fighter_id", *profile).withColumnRenamed("tapology_fighter_id", "tap"), "tap").join(taking, "tap", "left_semi")
    second = last_record(fields(frames["ufcstats_fighters"], "ufcstats_fighter_id", "name", "dob", "record", "height_in", "reach_in", "stance", "fetched_at").withColumnRenamed("ufcstats_fighter_id", "ufc"), "ufc")
    second = second.select("ufc", *[c(x).alias(f"u_{x}") for x in second.columns if x != "ufc"])
    tied = fields(frames["fighter_id_map"], "tapology_fighter_id", "ufcstats_fighter_id").select(c("tapology_fighter_id").alias("tap"), c("ufcstats_fighter_id").alias("ufc"), "_row").where("ufc is not null").join(first.select("tap"), "tap", "left_semi")
    of_first, links = last_record(tied, "tap"), last_record(tied.select("ufc", "tap", "_row"), "ufc")
    fights = fields(frames["ufcstats_fights"], "red_fighter_id", "blue_fighter_id", "gender").withColumn("sex", text.gender(c("gender"))).where("sex != 'U'")
    sexes = fights.select(F.explode(F.array(F.struct(c("red_fighter_id").alias("ufc"), F.lit(0).alias("side")), F.struct(c("blue_fighter_id").alias("ufc"), F.lit(1).alias("side")))).alias("x"), "sex", "_row").select("x.ufc", "sex", F.struct("_row", "x.side").alias("_row"))
    met = first.join(of_first, "tap", "left").join(second, "ufc", "left").join(last_record(sexes, "ufc"), "ufc", "left")
    size = lambda n: F.coalesce(F.nullif(text.to_decimal(c(n)), F.lit(0)), text.to_decimal(c(f"u_{n}")))
    people = met.select(
        "tap", "ufc", F.coalesce("name", "u_name", text.name_of_slug(c("tap"))).alias("name"), "nickname", "dob_raw", text.flexible_date(F.coalesce("dob", "u_dob")).alias("birth_date"), "birth_place", F.coalesce("country", F.lit("UNK")).alias("country"), "fighting_out_of",
        "affiliation_gym", "foundation_style", "profile_image_url", c("u_record").alias("record"), size("height_in").alias("height_in"), text.inches_to_cm(size("height_in")).alias("height_cm"), size("reach_in").alias("reach_in"), text.inches_to_cm(size("reach_in")).alias("reach_cm"),
        F.coalesce("stance", "u_stance").alias("stance"), F.coalesce("sex", F.lit("U")).alias("sex"), F.greatest(text.timestamp(c("fetched_at")), text.timestamp(c("u_fetched_at"))).alias("fetched_at"), "source_file", c("u_name").isNotNull().alias("has_second"))
    return numbered(people, ["tap"], "fighter_id"), links


def fighter_sources(people: DataFrame, links: DataFrame) -> DataFrame:
    """(source, source_id, fighter_id): every id of either source that means one of ``people``."""
    one = people.select(F.lit("tapology").alias("source"), F.col("tap").alias("source_id"), "fighter_id")
    return one.unionByName(links.join(people.select("tap", "fighter_id"), "tap").select(F.lit("ufcstats").alias("source"), F.col("ufc").alias("source_id"), "fighter_id"))


def _event_slug(frame: DataFrame, *names: str) -> DataFrame:
    c = F.col
    rows = fields(frame, "event_tapology_slug", "event_tapology_url", "event_tapology_id", *names)
    return rows.withColumn("slug", F.coalesce(c("event_tapology_slug"), text.last_path_part(c("event_tapology_url"))))


def second_events(frames: dict[str, DataFrame]) -> DataFrame:
    c = F.col
    rows = fields(frames["ufcstats_events_2025"], "event_id", "date", "name", "url", "uuid", "num_fights", "location").withColumn("event_date", F.coalesce(text.flexible_date(c("date")), F.lit(NO_DAY).cast("date"))).where(c("event_date") <= F.lit(CUTOFF).cast("date"))
    rows = rows.select(c("event_id").alias("ufc_event"), "event_date", F.coalesce("name", F.concat(F.lit("UFCStats Event "), c("event_id"))).alias("event_name"), "url", text.uuid(c("uuid")).alias("uuid"), text.to_int(c("num_fights")).alias("num_fights"), "location", "_row")
    return numbered(first_known(rows, "ufc_event", ["event_date", "event_name", "url", "uuid", "num_fights", "location"]), ["ufc_event"], "event_id")


def first_events(frames: dict[str, DataFrame]) -> DataFrame:
    c, parts = F.col, []
    for place, name in enumerate(("tapology_events", "tapology_bouts")):
        rows = _event_slug(frames[name], "event_date", "event_date_raw", "event_name", "promotion_tapology_url", "promotion_name").withColumn("slug", F.coalesce("slug", "event_tapology_id"))
        parts.append(rows.select(
            "slug", F.coalesce(text.flexible_date(c("event_date")), text.flexible_date(c("event_date_raw")), F.lit(NO_DAY).cast("date")).alias("event_date"), "event_date_raw", F.coalesce("event_name", F.concat(F.lit("Tapology Event "), c("slug"))).alias("event_name"),
            c("event_tapology_url").alias("url"), text.last_path_part(c("promotion_tapology_url")).alias("promotion_slug"), "promotion_name", F.struct(F.lit(place).alias("f"), "_row").alias("_row")))
    return first_known(parts[0].unionByName(parts[1]), "slug", ["event_date", "event_date_raw", "event_name", "url", "promotion_slug", "promotion_name"])


def event_bridge(frames: dict[str, DataFrame], events: DataFrame) -> DataFrame:
    """Events of both sources that share contests by the map, one to one: most shared first. ``confidence`` is the share of the second's mapped contests."""
    c = F.col
    of_bout = last_record(_event_slug(frames["tapology_bouts"], "tapology_bout_id").where("slug is not null").select(c("tapology_bout_id").alias("ref"), "slug", "_row"), "ref")
    of_fight = last_record(fields(frames["ufcstats_fights"], "ufcstats_fight_id", "ufcstats_event_id").where("ufcstats_event_id is not null").select(c("ufcstats_fight_id").alias("fight"), c("ufcstats_event_id").alias("ufc_event"), "_row"), "fight")
    tied = fields(frames["bout_id_map"], "ufcstats_fight_id", "tapology_bout_id").select(c("ufcstats_fight_id").alias("fight"), c("tapology_bout_id").alias("ref"))
    shared = tied.join(of_fight, "fight").join(of_bout, "ref").join(events.select("ufc_event", "event_id"), "ufc_event").groupBy("ufc_event", "event_id", "slug").agg(F.count("*").alias("n"))
    total = shared.groupBy("ufc_event").agg(F.sum("n").alias("total"))
    best = joins.greedy_match(shared, "ufc_event", "slug", "n")
    return best.join(total, "ufc_event").join(events.select("ufc_event", "event_id"), "ufc_event").select("ufc_event", "slug", "event_id", c("n").alias("mapped_contests"), F.round(c("n") / c("total"), 4).alias("confidence"))


def bouts(frames: dict[str, DataFrame], t: dict[str, DataFrame]) -> DataFrame:
    """One row a contest of either source, joined by the map. The second source's fields count where it has them. A contest of the first stands at the next event of the second.

    Raises where a contest of the second at a known event has none of the first.
    """
    c = F.col
    truth = lambda n: F.coalesce(text.boolean(c(n)), F.lit(False))
    raw = _event_slug(frames["tapology_bouts"], "tapology_bout_id", "event_date", "event_date_raw", "sport", "is_title_fight", "is_amateur", "weight_class", "weight_lbs", "method", "method_details", "promotion_tapology_url")
    one = last_record(raw.withColumnRenamed("tapology_bout_id", "ref"), "ref").withColumns({"sport": text.sport(c("sport")), "title": truth("is_title_fight"), "day": F.coalesce(text.flexible_date(c("event_date")), text.flexible_date(c("event_date_raw")))})
    one = one.withColumn("rounds", F.when((c("sport") == "mma") & c("title"), 5)).withColumns({"m": text.method_group(c("method"), c("method_details")), "finish_round": text.round_in_details(c("method_details")), "finish_seconds": text.time_in_details(c("method_details"))})
    one = weights.weight_class(one, c("weight_class"), F.lit(None).cast("string"), c("weight_lbs"), c("sport"))
    one = joins.forward_asof(one.select("ref", "day", "sport", "title", truth("is_amateur").alias("is_amateur"), "rounds", c("m.method").alias("method"), c("m.decision").alias("decision"), "finish_round", "finish_seconds", text.last_path_part(c("promotion_tapology_url")).alias("promotion_slug"), "slug",
        c("weight_class").alias("label"), F.coalesce(text.to_decimal(c("weight_lbs")), c("w.lbs")).cast("double").alias("weight_lbs"), c("w.division").alias("division"), c("w.sex").alias("sex"), c("w.is_catchweight").alias("is_catchweight"), c("w.is_open").alias("is_open")), "day", t["events"].select("event_date", "event_id"), "event_date", "event_id")
    one = one.where("event_id is not null").drop("event_date").withColumn("key", F.concat(F.lit("tap:"), c("ref")))
    tied = last_record(fields(frames["bout_id_map"], "ufcstats_fight_id", "tapology_bout_id").select(c("ufcstats_fight_id").alias("fight"), c("tapology_bout_id").alias("mapped"), "_row").where("mapped is not null"), "fight")
    fights = fields(frames["ufcstats_fights"], "ufcstats_fight_id", "ufcstats_event_id", "scheduled_rounds", "is_title_bout", "weight_class", "gender", "method", "method_detail", "round", "time", "referee", "winner_fighter_id").withColumnRenamed("ufcstats_fight_id", "fight").where("fight is not null")
    fights = fights.join(t["events"].select(c("ufc_event").alias("ufcstats_event_id"), c("event_id").alias("event2")), "ufcstats_event_id").join(tied, "fight", "left").join(one.select(c("ref").alias("mapped"), F.lit(True).alias("_there")), "mapped", "left")
    fights = fights.withColumns({"key": F.when(c("_there"), F.concat(F.lit("tap:"), c("mapped"))).otherwise(F.concat(F.lit("ufc:"), c("fight"))), "m2": text.method_group_second(c("method"), c("method_detail"))})
    fights = weights.weight_class(fights, c("weight_class"), c("gender"), F.lit(None).cast("string"), F.lit("mma"))
    winner = t["fighter_sources"].where("source = 'ufcstats'").select(c("source_id").alias("winner_fighter_id"), c("fighter_id").alias("winner_id"))
    two = last_record(fights, "key").join(winner, "winner_fighter_id", "left").select(
        "key", "fight", "mapped", "event2", text.to_int(c("scheduled_rounds")).alias("rounds2"), truth("is_title_bout").alias("title2"), F.nullif(c("m2.method"), F.lit("UNKNOWN")).alias("method2"), F.nullif(c("m2.decision"), F.lit("UNKNOWN")).alias("decision2"), text.to_int(c("round")).alias("round2"),
        text.minutes_seconds(c("time")).alias("seconds2"), "referee", "winner_id", c("weight_class").alias("label2"), c("w.lbs").cast("double").alias("lbs2"), c("w.division").alias("division2"), c("w.sex").alias("sex2"), c("w.is_catchweight").alias("catch2"), c("w.is_open").alias("open2"))
    has = c("fight").isNotNull()
    pick = lambda second, first, out: F.coalesce(second, first).alias(out)
    both = one.join(two, "key", "full_outer").select(
        "key", F.coalesce("mapped", "ref").alias("ref"), "fight", pick("event2", "event_id", "event_id"), F.when(has, F.lit("mma")).otherwise(c("sport")).alias("sport"), "day", F.when(has, c("title2")).otherwise(c("title")).alias("title"), F.coalesce("is_amateur", F.lit(False)).alias("is_amateur"),
        F.when(has, c("rounds2")).otherwise(c("rounds")).alias("rounds"), F.coalesce("method2", "method", F.lit("UNKNOWN")).alias("method"), F.coalesce("decision2", "decision", F.lit("NA")).alias("decision"), pick("round2", "finish_round", "finish_round"), pick("seconds2", "finish_seconds", "finish_seconds"),
        "referee", "winner_id", pick("label2", "label", "label"), pick("lbs2", "weight_lbs", "weight_lbs"), F.when(has, c("division2")).otherwise(c("division")).alias("division"), F.when(has, c("sex2")).otherwise(c("sex")).alias("sex"),
        (F.coalesce("catch2", F.lit(False)) | F.coalesce("is_catchweight", F.lit(False))).alias("is_catchweight"), (F.coalesce("open2", F.lit(False)) | F.coalesce("is_open", F.lit(False))).alias("is_open"), "promotion_slug", "slug")
    known = fields(frames["ufcstats_fights"], "ufcstats_fight_id", "ufcstats_event_id").join(t["events"].select(c("ufc_event").alias("ufcstats_event_id")), "ufcstats_event_id").select(c("ufcstats_fight_id").alias("fight")).where("fight is not null").distinct()
    joins.require_all(known, both.where("fight is not null and ref is not null"), "fight")
    both = both.withColumn("total_seconds", (c("finish_round") - 1) * ROUND_SECONDS + c("finish_seconds")).withColumn("ruleset", text.ruleset(c("sport"), c("rounds"), c("title"))["ruleset"])
    both = both.join(t["rulesets"].select("ruleset", "ruleset_id"), "ruleset", "left").join(t["sports"].select("sport", "sport_id"), "sport", "left")
    placed = joins.lookup_with_fallback(both, t["divisions"], ["sport", "division", "sex"], "division_id", {"sex": "U"})
    unknown = t["divisions"].where("sex = 'U'").where(F.col("division") == F.concat(F.upper("sport"), F.lit("_UNKNOWN"))).select("sport", c("division_id").alias("_none"))
    placed = placed.join(unknown, "sport", "left").withColumn("division_id", F.coalesce("division_id", "_none")).drop("_none")
    promoted = t["promotions"].where("slug is not null").groupBy(c("slug").alias("promotion_slug")).agg(F.min_by("promotion_id", "key").alias("promotion_id"))
    return numbered(placed.join(promoted, "promotion_slug", "left"), ["key"], "bout_id")


def results(spark: SparkSession) -> DataFrame:
    """The ontology: every outcome and method, decisions with decided contests only. A table of fixed size."""
    axis = lambda values, name: F.explode(F.array(*[F.lit(v) for v in values])).alias(name)
    rows = spark.range(1).select(axis(OUTCOMES, "outcome")).select("*", axis(METHODS, "method")).select("*", axis(DECISIONS, "decision")).where("method = 'DEC' or decision in ('NA', 'UNKNOWN')")
    return numbered(rows, ["outcome", "method", "decision"], "result_id")


def participants(frames: dict[str, DataFrame], t: dict[str, DataFrame]) -> DataFrame:
    """One row a contest and contestant: both corners of the second source, with the first source's outcomes over them, and opponents that only the first names."""
    c = F.col
    ids = lambda source, out: t["fighter_sources"].where(c("source") == source).select(c("source_id").alias(f"{out}_source"), c("fighter_id").alias(out))
    fights = last_record(fields(frames["ufcstats_fights"], "ufcstats_fight_id", "red_fighter_id", "blue_fighter_id", "winner_fighter_id", "method", "method_detail").withColumnRenamed("ufcstats_fight_id", "fight"), "fight")
    fights = fights.join(t["bouts"].where("fight is not null").select("fight", "bout_id"), "fight").withColumns({"red_source": c("red_fighter_id"), "blue_source": c("blue_fighter_id")}).join(ids("ufcstats", "red"), "red_source").join(ids("ufcstats", "blue"), "blue_source")
    fights = fights.withColumn("o", text.corner_results(c("winner_fighter_id"), c("red_fighter_id"), c("blue_fighter_id"), text.method_group_second(c("method"), c("method_detail"))["method"]))
    side = lambda me, other: F.struct(c(me).alias("contestant"), c(other).alias("opponent"), c(f"o.{me}").alias("outcome"), c(f"{me}_source").alias("source_id"), F.lit(me).alias("corner"))
    corners = fights.select(c("bout_id").alias("contest_id"), F.explode(F.array(side("red", "blue"), side("blue", "red"))).alias("s")).select("contest_id", "s.*")
    records = last_record(fields(frames["ufcstats_fighters"], "ufcstats_fighter_id", "record").withColumnRenamed("ufcstats_fighter_id", "source_id"), "source_id")
    primary = corners.join(records, "source_id", "left").select("contest_id", "contestant", "opponent", "outcome", "record")
    named = fields(frames["tapology_bout_fighters"], "tapology_bout_id", "tapology_fighter_id", "opponent_tapology_slug", "result", "fighter_record_before_raw").select(c("tapology_bout_id").alias("ref"), c("tapology_fighter_id").alias("me_source"), c("opponent_tapology_slug").alias("other_source"), "result", c("fighter_record_before_raw").alias("record"), "_row")
    named = named.join(t["bouts"].where("ref is not null").select("ref", c("bout_id").alias("contest_id"), "method"), "ref").join(ids("tapology", "me"), "me_source").join(ids("tapology", "other"), "other_source", "left")
    outcome = F.when(c("method") == "OVERTURNED", "NC").otherwise(text.result(c("result")))
    secondary = last_record(named.select("contest_id", c("me").alias("contestant"), c("other").alias("opponent"), outcome.alias("outcome"), "record", "_row"), "contest_id", "contestant")
    whole = joins.merge_participants(primary, secondary).join(corners.select("contest_id", "contestant", "corner"), ["contest_id", "contestant"], "left")
    told = whole.join(t["bouts"].select(c("bout_id").alias("contest_id"), "method", "decision"), "contest_id").withColumn("decision", text.decision_for(c("outcome"), c("method"), c("decision")))
    unknown = {"outcome": "UNKNOWN", "method": "UNKNOWN", "decision": "UNKNOWN"}
    found = joins.lookup_with_fallback(told, t["results"], ["outcome", "method", "decision"], "result_id", unknown)
    return found.select(c("contest_id").alias("bout_id"), c("contestant").alias("fighter_id"), c("opponent").alias("opponent_id"), F.coalesce("corner", F.lit("unknown")).alias("corner"), "outcome", "result_id", "record", "inferred")


def statistics(frames: dict[str, DataFrame], t: dict[str, DataFrame], name: str) -> DataFrame:
    """One statistics export by contest and contestant; rows of others are left out, ``Totals`` are round 0."""
    c, columns = F.col, STATISTICS[name]
    rows = fields(frames[name], "ufcstats_fight_id", "ufcstats_fighter_id", "round", "ctrl", *columns.values())
    whose = t["fighter_sources"].where("source = 'ufcstats'").select(c("source_id").alias("ufcstats_fighter_id"), "fighter_id")
    met = rows.join(t["bouts"].where("fight is not null").select(c("fight").alias("ufcstats_fight_id"), "bout_id"), "ufcstats_fight_id").join(whose, "ufcstats_fighter_id")
    found = met.select("bout_id", "fighter_id", text.round_number(c("round")).alias("round_num"), *[text.to_int(c(source)).alias(out) for out, source in columns.items()], text.minutes_seconds(c("ctrl")).alias("ctrl_seconds"))
    found = found.drop("ctrl_seconds") if "strikes" in name else found
    return found.drop("round_num") if name.endswith("totals") else found.where("round_num is not null")


def load_exports(spark: SparkSession, folder: str, store: Store) -> int:
    """Loads all exports of ``folder`` into ``store`` and gives its new version. The old version is shown until all tables are there; a load that fails can be repeated.

    Tables: sports, promotions, divisions, weight_limits, weight_bridge, rulesets, fighters, fighter_sources, source_events, events, event_bridge, bouts, results, participants, round_stats, by_target, by_position, fight_totals, rounds.
    Empty exports give empty tables; missing columns are null.
    """
    frames, draft, t = exports.load(spark, folder), store.begin(), {}

    def put(name: str, df: DataFrame) -> None:
        t[name] = draft.put(name, "all", df)

    put("sports", sports(frames))
    put("promotions", promotions(frames, t["sports"]))
    put("weight_labels", weight_labels(frames))
    put("divisions", divisions(t["weight_labels"], t["sports"]))
    put("weight_limits", weight_limits(t["weight_labels"]))
    put("weight_bridge", weight_bridge(t["weight_labels"], t["divisions"], t["weight_limits"]))
    put("rulesets", rulesets(frames, t["sports"]))
    people, links = fighters(frames)
    put("fighters", people)
    put("fighter_sources", fighter_sources(t["fighters"], links))
    put("source_events", first_events(frames))
    put("events", second_events(frames))
    put("event_bridge", event_bridge(frames, t["events"]))
    put("bouts", bouts(frames, t))
    put("results", results(spark))
    put("participants", participants(frames, t))
    for table, name in (("round_stats", "ufcstats_fight_rounds"), ("by_target", "ufcstats_sig_strikes_by_target"), ("by_position", "ufcstats_sig_strikes_by_position"), ("fight_totals", "ufcstats_fight_totals")):
        put(table, statistics(frames, t, name))
    seen = [t[n].select(F.col("bout_id").alias("contest_id"), "round_num") for n in ("round_stats", "by_target", "by_position")]
    put("rounds", round_table(t["bouts"].withColumnRenamed("bout_id", "contest_id"), seen[0].unionByName(seen[1]).unionByName(seen[2])).withColumnRenamed("contest_id", "bout_id"))
    mark = exports.watermark(t["events"], "event_date", "event_id").first()
    draft.facts["watermark"] = {"newest_day": str(mark["newest_day"]), "newest": mark["newest"]}
    return draft.commit()


def contest_log(store: Store, tiers: tuple[float, float] = (0.9, 0.6)) -> DataFrame | None:
    """The log that the folds read: contests of exactly two contestants, the smaller id as ``a``; the promotion's strength gives ``promotion`` and the tier: A and B from ``tiers`` on, else C.

    ``day`` is the first source's day of the contest, else the event's; ``checkpoint`` is the event's, at which snapshots stand. ``seq`` orders the contests of a day by checkpoint and then as
    tournaments go, by the records that contestants brought to them. A missing day is the first of 1900.
    """
    c = F.col
    people = store.read("participants")
    if people is None:
        return None
    names = store.read("fighters").select("fighter_id", "name")
    people = people.join(names, "fighter_id", "left").withColumns({"name": F.coalesce("name", c("fighter_id").cast("string")), "total": text.record_total(c("record"))})
    side = F.struct("fighter_id", "outcome", "total", "name")
    pair = people.groupBy("bout_id").agg(F.min(side).alias("x"), F.max(side).alias("y"), F.count("*").alias("n")).where("n = 2")
    strength = store.read("promotions").select("promotion_id", c("strength").cast("double").alias("promotion"))
    met = store.read("bouts").join(pair, "bout_id").join(store.read("events").select("event_id", "event_date"), "event_id", "left").join(strength, "promotion_id", "left")
    tier = F.when(c("promotion") >= tiers[0], "A").when(c("promotion") >= tiers[1], "B").otherwise("C")
    first = F.lit(folds.FIRST_DAY).cast("date")
    log = met.select(
        c("bout_id").alias("contest_id"), F.coalesce("day", "event_date", first).alias("day"), F.coalesce("event_date", "day", first).alias("checkpoint"), c("x.fighter_id").alias("a"), c("y.fighter_id").alias("b"), text.rating_outcome(text.pair_outcome(c("x.outcome"), c("y.outcome"))).alias("outcome"), "sport", text.finish_method(c("method")).alias("method"),
        F.coalesce("rounds", F.lit(3)).alias("rounds"), "title", "finish_round", "finish_seconds", "promotion", tier.alias("tier"), F.lit(None).cast("double").alias("margin"),
        c("x.total").alias("total_a"), c("y.total").alias("total_b"), c("x.name").alias("name_a"), c("y.name").alias("name_b"))
    return same_day_order(log)
