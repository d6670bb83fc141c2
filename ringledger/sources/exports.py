"""Reading the contest exports (CSV, every column text) and writing result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text


def header(spark: SparkSession, path: str) -> list[str]:
    """The columns that a CSV file names; none where it is empty."""
    return spark.read.option("header", True).csv(path).columns


def read_export(spark: SparkSession, path: str, columns: list[str] | None = None, multi_line: bool = False) -> DataFrame:
    """A CSV export with the given columns (or all) as trimmed text; empty fields are null, missing columns all null, further ones are not read.

    The header is read once. With ``multi_line`` fields may hold line breaks, and a file is read by one task.
    """
    head = header(spark, path)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in head])
    rows = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').schema(schema).csv(path)
    return rows.select(*[(text.clean(F.col(c)) if c in head else F.lit(None).cast("string")).alias(c) for c in (head if columns is None else columns)])


# The exports' files, and in which columns of them ids of 16 hex digits stand (with the column of the url that may hold them too).
EXPORTS = (
    "tapology_fighters", "tapology_events", "tapology_bouts", "tapology_bout_fighters", "ufcstats_fighters", "ufcstats_events_2025", "ufcstats_fights", "ufcstats_fight_totals", "ufcstats_fight_rounds",
    "ufcstats_sig_strikes_by_target", "ufcstats_sig_strikes_by_position", "fighter_id_map", "bout_id_map", "promotions_with_sports", "sport_translation",
)
HEX_IDS = {
    "ufcstats_fighters": {"ufcstats_fighter_id": "ufcstats_url"},
    "ufcstats_events_2025": {"event_id": "url"},
    "ufcstats_fights": {"ufcstats_fight_id": "ufcstats_fight_url", "ufcstats_event_id": None, "red_fighter_id": None, "blue_fighter_id": None, "winner_fighter_id": None},
    "ufcstats_fight_totals": {"ufcstats_fight_id": None, "ufcstats_fighter_id": None},
    "ufcstats_fight_rounds": {"ufcstats_fight_id": None, "ufcstats_fighter_id": None},
    "ufcstats_sig_strikes_by_target": {"ufcstats_fight_id": None, "ufcstats_fighter_id": None},
    "ufcstats_sig_strikes_by_position": {"ufcstats_fight_id": None, "ufcstats_fighter_id": None},
    "fighter_id_map": {"ufcstats_fighter_id": None},
    "bout_id_map": {"ufcstats_fight_id": None},
}


def load(spark: SparkSession, folder: str, names: tuple[str, ...] = EXPORTS, multi_line: bool = False) -> dict[str, DataFrame]:
    """Every export as a frame of trimmed texts, its hex ids in canonical form. Files are read when the frames are."""
    frames = {}
    for name in names:
        path = f"{folder}/{name}.csv"
        frame = read_export(spark, path, multi_line=multi_line)
        for id_col, url_col in HEX_IDS.get(name, {}).items():
            if id_col in frame.columns or url_col in frame.columns:
                frame = with_resolved_ids(frame, id_col, url_col)
        frames[name] = frame
    return frames


def with_resolved_ids(df: DataFrame, id_col: str, url_col: str | None = None) -> DataFrame:
    """The id that the url holds, else the raw one if it is well formed, else null."""
    known = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    return df.withColumn(id_col, text.resolve_hex_id(known(id_col), known(url_col)))


def write_table(df: DataFrame, path: str, by: list[str] | None = None, replace: bool = True) -> None:
    """A Parquet table; with ``by`` only the partitions that ``df`` has are replaced."""
    writer = df.write.mode("overwrite" if replace else "append")
    if by:
        writer = writer.partitionBy(*by).option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def watermark(events: DataFrame, day: str, key: str) -> DataFrame:
    """One row: the newest day and the newest record of it."""
    return events.agg(F.max(day).alias("newest_day"), F.max_by(key, F.struct(day, key)).alias("newest"))
