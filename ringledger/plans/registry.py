"""Where the plans register their queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .contest import CONTESTS_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, views: bool = True):
    """Registers a function of (spark, sf_dir) by its name; ``sql`` may use the contest views."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"with {CONTESTS_SQL} {sql}" if views else sql
        return f

    return keep


r6 = lambda c: F.round(c, 6)
