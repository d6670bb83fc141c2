"""URL filter as a sort-merge range join, in DataFrame functions only.

A url becomes canonical keys ``net.example.m./en/25``: the host's labels reversed, each closed by a
dot, then the path. A rule (host, path) becomes the same kind of key, so the urls it fits under its host
are one interval of the sorted keys. Rules whose keys are prefixes of one another nest; every rule
carries the stack of rules open at its key. One sorted sweep over rules and urls together then gives each
url key the stack of the last rule before it, and the longest entry that is a prefix of the key applies.

A rule also fits subdomains, where the path does not follow the rule's host directly. So a url is swept once
for each number of labels that some rule's host has (``net.`` and ``net.example.`` for rules of one and
two labels): the host is cut to that many labels and the path appended.

Scale: urls are dealt over salts, and the (small) rule list is replicated to every salt, so a host with a third
of all urls is spread evenly; there is one shuffle, and the sweep streams. Nothing is broadcast or collected but
the distinct label counts of the rules (at most 127, the limit of host names).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

RULE_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("host", "path", "verdict")])
#: host, path, verdict
DEFAULT_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _cut_key(host: Column, depth: Column) -> Column:
    """The last ``depth`` labels of a host, reversed and each closed by a dot."""
    labels = F.reverse(F.split(host, r"\.", -1))
    return F.concat(F.array_join(F.slice(labels, 1, depth), "."), F.lit("."))


def _stacked_rules(rules: DataFrame) -> DataFrame:
    """Rules with key, depth and the stack of the rules whose keys are prefixes of theirs, shortest first."""
    clean = (
        rules.select(lower_ascii(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
        .where("host is not null and host != ''")
        .groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # "block" wins over "allow" for a rule given twice
        .withColumn("depth", F.size(F.split("host", r"\.", -1)))
        .withColumn("key", F.concat(_cut_key(F.col("host"), F.col("depth")), F.col("path")))
        .withColumn("rule", F.concat("host", "path"))
    )
    outer = clean.select("host", F.col("path").alias("outer_path"), F.struct(F.length("rule").alias("length"), F.col("key").alias("key"), F.col("rule").alias("rule"), F.col("verdict").alias("verdict")).alias("entry"))
    prefixes = clean.select("host", "key", "depth", F.explode(F.transform(F.sequence(F.lit(0), F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))).alias("outer_path"))
    return prefixes.join(outer, ["host", "outer_path"]).groupBy("key", "depth").agg(F.sort_array(F.collect_list("entry")).alias("stack"))


def judge_urls(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", salts: int | None = None) -> DataFrame:
    """One row per input row: ``id_col, url, host, path, rule, verdict``.

    The longest rule (host and path together) that fits wins; between hosts and paths of the same total length the longer
    host wins. Without a fitting rule ``rule`` is null and ``verdict`` is ``default``. Null urls and urls
    without ``://`` have empty host and path and fit no rule. Rows that repeat are returned as often as they came; ids
    may be null. Rules with null or empty hosts are ignored, and of a rule given twice with both verdicts
    ``block`` holds. Other columns of ``urls`` are not read. An empty table gives an empty result, and no rules
    give ``default`` for all.
    """
    spark = urls.sparkSession
    salts = salts or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    stacked = _stacked_rules(rules)
    depths = sorted(r[0] for r in rules.where("host is not null and host != ''").select(F.size(F.split("host", r"\.", -1))).distinct().collect())
    base = urls.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).withColumns({"host": url_host(F.col("url")), "path": url_path(F.col("url"))})
    # Repeated rows are folded before the shuffle's sweep and given back at the end.
    base = base.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(salts)).cast("int"))
    width = F.size(F.split("host", r"\.", -1))
    wanted = F.filter(F.array(*[F.lit(d) for d in depths]) if depths else F.array().cast("array<int>"), lambda d: (d <= width) & (F.col("host") != ""))
    probes = base.withColumn("depth", F.explode_outer(wanted)).withColumn("key", F.concat(_cut_key(F.col("host"), F.col("depth")), "path"))
    opened = stacked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).select(
        "salt", "key", F.lit(0).alias("is_url"), "stack", *[F.lit(None).cast(t).alias(c) for c, t in (("id", urls.schema[id_col].dataType), ("url", "string"), ("host", "string"), ("path", "string"))])
    asked = probes.select("salt", "key", F.lit(1).alias("is_url"), F.lit(None).cast(opened.schema["stack"].dataType).alias("stack"), "id", "url", "host", "path")
    sweep = Window.partitionBy("salt").orderBy("key", "is_url").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = opened.unionByName(asked).withColumn("stack", F.last("stack", ignorenulls=True).over(sweep)).where("is_url = 1")
    hit = F.filter("stack", lambda e: F.startswith(F.col("key"), e["key"]))
    met = met.withColumn("best", F.when(F.col("key").isNotNull(), F.try_element_at(hit, F.lit(-1))))
    probes_each = F.greatest(F.size(wanted), F.lit(1))
    found = met.groupBy("salt", "id", "url", "host", "path").agg(F.max("best").alias("best"), F.count("*").alias("rows"))
    found = found.withColumn("copies", (F.col("rows") / probes_each).cast("int"))
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(
        F.col("id").alias(id_col), F.col("url").alias(url_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def default_rules(spark: SparkSession) -> DataFrame:
    return spark.sql("select * from values " + ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in DEFAULT_RULES) + " as rules(host, path, verdict)")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judge_urls(pages, default_rules(spark)).select("page_id", "host", "path", "rule", "verdict")


def _oracle() -> str:
    rules = " union all ".join(f"select '{h}' h, '{p}' p, '{v}' v" for h, p, v in DEFAULT_RULES)
    return f"""
with cut as (select row_number() over () n, page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') path from pages),
rules as ({rules}),
best as (select n, arg_max(h || p, length(h || p)) rule, arg_max(v, length(h || p)) verdict from cut join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by n)
select page_id, host, path, rule, coalesce(verdict, 'allow') verdict from cut left join best using (n)"""


QUERIES = {"op2_url_filters": op2_url_filters}
ORACLES = {"op2_url_filters": _oracle()}
