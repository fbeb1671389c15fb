"""URL filters as a sort-merge range join.

The labels of a host are reversed and the path follows, so a rule is a prefix of the keys of the urls that it
fits, an interval in their order. A url has one key for each of its host's endings, as a rule fits subdomains too.
Rules open and close at their interval's ends. Ends and keys are range-partitioned and sorted together; a sweep
carries the top of the stack of open rules along: an opening rule is put on top, a closing one uncovers the
rule that it is nested in. A block of the range starts with the top that the blocks before it left. Keys are
split by a hash of the url, so one host may fill many blocks. Only DataFrame functions are used.

Defined results: a url that is null or lacks `://` has an empty host and path and gets the default verdict; an
empty table of rules leaves the default for all; repeated rows are judged each; rules with a null in host, path
or action count as absent, of equal rules a blocking one wins; of rules of one length the longer host wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contestframe.llm.texts import LOWER, UPPER, on_key, written

#: The rules of the registered query: host, path, action.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def rules_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, action string")


def host_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path of a url; both empty without `://`."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _reversed(host: Column) -> Column:
    return F.reverse(F.split(host, "\\."))


def _key(labels: Column, path: Column) -> Column:
    """Canonical key as bytes: reversed labels, `?` (which no host holds), path."""
    return F.concat(F.array_join(labels, "."), F.lit("?"), path).cast("binary")


def _boundaries(rules: DataFrame) -> DataFrame:
    """Where rules open and close: key and the rule that is on top of the stack from there on."""
    known = (
        rules.dropna(subset=["host", "path", "action"])
        .groupBy(F.translate("host", UPPER, LOWER).alias("host"), "path")
        .agg(F.when(F.max((F.col("action") == "block").cast("int")) == 1, "block").otherwise("allow").alias("action"))
        .withColumn("rule", F.concat("host", "path"))
    )
    top = F.struct(F.length("rule").alias("size"), F.length("host").alias("host_size"), "rule", "action")
    known = known.select("host", "path", top.alias("top"))
    nested = known.select("host", "path", F.explode(F.expr("transform(sequence(0, length(path)), n -> substring(path, 1, n))")).alias("outer_path"))
    outer = known.select(F.col("host").alias("outer_host"), F.col("path").alias("outer_path"), F.col("top").alias("outer_top"))
    parents = (
        nested.where(F.col("outer_path") != F.col("path"))
        .join(outer, (F.col("host") == F.col("outer_host")) & (nested["outer_path"] == outer["outer_path"]))
        .groupBy("host", "path").agg(F.max("outer_top").alias("under"))
    )
    key = _key(_reversed(F.col("host")), F.col("path"))
    none = F.struct(F.lit(0).alias("size"), F.lit(0).alias("host_size"), F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("action"))
    both = known.join(parents, ["host", "path"], "left")
    return both.select(key.alias("key"), "top").unionByName(
        both.select(F.concat(key, F.lit(bytearray(b"\xff"))).alias("key"), F.coalesce("under", none).alias("top")))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """The rows with host, path, rule (null if none fits) and verdict; columns of these names are replaced."""
    most = rules.agg(F.max(F.size(F.split("host", "\\.")))).first()[0] or 1
    urls = pages.select(F.col(url).alias("_url")).distinct().where(F.contains("_url", F.lit("://")))
    host, path = host_path(F.col("_url"))
    ends = F.transform(F.sequence(F.lit(1), F.least(F.size("labels"), F.lit(most))), lambda n: _key(F.slice("labels", 1, n), F.col("path")))
    keys = urls.select("_url", _reversed(host).alias("labels"), path.alias("path")).select("_url", F.explode(ends).alias("key"))
    bounds = _boundaries(rules)
    empty = F.lit(None).cast(bounds.schema["top"].dataType)
    events = keys.select("key", F.lit(1).alias("kind"), "_url", empty.alias("top")).unionByName(
        bounds.select("key", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("_url"), "top"))
    ranged = events.withColumn("tie", F.xxhash64("_url")).repartitionByRange("key", "kind", "tie")
    blocks = written(ranged.withColumn("block", F.spark_partition_id()))
    left = blocks.groupBy("block").agg(F.max_by("top", F.when(F.col("kind") == 0, F.col("key"))).alias("last"))
    # one row for each block of the range
    carried = left.select("block", F.last("last", True).over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("carry"))
    sweep = Window.partitionBy("block").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = blocks.withColumn("now", F.last("top", True).over(sweep)).where("kind = 1").join(carried, "block", "left")
    best = (
        swept.select("_url", F.coalesce("now", "carry").alias("fit")).where("fit.rule is not null")
        .groupBy("_url").agg(F.max("fit").alias("_fit"))
    )
    known = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    packed = pages.select(F.struct(*[F.col(f"`{c}`") for c in known]).alias("_row"), F.col(url).alias("_url"))
    host, path = host_path(F.col("_url"))
    return on_key(packed, best, cols=("_url",)).select(
        *[F.col("_row")[c].alias(c) for c in known], host.alias("host"), path.alias("path"), F.col("_fit.rule").alias("rule"),
        F.coalesce(F.col("_fit.action"), F.lit(default)).alias("verdict"))
