"""URL rules by a sort-merge range join.

A host is turned into a key of its reversed labels, so that a host rule becomes the interval of all keys that it
begins. Rule starts, rule ends and urls are sorted together; a sweep keeps the stack of the rules that are
open at each place. A second sweep of the same kind, over (rule host, path), finds the longest path.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.sources.shared import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
START, POINT, END = 0, 1, 2
#: Sorts behind every hex digit, so key + AFTER ends the interval of all keys that begin with key.
AFTER = "G"


class UrlRule(NamedTuple):
    verdict: str
    host: str
    path: str


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and for a url without ://."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    pattern = r"^([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(rest, pattern, 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, pattern, 2), F.lit(""))


def host_key(host: Column) -> Column:
    """Reversed labels, each followed by a dot, in hex: a host and its subdomains share the prefix."""
    reversed_labels = F.array_join(F.reverse(F.split(host, r"\.")), ".")
    return F.hex(F.encode(F.concat(reversed_labels, F.lit(".")), "UTF-8"))


def path_key(rule_host: Column, path: Column) -> Column:
    return F.concat(rule_host, F.lit("!"), F.hex(F.encode(path, "UTF-8")))


def sweep(points: DataFrame, rules: DataFrame) -> DataFrame:
    """(key, stack) of the distinct points: the rule keys that begin the point's key, shortest first.

    Both frames have one column key. The sorted events are cut into range partitions; what is open at the start of
    a partition comes from the partitions before it, of which only one row each is looked at.
    """
    event = "pos string, kind int, rule string"
    starts = rules.distinct().select(F.col("key").alias("pos"), F.lit(START).alias("kind"), F.col("key").alias("rule"))
    ends = starts.select(F.concat("pos", F.lit(AFTER)).alias("pos"), F.lit(END).alias("kind"), F.lit(None).cast("string").alias("rule"))
    probes = points.distinct().select(F.col("key").alias("pos"), F.lit(POINT).alias("kind"), F.lit(None).cast("string").alias("rule"))
    events = starts.unionByName(ends).unionByName(probes).to(points.sparkSession.createDataFrame([], event).schema)
    placed = materialize(
        events.repartitionByRange("pos", "kind").withColumn("block", F.spark_partition_id()), "sweep-events"
    )
    step = F.when(F.col("kind") == START, 1).when(F.col("kind") == END, -1).otherwise(0)
    placed = placed.withColumn("step", step)

    # One row per range partition: how many rules it leaves open.
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    opened = placed.groupBy("block").agg(F.sum("step").alias("net"))
    opened = opened.select("block", F.coalesce(F.sum("net").over(earlier), F.lit(0)).alias("open_before"))
    so_far = Window.partitionBy("block").orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, 0)
    deep = materialize(
        placed.join(opened, "block").withColumn("depth", F.col("open_before") + F.sum("step").over(so_far)),
        "sweep-depths",
    )
    deepest = deep.where(F.col("kind") == START).agg(F.max("depth")).first()[0] or 0
    if not deepest:
        return points.distinct().select("key", F.array().cast("array<string>").alias("stack"))

    levels = range(1, deepest + 1)
    at_level = {k: F.when((F.col("kind") == START) & (F.col("depth") == k), F.col("rule")) for k in levels}
    last_of_block = deep.groupBy("block").agg(
        *[F.max_by(at_level[k], F.when(at_level[k].isNotNull(), F.col("pos"))).alias(f"l{k}") for k in levels]
    )
    carried = last_of_block.select("block", *[F.last(f"l{k}", ignorenulls=True).over(earlier).alias(f"c{k}") for k in levels])
    slots = [F.coalesce(F.last(at_level[k], ignorenulls=True).over(so_far), F.col(f"c{k}")) for k in levels]
    return (
        deep.join(carried, "block")
        .select("pos", "kind", F.slice(F.array(*slots), F.lit(1), F.col("depth").cast("int")).alias("stack"))
        .where(F.col("kind") == POINT)
        .select(F.col("pos").alias("key"), "stack")
    )


def filter_urls(df: DataFrame, url: str, rules: Sequence[UrlRule], default: str = "allow") -> DataFrame:
    """The rows with host, path, rule and verdict; those four names are replaced where df has them.

    A rule fits its host and all subdomains where the path begins with the rule's; the longest rule (host and
    path together, then the longer host) wins. rule is null and the verdict is default where none fits. Null and
    malformed urls have an empty host and path, rows are kept as often as they come, an empty table gives
    an empty result. A rule that is listed twice must have one verdict.
    """
    verdicts = {(r.host.translate(str.maketrans(UPPER, LOWER)), r.path): r.verdict for r in rules}
    if len(verdicts) < len(set(rules)):
        raise ValueError("two verdicts for one rule")
    spark = df.sparkSession
    listed = spark.createDataFrame(
        [(h, p, v) for (h, p), v in verdicts.items()], "rule_host string, rule_path string, verdict string"
    ).select("*", host_key(F.col("rule_host")).alias("rule_key"))
    listed = listed.withColumn("key", path_key(F.col("rule_key"), F.col("rule_path")))

    host, path = host_and_path(F.col(url))
    rows = df.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path})
    urls = materialize(rows.select("host", "path").distinct().withColumn("host_key", host_key(F.col("host"))), "urls")

    open_hosts = sweep(urls.select(F.col("host_key").alias("key")), listed.select(F.col("rule_key").alias("key")))
    candidates = urls.join(open_hosts, urls["host_key"] == open_hosts["key"]).select(
        "host", "path", F.explode("stack").alias("rule_key")
    )
    candidates = materialize(candidates.withColumn("key", path_key(F.col("rule_key"), F.col("path"))), "url-candidates")
    open_paths = sweep(candidates.select("key"), listed.select("key"))
    top = F.try_element_at("stack", F.lit(-1))
    fitting = (
        candidates.join(open_paths.where(F.size("stack") > 0).select("key", top.alias("winner")), "key")
        .join(listed.select(F.col("key").alias("winner"), "rule_host", "rule_path", "verdict"), "winner")
        .withColumn("length", F.length("rule_host") + F.length("rule_path"))
        .groupBy("host", "path")
        .agg(F.max_by(F.struct("rule_host", "rule_path", "verdict"), F.struct("length", F.length("rule_host"), "rule_host")).alias("best"))
        .select(
            "host",
            "path",
            F.concat("best.rule_host", "best.rule_path").alias("rule"),
            F.col("best.verdict").alias("verdict"),
        )
    )
    return rows.join(fitting, ["host", "path"], "left").select(
        *[rows[c] for c in rows.columns], "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")
    )
