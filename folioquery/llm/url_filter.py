"""Rule lists over URLs: host suffixes and path prefixes by hash prefix, then full digests.

A rule is a verdict, a host and the start of a path. It fits its host and every
subdomain where the URL's path starts with the rule's. Of the rules that fit, the
longest (host and path together) wins, then the one with the longer host; of
rules with the same host and path block wins. A URL that no rule fits gets
``default``.

Defined results: the host is what stands after the first ``://`` up to ``/``,
``?``, ``#`` or the end, with A-Z lowered, ports and user names included; the path
goes on to ``?``, ``#`` or the end. A null URL, or one without ``://``, has empty
host and path. Rules without a host fit nothing; a null path starts every path.
Repeated rows are answered one by one; an empty table or list is no special case.
Only the columns named are read, so that others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquery.llm._spark import cut, spread_join

#: Rules and characters up to which a list is broadcast; a larger one is joined by key.
BROADCAST_RULES, BROADCAST_CHARS = 200_000, 16_000_000
#: Hexadecimal digits of a digest that rules and URLs meet on.
SHORT = 8


def lowered(text) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url) -> Column:
    return lowered(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1))


def path_of(url) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def rule_list(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """(verdict, host, path) as the table that ``filter_urls`` takes."""
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def _labels(host) -> Column:
    return F.size(F.split(host, r"\."))


def _digests(rules: DataFrame) -> DataFrame:
    """One row a rule: its shape, the written rule, verdict, digest and the digest's first digits."""
    named = rules.select(lowered(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").filter("host <> ''")
    one = named.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    digest = F.sha2(F.concat("host", "path"), 256)
    return one.select(
        F.struct(_labels(F.col("host")).alias("labels"), F.length("path").alias("chars")).alias("shape"),
        F.struct(F.length(F.concat("host", "path")).alias("size"), F.length("host").alias("of_host"), F.concat("host", "path").alias("rule"), "verdict").alias("found"),
        digest.alias("known"), F.substring(digest, 1, SHORT).alias("short"),
    )


def _expressions(host, path, shapes: Sequence) -> Column:
    """Digests of the host suffixes and path prefixes that have the shape of some rule."""
    listed = F.array(*[F.struct(F.lit(s["labels"]).alias("labels"), F.lit(s["chars"]).alias("chars")) for s in shapes])
    fit = F.filter(listed, lambda s: (s["labels"] <= _labels(host)) & (s["chars"] <= F.length(path)))
    return F.transform(fit, lambda s: F.sha2(F.concat(F.call_function("substring_index", host, F.lit("."), -s["labels"]), F.substring(path, F.lit(1), s["chars"])), 256))


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", keep: Sequence[str] = ("page_id",), default: str = "allow", broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """``keep``, host, path, rule (null if none fits) and verdict of every row.

    Only shapes (number of host labels, length of path) that some rule has are
    expanded; these pairs, bounded by DNS's 127 labels and the longest path, are all that
    reaches the driver. Rows are told apart by their columns and the task that reads
    them, so that repeated rows are counted before the one shuffle, and stay spread.
    Rules beyond the bounds of a broadcast meet salted expressions by key; the salt is
    the task, so the rows are written to the shared folder first.
    """
    known = _digests(rules)
    shapes = [r["shape"] for r in known.select("shape").distinct().collect()]
    rows = pages.select(F.struct(*[pages[c] for c in keep]).alias("row"), host_of(pages[url]).alias("host"), path_of(pages[url]).alias("path"))
    if not shapes:
        return rows.select("row.*", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    rows = rows.withColumn("task", F.spark_partition_id())
    table = known.drop("shape")
    bound = table.agg(F.count("*").alias("n"), F.sum("found.size").alias("chars")).first()
    small = bound["n"] <= broadcast_rules and bound["chars"] <= BROADCAST_CHARS
    asked = (rows if small else cut(rows)).select("*", F.posexplode_outer(_expressions(F.col("host"), F.col("path"), shapes)).alias("place", "digest"))
    asked = asked.withColumn("short", F.substring("digest", 1, SHORT))
    met = asked.join(F.broadcast(table), "short", "left") if small else spread_join(asked, table, "short", "task", "left")
    found = F.max(F.when(F.col("digest") == F.col("known"), F.col("found"))).alias("found")
    copies = F.sum(F.when(F.coalesce("place", F.lit(0)) == 0, 1).otherwise(0)).cast("int")
    judged = met.groupBy("task", "row", "host", "path").agg(found, copies.alias("copies"))
    out = judged.select("row", "host", "path", "found", F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("copy"))
    return out.select("row.*", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", F.lit(default)).alias("verdict"))
