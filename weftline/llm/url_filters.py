"""Operator 1: URL filters as a sort-merge range join, with DataFrame functions only.

A host becomes its labels in reverse, each followed by a dot: example.com is com.example. and all its subdomains share
that prefix, so a rule's host is an interval of the sorted keys. Points and interval starts are sorted together and
swept: prefix intervals nest, so the active rules at a point are among the last start before it and its ancestors,
the stack that each start carries. Two sweeps decide a url: over hosts, giving the rule hosts above it (127 labels at
most), and for each of those over paths, giving the longest fitting path.

Distribution: a sweep works in buckets that no interval leaves (the last two labels; the rule host). Buckets with more
than their share of the points are dealt over salts, to each of which the bucket's rules are copied. The list of such
buckets is broadcast: each holds more than 1 / (4 * shuffle partitions) of all points, so there are fewer than
4 * shuffle partitions of them.

Defined cases: a null url, or one without ://, has an empty host and path and gets the default verdict. Ports and user
names stay part of the host. Rules with a null or empty host or a null path are ignored; of equal rules the verdict
that is first in the alphabet holds (allow). Of fitting rules the one of the longest rule string wins, then the longer
host. Repeated rows are judged each; extra columns of the input are not returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import ascii_lower, partitions


def host_of(url: Column) -> Column:
    """From behind the first :// up to / ? # or the end, with A-Z lower-cased; empty if there is none."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """From behind the host up to ? or # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def reversed_key(host: Column) -> Column:
    """com.example. for example.com."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def bucket_of(key: Column) -> Column:
    """The last two labels of a reversed key, or its only one."""
    return F.regexp_extract(key, r"^[^.]*\.(?:[^.]*\.)?", 0)


def _sweep(points: DataFrame, starts: DataFrame, total: int) -> DataFrame:
    """points (bucket, key, id, *) with the stack of the last start at or before key within the bucket; starts (bucket, key, stack)."""
    parts = partitions(points.sparkSession)
    share = max(1, total // (4 * parts))
    heavy = points.groupBy("bucket").count().filter(F.col("count") > share).select("bucket", F.ceil(F.col("count") / share).cast("int").alias("salts"))
    dealt = points.join(F.broadcast(heavy), "bucket", "left").withColumn("salt", F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("id", "key"), F.col("salts")).cast("int"))).drop("salts")
    copied = starts.join(F.broadcast(heavy), "bucket", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    both = dealt.withColumn("stack", F.lit(None).cast(starts.schema["stack"].dataType)).withColumn("point", F.lit(1)).unionByName(copied.withColumn("point", F.lit(0)), allowMissingColumns=True)
    order = Window.partitionBy("bucket", "salt").orderBy("key", "point").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("stack", F.last("stack", ignorenulls=True).over(order)).filter("point = 1").drop("point", "salt")


def _nested(rules: DataFrame, group: list[str], key: str) -> DataFrame:
    """group, key and stack: the keys of the same group that are prefixes of key, itself included, shortest first."""
    own = rules.select(*group, key).distinct()
    lengths = own.groupBy(*group).agg(F.collect_set(F.length(key)).alias("lengths"))
    ups = own.join(lengths, group).select(*group, key, F.explode(F.filter("lengths", lambda n: n <= F.length(key))).alias("n"))
    ups = ups.withColumn("above", F.expr(f"substring({key}, 1, n)"))
    found = ups.join(own.select(*group, F.col(key).alias("above")), [*group, "above"], "left_semi")
    return found.groupBy(*group, key).agg(F.array_sort(F.collect_list("above")).alias("stack"))


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """(key, host, path, rule, verdict) for each page; rules are (host, path, verdict)."""
    urls = pages.select(F.col(key).alias("page"), F.col(url).alias("url")).select("page", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    urls = urls.withColumn("key", reversed_key(F.col("host"))).withColumn("bucket", bucket_of(F.col("key"))).withColumn("id", F.xxhash64("page", "host", "path"))
    clean = (
        rules.select(ascii_lower(F.col("host")).alias("host"), F.col("path").alias("path"), F.col("verdict").alias("verdict"))
        .filter("host <> '' and path is not null and verdict is not null").groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
        .withColumn("key", reversed_key(F.col("host")))
    )
    total = urls.count()
    hosts = clean.select("key").distinct().withColumn("top", F.regexp_extract("key", r"^[^.]*\.", 0))
    stacks = _nested(hosts, ["top"], "key").withColumn("bucket", bucket_of(F.col("key")))
    # A rule for a top domain alone opens each bucket below it; the other stacks already hold it.
    short = stacks.filter("key = top").select("top", "key", "stack")
    below = urls.select("bucket").distinct().withColumn("top", F.regexp_extract("bucket", r"^[^.]*\.", 0)).filter("bucket <> top")
    starts = stacks.select("bucket", "key", "stack").unionByName(below.join(short, "top").select("bucket", "key", "stack"))
    placed = _sweep(urls, starts, total).withColumn("above", F.filter("stack", lambda h: F.startswith(F.col("key"), h))).drop("stack")

    # The second sweep: paths below each rule host that stands above the url.
    paths = _nested(clean.withColumnRenamed("key", "rule_key"), ["rule_key"], "path").select(F.col("rule_key").alias("bucket"), F.col("path").alias("key"), "stack")
    asked = placed.filter(F.size("above") > 0).select("page", "host", "path", "id", F.explode("above").alias("bucket")).withColumn("key", F.col("path"))
    swept = _sweep(asked, paths, total * 2).withColumn("rule_path", F.array_max(F.filter("stack", lambda p: F.startswith(F.col("path"), p))))
    fits = swept.filter(F.col("rule_path").isNotNull()).select("page", "host", "path", F.col("bucket").alias("rule_key"), "rule_path")
    best = F.max_by(F.struct("rule_key", "rule_path"), F.struct(F.length("rule_key") + F.length("rule_path"), F.length("rule_key")))
    won = fits.groupBy("page", "host", "path").agg(best.alias("won")).select("page", "host", "path", "won.*")
    verdicts = clean.select(F.col("key").alias("rule_key"), F.col("path").alias("rule_path"), F.concat("host", "path").alias("rule"), "verdict")
    return _with_verdicts(urls, won, verdicts, key, default)


def _with_verdicts(urls: DataFrame, won: DataFrame, verdicts: DataFrame, key: str, default: str) -> DataFrame:
    """Each url with its winning rule; page, host and path decide together, so repeated rows agree."""
    named = won.select(F.col("page").alias("w_page"), F.col("host").alias("w_host"), F.col("path").alias("w_path"), "rule_key", "rule_path")
    same = F.col("page").eqNullSafe(F.col("w_page")) & (F.col("host") == F.col("w_host")) & (F.col("path") == F.col("w_path"))
    out = urls.select("page", "host", "path").join(named, same, "left").join(verdicts, ["rule_key", "rule_path"], "left")
    return out.select(F.col("page").alias(key), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
