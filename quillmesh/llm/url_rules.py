"""URL filters: a sort-merge range join of hosts with nested host rules, in DataFrame functions only.

A host is keyed by its labels in reverse order with a full stop after each (``www.example.net`` is
``net.example.www.``), so a rule's host and all its subdomains are one interval of keys: from the rule's key up to the
same key with its last full stop replaced by ``/``, the next byte. Such intervals nest or are disjoint. A sweep in key
order keeps the stack of active rule hosts: a window holds, for each number of labels, the last rule host begun, which is
active while the key is below its end. Only distinct hosts are swept, in buckets of the two top labels that are salted
where they hold many hosts, so a host with a third of the pages is one row of the sweep.

Paths are swept likewise under each rule host on the stack, in the order of paths: all paths that a rule's path begins
are one interval, and these nest. Here the stack travels with the rules: each has those of its host whose path begins its
own, at most one for each of its characters, and the last rule begun has on its stack all that can fit a page. Only distinct
pairs of host and path are swept; the sweep of a rule host is salted by how many pages it has for each of its rules, so
the copies of rules that salts need are no more than the pages. Pages meet the result by an equi-join that AQE splits where
it is skewed. No array holds a host's rules.

Defined cases: a null url or one without ``://`` has empty host and path and gets the default verdict. Hosts are
compared as written apart from A-Z, ports and trailing full stops included. The longest rule text (host and path) wins,
then the longer host, then the greater text, then the verdict ``block`` before ``allow``. Rules with a null or empty host fit
nothing; a null path counts as empty; repeated rules count once. Repeated pages stay repeated; columns of pages other than
the id and url are not read.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
DEFAULT_VERDICT = "allow"
HOSTS_PER_SALT = 2000


def rules_frame(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """A rules DataFrame (host, path, verdict) from literals, without Python on the executors."""
    rows = [F.struct(F.lit(h).cast("string").alias("host"), F.lit(p).cast("string").alias("path"), F.lit(v).cast("string").alias("verdict")) for h, p, v in rules]
    if not rows:
        return spark.range(0).select(*(F.lit("").alias(c) for c in ("host", "path", "verdict")))
    return spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def lower_ascii(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def split_urls(pages: DataFrame, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """(id, host, path) of each page."""
    at = F.instr(F.col("u"), "://")
    cut = pages.select(F.col(id_column).alias("id"), F.col(url_column).alias("u")).select("id", F.when(at > 0, F.col("u").substr(at + 3, F.length("u"))).otherwise("").alias("rest"))
    cut = cut.select("id", F.coalesce("rest", F.lit("")).alias("rest"))
    host = F.regexp_extract("rest", r"^[^/?#]*", 0)
    return cut.select("id", lower_ascii(host).alias("host"), F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1).alias("path"))


def reversed_labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\.", -1))


def _key(host: Column) -> Column:
    return F.concat(F.array_join(reversed_labels(host), "."), F.lit("."))


def _bucket(host: Column) -> Column:
    return F.array_join(F.slice(reversed_labels(host), 1, 2), ".")


def active_hosts(hosts: DataFrame, rule_hosts: DataFrame) -> DataFrame:
    """(host, h) for distinct hosts and every rule host (column h) that covers them."""
    grouped = rule_hosts.select(_key(F.col("h")).alias("key"), F.size(F.split("h", r"\.", -1)).alias("depth"), _bucket(F.col("h")).alias("bucket"), F.element_at(reversed_labels(F.col("h")), 1).alias("top"), "h")
    depth = grouped.agg(F.max("depth")).first()[0] or 0
    keyed = hosts.select("host", _key(F.col("host")).alias("key"), _bucket(F.col("host")).alias("bucket"))
    salts = keyed.groupBy("bucket").agg(F.ceil(F.count("*") / HOSTS_PER_SALT).cast("int").alias("salts")).select("bucket", "salts", F.split("bucket", r"\.", -1)[0].alias("top"))
    # Rules of one label begin every bucket under that label; deeper ones belong to the bucket of their two top labels.
    begun = grouped.where("depth > 1").join(salts.drop("top"), "bucket").unionByName(grouped.where("depth = 1").drop("bucket").join(salts, "top").select("bucket", "key", "depth", "top", "h", "salts"))
    begun = begun.select("bucket", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "key", "depth", "h", F.lit(None).cast("string").alias("host"))
    swept = keyed.join(salts.select("bucket", "salts"), "bucket").select("bucket", F.pmod(F.xxhash64("host"), F.col("salts")).cast("int").alias("salt"), "key", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("h"), "host")
    order = Window.partitionBy("bucket", "salt").orderBy("key", F.col("host").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    events = begun.unionByName(swept)
    if not depth:
        return hosts.select("host", F.lit("").alias("h")).where("false")
    slots = [F.last(F.when(F.col("depth") == level, F.struct("key", "h")), ignorenulls=True).over(order).alias(f"slot{level}") for level in range(1, depth + 1)]
    stacked = events.select("host", "key", *slots).where("host is not null")
    active = [F.when(F.expr(f"key < concat(substr(slot{level}.key, 1, length(slot{level}.key) - 1), '/')"), F.col(f"slot{level}.h")) for level in range(1, depth + 1)]
    return stacked.select("host", F.explode(F.filter(F.array(*active), lambda x: x.isNotNull())).alias("h"))


def nested_rules(rules: DataFrame) -> DataFrame:
    """(h, path, stack) of distinct rules; stack: the host's rules (path, r) whose path begins this one's, itself included."""
    rule = rules.select(lower_ascii(F.col("host")).alias("h"), F.coalesce("path", F.lit("")).alias("path"), "verdict").where("h <> ''")
    best = F.max(F.struct(F.length(F.concat("h", "path")).alias("size"), F.length("h").alias("host_size"), F.concat("h", "path").alias("rule"), "verdict"))
    rule = rule.groupBy("h", "path").agg(best.alias("r"))
    begins = rule.select("h", "path", F.explode(F.transform(F.sequence(F.lit(0), F.length("path")), lambda n: F.left("path", n))).alias("begin"))
    held = begins.join(rule.select("h", F.col("path").alias("begin"), "r"), ["h", "begin"])
    return held.groupBy("h", "path").agg(F.collect_list(F.struct(F.col("begin").alias("path"), "r")).alias("stack"))


def fitting_rules(pairs: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, best) of distinct pairs (host, path) that a rule fits; best: its size, host_size, rule and verdict."""
    nested = nested_rules(rules)
    counted = nested.groupBy("h").agg(F.count("*").alias("rules"))
    wanted = pairs.join(active_hosts(pairs.select("host").distinct(), counted.select("h")), "host")
    salts = wanted.groupBy("h").agg(F.count("*").alias("n")).join(counted, "h").select("h", F.ceil(F.col("n") / F.greatest(F.lit(HOSTS_PER_SALT), F.col("rules"))).cast("int").alias("salts"))
    begun = nested.join(salts, "h").select("h", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "path", "stack", F.lit(None).cast("string").alias("host"))
    swept = wanted.join(salts, "h").select("h", F.pmod(F.xxhash64("path", "host"), F.col("salts")).cast("int").alias("salt"), "path", F.lit(None).cast(nested.schema["stack"].dataType).alias("stack"), "host")
    order = Window.partitionBy("h", "salt").orderBy("path", F.col("host").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    held = begun.unionByName(swept).select("host", "path", F.last("stack", ignorenulls=True).over(order).alias("stack")).where("host IS NOT NULL")
    fit = F.array_max(F.transform(F.filter("stack", lambda x: F.startswith(F.col("path"), x["path"])), lambda x: x["r"]))
    return held.select("host", "path", fit.alias("best")).where("best IS NOT NULL").groupBy("host", "path").agg(F.max("best").alias("best"))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT_VERDICT, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every page."""
    parsed = split_urls(pages, id_column, url_column)
    judged = parsed.join(fitting_rules(parsed.select("host", "path").distinct(), rules), ["host", "path"], "left")
    return judged.select(F.col("id").alias(id_column), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


ORACLE_SQL = """
WITH cut AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), parsed AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), named AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM parsed
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM named
"""
