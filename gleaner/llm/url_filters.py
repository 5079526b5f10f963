"""URL filters as a sort-merge range join of canonical keys with prefix rules.

A host's canonical key is its labels in reverse order, each followed by a dot (`www.example.org` ->
`org.example.www.`).  A rule on a host fits the host and its subdomains, which is the key interval from the rule's
key (with the dot) up to the same key with `/`, the next character, in place of the dot.  Such intervals nest or are
disjoint, so one sweep in key order needs only a stack of the rules that are open: since a rule's ancestors never
change, each rule carries its stack, and the sweep carries the stack of the last rule opened; rules in it whose
interval has ended are popped by comparing their end with the key.  Of the open rules, those whose path starts the
url's path fit, and the longest wins.

The sweep runs in parallel: urls are range-partitioned by (key, id), so a host that holds a third of all urls spans
many partitions, and each rule goes into every partition its interval overlaps.  Only DataFrame functions are used.

Defined results: null urls and urls without `://` have empty host and path and get the default verdict, as do urls
that no rule fits; of rules equally long the one with the longer host, then the smaller string wins; repeated rows
are each returned; a null id is returned as null; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .carry import pick
from .store import saved

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url):
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url):
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def canonical(host):
    """Labels in reverse, a dot after each; empty for an empty host."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def rule_stacks(rules: DataFrame) -> DataFrame:
    """rules (verdict, host, path) -> one row per rule key: start, end and the stack of rules open from its start on."""
    keyed = rules.select("verdict", "host", "path", canonical(F.col("host")).alias("start")).distinct()
    own = keyed.groupBy("start").agg(F.collect_set(F.struct("host", "path", "verdict")).alias("own"))
    # A key's ancestors are its own prefixes that end in a dot: as many as it has labels, so an equi-join finds them.
    labels = F.split(F.expr("substring(start, 1, length(start) - 1)"), r"\.")
    up = own.select("start", F.posexplode(labels).alias("depth", "label")).select("start", "depth", F.concat(F.array_join(F.slice(labels, 1, F.col("depth") + 1), "."), F.lit(".")).alias("ancestor"))
    open_ = up.join(own.select(F.col("start").alias("ancestor"), "own"), "ancestor")
    end = F.concat(F.expr("substring(ancestor, 1, length(ancestor) - 1)"), F.lit("/"))
    return open_.groupBy("start").agg(F.sort_array(F.collect_list(F.struct("depth", end.alias("end"), "own"))).alias("stack")).withColumn("end", F.concat(F.expr("substring(start, 1, length(start) - 1)"), F.lit("/")))


def filter_urls(df: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """(key, host, path, rule, verdict) for every row of df; rules: (verdict, host, path), path with its slash."""
    urls = pick(df, id=key, url=url).select("id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn("at", canonical(F.col("host")))
    swept = saved(urls.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange("at", "id", "tie").withColumn("part", F.spark_partition_id()), "urls")
    # One row per partition: as many as the shuffle has partitions, whatever the number of urls.
    parts = swept.groupBy("part").agg(F.min("at").alias("least"), F.max("at").alias("most"))
    opened = rule_stacks(rules).join(F.broadcast(parts), F.expr("start <= most AND end > least"))
    events = swept.select("part", "at", F.lit(1).alias("turn"), "tie", "id", "host", "path", F.lit(None).cast(opened.schema["stack"].dataType).alias("stack")).unionByName(
        opened.select("part", F.col("start").alias("at"), F.lit(0).alias("turn"), "stack"), allowMissingColumns=True
    )
    sweep = Window.partitionBy("part").orderBy("at", "turn", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = events.withColumn("stack", F.last("stack", ignorenulls=True).over(sweep)).where("turn = 1")
    fits = F.expr(
        "filter(flatten(transform(filter(coalesce(stack, array()), s -> s.end > at AND startswith(at, concat(substring(s.end, 1, length(s.end) - 1), '.'))), s -> s.own)), r -> startswith(path, r.path))"
    )
    ranked = F.expr("transform(fits, r -> struct(length(r.host) + length(r.path) AS size, length(r.host) AS hosts, concat(r.host, r.path) AS rule, r.verdict AS verdict))")
    best = F.expr("reduce(ranked, cast(null AS struct<size:int,hosts:int,rule:string,verdict:string>), (a, b) -> CASE WHEN a IS NULL OR b.size > a.size OR (b.size = a.size AND (b.hosts > a.hosts OR (b.hosts = a.hosts AND b.rule < a.rule))) THEN b ELSE a END)")
    return seen.withColumn("fits", fits).withColumn("ranked", ranked).withColumn("best", best).select(F.col("id").alias(key), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def rules_table(spark, rules=RULES) -> DataFrame:
    """Rules written as (verdict, 'host/path')."""
    quoted = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    values = ", ".join(f"({quoted(verdict)}, {quoted(rule.split('/', 1)[0])}, {quoted('/' + rule.split('/', 1)[1])})" for verdict, rule in rules)
    return spark.sql(f"SELECT * FROM VALUES {values} AS rules(verdict, host, path)")


SQL = rf"""
WITH u AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '{_URL}', 1), '{_UPPER}', '{_LOWER}'), '') AS host,
         coalesce(regexp_extract(url, '{_URL}', 2), '') AS path
  FROM pages),
rules(verdict, host, path) AS (VALUES {", ".join(f"('{v}', '{r.split('/', 1)[0]}', '/{r.split('/', 1)[1]}')" for v, r in RULES)}),
fit AS (
  SELECT u.page_id, r.host || r.path AS rule, r.verdict,
         row_number() OVER (PARTITION BY u.page_id ORDER BY length(r.host || r.path) DESC, length(r.host) DESC, r.host || r.path) AS rank
  FROM u JOIN rules r ON (u.host = r.host OR u.host LIKE '%.' || r.host) AND starts_with(u.path, r.path))
SELECT u.page_id, u.host, u.path, fit.rule, coalesce(fit.verdict, 'allow') AS verdict
FROM u LEFT JOIN fit ON fit.page_id = u.page_id AND fit.rank = 1
"""
