"""Filtering urls by rules for hosts and paths: a range join by sorted sweeps over canonical keys."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barwatch.llm.common import table
from barwatch.session import materialize

# The query's rules: host, path, verdict.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

_UPTO = (Window.unboundedPreceding, 0)
_BEFORE = (Window.unboundedPreceding, -1)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host with A-Z lower-cased, and the path; both empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.char_length(url)))
    rest = F.coalesce(rest, F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """The labels from the last to the first, a dot after each: a host's subdomains are the keys that begin with its own."""
    return F.concat(F.concat_ws(".", F.reverse(F.split(host, r"\."))), F.lit(".")).cast("binary")


def _swept(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` range-sorted over as many tasks as it takes and written: ``at`` rises along the order, ``run`` names the task."""
    ordered = rows.orderBy(*order).withColumn("at", F.monotonically_increasing_id())
    return materialize(ordered, name).withColumn("run", F.shiftright("at", 33))


def _carried(rows: DataFrame, value: Column, found: Column, group: list[str]) -> DataFrame:
    """Adds ``state``, the last ``value`` (a struct) up to each row where ``found``, within its group.

    Every run is one window; what it takes over from the runs before it comes
    from a table of one row a group and run.
    """
    marked = rows.withColumn("own", F.when(found, value))
    inside = Window.partitionBy(*group, "run").orderBy("at").rowsBetween(*_UPTO)
    earlier = Window.partitionBy(*group).orderBy("run").rowsBetween(*_BEFORE)
    ends = marked.groupBy(*group, "run").agg(F.max_by("own", F.when(F.col("own").isNotNull(), F.col("at"))).alias("end"))
    ends = ends.select(*group, "run", F.last("end", ignorenulls=True).over(earlier).alias("before"))
    ends = F.broadcast(ends) if not group else ends  # one row for every task of a sort
    swept = marked.withColumn("here", F.last("own", ignorenulls=True).over(inside)).join(ends, [*group, "run"])
    return swept.withColumn("state", F.coalesce("here", "before")).drop("own", "here", "before")


def stacks(intervals: DataFrame) -> DataFrame:
    """Where intervals of keys begin and end: ``key``, and ``stack``, the payloads of those open from there on, outermost first.

    ``intervals`` has distinct binary ``key`` prefixes, each with a ``payload``;
    one covers all keys that begin with its own, so any two are nested or
    apart.  The sweep adds up starts and ends to a depth.  What lies at level j of the
    stack is the latest start that reached depth j.  A byte that no UTF-8 text
    has closes an interval after all keys inside it.
    """
    starts = intervals.select("key", "payload", F.lit(1).alias("step"))
    ends = intervals.select(F.concat("key", F.lit(b"\xff")).alias("key"), "payload", F.lit(-1).alias("step"))
    events = _swept(starts.union(ends), ["key"], "url-events")
    runs = events.groupBy("run").agg(F.sum("step").alias("moved"))
    runs = runs.select("run", F.coalesce(F.sum("moved").over(Window.orderBy("run").rowsBetween(*_BEFORE)), F.lit(0)).alias("moved"))
    inside = Window.partitionBy("run").orderBy("at").rowsBetween(*_UPTO)
    deep = events.join(F.broadcast(runs), "run").withColumn("depth", F.sum("step").over(inside) + F.col("moved"))
    # Every event asks for each level that is open; a start answers for its own.
    levels = F.explode_outer(F.when(F.col("depth") > 0, F.sequence(F.lit(1).cast("long"), "depth")))
    asked = deep.withColumn("level", levels)
    opened = (F.col("step") == 1) & (F.col("level") == F.col("depth"))
    answered = _carried(asked.where("level is not null"), F.struct("payload"), opened, ["level"])
    stack = F.transform(F.sort_array(F.collect_list(F.struct("level", F.col("state.payload").alias("payload")))), lambda x: x["payload"])
    open_ = answered.groupBy("at", "key").agg(stack.alias("stack")).select("key", "stack")
    nothing = F.lit(None).cast(open_.schema["stack"].dataType).alias("stack")
    return materialize(open_.union(asked.where("level is null").select("key", nothing)), "url-stacks")


def with_stack(points: DataFrame, intervals: DataFrame) -> DataFrame:
    """``points`` with ``stack``: the payloads of the intervals that hold each one's binary ``key``, outermost first, or null.

    Points and boundaries are sorted together; equal keys are dealt by a salt,
    so they may fill any number of tasks.  A point takes the stack of the
    last boundary before it.
    """
    columns = [c for c in points.columns if c != "key"]
    edges = stacks(intervals).withColumn("edge", F.lit(0))
    salted = points.withColumns({"edge": F.lit(1), "salt": F.xxhash64("key", *columns)})
    both = salted.unionByName(edges, allowMissingColumns=True)
    swept = _carried(_swept(both, ["key", "edge", "salt"], "url-points"), F.struct("stack"), F.col("edge") == 0, [])
    return swept.where("edge = 1").select("at", "key", *columns, F.col("state.stack").alias("stack"))


def judge_urls(pages: DataFrame, rules: DataFrame, otherwise: str = "allow", hostless: str = "block") -> DataFrame:
    """Per page: ``page_id``, ``host``, ``path``, ``rule`` (host and path, or null) and ``verdict``.

    ``rules`` has ``host``, ``path`` and ``verdict``.  A rule fits its host and
    all subdomains, if the url's path begins with the rule's path; the longest
    rule wins (of equally long ones the one with the longer host).  Without a
    rule the verdict is ``otherwise``, or ``hostless`` where the url has no host.

    With its labels reversed a host turns into a key, and a rule's host into
    the interval of keys of its subdomains.  One sorted sweep over pages and
    the boundaries of these intervals gives each page the stack of nested
    rule hosts around it.  For each of them (as many as the
    host has labels, at most) a second sweep over that host's paths finds the longest
    path that the url begins with.  No page meets a rule that does not fit.

    A null url, or one without ``://``, has no host; equal pages are judged
    each; of rules with one host and path, block goes before allow; a rule with a null
    is none; without rules or pages the result is as stated; other columns are ignored.
    """
    rules = rules.dropna(subset=["host", "path", "verdict"]).select(lower_ascii(F.col("host")).alias("host"), "path", "verdict")
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    rules = rules.select(host_key(F.col("host")).alias("node"), "host", "path", "verdict")
    host, path = host_and_path(F.col("url"))
    located = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("key", host_key(F.col("host")))
    hosts = rules.select(F.col("node").alias("key"), F.col("node").alias("payload")).distinct()
    placed = materialize(with_stack(located, hosts), "url-hosts")

    def node_path(node: str) -> Column:
        return F.concat(F.col(node), F.lit(b"\0"), F.col("path").cast("binary"))

    length = (F.char_length("host") + F.char_length("path")).alias("length")
    of_paths = rules.select(
        node_path("node").alias("key"),
        F.struct(length, F.char_length("host").alias("host_length"), F.concat("host", "path").alias("rule"), "verdict").alias("payload"),
    )
    asked = placed.where("stack is not null").select(F.col("at").alias("page"), "page_id", "host", "path", F.explode("stack").alias("node"))
    found = with_stack(asked.withColumn("key", node_path("node")).drop("node"), of_paths)
    best = found.groupBy("page").agg(
        *[F.first(c).alias(c) for c in ("page_id", "host", "path")], F.max(F.element_at("stack", -1)).alias("best")
    )
    ruled = best.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))
    unruled = placed.where("stack is null").select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    default = F.when(F.col("host") == "", hostless).otherwise(otherwise)
    return ruled.union(unruled).select("page_id", "host", "path", "rule", F.coalesce("verdict", default).alias("verdict"))


def op11_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages"), rules)


OP11_SQL = r"""
WITH rules(host, path, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), rests AS (
  SELECT row_number() OVER () AS r, page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT r, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rests
), best AS (
  SELECT r, arg_max(rules.host || rules.path, len(rules.host || rules.path)) AS rule, arg_max(verdict, len(rules.host || rules.path)) AS verdict
  FROM parts JOIN rules ON (parts.host = rules.host OR ends_with(parts.host, '.' || rules.host)) AND starts_with(parts.path, rules.path)
  GROUP BY r
)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN host = '' THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN best USING (r)
"""
