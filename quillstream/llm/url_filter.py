"""Temporal URL filter: dated list entries joined to captures as of their fetch time.

A list is a table of dated changes (list_name, key, changed_on, action). Changes of one key become
disjoint validity intervals [valid_from, valid_to); a capture is judged by the intervals that hold
its fetch day. Keys are a host or a parent domain (``example.org`` covers ``a.example.org``).

Defined results: a null or unparsable url has no host and is allowed; a null fetch day is allowed;
repeated changes count once; of changes of one key, list and day ``remove`` wins over ``add``; a second
``add`` keeps the interval open; captures are returned once per input row, so repeated pages repeat. A column of the
captures that has the name of an added one (``host``, ``n_lists``, ``lists``, ``allowed``, behind ``prefix``) gives way to it;
all others stay, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstream.llm import shared

#: Dated changes of the built-in lists (list, domain, day, action).
LIST_CHANGES = [
    ("spam", "spam-farm.example.org", "2024-01-15", "add"),
    ("spam", "spam-farm.example.org", "2024-04-01", "remove"),
    ("spam", "spam-farm.example.org", "2024-06-01", "add"),
    ("pharma", "cheap-pills.example.com", "2024-02-01", "add"),
    ("pharma", "cheap-pills.example.com", "2024-10-01", "remove"),
    ("mirror", "example.net", "2024-08-01", "add"),
    ("mirror", "example.net", "2024-08-15", "remove"),
]
EPOCH, DAYS = "2024-01-01", 366


def list_changes(spark: SparkSession, rows: list[tuple[str, str, str, str]] = LIST_CHANGES) -> DataFrame:
    """The changes as a DataFrame of literals, built without Python workers."""
    quoted = [", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in row) for row in rows]
    if not quoted:
        return spark.sql("SELECT '' list_name, '' key, DATE'2000-01-01' changed_on, '' action WHERE false")
    return spark.sql(f"SELECT list_name, key, CAST(changed_on AS DATE) changed_on, action FROM VALUES {', '.join(f'({q})' for q in quoted)} AS t(list_name, key, changed_on, action)")


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    """Dated changes from CSV files with a header line: list_name, key, changed_on (ISO day), action."""
    return spark.read.csv(path, header=True, schema="list_name string, key string, changed_on date, action string")


def validity_intervals(changes: DataFrame) -> DataFrame:
    """(list_name, key, valid_from, valid_to): one interval per ``add``, closed by the next change of that key."""
    daily = changes.where("list_name IS NOT NULL AND key IS NOT NULL AND changed_on IS NOT NULL AND action IN ('add', 'remove')").groupBy(
        "list_name", F.lower("key").alias("key"), "changed_on"
    ).agg(F.max("action").alias("action"))  # 'remove' sorts after 'add'
    order = Window.partitionBy("list_name", "key").orderBy("changed_on")
    return (
        daily.withColumn("valid_to", F.lead("changed_on").over(order))
        .where("action = 'add'")
        .select("list_name", "key", F.col("changed_on").alias("valid_from"), F.coalesce("valid_to", F.lit("9999-12-31").cast("date")).alias("valid_to"))
    )


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and trailing dot; null if there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#@:]+)", 1)
    host = F.regexp_replace(host, r"\.+\z", "")
    return F.when(host != "", host)


def domain_keys(host: Column, least: Column) -> Column:
    """The host and its parent domains of at least ``least`` labels."""
    labels = F.split(host, r"\.")
    last = F.size(labels) - least + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).otherwise(F.array().cast("array<string>"))


def filter_captures(captures: DataFrame, changes: DataFrame, url_col: str = "url", day_col: str = "fetched_on", prefix: str = "") -> DataFrame:
    """captures with host, n_lists, lists (sorted, comma-joined) and allowed.

    Hosts are reduced to their distinct (host, day) pairs before any join, so a host with a third of
    the rows costs one row per day. Only parent domains as long as the shortest listed key are looked up, so that a bare
    suffix such as ``com`` is no key unless it is listed. What is joined back to the captures is keyed on host and day, and
    Spark splits what skew remains.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in captures.columns]) if captures.columns else F.struct(F.lit(None).alias("none"))
    hosted = captures.select(row.alias("_row"), host_of(F.col(f"`{url_col}`")).alias("_host"), F.col(f"`{day_col}`").alias("_day"))
    spans = validity_intervals(changes)
    least = spans.agg(F.coalesce(F.min(F.size(F.split("key", r"\."))), F.lit(1)).alias("least"))  # one row
    wanted = hosted.where("_host IS NOT NULL AND _day IS NOT NULL").select("_host", "_day").distinct().withColumn("_least", least.scalar())
    keyed = wanted.select("_host", "_day", F.explode(domain_keys(F.col("_host"), F.col("_least"))).alias("key"))
    held = keyed.join(spans, (keyed.key == spans.key) & (keyed["_day"] >= spans.valid_from) & (keyed["_day"] < spans.valid_to))
    verdict = held.groupBy("_host", "_day").agg(F.array_sort(F.collect_set("list_name")).alias("_found"))
    joined = hosted.join(verdict, ["_host", "_day"], "left")
    added = {
        "host": F.col("_host"),
        "n_lists": F.coalesce(F.size("_found"), F.lit(0)).cast("int"),
        "lists": F.coalesce(F.array_join("_found", ","), F.lit("")),
        "allowed": F.col("_found").isNull(),
    }
    own = [F.col(f"_row.`{c}`").alias(c) for c in captures.columns if c not in {prefix + n for n in added}]
    return joined.select(*own, *[c.alias(prefix + n) for n, c in added.items()])


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged as of its fetch day. ``pages`` has no fetch time, so the day is derived from page_id."""
    pages = shared.table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched_on", F.date_add(F.lit(EPOCH).cast("date"), F.pmod(F.col("page_id"), F.lit(DAYS)).cast("int")))
    found = filter_captures(captures, list_changes(spark))
    return found.select("page_id", "host", "fetched_on", "n_lists", "lists", "allowed")


_VALUES = ", ".join("('{}', '{}', DATE '{}', '{}')".format(*row) for row in LIST_CHANGES)
OP5_SQL = f"""
WITH changes(list_name, key, changed_on, action) AS (VALUES {_VALUES}),
spans AS (
  SELECT list_name, key, valid_from, coalesce(valid_to, DATE '9999-12-31') AS valid_to FROM (
    SELECT list_name, key, changed_on AS valid_from, action, lead(changed_on) OVER (PARTITION BY list_name, key ORDER BY changed_on) AS valid_to FROM changes)
  WHERE action = 'add'),
captures AS (
  SELECT page_id, nullif(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#@:]+)', 1), '') AS host,
         CAST(DATE '{EPOCH}' + CAST(page_id % {DAYS} AS INTEGER) AS DATE) AS fetched_on FROM pages)
SELECT c.page_id, c.host, c.fetched_on,
       CAST(count(DISTINCT s.list_name) AS INTEGER) AS n_lists,
       coalesce(string_agg(DISTINCT s.list_name, ',' ORDER BY s.list_name), '') AS lists,
       count(s.list_name) = 0 AS allowed
FROM captures c LEFT JOIN spans s
  ON (c.host = s.key OR ends_with(c.host, '.' || s.key)) AND c.fetched_on >= s.valid_from AND c.fetched_on < s.valid_to
GROUP BY c.page_id, c.host, c.fetched_on
"""
