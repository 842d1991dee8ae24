"""URL filters over dated lists, as an interval join; Spark functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Shares that the captures of one pattern and month are dealt over.
SALTS = 8


def host_of(url: Column) -> Column:
    """The lower-case host without user and port; empty where there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))


def path_segments(url: Column) -> Column:
    """The path's parts that aren't empty."""
    return F.filter(F.split(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1), "/"), lambda x: x != "")


def patterns_of(url: Column) -> Column:
    """All list patterns that cover a URL: its host and the domains above, host and path prefixes."""
    host = host_of(url)
    labels, parts = F.split(host, r"\."), path_segments(url)
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("pattern")))
    prefixes = F.when(
        F.size(parts) > 0,
        F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat(host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")).alias("pattern"))),
    ).otherwise(F.array().cast("array<struct<kind:string,pattern:string>>"))
    return F.when(host != "", F.concat(domains, prefixes))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, kind, pattern, since, until): when each pattern is on each list.

    ``entries`` has list, kind ("domain" or "prefix"), pattern, action ("add" or
    "remove") and dated (a date). An entry holds from its date to the next entry
    of the same pattern on the same list; until is null for the last. Of several
    entries of one date, an addition wins. Entries with a null or another action
    are ignored. They are first reduced to one a date, so that no pattern has
    more rows than the calendar has days, however often it is listed.
    """
    key = ["list", "kind", "pattern"]
    daily = (
        entries.where(F.col("action").isin("add", "remove"))
        .dropna(subset=[*key, "dated"])
        .groupBy(*key, F.to_date("dated").alias("since"))
        .agg(F.max((F.col("action") == "add").cast("int")).alias("on"))
    )
    # The next date is looked up within a month, and for a month's last entry among
    # the months' first: no window holds more than a month or one row a month.
    daily = daily.withColumn("month", F.trunc("since", "month"))
    months = daily.groupBy(*key, "month").agg(F.min("since").alias("first"))
    months = months.withColumn("next", F.lead("first").over(Window.partitionBy(*key).orderBy("month"))).drop("first")
    within = F.lead("since").over(Window.partitionBy(*key, "month").orderBy("since"))
    daily = daily.withColumn("within", within).join(months, [*key, "month"])
    return daily.where("on = 1").select(*key, "since", F.coalesce("within", "next").alias("until"))


def filter_captures(captures: DataFrame, entries: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row per row of ``captures``: page_id, url, fetched_at, n_active, pattern, verdict.

    Every capture is judged by the entries active on the day it was fetched:
    n_active counts them, pattern is the most specific of them (the longest; a
    path before a domain of the same length), and verdict is "allowed" if that
    pattern is on list "allow", "blocked" if on another only, "unlisted" without
    any. Intervals are cut at months, and captures meet those of their pattern
    and month only; a pattern's captures are dealt over ``salts`` tasks, so a
    host may hold any share of them.

    A null URL, one without a host, or a null time is unlisted with n_active 0
    and a null pattern; repeated rows are returned each; other columns are
    ignored. No captures in, none out; no entries, all unlisted.
    """
    rows = captures.select("page_id", "url", F.col("fetched_at").cast("timestamp").alias("fetched_at"))
    rows = rows.groupBy("page_id", "url", "fetched_at").agg(F.count(F.lit(1)).alias("copies"))
    day = F.to_date("fetched_at")
    keys = rows.withColumn("day", day).withColumn("k", F.explode_outer(patterns_of(F.col("url"))))
    keys = keys.select(
        "page_id", "url", "fetched_at", "copies", "day", F.col("k.kind").alias("kind"), F.col("k.pattern").alias("pattern"),
        F.trunc("day", "month").alias("month"), F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).alias("salt"),
    )
    last = captures.agg(F.max(F.to_date(F.col("fetched_at").cast("timestamp"))).alias("last"))
    spans = intervals(entries).join(F.broadcast(last))  # one row
    end = F.least(F.coalesce(F.date_sub("until", 1), F.col("last")), F.col("last"))
    spans = spans.where(F.col("since") <= end).withColumn("month", F.explode(F.sequence(F.trunc("since", "month"), F.trunc(end, "month"), F.expr("INTERVAL 1 MONTH"))))
    spans = spans.select(
        "kind", "pattern", "month", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"),
        F.col("since"), F.col("until"), F.when(F.col("list") == "allow", 1).otherwise(0).alias("allow"),
    )
    active = (F.col("day") >= F.col("since")) & (F.col("until").isNull() | (F.col("day") < F.col("until")))
    on = ["kind", "pattern", "month", "salt"]
    met = keys.alias("k").join(spans.alias("s"), [F.col(f"k.{c}") == F.col(f"s.{c}") for c in on] + [active], "left")
    hit = F.col("s.since").isNotNull()
    # Length, then path before domain, then allowed before blocked.
    rank = F.when(hit, F.length("k.pattern").cast("long") * 4 + F.when(F.col("k.kind") == "prefix", 2).otherwise(0) + F.col("s.allow"))
    found = met.groupBy("page_id", "url", "fetched_at").agg(F.max("copies").alias("copies"), F.count("s.since").alias("n_active"), F.max(rank).alias("rank"))
    size = F.floor(F.col("rank") / 4).cast("int")
    host = host_of(F.col("url"))
    path = F.concat(host, F.lit("/"), F.array_join(path_segments(F.col("url")), "/"))
    pattern = F.when(F.col("rank") % 4 >= 2, F.left(path, size)).when(F.col("rank").isNotNull(), F.right(host, size))
    verdict = F.when(F.col("rank").isNull(), "unlisted").when(F.col("rank") % 2 == 1, "allowed").otherwise("blocked")
    return found.select("page_id", "url", "fetched_at", "n_active", pattern.alias("pattern"), verdict.alias("verdict"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).drop("_copy")


def dated(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Captures and list entries for the synthetic ``pages``, which have neither dates nor lists.

    Each page was fetched at an hour spread over two years by its page_id, and
    stands for one entry, on another day of them, for its host, the domain above
    it or its first path, to or from one of two lists.
    """
    x = F.expr("page_id % 2147483648 * 1103515245 % 4294967296")
    div = lambda n: F.floor(x / n)
    host = host_of(F.col("url"))
    start = F.lit("2023-01-01")
    captures = pages.select("page_id", "url", (start.cast("timestamp") + F.make_interval(hours=(div(13) % (730 * 24)).cast("int"))).alias("fetched_at"))
    kind = x % 3
    parent = F.regexp_replace(host, r"^[^.]*\.", "")
    prefix = F.concat(host, F.lit("/"), F.try_element_at(path_segments(F.col("url")), F.lit(1)))
    entries = pages.select(
        F.when(div(3) % 5 == 0, "allow").otherwise("block").alias("list"),
        F.when(kind == 2, "prefix").otherwise("domain").alias("kind"),
        F.when(kind == 0, host).when(kind == 1, parent).otherwise(prefix).alias("pattern"),
        F.when(div(11) % 3 == 0, "remove").otherwise("add").alias("action"),
        F.date_add(start.cast("date"), (div(7) % 730).cast("int")).alias("dated"),
    )
    return captures, entries


#: Rows of ``filter_captures`` over ``dated(pages)``, for DuckDB.
URL_LISTS_SQL = r"""
WITH p AS (
  SELECT page_id, url, page_id % 2147483648 * 1103515245 % 4294967296 AS x,
    lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]*)', 1)) AS host,
    list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '') AS parts
  FROM pages
), captures AS (
  SELECT page_id, url, host, parts, TIMESTAMP '2023-01-01' + to_hours(((x // 13) % 17520)::INTEGER) AS fetched_at FROM p
), entries AS (
  SELECT CASE WHEN (x // 3) % 5 = 0 THEN 'allow' ELSE 'block' END AS list,
    CASE WHEN x % 3 = 2 THEN 'prefix' ELSE 'domain' END AS kind,
    CASE x % 3 WHEN 0 THEN host WHEN 1 THEN regexp_replace(host, '^[^.]*\.', '') ELSE host || '/' || parts[1] END AS pattern,
    CASE WHEN (x // 11) % 3 = 0 THEN 0 ELSE 1 END AS added,
    DATE '2023-01-01' + ((x // 7) % 730)::INTEGER AS since
  FROM p
), daily AS (
  SELECT list, kind, pattern, since, max(added) AS added FROM entries WHERE pattern IS NOT NULL GROUP BY ALL
), spans AS (
  SELECT * FROM (SELECT *, lead(since) OVER (PARTITION BY list, kind, pattern ORDER BY since) AS til FROM daily) WHERE added = 1
), keys AS (
  SELECT page_id, url, fetched_at, 'domain' AS kind, array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.') AS pattern
  FROM (SELECT *, unnest(range(1, len(string_split(host, '.')) + 1)) AS i FROM captures WHERE host <> '')
  UNION ALL
  SELECT page_id, url, fetched_at, 'prefix', host || '/' || array_to_string(list_slice(parts, 1, i), '/')
  FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM captures WHERE host <> '')
), met AS (
  SELECT k.*, s.list, length(k.pattern) * 4 + CASE WHEN k.kind = 'prefix' THEN 2 ELSE 0 END + CASE WHEN s.list = 'allow' THEN 1 ELSE 0 END AS rank
  FROM keys k JOIN spans s ON s.kind = k.kind AND s.pattern = k.pattern
    AND s.since <= k.fetched_at::DATE AND (s.til IS NULL OR k.fetched_at::DATE < s.til)
), best AS (
  SELECT page_id, count(*) AS n_active, arg_max(pattern, rank) AS pattern, max(rank) AS rank FROM met GROUP BY page_id
)
SELECT c.page_id, c.url, c.fetched_at, coalesce(b.n_active, 0) AS n_active, b.pattern,
  CASE WHEN b.rank IS NULL THEN 'unlisted' WHEN b.rank % 2 = 1 THEN 'allowed' ELSE 'blocked' END AS verdict
FROM captures c LEFT JOIN best b USING (page_id)
"""
