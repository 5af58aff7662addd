"""URL filters by a temporal list join (operator 5).

Lists change: an entry is added on one day and removed on another. Dated list
events become validity intervals, and every capture is evaluated against the
entries active when it was fetched, so a later removal does not clear an old
capture and a later addition does not condemn one. Entries are hosts (with all
their subdomains), exact hosts or path prefixes; a capture looks up each suffix
of its host and each prefix of its path as an equality key, and the interval
decides.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: (list, kind, pattern, action, date): kind is domain (host and subdomains),
#: host (exactly) or path (host and beginning of the path); an allow entry
#: outweighs block entries that are no more specific.
EVENTS = [
    ("spam", "domain", "casino-win.example.com", "block", "2023-01-01"),
    ("spam", "domain", "casino-win.example.com", "remove", "2024-02-01"),
    ("spam", "domain", "casino-win.example.com", "block", "2024-06-01"),
    ("spam", "domain", "cheap-pills.example.com", "block", "2023-03-15"),
    ("spam", "domain", "free-bets.example.com", "block", "2024-01-10"),
    ("gambling", "domain", "free-bets.example.com", "block", "2023-06-01"),
    ("gambling", "domain", "casino-win.example.com", "block", "2023-09-01"),
    ("gambling", "domain", "free-bets.example.com", "remove", "2024-09-01"),
    ("policy", "domain", "example.org", "block", "2024-10-01"),
    ("policy", "domain", "thther.example.org", "allow", "2024-10-15"),
    ("policy", "host", "blog.tionble.example.com", "block", "2024-03-01"),
    ("policy", "path", "tionsh.example.net/de", "block", "2024-04-01"),
    ("policy", "path", "tionsh.example.net/de", "remove", "2024-11-01"),
]
#: Captures without a fetch time of their own are dated by their id over 2024.
EPOCH, DAYS = "2024-01-01", 366


def list_events(spark: SparkSession, events: list[tuple] = EVENTS) -> DataFrame:
    rows = [(a, b, c, d, dt.date.fromisoformat(e)) for a, b, c, d, e in events]
    return spark.createDataFrame(rows, "list string, kind string, pattern string, action string, since date")


def intervals(events: DataFrame) -> DataFrame:
    """(list, kind, pattern, action, since, until) while an entry is active:
    from one event of an entry up to the day before its next. Of several events
    of an entry on one day the last by name of the action counts ("remove" over
    "block" over "allow"). Events with a null in any column are left out."""
    entry = Window.partitionBy("list", "kind", "pattern").orderBy("since")
    daily = events.dropna().groupBy("list", "kind", "pattern", "since").agg(F.max("action").alias("action"))
    return daily.withColumn("until", F.lead("since").over(entry)).where("action <> 'remove'")


def host_of(url: str | Column) -> Column:
    """Lower-case host without user, port and a final dot; null where there is none."""
    raw = F.regexp_extract(F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.nullif(F.regexp_replace(F.lower(raw), r"\.$", ""), F.lit(""))


def path_of(url: str) -> Column:
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def evaluate(captures: DataFrame, events: DataFrame, fetched: Column | None = None) -> DataFrame:
    """(page_id, url, host, fetched, lists, entries, is_blocked) of every row.

    `lists` names the lists with an active blocking entry, `entries` counts
    them. An allow entry lifts blocking entries of its list that are not longer
    than it. Captures without a usable URL (null, empty, no host) or a fetch
    time match nothing and are not blocked. Very long URLs are looked up whole.
    A capture on the day of an event sees the event's outcome; of tied events of
    one day see `intervals`. Repeated rows are evaluated one by one. Extra
    columns are ignored, whatever their names; an empty table gives an empty
    table.

    The list is joined by equality of keys; Catalyst broadcasts it only while
    its size is below the session's threshold and shuffles both sides beyond.
    Suffixes are looked up only if some entry has as many labels, so that
    top-level domains, which nearly all captures share, are no keys at all
    unless a list names one.
    """
    if fetched is None:
        # a null id has no day
        fetched = F.date_add(F.lit(EPOCH).cast("date"), F.pmod("page_id", F.lit(DAYS)).cast("int"))
    rows = captures.select("page_id", "url", host_of("url").alias("host"), fetched.alias("fetched"), path_of("url").alias("__path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.filter(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_contains("depths", F.size(labels) - i + 1)), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("pattern")))
    steps = F.filter(F.split("__path", "/"), lambda x: x != "")
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(steps), F.lit(1))), lambda i: F.struct(F.lit("path").alias("kind"), F.concat("host", F.lit("/"), F.array_join(F.slice(steps, 1, i), "/")).alias("pattern")))
    keys = F.concat(suffixes, prefixes, F.array(F.struct(F.lit("host").alias("kind"), F.col("host").alias("pattern"))))
    # one lookup per distinct (host, path, day): captures of one address on one day share it
    spots = rows.where("host is not null and fetched is not null").select("host", "__path", "fetched").distinct()
    active = intervals(events)
    # one row: the numbers of labels of domain entries
    depths = active.where("kind = 'domain'").agg(F.collect_set(F.size(F.split("pattern", r"\."))).alias("depths"))
    met = spots.join(F.broadcast(depths)).withColumn("key", F.explode(keys)).select("host", "__path", "fetched", "key.kind", "key.pattern").join(active, ["kind", "pattern"]).where("since <= fetched and (until is null or fetched < until)")
    spot = ["host", "__path", "fetched"]
    verdict = (
        met.groupBy(*spot, "list")
        .agg(F.max(F.when(F.col("action") == "allow", F.length("pattern"))).alias("lifted"), F.collect_list(F.when(F.col("action") == "block", F.length("pattern"))).alias("blocks"))
        .withColumn("left", F.size(F.filter("blocks", lambda n: n > F.coalesce(F.col("lifted"), F.lit(-1)))))
        .where(F.col("left") > 0)
        .groupBy(*spot)
        .agg(F.array_join(F.sort_array(F.collect_list("list")), ",").alias("lists"), F.sum("left").cast("long").alias("entries"))
    )
    return rows.join(verdict, spot, "left").select("page_id", "url", "host", "fetched", F.coalesce("lists", F.lit("")).alias("lists"), F.coalesce("entries", F.lit(0)).cast("long").alias("entries"), F.col("lists").isNotNull().alias("is_blocked"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), list_events(spark)).withColumn("fetched", F.col("fetched").cast("string"))


SQL = (
    "WITH events(list, kind, pattern, action, since) AS (VALUES "
    + ", ".join(f"('{a}', '{b}', '{c}', '{d}', DATE '{e}')" for a, b, c, d, e in EVENTS)
    + f"""),
active AS (SELECT * FROM (SELECT *, lead(since) OVER (PARTITION BY list, kind, pattern ORDER BY since) AS until FROM events) WHERE action <> 'remove'),
caps AS (SELECT page_id, url, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '') AS host,
                regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path,
                DATE '{EPOCH}' + (page_id % {DAYS})::INTEGER AS fetched FROM pages),
met AS (SELECT page_id, url, fetched, a.* FROM caps JOIN active a
        ON since <= fetched AND (until IS NULL OR fetched < until)
       AND CASE kind WHEN 'host' THEN host = pattern
                     WHEN 'domain' THEN host = pattern OR ends_with(host, '.' || pattern)
                     ELSE host || path = pattern OR starts_with(host || path, pattern || '/') END),
per AS (SELECT page_id, list, max(CASE WHEN action = 'allow' THEN length(pattern) END) AS lifted, list(length(pattern)) FILTER (WHERE action = 'block') AS blocks FROM met GROUP BY ALL),
kept AS (SELECT page_id, list, len(list_filter(blocks, lambda n: n > coalesce(lifted, -1))) AS n FROM per),
verdict AS (SELECT page_id, string_agg(list, ',' ORDER BY list) AS lists, sum(n)::BIGINT AS entries FROM kept WHERE n > 0 GROUP BY page_id)
SELECT c.page_id, c.url, c.host, c.fetched::DATE::VARCHAR AS fetched, coalesce(v.lists, '') AS lists, coalesce(v.entries, 0) AS entries, v.lists IS NOT NULL AS is_blocked
FROM caps c LEFT JOIN verdict v USING (page_id)
"""
)
