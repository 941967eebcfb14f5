"""URL lists with dates: captures judged by the entries active when they were fetched.

A list is a log of dated entries (pattern, action, day): "block", "allow", or "drop", which
takes the pattern off the list.  Each pattern's entries become validity intervals, from
an entry's day to the next one's.  A capture is judged by an as-of join: its host and every
parent domain, and the host with each leading folder of the path, are its keys; the entry of
a key whose interval holds the fetch day is active, and the longest key's entry decides.

Captures meet entries on (key, period, salt): intervals are cut at fixed periods, so a
pattern with a long history does not pair every capture with all of it, and a host with a
third of all captures is dealt over SALTS tasks, to each of which its few entries go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days of a period, parts of a hot key, and the end of intervals that are still open.
PERIOD, SALTS, OPEN = 30, 16, "2100-01-01"


def host_of(url: Column) -> Column:
    """The host in lower case, without user, port and a last dot; empty for what is no URL."""
    authority = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.regexp_replace(F.lower(F.regexp_replace(authority, r"^.*@|:[0-9]*$", "")), r"\.$", "")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)?", 1)


def keys_of(url: Column) -> Column:
    """All patterns that cover a URL: its host, the parent domains of two labels or more, and host with leading folders."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    count = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), F.greatest(count - 1, F.lit(1))), lambda k: F.array_join(F.slice(labels, k, count), "."))
    parts = F.filter(F.split(path_of(url), "/"), lambda p: p != "")
    folders = F.transform(
        F.filter(F.sequence(F.lit(0), F.size(parts)), lambda k: k > 0), lambda k: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, 1, k), "/"))
    )
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(domains, folders)))


def intervals(entries: DataFrame) -> DataFrame:
    """pattern, action, from_day and to_day (exclusive) of the entries (pattern, action, day).

    Of several entries of one day for one pattern the greatest action in code-point order
    counts: "drop" over "block" over "allow".  Entries without pattern, action or day are ignored.
    A pattern's host is read in lower case, its folders as they are.
    """
    host = F.substring_index("pattern", "/", 1)
    pattern = F.concat(F.lower(host), F.substring(F.col("pattern"), F.length(host) + 1, F.length("pattern")))
    known = entries.select(pattern.alias("pattern"), "action", F.col("day").cast("date").alias("from_day"))
    known = known.filter(F.col("pattern").isNotNull() & F.col("action").isin("allow", "block", "drop") & F.col("from_day").isNotNull())
    daily = known.groupBy("pattern", "from_day").agg(F.max("action").alias("action"))
    following = F.lead("from_day").over(Window.partitionBy("pattern").orderBy("from_day"))
    return daily.withColumn("to_day", F.coalesce(following, F.lit(OPEN).cast("date"))).filter("action <> 'drop'")


def _period(day: Column) -> Column:
    return F.floor(F.unix_date(day) / F.lit(PERIOD))


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """capture_id, host, fetched, verdict and pattern of every capture (capture_id, url, fetched).

    verdict is that of the longest active pattern, "none" without one; pattern is null then.
    Null URLs, those without a host and null days meet no entry; a null capture_id stays;
    repeated captures are judged alike; empty tables give no rows, or only "none"; other
    columns are not read.
    """
    own = captures.select(F.col("capture_id"), "url", F.col("fetched").cast("date").alias("fetched"))
    keyed = own.withColumn("salt", F.pmod(F.xxhash64("url", "capture_id"), F.lit(SALTS)).cast("int")).select(
        "capture_id", "url", "fetched", "salt", F.explode_outer(keys_of(F.col("url"))).alias("pattern")
    )
    # Periods after the last capture meet none; merged, not broadcast, as the rows are made after the last known size.
    ended = F.least("to_day", F.lit(own.agg(F.max("fetched")).first()[0]).cast("date") + F.expr("interval 1 day"))
    spread = (
        intervals(entries)
        .withColumn("to_day", ended.cast("date"))
        .filter("to_day > from_day")
        .withColumn("period", F.explode(F.sequence(_period(F.col("from_day")), _period(F.date_sub("to_day", 1)))))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        .hint("merge")
    )
    active = keyed.withColumn("period", _period(F.col("fetched"))).join(spread, ["pattern", "period", "salt"], "left")
    holds = (F.col("fetched") >= F.col("from_day")) & (F.col("fetched") < F.col("to_day"))
    longest = F.max(F.when(holds, F.struct(F.length("pattern").alias("size"), "pattern", "action"))).alias("best")
    best = active.groupBy("capture_id", "url", "fetched").agg(longest)
    judged = own.join(
        best.select(F.col("capture_id").alias("b_id"), F.col("url").alias("b_url"), F.col("fetched").alias("b_day"), "best"),
        F.col("capture_id").eqNullSafe(F.col("b_id")) & F.col("url").eqNullSafe(F.col("b_url")) & F.col("fetched").eqNullSafe(F.col("b_day")),
    )
    return judged.select(
        "capture_id", host_of(F.col("url")).alias("host"), "fetched", F.coalesce("best.action", F.lit("none")).alias("verdict"), F.col("best.pattern").alias("pattern")
    )


def page_captures(pages: DataFrame) -> DataFrame:
    """The pages as captures: a page's fetch day is one of 360 of 2024, by its number."""
    return pages.select(F.col("page_id").alias("capture_id"), "url", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 360).cast("int")).alias("fetched"))


def page_list(pages: DataFrame) -> DataFrame:
    """A dated list made from the pages' own hosts and folders.

    Every host that a page with a number divisible by 3 shows is blocked from a day on that
    its length gives, allowed again 90 days later and dropped after 200; the language folder of
    pages divisible by 7 is allowed on their host from day 45.
    """
    start = F.lit("2024-01-01").cast("date")
    hosts = pages.filter("page_id % 3 = 0").select(host_of(F.col("url")).alias("pattern")).filter("pattern <> ''").distinct()
    first = F.length("pattern") * 3 % 150
    dated = F.array(*[F.struct(F.lit(a).alias("action"), F.date_add(start, (first + n).cast("int")).alias("day")) for a, n in (("block", 0), ("allow", 90), ("drop", 200))])
    by_host = hosts.select("pattern", F.inline(dated))
    folder = F.regexp_extract(path_of(F.col("url")), "^/([^/]+)/", 1)
    by_folder = (
        pages.filter("page_id % 7 = 0").select(host_of(F.col("url")).alias("h"), folder.alias("f")).filter("h <> '' AND f <> ''").distinct()
        .select(F.concat("h", F.lit("/"), "f").alias("pattern"), F.lit("allow").alias("action"), F.date_add(start, 45).alias("day"))
    )
    return by_host.unionByName(by_folder)


ORACLE = r"""
WITH c AS (
  SELECT page_id AS capture_id, url, CAST(DATE '2024-01-01' + CAST(page_id % 360 AS INTEGER) AS DATE) AS fetched,
    regexp_replace(lower(regexp_replace(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@|:[0-9]*$', '', 'g')), '\.$', '') AS host,
    regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)?', 1) AS path
  FROM pages
),
list AS (
  SELECT pattern, action, CAST(DATE '2024-01-01' + CAST(length(pattern) * 3 % 150 + days AS INTEGER) AS DATE) AS from_day
  FROM (SELECT DISTINCT host AS pattern FROM c WHERE capture_id % 3 = 0 AND host <> ''), (VALUES ('block', 0), ('allow', 90), ('drop', 200)) v(action, days)
  UNION ALL
  SELECT DISTINCT host || '/' || regexp_extract(path, '^/([^/]+)/', 1), 'allow', CAST(DATE '2024-01-01' + 45 AS DATE)
  FROM c WHERE capture_id % 7 = 0 AND host <> '' AND regexp_extract(path, '^/([^/]+)/', 1) <> ''
),
spans AS (SELECT *, coalesce(lead(from_day) OVER (PARTITION BY pattern ORDER BY from_day), DATE '2100-01-01') AS to_day FROM list),
best AS (
  SELECT c.capture_id, max_by(s.action, length(s.pattern)) AS action, max_by(s.pattern, length(s.pattern)) AS pattern
  FROM c JOIN spans s ON s.action <> 'drop' AND c.fetched >= s.from_day AND c.fetched < s.to_day
    AND (host = s.pattern OR ends_with(host, '.' || s.pattern) OR starts_with(host || path || '/', s.pattern || '/'))
  GROUP BY c.capture_id
)
SELECT capture_id, host, fetched, coalesce(action, 'none') AS verdict, pattern FROM c LEFT JOIN best USING (capture_id)
"""
