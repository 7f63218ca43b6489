"""Temporal list join: every capture against the list entries active when it was fetched.

Dated list events (an entry is added or removed) become validity intervals. A
capture yields the keys under which an entry may name it - its host, its
parent domains, and path prefixes of the host, of the depths that the list
has - and an as-of lookup takes the intervals of these keys that contain the
time of the fetch.

Scale: one shuffle of events by key, one of captures by key.  Equal captures are
aggregated first.  An interval stays a row of its own, so neither a host with a
third of all captures nor a key with a third of the list makes one large row, and
Spark may split either side of the join (AQE); a small list is broadcast by
Spark's own size check.

Defined results: a null or relative URL has no host and is never blocked; a
null fetch time matches nothing; an event with a null key or time is ignored;
of events of one entry at one time a removal wins, of two additions the
category that sorts last; repeated captures repeat; no captures give no rows, no
events no entries; a column ``entries`` of the captures stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import free_name


def host_of(url: Column) -> Column:
    """Lower-case host without user and port; empty when there is none."""
    authority = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", ""))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def intervals(events: DataFrame) -> DataFrame:
    """Events (list, key, action, at, category) as rows (list, key, category, since, until); an open end is null."""
    good = events.filter("key IS NOT NULL AND at IS NOT NULL AND action IN ('add', 'remove')")
    one = good.groupBy("list", "key", "at").agg(F.max("action").alias("action"), F.max("category").alias("category"))
    w = Window.partitionBy("list", "key").orderBy("at")
    return one.withColumn("until", F.lead("at").over(w)).filter("action = 'add'").select("list", "key", "category", F.col("at").alias("since"), "until")


def depth_of(key: Column) -> Column:
    """Steps of a ``host/path`` key, or minus the labels of a host's."""
    return F.when(F.contains(key, F.lit("/")), F.size(F.split(key, "/")) - 1).otherwise(-F.size(F.split(key, r"\.")))


def keys_of(url: Column, depths: list[int]) -> Column:
    """Keys of the given depths that may name a URL: ``host``-suffixes of so many labels, ``host/path`` prefixes of so many steps.

    Each is cut from the address in one pass, so the work is linear in its length.
    """
    host, path = host_of(url), path_of(url)
    steps = F.filter(F.split(path, "/"), lambda s: s != "")
    whole = F.array_join(steps, "/")
    of = lambda wanted: F.array(*[F.lit(d) for d in wanted]).cast("array<int>")
    suffixes = F.transform(F.filter(of([-d for d in depths if d < 0]), lambda d: d <= F.size(F.split(host, r"\."))), lambda d: F.call_function("substring_index", host, F.lit("."), -d))
    prefixes = F.transform(F.filter(of([d for d in depths if d > 0]), lambda d: d <= F.size(steps)), lambda d: F.concat(host, F.lit("/"), F.call_function("substring_index", whole, F.lit("/"), d)))
    return F.when(host != "", F.concat(suffixes, prefixes)).otherwise(F.array().cast("array<string>"))


def evaluate(captures: DataFrame, events: DataFrame, url: str = "url", fetched: str = "fetched_at") -> DataFrame:
    """``captures`` (any columns) with ``entries`` (longer where they have it): array of (list, key, category) active at the fetch, sorted."""
    name = free_name(captures, "entries")
    cols = [F.col(f"`{c}`") for c in captures.columns]
    each = captures.select(F.struct(*cols).alias("capture"), F.col(f"`{url}`").alias("url"), F.col(f"`{fetched}`").alias("at"))
    distinct = each.groupBy("url", "at").agg(F.lit(1).alias("one"))
    depths = [r[0] for r in events.select(depth_of(F.col("key")).alias("d")).filter("d IS NOT NULL").distinct().collect()]  # as many as the list has kinds of keys
    wanted = distinct.select("url", "at", F.explode(keys_of(F.col("url"), depths)).alias("key"))
    # interval by interval: a listed key with many intervals stays many rows, and both sides of the join can be split
    valid = intervals(events).select("key", F.struct("since", "until", "list", "category").alias("s"))
    met = wanted.join(valid, "key").filter((F.col("s.since") <= F.col("at")) & (F.col("s.until").isNull() | (F.col("at") < F.col("s.until"))))
    hits = met.select("url", "at", F.struct(F.col("s.list").alias("list"), "key", F.col("s.category").alias("category")).alias("entry"))
    found = hits.groupBy("url", "at").agg(F.array_sort(F.collect_set("entry")).alias("entries"))
    out = each.alias("c").join(found.alias("f"), (F.col("c.url") == F.col("f.url")) & (F.col("c.at") == F.col("f.at")), "left")
    return out.select("capture.*", F.coalesce("entries", F.array().cast(found.schema["entries"].dataType)).alias(name))


def allowed(captures: DataFrame, events: DataFrame, url: str = "url", fetched: str = "fetched_at") -> DataFrame:
    """The captures that no entry blocks, with their own columns."""
    name = free_name(captures, "entries")
    return evaluate(captures, events, url, fetched).filter(F.size(F.col(name)) == 0).select(*[F.col(f"`{c}`") for c in captures.columns])


def sample_events(pages: DataFrame) -> DataFrame:
    """A dated list for the test tables, made of the pages' own hosts and first path steps by a rule on their digests.

    A name takes part if its digest begins with 0 to 5; it is added on a day of
    the year that the digest gives, removed 60 days later, and every second one
    is added again after 40 more days.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    step = F.regexp_extract(path, "^/+([^/]+)", 1)
    parent = F.regexp_replace(host, r"^[^.]*\.", "")
    names = pages.select(F.explode(F.array(F.struct(F.lit("hosts").alias("list"), host.alias("key")), F.struct(F.lit("domains").alias("list"), parent.alias("key")), F.struct(F.lit("paths").alias("list"), F.when(step != "", F.concat(host, F.lit("/"), step)).otherwise("").alias("key")))).alias("n")).select("n.*").filter("key <> '' AND contains(key, '.')").distinct()
    d = names.withColumn("d", F.md5(F.concat_ws("|", "list", "key"))).filter("substr(d, 1, 1) < '6'")
    day = (F.ascii(F.substr("d", F.lit(2), F.lit(1))) * 31 + F.ascii(F.substr("d", F.lit(3), F.lit(1))) * 7 + F.ascii(F.substr("d", F.lit(4), F.lit(1)))) % 366
    again = F.col("d").substr(5, 1) < "8"
    event = lambda what, off, when: F.when(when, F.struct(F.lit(what).alias("action"), F.date_add(F.lit("2024-01-01").cast("date"), (day + off).cast("int")).alias("at")))
    events = F.filter(F.array(event("add", 0, F.lit(True)), event("remove", 60, F.lit(True)), event("add", 100, again)), lambda e: e.isNotNull())
    return d.select("list", "key", F.explode(events).alias("e"), F.substr("d", F.lit(6), F.lit(1)).alias("category")).select("list", "key", "e.action", "e.at", "category")


def query(pages: DataFrame) -> DataFrame:
    """Every page, fetched on the day of 2024 that its id gives, against the dated list of :func:`sample_events`."""
    captures = pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id"), F.lit(366)).cast("int")).alias("fetched_at"))
    out = evaluate(captures, sample_events(pages))
    said = F.array_join(F.transform("entries", lambda e: F.concat_ws(":", e["list"], e["key"], e["category"])), ",")
    return out.select("page_id", host_of(F.col("url")).alias("host"), F.col("fetched_at").cast("string").alias("fetched_on"), F.size("entries").cast("long").alias("n_entries"), said.alias("entries"), (F.size("entries") > 0).alias("blocked"))


ORACLE = r"""
WITH p AS (SELECT page_id, url, lower(regexp_replace(regexp_replace(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', '')) AS host,
    regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages),
n AS (SELECT DISTINCT * FROM (
    SELECT 'hosts' AS list, host AS key FROM p UNION ALL SELECT 'domains', regexp_replace(host, '^[^.]*\.', '') FROM p
    UNION ALL SELECT 'paths', host || '/' || regexp_extract(path, '^/+([^/]+)', 1) FROM p WHERE regexp_extract(path, '^/+([^/]+)', 1) <> '') WHERE key <> '' AND contains(key, '.')),
d AS (SELECT *, md5(list || '|' || key) AS d FROM n),
b AS (SELECT list, key, substr(d, 6, 1) AS category, substr(d, 5, 1) < '8' AS again, (ascii(substr(d, 2, 1)) * 31 + ascii(substr(d, 3, 1)) * 7 + ascii(substr(d, 4, 1))) % 366 AS day FROM d WHERE substr(d, 1, 1) < '6'),
v AS (SELECT list, key, category, DATE '2024-01-01' + day::INTEGER AS since, DATE '2024-01-01' + (day + 60)::INTEGER AS until FROM b
    UNION ALL SELECT list, key, category, DATE '2024-01-01' + (day + 100)::INTEGER, NULL FROM b WHERE again),
c AS (SELECT page_id, host, path, DATE '2024-01-01' + (page_id % 366)::INTEGER AS at FROM p),
m AS (SELECT DISTINCT c.page_id, v.list, v.key, v.category FROM c JOIN v ON v.since <= c.at AND (v.until IS NULL OR c.at < v.until) AND (
    (v.list <> 'paths' AND (c.host = v.key OR ends_with(c.host, '.' || v.key))) OR
    (v.list = 'paths' AND (c.host || '/' || array_to_string(list_filter(string_split(c.path, '/'), lambda s: s <> ''), '/') || '/') LIKE (replace(replace(v.key, '%', '\%'), '_', '\_') || '/%') ESCAPE '\')))
SELECT c.page_id, any_value(c.host) AS host, any_value(c.at)::VARCHAR AS fetched_on, count(m.key)::BIGINT AS n_entries,
    coalesce(string_agg(m.list || ':' || m.key || ':' || m.category, ',' ORDER BY m.list, m.key, m.category), '') AS entries, count(m.key) > 0 AS blocked
FROM c LEFT JOIN m USING (page_id) GROUP BY c.page_id
"""
