"""Queries on results after a run, the yield of queries from nested metadata, reopenings, and tables that change together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import saving
from ..operators.snapshots import TableSet
from .catalog import query, register
from .decisions import _shared

_NOW = "2024-01-31 00:00:00"


@query(f"""WITH e AS (SELECT o_orderkey AS key, o_totalprice AS price, o_orderpriority AS title, NULL::VARCHAR AS official_url, CASE o_orderstatus WHEN 'F' THEN 'ARCHIVED' WHEN 'O' THEN 'NEW' ELSE 'REJECTED' END AS status, o_orderdate AS seen, CASE WHEN o_orderkey % 5 = 0 THEN 'UNVERIFIED_BUT_CREDIBLE' ELSE 'UNRESOLVED' END AS resolution FROM orders WHERE o_orderkey % 4 > 0),
n AS (SELECT o_orderkey AS key, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS price, o_orderpriority AS title, 'https://o.example/' || o_orderkey AS official_url, o_orderkey % 7 > 0 AS relevant, o_orderkey % 11 = 0 AS manual, o_orderkey % 2 = 0 AS analysed, 'VERIFIED_OFFICIAL' AS resolution FROM orders WHERE o_orderkey % 6 < 5),
b AS (SELECT key, e.key IS NOT NULL AS has, n.key IS NOT NULL AS came, e.price AS ep, n.price AS np, e.status, e.seen, relevant, manual, analysed, n.official_url, coalesce(e.resolution = 'UNVERIFIED_BUT_CREDIBLE' AND e.price = n.price, false) AS enriched FROM e FULL JOIN n USING (key)),
s AS (SELECT *, has AND came AND (enriched OR NOT analysed) AS quiet FROM b),
t AS (SELECT *, CASE WHEN came THEN CASE WHEN quiet THEN 'UNCHANGED' WHEN NOT relevant THEN 'REJECTED' WHEN manual THEN 'MANUAL_REVIEW' WHEN has THEN 'UPDATED' ELSE 'NEW' END END AS state FROM s)
SELECT key, CASE WHEN came AND NOT quiet THEN np ELSE ep END AS price, CASE WHEN came AND (NOT quiet OR enriched) THEN official_url END AS official_url, CASE WHEN NOT came OR (quiet AND status IN ('ARCHIVED', 'REJECTED')) OR status = 'ARCHIVED' THEN status WHEN quiet THEN 'UNCHANGED' ELSE state END AS status, state,
CASE WHEN enriched THEN 'OFFICIAL_ENRICHED' END AS event, (CASE WHEN came AND NOT quiet THEN TIMESTAMP '{_NOW}' ELSE seen END)::DATE::VARCHAR AS last_changed, (CASE WHEN came THEN TIMESTAMP '{_NOW}' ELSE seen END)::DATE::VARCHAR AS last_seen FROM t""")
def q_saved_results(t):
    """Every order after a run that saw some of them: states, sticky decisions, evidence that changes nothing else."""
    o = t("orders")
    resolution = F.when(F.col("o_orderkey") % 5 == 0, "UNVERIFIED_BUT_CREDIBLE").otherwise("UNRESOLVED")
    status = F.when(F.col("o_orderstatus") == "F", "ARCHIVED").when(F.col("o_orderstatus") == "O", "NEW").otherwise("REJECTED")
    seen = F.col("o_orderdate").cast("timestamp")
    existing = o.filter("o_orderkey % 4 > 0").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("title"), F.lit(None).cast("string").alias("official_url"), status.alias("status"), seen.alias("first_seen"), seen.alias("last_seen"), seen.alias("last_changed"), resolution.alias("resolution"))
    price = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    incoming = o.filter("o_orderkey % 6 < 5").select(F.col("o_orderkey").alias("key"), price.alias("price"), F.col("o_orderpriority").alias("title"), F.concat(F.lit("https://o.example/"), "o_orderkey").alias("official_url"), F.expr("o_orderkey % 7 > 0").alias("relevant"), F.expr("o_orderkey % 11 = 0").alias("manual"), F.expr("o_orderkey % 2 = 0").alias("analysed"), F.lit("VERIFIED_OFFICIAL").alias("resolution"))
    out = saving.saved(existing, incoming, ["price", "title", "official_url"], F.lit(_NOW).cast("timestamp"))
    return out.select("key", "price", "official_url", "status", "state", "event", F.to_date("last_changed").cast("string").alias("last_changed"), F.to_date("last_seen").cast("string").alias("last_seen"))


@query("""WITH r AS (SELECT o_orderkey, o_custkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders WHERE o_orderstatus <> 'P'),
q AS (SELECT o_custkey, o_orderdate, CASE l_returnflag WHEN 'A' THEN 'DIRECT' WHEN 'R' THEN 'CONTROL' ELSE 'SEARCH' END AS strategy, l_linestatus AS family, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity::BIGINT ELSE 0 END AS raw, CASE WHEN l_returnflag = 'A' THEN l_linenumber ELSE 0 END AS usable FROM r JOIN lineitem ON l_orderkey = o_orderkey WHERE n <= 10)
SELECT o_custkey AS scope, strategy || ':' || family AS query, count(*) AS executions, sum(raw)::BIGINT AS raw_results, sum(usable)::BIGINT AS usable_observations, count(*) FILTER (raw = 0) AS zero_results, (max(o_orderdate) FILTER (raw > 0))::DATE::VARCHAR AS last_successful_at FROM q WHERE strategy <> 'CONTROL' GROUP BY 1, 2""")
def q_nested_query_yield(t):
    """The last ten runs' queries from nested metadata whose fields differ by query, per strategy and family."""
    even = F.col("l_linenumber") % 2 == 0
    flag = F.col("l_returnflag")
    asked = F.struct(
        F.when(flag == "A", "DIRECT").when(flag == "R", "CONTROL").otherwise("SEARCH").alias("source_strategy"), F.col("l_linestatus").alias("query_family"),
        F.when(even, F.col("l_quantity").cast("long")).alias("raw_results_count"), F.when(flag == "A", F.col("l_linenumber").cast("long")).alias("candidates_created"),
    )
    lines = t("lineitem").select("l_orderkey", asked.alias("asked")).groupBy("l_orderkey").agg(F.to_json(F.struct(F.collect_list("asked").alias("collection_queries"))).alias("metadata"))  # a run's own queries
    runs = t("orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    runs = runs.select(F.col("o_custkey").alias("scope"), F.col("o_orderkey").alias("run"), F.when(F.col("o_orderstatus") == "P", "failed").otherwise("completed").alias("status"), F.col("o_orderdate").alias("started"), "metadata")
    out = saving.query_yield(runs)
    return out.select("scope", "query", "executions", "raw_results", "usable_observations", "zero_results", F.to_date("last_successful_at").cast("string").alias("last_successful_at"))


@query("""WITH o AS (SELECT user_id, event_id, ts, event_type, (value > 50)::INT AS dear FROM events WHERE event_type <> 'error'), e AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'error'),
b AS (SELECT e.user_id, e.event_id, arg_max({'t': o.event_type, 'd': o.dear}, o.ts) AS s FROM e JOIN o ON o.user_id = e.user_id AND o.ts < e.ts GROUP BY 1, 2), a AS (SELECT e.user_id, e.event_id, arg_min({'t': o.event_type, 'd': o.dear}, o.ts) AS s FROM e JOIN o ON o.user_id = e.user_id AND o.ts >= e.ts GROUP BY 1, 2)
SELECT e.user_id AS id, strftime(e.ts, '%Y-%m-%d %H:%M:%S.%f') AS moment, CASE WHEN b.s IS NOT NULL AND a.s IS NOT NULL THEN array_to_string(list_filter([CASE WHEN b.s.t <> a.s.t THEN 'kind' END, CASE WHEN b.s.d <> a.s.d THEN 'dear' END], lambda x: x IS NOT NULL), ',') END AS changed FROM e LEFT JOIN b USING (user_id, event_id) LEFT JOIN a USING (user_id, event_id)""")
def q_reopenings(t):
    """What changed around every reopening (an error event), by the observations on both sides of it."""
    e = t("events")
    seen = e.filter("event_type <> 'error'").select(F.col("user_id").alias("id"), F.col("ts").alias("seen_at"), F.col("event_type").alias("kind"), (F.col("value") > 50).cast("int").alias("dear"))
    events = e.filter("event_type = 'error'").select(F.col("user_id").alias("id"), F.col("ts").alias("at"), F.lit("REOPENED").alias("event"))
    out = saving.reopened(events, seen.withColumnRenamed("kind", "what"), ["what", "dear"])
    names = F.transform("changed", lambda c: F.when(c == "what", "kind").otherwise(c))
    return out.select("id", F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("moment"), F.array_join(names, ",").alias("changed"))


def q_table_reset(spark: SparkSession, d: str) -> DataFrame:
    """Tables put, added to, reset and restored together: rows of each at every step."""
    read = lambda n: spark.read.parquet(f"{d}/{n}.parquet")
    tables = TableSet(spark, f"{_shared(spark)}/set")
    tables.commit({"orders": read("orders"), "lineitem": read("lineitem"), "customer": read("customer")})
    tables.append({"lineitem": read("lineitem").limit(0), "audit": read("nation")})
    held = tables.latest()
    before = tables.counts()
    report = tables.reset(["lineitem", "orders"], {"lineitem": ["orders"], "orders": ["customer"]}, confirm=True)
    tables.restore(held, ["lineitem", "orders"])
    restored = {n: tables.read(n).count() for n in before}
    return spark.createDataFrame([(n, c, report["after"][n], restored[n]) for n, c in before.items()], "name string, before long, after long, restored long")


register("q_table_reset", q_table_reset, """SELECT name, n AS before, CASE WHEN name IN ('customer', 'audit') THEN n ELSE 0 END AS after, n AS restored FROM (SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'audit', count(*) FROM nation)""")
