"""Queries on clocks and caps of runs, keys of comparison, headlines, and promulgations in bulletins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clocks, leadership, policies
from .catalog import query

_NOW = "1998-08-02 00:00:00"


@query(f"""WITH r AS (SELECT o_custkey AS scope, o_orderdate AS started, o_orderstatus <> 'P' AND o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 AS whole FROM orders), l AS (SELECT scope, max(started) FILTER (whole) AS last FROM r GROUP BY 1)
SELECT scope, last::DATE::VARCHAR AS last, coalesce(date_diff('hour', last::TIMESTAMP, TIMESTAMP '{_NOW}') >= 720, true) AS due FROM l""")
def q_reconciliation_due(t):
    """Customers whose last whole comparison is thirty days old, or who never had one."""
    k = F.col("o_orderkey")
    meta = F.to_json(F.struct(F.struct(F.when(k % 3 == 0, "reconciliation").otherwise("incremental").alias("pmmp_sync_mode"), (k % 2 == 0).alias("pmmp_sync_complete")).alias("collector_metrics")))
    runs = t("orders").select(F.col("o_custkey").alias("scope"), F.when(F.col("o_orderstatus") == "P", "failed").otherwise("completed").alias("status"), F.col("o_orderdate").alias("started"), F.lit(None).cast(t("orders").schema["o_orderdate"].dataType).alias("finished"), meta.alias("metadata"))
    return clocks.reconciliation_due(runs, F.lit(_NOW).cast("timestamp"), 720).select("scope", F.to_date("last").cast("string").alias("last"), "due")


@query("""WITH r AS (SELECT o_orderkey AS run, o_orderdate::DATE AS day, o_custkey % 9 AS calls, o_orderkey % 7 AS wanted, o_orderstatus <> 'P' AS paid FROM orders), s AS (SELECT *, greatest(0, 30 - (sum(calls) OVER (PARTITION BY day) - calls)) AS left_ FROM r)
SELECT run, CASE WHEN paid THEN left_::BIGINT END AS remaining, CASE WHEN paid THEN least(wanted, left_)::BIGINT ELSE wanted::BIGINT END AS allowed, CASE WHEN paid AND left_ = 0 THEN 'daily_search_limit_reached' END AS error FROM s""")
def q_allowed_calls(t):
    """What each order's day leaves of its searches, its own not counted."""
    rows = t("orders").select(F.col("o_orderkey").alias("run"), F.to_date("o_orderdate").alias("day"), (F.col("o_custkey") % 9).cast("long").alias("search_calls"), (F.col("o_orderkey") % 7).cast("long").alias("wanted"), (F.col("o_orderstatus") != "P").alias("paid"))
    return clocks.allowed_calls(rows.select("run", "day", "search_calls"), rows.select("run", "day", "wanted", "paid"), 30).select("run", "remaining", "allowed", "error")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'cid:' || o_orderkey WHEN o_orderkey % 4 = 1 THEN 'url:https://a.example/' || o_orderkey WHEN o_orderkey % 4 = 2 THEN 'ref:r/' || o_orderkey || '|' || CASE WHEN o_custkey % 2 = 0 THEN 'client ' || o_custkey ELSE '' END ELSE 'title:' || lower(o_orderpriority) END AS key FROM orders""")
def q_comparison_keys(t):
    k = F.col("o_orderkey")
    text = lambda c: c.cast("string")
    r = {"consultation": F.when(k % 4 == 0, text(k)).otherwise(""), "url": F.when(k % 4 < 2, F.concat(F.lit(" HTTPS://a.example/"), k)), "reference": F.when(k % 4 < 3, F.concat(F.lit("R/"), k, F.lit(" "))), "buyer": F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("Client "), "o_custkey")), "title": F.col("o_orderpriority")}
    return t("orders").select(k.alias("id"), clocks.comparison_key(r).alias("key"))


@query("""SELECT o_orderkey AS id, CASE left(o_orderpriority, 1) WHEN '1' THEN 'recruitment_notice' WHEN '2' THEN 'obsolete_role' WHEN '3' THEN 'generic_article' WHEN '4' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'recruitment_notice' END END AS reason FROM orders""")
def q_headline_rejection(t):
    """Headlines of offers of work, former offices and events; a word inside another is none."""
    titles = {"1": "Appel à candidatures : architecte", "2": "L'ancien directeur parle", "3": "Colloque sur la médina", "5": "Recrutements et conférenciers"}
    p = F.left("o_orderpriority", F.lit(1))
    title = F.when(p == "4", F.when(F.col("o_orderkey") % 2 == 0, "Offre d'emploi").otherwise("Offres de services")).otherwise(F.try_element_at(F.create_map(*[F.lit(x) for pair in titles.items() for x in pair]), p))
    return t("orders").select(F.col("o_orderkey").alias("id"), leadership.headline_rejection(F.concat(title, F.lit(" "), "o_orderkey")).alias("reason"))


@query("""SELECT o_orderkey AS id, n AS section, '33.22' AS reference FROM orders, (VALUES (0), (1)) v(n) WHERE o_orderkey % 5 > 0 AND o_orderkey % 3 > 0 AND (n = 0 OR o_custkey % 2 = 0)""")
def q_arabic_sections(t):
    """Promulgations in Arabic bulletins: one or two formulas in each, another bulletin's number or another law gives none."""
    k = F.col("o_orderkey")
    formula = F.concat(F.lit("ينفذ وينشر  بالجريدة الرسمية القانون رقم "), F.when(k % 3 == 0, "٤٤.٢٢").otherwise("٣٣ - ٢٢"), F.lit(" المتعلق بحماية التراث. "))
    text = F.concat(F.lit("عدد "), F.when(k % 5 == 0, "17415").otherwise("7415"), F.lit(" نص "), formula, F.repeat(F.lit("كلام "), F.lit(200)), F.when(F.col("o_custkey") % 2 == 0, formula).otherwise(""))
    registry = t("orders").sparkSession.sql("SELECT * FROM VALUES ('a', '33.22', '7415', 'Loi n° 33.22') AS r(key, reference, number, title)")  # of a known size: it is what travels, not the texts
    found = policies.arabic_sections(t("orders").select(F.lit("a").alias("key"), k.cast("string").alias("url"), text.alias("text")), registry)
    return found.select(F.col("url").cast("long").alias("id"), "section", "reference")
