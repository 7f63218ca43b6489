"""Queries on the composed flow: orders are hits of five kinds, some with a page of their own that agrees, contradicts or is closed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import flow
from ..operators.written import spread
from ..sources import markup
from .catalog import query

_AS_OF, _NOW = "1995-06-17", "1995-06-17 12:00:00"
TITLES = {
    "1-URGENT": "Etude de restauration des remparts de la médina, lot ",
    "2-HIGH": "Gardiennage et nettoyage des locaux, lot ",
    "3-MEDIUM": "Etude de voirie et assainissement des routes, lot ",
    "4-NOT SPECIFIED": "Consultation architecturale pour la réhabilitation de la kasbah, lot ",
    "5-LOW": "Travaux de construction du gros oeuvre, lot ",
}


def _orders(t) -> DataFrame:
    title = F.element_at(F.create_map(*[F.lit(x) for pair in TITLES.items() for x in pair]), F.col("o_orderpriority"))
    return spread(t("orders")).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.to_date("o_orderdate").alias("day"), F.concat(title, "o_orderkey").alias("title"))


def _hits(t) -> DataFrame:
    """A hit per order (every thirteenth twice): official notices, or ones of a gathering site that carry their deadline."""
    o, second = _orders(t), F.col("o_orderstatus") == "P"
    url = F.concat(F.when(second, "https://www.marchefacile.ma/avis/").otherwise("https://www.alomrane.gov.ma/avis/"), "o_orderkey")
    hit = o.select(
        F.col("o_orderkey").alias("position"), F.concat("o_orderkey", F.lit("/2024")).alias("reference"), F.concat(F.lit("Commune "), "o_custkey").alias("institution"), "title", url.alias("url"),
        F.lit("").alias("evidence"), F.lit("open").alias("status"), F.when(second, F.col("day")).alias("deadline"), F.lit(None).cast("date").alias("published"), url.alias("found_at"), F.lit(True).alias("at_home"),
        F.lit(None).cast("double").alias("amount"), F.lit(False).alias("amount_verified"),
    )
    return hit.unionByName(hit.filter("position % 13 = 0").withColumn("position", F.col("position") + 100_000_000))


def _pages(t) -> DataFrame:
    """Pages of two official notices of three: cheap ones are cancelled, every eleventh has another number, every seventh no deadline."""
    o = _orders(t).filter("o_orderstatus <> 'P' AND o_orderkey % 3 > 0")
    html = F.concat(
        F.lit("<h1>Avis</h1><p>Référence : "), "o_orderkey", F.when(F.col("o_orderkey") % 11 == 0, "9/2024").otherwise("/2024"), F.lit("</p><p>Objet : "), "title", F.lit("</p><p>Acheteur public : Commune "), "o_custkey", F.lit("</p>"),
        F.when(F.col("o_orderkey") % 7 == 0, "").otherwise(F.concat(F.lit("<p>Date limite : "), F.date_format("day", "dd/MM/yyyy"), F.lit("</p>"))), F.when(F.col("o_totalprice") < 100000, "<p>Statut : Annulé</p>").otherwise(""),
    )
    return markup.tokenized(o.select(F.concat(F.lit("https://www.alomrane.gov.ma/avis/"), "o_orderkey").alias("url"), html.alias("html")))


def _known(t) -> DataFrame:
    return _hits(t).filter("position < 100000000 AND position % 17 = 0").select(flow.signature(F.col("reference"), F.col("institution"), F.col("title")).alias("signature"))


_HITS = f"""WITH o AS (SELECT o_orderkey AS k, o_orderkey AS position, o_orderstatus AS s, o_totalprice < 100000 AS cancelled, o_orderdate::DATE AS day, o_orderdate::DATE < DATE '{_AS_OF}' AS past, left(o_orderpriority, 1) AS p, o_orderstatus <> 'P' AND o_orderkey % 3 > 0 AS paged FROM orders),
h AS (SELECT * FROM o UNION ALL BY NAME SELECT * REPLACE (position + 100000000 AS position) FROM o WHERE k % 13 = 0)"""
_EARLY = "WHEN position >= 100000000 THEN 'duplicate' WHEN k % 17 = 0 THEN 'known' WHEN p IN ('2', '5') THEN 'prefilter'"


@query(f"""{_HITS}, j AS (SELECT *, CASE {_EARLY} WHEN p = '3' THEN 'relevance' END AS early, CASE WHEN NOT paged THEN 'not_read' WHEN k % 11 = 0 THEN 'reference_mismatch' WHEN cancelled OR (k % 7 > 0 AND past) THEN 'closed_or_expired' WHEN k % 7 = 0 THEN 'not_verified' END AS fault, (s <> 'P' OR NOT past) AS may FROM h),
w AS (SELECT *, CASE WHEN early IS NULL THEN CASE WHEN fault IS NULL THEN 'VERIFIED' WHEN fault NOT IN ('reference_mismatch', 'closed_or_expired') AND may THEN 'CREDIBLE' ELSE 'UNRESOLVED' END END AS resolution FROM j),
x AS (SELECT *, coalesce(early, CASE WHEN fault = 'closed_or_expired' THEN 'freshness' WHEN resolution = 'UNRESOLVED' THEN CASE WHEN fault = 'not_read' THEN 'page' ELSE 'proof' END ELSE 'accepted' END) AS stage FROM w)
SELECT position, CASE WHEN stage = 'accepted' THEN 'accepted' WHEN stage IN ('duplicate', 'known') THEN 'skipped' WHEN stage IN ('page', 'proof') THEN 'retry' ELSE 'rejected' END AS outcome, stage, resolution,
CASE stage WHEN 'duplicate' THEN 'duplicate_discovery_signature' WHEN 'known' THEN 'known_unchanged' WHEN 'freshness' THEN 'closed_or_expired' WHEN 'page' THEN fault WHEN 'proof' THEN fault WHEN 'accepted' THEN CASE resolution WHEN 'VERIFIED' THEN 'verified_offer' ELSE 'credible_fallback' END ELSE 'irrelevant_business_purpose' END AS reason,
CASE WHEN stage = 'accepted' THEN 'P1_HERITAGE' ELSE 'REJECT' END AS category, CASE WHEN stage = 'accepted' AND resolution = 'VERIFIED' THEN 'https://www.alomrane.gov.ma/avis/' || k END AS official_url FROM x""")
def q_notice_flow(t):
    """Every hit with the stage and reason that decided it, in one plan."""
    done = flow.processed(_hits(t), _pages(t), _known(t), F.lit(_AS_OF).cast("date"), F.lit(_NOW).cast("timestamp"))
    return done.select("position", "outcome", "stage", "resolution", "reason", "category", "official_url")


@query(f"""{_HITS}, j AS (SELECT *, CASE WHEN p IN ('2', '5', '3') THEN 'prefilter' WHEN position >= 100000000 THEN 'duplicate' WHEN k % 17 = 0 THEN 'known' END AS early, CASE WHEN NOT paged THEN 'not_read' WHEN k % 11 = 0 THEN 'reference_mismatch' WHEN k % 7 = 0 THEN 'official_deadline_missing' WHEN cancelled OR past THEN 'closed_or_expired' END AS fault FROM h),
x AS (SELECT *, coalesce(early, CASE WHEN fault = 'closed_or_expired' THEN 'freshness' WHEN fault = 'not_read' THEN 'page' WHEN fault IS NOT NULL THEN 'proof' ELSE 'accepted' END) AS stage FROM j)
SELECT stage, CASE stage WHEN 'prefilter' THEN CASE p WHEN '2' THEN 'REJECT_IRRELEVANT_DOMAIN' WHEN '5' THEN 'REJECT_PURE_EXECUTION' ELSE 'REJECT_OUT_OF_SCOPE_INFRASTRUCTURE' END WHEN 'duplicate' THEN 'duplicate_discovery_signature' WHEN 'known' THEN 'known_unchanged' WHEN 'freshness' THEN 'closed_or_expired' WHEN 'accepted' THEN 'verified_offer' ELSE fault END AS reason, count(*) AS n FROM x GROUP BY ALL""")
def q_index_backfill(t):
    """The funnel of the whole index: what the first look rejects is not read, the rest needs its own whole page."""
    more = [F.lit("").alias(c) for c in ("procedure", "category", "location")]
    done = flow.backfill(_hits(t).select("*", *more), _pages(t), _known(t), F.lit(_AS_OF).cast("date"), F.lit(_NOW).cast("timestamp"))
    return done.groupBy("stage", "reason").agg(F.count("*").alias("n"))
