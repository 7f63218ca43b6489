"""Queries on candidate builders: orders are items whose wording, host, date and figures come from their own columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import candidates
from ..operators.written import spread
from .catalog import query

_AS_OF = "1995-06-17"
_OFFICIAL = ["gov.example"]
_ITEM = "SELECT o_orderkey AS id, o_custkey, o_orderdate::DATE AS day, o_orderstatus AS s, left(o_orderpriority, 1) AS p, o_totalprice AS price, 'https://' || CASE o_orderstatus WHEN 'P' THEN 'blog.example' ELSE 'www.gov.example' END || '/' || o_orderkey AS url FROM orders"
_URL = "CASE WHEN s <> 'P' THEN url END"


def _items(t, title, evidence) -> DataFrame:
    host = F.when(F.col("o_orderstatus") == "P", "blog.example").otherwise("www.gov.example")
    return t("orders").select(
        F.col("o_orderkey").alias("id"), title.alias("title"), F.concat(F.lit("https://"), host, F.lit("/"), "o_orderkey").alias("url"), evidence.alias("evidence"),
        F.concat(F.lit("Agence urbaine "), "o_custkey").alias("institution"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("published"), F.col("o_orderpriority").alias("p"), F.col("o_orderstatus").alias("s"),
    )


def _by_priority(**said: str):
    return F.element_at(F.create_map(*[F.lit(x) for k, v in said.items() for x in (k[1:], v)]), F.left("o_orderpriority", F.lit(1)))


@query(f"""WITH i AS ({_ITEM}), b AS (SELECT *, unnest(CASE p WHEN '1' THEN [0, 1] ELSE [0] END) AS block FROM i), r AS (SELECT *, day < DATE '{_AS_OF}' - 90 AS old FROM b)
SELECT id, block, CASE WHEN p = '4' THEN 'rejected_tender' WHEN p IN ('2', '3') AND old THEN 'rejected_old' WHEN p = '5' THEN CASE WHEN old THEN 'rejected_old' ELSE 'rejected_vague' END END AS rejected,
CASE p WHEN '1' THEN CASE block WHEN 0 THEN 'CONVENTION_SIGNED' ELSE 'FINANCING_APPROVED' END WHEN '2' THEN 'BUDGET_ALLOCATED' WHEN '3' THEN 'PROJECT_ANNOUNCED' END AS signal,
CASE p WHEN '1' THEN CASE block WHEN 0 THEN 'B' ELSE 'A' END WHEN '2' THEN 'A' WHEN '3' THEN 'B' ELSE 'D' END AS maturity, CASE WHEN p = '1' AND block = 0 THEN floor(price)::BIGINT || ' dh' END AS budget, day::VARCHAR AS announced, {_URL} AS official_url FROM r""")
def q_project_candidates(t):
    """Projects of all items: lists give two each, old, vague and tendered ones are refused with their reason."""
    title = _by_priority(_1="Projets de la ville", _2="Budget alloué pour la médina", _3="Projet annoncé de restauration", _4="Appel d'offres : restauration", _5="Nouvelles de la médina")
    both = F.concat(F.lit("Liste\n- Convention signée pour la réhabilitation de la médina, "), F.floor("o_totalprice").cast("string"), F.lit(" dh\n* Financement approuvé pour la restauration des monuments\ncourt"))
    items = _items(t, title, F.when(F.col("o_orderpriority").startswith("1"), both).otherwise("texte"))
    out = candidates.projects(items, _OFFICIAL, F.lit(_AS_OF).cast("date"))
    return out.select("id", "block", "rejected", "signal", "maturity", "budget", F.col("announced").cast("string").alias("announced"), "official_url")


@query(f"""WITH i AS ({_ITEM}), c AS (SELECT *, date_diff('day', day, DATE '{_AS_OF}') BETWEEN 0 AND 180 AS fresh, s <> 'P' AS official FROM i)
SELECT id, CASE WHEN p = '4' THEN 'recruitment_notice' WHEN p = '5' THEN 'not_relevant' WHEN p IN ('1', '2') AND NOT official THEN 'generic_article' END AS rejected, 'INSTITUTION' AS profile_type, 'INSTITUTION_PROFILE' AS result_type, {_URL} AS official_url FROM c WHERE p <> '3'""")
def q_institution_candidates(t):
    """Institutions of all items: profiles on official hosts, offers of work and other subjects refused."""
    title = _by_priority(_1="Agence", _2="Agence", _3="Agence", _4="Recrutement", _5="Football")
    said = F.when(F.col("o_orderpriority").startswith("5"), "La pêche et le sport").otherwise("L'agence urbaine et le patrimoine architectural de la ville")
    items = _items(t, title, said).filter("p NOT LIKE '3%'").withColumn("profile", F.lit(True))
    return candidates.institutions(items, _OFFICIAL, F.lit(_AS_OF).cast("date")).select("id", "rejected", "profile_type", "result_type", "official_url")


@query(f"""WITH i AS ({_ITEM})
SELECT id, CASE WHEN p = '5' OR s = 'P' THEN 'unrelated_or_nonofficial' END AS rejected, CASE WHEN p IN ('1', '2') THEN 'LAW' WHEN p = '3' OR (p = '4' AND id % 2 = 0) THEN 'DECREE' WHEN id % 2 = 0 THEN 'DECREE' END AS document_type,
CASE WHEN id % 2 = 0 THEN 'DRAFT' WHEN p IN ('1', '2', '3') THEN 'POLICY_SIGNAL' END AS status, CASE WHEN p = '1' THEN id || '.80' END AS reference, CASE WHEN id % 2 = 0 THEN 0.95 WHEN p IN ('1', '2', '3') THEN 0.3 END AS confidence, day::VARCHAR AS published_on FROM i WHERE p <> '4' AND NOT (p = '5' AND id % 2 = 0) AND NOT (p IN ('1', '2') AND id % 2 = 0)""")
def q_policy_candidates(t):
    """Instruments of all items: numbers only where the title is the instrument's own, nothing in force by a page's word, drafts by their list."""
    k = F.col("o_orderkey").cast("string")
    title = F.when(F.left("o_orderpriority", F.lit(1)) == "1", F.concat(F.lit("Loi n° "), k, F.lit(".80 relative à la conservation des monuments historiques"))).otherwise(_by_priority(_1="", _2="Présentation de la loi n° 1.2 sur le patrimoine", _3="Décret sur la médina", _4="x", _5="Les nouvelles du sport"))
    items = _items(t, title, F.lit("")).withColumns({"listing": F.when(F.col("id") % 2 == 0, "https://gov.example/list"), "listed_type": F.lit("DECREE")})
    kept = items.filter("p NOT LIKE '4%' AND NOT (p LIKE '5%' AND id % 2 = 0) AND NOT ((p LIKE '1%' OR p LIKE '2%') AND id % 2 = 0)")
    out = candidates.instruments(kept, _OFFICIAL)
    weak = F.when(F.col("document_type").isNotNull(), F.col("status"))
    return out.select("id", "rejected", "document_type", weak.alias("status"), "reference", F.when(F.col("document_type").isNotNull(), F.col("confidence")).alias("confidence"), F.col("published_on").cast("string").alias("published_on"))


@query(f"""WITH i AS ({_ITEM}) SELECT id, CASE WHEN s = 'P' THEN 'not_readable' WHEN p = '5' THEN 'outside_scope' END AS rejected, CASE WHEN s <> 'P' THEN 'Gov Fund' ELSE 'Agence urbaine ' || o_custkey END AS funder,
CASE WHEN p IN ('1', '2') THEN round(price, 2) WHEN p = '3' THEN floor(price) * 1000000.0 END AS amount, CASE WHEN p IN ('1', '2') THEN 'USD' WHEN p = '3' THEN 'EUR' END AS currency, CASE WHEN p IN ('1', '2') THEN 'Borrower ' || o_custkey ELSE 'Agence urbaine ' || o_custkey END AS beneficiary,
CASE WHEN p = '1' THEN 'B' END AS active, CASE WHEN p IN ('1', '2') THEN day::VARCHAR END AS closing FROM i""")
def q_funding_candidates(t):
    """Programmes of all items: donors' own records give figures, texts are read for theirs; hosts, scope and funder refuse."""
    p = F.left("o_orderpriority", F.lit(1))
    title = F.when(p == "5", "Nouvelles du sport").otherwise("Maroc : réhabilitation du patrimoine urbain")
    said = F.when(p == "3", F.concat(F.lit("programme de "), F.floor("o_totalprice").cast("string"), F.lit(" million EUR"))).otherwise("texte")
    record = F.to_json(F.struct(
        F.concat(F.lit("P"), "o_orderkey").alias("id"), F.lit("Morocco urban heritage").alias("project_name"), F.when(p == "1", "Active").otherwise("Pipeline").alias("projectstatusdisplay"), F.format_number("o_totalprice", 2).alias("totalamt"),
        F.concat(F.lit("Borrower "), "o_custkey").alias("borrower"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("closingdate"), F.struct(F.lit("Urban").alias("Name")).alias("sector1"), F.array(F.struct(F.lit("heritage").alias("name"))).alias("mjtheme_namecode"),
    ))
    dealt = lambda n: spread(t(n))
    raw = t("orders").select(F.col("o_orderkey").alias("id"), F.when(p.isin("1", "2"), record).alias("raw"))
    out = candidates.programmes(_items(dealt, title, said).join(raw, "id"), _OFFICIAL, {"gov.example": "Gov Fund"})
    active = F.when(F.col("project").isNotNull() & (F.col("letter") == "B") & (F.col("status") == "active"), "B")
    return out.select("id", "rejected", "funder", "amount", "currency", "beneficiary", active.alias("active"), F.col("closing").cast("string").alias("closing"))
