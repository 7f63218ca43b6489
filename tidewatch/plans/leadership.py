"""Queries on who leads: texts written from lines of orders, one piece of evidence each; suppliers are institutions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import leadership
from ..sources import markup
from .catalog import query

_MONTHS = "['janvier', 'février', 'mars', 'avril', 'mai', 'juin', 'juillet', 'août', 'septembre', 'octobre', 'novembre', 'décembre']"
_AS_OF = "1999-01-01"
_SOURCE = "CASE l_returnflag WHEN 'R' THEN 'GOVERNANCE' WHEN 'A' THEN 'APPOINTMENT' ELSE 'PROFESSIONAL' END"


def _evidence(t) -> DataFrame:
    """A text per line: a person named after the part beside a role, in four wordings, dated by its ship date."""
    who = F.initcap("p_name")
    day = F.concat(F.day("l_shipdate").cast("string"), F.lit(" "), F.element_at(F.array(*[F.lit(m) for m in ("janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre")]), F.month("l_shipdate")), F.lit(" "), F.year("l_shipdate"))
    n = F.col("l_linenumber") % 4
    said = (
        F.when(n == 0, F.concat(F.lit(" : Madame "), who, F.lit(" a été nommée présidente par intérim du conseil.")))
        .when(n == 1, F.concat(F.lit(" : "), who, F.lit(", directeur général de l'agence.")))
        .when(n == 2, F.concat(F.lit(" : le journaliste "), who, F.lit(", directeur de la revue.")))
        .otherwise(F.concat(F.lit(" : "), who, F.lit(" est directeur, qui a quitté ses fonctions.")))
    )
    lines = t("lineitem").join(t("part"), F.col("p_partkey") == F.col("l_partkey"))
    return lines.select(F.col("l_suppkey").alias("institution"), F.expr(_SOURCE).alias("source_type"), F.concat(F.lit("https://i.example/"), "l_orderkey", F.lit("/"), "l_linenumber", F.lit("/"), "l_partkey").alias("url"), F.concat(F.when(F.col("l_linestatus") == "O", F.concat(F.lit("  le  "), day)).otherwise("sans date"), said).alias("text"))


_SQL = f"""WITH r AS (SELECT l_suppkey AS institution, {_SOURCE} AS source_type, 'https://i.example/' || l_orderkey || '/' || l_linenumber || '/' || l_partkey AS url,
  array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS person_name,
  CASE l_linenumber % 4 WHEN 0 THEN 'présidente par intérim' WHEN 1 THEN 'directeur général' ELSE 'directeur' END AS role_title,
  CASE WHEN l_linestatus = 'O' THEN l_shipdate::DATE END AS dated, l_linenumber % 4 = 3 AS departed, l_linenumber % 4 = 0 AS interim FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linenumber % 4 <> 2)"""


@query(f"{_SQL} SELECT institution, source_type, url, person_name, role_title, dated::VARCHAR AS dated, departed, interim FROM r")
def q_named_roles(t):
    """Names beside roles in every text, with their date, departures and interim holders; those a journalist's line names are none."""
    return leadership.named(_evidence(t)).select("institution", "source_type", "url", "person_name", "role_title", F.col("evidence_date").cast("string").alias("dated"), "departed", "interim")


_RESOLVED = f"""{_SQL}, k AS (SELECT *, lower(person_name) AS name, (source_type = 'PROFESSIONAL')::INT AS u, CASE source_type WHEN 'GOVERNANCE' THEN 1 WHEN 'APPOINTMENT' THEN 3 ELSE 6 END AS rank, dated IS NULL OR dated <= DATE '{_AS_OF}' AS counts FROM r),
p AS (SELECT *, rank() OVER (PARTITION BY institution ORDER BY u, dated DESC NULLS LAST, rank) AS place, row_number() OVER (PARTITION BY institution ORDER BY u, dated DESC NULLS LAST, rank, url) AS turn FROM k WHERE counts),
f AS (SELECT institution, min(name) AS low, max(name) AS high, max(u) AS u, max(dated) AS dated, bool_or(departed AND turn = 1) AS gone, max(CASE WHEN turn = 1 THEN person_name END) AS person, max(CASE WHEN turn = 1 THEN role_title END) AS role, bool_or(turn = 1 AND (source_type = 'APPOINTMENT' OR interim)) AS fresh FROM p WHERE place = 1 GROUP BY 1),
s AS (SELECT i.institution, i.changed, f.*, CASE WHEN f.low IS NULL THEN 'UNVERIFIED' WHEN gone OR date_diff('day', dated, DATE '{_AS_OF}') > 180 THEN 'OBSOLETE' WHEN low <> high THEN 'UNVERIFIED' WHEN u = 1 OR dated IS NULL THEN 'PROBABLY_CURRENT' ELSE 'VERIFIED_CURRENT' END AS status
 FROM (SELECT institution, min(name) <> max(name) AS changed FROM k GROUP BY 1) i LEFT JOIN f USING (institution))"""


@query(f"""{_RESOLVED} SELECT s_suppkey AS institution, coalesce(status, 'none') AS status, CASE WHEN status IN ('VERIFIED_CURRENT', 'PROBABLY_CURRENT') THEN person END AS person_name, CASE WHEN status IN ('VERIFIED_CURRENT', 'PROBABLY_CURRENT') THEN role END AS role_title,
CASE WHEN status IS NULL OR status = 'UNVERIFIED' THEN 'CURRENT_PROFILE' WHEN changed THEN 'LEADERSHIP_CHANGE' WHEN fresh THEN 'NEW_APPOINTMENT' ELSE 'CURRENT_PROFILE' END AS activity, s_name || CASE WHEN status IN ('VERIFIED_CURRENT', 'PROBABLY_CURRENT') THEN ' — ' || role || ' : ' || person || ' — ' || CASE status WHEN 'VERIFIED_CURRENT' THEN 'rôle actuel vérifié' ELSE 'probablement actuel, non confirmé' END WHEN status IS NULL THEN '' ELSE ' — Responsable actuel non vérifié' END AS title
FROM supplier LEFT JOIN s ON s.institution = s_suppkey""")
def q_leaders(t):
    """Who leads each supplier by all evidence on it: conflicts, departures, old and undated evidence told apart."""
    e = leadership.named(_evidence(t)).withColumn("position", F.col("url"))
    profiles = t("supplier").select(F.col("s_suppkey").alias("slot"), F.col("s_name").alias("institution"), F.lit("CURRENT_PROFILE").alias("activity"))
    held = leadership.resolved(e.withColumnRenamed("institution", "slot"), ["slot"], F.lit(_AS_OF).cast("date"))
    out = leadership.applied(profiles, held, ["slot"])
    return out.select(F.col("slot").alias("institution"), F.coalesce("status", F.lit("none")).alias("status"), "person_name", "role_title", "activity", "title")


@query(f"""{_SQL}, official AS (SELECT * FROM r WHERE source_type <> 'PROFESSIONAL'), a AS (SELECT * FROM r WHERE source_type = 'PROFESSIONAL')
SELECT institution, count(*) AS n, count(*) FILTER (source_type = 'PROFESSIONAL') AS again FROM (SELECT * FROM official UNION ALL SELECT * FROM a WHERE EXISTS (SELECT 1 FROM official o WHERE o.institution = a.institution AND lower(o.person_name) = lower(a.person_name))) GROUP BY 1""")
def q_confirmed_roles(t):
    """What other pages say of people whom official evidence names, added to it."""
    e = leadership.named(_evidence(t))
    both = leadership.confirmed(e.filter("source_type <> 'PROFESSIONAL'"), e.filter("source_type = 'PROFESSIONAL'"), ["institution"])
    return both.groupBy("institution").agg(F.count("*").alias("n"), F.count_if(F.col("source_type") == "PROFESSIONAL").alias("again"))


@query("""WITH p AS (SELECT s_suppkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS who FROM supplier JOIN part ON p_partkey = s_suppkey)
SELECT s_suppkey AS key, who AS person_name, CASE WHEN s_suppkey % 2 = 0 THEN 'Directeur' ELSE 'Présidente' END AS role_title, CASE WHEN s_suppkey % 2 = 0 THEN 'DIRECTOR' END AS kind, '2024-03-05' AS dated FROM p WHERE s_suppkey % 5 > 0""")
def q_curated_roles(t):
    """An institution's own role before or after a name on its page, by a pattern of the registry; offers of work are none."""
    s = t("supplier").join(t("part"), F.col("p_partkey") == F.col("s_suppkey"))
    who, even = F.initcap("p_name"), F.col("s_suppkey") % 2 == 0
    said = F.when(even, F.concat(F.lit("Directeur, "), who, F.lit(" depuis"))).otherwise(F.concat(who, F.lit(" , Présidente de la maison")))
    html = F.concat(F.lit("<h1>"), F.when(F.col("s_suppkey") % 5 == 0, "Recrutement").otherwise("Message"), F.lit("</h1><p>Le 5 mars 2024</p><p>:</p><p>"), said, F.lit("</p><h2>Autre</h2><p>Jean Petit, Directeur</p>"))
    pages = markup.tokenized(s.select(F.col("s_suppkey").alias("id"), F.when(even, "a").otherwise("b").alias("key"), html.alias("html")))
    registry = t("supplier").sparkSession.createDataFrame([("a", "A", "Direct(?:eur|rice)", "https://a.example", "GOVERNANCE"), ("b", "B", "Présidente?", "https://b.example", "OFFICIAL_RELEASE")], "key string, institution string, role_pattern string, url string, source_type string")
    return leadership.curated(pages, registry, keep=["id"]).select(F.col("id").alias("key"), "person_name", "role_title", "kind", F.col("evidence_date").cast("string").alias("dated"))
