"""Rules over records whose every field is a column's value: lines of orders with their orders, counted by outcome.

Fields are SQL expressions that both engines read alike; the SQL of a query states the rule itself, in its own words.
Sums of keys beside the counts tell which rows had an outcome.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identity, money, text, urls
from ..operators import conditions as C
from ..operators import gating, procurement
from ..operators.policies import reference
from .catalog import query

_AS_OF = "1998-06-15"
_ROWS = "SELECT * FROM lineitem JOIN orders ON o_orderkey = l_orderkey"


def _lines(t, fields: dict[str, str]) -> DataFrame:
    return t("lineitem").join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey")).select("l_orderkey", F.struct(*[F.expr(x).alias(n) for n, x in fields.items()]).alias("r"))


def _sql(fields: dict[str, str], more: str) -> str:
    return f"WITH b AS ({_ROWS}), r AS (SELECT l_orderkey, {', '.join(f'{x} AS {n}' for n, x in fields.items())} FROM b), {more}"


def _counted(rows: DataFrame, outcome: Column) -> DataFrame:
    o = F.col("o")
    said = rows.select("l_orderkey", outcome.alias("o"))
    return said.groupBy(o["valid"].alias("valid"), o["review"].alias("review"), o["ask"].alias("ask"), F.array_join(o["reasons"], ",").alias("reasons")).agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("keys"))


def _verdict(rejected: list[tuple[str, str]], doubts: list[tuple[str, str]], ask: str) -> str:
    """SQL of an outcome: the first rejection, else all doubts."""
    why = "CASE " + " ".join(f"WHEN {test} THEN '{name}'" for name, test in rejected) + " END"
    doubt = "concat_ws(',', " + ", ".join(f"CASE WHEN {test} THEN '{name}' END" for name, test in doubts) + ")"
    return f"j AS (SELECT *, {why} AS why, {doubt} AS doubt, {ask} AS may FROM r) SELECT why IS NULL AS valid, why IS NULL AND doubt <> '' AS review, why IS NULL AND may AS ask, coalesce(why, doubt) AS reasons, count(*) AS n, sum(l_orderkey)::BIGINT AS keys FROM j GROUP BY ALL"


_BUSINESS = "CASE l_returnflag WHEN 'A' THEN 'keep' WHEN 'R' THEN 'review' ELSE 'reject' END"
_HOME = "CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_partkey % 5 > 1 END"

NOTICE = {
    "business": _BUSINESS, "list_title": "l_linenumber = 7", "published": "CAST(o_orderdate AS DATE)", "deadline": "CASE WHEN l_linestatus = 'O' THEN CAST(l_shipdate AS DATE) END", "deadline_at": "CASE WHEN l_quantity > 45 THEN CAST(l_shipdate AS TIMESTAMP) END",
    "status": "CASE l_suppkey % 5 WHEN 0 THEN 'closed' WHEN 1 THEN NULL WHEN 2 THEN 'awarded' ELSE 'open' END", "procedure": "CASE WHEN l_partkey % 3 = 0 THEN 'unknown' ELSE 'open_call' END", "at_home": _HOME, "detail_verified": "l_orderkey % 4 > 0",
    "confirmed": "l_orderkey % 3 > 0", "official_page": "l_linenumber < 6", "credible": "l_orderkey % 7 < 3", "attempted": "l_orderkey % 7 < 2", "fallback_sound": "l_partkey % 2 = 0", "current_evidence": "l_suppkey % 3 = 0",
}
_WAITS = "(credible AND attempted)"


@query(_sql(NOTICE, _verdict([
    ("not_relevant_individual_procurement", "list_title OR business = 'reject'"), ("future_publication", f"published > DATE '{_AS_OF}'"), ("old_without_active_deadline", f"date_diff('day', published, DATE '{_AS_OF}') > 30 AND NOT coalesce(deadline >= DATE '{_AS_OF}', false)"),
    ("unresolved_identity_or_stale_evidence", f"{_WAITS} AND NOT fallback_sound"), ("unverified_procurement_detail", f"NOT {_WAITS} AND (NOT detail_verified OR NOT confirmed OR NOT official_page OR at_home IS false)"),
    ("expired_opportunity", f"NOT {_WAITS} AND (deadline < DATE '{_AS_OF}' OR status = 'closed')"), ("expired_deadline_time", f"NOT {_WAITS} AND deadline_at < TIMESTAMP '{_AS_OF} 12:00:00'"),
], [
    ("official_url_not_confirmed", _WAITS), ("business_fit_requires_human_review", f"NOT {_WAITS} AND business = 'review'"), ("home_unclear", f"NOT {_WAITS} AND at_home IS NULL"), ("deadline_unknown", "deadline IS NULL"),
    ("status_unclear", f"NOT {_WAITS} AND coalesce(status <> 'open', true)"), ("procedure_unclear", f"NOT {_WAITS} AND procedure = 'unknown'"),
], f"NOT {_WAITS} AND business = 'keep' AND confirmed AND coalesce(status = 'open', false)")))
def q_notice_checks(t):
    return _counted(_lines(t, NOTICE), C.notice(F.col("r"), F.lit(_AS_OF).cast("date"), F.lit(f"{_AS_OF} 12:00:00").cast("timestamp")))


@query(_sql(NOTICE, f"""j AS (SELECT *, list_title OR (NOT detail_verified AND NOT credible) OR coalesce(status IN ('closed', 'awarded'), false) OR at_home IS false OR coalesce(deadline < DATE '{_AS_OF}', false) OR coalesce(deadline_at <= TIMESTAMP '{_AS_OF} 12:00:00', false)
OR (date_diff('day', published, DATE '{_AS_OF}') > 30 AND NOT current_evidence AND NOT coalesce(deadline >= DATE '{_AS_OF}', false)) AS obsolete FROM r)
SELECT obsolete, business <> 'reject' AND NOT obsolete AND coalesce(status = 'open', false) AND (coalesce(deadline >= DATE '{_AS_OF}', false) OR current_evidence OR date_diff('day', published, DATE '{_AS_OF}') BETWEEN 0 AND 30) AS current, count(*) AS n, sum(l_orderkey)::BIGINT AS keys FROM j GROUP BY ALL"""))
def q_notice_currency_checks(t):
    """Notices in the queue that have lost their sense, and those that can be answered today."""
    at, now, r = F.lit(_AS_OF).cast("date"), F.lit(f"{_AS_OF} 12:00:00").cast("timestamp"), F.col("r")
    return _lines(t, NOTICE).groupBy(C.obsolete(r, at, now).alias("obsolete"), C.current(r, at, now).alias("current")).agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("keys"))


POLICY = {
    "business": _BUSINESS, "status": "CASE l_suppkey % 6 WHEN 0 THEN 'adopted' WHEN 1 THEN 'PUBLISHED' WHEN 2 THEN 'IN_FORCE' WHEN 3 THEN 'POLICY_SIGNAL' WHEN 4 THEN 'DRAFT' END", "document_type": "CASE WHEN l_partkey % 4 = 0 THEN 'draft_law' ELSE 'LAW' END",
    "reliable": "l_linenumber < 6", "official": "l_orderkey % 5 > 0", "evidence": "CASE WHEN l_partkey % 7 = 0 THEN '' ELSE 'e' END", "published": "l_orderkey % 3 > 0",
    "status_url": "CASE WHEN l_linestatus = 'O' THEN concat('https://www.sgg.gov.ma/BO/fr/', CAST(l_partkey AS STRING), '.pdf') ELSE 'https://elsewhere.example/BO/1.pdf' END", "effective": "CASE WHEN l_quantity > 10 THEN CAST(l_shipdate AS DATE) END",
}
_PROVEN = "(reliable AND official AND evidence <> '')"


@query(_sql(POLICY, _verdict([
    ("outside_scope", "business = 'reject'"), ("publication_not_verified", "upper(status) IN ('PUBLISHED', 'IN_FORCE') AND NOT (published AND status_url LIKE 'https://www.sgg.gov.ma/%')"), ("effective_date_not_verified", f"status = 'IN_FORCE' AND NOT coalesce(effective <= DATE '{_AS_OF}', false)"),
    ("contradictory_legal_status", "upper(status) IN ('ADOPTED', 'PUBLISHED', 'IN_FORCE') AND document_type = 'draft_law'"), ("legal_claim_without_reliable_status", f"upper(status) IN ('ADOPTED', 'PUBLISHED', 'IN_FORCE') AND NOT {_PROVEN}"),
], [("policy_status_requires_review", f"NOT {_PROVEN} OR coalesce(status = 'POLICY_SIGNAL', false) OR business = 'review'")], f"NOT {_PROVEN} OR coalesce(status = 'POLICY_SIGNAL', false) OR business = 'review'")))
def q_policy_checks(t):
    return _counted(_lines(t, POLICY), C.policy(F.col("r"), F.lit(_AS_OF).cast("date")))


INSTITUTION = {
    "business": _BUSINESS, "public_only": "l_linenumber < 7", "relevant": "l_partkey % 11 > 0", "obsolete": "l_partkey % 13 = 0", "person": "CASE WHEN l_suppkey % 2 = 0 THEN concat('P', CAST(l_suppkey AS STRING)) END", "position": "CASE WHEN l_partkey % 3 > 0 THEN 'chief' ELSE '' END",
    "status": "CASE l_orderkey % 5 WHEN 0 THEN 'VERIFIED_CURRENT' WHEN 1 THEN 'PROBABLY_CURRENT' WHEN 2 THEN 'OBSOLETE' WHEN 3 THEN 'UNVERIFIED' END", "verified_on": "CASE WHEN l_linestatus = 'O' THEN CAST(l_shipdate AS DATE) END", "official": "l_quantity > 5",
    "mission": "CASE WHEN l_partkey % 2 = 0 THEN 'm' END", "profile_evidence": "l_orderkey % 3 = 0", "activity": "CASE WHEN l_orderkey % 4 = 0 THEN 'a' END", "activity_date": "CASE WHEN l_linenumber > 2 THEN CAST(o_orderdate AS DATE) END",
}
_OWN = f"(official AND person IS NOT NULL AND position <> '' AND coalesce(date_diff('day', verified_on, DATE '{_AS_OF}') BETWEEN 0 AND 180, false))"
_PROFILE = "(official AND ((mission IS NOT NULL AND profile_evidence) OR (activity IS NOT NULL AND activity_date IS NOT NULL)))"


@query(_sql(INSTITUTION, _verdict([
    ("outside_scope", "business = 'reject'"), ("private_personal_data", "NOT public_only"), ("institution_not_relevant", "NOT relevant"), ("obsolete_role_holder", "obsolete OR (person IS NOT NULL AND status = 'OBSOLETE')"),
    ("current_role_evidence_missing_or_stale", f"person IS NOT NULL AND status = 'VERIFIED_CURRENT' AND NOT {_OWN}"), ("unverified_named_profile", f"person IS NOT NULL AND coalesce(status, '') NOT IN ('VERIFIED_CURRENT', 'PROBABLY_CURRENT') AND NOT {_OWN}"),
], [("current_role_not_confirmed", "person IS NOT NULL AND status = 'PROBABLY_CURRENT'"), ("institutional_relevance_requires_review", f"person IS NULL AND NOT {_PROFILE}")], f"person IS NULL AND NOT {_PROFILE}")))
def q_institution_checks(t):
    return _counted(_lines(t, INSTITUTION), C.institution(F.col("r"), F.lit(_AS_OF).cast("date")))


MIXED = {
    "business": _BUSINESS, "maturity": "CASE l_suppkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'C' WHEN 2 THEN 'D' ELSE 'B' END", "source_quality": "CASE WHEN l_linestatus = 'O' THEN 'OFFICIAL_PRIMARY' ELSE 'RELIABLE_SECONDARY' END", "evidence": "CASE WHEN l_partkey % 9 > 0 THEN 'e' END",
    "tender": "l_linenumber = 7", "completed": "l_orderkey % 6 = 0", "new_phase": "l_orderkey % 12 = 0", "vague": "CASE WHEN l_partkey % 8 = 0 THEN NULL ELSE l_partkey % 8 = 1 END", "status": "CASE WHEN l_quantity > 40 THEN 'closed' ELSE 'open' END", "strategic": "l_quantity > 45",
    "at_home": _HOME, "mode": "CASE WHEN l_orderkey % 2 = 0 THEN 'DIRECT_ACCESS' ELSE 'GRANT' END", "eligible": "l_partkey % 2 = 0", "eligibility": "CASE WHEN l_partkey % 4 = 0 THEN 'c' END", "official": "l_suppkey % 3 > 0",
}
_PROJECT_NO = "CASE WHEN business = 'reject' THEN 'outside_scope' WHEN tender THEN 'already_published_tender' WHEN completed AND NOT new_phase THEN 'completed_without_new_phase' WHEN maturity = 'D' OR coalesce(vague, false) THEN 'weak_or_vague_signal' END"
_PROJECT_DOUBT = "list_filter([CASE WHEN evidence IS NULL THEN 'signal_evidence_missing' END, CASE WHEN evidence IS NOT NULL AND ((maturity = 'C' AND source_quality = 'RELIABLE_SECONDARY') OR business = 'review') THEN 'ambiguous_secondary_signal' END], lambda x: x IS NOT NULL)"
_FUNDING_NO = "CASE WHEN business = 'reject' THEN 'outside_scope' WHEN status = 'closed' AND NOT strategic THEN 'closed_without_strategic_relevance' WHEN at_home IS false THEN 'unrelated_to_home' END"
_FUNDING_DOUBT = "list_filter([CASE WHEN business = 'review' THEN 'business_relevance_requires_review' END, CASE WHEN at_home IS NULL THEN 'home_unclear' END, CASE WHEN mode = 'DIRECT_ACCESS' AND NOT (eligible AND eligibility IS NOT NULL AND official) THEN 'direct_eligibility_unverified' END], lambda x: x IS NOT NULL)"


@query(_sql(MIXED, f"""j AS (SELECT *, {_PROJECT_NO} AS pn, {_PROJECT_DOUBT} AS pd, {_FUNDING_NO} AS fn, {_FUNDING_DOUBT} AS fd FROM r),
k AS (SELECT *, CASE WHEN pn IS NULL THEN pd ELSE [pn] END AS pr, CASE WHEN fn IS NULL THEN fd ELSE [fn] END AS fr FROM j)
SELECT pn IS NULL AND fn IS NULL AS valid, (pn IS NULL AND len(pd) > 0) OR (fn IS NULL AND len(fd) > 0) AS review, pn IS NULL AND len(pd) > 0 AND fn IS NULL AND len(fd) > 0 AS ask,
array_to_string(list_concat(pr, list_filter(fr, lambda x: NOT list_contains(pr, x))), ',') AS reasons, count(*) AS n, sum(l_orderkey)::BIGINT AS keys FROM k GROUP BY ALL"""))
def q_combined_checks(t):
    """Two kinds of conditions on one record: a project that is also a programme of funds."""
    return _counted(_lines(t, MIXED), C.both(C.project(F.col("r")), C.funding(F.col("r"))))


STRICT = {
    "kind": "CASE l_suppkey % 3 WHEN 0 THEN 'tender' WHEN 1 THEN 'news' ELSE 'study' END", "note": "CASE l_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'false' ELSE 'n' END", "spam": "CASE WHEN l_linenumber = 6 THEN NULL ELSE l_linenumber = 7 END", "at_home": _HOME,
    "source_quality": "CASE WHEN l_linestatus = 'O' THEN 'OFFICIAL_PRIMARY' ELSE 'BLOG' END", "current_evidence": "l_orderkey % 2 = 0", "publication_date": "CASE WHEN l_quantity > 5 THEN CAST(o_orderdate AS DATE) END", "reference": "CASE WHEN l_orderkey % 3 > 0 THEN 'x' END",
    "url": "CASE WHEN l_orderkey % 9 = 0 THEN 'u' ELSE '' END", "title": "CASE WHEN l_partkey % 6 > 0 THEN 't' END", "conflict": "l_partkey % 10 = 0",
}
_STRICT = C.Conditions(include=(C.Test("kind", "in", ("tender", "study")), C.Test("note", "present")), exclude=(C.Test("spam", "equals", True),), sources=("OFFICIAL_PRIMARY",), mandatory=(("reference", "url"), ("title",)), doubts=(C.Test("conflict", "present"),), fresh_days=30)


@query(_sql(STRICT, _verdict([
    ("excluded:spam", "coalesce(spam, false)"), ("outside_home", "at_home IS false"), ("no_concrete_inclusion_signal", "kind = 'news' AND coalesce(note, '') <> 'n'"), ("old_without_current_evidence", f"coalesce(date_diff('day', publication_date, DATE '{_AS_OF}') > 30, false) AND NOT current_evidence"),
], [
    ("missing:reference|url", "reference IS NULL AND url = ''"), ("missing:title", "title IS NULL"), ("home_unclear", "NOT coalesce(at_home, false)"), ("source_not_reliable", "source_quality <> 'OFFICIAL_PRIMARY'"), ("date_in_future", f"coalesce(publication_date > DATE '{_AS_OF}', false)"), ("review:conflict", "conflict"),
], "doubt = ''").replace("doubt = '' AS may", "true AS may").replace("why IS NULL AND may AS ask", "why IS NULL AND doubt = '' AS ask")))
def q_strict_checks(t):
    """The conditions' own language over all records: included kinds, exclusions, groups of fields of which one must be there."""
    return _counted(_lines(t, STRICT), _STRICT.evaluate(F.col("r"), F.lit(_AS_OF).cast("date")))


@query("""WITH b AS (SELECT c_custkey AS k, c_custkey % 5 AS h, c_nationkey % 6 AS f FROM customer), u AS (SELECT *, CASE h WHEN 0 THEN 'marchespublics.gov.ma' WHEN 1 THEN 'cpmaroc.com' WHEN 2 THEN 'culture.gov.ma' WHEN 3 THEN 'elsewhere.example' ELSE 'notculture.gov.ma' END AS host FROM b),
a AS (SELECT *, 'https://www.' || host || CASE f WHEN 0 THEN '/index.php?page=entreprise.EntrepriseDetailConsultation&refConsultation=' || k || '&orgAcronyme=a' || f WHEN 1 THEN '/bdc/entreprise/consultation/show/' || k || '/' WHEN 2 THEN '/avis/' || k WHEN 3 THEN '/actualites/' || k WHEN 4 THEN '/avis/' || k || '?Search=x' ELSE '/Marches-Publics/' END AS url FROM u)
SELECT k AS id, CASE h WHEN 0 THEN 'OFFICIAL_PROCUREMENT' WHEN 1 THEN 'PROCUREMENT_AGGREGATOR' WHEN 2 THEN 'OFFICIAL_INSTITUTIONAL' END AS role, CASE WHEN h = 0 THEN f IN (0, 1) ELSE f IN (1, 2) END AS page, h = 0 AND f IN (0, 1) AS direct,
CASE WHEN h = 0 AND f = 0 THEN 'https://www.marchespublics.gov.ma/index.php?page=entreprise.EntrepriseDetailsConsultation&refConsultation=' || k || '&orgAcronyme=a' || f ELSE url END AS detail, CASE f WHEN 1 THEN rtrim(url, '/') WHEN 5 THEN rtrim(url, '/') WHEN 0 THEN url ELSE url END AS canonical, host AS domain FROM a""")
def q_address_checks(t):
    """Addresses of five hosts in six forms: whose they are, whether they name one notice, and their one form."""
    k, h, f = F.col("c_custkey"), F.col("c_custkey") % 5, F.col("c_nationkey") % 6
    host = F.when(h == 0, "marchespublics.gov.ma").when(h == 1, "cpmaroc.com").when(h == 2, "culture.gov.ma").when(h == 3, "elsewhere.example").otherwise("notculture.gov.ma")
    rest = (
        F.when(f == 0, F.concat(F.lit("/index.php?page=entreprise.EntrepriseDetailConsultation&refConsultation="), k, F.lit("&orgAcronyme=a"), f)).when(f == 1, F.concat(F.lit("/bdc/entreprise/consultation/show/"), k, F.lit("/")))
        .when(f == 2, F.concat(F.lit("/avis/"), k)).when(f == 3, F.concat(F.lit("/actualites/"), k)).when(f == 4, F.concat(F.lit("/avis/"), k, F.lit("?Search=x"))).otherwise("/Marches-Publics/")
    )
    url = F.concat(F.lit("https://www."), host, rest)
    return t("customer").select(k.alias("id"), procurement.source_role(url).alias("role"), procurement.notice_page(url).alias("page"), procurement.direct_notice(url).alias("direct"), procurement.canonical_detail(url).alias("detail"), urls.canonical_url(url).alias("canonical"), urls.domain(url).alias("domain"))


_J = "sha256('[\"' || {} || '\"]')"


@query(f"""WITH p AS (SELECT p_partkey AS k, p_partkey % 4 AS m, lower(p_name) AS name, lower(p_brand) AS brand, lower(p_type) AS type FROM part)
SELECT k AS id, CASE m WHEN 0 THEN {_J.format("'v1\", \"reference\", \"' || brand || '/' || k || '\", \"' || type")} WHEN 1 THEN {_J.format("'v1\", \"url\", \"https://a.example/P/' || k || '?b=1'")} WHEN 2 THEN {_J.format("'v1\", \"title\", \"' || name || ' é\", \"'  || type")} END AS fingerprint,
CASE m WHEN 0 THEN {_J.format("brand || '/' || k || '\", \"' || type")} END AS reference, CASE m WHEN 3 THEN {_J.format("'\", \"' || type")} ELSE {_J.format("name || ' é\", \"' || type")} END AS identity FROM p""")
def q_identity_checks(t):
    """Digests of the strongest identity of every part: reference and buyer, address, or title and buyer, whatever case, spaces and forms of letters."""
    m = F.col("p_partkey") % 4
    reference = F.when(m == 0, F.concat(F.lit(" "), F.upper("p_brand"), F.lit("/"), "p_partkey"))
    url = F.when(m == 1, F.concat(F.lit("HTTPS://A.example/P/"), "p_partkey", F.lit("?b=1#c")))
    title = F.when(m != 3, F.concat(F.initcap("p_name"), F.lit("  É")))
    org = F.concat(F.lower("p_type"), F.lit("　"))
    none = F.lit(None).cast("string")
    print_ = identity.fingerprint(reference, org, title, url)
    fields = {"program_name": none, "funder": none, "legal_status": none, "document_type": none, "reference_number": none, "title": title, "institution": org, "person": none, "institution_name": none, "official_site": none, "url": none, "reference": reference}
    keys = identity.identity_keys(F.struct(*[c.alias(n) for n, c in fields.items()], F.lit(False).alias("fallback")))
    rows = t("part").select(F.col("p_partkey").alias("id"), F.when(m != 3, print_).alias("fingerprint"), keys.alias("k"))
    return rows.select("id", "fingerprint", F.col("k.reference").alias("reference"), F.col("k.identity").alias("identity"))


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN o_totalprice * 1e6 WHEN 1 THEN floor(o_totalprice) WHEN 2 THEN NULL ELSE floor(o_totalprice) * 1e9 END AS donor, CASE o_orderkey % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 3 THEN 'MAD' END AS currency,
CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE round(o_totalprice, 2) END AS amount, CASE WHEN o_custkey % 2 = 0 THEN 'TTC' WHEN o_custkey % 3 > 0 THEN 'UNKNOWN' END AS tax, o_custkey % 3 > 0 AND o_orderkey % 5 > 0 AS verified, o_orderdate::DATE::VARCHAR AS day, '2-' || o_orderkey || '.7' AS number FROM orders""")
def q_amount_checks(t):
    """Donor amounts, estimates, times and numbers written from each order's own figures, and read again."""
    k, c, whole = F.col("o_orderkey") % 4, F.col("o_custkey"), F.floor("o_totalprice").cast("string")
    price = F.col("o_totalprice").cast("decimal(14,2)").cast("string")
    donor = F.when(k == 0, F.concat(F.lit("un prêt de US $ "), price, F.lit(" million"))).when(k == 1, F.concat(whole, F.lit(" euros"))).when(k == 2, F.concat(whole, F.lit(" sans monnaie"))).otherwise(F.concat(F.lit("environ "), whole, F.lit(" milliards de dirhams")))
    read = money.donor_amount(donor)
    told = F.concat(F.when(c % 3 == 0, "*").otherwise(F.replace(price, F.lit("."), F.lit(","))), F.when(c % 2 == 0, " TTC").otherwise(""))
    e = money.estimate(F.lit(None).cast("double"), told, F.col("o_orderkey") % 5 > 0)
    ms = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    number = F.regexp_replace(reference(F.concat(F.lit("٢ - "), "o_orderkey", F.lit(" / 7"))), r"^2\.", "2-")
    return t("orders").select(F.col("o_orderkey").alias("id"), read["amount"].alias("donor"), read["currency"].alias("currency"), e["amount"].alias("amount"), e["tax_mode"].alias("tax"), e["verified"].alias("verified"), money.epoch_day(ms, "UTC").cast("string").alias("day"), number.alias("number"))


@query("""SELECT p_partkey AS id, lower(p_name) || ' strasse' AS normal, lower(p_name) || ' coeur d ete' AS folded, CASE WHEN length(p_name) > 11 THEN CASE WHEN p_name[11] = ' ' THEN p_name[:10] ELSE coalesce(nullif(regexp_extract(p_name[:10], '^(.*\\S)\\s', 1), ''), p_name[:10]) END || '…' ELSE p_name END AS short FROM part""")
def q_normal_form_checks(t):
    """Every part's name in three normal forms, from text with wide letters, ligatures, marks and odd spaces."""
    wide = F.translate(F.upper("p_name"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "".join(chr(0xFF21 + i) for i in range(26)))
    return t("part").select(F.col("p_partkey").alias("id"), text.normalize_exact(F.concat(F.lit("　"), wide, F.lit("  Straße "))).alias("normal"), text.fold_general(F.concat("p_name", F.lit(" Cœur d'Été"))).alias("folded"), text.shortened(F.concat(F.lit(" "), "p_name"), 11).alias("short"))


_OUTCOME = {"valid": "l_orderkey % 5 > 0", "ask": "l_orderkey % 2 = 0", "review": "l_orderkey % 3 = 0"}


@query(_sql(_OUTCOME, """j AS (SELECT *, valid AND ask AS asks, CASE WHEN NOT valid THEN 'INSUFFICIENT_BUSINESS_VALUE' WHEN ask THEN 'MATERIAL_AMBIGUITY' WHEN review THEN 'NO_AMBIGUITY' ELSE 'DETERMINISTIC_CONFIDENCE' END AS why FROM r) SELECT asks AS ask, why, count(*) AS n, sum(l_orderkey)::BIGINT AS keys FROM j GROUP BY ALL"""))
def q_question_checks(t):
    """Whether a model is asked about a line's outcome, and the reason kept."""
    q = gating.question(F.col("r"))
    return _lines(t, _OUTCOME).select("l_orderkey", q.alias("q")).groupBy("q.ask", "q.why").agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("keys"))


@query("""WITH r AS (SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'ADOPTED' WHEN 1 THEN 'IN_FORCE' WHEN 2 THEN 'DRAFT' END AS status, CASE o_custkey % 3 WHEN 0 THEN 'LAW' WHEN 1 THEN 'DRAFT_LAW' ELSE 'DECREE' END AS kind, left(o_orderpriority, 1) AS letter, CASE o_custkey % 3 WHEN 0 THEN 'GRANT' WHEN 1 THEN 'TECHNICAL_ASSISTANCE' ELSE 'DIRECT_ACCESS' END AS mode, o_orderkey % 4 AS n FROM orders)
SELECT id, CASE WHEN status IN ('ADOPTED', 'IN_FORCE') THEN 1 ELSE 2 END AS policy_priority, CASE kind WHEN 'LAW' THEN 'law' WHEN 'DRAFT_LAW' THEN 'draft_law' ELSE 'other' END AS policy_category, CASE WHEN letter = '1' THEN 1 ELSE 2 END AS funding_priority, CASE mode WHEN 'GRANT' THEN 'grant' WHEN 'TECHNICAL_ASSISTANCE' THEN 'technical_assistance' ELSE 'investment' END AS funding_category,
letter::INT AS project_priority, CASE WHEN letter IN ('1', '3') THEN 1 ELSE 2 END AS institution_priority, CASE WHEN mode = 'GRANT' THEN 'appointment' ELSE 'institutional_activity' END AS institution_category, CASE n WHEN 1 THEN 'a' WHEN 2 THEN 'a; b' WHEN 3 THEN 'b' END AS review_reason FROM r""")
def q_review_rows(t):
    """Rows of policies, programmes and projects that rules alone send to a person."""
    k, c, p = F.col("o_orderkey"), F.col("o_custkey"), F.left("o_orderpriority", F.lit(1))
    text_ = F.lit("s")
    policy = F.struct(F.when(k % 5 == 0, "ADOPTED").when(k % 5 == 1, "IN_FORCE").when(k % 5 == 2, "DRAFT").alias("status"), F.when(c % 3 == 0, "LAW").when(c % 3 == 1, "DRAFT_LAW").otherwise("DECREE").alias("document_type"), text_.alias("summary"), text_.alias("implications"), text_.alias("evidence"))
    funding = F.struct(F.when(p == "1", "A").otherwise("B").alias("letter"), F.when(c % 3 == 0, "GRANT").when(c % 3 == 1, "TECHNICAL_ASSISTANCE").otherwise("DIRECT_ACCESS").alias("mode"), text_.alias("summary"), text_.alias("relevance"))
    project = F.struct(p.cast("int").alias("priority"), text_.alias("summary"))
    institution = F.struct(F.when(p != "5", p.isin("1", "3")).alias("verified"), F.when(c % 3 == 0, "NEW_APPOINTMENT").otherwise("PARTNERSHIP").alias("activity"), text_.alias("summary"))
    doubts = F.array_compact(F.array(F.when((k % 4).isin(1, 2), "a"), F.when((k % 4).isin(2, 3), "b")))
    a, b, d, e = (gating.review_row(n, r, doubts) for n, r in (("policy", policy), ("funding", funding), ("project", project), ("institution", institution)))
    return t("orders").select(k.alias("id"), a["priority"].alias("policy_priority"), a["category"].alias("policy_category"), b["priority"].alias("funding_priority"), b["category"].alias("funding_category"), d["priority"].alias("project_priority"), e["priority"].alias("institution_priority"), e["category"].alias("institution_category"), d["review_reason"].alias("review_reason"))
