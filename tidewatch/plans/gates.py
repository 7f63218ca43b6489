"""Registered queries for gates, resolutions, recoveries, sessions, board pages and search answers; see ``records`` for how cases are held."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from ..operators import details, evidence, gating, recovery, resolver, sessions
from ..sources import board, search
from .catalog import FOLD, golden, query
from .judgements import _judge, _now, _today

D = date
_NO, _OFFICIAL = "https://news.example.org/x", "https://www.marchespublics.gov.ma/index.php?page=entreprise.EntrepriseDetailsConsultation&refConsultation=7&orgAcronyme=a"


@golden("valid boolean, review boolean, ask boolean, reason string", ["ask_model", "why", "relevant", "confidence", "manual", "said"], [
    ((True, False, True, None), (True, "MATERIAL_AMBIGUITY", True, 0.0, True, "")),
    ((True, True, False, "deadline_unknown"), (False, "NO_AMBIGUITY", True, 0.0, True, "deadline_unknown")),
    ((True, False, False, None), (False, "DETERMINISTIC_CONFIDENCE", True, 0.0, True, "")),
    ((False, False, False, "old"), (False, "INSUFFICIENT_BUSINESS_VALUE", False, 1.0, False, "old")),
])
def q_question_gate(valid, review, ask, reason):
    o = F.struct(valid.alias("valid"), review.alias("review"), ask.alias("ask"), F.array_compact(F.array(reason)).alias("reasons"))
    q, r = gating.question(o), gating.without_model(o)
    return [q["ask"], q["why"], r["relevant"], r["confidence"], r["manual"], r["reason"]]


@golden("reason string", ["code"], [
    (("deadline_unknown",), ("DEADLINE_UNCLEAR",)), (("missing:url",), ("OFFICIAL_URL_NOT_CONFIRMED",)), (("missing:title",), ("MISSING_TITLE",)), (("review:conflict",), ("REVIEW_CONFLICT",)),
    (("review:reference_conflict",), ("REFERENCE_CONFLICT",)), (("date_in_future",), ("DATE_IN_FUTURE",)),
])
def q_review_codes(reason):
    return [gating.review_code(reason)]


_VERDICT = {"valid": True, "review": False, "reason": None, "relevant": True, "confidence": 0.9, "manual": False, "business": "keep", "strong": False}
_judge("q_procurement_verdict", "valid boolean, review boolean, reason string, relevant boolean, confidence double, manual boolean, business string, strong boolean", _VERDICT, ["relevant", "manual", "reasons"], [
    ({}, (True, False, "")),
    ({"valid": False, "reason": "old"}, (False, False, "old")),
    ({"relevant": False}, (True, True, "BUSINESS_FIT_REQUIRES_HUMAN_REVIEW")),
    ({"business": "review", "review": True, "reason": "fit"}, (True, True, "fit,BUSINESS_FIT_REQUIRES_HUMAN_REVIEW")),
    ({"confidence": 0.7}, (True, True, "MEDIUM_AI_CONFIDENCE")),
    ({"confidence": 0.7, "strong": True}, (True, False, "")),
    ({"confidence": 0.7, "strong": True, "manual": True}, (True, True, "AI_REVIEW_REQUESTED,MEDIUM_AI_CONFIDENCE")),
    ({"confidence": 0.4}, (True, True, "BUSINESS_FIT_REQUIRES_HUMAN_REVIEW")),
    ({"confidence": 0.4, "review": True, "reason": "deadline_unknown"}, (True, True, "DEADLINE_UNCLEAR,MEDIUM_AI_CONFIDENCE")),
    ({"manual": True}, (True, True, "AI_REVIEW_REQUESTED")),
], lambda r: gating.verdict(F.struct(r["valid"].alias("valid"), r["review"].alias("review"), F.array_compact(F.array(r["reason"])).alias("reasons")), r, r["business"], r["strong"]))

_judge("q_strong_evidence", "at_home boolean, home_evidence string, confirmed boolean, official_url string, status string, reference string, deadline date, procedure string, business string, source_conflict boolean, reference_conflict boolean",
    {"at_home": True, "home_evidence": "Fes", "confirmed": True, "official_url": _OFFICIAL, "status": "open", "reference": "1", "deadline": D(2024, 7, 1), "procedure": "open_call", "business": "keep", "source_conflict": False, "reference_conflict": None}, ["strong"], [
    ({}, (True,)),
    ({"official_url": _NO}, (False,)),
    ({"deadline": D(2024, 6, 15)}, (False,)),
    ({"deadline": None}, (False,)),
    ({"procedure": None}, (False,)),
    ({"home_evidence": ""}, (False,)),
    ({"source_conflict": True}, (False,)),
    ({"business": "review"}, (False,)),
], lambda r: F.struct(gating.strong_evidence(r, _today()).alias("strong")))


@golden("url string, n_rows int, text string", ["kind"], [
    ((_OFFICIAL, 0, ""), ("tender_detail",)),
    (("https://culture.gov.ma/consultations", 3, ""), ("institutional_procurement",)),
    (("https://cpmaroc.com/secteur/search?q=1", 3, ""), ("procurement_category",)),
    (("https://cpmaroc.com/search?q=1", 3, ""), ("tender_list",)),
    (("https://example.org/", 0, "Nos appels d'offres: Appel d'offres ouvert"), ("generic_org",)),
    (("https://example.org/", 0, "Bienvenue"), ("non_procurement",)),
    (("https://example.org/", 0, None), ("non_procurement",)),
])
def q_page_type(url, n_rows, text):
    return [gating.page_type(url, n_rows, text)]


@golden("code string, source_type string, url string, architectural boolean, role_fit boolean", ["later"], [
    (("REJECT_NO_ARCHITECTURAL_ROLE", "OFFICIAL_PROCUREMENT", _OFFICIAL, True, False), (True,)),
    (("REJECT_NO_ARCHITECTURAL_ROLE", "OFFICIAL_PROCUREMENT", _OFFICIAL, False, True), (True,)),
    (("REJECT_NO_ARCHITECTURAL_ROLE", "OFFICIAL_PROCUREMENT", _OFFICIAL, None, None), (False,)),
    (("REJECT_PURE_EXECUTION", "OFFICIAL_PROCUREMENT", _OFFICIAL, True, True), (False,)),
    (("REJECT_GENERIC_ARCHITECTURE_NOT_STRATEGIC", "PROCUREMENT_AGGREGATOR", _OFFICIAL, True, True), (False,)),
    (("REJECT_GENERIC_ARCHITECTURE_NOT_STRATEGIC", "OFFICIAL_PROCUREMENT", "https://www.marchespublics.gov.ma/", True, True), (False,)),
    ((None, None, None, True, True), (False,)),
])
def q_read_before_rejecting(code, source_type, url, architectural, role_fit):
    return [gating.read_before_rejecting(code, source_type, url, architectural, role_fit)]


@golden("decision string, score double, negative int", ["decision_after"], [
    (("keep", -0.9, 3), ("review",)), (("keep", 0.5, 3), ("keep",)), (("reject", 0.9, 0), ("reject",)), (("review", 0.9, 0), ("review",)),
])
def q_feedback_demotion(decision, score, negative):
    return [evidence.adjusted(decision, score, negative)]


_ADDRESS = {"title": "Étude du musée", "confirmed": True, "official_url": _OFFICIAL, "url": _NO, "found_at": None}
_judge("q_address_status", "title string, confirmed boolean, official_url string, url string, found_at string", _ADDRESS, ["status"], [
    ({}, ("VERIFIED_DIRECT",)),
    ({"official_url": "https://culture.gov.ma/notice/7"}, ("VERIFIED_INSTITUTIONAL",)),
    ({"official_url": "https://cpmaroc.com/notice/7"}, ("SECONDARY_ONLY",)),
    ({"confirmed": None}, ("SECONDARY_ONLY",)),
    ({"confirmed": False, "found_at": _OFFICIAL}, ("INDIRECT_PMMP",)),
    ({"title": "Liste des appels d'offres"}, ("SECONDARY_ONLY",)),
    ({"confirmed": False, "url": None}, ("NOT_FOUND",)),
], lambda r: F.struct(gating.address_status(r).alias("status")))

_FOUND = {"title": "Étude du musée", "reference": "12/24", "institution": "Commune", "url": "https://cpmaroc.com/n/1", "found_at": None, "source_conflict": False, "reference_conflict": False, "at_home": True, "status": "open", "published": D(2024, 6, 1), "deadline": None, "deadline_at": None}
_judge("q_credible_fallback", "title string, reference string, institution string, url string, found_at string, source_conflict boolean, reference_conflict boolean, at_home boolean, status string, published date, deadline date, deadline_at timestamp", _FOUND, ["strong", "sound"], [
    ({}, (True, True)),
    ({"institution": None}, (True, True)),
    ({"institution": None, "title": "12/24"}, (False, False)),
    ({"reference": "AO", "title": "Musée"}, (False, False)),
    ({"url": _NO}, (False, False)),
    ({"url": _NO, "found_at": "https://cpmaroc.com/n/1"}, (True, True)),
    ({"source_conflict": True}, (False, False)),
    ({"at_home": None}, (True, False)),
    ({"status": "awarded"}, (True, False)),
    ({"published": D(2024, 5, 1)}, (True, False)),
    ({"published": D(2024, 5, 1), "deadline": D(2024, 6, 15)}, (True, True)),
    ({"published": None}, (True, True)),
    ({"deadline": D(2024, 6, 14)}, (True, False)),
    ({"deadline": D(2024, 6, 15), "deadline_at": datetime(2024, 6, 15, 12)}, (True, False)),
], lambda r: F.struct(gating.strong_identity(r).alias("strong"), gating.credible(r, _today(), _now()).alias("sound")))


@golden("state string, url string, found_at string, official_url string", ["url_after", "official_after", "quality", "confidence"], [
    (("VERIFIED_OFFICIAL", "u", "f", "o"), ("u", "o", "OFFICIAL_PRIMARY", 1.0)),
    (("UNVERIFIED_BUT_CREDIBLE", "u", "f", "o"), ("f", None, "RELIABLE_SECONDARY", 0.0)),
    (("UNRESOLVED", "u", None, "o"), ("u", None, "RELIABLE_SECONDARY", 0.0)),
])
def q_resolution_state(state, url, found_at, official_url):
    r = gating.resolution(state, url, found_at, official_url)
    return [r["url"], r["official_url"], r["quality"], r["confidence"]]


_judge("q_policy_class", "status string, document_type string, reliable boolean, official boolean, evidence string, claimed string",
    {"status": "ADOPTED", "document_type": "LAW", "reliable": True, "official": True, "evidence": "e", "claimed": "ADOPTED"}, ["status", "letter", "refused"], [
    ({}, ("ADOPTED", "A", False)),
    ({"claimed": "IN_FORCE"}, (None, None, True)),
    ({"status": "PUBLISHED"}, ("PUBLISHED", "A", False)),
    ({"evidence": ""}, (None, None, True)),
    ({"evidence": "", "claimed": "DRAFT"}, ("POLICY_SIGNAL", "D", False)),
    ({"document_type": "draft_law"}, (None, None, True)),
    ({"status": "draft", "claimed": "DRAFT"}, ("DRAFT", "C", False)),
    ({"status": "IMPLEMENTATION", "claimed": None}, ("IMPLEMENTATION", "B", False)),
    ({"status": "ANNOUNCED", "claimed": "ANNOUNCED"}, ("ANNOUNCED", "D", False)),
], lambda r: gating.policy_class(r, r["claimed"]))


@golden("status string, mode string, eligible boolean, eligibility string, official boolean, deadline date, priority int", ["letter", "access", "due", "fit"], [
    (("open", "GRANT", None, None, None, D(2024, 7, 1), 1), ("A", "GRANT", "active", "direct")),
    (("pipeline", "DIRECT_ACCESS", True, "communes", True, D(2024, 6, 15), 2), ("D", "DIRECT_ACCESS", "active", "potential")),
    (("closed", "DIRECT_ACCESS", True, "", True, D(2024, 6, 14), 3), ("E", "MONITORING_ONLY", "expired", "potential")),
    ((None, "DIRECT_ACCESS", None, None, None, None, None), ("unknown", "MONITORING_ONLY", "unknown", "potential")),
])
def q_funding_class(status, mode, eligible, eligibility, official, deadline, priority):
    r = F.struct(status.alias("status"), mode.alias("mode"), eligible.alias("eligible"), eligibility.alias("eligibility"), official.alias("official"))
    f, d = gating.funding_class(r), gating.deadline_class(deadline, priority, _today())
    return [f["letter"], f["access"], d["deadline"], d["fit"]]


@golden("status string, until timestamp, beat timestamp", ["expired"], [
    (("idle", None, None), (True,)),
    (("running", datetime(2024, 6, 15, 13), datetime(2024, 6, 15, 8)), (False,)),
    (("running", datetime(2024, 6, 15, 11), datetime(2024, 6, 15, 11, 58)), (False,)),
    (("running", datetime(2024, 6, 15, 11), datetime(2024, 6, 15, 11, 57)), (True,)),
    (("running", None, None), (True,)),
])
def q_lease_expired(status, until, beat):
    return [recovery.lease_expired(status, until, beat, _now(), 180)]


@query("""WITH e AS (SELECT p_partkey AS id, lower(p_brand) AS r, nullif(CASE WHEN p_size % 3 = 0 THEN '' ELSE lower(p_type) END, '') AS b, lower(p_name) AS t FROM part),
c AS (SELECT p_partkey AS row, lower(p_brand) AS r, CASE WHEN p_retailprice < 1200 THEN NULL ELSE lower(p_type) END AS b, lower(p_name) AS t FROM part),
m AS (SELECT row, min(id) AS low, max(id) AS high FROM c JOIN e USING (r) WHERE c.b = e.b OR ((c.b IS NULL OR e.b IS NULL) AND c.t = e.t) GROUP BY 1)
SELECT row, CASE WHEN low = high THEN low END AS match, coalesce(low <> high, false) AS conflict FROM c LEFT JOIN m USING (row)""")
def q_reconcile_reference(t):
    """Parts against parts under a reference written otherwise: the one part, or a conflict."""
    p = t("part")
    e = p.select(F.col("p_partkey").alias("id"), F.upper(F.replace("p_brand", F.lit("#"), F.lit(" - "))).alias("reference"), F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_type")).alias("institution"), F.col("p_name").alias("title"))
    c = p.select(F.col("p_partkey").alias("row"), F.col("p_brand").alias("reference"), F.when(F.col("p_retailprice") >= 1200, F.upper("p_type")).alias("institution"), F.upper("p_name").alias("title"))
    return resolver.reconcile(c, e)


@query("""WITH s AS (SELECT DISTINCT user_id % 97 AS q, 'https://site.example/' || (event_id % 53) AS u FROM events), h AS (SELECT o_custkey % 97 AS q, 'https://site.example/' || (o_orderkey % 53) AS u FROM orders)
SELECT q AS query, u AS url, 'hit' AS kind, count(*) AS n FROM h WHERE (q, u) IN (SELECT (q, u) FROM s) GROUP BY 1, 2 UNION ALL SELECT q, u, 'discovery_page', 1 FROM s WHERE (q, u) NOT IN (SELECT (q, u) FROM h)""")
def q_search_hits(t):
    """Hits of a search that saw their address, and what it saw without a hit."""
    at = lambda c: F.concat(F.lit("HTTPS://Site.example:443/"), F.col(c) % 53, F.lit("/?utm_source=s#top"))
    none = F.lit(None).cast("string")
    s = t("events").select((F.col("user_id") % 97).alias("query"), F.col("event_id").alias("position"), at("event_id").alias("url"), F.col("event_type").alias("title"), none.alias("snippet"), none.alias("day"))
    h = t("orders").select((F.col("o_custkey") % 97).alias("query"), F.col("o_orderkey").alias("position"), at("o_orderkey").alias("url"), F.col("o_orderpriority").alias("title"), none.alias("evidence"), none.alias("day"))
    good, _ = search.merged(h, s)
    return good.groupBy("query", "url", "kind").agg(F.count("*").alias("n"))


_MARK, _HOLD = "ctl0_CONTENU_PAGE_resultSearch_tableauResultSearch_ctl", "ctl0$CONTENU_PAGE$resultSearch$tableauResultSearch$ctl"


def _board_page(rows):
    """A board page of (number, consultation, fields) columns."""
    parts = []
    for n, consultation, fields in rows:
        parts += [F.lit(f'<input name="{_HOLD}{n}$refCons" value="'), consultation.cast("string"), F.lit(f'"/><input name="{_HOLD}{n}$orgCons" value="org"/>')]
        for name, value in fields.items():
            parts += [F.lit(f'<p id="{_MARK}{n}_{name}">'), value, F.lit("</p>")]
    return F.concat(*parts)


@query("""SELECT o_orderkey AS page, 1::INT AS n, o_orderkey::VARCHAR AS consultation, o_orderpriority AS reference, 'Commande & ' || o_orderstatus AS title, strftime(o_orderdate, '%d/%m/%Y') AS publication, 'Services' AS category, 'Appel ouvert' AS procedure FROM orders
UNION ALL SELECT o_orderkey, 2, o_custkey::VARCHAR, NULL, o_orderpriority, NULL, 'Travaux', NULL FROM orders""")
def q_board_listings(t):
    """Board pages made of orders, two listings each below the head, read back."""
    day = F.date_format("o_orderdate", "dd/MM/yyyy")
    said = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    html = _board_page([
        (0, F.lit(9), {"reference": F.lit("head")}),
        (1, F.col("o_orderkey"), {"reference": said(" : ", F.col("o_orderpriority"), " "), "panelBlocObjet": said("<b>Objet</b> : Commande &amp; ", F.col("o_orderstatus")), "panelBlocTypesProc": said("Appel ouvert <i>services</i> ", day)}),
        (2, F.col("o_custkey"), {"infosBullesObjet": said("objet : ", F.col("o_orderpriority")), "panelBlocCategorie": said("TRAVAUX ", day), "infosLieuExecutionLtRef": day}),
    ])
    pages = t("orders").select(F.lit("c").alias("crawl"), F.col("o_orderkey").alias("page"), html.alias("html"))
    return board.listings(pages).select("page", "n", "consultation", "reference", "title", "publication", "category", "procedure")


@query("""WITH p AS (SELECT o_custkey AS crawl, o_orderkey AS page, o_orderkey % 7 AS k FROM orders), a AS (SELECT *, row_number() OVER (PARTITION BY crawl, k ORDER BY page) > 1 AS again FROM p),
s AS (SELECT crawl, min(page) FILTER (again) AS loop FROM a GROUP BY 1)
SELECT crawl, count(*) FILTER (loop IS NULL OR page < loop) AS pages, CASE WHEN any_value(loop) IS NULL THEN 'final_page' ELSE 'pagination_loop' END AS stop FROM a JOIN s USING (crawl) GROUP BY 1""")
def q_board_walk(t):
    """Crawls, one per customer, whose pages are their orders: each ends before a page that came before."""
    html = F.concat(_board_page([(1, F.col("o_orderkey") % 7, {"reference": F.col("o_orderstatus")})]), F.lit(board.NEXT))
    pages = t("orders").select(F.col("o_custkey").alias("crawl"), F.col("o_orderkey").alias("page"), html.alias("html"))
    return board.walk(pages, pages.sparkSession.createDataFrame([], "identity string, digest string"))[1]


@query(f"""WITH h AS (SELECT doc_id AS hit, 'https://s.example/' || (doc_id % 1009) AS url, {FOLD.format("text")} AS f, length(text) > 0 AS some, source LIKE '%1' AS odd FROM documents)
SELECT hit, CASE WHEN url IS NULL THEN 'rejected' WHEN r = 1 AND k THEN 'known' WHEN r = 1 THEN 'new' ELSE 'updated' END AS outcome FROM (
  SELECT hit, url, hit_at, row_number() OVER (PARTITION BY url ORDER BY hit) AS r, (hit_at % 2 = 0) AS k FROM (SELECT hit, url, regexp_extract(url, '[0-9]+$')::INT AS hit_at, LEAST(35, 10 * (contains(f, 'the')::INT + contains(f, 'and')::INT + contains(f, 'der')::INT)) AS s FROM h) WHERE 35 + s >= 45)
UNION ALL SELECT hit, 'rejected' FROM h WHERE 35 + LEAST(35, 10 * (contains(f, 'the')::INT + contains(f, 'and')::INT + contains(f, 'der')::INT)) < 45""")
def q_session_ingest(t):
    """Documents as hits of a brief against known addresses: new, known, updated or rejected."""
    none = F.lit(None).cast("string")
    hits = t("documents").select(
        F.col("doc_id").alias("hit"), F.col("text").alias("title"), F.col("doc_id").cast("string").alias("evidence"), none.alias("institution"), none.alias("location"),
        F.concat(F.lit("https://S.example/"), F.col("doc_id") % 1009).alias("url"), F.lit("2024-01-01").cast("date").alias("day"), none.alias("status"), F.lit(False).alias("official"),
    )
    # every second address has a record already
    held = t("documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("https://s.example/"), (F.col("doc_id") % 505) * 2).alias("url"))
    links = hits.sparkSession.createDataFrame([], "url string, fingerprint string, review string")
    brief = {"wanted": ["the", "and", "der"], "excluded": [], "places": [], "since": "2023-01-01", "until": "2024-06-01", "archive": False, "open_only": True}
    return sessions.ingest(hits, held, links, brief).select("hit", "outcome")


@query("""WITH d AS (SELECT o_custkey AS c, o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN 'PERTINENT' WHEN 'O' THEN 'REJECTED' ELSE 'TOO_BROAD' END AS x FROM orders)
SELECT c_custkey AS result, coalesce((SELECT arg_max(x, k) FROM d WHERE c = c_custkey AND x <> 'TOO_BROAD'), 'PENDING') AS review FROM customer""")
def q_session_feedback(t):
    """Reviews of results after all decisions; only a verdict changes one."""
    links = t("customer").select(F.lit(1).alias("session"), F.col("c_custkey").alias("result"), F.lit("PENDING").alias("review"))
    x = F.when(F.col("o_orderstatus") == "F", "PERTINENT").when(F.col("o_orderstatus") == "O", "REJECTED").otherwise("TOO_BROAD")
    said = t("orders").select(F.lit(1).alias("session"), F.col("o_custkey").alias("result"), x.alias("decision"), F.col("o_orderkey").alias("at"))
    return sessions.decide(links, said)[0].select("result", "review")


@query("""WITH r AS (SELECT o_orderkey AS request, o_custkey AS s, CASE o_orderstatus WHEN 'F' THEN 'refine' WHEN 'O' THEN 'reserve' ELSE 'cancel' END AS kind, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
c AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'RUNNING' WHEN c_acctbal < 5000 THEN 'DRAFT' ELSE 'COMPLETED' END AS st FROM customer)
SELECT CASE WHEN n > 1 THEN 'again' WHEN kind IN ('refine', 'reserve') AND st <> 'RUNNING' OR kind = 'cancel' AND st = 'DRAFT' THEN 'done' ELSE 'refused' END AS outcome, kind, count(*) AS n FROM r JOIN c ON c_custkey = s GROUP BY 1, 2""")
def q_session_requests(t):
    """Requests to sessions by compare and set."""
    status = F.when(F.col("c_acctbal") < 0, "RUNNING").when(F.col("c_acctbal") < 5000, "DRAFT").otherwise("COMPLETED")
    s = t("customer").select(F.col("c_custkey").alias("session"), F.lit(1).alias("version"), status.alias("status"))
    kind = F.when(F.col("o_orderstatus") == "F", "refine").when(F.col("o_orderstatus") == "O", "reserve").otherwise("cancel")
    r = t("orders").select(F.col("o_orderkey").alias("request"), F.col("o_custkey").alias("session"), F.lit(1).alias("version"), kind.alias("kind"))
    out = sessions.transit(s, r)[1].join(r.select("request", "kind"), "request")
    return out.groupBy("outcome", "kind").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey AS session, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'O' GROUP BY 1, c_acctbal ORDER BY c_acctbal DESC, c_custkey LIMIT 20""")
def q_session_waiting(t):
    """The sessions last changed that have results to review."""
    s = t("customer").select(F.col("c_custkey").alias("session"), F.col("c_acctbal").alias("updated_at"))
    links = t("orders").select(F.col("o_custkey").alias("session"), F.when(F.col("o_orderstatus") == "O", "PENDING").alias("review"))
    return sessions.waiting(s, links).select("session", "n")


@query("""WITH p AS (SELECT o_custkey AS c, max(o_orderdate) AS stamp, arg_max(CASE o_orderstatus WHEN 'F' THEN 'PROCESSED' ELSE 'REJECTED' END, (o_orderdate, CASE o_orderstatus WHEN 'F' THEN 'PROCESSED' ELSE 'REJECTED' END)) AS st FROM orders GROUP BY 1)
SELECT c_custkey AS key, CASE WHEN stamp >= TIMESTAMP '1998-01-01' THEN st WHEN c_acctbal < 0 THEN 'REJECTED' ELSE 'PENDING_PROCESSING' END AS state FROM customer LEFT JOIN p ON c = c_custkey""")
def q_recover_legacy(t):
    """Customers as listings without a state, orders as judgements of their snapshots: proven after the last change, turned away, or queued."""
    def listing(key):
        said = F.concat(F.lit("L "), F.col(key))
        return [said.alias("title"), F.col(key).alias("reference"), F.lit("Buyer").alias("institution"), F.lit("2024-01-01").alias("deadline"), F.lit(None).cast("string").alias("publication_date"), F.lit("open").alias("source_status"), said.alias("url")]

    rows = t("customer").select(F.col("c_custkey").alias("key"), "c_acctbal", F.lit("1998-01-01").cast("timestamp").alias("last_changed"), *listing("c_custkey"))
    judged = t("orders").select(*listing("o_custkey"), "o_orderdate", "o_orderstatus")
    proofs = judged.select(recovery.snapshot_digest().alias("digest"), F.col("o_orderdate").alias("stamp"), F.when(F.col("o_orderstatus") == "F", "PROCESSED").otherwise("REJECTED").alias("state"))
    return recovery.recover(rows, proofs, F.when(F.col("c_acctbal") < 0, "no_scope")).select("key", "state")


@query("""SELECT CASE WHEN o_orderstatus <> 'F' AND o_orderdate < TIMESTAMP '1998-06-01 00:00:00' - INTERVAL 11 MINUTE THEN 'failed' WHEN o_orderstatus = 'F' THEN 'completed' ELSE 'running' END AS status, count(*) AS n FROM orders GROUP BY 1""")
def q_stale_runs(t):
    """Runs that are silent for longer than their budget allows have failed."""
    runs = t("orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("running").alias("status"), F.col("o_orderdate").alias("started_at"))
    return recovery.end_stale(runs, F.lit("1998-06-01").cast("timestamp"), recovery.stale_minutes(60, 390)).groupBy("status").agg(F.count("*").alias("n"))


_PAGE = {"title": "Étude du musée", "reference": "12/2024", "institution": "Commune de Fès", "deadline": D(2024, 7, 1), "url": "https://culture.gov.ma/notice/7", "text": "AO 12/2024 Etude du MUSEE, commune de Fes. Limite 01/07/2024", "rows": ["12/2024 le 01/07/2024"], "headings": ["Avis"]}
_judge("q_detail_proof", "title string, reference string, institution string, deadline date, url string, text string, rows array<string>, headings array<string>", _PAGE, ["why"], [
    ({}, (None,)),
    ({"rows": ["12/2024", "13/2024"]}, ("container",)),
    ({"headings": ["Appels d'offres"]}, ("container",)),
    ({"rows": ["12/2024", "13/2024"], "url": _OFFICIAL}, (None,)),
    ({"deadline": D(2024, 7, 2)}, ("not_verified",)),
    ({"deadline": None}, ("not_verified",)),
    ({"institution": None}, ("not_verified",)),
    ({"reference": "13/2024"}, ("not_verified",)),
    ({"url": "https://culture.gov.ma/actualites"}, ("not_verified",)),
    ({"text": "Annulé : AO 12/2024 Etude du musée, commune de Fès. Limite 2024-07-01"}, ("closed",)),
    ({"reference": None, "text": None}, ("not_verified",)),
], lambda r: F.struct(details.unproven(r).alias("why")))


@golden("text string, href string, label string, form boolean", ["available", "size", "access", "url"], [
    (("Le DCE (12,5 Mo) est disponible", "files/dce.zip", "Dossier", False), (True, "12,5 Mo", "DIRECT_DOWNLOAD", "https://a.org/x/files/dce.zip")),
    (("Le DCE est disponible", "files/dce.zip", "Dossier", True), (True, None, "FORM_REQUIRED", None)),
    (("Le CPS est disponible", "about.html", "Contact", False), (True, None, "ATTACHMENT_AVAILABLE", None)),
    (("Règlement du concours: formulaire à renseigner", "about.html", "Contact", None), (True, None, "FORM_REQUIRED", None)),
    (("Bienvenue", "plan.pdf", "plans", None), (True, None, "DIRECT_DOWNLOAD", "https://a.org/x/plan.pdf")),
    (("Bienvenue", "menu.pdf", "menu", None), (False, None, "NOT_FOUND", None)),
])
def q_tender_documents(text, href, label, form):
    d = details.documents(text, F.array(F.struct(href.alias("href"), label.alias("label"))), F.lit("https://a.org/x/page"), form)
    return [d["available"], d["size"], d["access"], d["url"]]


@query("""SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 2 ELSE 1 END AS blocks FROM orders""")
def q_project_blocks(t):
    """Texts that list several projects, one block each; other texts are one block."""
    line = "Étude de faisabilité du musée régional de la ville"
    several = f"Programme\n- {line} A\n\n* {line} B\nFin"
    rows = t("orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", several).when(F.col("o_orderstatus") == "O", f"{line}\nshort").alias("text"), F.lit(None).cast("date").alias("published"))
    return details.project_blocks(rows, _today()).groupBy("id").agg(F.count("*").cast("int").alias("blocks"))
