"""Registered queries for addresses, identities and relevance of records.

Rules are held against cases of their own (``golden``): the SQL counts the outcome that each case must have and knows
nothing of the rule.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import functions as F

from ..functions import identity as I  # noqa: E741
from ..functions import text, urls
from ..operators import identity, procurement
from .catalog import _CANON, FOLD, golden, query


def _digest(*parts) -> str:
    """The digest that the JSON form of a list has."""
    return hashlib.sha256(json.dumps(parts, ensure_ascii=False).encode()).hexdigest()


@golden("url string", ["canonical"], [
    (("HTTP://News.Example.ORG:80/A/b/?q=1#top",), ("http://news.example.org/A/b?q=1",)),
    (("https://www.example.org:8443",), ("https://www.example.org:8443/",)),
    (("https://example.org/x?utm_source=a&b=&GCLID=2&ref=z",), ("https://example.org/x?b=&ref=z",)),
    (("http://user@evil.example/x",), (None,)),
    (("ftp://example.org/x",), (None,)),
    (("/only/a/path",), (None,)),
    (("  https://example.org/é?x=a b&y=%7E*  ",), ("https://example.org/é?x=a",)),
    (("https://bücher.example/",), ("https://xn--bcher-kva.example/",)),
    (("https://example.org:abc/x",), (None,)),
    (("https://example.org/x?a=1&a=2&flag",), ("https://example.org/x?a=1&a=2&flag=",)),
])
def q_url_cases(url):
    return [urls.canonical_url(url)]


@golden("base string, href string", ["found"], [
    (("https://a.example/b/c?d#e", "f.html"), ("https://a.example/b/f.html",)),
    (("https://a.example/b/c?d#e", "/f"), ("https://a.example/f",)),
    (("https://a.example/b/c?d#e", "//x.example/f"), ("https://x.example/f",)),
    (("https://a.example/b/c?d#e", "?g=1"), ("https://a.example/b/c?g=1",)),
    (("https://a.example/b/c?d#e", "#h"), ("https://a.example/b/c?d#h",)),
    (("https://a.example/b/c?d#e", "../../k"), ("https://a.example/k",)),
    (("https://a.example/b/c?d#e", ""), ("https://a.example/b/c?d#e",)),
    (("https://a.example", "mailto:x@y.example"), ("mailto:x@y.example",)),
    (("https://a.example", "k"), ("https://a.example/k",)),
])
def q_url_join(base, href):
    return [urls.resolved(base, href)]


@golden("url string", ["role", "page", "direct", "detail"], [
    (("https://www.marchespublics.gov.ma/index.php?page=entreprise.EntrepriseDetailConsultation&refConsultation=77&orgAcronyme=a1",), ("OFFICIAL_PROCUREMENT", True, True, "https://www.marchespublics.gov.ma/index.php?page=entreprise.EntrepriseDetailsConsultation&refConsultation=77&orgAcronyme=a1")),
    (("https://www.marchespublics.gov.ma/index.php?page=entreprise.Home",), ("OFFICIAL_PROCUREMENT", False, False, "https://www.marchespublics.gov.ma/index.php?page=entreprise.Home")),
    (("https://marchespublics.gov.ma/bdc/entreprise/consultation/show/904/",), ("OFFICIAL_PROCUREMENT", True, True, "https://marchespublics.gov.ma/bdc/entreprise/consultation/show/904/")),
    (("https://x.cpmaroc.com/avis/muraille-de-safi",), ("PROCUREMENT_AGGREGATOR", True, False, "https://x.cpmaroc.com/avis/muraille-de-safi")),
    (("https://cpmaroc.com/search?q=musee",), ("PROCUREMENT_AGGREGATOR", False, False, "https://cpmaroc.com/search?q=musee")),
    (("https://culture.gov.ma/actualites/un-musee",), ("OFFICIAL_INSTITUTIONAL", False, False, "https://culture.gov.ma/actualites/un-musee")),
    (("https://elsewhere.example/avis-12",), (None, True, False, "https://elsewhere.example/avis-12")),
    (("ftp://culture.gov.ma/avis-12",), ("OFFICIAL_INSTITUTIONAL", False, False, "ftp://culture.gov.ma/avis-12")),
])
def q_notice_address(url):
    return [procurement.source_role(url), procurement.notice_page(url), procurement.direct_notice(url), procurement.canonical_detail(url)]


@golden("a string, b string", ["digest"], [((a, b), (_digest(a, b),)) for a, b in [("x", "y"), ('quo"te', "back\\slash"), ("tab\tnew\nline", "\x01\x1f"), ("é œ ع", ""), (None, "n"), ("\\u001A", "\x1a")]])
def q_digest_cases(a, b):
    return [urls.key_digest(a, b)]


_FP = [
    (("AO 12 / 2024", "Commune  d'Azrou", "Titre", "https://a.example/x"), ("v1", "reference", "ao 12 / 2024", "commune d'azrou")),
    ((None, "Commune", "Titre", "HTTPS://A.example/X?b=1#c"), ("v1", "url", "https://a.example/X?b=1")),
    ((None, "Commune", "Titre", "https://a.example"), ("v1", "url", "https://a.example/")),
    (("", "Ｃommune", "Straße ﬁne", ""), ("v1", "title", "strasse fine", "commune")),
]


@golden("reference string, institution string, title string, url string", ["digest"], [*((g, (_digest(*k),)) for g, k in _FP), ((None, None, None, None), (None,)), ((None, None, "t", "mailto:x"), (None,))])
def q_fingerprint(reference, institution, title, url):
    return [I.fingerprint(reference, institution, title, url)]


_KEY_FIELDS = ["program_name", "funder", "legal_status", "document_type", "reference_number", "title", "institution", "person", "institution_name", "official_site", "url", "reference"]


def _record(**kw):
    return (*[kw.get(k) for k in _KEY_FIELDS], kw.get("fallback"))


@golden(", ".join(f"{k} string" for k in _KEY_FIELDS) + ", fallback boolean", ["url", "reference", "identity"], [
    (_record(program_name="Fonds A", funder="Banque B"), (None, *[_digest("fonds a", "banque b")] * 2)),
    (_record(legal_status="DRAFT", document_type="DECREE", title="projet decret 7", institution="MI"), (None, *[_digest(" decret 7", "mi")] * 2)),
    (_record(legal_status="DRAFT", document_type="DECREE", reference_number="2.24", title="x", institution="MI"), (None, *[_digest("2.24", "mi")] * 2)),
    (_record(person="A. B.", institution_name="Agence"), (None, *[_digest("a. b.", "agence")] * 2)),
    (_record(institution_name="Agence", official_site="https://WWW.Agence.example/p"), (None, *[_digest("www.agence.example", "agence")] * 2)),
    (_record(title="Un avis", institution="Ville", reference="9/24", url="http://a.example/1/"), ("http://a.example/1", _digest("9/24", "ville"), _digest("un avis", "ville"))),
    (_record(title="Un avis", reference="9/24", url="http://a.example/1/", fallback=True), (None, _digest("9 24", ""), _digest("un avis", ""))),
    (_record(title="Un avis"), (None, None, _digest("un avis", ""))),
])
def q_identity_keys(*fields):
    k = I.identity_keys(F.struct(*[c.alias(n) for n, c in zip([*_KEY_FIELDS, "fallback"], fields, strict=True)]))
    return [k["url"], k["reference"], k["identity"]]


@golden("value string", ["normal", "folded", "words", "short"], [
    (("  Ｆull　Width ﬁ ", ), ("full width fi", "full width fi", "full width fi", "Ｆull　Width ﬁ")),
    (("Cœur d'Été",), ("cœur d'été", "coeur d ete", "cœur d ete", "Cœur d'Été")),
    (("STRASSE Straße", ), ("strasse strasse", "strasse strasse", "strasse strasse", "STRASSE Straße")),
    (("تراثٌ_x 12",), ("تراثٌ_x 12", "تراث x 12", "تراث_x 12", "تراثٌ_x 12")),
    (("one two three four five six",), ("one two three four five six",) * 3 + ("one two three four…",)),
    ((None,), ("", "", "", "")),
])
def q_normalisers(value):
    return [text.normalize_exact(value), text.fold_general(value), text.folder(words=True)(value), text.shortened(value, 20)]


_CASES = [
    # title, scope, procedure, amount, verified -> decision, category, reason, rejection, tracks
    (("Travaux de construction d'un centre", None, None, None, False), ("reject", "REJECT", "REJECT_PURE_EXECUTION", "pure_execution_works", "")),
    (("Fourniture de quatre groupes électrogènes", None, "Travaux", None, False), ("reject", "REJECT", "REJECT_PURE_EXECUTION", "pure_execution_works", "")),
    (("Étude pour un logiciel de caisse", None, None, None, False), ("reject", "REJECT", "REJECT_IRRELEVANT_DOMAIN", "non_architectural_purchase", "")),
    (("Étude de la voirie et de l'éclairage public", None, None, None, False), ("reject", "REJECT", "REJECT_OUT_OF_SCOPE_INFRASTRUCTURE", "infrastructure_without_architecture", "")),
    (("Étude et levé topographique des terrains", None, None, None, False), ("reject", "REJECT", "REJECT_OUT_OF_SCOPE_INFRASTRUCTURE", "topography_only", "")),
    (("Étude de restauration des remparts de la médina", None, None, None, False), ("keep", "P1_HERITAGE", "ACCEPT_HERITAGE_PROFESSIONAL_SERVICE", None, "HERITAGE")),
    (("دراسة ترميم الأسوار التاريخية للمدينة", "étude", None, None, False), None),
    (("Étude urbaine de l'espace public de la médina", None, None, None, False), ("review", "P2_REVIEW", "REVIEW_AMBIGUOUS_RELEVANCE", None, "HERITAGE")),
    (("Concours architectural pour un musée", None, None, None, False), ("keep", "P1_CONCOURS", "ACCEPT_ARCHITECTURAL_COMPETITION", None, "CONCOURS")),
    (("Concours architectural pour une école", None, None, None, False), ("reject", "REJECT", "REJECT_GENERIC_ARCHITECTURE_NOT_STRATEGIC", "generic_architecture_not_strategic", "")),
    (("Conception du nouveau campus de l'université", None, None, None, False), ("keep", "P1_MAJOR_ARCH", "ACCEPT_MAJOR_ARCHITECTURAL_SERVICE", None, "MAJOR_ARCH")),
    (("Conception d'un théâtre", None, None, 25e6, True), ("keep", "P1_MAJOR_ARCH", "ACCEPT_MAJOR_ARCHITECTURAL_SERVICE", None, "MAJOR_ARCH")),
    (("Conception d'un théâtre", None, None, 25e6, False), ("review", "P2_REVIEW", "REVIEW_AMBIGUOUS_RELEVANCE", None, "MAJOR_ARCH")),
    (("Conception d'une salle des fêtes", None, None, None, False), ("reject", "REJECT", "REJECT_GENERIC_ARCHITECTURE_NOT_STRATEGIC", "generic_architecture_not_strategic", "")),
    (("Location de salles pour un séminaire", None, None, None, False), ("reject", "REJECT", "REJECT_NO_ARCHITECTURAL_ROLE", "no_architectural_role", "")),
    (("Étude de la pêche côtière", None, None, None, False), ("reject", "REJECT", "REJECT_NO_HERITAGE_OR_ARCHITECTURE_CONTEXT", "no_heritage_scope", "")),
    (("Diagnostic du patrimoine naturel de la région", None, None, None, False), ("reject", "REJECT", "REJECT_IRRELEVANT_DOMAIN", "natural_heritage_only", "")),
    (("Étude du port de Ksar Sghir", None, None, None, False), ("reject", "REJECT", "REJECT_NO_HERITAGE_OR_ARCHITECTURE_CONTEXT", "no_heritage_scope", "")),
    (("Étude de conservation du ksar", None, None, None, False), ("keep", "P1_HERITAGE", "ACCEPT_HERITAGE_PROFESSIONAL_SERVICE", None, "HERITAGE")),
    ((None, None, None, None, None), ("reject", "REJECT", "REJECT_NO_ARCHITECTURAL_ROLE", "no_architectural_role", "")),
]
_CASES = [c for c in _CASES if c[1]]


@golden("title string, scope string, procedure string, amount double, verified boolean", ["decision", "category", "reason", "rejection", "tracks"], _CASES)
def q_procurement_relevance(title, scope, procedure, amount, verified):
    return procurement.relevance(title, scope, procedure, amount, verified)


@golden("title string, buyer string, category string", ["first", "first_reason", "listed", "listed_reason"], [
    (("Achat de vehicules", "Commune", None), ("reject", "REJECT_IRRELEVANT_DOMAIN", "reject", "REJECT_IRRELEVANT_DOMAIN")),
    (("Travaux d'aménagement d'une place", "Commune", None), ("reject", "REJECT_PURE_EXECUTION", "reject", "REJECT_PURE_EXECUTION")),
    (("Étude de la voirie", "Commune", "Services"), ("continue", None, "reject", "REJECT_OUT_OF_SCOPE_INFRASTRUCTURE")),
    (("Étude architecturale de la rue", "Commune", "Services"), ("continue", None, "continue", None)),
    (("Étude du site", "Agence", "Services"), ("continue", None, "continue", None)),
    (("Liste des appels d'offres", "Agence", None), ("continue", None, "continue", None)),
])
def q_notice_prefilter(title, buyer, category):
    p, q = procurement.plausible(title, F.lit("")), procurement.listing_plausible(title, buyer, F.lit(None).cast("string"), category, F.lit(None).cast("string"), F.lit(None).cast("string"))
    return [p["decision"], p["reason"], q["decision"], q["reason"]]


_TITLE = FOLD.format("regexp_extract(html, '<title>([^<]*)</title>', 1)")


@query(f"""WITH k AS (SELECT page_id AS id, {_CANON} AS u, {_TITLE} AS x FROM pages), c AS (SELECT * FROM k WHERE id >= 100), e AS (SELECT * FROM k WHERE id < 100),
m AS (SELECT c.id, min(e.id) AS low, max(e.id) AS high FROM c LEFT JOIN e ON c.u = e.u OR (c.x = e.x AND length(c.x) >= 5) GROUP BY 1)
SELECT id AS page_id, CASE WHEN low = high THEN low END AS match, coalesce(low <> high, false) AS conflict FROM m""")
def q_match_existing(t):
    """Later pages against the earlier ones by address or title: the one match, or a conflict where keys point to several."""
    k = t("pages").select(F.col("page_id").alias("id"), urls.canonical_url(F.col("url")).alias("u"), text.fold_text(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("x"))
    k = k.withColumn("x", F.when(F.length("x") >= 5, F.md5("x")))
    return identity.match_existing(k.filter("id >= 100").withColumnRenamed("id", "page_id"), k.filter("id < 100"), "page_id", ["u", "x"])


@query(f"""WITH k AS (SELECT page_id AS id, page_id % 3 AS c, {_CANON} AS u, {_TITLE} AS x, md5(html) AS h FROM pages),
m AS (SELECT a.id, min(b.id) AS m FROM k a JOIN k b ON a.u = b.u AND a.c <> b.c GROUP BY 1), n AS (SELECT a.id, min(b.id) AS m FROM k a JOIN k b ON a.x = b.x AND a.h = b.h AND a.c <> b.c WHERE length(a.x) >= 25 GROUP BY 1)
SELECT k.id, coalesce(m.m, n.m) AS mirror, coalesce(o.h <> k.h, false) AS material FROM k LEFT JOIN m USING (id) LEFT JOIN n USING (id) LEFT JOIN k o ON o.id = m.m""")
def q_mirrors(t):
    """Pages of three collections: the same item in another one, by address, else by long title and equal content."""
    x = text.fold_text(F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    k = t("pages").select(F.col("page_id").alias("id"), (F.col("page_id") % 3).alias("collection"), urls.canonical_url(F.col("url")).alias("url_key"), x.alias("title_key"), F.md5("html").alias("content_key"), F.lit(True).alias("has_body"))
    return identity.mirrors(k)


@query(f"""WITH RECURSIVE k AS (SELECT page_id, md5(left(regexp_extract(html, '<title>([^<]*)</title>', 1), 4)) AS a, {_CANON} AS b FROM pages), p AS (SELECT row_number() OVER (ORDER BY page_id) AS n, * FROM k),
w AS (SELECT 0::BIGINT AS n, NULL::BIGINT AS page_id, true AS kept, []::VARCHAR[] AS seen
  UNION ALL SELECT p.n, p.page_id, NOT list_has_any(w.seen, ['a' || p.a, 'b' || p.b]), CASE WHEN list_has_any(w.seen, ['a' || p.a, 'b' || p.b]) THEN w.seen ELSE list_concat(w.seen, ['a' || p.a, 'b' || p.b]) END FROM w JOIN p ON p.n = w.n + 1)
SELECT page_id, kept FROM w WHERE n > 0""")
def q_first_wins_any(t):
    """Pages in order: one stays if none that stayed before it has its address or the start of its title."""
    k = t("pages").select("page_id", F.md5(F.regexp_extract("html", "<title>([^<]*)</title>", 1).substr(1, 4)).alias("a"), urls.canonical_url(F.col("url")).alias("b"))
    return identity.first_wins_any(k, "page_id", ["a", "b"])
