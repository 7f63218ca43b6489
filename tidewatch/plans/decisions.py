"""Registered queries for rule sets, scores, values read from text, identity and streams, with their SQL.

Roles as in ``catalog``; orders are also notices (their price an amount, their date a publication date).
"""

from __future__ import annotations

import tempfile
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text, urls, values
from ..operators import evidence, notices, rules
from ..sources import pages
from ..streaming import changes, runs, states
from .catalog import _CANON, AS_OF, FOLD, ORACLE, QUERIES, query, register  # noqa: F401  (QUERIES: for tests)


def _any(terms: list[str], whole: bool = True) -> str:
    """SQL test of the folded text ``f`` for a term list."""
    return "(" + " OR ".join(f"contains(' ' || f || ' ', ' {t} ')" if whole else f"contains(f, '{t}')" for t in terms) + ")"


def _case(rows: list[tuple[str, str]], other: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {test} THEN '{name}'" for name, test in rows) + f" ELSE {other} END"


_DOCS = f"WITH d AS (SELECT doc_id, source, {FOLD.format('text')} AS f FROM documents)"


def _shared(spark: SparkSession) -> str:
    """A new folder for a query's stream: below the cluster's checkpoint folder, else (tests) a local one."""
    root = spark.conf.get("spark.checkpoint.dir", "")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        return tempfile.mkdtemp(prefix="spark-")
    return f"{root.rstrip('/')}/stream-{spark.sql('SELECT uuid()').first()[0]}"


@query(f"""{_DOCS}, s AS (SELECT f, {_case([(n, _any(t, False)) for n, t in L.PROJECT_SIGNALS])} AS signal, doc_id FROM d), p AS (SELECT doc_id, signal, {_case([("published_tender", _any(L.PROJECT_TENDER, False)), ("completed", _any(L.PROJECT_DONE, False) + " AND NOT " + _any(L.PROJECT_NEWS, False)), ("vague", "signal IS NULL"), ("irrelevant", "NOT " + _any(L.PROJECT_SCOPE, False) + " OR (" + _any(L.PROJECT_OTHER, False) + " AND NOT " + _any(L.PROJECT_RESCUE, False) + ")")])} AS rejection FROM s)
SELECT signal, rejection, count(*) AS n FROM p GROUP BY 1, 2""")
def q_project_signal(t):
    p = rules.project_signal(F.col("text"), F.lit(None).cast("date"), F.lit(AS_OF).cast("date"))
    return t("documents").select(p.alias("p")).groupBy("p.signal", "p.rejection").agg(F.count("*").alias("n"))


@query(f"""{_DOCS}, s AS (SELECT f, {_case([("closed", _any(L.FUNDING_CLOSED)), ("pipeline", _any(L.FUNDING_FRAMEWORK, False)), ("open", "NOT " + _any(L.FUNDING_NOT_OPEN, False) + " AND " + _any(L.FUNDING_OPEN)), ("active", _any(L.FUNDING_ACTIVE)), ("preparation", _any(L.FUNDING_PREPARED))], "'pipeline'")} AS st, {_any(L.FUNDING_PLACES)} AND {_any(L.FUNDING_SCOPE)} AS inside FROM d)
SELECT CASE WHEN inside THEN st END AS status, count(*) AS n FROM s GROUP BY 1""")
def q_funding_status(t):
    return t("documents").select(rules.funding(F.col("text"))["status"].alias("status")).groupBy("status").agg(F.count("*").alias("n"))


@query(f"""{_DOCS} SELECT {_any(L.INSTITUTION_SCOPE)} AS relevant, {_case([(n, _any(x)) for n, x in L.INSTITUTION_ACTIVITIES], "'CURRENT_PROFILE'")} AS activity, {_case([(n, _any(x)) for n, x in L.INSTITUTION_ROLES])} AS role, {_any(L.INSTITUTION_OBSOLETE)} AS obsolete, count(*) AS n FROM d GROUP BY ALL""")
def q_institution_class(t):
    s = t("documents").select(rules.institution(F.col("text"), F.lit(None).cast("date"), F.lit(AS_OF).cast("date")).alias("s"))
    return s.groupBy("s.relevant", "s.activity", "s.role", "s.obsolete").agg(F.count("*").alias("n"))


#: Notices (title, procedure, category) that the orders are taken to carry in turn.
NOTICES = [
    ("Étude de restauration des remparts de la médina", "", "services"), ("Travaux de construction d'une mosquée à Fès", "", "travaux"),
    ("Concours architectural pour un théâtre régional", "concours", "services"), ("Études techniques et suivi du musée national", "", "services"),
    ("Achat de matériel informatique pour la commune", "", "fournitures"), ("Achat de tables et de chaises diverses", "", "fournitures"),
    ("Étude de construction d'une école à Rabat", "", "services"), ("Levés topographiques de la zone industrielle", "", "services"),
    ("Consultation PMMP", "", ""), ("دراسة ترميم الأسوار التاريخية للمدينة", "", ""), ("بناء مركز للشباب بالجماعة القروية", "", ""),
    ("Location de salles pour un séminaire annuel", "", "services"), ("Aménagement de la kasbah historique et de ses abords…", "", "travaux"),
]
_LATIN = "trim(regexp_replace(translate(strip_accents(replace(lower({0}), 'œ', 'oe')), 'أإآىـ', 'اااي'), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"
_VALUES = ", ".join("(%d, %s)" % (i, ", ".join("'" + x.replace("'", "''") + "'" for x in row)) for i, row in enumerate(NOTICES))
_ADDED = " || ".join(f"CASE WHEN contains(b, '{a}') AND NOT contains(' ' || b || ' ', ' {x} ') THEN ' {x}' ELSE '' END" for a, x in L.TITLE_EQUIVALENTS)
_PLAIN = [(n, _any(t, False)) for n, t in (("hd", L.TITLE_HERITAGE), ("proof", L.TITLE_HERITAGE_PROOF), ("mj", L.TITLE_MAJOR), ("un", L.TITLE_UNRELATED), ("un2", L.TITLE_UNIVERSITY), ("mq", L.TITLE_MOSQUE), ("ord", L.TITLE_ORDINARY))]
_STEP = "(" + " OR ".join(f"contains(f || s, '{x}')" for x in L.TITLE_CONTEST) + ")"
_REASON = _case([("unrelated_scope", "un"), ("supply_purchase", "k = 'fournitures' AND NOT sv AND NOT ct"), ("ordinary_facility_or_infrastructure", "(ord OR contains(' ' || f || ' ', ' ista ')) AND NOT (hd AND proof) AND NOT un2 AND NOT (cut AND mq)"), ("unrelated_topography", "contains(f, 'topograph') AND NOT hd AND NOT mj AND NOT ct"), ("pure_execution", "(contains(f, 'travaux') OR k = 'travaux') AND NOT sv AND NOT ct AND NOT (cut AND hd AND NOT starts_with(f, 'travaux'))"), ("A_heritage_service", "hd AND sv"), ("C_architectural_competition", "ct"), ("D_major_architecture", "mj AND sv"), ("incomplete_scope_requires_detail", "f IN ('', 'consultation pmmp', 'details', 'detail') OR length(b) < 20 OR (cut AND (hd OR sv OR mj))"), ("arabic_scope_requires_detail", "arabic")], "'no_relevant_title_context'")

_PRIORITY = "CASE " + " ".join(f"WHEN reason = '{n}' THEN {p}" for n, p in L.TITLE_PRIORITY.items()) + " ELSE 9 END"


@query(f"""WITH n(i, title, step, kind) AS (VALUES {_VALUES}), a AS (SELECT i, {_LATIN.format("title")} AS b, {_LATIN.format("step")} AS s, {_LATIN.format("kind")} AS k, regexp_matches(title, '(\\.\\.\\.|…)\\s*$') AS cut, regexp_matches(title, '[؀-ۿ]') AS arabic FROM n),
t AS (SELECT *, b || {_ADDED} AS f FROM a), h AS (SELECT *, {", ".join(f"{x} AS {n}" for n, x in _PLAIN)}, {_any(L.TITLE_SERVICE)} AS sv, (contains(f || s, 'architectur') AND {_STEP}) OR contains(f, 'concours de conception') AS ct FROM t),
r AS (SELECT i, {_REASON} AS reason FROM h)
SELECT reason, {_PRIORITY} AS priority, count(*) AS n FROM orders JOIN r ON i = o_orderkey % {len(NOTICES)} GROUP BY 1, 2""")
def q_title_selector(t):
    """Notices selected by their titles alone."""
    rows = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(("title", "procedure", "category"), row, strict=True)]) for row in NOTICES])
    n = t("orders").select(F.get(rows, (F.col("o_orderkey") % len(NOTICES)).cast("int")).alias("n"))
    s = n.select(notices.select_title(F.col("n.title"), F.col("n.procedure"), F.col("n.category")).alias("s"))
    return s.groupBy("s.reason", "s.priority").agg(F.count("*").alias("n"))


DOMAINS = {"legal": ["license", "copyright", "apache"], "german": ["und", "der"], "french": ["les", "des"]}
_FOUND = "list_filter([" + ", ".join(f"CASE WHEN {_any(t)} THEN '{n}' END" for n, t in DOMAINS.items()) + "], lambda x: x IS NOT NULL)"


@query(f"""{_DOCS} SELECT doc_id, array_to_string({_FOUND}, ',') AS domains, CASE WHEN len({_FOUND}) = 0 THEN 'reject' WHEN {_any(["the", "die", "la"])} THEN 'keep' ELSE 'review' END AS decision,
CASE WHEN len({_FOUND}) > 0 THEN NULL WHEN {_any(["los", "que"])} THEN 'unrelated_generic_content' ELSE 'outside_scope' END AS reason FROM d""")
def q_scope_boundary(t):
    b = rules.boundary(F.col("text"), DOMAINS, ["los", "que"], ["the", "die", "la"])
    return t("documents").select("doc_id", b.alias("b")).select("doc_id", F.array_join("b.domains", ",").alias("domains"), "b.decision", "b.reason")


@query("""WITH e AS (SELECT event_id, value / 100 AS conf, event_type = 'error' AS manual, event_type <> 'click' AS relevant FROM events)
SELECT CASE WHEN NOT relevant OR (conf < 0.55 AND NOT manual) THEN 'rejected' WHEN conf < 0.8 OR manual THEN 'review' ELSE 'accepted' END AS gate, count(*) AS n FROM e GROUP BY 1""")
def q_gate_confidence(t):
    kind = F.col("event_type")
    gate = rules.confidence_gate(kind != "click", F.col("value") / 100, kind == "error")
    return t("events").groupBy(gate.alias("gate")).agg(F.count("*").alias("n"))


@query(f"""{_DOCS}, s AS (SELECT doc_id, CASE WHEN {_any(["password"], False)} THEN 0 ELSE greatest(0, least(100, 35 + least(35, 10 * (contains(f, 'the')::INT + contains(f, 'que')::INT + contains(f, 'license')::INT + contains(f, 'und')::INT)) + CASE WHEN {_any(["les", "der"], False)} THEN 20 ELSE -35 END + CASE WHEN source = 'src0' THEN 10 ELSE 0 END)) END AS score FROM d)
SELECT doc_id, score FROM s WHERE score >= 45""")
def q_targeted_score(t):
    d = t("documents").select("doc_id", "source", text.fold_text(F.col("text")).alias("f"))
    score = rules.targeted_score(F.col("f"), ["the", "que", "license", "und"], ["password"], ["les", "der"], F.col("source") == "src0")
    return d.select("doc_id", score.alias("score")).filter("score >= 45")


def _fed_back(t, part) -> DataFrame:
    words = part(F.filter(F.split(text.fold_text(F.col("text")), " "), lambda w: F.length(w) >= 5))
    features = t("documents").select("doc_id", F.explode(F.array_distinct(words)).alias("feature"))
    judged = features.join(t("labels").select("doc_id", (F.col("quality") == 1).alias("approved")), "doc_id")
    return evidence.feedback_score(features, evidence.feedback_profile(judged), "doc_id")


@query(f"""WITH w AS (SELECT DISTINCT doc_id, feature FROM (SELECT doc_id, unnest(list_filter(string_split({FOLD.format('text')}, ' '), lambda x: length(x) >= 5)[1:12]) AS feature FROM documents)),
p AS (SELECT feature, count(*) FILTER (quality = 1) AS a, count(*) FILTER (quality = 0) AS r FROM w JOIN labels USING (doc_id) GROUP BY 1),
s AS (SELECT feature, CASE WHEN a >= 3 AND a > r THEN (a - r) / (a + r) END AS up, CASE WHEN r >= 3 AND r > a THEN (r - a) / (a + r) END AS down FROM p),
h AS (SELECT doc_id, coalesce(sum(up), 0) - coalesce(sum(down), 0) AS raw, count(up) AS positive, count(down) AS negative FROM w LEFT JOIN s USING (feature) GROUP BY 1)
SELECT doc_id, round(greatest(-0.85, least(0.85, CASE WHEN positive > 0 AND negative > 0 THEN raw * 0.35 ELSE raw END / 6)), 3) AS score, positive, negative FROM h""")
def q_feedback_score(t):
    """Reviews feed back, by the first 12 long words of a text: features approved or rejected at least three times move a score."""
    return _fed_back(t, lambda words: F.slice(words, 1, 12))


@query(ORACLE["q_feedback_score"].replace("[1:12]", ""))
def q_feedback_score_whole(t):
    """The same by all long words of a text."""
    return _fed_back(t, lambda words: words)


_SOURCE = "CASE event_type WHEN 'view' THEN 'GOVERNANCE' WHEN 'click' THEN 'APPOINTMENT' WHEN 'error' THEN 'PROFESSIONAL' ELSE 'OFFICIAL_RELEASE' END"


def _role_holders(events: DataFrame) -> DataFrame:
    e = events.select("user_id", F.expr("concat('p', event_id % 3)").alias("person"), F.expr(_SOURCE).alias("source"), F.expr("CASE WHEN event_id % 10 > 0 THEN to_date(ts) END").alias("dated"), (F.col("value") > 60).alias("departed"))
    return evidence.role_holder(e, ["user_id"], F.lit("2024-01-25").cast("date"))


@query(f"""WITH e AS (SELECT user_id, 'p' || (event_id % 3) AS person, {_SOURCE} AS source, CASE WHEN event_id % 10 > 0 THEN ts::DATE END AS dated, value > 60 AS departed FROM events),
r AS (SELECT *, (source = 'PROFESSIONAL')::INT AS u, CASE source WHEN 'GOVERNANCE' THEN 1 WHEN 'APPOINTMENT' THEN 3 WHEN 'OFFICIAL_RELEASE' THEN 4 ELSE 6 END AS k FROM e WHERE dated IS NULL OR dated <= DATE '2024-01-25'),
b AS (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY u, dated DESC NULLS LAST, k) AS place FROM r),
f AS (SELECT user_id, min(person) AS low, max(person) AS high, bool_or(departed) AS gone, min(dated) AS dated, max(u) AS u FROM b WHERE place = 1 GROUP BY 1),
s AS (SELECT *, CASE WHEN gone OR date_diff('day', dated, DATE '2024-01-25') > 180 THEN 'OBSOLETE' WHEN low <> high THEN 'UNVERIFIED' WHEN u = 1 OR dated IS NULL THEN 'PROBABLY_CURRENT' ELSE 'VERIFIED_CURRENT' END AS status FROM f)
SELECT user_id, CASE WHEN status <> 'UNVERIFIED' THEN low END AS person, status FROM s""")
def q_role_resolution(t):
    return _role_holders(t("events"))


@query()
def q_snippets(t):
    """Sentences of evidence per document; a greedy budget, held against a plain version in the tests."""
    return t("documents").select("doc_id", F.array_join(evidence.ranked_sentences(F.col("text")), "|").alias("snippets"))


@query()
def q_pii_scrub(t):
    """Contacts omitted; Unicode word rules differ in SQL, so the tests hold it against a plain version."""
    return t("documents").select("doc_id", F.md5(values.omit_contacts(F.col("text"))).alias("scrubbed"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN o_orderdate::DATE::VARCHAR END AS day FROM orders")
def q_parse_dates(t):
    """Dates written in three ways and read back; a day that does not exist is null."""
    written = F.expr("CASE o_orderkey % 4 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') || 'T08:00' WHEN 1 THEN date_format(o_orderdate, 'dd/MM/yyyy') WHEN 2 THEN date_format(o_orderdate, 'd-M-yyyy') ELSE '31/02/1998' END")
    return t("orders").select("o_orderkey", values.date_of(written).cast("string").alias("day"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 4 THEN round(o_totalprice, 2) END AS amount, CASE WHEN o_orderkey % 5 = 3 THEN 'EUR' ELSE 'MAD' END AS currency, CASE WHEN o_orderkey % 5 IN (0, 4) THEN 'TTC' WHEN o_orderkey % 5 = 1 THEN 'HT' ELSE 'UNKNOWN' END AS tax_mode FROM orders")
def q_parse_amount(t):
    """Amounts written in French and read back; a placeholder keeps currency and tax wording."""
    written = F.expr("CASE o_orderkey % 5 WHEN 4 THEN '* TTC MAD' ELSE translate(format_number(o_totalprice, 2), ',.', ' ,') || element_at(array(' DH TTC', ' dhs H.T. HT', ' MAD', ' eur'), CAST(o_orderkey % 5 AS INT) + 1) END")
    return t("orders").select("o_orderkey", values.amount(written).alias("v")).select("o_orderkey", F.round("v.amount", 2).alias("amount"), "v.currency", "v.tax_mode")


@query("SELECT user_id, CASE WHEN count(*) FILTER (event_type = 'error') = 0 THEN round(sum((80 * 2.5 + 20 * 0.25 + event_id % 50 * 10) / 1e6), 6) END AS cost FROM events GROUP BY 1")
def q_call_cost(t):
    """Cost per entity; unknown as soon as one call's is."""
    unknown = F.when(F.col("event_type") != "error", F.lit(20))
    cost = values.call_cost(F.lit(100), unknown, F.col("event_id") % 50, ("2.5", "0.25", "10"))
    return t("events").groupBy("user_id").agg(F.round(values.sum_or_unknown(cost).cast("double"), 6).alias("cost"))


@query("""WITH s AS (SELECT user_id, count(*) AS c, arg_max(event_type, (ts, event_id)) AS last, arg_min(value, (ts, event_id)) AS a, arg_max(value, (ts, event_id)) AS b FROM events GROUP BY 1),
p AS (SELECT *, CASE user_id % 3 WHEN 0 THEN 'APPROVED' WHEN 1 THEN 'REJECTED' ELSE 'PENDING' END AS prev FROM s)
SELECT user_id, CASE WHEN c = 1 THEN 'NEW' ELSE 'UPDATED' END AS discovery, CASE WHEN last <> 'error' AND (c = 1 OR a <> b) THEN 'PENDING' ELSE prev END AS review,
CASE WHEN c = 1 THEN 'DISCOVERED' WHEN last <> 'error' AND a <> b AND prev IN ('APPROVED', 'REJECTED') THEN 'REOPENED' ELSE 'UPDATED' END AS event FROM p""")
def q_lifecycle_transition(t):
    order = F.struct("ts", "event_id")
    s = t("events").groupBy("user_id").agg(F.count("*").alias("c"), F.max_by("event_type", order).alias("last"), F.min_by("value", order).alias("a"), F.max_by("value", order).alias("b"))
    previous = F.expr("CASE user_id % 3 WHEN 0 THEN 'APPROVED' WHEN 1 THEN 'REJECTED' ELSE 'PENDING' END")
    return s.select("user_id", rules.lifecycle(F.col("c") == 1, F.col("last") != "error", F.col("a") != F.col("b"), previous).alias("r")).select("user_id", "r.*")


@query("(SELECT c_nationkey AS k, 'both' AS side FROM customer INTERSECT SELECT s_nationkey, 'both' FROM supplier) UNION ALL (SELECT c_nationkey, 'left' FROM customer EXCEPT SELECT s_nationkey, 'left' FROM supplier)")
def q_intersect_except(t):
    c, s = t("customer").select(F.col("c_nationkey").alias("k")), t("supplier").select(F.col("s_nationkey").alias("k"))
    return c.intersect(s).withColumn("side", F.lit("both")).unionByName(c.subtract(s).withColumn("side", F.lit("left")))


@query("SELECT kind, id, day FROM (SELECT 0 AS kind, o_orderkey AS id, o_orderdate::DATE::VARCHAR AS day FROM orders UNION ALL SELECT 1, event_id, ts::DATE::VARCHAR FROM events) ORDER BY day DESC, kind, id LIMIT 100")
def q_ordered_union(t):
    """Two logs in one order, newest first: the page shown."""
    o = t("orders").select(F.lit(0).alias("kind"), F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").cast("string").alias("day"))
    e = t("events").select(F.lit(1).alias("kind"), F.col("event_id").alias("id"), F.to_date("ts").cast("string").alias("day"))
    return o.unionByName(e).orderBy(F.desc("day"), "kind", "id").limit(100)


@query("SELECT o_orderkey, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40")
def q_page_total(t):
    """The third page of twenty and the number of all rows (the total is one row of one number)."""
    page = t("orders").orderBy(F.desc("o_orderdate"), "o_orderkey").offset(40).limit(20).select("o_orderkey")
    return page.join(F.broadcast(t("orders").agg(F.count("*").alias("total"))))


@query("""WITH r AS (SELECT o_orderkey, o_custkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders)
SELECT o_custkey, l_returnflag AS family, round(sum(l_quantity), 2) AS units, count(*) FILTER (l_discount = 0) AS zero, max(o_orderdate)::DATE::VARCHAR AS last_run FROM r JOIN lineitem ON l_orderkey = o_orderkey WHERE n <= 10 GROUP BY 1, 2""")
def q_query_performance(t):
    """Yield of the last ten runs of each key, per family."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    last = t("orders").select("o_custkey", "o_orderkey", "o_orderdate", F.row_number().over(w).alias("n")).filter("n <= 10")
    return last.join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey", F.col("l_returnflag").alias("family")).agg(F.round(F.sum("l_quantity"), 2).alias("units"), F.count_if(F.expr("l_discount = 0")).alias("zero"), F.to_date(F.max("o_orderdate")).cast("string").alias("last_run"))


@query(f"""WITH k AS (SELECT page_id, {_CANON} AS u, {FOLD.format("regexp_extract(html, '<title>([^<]*)</title>', 1)")} AS x FROM pages)
SELECT page_id, min(page_id) OVER (PARTITION BY u) AS by_url, CASE WHEN length(x) >= 25 THEN min(page_id) OVER (PARTITION BY x) END AS by_title FROM k""")
def q_identity_or_keys(t):
    """The earliest page with the same address, and with the same long title: keys pre-aggregated, side by side."""
    k = t("pages").select("page_id", urls.canonical_url(F.col("url")).alias("u"), text.fold_text(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("x"))
    both = k.withColumn("u", F.coalesce("u", F.lit("")))
    first_u = both.groupBy("u").agg(F.min("page_id").alias("by_url"))
    first_x = both.filter(F.length("x") >= 25).groupBy("x").agg(F.min("page_id").alias("by_title"))
    return both.join(first_u, "u", "left").join(first_x, "x", "left").select("page_id", "by_url", "by_title")


@query(r"""WITH p AS (SELECT page_id, regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1\s*>', 1) AS h, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title\s*>', 1) AS x FROM pages)
SELECT (h <> '') AS has_heading, count(*) AS n FROM p GROUP BY 1""")
def q_page_headings(t):
    return t("pages").groupBy((F.regexp_extract("html", r"(?is)<h1\b[^>]*>(.*?)</h1\s*>", 1) != "").alias("has_heading")).agg(F.count("*").alias("n"))


@query()
def q_page_records(t):
    """Records of raw pages with a reason where there is none; held against a plain parser in the tests."""
    return pages.records(t("pages"))


def q_stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """Daily totals as a stream with late data allowed, run through and read back."""
    place = _shared(spark)
    source = changes.events(spark, f"{d}/events.parque*", spark.read.parquet(f"{d}/events.parquet").schema)
    daily = changes.DailyTotals(spark, place).follow(changes.daily_totals(source))
    return daily.select(F.to_date("window.start").cast("string").alias("day"), "event_type", "n", F.round("total", 2).alias("total"))


def q_stream_cdc(spark: SparkSession, d: str) -> DataFrame:
    """Change classes of an event stream against a durable state per entity, run through and read back."""
    source = changes.events(spark, f"{d}/events.parque*", spark.read.parquet(f"{d}/events.parquet").schema)
    state = changes.StateTable(spark, _shared(spark), "user_id long, event_type string")
    seen = state.follow(source.select("user_id", "event_type", "ts", "event_id"), "user_id", "event_type", ["ts", "event_id"])
    return seen.groupBy("state").agg(F.count("*").alias("n"))


def q_stream_runs(spark: SparkSession, d: str) -> DataFrame:
    """Life of runs of every user's events as a stream: one run at a time, failed by a timer after half a day."""
    source = changes.events(spark, f"{d}/events.parque*", spark.read.parquet(f"{d}/events.parquet").schema)
    steps = {"signup": "reserve", "view": "claim", "click": "stage", "purchase": "complete", "error": "fail"}
    step = F.try_element_at(F.create_map(*[F.lit(x) for pair in steps.items() for x in pair]), F.col("event_type"))
    asked = source.select(F.col("user_id").alias("scope"), F.col("event_id").alias("id"), F.col("ts").alias("at"), step.alias("step"), F.col("event_type").alias("detail"))
    done = runs.followed(runs.log(asked, timedelta(hours=12)), _shared(spark))
    return done.select("scope", "run", F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"), "status", "detail")


def q_stream_states(spark: SparkSession, d: str) -> DataFrame:
    """Change classes of an event stream against the newest state of each entity, kept by the stream itself."""
    source = changes.events(spark, f"{d}/events.parque*", spark.read.parquet(f"{d}/events.parquet").schema)
    rows = source.select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("ts").alias("at"), F.col("event_type").alias("digest"))
    return runs.followed(states.changes(rows), _shared(spark)).select("key", "id", "state")


register("q_stream_states", q_stream_states, "SELECT user_id AS key, event_id AS id, CASE WHEN b IS NULL THEN 'NEW' WHEN b = event_type THEN 'UNCHANGED' ELSE 'UPDATED' END AS state FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events)")
register("q_stream_tumbling", q_stream_tumbling, "SELECT ts::DATE::VARCHAR AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
register("q_stream_cdc", q_stream_cdc, "SELECT CASE WHEN b IS NULL THEN 'NEW' WHEN b = event_type THEN 'UNCHANGED' ELSE 'UPDATED' END AS state, count(*) AS n FROM (SELECT event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) GROUP BY 1")
register("q_stream_runs", q_stream_runs, """WITH RECURSIVE e AS (SELECT user_id AS scope, event_id AS id, ts, event_type AS d, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE ts <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR),
w AS (SELECT DISTINCT scope, 0::BIGINT AS n, NULL::BIGINT AS run, NULL::BOOLEAN AS claimed, NULL::TIMESTAMP AS since, NULL::BIGINT AS gone, NULL::TIMESTAMP AS gone_at, NULL::BIGINT AS of_run, NULL::TIMESTAMP AS tm, NULL::VARCHAR AS status, NULL::VARCHAR AS detail FROM e
UNION ALL SELECT scope, n, CASE WHEN d = 'signup' THEN coalesce(live, id) WHEN d IN ('purchase', 'error') THEN NULL ELSE live END, CASE d WHEN 'signup' THEN live IS NOT NULL AND claimed WHEN 'view' THEN live IS NOT NULL WHEN 'click' THEN claimed ELSE false END, CASE WHEN d = 'signup' AND live IS NULL THEN ts WHEN d IN ('purchase', 'error') THEN NULL WHEN live IS NULL THEN NULL ELSE since END,
 gone, gone_at, CASE WHEN d = 'signup' THEN id ELSE live END, ts,
 CASE WHEN d = 'signup' THEN CASE WHEN live IS NULL THEN 'INITIALIZED' ELSE 'REJECTED' END WHEN live IS NULL OR (d = 'view' AND claimed) THEN 'REJECTED' WHEN d = 'view' THEN 'RUNNING' WHEN d = 'click' THEN CASE WHEN claimed THEN 'RUNNING' ELSE 'INITIALIZED' END WHEN d = 'purchase' THEN 'COMPLETED' ELSE 'FAILED' END,
 CASE WHEN d = 'signup' AND live IS NOT NULL THEN 'already_running' WHEN d <> 'signup' AND live IS NULL THEN 'not_active' WHEN d = 'view' AND claimed THEN 'already_claimed' ELSE d END
 FROM (SELECT e.scope, e.n, e.id, e.ts, e.d, CASE WHEN w.since + INTERVAL 12 HOUR > e.ts THEN w.run END AS live, coalesce(w.since + INTERVAL 12 HOUR > e.ts AND w.claimed, false) AS claimed, w.since, CASE WHEN w.since + INTERVAL 12 HOUR <= e.ts THEN w.run END AS gone, CASE WHEN w.since + INTERVAL 12 HOUR <= e.ts THEN w.since + INTERVAL 12 HOUR END AS gone_at FROM w JOIN e ON e.scope = w.scope AND e.n = w.n + 1)),
l AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY n DESC) AS last FROM w),
a AS (SELECT scope, of_run AS run, tm, status, detail FROM w WHERE n > 0 UNION ALL SELECT scope, gone, gone_at, 'FAILED', 'stale_run_recovered' FROM w WHERE gone IS NOT NULL
UNION ALL SELECT scope, run, since + INTERVAL 12 HOUR, 'FAILED', 'stale_run_recovered' FROM l WHERE last = 1 AND run IS NOT NULL AND since + INTERVAL 12 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR)
SELECT scope, run, strftime(tm, '%Y-%m-%d %H:%M:%S.%f') AS "at", status, detail FROM a""")
