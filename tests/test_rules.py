"""Rule sets, values, evidence, pages and the state table on small rows with known results."""

import datetime
import re

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import lexicons, values
from tidewatch.operators import evidence, notices, rules
from tidewatch.plans import decisions
from tidewatch.sources import pages
from tidewatch.streaming import changes

DIR = "/root/testdata/sf0.001"
AS_OF = "2024-01-31"


def column(spark, rows, build, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, t {kind}")
    return [r[0] for r in df.orderBy("i").select(build(F.col("t"))).collect()]


def test_amounts(spark):
    rows = ["17 250 300,40 MAD TTC", "1,5 million dh", "2 milliards", "* TTC MAD", "12 mdh HT", "", None, "néant", "7.25 EUR", "Budget : 300 USD"]
    got = [tuple(r) for r in column(spark, rows, values.amount)]
    assert got == [(17250300.4, "MAD", "TTC"), (1500000.0, "MAD", "UNKNOWN"), (2e9, None, "UNKNOWN"), (None, "MAD", "TTC"), (12e6, "MAD", "HT"), (None, None, None), (None, None, None), (None, None, None), (7.25, "EUR", "UNKNOWN"), (300.0, "USD", "UNKNOWN")]


def test_dates(spark):
    rows = ["2024-02-29", "2023-02-29", "05/03/2024 à 10h", "5-3-2024", "bad", "", None, "2024-1-5"]
    day = datetime.date
    assert column(spark, rows, values.date_of) == [day(2024, 2, 29), None, day(2024, 3, 5), day(2024, 3, 5), None, None, None, day(2024, 1, 5)]
    rows = ["Fès, le 3 février 2024.", "le 31 Août 2023", "30 février 2024", "vu 2024-05-06", "rien", None]
    assert column(spark, rows, values.french_date) == [day(2024, 2, 3), day(2023, 8, 31), None, day(2024, 5, 6), None, None]


def test_cost_is_unknown_when_a_count_is(spark):
    df = spark.createDataFrame([(1, 100, 20, 10), (1, 50, 0, 0), (2, 10, 20, 0), (2, 10, 0, 0)], "k int, i int, c int, o int")
    cost = values.call_cost(F.col("i"), F.col("c"), F.col("o"), ("2", "1", "10"))
    got = {r["k"]: r["x"] for r in df.groupBy("k").agg(values.sum_or_unknown(cost).cast("double").alias("x")).collect()}
    assert got == {1: pytest.approx(0.00038), 2: None}


def test_project_signals(spark):
    rows = ["Financement approuvé pour la réhabilitation de la médina", "Appel d'offres : projet de restauration du monument", "Projet achevé : convention signée pour le patrimoine", "Discours sur l'architecture", "Lancement du projet d'autoroute", None]
    got = [tuple(r) for r in column(spark, rows, lambda t: rules.project_signal(t, F.lit(None).cast("date"), F.lit(AS_OF).cast("date")))]
    assert got == [("FINANCING_APPROVED", "A", None, 1), ("PROJECT_ANNOUNCED", "B", "published_tender", 1), ("CONVENTION_SIGNED", "B", None, 1), (None, "D", "vague", 2), ("PROJECT_ANNOUNCED", "B", "irrelevant", 2), (None, "D", "vague", 2)]
    old = column(spark, ["Projet annoncé : architecture", "Projet annoncé, nouvelle phase d'architecture"], lambda t: rules.project_signal(t, F.lit("2023-01-01").cast("date"), F.lit(AS_OF).cast("date"))["rejection"])
    assert old == ["old", None]


def test_funding(spark):
    rows = ["Morocco heritage: open call, eligibles", "Morocco urban project, not an open call, approved", "Maroc patrimoine : dossier clôture", "Heritage open call", "Morocco urban strategic pipeline framework, technical assistance", None]
    got = [r and tuple(r) for r in column(spark, rows, rules.funding)]
    assert got == [("open", "A", "DIRECT_ACCESS"), ("active", "B", "MONITORING_ONLY"), ("closed", "E", "MONITORING_ONLY"), None, ("pipeline", "D", "TECHNICAL_ASSISTANCE"), None]


def test_institution_and_boundary(spark):
    rows = ["M. X nommé directeur général de l'urbanisme", "ancien directeur", None]
    got = [tuple(r) for r in column(spark, rows, lambda t: rules.institution(t, F.lit("2023-12-01").cast("date"), F.lit(AS_OF).cast("date")))]
    assert got == [(True, "NEW_APPOINTMENT", "STRATEGIC_DECISION_MAKER", False, True), (False, "CURRENT_PROFILE", None, True, True), (False, "CURRENT_PROFILE", None, False, True)]
    got = [tuple(r) for r in column(spark, ["projet de médina", "médina", "football", "rien", None], lambda t: rules.boundary(t, {"old": ["medina"]}, ["football"], ["projet"]))]
    assert got == [("keep", ["old"], None), ("review", ["old"], None), ("reject", [], "unrelated_generic_content"), ("reject", [], "outside_scope"), ("reject", [], "outside_scope")]


def test_role_holder(spark):
    day = datetime.date
    rows = [
        ("a", "Ali", "GOVERNANCE", day(2024, 1, 1), False), ("a", "Sara", "APPOINTMENT", day(2024, 1, 5), False), ("a", "Late", "GOVERNANCE", day(2025, 1, 1), False),
        ("b", "Ali", "GOVERNANCE", day(2024, 1, 1), False), ("b", "Sara", "GOVERNANCE", day(2024, 1, 1), False), ("c", "Ali", "PROFESSIONAL", day(2024, 1, 1), False),
        ("d", "Ali", "GOVERNANCE", None, False), ("e", "Ali", "GOVERNANCE", day(2023, 1, 1), False), ("f", "Ali", "UNKNOWN", day(2024, 1, 1), False),
        ("g", "Pro", "PROFESSIONAL", day(2024, 1, 9), False), ("g", "Off", "GOVERNANCE", day(2024, 1, 1), False), ("h", "Ali", "GOVERNANCE", day(2024, 1, 1), True),
    ]
    df = spark.createDataFrame(rows, "slot string, person string, source string, dated date, departed boolean")
    got = {r["slot"]: (r["person"], r["status"]) for r in evidence.role_holder(df, ["slot"], F.lit(AS_OF).cast("date")).collect()}
    assert got == {"a": ("Sara", "VERIFIED_CURRENT"), "b": (None, "UNVERIFIED"), "c": ("Ali", "PROBABLY_CURRENT"), "d": ("Ali", "PROBABLY_CURRENT"), "e": ("Ali", "OBSOLETE"), "g": ("Off", "VERIFIED_CURRENT"), "h": ("Ali", "OBSOLETE")}


def test_feedback_only_demotes(spark):
    df = spark.createDataFrame([("keep", -0.5, 2), ("keep", -0.5, 1), ("reject", 0.8, 0), ("review", 0.8, 0)], "d string, s double, n int")
    assert [r[0] for r in df.select(rules_adjusted()).collect()] == ["review", "keep", "reject", "review"]


def rules_adjusted():
    return evidence.adjusted(F.col("d"), F.col("s"), F.col("n"))


def plain_snippets(text, max_chars=2400, size=500, items=4):
    parts = [p.strip() for p in re.split(r"(?<=[.!?;])\s+|\s*[|•]\s*", re.sub(r"\s+", " ", text or "").strip()) if p.strip()]
    order = sorted(range(len(parts)), key=lambda i: (-sum(k in parts[i].lower() for k in lexicons.EVIDENCE_KEYWORDS), i))
    kept, used = [], 0
    for i in order:
        one = parts[i][:size]
        if len(kept) < items and used + len(one) <= max_chars:
            kept.append(one)
            used += len(one)
    return kept


def test_snippets_as_plain_version(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").toPandas()
    got = {r["doc_id"]: r["snippets"] for r in decisions.QUERIES["q_snippets"](spark, DIR).collect()}
    assert got == {d: "|".join(plain_snippets(t)) for d, t in zip(docs["doc_id"], docs["text"])}
    rows = ["Rien. Le budget du patrimoine! Une loi; fin", "", None, "a" * 3000 + ". budget"]
    assert column(spark, rows, evidence.ranked_sentences) == [plain_snippets(r) for r in rows]


def test_scrub_as_plain_version(spark):
    import hashlib

    def plain(t):
        t = re.sub(r"\b[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}\b", "[contact omitted]", t or "")
        return " ".join(re.sub(r"(?<!\d)(?:\+?212[ .-]?|0)[5-7](?:[ .-]?\d{2}){4}(?!\d)", "[contact omitted]", t).split())

    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").toPandas()
    got = {r["doc_id"]: r["scrubbed"] for r in decisions.QUERIES["q_pii_scrub"](spark, DIR).collect()}
    assert got == {d: hashlib.md5(plain(t).encode()).hexdigest() for d, t in zip(docs["doc_id"], docs["text"])}
    rows = ["écrire à é.b@x.co.ma ou 06 12 34 56 78.", "+212 612345678", "00612345678", None]
    assert column(spark, rows, values.omit_contacts) == [plain(r) for r in rows]


def test_page_records(spark):
    rows = [(1, "http://www.A.com/x/?utm_a=1#f", "<title>T</title><h1>Big <b>one</b> &amp; all</h1><a href='/q'>a label that is long enough</a><a href=\"z\">short</a>"), (2, "ftp://a", "<title>x</title>"), (3, "http://a.com", None), (4, "http://a.com", "<p>no</p>"), (5, None, "<title>x</title>")]
    got = [tuple(r) for r in pages.records(spark.createDataFrame(rows, "page_id int, url string, html string")).orderBy("page_id").collect()]
    assert got == [(1, "http://www.a.com/x", "Big one & all", 1, None), (2, None, "x", 0, "bad_address"), (3, "http://a.com/", "", 0, "empty_page"), (4, "http://a.com/", "", 0, "no_title"), (5, None, "x", 0, "bad_address")]
    assert column(spark, ["<head>h</head><script>s<b></script>a&lt;b<!-- c -->", None], pages.visible) == ["a<b", None]


def test_state_table_over_batches_and_replay(spark, tmp_path):
    state = changes.StateTable(spark, str(tmp_path), "k long, v string")
    one = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (1, "b", 3), (2, "x", 1)], "k long, v string, s int")
    two = spark.createDataFrame([(1, "b", 4), (2, "y", 5), (3, "n", 6)], "k long, v string, s int")
    state.apply(one, 0, "k", "v", ["s"])
    state.apply(two, 1, "k", "v", ["s"])
    state.apply(two, 1, "k", "v", ["s"])  # a replay after a lost driver
    got = sorted((r["k"], r["s"], r["state"]) for r in spark.read.parquet(f"{tmp_path}/changes/*").collect())
    assert got == [(1, 1, "NEW"), (1, 2, "UNCHANGED"), (1, 3, "UPDATED"), (1, 4, "UNCHANGED"), (2, 1, "NEW"), (2, 5, "UPDATED"), (3, 6, "NEW")]
    assert sorted(tuple(r) for r in state.version(1).collect()) == [(1, "b"), (2, "y"), (3, "n")]


def test_titles(spark):
    want = ["A_heritage_service", "pure_execution", "C_architectural_competition", "D_major_architecture", "unrelated_scope", "supply_purchase", "ordinary_facility_or_infrastructure", "unrelated_topography", "incomplete_scope_requires_detail", "A_heritage_service", "arabic_scope_requires_detail", "no_relevant_title_context", "incomplete_scope_requires_detail"]
    rows = [*decisions.NOTICES, (None, None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, p string, c string")
    got = [r[0] for r in df.orderBy("i").select(notices.select_title(F.col("t"), F.col("p"), F.col("c"))).collect()]
    assert [r["reason"] for r in got] == [*want, "incomplete_scope_requires_detail"]
    assert {(r["decision"], r["priority"]) for r in got} == {("continue", 1), ("continue", 2), ("continue", 3), ("continue", 4), ("reject", 9)}
