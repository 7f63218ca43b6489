"""Briefs, ledgers, decisions, identities and budgets on small cases."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import urls
from tidewatch.operators import accounting, briefs, conditions, identity, ledger, revisions

DAY = date(2024, 6, 13)  # a Thursday


@pytest.mark.parametrize(("text", "want"), [
    ("entre 1er mars 2024 et 2 avril 2024", (date(2024, 3, 1), date(2024, 4, 2), "EXPLICIT")),
    ("de 2019 à 2021", (date(2019, 1, 1), date(2021, 12, 31), "ARCHIVE")),
    ("depuis le 5 février 2023", (date(2023, 2, 5), None, "EXPLICIT")),
    ("avant mars 2023", (None, date(2023, 3, 31), "EXPLICIT")),
    ("en février 2024", (date(2024, 2, 1), date(2024, 2, 29), "EXPLICIT")),
    ("aujourd'hui", (DAY, DAY, "CURRENT")),
    ("cette semaine", (date(2024, 6, 10), DAY, "CURRENT")),
    ("archives récentes", (date(2024, 3, 15), None, "ARCHIVE")),
    ("sans date", (None, None, "DEFAULT")),
])
def test_days_of_a_brief(text, want):
    assert briefs.days(text, DAY) == want


def test_briefs():
    b = briefs.interpret("Appel d'offres pour la muraille à Safi depuis mars 2024 avec CPS, sans routes", DAY)
    assert (b["mode"], b["place"], b["since"], b["documents"], b["excluded"]) == ("PROCUREMENT", "Safi", date(2024, 3, 1), ["CPS"], ["routes"])
    assert b["topics"] == ["muraille"] and "remparts" in b["related"] and b["open_only"]
    c = briefs.refine(b, "aussi à Fès, patrimoine culturel", DAY)
    assert c["place"] == "Fès" and c["topics"] == ["muraille", "patrimoine"] and c["since"] == b["since"] and "patrimoine culturel" in c["wanted"]
    assert briefs.place("des remparts à Azrou, vite") == ("Azrou", ["Azrou"]) and briefs.interpret("le patrimoine", DAY)["unclear"]
    assert briefs.recency_days(b, DAY) == 104
    with pytest.raises(ValueError):
        briefs.interpret(" x", DAY)


def test_thresholds_are_checked():
    with pytest.raises(ValueError):
        conditions.Conditions(accept=0.4, review=0.5)


def test_first_wins_is_sequential(spark):
    """Row 2 goes by row 1's key, so its other key is free for row 3; copies of one key all go but the first."""
    rows = [(1, "a", None), (2, "a", "b"), (3, "c", "b"), (4, "d", "b"), (5, None, None), *[(i, "hot", None) for i in range(10, 60)], (70, "e", "hot2"), (71, "hot", "hot2")]
    df = spark.createDataFrame(rows, "id long, x string, y string")
    got = {r["id"]: r["kept"] for r in identity.first_wins_any(df, "id", ["x", "y"]).collect()}
    seen, want = set(), {}
    for i, x, y in rows:
        keys = {("x", x) if x else None, ("y", y) if y else None} - {None}
        want[i] = not keys & seen
        if want[i]:
            seen |= keys
    assert got == want
    assert identity.first_wins_any(df.limit(0), "id", ["x", "y"]).count() == 0


def test_first_wins_along_a_long_chain(spark):
    """Thousands of rows that hang on one another end in a few rounds."""
    even = spark.createDataFrame([(i, f"k{i // 2}", f"m{(i + 1) // 2}") for i in range(2000)], "id long, a string, b string")  # neighbours share a or b in turn
    kept = {r["id"]: r["kept"] for r in identity.first_wins_any(even, "id", ["a", "b"]).collect()}
    assert kept == {i: i % 2 == 0 for i in range(2000)}


def test_ledger_states(spark):
    at = lambda d: F.lit(f"2024-01-{d:02} 00:00:00").cast("timestamp")
    batch = lambda *rows: spark.createDataFrame(rows, "key string, digest string, seq long")
    states = lambda df: {r["key"]: (r["state"], r["reason"]) for r in df.collect()}
    one, _ = ledger.absorb(spark.createDataFrame([], ledger.SCHEMA), batch(("a", "1", 1), ("b", "1", 1), ("a", "2", 2), ("c", "1", 1)), at(1))
    claimed = ledger.claim(one, batch(("a", "2", 0), ("b", "old", 0), ("c", "1", 0)), 5, at(2))
    assert states(claimed) == {"a": (ledger.PROCESSING, None), "b": (ledger.PENDING, None), "c": (ledger.PROCESSING, None)}
    verdicts = spark.createDataFrame([("a", "2", "rejected", "r"), ("c", "1", "parser_error", "p"), ("b", "1", "kept", "x")], "key string, digest string, verdict string, reason string")
    done = ledger.finish(claimed, verdicts, 5, "v1")
    assert states(done) == {"a": (ledger.REJECTED, "r"), "b": (ledger.PENDING, None), "c": (ledger.RETRY, "p")}
    late, classes = ledger.absorb(done, batch(("a", "1", 1)), at(3))  # older than what the ledger holds
    assert states(late) == states(done) and classes.first()["class"] == "UNCHANGED"
    assert {r["key"] for r in ledger.waiting(done, "v1").collect()} == {"b", "c"} and ledger.waiting(done, "v2").count() == 3
    runs = spark.createDataFrame([(5, "failed", datetime(2024, 1, 1))], "id long, status string, started_at timestamp")
    assert states(ledger.release(claimed, runs))["a"] == (ledger.RETRY, "interrupted_owner_run")
    live = spark.createDataFrame([(5, "running", datetime(2024, 1, 1))], "id long, status string, started_at timestamp")
    assert states(ledger.release(claimed, live))["a"][0] == ledger.PROCESSING
    report = ledger.report(done, "v1").first()
    assert (report["rows"], report["waiting"], report["rejected"]) == (3, 2, 1)
    kept = ledger.finish(ledger.claim(done, batch(("b", "1", 0)), 6, at(3)), verdicts.filter("key = 'b'"), 6, "v1")
    assert states(ledger.requeue(kept, at(1), at(9)))["b"] == (ledger.PENDING, "periodic_check")


def test_refused_decisions(spark):
    results = spark.createDataFrame([(1, "v1", "NEW", True), (2, "v2", "NEW", False)], "id int, version string, status string, current boolean")
    said = spark.createDataFrame([(1, "v0", "APPROVED", "a", 1), (1, "v1", "REJECTED", "b", 2), (2, "v2", "APPROVED", "a", 1), (9, "v", "APPROVED", "a", 1)], "id int, version string, verdict string, reviewer string, at int")
    out, refused = revisions.decide(results, said)
    assert {(r["id"], r["status"], r["reviewer"]) for r in out.collect()} == {(1, "REJECTED", "b"), (2, "NEW", None)}
    assert {(r["id"], r["reason"]) for r in refused.collect()} == {(1, "changed_since_shown"), (2, "not_current"), (9, "unknown_row")}


def test_pages_and_addresses(spark):
    df = spark.range(0).select(F.col("id"))
    assert accounting.page(df, ["id"], 3, 5).count() == 0
    got = spark.range(1).select(urls.domain(F.lit("WWW.Site.example.")).alias("d"), urls.domain_match(F.lit("https://a.site.example/x"), ["site.example"]).alias("m"), urls.domain_match(F.lit("https://notsite.example"), ["site.example"]).alias("n")).first()
    assert tuple(got) == ("site.example", True, False)
