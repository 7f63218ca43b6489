"""Sources, hits and candidates with odd fields: what is refused, left out or filled in."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import validation

HIT = "id int, title string, url string, evidence string, deadline_at string, estimated_amount string, provisional_bond string, at_home boolean, found_from string, " + ", ".join(f"{c} string" for c in validation.LONGEST)


def hit(i, **more):
    return {"id": i, "title": "t", "url": "https://x.example"} | more


def test_sources_in_order(spark):
    rows = [(0, "b", "https://b.example", 50, None, None), (1, "a", "https://a.example", 10, True, "CURATED_ROLE:x"), (2, "off", "https://c.example", 1, False, None), (3, None, "https://d.example", 1, None, None), (4, "e", "e.example", 1, None, "TABLE"), (5, "f", "https://f.example", None, None, "XLS")]
    got = {r["position"]: r for r in validation.planned_sources(spark.createDataFrame(rows, "position int, name string, index_url string, priority int, enabled boolean, parser_type string")).collect()}
    assert {p: (r["place"], r["error"]) for p, r in got.items()} == {0: (2, None), 1: (1, None), 3: (None, "no_name"), 4: (None, "no_address"), 5: (None, "unknown_parser")}
    assert got[0]["refresh_days"] == 7 and got[0]["parser_type"] == "HTML_LIST" and got[5]["priority"] == 50


def test_hits_in_bounds(spark):
    rows = [
        hit(1, title=None, reference=None), hit(2, title=" ", reference="r" * 256), hit(3, title="", reference="9/24", deadline_at="2024-06-01T10:00:00Z"), hit(4, deadline_at="2024-06-01T10:00:00"), hit(5, deadline_at="2024-13-01T10:00:00Z", status="s" * 101),
        hit(6, estimated_amount="12,5 millions DH TTC", provisional_bond="-", url="https://www.marchefacile.ma/a"), hit(7, estimated_amount="à voir", at_home=False, url=None),
    ]
    got = {r["id"]: r for r in validation.admitted(spark.createDataFrame(rows, HIT)).collect()}
    assert got[1]["error"] == "title_or_reference_required" and got[2]["error"] is None and got[2]["reference"] is None and got[3]["title"] == "9/24"
    assert [got[i]["deadline_at"] for i in (3, 4, 5)] == ["2024-06-01T10:00:00Z", None, None] and got[5]["status"] == "unknown"
    assert (got[6]["amount"], got[6]["currency"], got[6]["tax_mode"], got[6]["amount_source"], got[6]["bond"], got[6]["at_home"]) == (12_500_000.0, "MAD", "TTC", "MARCHE_FACILE", None, True)
    assert (got[7]["amount"], got[7]["amount_source"], got[7]["at_home"], got[7]["source_role"]) == (None, None, False, "DISCOVERY_ONLY")


def test_bounds_of_candidates(spark):
    kind = "struct<relevant:boolean,priority:int,score:int,category:string,summary:string,reason:string,confidence:double,manual:boolean>"
    good = (True, 1, 100, "c", "s", "r", 1.0, False)
    rows = [(1, None, None, None, None), (2, "http://é..example", "[", "x" * 4001, good), (3, "https://a.example", "{}", None, (True, None, -1, None, "s" * 2001, "", float("nan"), None)), (4, "", '{"a": 1}', "", good)]
    df = spark.createDataFrame(rows, f"id int, url string, metadata string, official_url string, analysis {kind}")
    got = {r["id"]: r["errors"] for r in validation.checked(df, ["official_url"]).collect()}
    assert got == {1: [], 2: ["bad_url", "metadata_no_json", "official_url_too_long"], 3: ["priority", "score", "confidence", "category", "summary", "reason"], 4: []}
    with pytest.raises(ValueError):
        validation.checked(df, [], accept=0.5, review=0.6)


def test_gate_and_snapshots(spark):
    one = spark.range(1)
    gate = lambda due, title="Etude de restauration des remparts": one.select(validation.listing_gate(F.lit(title), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(due).cast("string"), F.lit(date(2024, 6, 15))).alias("g")).first()["g"]["reason"]
    assert gate("14/06/2024") == "closed_or_expired" and gate("15/06/2024") == gate("bientôt") == gate(None) == "A_heritage_service"
    blank = dict.fromkeys(validation.SNAPSHOT, F.lit(None).cast("string"))
    assert one.select(validation.snapshot(blank).eqNullSafe(validation.snapshot(blank | {"title": F.lit("  ")}))).first()[0]


def test_compact_leaves_long_texts_out(spark):
    df = spark.createDataFrame([(1, "x" * 600, "Le patrimoine de la ville. " * 400, '{"text": "Convention signée."}', None), (2, None, None, "no json", 5)], "id int, title string, summary string, metadata string, n int")
    got = {r["id"]: r["payload"] for r in validation.compact(df, ["title", "summary", "metadata", "n"]).collect()}
    assert len(got[1]) < 3600 and '"convention"' in got[1] and '"summary"' not in got[1] and '"n":5' in got[2]
