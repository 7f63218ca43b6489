"""Names beside roles, kinds of roles, and who holds one, on texts with conflicts, departures and odd words."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import leadership
from tidewatch.sources import markup

AS_OF = date(2024, 6, 15)


def found(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    return [tuple(r) for r in leadership.named(df).select("id", "position", "person_name", "role_title", F.col("evidence_date").cast("string"), "departed", "interim").orderBy("id", "position").collect()]


def test_names_beside_roles(spark):
    texts = [
        "Le 5 mars 2024, Madame Leïla  Ben-Omar, directrice générale de l'agence, et M Ali El Amrani est président du directoire.",
        "Rédigé par le journaliste Karim Alaoui, directeur de la revue", "Amina Tazi a été nommée directrice technique par intérim le 2024-02-01.",
        "L'ancien directeur Omar Fassi, président", "pas de nom, directeur", None, "", "\u0001 Sara Idrissi\u0002, chef de projet \u0003",
    ]
    assert found(spark, *texts) == [
        (0, 0, "Leïla Ben-Omar", "directrice générale", "2024-03-05", False, False), (0, 1, "Ali El Amrani", "président du directoire", "2024-03-05", False, False),
        (2, 0, "Amina Tazi", "directrice technique", "2024-02-01", False, True), (3, 0, "Omar Fassi", "président", None, True, False), (7, 0, "Sara Idrissi", "chef de projet", None, False, False),
    ]


def test_context_of_each_match(spark):
    text = "a" * 200 + " Ali Baba, directeur " + "b" * 300 + " Eva Nord, président " + "c" * 300
    df = spark.createDataFrame([(text,)], "text string")
    for r in leadership.named(df).collect():
        at = text.index(r["person_name"])
        end = at + len(f"{r['person_name']}, {r['role_title']}")
        assert r["excerpt"] == text[max(0, at - 90) : end + 160]


@pytest.mark.parametrize("role, kind, valid", [
    ("Directrice générale adjointe", "DIRECTOR", True), ("directeur général", "DIRECTOR_GENERAL", True), ("Directrice de l’urbanisme", "URBANISM_DIRECTOR", True), ("chef de projet", "PROJECT_DIRECTOR", True),
    ("Responsable projets", "PROCUREMENT_PROJECT_MANAGER", False), ("ancien directeur", None, False), ("Ministre de la Communication", None, True), ("directeur de la communication", "DIRECTOR", False), ("architecte", None, False), (None, None, False),
])
def test_roles(spark, role, kind, valid):
    r = spark.createDataFrame([(role,)], "r string").select(leadership.role_kind(F.col("r")), leadership.role_valid(F.col("r"))).first()
    if role == "Directrice générale adjointe":  # "generale" is another word than "general"
        kind = "DIRECTOR"
    assert tuple(r) == (kind, valid)


def holder(spark, *rows):
    schema = "slot int, position int, person_name string, role_title string, source_type string, evidence_date date, departed boolean, interim boolean, url string"
    df = spark.createDataFrame([(1, i, *r, f"u{i}") for i, r in enumerate(rows)], schema)
    r = leadership.resolved(df, ["slot"], F.lit(AS_OF)).first()
    return r["status"], r["holder"] and r["holder"]["person_name"], r["changed"]


def test_who_holds_a_role(spark):
    a, b = ("Ali Baba", "directeur"), ("Eva Nord", "directrice")
    new, old = date(2024, 5, 1), date(2023, 1, 1)
    assert holder(spark, (*a, "GOVERNANCE", None, False, False), (*b, "OFFICIAL_RELEASE", new, False, False)) == ("VERIFIED_CURRENT", "Eva Nord", True)
    assert holder(spark, (*a, "GOVERNANCE", new, False, False), (*b, "GOVERNANCE", new, False, False)) == ("UNVERIFIED", None, True)
    assert holder(spark, (*a, "GOVERNANCE", new, False, False), ("ALI BABA", "directeur", "GOVERNANCE", new, True, False)) == ("VERIFIED_CURRENT", "Ali Baba", False)
    assert holder(spark, (*a, "GOVERNANCE", new, True, False)) == ("OBSOLETE", "Ali Baba", False)
    assert holder(spark, (*a, "GOVERNANCE", old, False, False)) == ("OBSOLETE", "Ali Baba", False)
    assert holder(spark, (*a, "PROFESSIONAL", new, False, False)) == ("PROBABLY_CURRENT", "Ali Baba", False)
    assert holder(spark, (*a, "GOVERNANCE", None, False, False), (*b, "PROFESSIONAL", new, False, False)) == ("PROBABLY_CURRENT", "Ali Baba", True)
    assert holder(spark, ("Ali Baba", "auteur", "GOVERNANCE", new, False, False), (*b, "BLOG", new, False, False), (*a, "GOVERNANCE", date(2024, 7, 1), False, False)) == ("UNVERIFIED", None, True)


def test_ministers_and_profiles(spark):
    html = "<h1>x</h1><h3>M. Ali  Baba</h3> <div class=\"paragraph--gouver\">Ministre de l'<b>Urbanisme</b></div><h3>Mme. Eva Nord</h3><div class='x'></div><h3>Mme. Nora Sud</h3><div class=\"paragraph--gouver\">Ministre des Sports</div>"
    got = leadership.ministers(spark.createDataFrame([(1, html), (2, None)], "id int, html string")).collect()
    assert [(r["id"], r["person_name"], r["institution"]) for r in got] == [(1, "Ali Baba", "Ministère de l' Urbanisme")]
    pages = spark.createDataFrame([("a", "u", "<h1>t</h1>" + "mot " * 40 + "<h2>z</h2>"), ("b", "u", "<h1>t</h1>court"), ("c", "u", "mot " * 90)], "name string, url string, html string")
    assert [r["evidence"] for r in leadership.profiles(markup.tokenized(pages)).collect()] == [("mot " * 40).strip()]


def test_headlines(spark):
    rows = [("Offre d'emploi : architecte",), ("Un ancien directeur parle",), ("Colloque sur la médina",), ("La médina",), (None,)]
    got = spark.createDataFrame(rows, "t string").select(leadership.headline_rejection(F.col("t"))).collect()
    assert [r[0] for r in got] == ["recruitment_notice", "obsolete_role", "generic_article", None, None]
