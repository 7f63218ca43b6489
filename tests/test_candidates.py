"""Builders of candidates on items with odd dates, addresses and records."""

from datetime import date

from pyspark.sql import functions as F

from tidewatch.operators import candidates

AS_OF = date(2024, 6, 15)
ITEM = "id int, title string, url string, evidence string, institution string, published string"


def by_id(df):
    return {(r["id"], r["block"]) if "block" in df.columns else r["id"]: r for r in df.collect()}


def test_projects(spark):
    two = "Programme de la ville\n- Convention signée pour la réhabilitation de la médina de Fès, 12 millions dh\n* Financement approuvé pour la restauration des monuments de Safi\ncourt"
    items = [
        (1, "Projets", "https://www.gov.example/1", two, "Ville", "2024-06-01"), (2, "Convention signée : restauration du patrimoine", "https://blog.example/2", "Le 3 juin 2024, 5,5 mdh", None, None),
        (3, "Budget alloué : restauration", "https://gov.example/3", "", None, "01/01/2023"), (4, "Rien", None, None, None, "bientôt"),
    ]
    got = by_id(candidates.projects(spark.createDataFrame(items, ITEM), ["gov.example"], F.lit(AS_OF)))
    assert set(got) == {(1, 0), (1, 1), (2, 0), (3, 0), (4, 0)}
    a, b, c = got[1, 0], got[1, 1], got[2, 0]
    assert (a["rejected"], a["signal"], a["budget"], a["official_url"], a["maturity"]) == (None, "CONVENTION_SIGNED", "12 millions", "https://www.gov.example/1", "B") and a["officially_announced"]
    assert (b["signal"], b["financing_secured"], b["maturity"]) == ("FINANCING_APPROVED", True, "A")
    assert (c["announced"], c["source_quality"], c["official_url"]) == (date(2024, 6, 3), "RELIABLE_SECONDARY", None) and c["project_name"].startswith("Convention")
    assert got[3, 0]["rejected"] == "rejected_old" and got[4, 0]["rejected"] == "rejected_vague"


def test_institutions(spark):
    said = "L'agence urbaine et le patrimoine architectural. "
    rows = [
        (1, "Agence", "https://gov.example/a", said, "Agence urbaine", None, True), (2, "Agence", "https://blog.example/a", said, "Agence urbaine", None, True), (3, "Recrutement", "https://gov.example/a", said, "Agence", None, True),
        (4, "Agence", "https://gov.example/a", said + "M. Ali Baba a été nommé directeur.", "Agence urbaine", "2024-06-01", False), (5, "Agence", "https://gov.example/a", said + "M. Ali Baba a été nommé directeur.", "Agence urbaine", "2020-06-01", False),
        (6, "Agence", "https://gov.example/a", said, "Portail officiel de la ville", None, True), (7, "Agence", None, None, None, None, None),
    ]
    got = by_id(candidates.institutions(spark.createDataFrame(rows, ITEM + ", profile boolean"), ["gov.example"], F.lit(AS_OF)))
    assert (got[1]["rejected"], got[1]["profile_type"], got[1]["result_type"]) == (None, "INSTITUTION", "INSTITUTION_PROFILE") and got[1]["limitation"]
    assert got[2]["rejected"] == "generic_article" and got[3]["rejected"] == "recruitment_notice" and got[6]["rejected"] == got[7]["rejected"] == "not_relevant"
    assert got[4]["person"] == got[5]["person"] == "Ali Baba" and got[5]["rejected"] == "obsolete_role"
    assert got[4]["rejected"] in (None, "officeholder_unverified") and (got[4]["verified"] == (got[4]["rejected"] is None))


def test_instruments(spark):
    rows = [
        (1, "Loi n° 22.80 relative à la conservation des monuments historiques", "https://www.gov.example/loi.PDF", "Loi entrée en vigueur", None, "2024-01-02", None, None), (2, "Présentation de la loi n° 22.80 sur le patrimoine", "https://gov.example/x", "adoptée", None, None, None, None),
        (3, "Projet de décret sur la médina", "https://gov.example/y", None, None, None, "https://gov.example/list", "DECREE"), (4, "Loi n° 1.1 sur le patrimoine", "https://blog.example/z", "", None, None, None, None), (5, "Une page", "https://gov.example/q", "", None, None, None, None),
    ]
    got = by_id(candidates.instruments(spark.createDataFrame(rows, ITEM + ", listing string, listed_type string"), ["gov.example"]))
    assert (got[1]["document_type"], got[1]["status"], got[1]["reference"], got[1]["confidence"], got[1]["document_url"], got[1]["published_on"]) == ("LAW", "POLICY_SIGNAL", "22.80", 0.3, "https://www.gov.example/loi.PDF", date(2024, 1, 2))
    assert got[2]["reference"] is None and got[2]["rejected"] is None
    assert (got[3]["document_type"], got[3]["status"], got[3]["status_source"], got[3]["confidence"]) == ("DECREE", "DRAFT", "SGG_DRAFT_LIST", 0.95) and got[3]["summary"].endswith("non vérifiées.")
    assert got[4]["rejected"] == got[5]["rejected"] == "unrelated_or_nonofficial"


def test_programmes(spark):
    said = "Maroc : programme de réhabilitation du patrimoine urbain ouvert, "
    raw = '{"id": "P1", "project_name": "Morocco urban heritage programme", "projectstatusdisplay": "Active", "totalamt": "1,500,000", "borrower": "Kingdom", "countryshortname": "Morocco", "sector1": {"Name": "Urban"}, "sector": [1], "mjtheme_namecode": [{"name": "heritage"}, {}], "closingdate": "2027-01-31T00:00:00Z"}'
    rows = [
        (1, "Appel à projets", "https://www.afd.fr/x", said + "appel à projets, 12,5 million EUR", None, None, None), (2, "Prêt", "https://gov.example/x", said + "$ 3 bn", "Ville", None, None), (3, "Prêt", "https://gov.example/x", said, " ", None, None),
        (4, "Prêt", "https://other.example/x", said, "Ville", None, None), (5, "Prêt", "https://gov.example/x", "rien", "Ville", None, None), (6, "Urban heritage in Morocco", "https://projects.worldbank.org/P1", None, "WB", None, raw), (7, None, None, None, None, None, "no json"),
    ]
    got = by_id(candidates.programmes(spark.createDataFrame(rows, ITEM + ", raw string"), ["afd.fr", "gov.example", "worldbank.org"], {"afd.fr": "AFD", "worldbank.org": "World Bank"}))
    assert (got[1]["rejected"], got[1]["funder"], got[1]["amount"], got[1]["currency"]) == (None, "AFD", 12_500_000.0, "EUR")
    assert (got[2]["funder"], got[2]["amount"], got[2]["currency"]) == ("Ville", 3e9, "USD") and got[3]["rejected"] == "no_funder" and got[4]["rejected"] == "not_readable" and got[5]["rejected"] == "outside_scope"
    w = got[6]
    assert (w["rejected"], w["funder"], w["amount"], w["currency"], w["beneficiary"], w["territory"], w["letter"], w["status"], w["project"], w["closing"]) == (None, "World Bank", 1_500_000.0, "USD", "Kingdom", "Morocco", "B", "active", "P1", date(2027, 1, 31))
    assert w["summary"].endswith("Urban heritage") and got[7]["rejected"] == "not_readable"
