"""The composed flow: every hit accounted for in one action, odd rows, and a copy shared by most hits."""

from datetime import date, datetime

from pyspark.sql import functions as F

from tidewatch.operators import flow
from tidewatch.plans import flows
from tidewatch.sources import markup

DIR = "/root/testdata/sf0.001"
SCHEMA = "position long, reference string, institution string, title string, url string, evidence string, status string, deadline date, published date, found_at string, at_home boolean, amount double, amount_verified boolean"
AS_OF, NOW = date(2024, 6, 15), datetime(2024, 6, 15, 12)
TITLE = "Etude de restauration des remparts de la médina"


def run(spark, hits, pages=(), known=(), **more):
    p = markup.tokenized(spark.createDataFrame(list(pages), "url string, html string"))
    k = spark.createDataFrame(list(known), "reference string, institution string, title string").select(flow.signature(*[F.col(c) for c in ("reference", "institution", "title")]).alias("signature"))
    return {r["position"]: r for r in flow.processed(spark.createDataFrame(hits, SCHEMA), p, k, F.lit(AS_OF), F.lit(NOW), **more).collect()}


def hit(position, reference="1/24", institution="Commune A", title=TITLE, url="https://www.alomrane.gov.ma/avis/1", status=None, deadline=None, at_home=True):
    return (position, reference, institution, title, url, None, status, deadline, None, url, at_home, None, None)


def page(more="", title=TITLE, reference="1/24", deadline="01/08/2024"):
    return ("https://www.alomrane.gov.ma/avis/1", f"<h1>Avis</h1><p>Référence : {reference}</p><p>Objet : {title}</p><p>Acheteur : Commune A</p><p>Date limite : {deadline}</p>{more}")


def said(r):
    return r["outcome"], r["stage"], r["reason"]


def test_stages(spark):
    got = run(spark, [hit(1), hit(2), hit(3, reference="1-24"), hit(4, None, None, None), hit(5, title="Gardiennage des locaux"), hit(6, title=" ", reference=" "), hit(7, reference="7/24", url=None)], [page()])
    assert said(got[1]) == ("accepted", "accepted", "verified_offer") and said(got[2]) == ("skipped", "duplicate", "duplicate_discovery_signature") == said(got[3])
    assert said(got[4]) == ("retry", "normalize", "missing_title_or_reference") and said(got[5]) == ("rejected", "prefilter", "irrelevant_business_purpose")
    assert got[6]["outcome"] in ("retry", "accepted", "rejected") and said(got[7])[0] == "retry" and len(got) == 7


def test_pages_decide(spark):
    at = "https://www.alomrane.gov.ma/avis/"
    cases = [page("<p>Statut : Annulé</p>"), page(deadline="01/01/2024"), page(reference="9/24"), None, page(deadline="bientôt"), page(title="Restauration..."), page(), page()]
    hits = [hit(i, title=f"{TITLE} {i}", url=f"{at}{i}", at_home=None if i == 7 else True) for i in range(8)]
    pages = [(f"{at}{i}", c[1].replace(TITLE, f"{TITLE} {i}")) for i, c in enumerate(cases) if c]
    known = [("1/24", "COMMUNE A", f"{TITLE} 6")]
    got = run(spark, hits, pages, known)
    assert said(got[0]) == said(got[1]) == ("rejected", "freshness", "closed_or_expired") and said(got[2]) == ("retry", "proof", "reference_mismatch") and said(got[3]) == ("accepted", "accepted", "credible_fallback")
    assert said(got[6]) == ("skipped", "known", "known_unchanged") and said(got[7]) == ("rejected", "complete", "missing_geography_buyer_or_deadline")
    got = run(spark, hits, pages, indexed=True)
    assert said(got[3]) == ("retry", "page", "not_read") and said(got[4]) == ("retry", "proof", "official_deadline_missing") and said(got[5]) == ("retry", "proof", "official_object_incomplete")
    assert said(got[6]) == ("accepted", "accepted", "verified_offer")


def test_every_hit_is_counted_in_one_action(spark):
    t = lambda n: spark.read.parquet(f"{DIR}/{n}.parquet")
    hits = flows._hits(t)
    done, seen = flow.observed(flow.processed(hits, flows._pages(t), flows._known(t), F.lit(date(1995, 6, 17)), F.lit(datetime(1995, 6, 17))), "counted")
    rows = done.collect()
    assert seen.get["hits"] == len(rows) == hits.count() == sum(seen.get[s] for s in flow.STAGES)
    assert {r["position"] for r in rows} == {r["position"] for r in hits.select("position").collect()}


def test_a_copy_of_most_hits_and_none_at_all(spark):
    got = run(spark, [hit(i) for i in range(400)] + [hit(500, reference="5/24")], [page()])
    assert sum(r["stage"] == "duplicate" for r in got.values()) == 399 and got[0]["stage"] == "accepted" and got[500]["stage"] == "proof"
