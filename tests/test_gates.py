"""Board pages, answers of a search, resolution, recovery and sessions on small rows with known results."""

from datetime import date, datetime

from pyspark.sql import functions as F

from tidewatch.operators import details, identity, recovery, resolver, sessions
from tidewatch.sources import board, search

_ID = "ctl0_CONTENU_PAGE_resultSearch_tableauResultSearch_ctl"


def listing(n, number, org="abc", **fields):
    name = "ctl0$CONTENU_PAGE$resultSearch$tableauResultSearch$ctl"
    own = f'<input name="{name}{n}$refCons" type="hidden" value="{number}"/><input name="{name}{n}$orgCons" value="{org}"/>'
    return own + "".join(f'<div id="{_ID}{n}_{k}" class="x">{v}</div>' for k, v in fields.items())


def page(*rows, more=False, declared=None):
    head = f'<span id="ctl0_CONTENU_PAGE_resultSearch_nombrePageTop">{declared}</span>' if declared else ""
    return head + "".join(rows) + (f'<a href="{board.NEXT}">next</a>' if more else "") + '<input name="PRADO_PAGESTATE" value="tok"/>'


def test_listings(spark):
    html = page(
        listing(0, 1, reference="head"),
        listing(1, 77, reference=" : 12/2024 ", panelBlocObjet="<b>Objet :</b> &Eacute;tude &amp; suivi", panelBlocDenomination="Acheteur public : Commune", infosLieuExecutionLtRef="05/07/2024 10:00",
                panelBlocCategorie="Services 01/06/2024", panelBlocTypesProc="Appel d'offres ouvert Services 01/06/2024", infosLieuExecution="FES ... MEKNES"),
        listing(2, 78, reference="", infosBullesObjet="Objet : Autre", panelBlocTypesProc="Concours 05/07/2024 travaux", infosLieuExecutionLtRef="05/07/2024"),
        declared=3,
    )
    df = spark.createDataFrame([("a", 1, html), ("a", 2, None), ("a", 3, "")], "crawl string, page int, html string")
    rows = {r["n"]: r for r in board.listings(df).collect()}
    assert sorted(rows) == [1, 2]
    one, two = rows[1], rows[2]
    assert (one["consultation"], one["organisation"], one["reference"], one["buyer"], one["category"], one["procedure"], one["location"]) == ("77", "abc", "12/2024", "Commune", "Services", "Appel d'offres ouvert", "FES")
    assert one["title"].endswith("tude & suivi") and (one["publication"], one["deadline"]) == ("01/06/2024", "05/07/2024 10:00")
    assert one["detail_url"].endswith("refConsultation=77&orgAcronyme=abc")
    assert (two["reference"], two["title"], two["publication"], two["deadline"], two["category"], two["procedure"]) == (None, "Autre", None, "05/07/2024", "Travaux", "Concours")
    f = board.facts(df).filter("page = 1").first()
    assert (f["declared_pages"], f["has_next"], f["state"], f["signature"]) == (3, False, "tok", "0:1|1:77|2:78")


def test_walk(spark):
    def crawl(name, *pages):
        return [(name, i, html) for i, html in enumerate(pages, 1)]

    one = lambda k, more=True, **f: page(listing(1, k, reference=str(k), **f), more=more)
    rows = (
        crawl("loop", one(1), one(2), one(1), one(3))
        + crawl("end", one(1), one(2, more=False), one(3))
        + crawl("empty", one(1), page(), one(4))
        + crawl("said", page(listing(1, 1), more=True, declared=2), one(2), one(3))
        + crawl("open", one(8), page(listing(1, 8, reference="8"), listing(2, 9), more=True))
    )
    df = spark.createDataFrame(rows, "crawl string, page int, html string")
    none = spark.createDataFrame([], "identity string, digest string")
    seen, ends = board.walk(df, none)
    assert {r["crawl"]: (r["pages"], r["stop"]) for r in ends.collect()} == {"loop": (2, "pagination_loop"), "end": (2, "final_page"), "empty": (2, "empty_page"), "said": (2, "final_page"), "open": (2, "final_page")}
    got = {(r["crawl"], r["page"], r["n"]): r["class"] for r in seen.collect()}
    assert got[("open", 2, 1)] == "DUPLICATE" and got[("open", 2, 2)] == "NEW" and ("loop", 3, 1) not in got
    known = seen.filter("crawl = 'loop' AND class = 'NEW'").select("identity", "digest").distinct()
    again, ends = board.walk(df.filter("crawl = 'loop'"), known, overlap=2)
    assert [tuple(r) for r in ends.collect()] == [("loop", 2, "incremental_overlap")] and {r["class"] for r in again.collect()} == {"UNCHANGED"}
    assert board.walk(df.filter("crawl = 'loop'"), none, most=1)[1].first()["stop"] == "max_pages"
    assert board.walk(df.limit(0), none)[1].isEmpty()


def test_search(spark):
    sources = spark.createDataFrame([(1, 0, "https://a.org/x/", "", "s0", None), (1, 1, "HTTPS://A.org/x#t", "T", "", "2024-01-01"), (1, 2, "no address", "x", "x", None), (2, 0, "https://b.org/", None, None, None)], "query int, position int, url string, title string, snippet string, day string")
    hits = spark.createDataFrame([(1, 0, "https://a.org/x", "h", " e  e ", None), (1, 1, "https://b.org/", "h", None, None), (2, 0, None, "h", "", None)], "query int, position int, url string, title string, evidence string, day string")
    good, refused = search.merged(hits, sources)
    assert sorted(tuple(r)[:4] + (r["kind"],) for r in good.collect()) == [(1, "https://a.org/x", "h", "e e", "hit"), (2, "https://b.org/", "", "", "discovery_page")]
    assert sorted(map(tuple, refused.collect())) == [(1, 1), (2, 0)]
    assert search.observed(sources).filter("query = 1").first().asDict() == {"query": 1, "url": "https://a.org/x", "title": "T", "snippet": "s0", "day": "2024-01-01", "domain": "a.org"}


def test_resolve(spark):
    schema = "id int, reference string, institution string, title string, official_url string, status string"
    c = spark.createDataFrame([(1, "12/24", "Commune", "t", None, "SECONDARY_ONLY"), (2, None, "Commune", "Étude de rue", None, "SECONDARY_ONLY"), (3, "9", None, "9", None, "NOT_FOUND"), (4, "1", "A", "t", "https://own", "VERIFIED_DIRECT"), (5, "5", "A", "t", "https://inst", "VERIFIED_INSTITUTIONAL")], schema)
    rows = [
        (1, 1, 0, "12 24", "X/1 - COMMUNE", "z", "https://second", "VERIFIED_DIRECT"), (1, 0, 1, "12-24", "commune", "z", "https://inst", "VERIFIED_INSTITUTIONAL"), (1, 0, 2, "12/24", "Commune", "z", "https://direct", "VERIFIED_DIRECT"),
        (1, 0, 0, "13/24", "Commune", "z", "https://other", "VERIFIED_DIRECT"), (2, 0, 0, "7", "commune", "étude  DE rue", "https://two", "VERIFIED_DIRECT"), (2, 0, 1, "7", "commune", "autre", "https://no", "VERIFIED_DIRECT"),
        (3, 0, 0, "9", "A", "t t", "https://a", "VERIFIED_DIRECT"), (3, 0, 1, "9", "B", "t t", "https://b", "VERIFIED_DIRECT"), (4, 0, 0, "1", "A", "t", "https://x", "VERIFIED_DIRECT"), (5, 0, 0, "5", "A", "t", "https://x", "INDIRECT_PMMP"),
    ]
    a = spark.createDataFrame(rows, "id int, step int, position int, reference string, institution string, title string, official_url string, status string")
    got = {r["id"]: (r["official_url"], r["from_answer"]) for r in resolver.resolve(c, a).collect()}
    assert got == {1: ("https://direct", True), 2: ("https://two", True), 3: (None, False), 4: ("https://own", False), 5: ("https://inst", False)}
    steps = [(r["step"], r["query"]) for r in resolver.ladder(c.filter("id < 3"), ["culture.gov.ma"]).filter("id = 1").orderBy("step").collect()]
    assert steps[0] == (0, 'site:marchespublics.gov.ma "12/24"') and steps[-1][1] == 'site:culture.gov.ma "12/24" "Commune" consultation' and len(steps) == 4
    assert resolver.ladder(c, []).filter("id = 2").count() == 1


def test_reconcile(spark):
    e = spark.createDataFrame([(1, "AO 1/24", "Commune A", "t"), (2, "ao-1-24", None, "Rue"), (3, "5", "B", "x"), (4, "5", "b ", "y"), (5, None, "B", "x")], "id int, reference string, institution string, title string")
    c = spark.createDataFrame([(10, "ao 1 24", "commune a", "z"), (11, "AO/1/24", "Other", "rue"), (12, "5", "B", "q"), (13, "5", None, "y"), (14, None, "B", "x"), (15, "AO 1 24", "commune A", "RUE")], "row int, reference string, institution string, title string")
    assert {r["row"]: (r["match"], r["conflict"]) for r in resolver.reconcile(c, e).collect()} == {10: (1, False), 11: (2, False), 12: (None, True), 13: (4, False), 14: (None, False), 15: (None, True)}


def test_recovery(spark):
    fields = "key string, title string, reference string, institution string, deadline date, publication_date date, source_status string, url string, last_changed timestamp"
    day, at = date(2024, 7, 1), datetime(2024, 6, 1, 12)
    rows = spark.createDataFrame([("a", "T", "1", "C", day, None, "open", "u", at), ("b", "T", "2", "C", day, None, "open", "u", at), ("c", "bad", "3", "C", day, None, "open", "u", at), ("d", "T", None, "C", day, None, "open", "u", at), ("e", "T", "5", "C", day, None, "open", "u", at)], fields)
    digest = dict(rows.select("key", recovery.snapshot_digest()).collect())
    late, early = datetime(2024, 6, 2), datetime(2024, 5, 1)
    proofs = spark.createDataFrame([(digest["a"], early, "REJECTED"), (digest["a"], late, "PROCESSED"), (digest["b"], early, "PROCESSED"), (digest["d"], late, "PROCESSED")], "digest string, stamp timestamp, state string")
    got = {r["key"]: (r["state"], r["evaluated_at"]) for r in recovery.recover(rows, proofs, F.when(F.col("title") == "bad", "no_scope")).collect()}
    assert got == {"a": ("PROCESSED", late), "b": ("PENDING_PROCESSING", None), "c": ("REJECTED", None), "d": ("PENDING_PROCESSING", None), "e": ("PENDING_PROCESSING", None)}
    existing = spark.createDataFrame([(1, digest["a"], False), (2, digest["b"], True), (3, digest["d"], False)], "id int, digest string, waiting boolean")
    met = rows.withColumn("row", F.col("key")).withColumn("match", F.expr("CASE key WHEN 'a' THEN 1 WHEN 'b' THEN 2 WHEN 'd' THEN 3 WHEN 'c' THEN 1 END"))
    assert dict(recovery.known_early(met, existing).collect()) == {"a": True, "b": False, "c": False, "d": False, "e": False}
    assert [recovery.stale_minutes(*x) for x in ((60, 390), (60, 10), (8, 6000))] == [11, 10, 10]


def test_sessions(spark):
    brief = {"wanted": ["rempart"], "excluded": ["route"], "places": ["fes"], "since": "2024-01-01", "until": None, "archive": False, "open_only": True}
    on = date(2024, 3, 1)
    rows = [
        (0, "Rempart de Fès", "e", "https://a.org/1", on, "open"), (1, "rempart de fes ", "e", "https://A.org/1/", on, "open"), (2, "Rempart de Fès", "e2", "https://a.org/1", on, None), (3, "Rempart de Fès", "e", "https://a.org/2", on, None),
        (4, "Rempart et route, Fès", "", "https://a.org/3", on, None), (5, "Rempart de Fès", "", "https://a.org/4", None, None), (6, "Rempart de Fès", "", "nowhere", on, None), (7, "Rempart de Fès", "", "https://a.org/5", on, "CLOSED"), (8, "Rempart", "", "https://a.org/6", on, None),
        (9, "Rempart de Fès", "new", "https://a.org/7", on, None),
    ]
    hits = spark.createDataFrame([(h, t, e, None, None, u, d, s, True) for h, t, e, u, d, s in rows], "hit int, title string, evidence string, institution string, location string, url string, day date, status string, official boolean")
    existing = spark.createDataFrame([(1, "https://a.org/2"), (2, "https://a.org/7")], "id int, url string")
    links = spark.createDataFrame([("https://a.org/7", "old", "REJECTED")], "url string, fingerprint string, review string")
    out = sessions.ingest(hits, existing, links, brief)
    assert {r["hit"]: r["outcome"] for r in out.collect()} == {0: "new", 1: "known", 2: "updated", 3: "known", 4: "rejected", 5: "rejected", 6: "rejected", 7: "rejected", 8: "rejected", 9: "updated"}
    assert tuple(sessions.counts(out).first()) == (1, 2, 2, 5, 4)

    held = spark.createDataFrame([(1, 1, "PENDING"), (1, 2, "PENDING"), (2, 1, "REJECTED")], "session int, result int, review string")
    said = spark.createDataFrame([(1, 1, "PERTINENT", 1), (1, 1, "REJECTED", 2), (1, 1, "TOO_BROAD", 3), (1, 2, "WRONG_DATE", 1), (1, 9, "REJECTED", 1), (2, 1, "maybe", 1)], "session int, result int, decision string, at int")
    after, refused = sessions.decide(held, said)
    assert sorted(map(tuple, after.collect())) == [(1, 1, "REJECTED"), (1, 2, "PENDING"), (2, 1, "REJECTED")]
    assert sorted((r["session"], r["reason"]) for r in refused.collect()) == [(1, "unknown_result"), (2, "unknown_decision")]

    s = spark.createDataFrame([(1, 1, "DRAFT"), (2, 3, "RUNNING"), (3, 1, "DRAFT"), (4, 1, "COMPLETED")], "session int, version int, status string")
    r = spark.createDataFrame([(0, 1, 1, "refine"), (1, 1, 1, "reserve"), (2, 2, 3, "reserve"), (3, 3, 2, "reserve"), (4, 4, 1, "cancel"), (5, 9, 1, "cancel")], "request int, session int, version int, kind string")
    now, answers = sessions.transit(s, r)
    assert {x["session"]: (x["version"], x["status"]) for x in now.collect()} == {1: (2, "DRAFT"), 2: (3, "RUNNING"), 3: (1, "DRAFT"), 4: (1, "COMPLETED")}
    assert dict(answers.collect()) == {0: "done", 1: "again", 2: "refused", 3: "stale", 4: "refused", 5: "unknown"}
    b = spark.createDataFrame([(["a", "b"], [], ["P"], ["CPS"], on, None)], "wanted array<string>, aliases array<string>, places array<string>, documents array<string>, since date, until date")
    assert b.select(sessions.query_text(F.struct("*"))).first()[0] == "Targeted professional research: a; b; P; CPS; 2024-03-01"


def test_refresh(spark):
    rows = [(i, page(listing(1, i, reference=str(i)), more=i < 7)) for i in range(1, 8)]
    df = spark.createDataFrame(rows, "page int, html string")
    none = spark.createDataFrame([], "identity string, digest string")
    seen, state = board.refresh(df, none, {}, 2, 3)
    first = state.first().asDict()
    assert first == {"cursor": 3, "cycle_pages": 5, "cycle_new": 5, "cycle_updated": 0, "cycle_unchanged": 0, "complete": False, "stop": "max_pages"}
    known = seen.select("identity", "digest").distinct()
    assert [r["page"] for r in seen.filter("crawl = 'deep'").orderBy("page").collect()] == [1, 2, 3]
    seen, state = board.refresh(df, known, first, 2, 3)
    second = state.first().asDict()
    assert (second["cursor"], second["cycle_new"], second["cycle_unchanged"], second["stop"]) == (6, 8, 2, "max_pages")
    last = board.refresh(df, known, second, 2, 3)[1].first().asDict()
    assert last == {"cursor": 0, "cycle_pages": 0, "cycle_new": 0, "cycle_updated": 0, "cycle_unchanged": 0, "complete": True, "stop": "final_page"}


def test_details(spark):
    c = spark.createDataFrame([(1, "1/24", "t", None), (2, "2/24", "t", "d"), (3, None, "t", None), (4, "4", "t", None)], "id int, reference string, title string, deadline string")
    good = "https://culture.gov.ma/notice/1"
    d = spark.createDataFrame([(1, "1-24", None, "2024", good), (2, "3/24", "x", "y", good), (3, "9", "T", None, "https://culture.gov.ma/search?q=a")], "id int, reference string, title string, deadline string, url string")
    out, refused = details.enriched(c, d, ["title", "deadline"])
    assert sorted(map(tuple, out.collect())) == [(1, "1-24", "t", "2024", good, True), (2, "2/24", "t", "d", None, False), (3, None, "t", None, None, False), (4, "4", "t", None, None, False)]
    assert dict(refused.collect()) == {2: "detail_reference_mismatch", 3: "not_detail_page"}
    p = spark.createDataFrame([("a", "x"), ("b", "x"), ("a ", "X!"), ("", "x")], "program string, funder string").withColumn("row", F.monotonically_increasing_id())
    kept = identity.first_wins_any(p.withColumns(details.first_keys("funding")), "row", ["program"]).filter("kept").count()
    assert kept == 3
    f = spark.createDataFrame([("s", "CHANGED"), ("t", "NOT_MODIFIED"), ("u", "FAILED")], "source string, state string")
    items, counts, health = details.run_sources(f, spark.createDataFrame([("s", 1), ("t", 2)], "source string, i int"))
    assert [tuple(r) for r in items.collect()] == [("s", 1)] and tuple(counts.first()) == (3, 1, 1, 1) and dict(health.collect()) == {"s": "HEALTHY", "t": "HEALTHY", "u": "FAILED"}


def test_cards_and_memory(spark):
    from tidewatch.operators import gating

    links = spark.createDataFrame([(1, 1, "NEW", "PENDING", 80), (1, 2, "KNOWN", "REJECTED", 60), (1, 3, "NEW", "PENDING", 50)], "session int, result int, match string, review string, score int")
    results = spark.createDataFrame([(1, "t", "u", date(2024, 1, 2), None, "R1", True), (2, "t", "u", None, None, "R1", None), (3, "t", "u", None, None, "R9", False)], "result int, title string, url string, published date, deadline date, collection string, targeted_only boolean")
    got = {r["result"]: (r["published"], r["deadline"], r["origin"]) for r in sessions.payload(links, results, {"R1": "Markets"}).collect()}
    assert got == {1: ("2024-01-02", "—", "targeted"), 2: ("—", "—", "Markets"), 3: ("—", "—", "R9")}
    s = spark.createDataFrame([(1, 5), (2, 7), (3, 7)], "session int, updated_at int")
    assert [r["session"] for r in sessions.history(s, 2).collect()] == [2, 3]
    o = F.struct(F.lit(True).alias("valid"), F.array(F.lit("a")).alias("reasons"))
    m = lambda prompt, rules="1": gating.memory("markets", rules, "S", prompt, o)
    assert tuple(spark.range(1).select(m("p") == m("p"), m("p") == m("q"), m("p") == m("p", "2")).first()) == (True, False, False)
