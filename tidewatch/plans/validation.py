"""Queries on what is checked before candidates are kept; fields, lengths and dates come from the tables' columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import validation
from .catalog import query


@query("""WITH s AS (SELECT s_suppkey AS position, CASE WHEN s_suppkey % 9 = 0 THEN ' ' ELSE s_name END AS name, CASE WHEN s_suppkey % 8 = 0 THEN 'ftp://x' ELSE 'https://s.example/' || s_suppkey END AS url, CASE WHEN s_suppkey % 5 = 0 THEN 'PDF' WHEN s_suppkey % 5 = 1 THEN NULL ELSE 'TABLE' END AS parser, CASE WHEN s_nationkey % 2 = 0 THEN s_nationkey END AS priority, s_acctbal > 0 AS enabled FROM supplier),
f AS (SELECT position, coalesce(priority, 50) AS priority, coalesce(parser, 'HTML_LIST') AS parser, CASE WHEN trim(name) = '' THEN 'no_name' WHEN url LIKE 'ftp%' THEN 'no_address' WHEN parser = 'PDF' THEN 'unknown_parser' END AS error FROM s WHERE enabled)
SELECT position, priority, parser, error, CASE WHEN error IS NULL THEN row_number() OVER (PARTITION BY error IS NULL ORDER BY priority, position) END AS place FROM f""")
def q_source_plan(t):
    """Suppliers as sources: enabled ones by priority, what they leave unsaid filled in, bad ones told apart."""
    k = F.col("s_suppkey")
    records = t("supplier").select(
        k.alias("position"), F.when(k % 9 == 0, " ").otherwise(F.col("s_name")).alias("name"), F.when(k % 8 == 0, "ftp://x").otherwise(F.concat(F.lit("https://s.example/"), k)).alias("index_url"),
        F.when(k % 5 == 0, "PDF").when(k % 5 > 1, "TABLE").alias("parser_type"), F.when(F.col("s_nationkey") % 2 == 0, F.col("s_nationkey")).alias("priority"), (F.col("s_acctbal") > 0).alias("enabled"),
    )
    return validation.planned_sources(records).select("position", "priority", F.col("parser_type").alias("parser"), "error", "place")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderdate::DATE < DATE '1995-06-17' AND o_orderstatus <> 'P' THEN 'reject' WHEN left(o_orderpriority, 1) IN ('1', '4') THEN 'continue' ELSE 'reject' END AS decision,
CASE WHEN o_orderdate::DATE < DATE '1995-06-17' AND o_orderstatus <> 'P' THEN 'closed_or_expired' WHEN left(o_orderpriority, 1) = '1' THEN 'A_heritage_service' WHEN left(o_orderpriority, 1) = '4' THEN 'C_architectural_competition' WHEN left(o_orderpriority, 1) = '5' THEN 'pure_execution' ELSE 'unrelated_scope' END AS reason FROM orders WHERE left(o_orderpriority, 1) <> '3'""")
def q_listing_gate(t):
    """Listings whose date has passed go before anything is read, the others by their title; without a date the title alone decides."""
    titles = {"1": "Etude de restauration des remparts de la médina", "2": "Gardiennage et nettoyage des locaux", "4": "Concours architectural pour la réhabilitation d'un théâtre", "5": "Travaux de construction du gros oeuvre du dépôt"}
    title = F.try_element_at(F.create_map(*[F.lit(x) for p in titles.items() for x in p]), F.left("o_orderpriority", F.lit(1)))
    due = F.when(F.col("o_orderstatus") == "P", "à préciser").otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    g = validation.listing_gate(title, F.lit(""), F.lit(""), due, F.lit("1995-06-17").cast("date"))
    return t("orders").filter(title.isNotNull()).select(F.col("o_orderkey").alias("id"), g.alias("g")).select("id", "g.decision", "g.reason")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 = 0 THEN 'title_or_reference_required' END AS error, CASE WHEN o_orderkey % 10 <> 0 THEN CASE WHEN o_orderkey % 10 = 1 THEN o_orderkey || '/24' ELSE 'Avis ' || o_orderkey END END AS title, CASE WHEN o_custkey % 4 <> 0 THEN 'Commune ' || o_custkey END AS institution,
CASE WHEN o_custkey % 3 = 0 THEN 'unknown' ELSE 'open' END AS status, CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '+01:00' END AS deadline_at, CASE o_orderstatus WHEN 'P' THEN 'PROCUREMENT_AGGREGATOR' WHEN 'O' THEN 'DISCOVERY_ONLY' ELSE 'OFFICIAL_INSTITUTIONAL' END AS source_role,
CASE WHEN o_orderstatus = 'P' THEN 'true' END AS at_home, CASE WHEN o_orderpriority NOT LIKE '5%' THEN floor(o_totalprice) END AS amount, 'MAD' AS currency, CASE WHEN o_orderpriority LIKE '5%' THEN 'TTC' ELSE 'UNKNOWN' END AS tax_mode, 20000.5 AS bond FROM orders""")
def q_admitted_hits(t):
    """Hits of all orders in bounds: long fields out, times with a zone only, figures read, those that name nothing with an error."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    host = F.when(F.col("o_orderstatus") == "P", "https://www.marchefacile.ma/avis/").when(F.col("o_orderstatus") == "O", "https://elsewhere.example/").otherwise("https://www.alomrane.gov.ma/avis/")
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    hits = t("orders").select(
        k.alias("id"), F.when(k % 10 > 1, F.concat(F.lit("Avis "), k)).otherwise("").alias("title"), F.when(k % 10 > 0, F.concat(k, F.lit("/24"))).alias("reference"), F.concat(host, k).alias("url"), F.lit("e").alias("evidence"),
        F.concat(F.lit("Commune "), c, F.when(c % 4 == 0, F.repeat(F.lit("x"), F.lit(250))).otherwise("")).alias("institution"), F.lit(None).cast("string").alias("location"), F.lit(None).cast("string").alias("official_date_evidence"), F.lit("tender").alias("procedure_type"),
        F.when(c % 3 == 0, F.repeat(F.lit("y"), F.lit(101))).otherwise("open").alias("status"), F.when(F.col("o_orderstatus") == "F", F.concat(stamp, F.lit("+01:00"))).when(F.col("o_orderstatus") == "O", stamp).otherwise("demain").alias("deadline_at"),
        F.when(F.col("o_orderpriority").startswith("5"), "* TTC MAD").otherwise(F.concat(F.floor("o_totalprice"), F.lit(",00 DH"))).alias("estimated_amount"), F.lit("20 000,5 DH").alias("provisional_bond"), F.lit(None).cast("boolean").alias("at_home"), F.lit(None).cast("string").alias("found_from"),
    )
    return validation.admitted(hits).select("id", "error", F.nullif("title", F.lit("")).alias("title"), "institution", "status", "deadline_at", "source_role", F.col("at_home").cast("string").alias("at_home"), "amount", "currency", "tax_mode", "bond")


@query("""SELECT o_orderkey AS id, concat_ws(',', CASE WHEN o_orderkey % 6 = 0 THEN 'bad_url' END, CASE WHEN o_orderkey % 7 = 0 THEN 'metadata_too_long' END, CASE WHEN o_orderkey % 5 = 0 THEN 'metadata_no_json' END, CASE WHEN o_custkey % 11 = 0 THEN 'official_url_too_long' END,
CASE WHEN o_orderstatus <> 'P' AND left(o_orderpriority, 1) = '5' THEN 'priority' END, CASE WHEN o_orderstatus <> 'P' AND o_totalprice > 100000 THEN 'score' END, CASE WHEN o_orderstatus <> 'P' AND o_custkey % 4 = 0 THEN 'confidence' END, CASE WHEN o_orderstatus <> 'P' AND o_custkey % 3 = 0 THEN 'category' END) AS errors,
CASE WHEN o_orderkey % 6 > 0 THEN 'https://a.example/' || o_orderkey END AS url FROM orders""")
def q_checked_candidates(t):
    """Bounds of all candidates and their analyses, every one that is broken named; candidates without an analysis break none of its."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    a = F.struct(
        F.lit(True).alias("relevant"), (F.left("o_orderpriority", F.lit(1)).cast("int") + F.when(F.col("o_orderpriority").startswith("5"), 1).otherwise(0)).alias("priority"), F.when(F.col("o_totalprice") > 100000, 101).otherwise(50).alias("score"), F.when(c % 3 > 0, "x").otherwise("").alias("category"),
        F.lit("s").alias("summary"), F.lit("r").alias("reason"), F.when(c % 4 == 0, float("nan")).otherwise(0.5).alias("confidence"), F.lit(False).alias("manual"),
    )
    meta = F.concat(F.when(k % 5 == 0, "no json ").otherwise('{"a": "'), F.when(k % 7 == 0, F.repeat(F.lit("z"), F.lit(65536))).otherwise("z"), F.when(k % 5 == 0, "").otherwise('"}'))
    rows = t("orders").select(k.alias("id"), F.when(k % 6 == 0, "mailto:x").otherwise(F.concat(F.lit("HTTPS://A.example/"), k, F.lit("/?utm_x=1#f"))).alias("url"), meta.alias("metadata"), F.concat(F.lit("https://o.example/"), F.when(c % 11 == 0, F.repeat(F.lit("p"), F.lit(4000))).otherwise("")).alias("official_url"), F.when(F.col("o_orderstatus") != "P", a).alias("analysis"))
    return validation.checked(rows, ["official_url"]).select("id", F.array_join("errors", ",").alias("errors"), "url")


@query("""WITH d AS (SELECT doc_id, source, lang, n_chars, coalesce(text, '') AS text FROM documents)
SELECT doc_id AS id, source, n_chars, contains(lower(text), 'urban') AS urban, lang IS NULL AS without, false AS verbose FROM d""")
def q_compact_candidates(t):
    """Documents as candidates in compact form: short fields and signs stay, whole texts do not."""
    rows = t("documents").select(F.col("doc_id").alias("id"), "source", "n_chars", "lang", F.col("text").alias("raw_text"), F.lit(None).cast("string").alias("metadata"))
    j = validation.compact(rows, ["source", "n_chars", "lang", "raw_text", "metadata"])
    got = lambda p: F.get_json_object("payload", p)
    words = F.from_json(got("$.signal_keywords"), "array<string>")
    return j.select("id", got("$.candidate.source").alias("source"), got("$.candidate.n_chars").cast("long").alias("n_chars"), F.array_contains(words, "urban").alias("urban"), got("$.candidate.lang").isNull().alias("without"), got("$.candidate.raw_text").isNotNull().alias("verbose"))


@query("""WITH e AS (SELECT o_orderkey, o_custkey, o_orderdate::DATE AS day, o_orderpriority FROM orders)
SELECT o_orderkey AS id, o_custkey % 4 <> 0 AND o_orderkey % 5 <> 0 AS same FROM e""")
def q_unchanged_discoveries(t):
    """Whether what a discovery says now is what it said before: case and spaces do not count, dates and words do."""
    o = t("orders")
    day = F.to_date("o_orderdate")
    before = {"title": F.col("o_orderpriority"), "reference": F.col("o_orderkey").cast("string"), "institution": F.concat(F.lit("Client "), "o_custkey"), "deadline": day, "publication_date": F.lit(None).cast("date"), "source_status": F.lit("open"), "url": F.lit("https://x.example")}
    after = before | {"title": F.concat(F.lit("  "), F.lower("o_orderpriority")), "institution": F.concat(F.lit("CLIENT  "), "o_custkey", F.when(F.col("o_custkey") % 4 == 0, " bis").otherwise("")), "deadline": F.when(F.col("o_orderkey") % 5 == 0, F.date_add(day, 1)).otherwise(day)}
    return o.select(F.col("o_orderkey").alias("id"), validation.snapshot(before).eqNullSafe(validation.snapshot(after)).alias("same"))
