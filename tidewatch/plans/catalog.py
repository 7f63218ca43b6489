"""Registered queries over the test tables, each with the SQL it must agree with.

Roles of the tables: documents are monitored results, labels the reviews of
them, pages captured sources, events observations (a user is an entity, the
event type its state), orders runs, lineitem their items.  ``AS_OF`` replaces
the wall clock everywhere.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text, urls
from ..operators import keyed
from ..operators.written import Written

AS_OF = "2024-01-31"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
FOLD = "trim(regexp_replace(lower(strip_accents(replace({0}, 'ß', 'ss'))), '[^a-z0-9]+', ' ', 'g'))"
NORM = "trim(regexp_replace(lower(replace({0}, 'ß', 'ss')), '\\s+', ' ', 'g'))"


def register(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    """Add a query of (session, folder of tables) and its DuckDB SQL; a name is given once."""
    if name in QUERIES:
        raise ValueError(f"two queries are named {name}")
    QUERIES[name] = run
    if sql:
        ORACLE[name] = sql


def query(sql: str | None = None):
    """Register a function of (reader of tables) under its name, with its DuckDB SQL."""

    def add(f):
        register(f.__name__, lambda spark, d: f(lambda t: spark.read.parquet(f"{d}/{t}.parquet")), sql)
        return f

    return add


def _literal(x) -> str:
    return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int | float) else "'" + str(x).replace("'", "''") + "'"


def golden(given: str, out: list[str], cases: list[tuple[tuple, tuple]]):
    """Register a rule over the orders, which carry the rows of ``cases`` in turn.

    The function takes the given columns and returns the outcomes as a list, or as a struct that has them (and is then
    computed once per row).  Outcomes are read as text, lists joined by commas.  The SQL knows nothing of the rule: it
    counts, per order, the outcome that each case says it must have.
    """

    def add(f):
        def run(spark: SparkSession, d: str) -> DataFrame:
            rows = spark.createDataFrame([(i, *g) for i, (g, _) in enumerate(cases)], f"i int, {given}")
            names = [x.split()[0] for x in given.split(", ")]
            got = f(*[F.col(n) for n in names])
            judged = rows.select("i", *[c.alias(n) for n, c in zip(out, got, strict=True)]) if isinstance(got, list) else rows.select("i", F.inline(F.array(got)))
            said = [(F.array_join(n, ",") if judged.schema[n].dataType.typeName() == "array" else F.col(n).cast("string")).alias(n) for n in out]
            # a text that many orders carry is judged once
            carried = spark.read.parquet(f"{d}/orders.parquet").groupBy(F.pmod("o_orderkey", F.lit(len(cases))).cast("int").alias("i")).agg(F.count("*").alias("n"))
            return carried.join(judged.select("i", *said), "i").select("i", *out, "n")

        values = ", ".join("(" + ", ".join([str(i), *map(_literal, o)]) + ")" for i, (_, o) in enumerate(cases))
        register(f.__name__, run, f"WITH g(i, {', '.join(out)}) AS (VALUES {values}) SELECT g.i::INT AS i, {', '.join(f'{n}::VARCHAR AS {n}' for n in out)}, count(*) AS n FROM orders JOIN g ON g.i = o_orderkey % {len(cases)} GROUP BY ALL")
        return f

    return add


@query(f"""WITH k AS (SELECT min(doc_id) AS doc_id FROM (SELECT doc_id, {NORM.format("text")} AS key FROM documents) GROUP BY key)
SELECT d.doc_id, d.source, d.lang, (SELECT count(*) FROM k) AS total, l.quality AS review FROM k JOIN documents d USING (doc_id) LEFT JOIN labels l USING (doc_id)
ORDER BY (l.quality IS NULL) DESC, d.n_chars DESC, d.doc_id LIMIT 25""")
def q_review_queue_page(t):
    """First page of the review queue: copies dropped, unreviewed first, longest first, with the total."""
    docs = t("documents").select("doc_id", "source", "lang", "n_chars", F.unhex(F.md5(text.normalize_text(F.col("text")))).alias("key"))
    one = docs.groupBy("key").agg(F.min_by(F.struct("doc_id", "source", "lang", "n_chars"), "doc_id").alias("d")).select("d.*")
    one = Written(one.sparkSession).keep(one)  # narrow rows, read twice: for the page and for the total
    total = one.agg(F.count("*").alias("total"))
    page = one.join(t("labels").select("doc_id", F.col("quality").alias("review")), "doc_id", "left").orderBy(F.col("review").isNull().desc(), F.desc("n_chars"), "doc_id").limit(25)
    return page.join(F.broadcast(total)).select("doc_id", "source", "lang", "total", "review")


@query("""SELECT r.r_name AS region, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region r ON n_regionkey = r_regionkey WHERE r.r_name IN ('ASIA', 'EUROPE') GROUP BY 1""")
def q_dim_lookup(t):
    dims = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region").filter(F.col("r_name").isin("ASIA", "EUROPE")), F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", F.col("r_name").alias("region"))
    return t("orders").join(dims, F.col("o_custkey") == F.col("c_custkey")).groupBy("region").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""SELECT c_custkey, max(o_orderdate)::DATE::VARCHAR AS last_run FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def q_left_outer_launcher(t):
    last = t("orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("m"))
    return t("customer").join(last, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", F.to_date("m").cast("string").alias("last_run"))


@query("SELECT source, count(*) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY 1")
def q_semi_reviewed(t):
    return t("documents").select("doc_id", "source").join(t("labels").filter("quality = 1"), "doc_id", "left_semi").groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT source, count(*) AS n FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) GROUP BY 1")
def q_anti_unreviewed(t):
    return t("documents").select("doc_id", "source").join(t("labels"), "doc_id", "left_anti").groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate + INTERVAL 60 DAY) GROUP BY 1")
def q_correlated_anti(t):
    late = (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_shipdate") > F.col("o_orderdate") + F.expr("INTERVAL 60 DAY"))
    return t("orders").join(t("lineitem").select("l_orderkey", "l_shipdate"), late, "left_anti").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query(f"""WITH k AS (SELECT source, {NORM.format("text")} AS key, doc_id FROM documents WHERE length(text) >= 25)
SELECT md5(key) AS key, count(DISTINCT source) AS sources, count(*) AS copies, min(doc_id) AS first_doc FROM k GROUP BY key HAVING count(DISTINCT source) > 1""")
def q_cross_source_mirror(t):
    """Texts that more than one source carries: an aggregation, no self-join."""
    k = t("documents").filter(F.length("text") >= 25).select("source", "doc_id", F.md5(text.normalize_text(F.col("text"))).alias("key"))
    return k.groupBy("key").agg(F.size(F.collect_set("source")).cast("long").alias("sources"), F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).filter("sources > 1")


@query("""SELECT event_id, (SELECT max(v.event_id) FROM events v WHERE v.user_id = p.user_id AND v.event_type = 'view' AND v.ts = (SELECT max(x.ts) FROM events x WHERE x.user_id = p.user_id AND x.event_type = 'view' AND x.ts <= p.ts)) AS view_id FROM events p WHERE event_type = 'purchase'""")
def q_asof_event(t):
    """Last view at or before each purchase: one window over both, no range join."""
    e = t("events").filter(F.col("event_type").isin("view", "purchase"))
    w = Window.partitionBy("user_id").orderBy("ts", (F.col("event_type") == "purchase").cast("int"), "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return e.withColumn("view_id", F.last(F.when(F.col("event_type") == "view", F.col("event_id")), True).over(w)).filter("event_type = 'purchase'").select("event_id", "view_id")


@query("""SELECT (SELECT count(*) FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)) AS both_, (SELECT count(*) FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier)) AS left_, (SELECT count(*) FROM (SELECT s_nationkey FROM supplier EXCEPT SELECT c_nationkey FROM customer)) AS right_""")
def q_set_overlap(t):
    c = t("customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.lit(1).alias("c"))
    s = t("supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.lit(1).alias("s"))
    return c.join(s, "k", "full").agg(F.count_if(F.expr("c = 1 AND s = 1")).alias("both_"), F.count_if(F.expr("s IS NULL")).alias("left_"), F.count_if(F.expr("c IS NULL")).alias("right_"))


@query(f"""WITH d AS (SELECT DISTINCT md5({NORM.format("coalesce(text, '')")}) AS k FROM documents), b AS (SELECT DISTINCT md5({NORM.format("coalesce(text, '')")}) AS k FROM benchmark)
SELECT count(*) FILTER (d.k IS NOT NULL AND b.k IS NOT NULL) AS both_, count(*) FILTER (b.k IS NULL) AS left_, count(*) FILTER (d.k IS NULL) AS right_ FROM d FULL JOIN b ON d.k = b.k""")
def q_set_overlap_texts(t):
    """Text keys of documents and benchmark: digests of normalised texts, one full join."""
    of = lambda name, side: t(name).groupBy(F.md5(text.normalize_text(F.col("text"))).alias("k")).agg(F.lit(1).alias(side))
    return of("documents", "d").join(of("benchmark", "b"), "k", "full").agg(F.count_if(F.expr("d = 1 AND b = 1")).alias("both_"), F.count_if(F.expr("b IS NULL")).alias("left_"), F.count_if(F.expr("d IS NULL")).alias("right_"))


@query("""SELECT n_name, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus = 'O') AS open_, count(*) FILTER (o_orderstatus = 'P') AS partial_ FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1""")
def q_status_counts(t):
    by = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(*[F.count_if(F.col("o_orderstatus") == s).alias(n) for s, n in (("F", "done"), ("O", "open_"), ("P", "partial_"))])
    return by.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(*[F.sum(c).alias(c) for c in ("done", "open_", "partial_")])


@query("SELECT ts::DATE::VARCHAR AS day, round(sum(value), 2) AS used, round(greatest(0, 5000 - sum(value)), 2) AS remaining FROM events GROUP BY 1")
def q_daily_budget(t):
    return t("events").groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.round(F.sum("value"), 2).alias("used"), F.round(F.greatest(F.lit(0.0), 5000 - F.sum("value")), 2).alias("remaining"))


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def q_latest_per_key(t):
    return keyed.latest(t("events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query("""SELECT user_id, state FROM (SELECT user_id, CASE WHEN event_type = 'error' AND (props->>'k')::INT > 50 THEN 'retry' ELSE event_type END AS state, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def q_latest_remapped(t):
    """A state is remapped before the latest per key is taken."""
    k = F.get_json_object("props", "$.k").try_cast("int")
    e = t("events").withColumn("state", F.when((F.col("event_type") == "error") & (k > 50), "retry").otherwise(F.col("event_type")))
    return keyed.latest(e, ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "state")


@query(f"SELECT min(doc_id) AS first_seq, count(*) AS n, md5(key) AS key FROM (SELECT doc_id, {NORM.format('text')} AS key FROM documents) GROUP BY key")
def q_first_wins_dedup(t):
    return keyed.first_wins(t("documents"), F.md5(text.normalize_text(F.col("text"))), "doc_id").select("first_seq", "n", "key")


@query("SELECT o_orderkey, o_orderpriority FROM orders ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END, o_totalprice DESC NULLS LAST, o_orderkey DESC LIMIT 50")
def q_queue_order(t):
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(2)
    return t("orders").orderBy(rank, F.desc_nulls_last("o_totalprice"), F.desc("o_orderkey")).limit(50).select("o_orderkey", "o_orderpriority")


@query("SELECT source, doc_id, r FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= 5")
def q_topk_per_source(t):
    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    return t("documents").select("source", "doc_id", "n_chars").withColumn("r", F.row_number().over(w)).filter("r <= 5").select("source", "doc_id", "r")


@query("""SELECT source, count(*) FILTER (run <= 200000) AS kept, count(*) FILTER (run > 200000) AS cut_, bool_or(run > 200000) AS truncated FROM (SELECT source, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS run FROM documents) GROUP BY 1""")
def q_candidate_cap(t):
    """Candidates of a source within a running budget of characters, and whether any was cut."""
    docs = t("documents").select("source", "doc_id", "n_chars").withColumn("part", F.floor(F.col("doc_id") / 4096))
    # a source may hold any share of the rows: sums of ranges of ids first, then rows within their range
    ranges = docs.groupBy("source", "part").agg(F.sum("n_chars").alias("s"))
    before = F.coalesce(F.sum("s").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    run = F.sum("n_chars").over(Window.partitionBy("source", "part").orderBy("doc_id")) + F.col("before")
    rows = docs.join(ranges.select("source", "part", before.alias("before")), ["source", "part"]).select("source", run.alias("run"))
    return rows.groupBy("source").agg(F.count_if(F.expr("run <= 200000")).alias("kept"), F.count_if(F.expr("run > 200000")).alias("cut_"), F.bool_or(F.expr("run > 200000")).alias("truncated"))


_HOST = r"lower(regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', ''))"
_PARTS = r"list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_[^=]*|fbclid|gclid|msclkid)(=|$)'))"
_CANON = rf"""CASE WHEN regexp_matches(url, '^https?://[^/?#@]+([/?#]|$)') THEN regexp_extract(url, '^([a-z]+)://', 1) || '://' || {_HOST} || CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]*?(:[0-9]+)?([/?#]|$)', 1) IN ('', ':80', ':443') THEN '' ELSE regexp_extract(url, '^[a-z]+://[^/?#]*?(:[0-9]+)?([/?#]|$)', 1) END
 || coalesce(nullif(rtrim(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), ''), '/') || CASE WHEN len({_PARTS}) > 0 THEN '?' || array_to_string(list_transform({_PARTS}, lambda x: CASE WHEN contains(x, '=') THEN x ELSE x || '=' END), '&') ELSE '' END END"""


@query(f"SELECT page_id, {_CANON} AS canonical, {_HOST} AS host FROM pages")
def q_canonical_url(t):
    return t("pages").select("page_id", urls.canonical_url(F.col("url")).alias("canonical"), urls.host(F.col("url")).alias("host"))


@query(f"""SELECT page_id, sha256('["v1", "url", ' || coalesce('"' || {_CANON} || '"', 'null') || ']') AS digest FROM pages""")
def q_url_digest(t):
    return t("pages").select("page_id", urls.key_digest(F.lit("v1"), F.lit("url"), urls.canonical_url(F.col("url"))).alias("digest"))


@query(f"SELECT {_HOST} AS host, count(*) AS pages, sha256(string_agg(DISTINCT sha256(url), ',' ORDER BY sha256(url))) AS digest FROM pages GROUP BY 1")
def q_item_set_hash(t):
    """Digest of a host's set of pages, independent of their order."""
    return t("pages").groupBy(urls.host(F.col("url")).alias("host")).agg(F.count("*").alias("pages"), F.sha2(F.array_join(F.array_sort(F.collect_set(F.sha2("url", 256))), ","), 256).alias("digest"))


@query(f"SELECT doc_id, md5({FOLD.format('text')}) AS folded FROM documents")
def q_fold_text(t):
    return t("documents").select("doc_id", F.md5(text.fold_text(F.col("text"))).alias("folded"))


TERMS = ["license", "copyright", "the", "apache", "der", "que", "password", "les"]


@query(f"SELECT doc_id, array_to_string(list_filter({TERMS}, lambda x: contains(' ' || {FOLD.format('text')} || ' ', ' ' || x || ' ')), ',') AS hits FROM documents")
def q_lexicon_hits(t):
    return t("documents").select("doc_id", F.array_join(text.lexicon_hits(text.fold_text(F.col("text")), TERMS), ",").alias("hits"))


CLASSES = [("legal", ["license", "copyright"]), ("german", ["und", "der"]), ("french", ["les", "des"]), ("spanish", ["que", "los"]), ("english", ["the", "and"])]
_CASE = " ".join("WHEN " + " OR ".join(f"contains(f, ' {x} ')" for x in terms) + f" THEN '{name}'" for name, terms in CLASSES)


@query(f"SELECT class, count(*) AS n FROM (SELECT CASE {_CASE} ELSE 'other' END AS class FROM (SELECT ' ' || {FOLD.format('text')} || ' ' AS f FROM documents)) GROUP BY 1")
def q_first_match_class(t):
    return t("documents").select(text.first_class(text.fold_text(F.col("text")), CLASSES, "other").alias("class")).groupBy("class").agg(F.count("*").alias("n"))


@query("""WITH d AS (SELECT doc_id, n_chars, lang, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))
SELECT doc_id, CASE WHEN toxic = 1 OR quality = 0 THEN 'reject' WHEN quality IS NULL OR n_chars < 200 THEN 'review' ELSE 'keep' END AS decision,
 array_to_string(list_filter([CASE WHEN toxic = 1 THEN 'toxic' END, CASE WHEN quality = 0 THEN 'low_quality' END, CASE WHEN quality IS NULL THEN 'unreviewed' END, CASE WHEN n_chars < 200 THEN 'short' END], lambda x: x IS NOT NULL), ',') AS reasons FROM d""")
def q_rule_decision(t):
    """An explainable decision: ordered rules, and every reason that applies."""
    d = t("documents").select("doc_id", "n_chars").join(t("labels"), "doc_id", "left")
    reasons = F.array_compact(F.array(F.when(F.expr("toxic = 1"), "toxic"), F.when(F.expr("quality = 0"), "low_quality"), F.when(F.expr("quality IS NULL"), "unreviewed"), F.when(F.expr("n_chars < 200"), "short")))
    decision = F.when(F.expr("toxic = 1 OR quality = 0"), "reject").when(F.expr("quality IS NULL OR n_chars < 200"), "review").otherwise("keep")
    return d.select("doc_id", decision.alias("decision"), F.array_join(reasons, ",").alias("reasons"))


@query(ORACLE["q_rule_decision"].replace("SELECT doc_id, CASE", "SELECT unnest(string_split(reasons, ',')) AS reason, count(*) AS n FROM (SELECT doc_id, CASE") + ") WHERE reasons <> '' GROUP BY 1")
def q_reason_histogram(t):
    return q_rule_decision(t).filter("reasons <> ''").select(F.explode(F.split("reasons", ",")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag AS family, round(sum(l_quantity), 2) AS units, round(sum(l_quantity) / nullif(sum(l_extendedprice), 0), 6) AS ratio FROM lineitem GROUP BY 1")
def q_usage_ratio(t):
    return t("lineitem").groupBy(F.col("l_returnflag").alias("family")).agg(F.round(F.sum("l_quantity"), 2).alias("units"), F.round(F.try_divide(F.sum("l_quantity"), F.sum("l_extendedprice")), 6).alias("ratio"))


@query("SELECT s_nationkey, arg_min(s_suppkey, (s_acctbal, s_suppkey)) AS supplier FROM supplier GROUP BY 1")
def q_min_by_link(t):
    return t("supplier").groupBy("s_nationkey").agg(F.min_by("s_suppkey", F.struct("s_acctbal", "s_suppkey")).alias("supplier"))


@query("SELECT source, bool_or(toxic = 1) AS any_toxic, count(*) FILTER (quality = 0) AS failing, count(quality) AS reviewed FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def q_health_rollup(t):
    return t("documents").select("doc_id", "source").join(t("labels"), "doc_id", "left").groupBy("source").agg(F.bool_or(F.expr("toxic = 1")).alias("any_toxic"), F.count_if(F.expr("quality = 0")).alias("failing"), F.count("quality").alias("reviewed"))


_SNAP = "SELECT user_id, arg_max(event_type || ':' || value, (ts, event_id)) AS digest FROM events {} GROUP BY 1"


def _classes(old: DataFrame, new: DataFrame) -> DataFrame:
    snap = lambda e: e.groupBy("user_id").agg(F.max_by(F.concat_ws(":", "event_type", F.col("value").cast("string")), F.struct("ts", "event_id")).alias("digest"))
    return keyed.classify(snap(old), snap(new), "user_id", "digest").groupBy("state").agg(F.count("*").alias("n"))


@query(f"""WITH o AS ({_SNAP.format("WHERE ts < TIMESTAMP '2024-01-29'")}), n AS ({_SNAP.format("WHERE ts >= TIMESTAMP '2024-01-29'")})
SELECT CASE WHEN o.user_id IS NULL THEN 'NEW' WHEN n.user_id IS NULL THEN 'MISSING' WHEN o.digest = n.digest THEN 'UNCHANGED' ELSE 'UPDATED' END AS state, count(*) AS n FROM o FULL JOIN n USING (user_id) GROUP BY 1""")
def q_cdc_classify(t):
    """Change classes of all entities: the earlier snapshot is what was seen before a date, the later one what was seen from it on."""
    return _classes(t("events").filter("ts < TIMESTAMP_NTZ '2024-01-29'"), t("events").filter("ts >= TIMESTAMP_NTZ '2024-01-29'"))


@query("""WITH o AS (SELECT user_id, max(value) AS value, min(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY 1), n AS (SELECT user_id, CASE WHEN max(value) > 40 THEN max(value) END AS value, max(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT coalesce(o.user_id, n.user_id) AS user_id, coalesce(n.value, o.value) AS value, coalesce(n.event_id, o.event_id) AS event_id FROM o FULL JOIN n ON o.user_id = n.user_id""")
def q_upsert_merge(t):
    e = t("events")
    old = e.filter("event_type = 'view'").groupBy("user_id").agg(F.max("value").alias("value"), F.min("event_id").alias("event_id"))
    new = e.filter("event_type = 'purchase'").groupBy("user_id").agg(F.when(F.max("value") > 40, F.max("value")).alias("value"), F.max("event_id").alias("event_id"))
    return keyed.merge(old, new, "user_id", ["value", "event_id"])


@query("""WITH s AS (SELECT user_id, arg_min({'event_type': event_type, 'value': value, 'props': props}, (ts, event_id)) AS a, arg_max({'event_type': event_type, 'value': value, 'props': props}, (ts, event_id)) AS b FROM events GROUP BY 1)
SELECT user_id, array_to_string(list_filter([CASE WHEN a.event_type IS DISTINCT FROM b.event_type THEN 'event_type' END, CASE WHEN a.value IS DISTINCT FROM b.value THEN 'value' END, CASE WHEN a.props IS DISTINCT FROM b.props THEN 'props' END], lambda x: x IS NOT NULL), ',') AS changed FROM s""")
def q_changed_fields(t):
    fields = ["event_type", "value", "props"]
    s = t("events").groupBy("user_id").agg(F.min_by(F.struct(*fields), F.struct("ts", "event_id")).alias("a"), F.max_by(F.struct(*fields), F.struct("ts", "event_id")).alias("b"))
    return s.select("user_id", F.array_join(keyed.changed_fields(fields, "a", "b"), ",").alias("changed"))


@query("""SELECT user_id, event_id FROM (SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) AS c FROM events) WHERE c >= 3""")
def q_sliding_limiter(t):
    """Events that exceed a rate: at least three of one entity within six hours."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy("at").rangeBetween(-6 * 3600 * 1_000_000, 0)
    return t("events").select("user_id", "event_id", at.alias("at")).withColumn("c", F.count("*").over(w)).filter("c >= 3").select("user_id", "event_id")


@query("""WITH s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS g FROM events)
SELECT user_id, max(c) AS longest FROM (SELECT user_id, event_type, g, count(*) AS c FROM s GROUP BY 1, 2, 3) GROUP BY 1""")
def q_unchanged_streak(t):
    """Longest run of one state per entity."""
    all_ = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    own = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    return t("events").select("user_id", "event_type", (all_ - own).alias("g")).groupBy("user_id", "event_type", "g").agg(F.count("*").alias("c")).groupBy("user_id").agg(F.max("c").alias("longest"))


@query("""SELECT CASE WHEN date_diff('day', ts::DATE, DATE '2024-01-31') <= 7 THEN 'fresh' WHEN date_diff('day', ts::DATE, DATE '2024-01-31') <= 21 THEN 'recent' ELSE 'stale' END AS age, count(*) AS n FROM events GROUP BY 1""")
def q_freshness(t):
    days = F.datediff(F.lit(AS_OF).cast("date"), F.to_date("ts"))
    return t("events").groupBy(F.when(days <= 7, "fresh").when(days <= 21, "recent").otherwise("stale").alias("age")).agg(F.count("*").alias("n"))


@query("SELECT event_type, sum((props->>'k')::BIGINT) AS k FROM events GROUP BY 1")
def q_json_items(t):
    return t("events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").try_cast("long")).alias("k"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def q_html_title(t):
    return t("pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query(r"""SELECT page_id, len(list_filter(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1), lambda x: length(x) >= 18))::BIGINT AS links FROM pages""")
def q_html_links(t):
    """Links of a page whose label is long enough."""
    labels = F.regexp_extract_all("html", F.lit('<a href="[^"]*">([^<]*)</a>'), F.lit(1))
    return t("pages").select("page_id", F.size(F.filter(labels, lambda x: F.length(x) >= 18)).cast("long").alias("links"))


@query("""SELECT user_id, string_agg(event_type, '>' ORDER BY ts, event_id) AS history FROM events GROUP BY 1""")
def q_lifecycle(t):
    h = F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type")))
    return t("events").groupBy("user_id").agg(F.array_join(F.transform(h, lambda x: x["event_type"]), ">").alias("history"))


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events)
SELECT user_id, event_id FROM e WHERE r = 1 AND (event_type IN ('view', 'click') OR (event_type = 'error' AND ts < TIMESTAMP '2024-01-28'))""")
def q_pending_ledger(t):
    """Entities whose latest state is pending, or an error old enough to be tried again."""
    last = keyed.latest(t("events"), ["user_id"], [F.desc("ts"), F.desc("event_id")])
    return last.filter("event_type IN ('view', 'click') OR (event_type = 'error' AND ts < TIMESTAMP_NTZ '2024-01-28')").select("user_id", "event_id")


@query("""SELECT regexp_extract(lower(word), '[a-z]+') AS term, count(DISTINCT doc_id) AS support FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS word FROM documents JOIN labels USING (doc_id) WHERE quality = 1) WHERE length(regexp_extract(lower(word), '[a-z]+')) >= 5 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 20""")
def q_feature_profile(t):
    """Terms of well-rated documents with enough support; distinct terms per document before the shuffle."""
    good = t("documents").select("doc_id", "text").join(t("labels").filter("quality = 1"), "doc_id", "left_semi")
    terms = F.array_distinct(F.transform(F.split("text", " "), lambda w: F.regexp_extract(F.lower(w), "[a-z]+", 0)))
    return good.select(F.explode(terms).alias("term")).filter(F.length("term") >= 5).groupBy("term").agg(F.count("*").alias("support")).filter("support >= 20")


@query("""WITH w AS (SELECT DISTINCT doc_id, quality, regexp_extract(lower(word), '[a-z]+') AS term FROM (SELECT doc_id, quality, unnest(string_split(text, ' ')) AS word FROM documents JOIN labels USING (doc_id)))
SELECT term, count(*) FILTER (quality = 1) AS approved, count(*) FILTER (quality = 0) AS rejected FROM w WHERE length(term) >= 5 GROUP BY 1 HAVING greatest(count(*) FILTER (quality = 1), count(*) FILTER (quality = 0)) >= 3""")
def q_feature_profile_classes(t):
    """Terms of all rated documents by class, where a class has the reference's least support of 3."""
    rated = t("documents").select("doc_id", "text").join(t("labels").select("doc_id", "quality"), "doc_id")
    terms = F.array_distinct(F.transform(F.split("text", " "), lambda w: F.regexp_extract(F.lower(w), "[a-z]+", 0)))
    by = rated.select("quality", F.explode(terms).alias("term")).filter(F.length("term") >= 5).groupBy("term")
    return by.agg(F.count_if(F.col("quality") == 1).alias("approved"), F.count_if(F.col("quality") == 0).alias("rejected")).filter("greatest(approved, rejected) >= 3")
