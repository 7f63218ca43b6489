"""Result pages of the procurement board: listings, facts of a page, and where a walk through the pages ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import content_digest, listing_identity
from ..functions.text import normalize_text
from ..operators.notices import once
from ..operators.procurement import canonical_detail
from .pages import plain

# fixed values: how the board's pages name their parts
FIELD = 'id="ctl0_CONTENU_PAGE_resultSearch_tableauResultSearch_ctl'
ROW = r'name="ctl0\$CONTENU_PAGE\$resultSearch\$tableauResultSearch\$ctl(\d+)\${0}"[^>]*value="({1})"'
PAGES = r'id="ctl0_CONTENU_PAGE_resultSearch_nombrePageTop"[^>]*>\s*(\d+)'
RESULTS = r'id="ctl0_CONTENU_PAGE_resultSearch_nombreElement"[^>]*>\s*(\d+)'
STATE = r'name="PRADO_PAGESTATE"[^>]*value="([^"]+)"'
NEXT = "javascript:;//ctl0_CONTENU_PAGE_resultSearch_PagerTop_ctl2"
DAY = r"\b(\d{2}/\d{2}/\d{4})(?:\s+(\d{2}:\d{2}))?\b"
KIND = r"(?i)\b(Travaux|Services|Fournitures)\b"
DETAIL = "https://www.marchespublics.gov.ma/index.php?page=entreprise.EntrepriseDetailsConsultation&refConsultation="
LONGEST = 4000
LISTING = ["consultation", "organisation", "reference", "title", "buyer", "publication", "deadline", "procedure", "category", "location", "detail_url"]


def _clean(c: Column) -> Column:
    """Without spaces and colons at the ends; empty is null."""
    return F.nullif(F.btrim(F.coalesce(c, F.lit("")), F.lit(" :")), F.lit(""))


def _after(c: Column, label: str) -> Column:
    """What follows a label; a text without it stays."""
    return once(_clean(c), lambda t: F.when(F.startswith(normalize_text(t), F.lit(label)), _clean(F.substr(t, F.lit(len(label) + 1)))).otherwise(t))


def _day(c: Column) -> Column:
    return F.nullif(F.concat_ws(" ", F.nullif(F.regexp_extract(c, DAY, 1), F.lit("")), F.nullif(F.regexp_extract(c, DAY, 2), F.lit(""))), F.lit(""))


def _kind(c: Column) -> Column:
    return F.nullif(F.initcap(F.regexp_extract(c, KIND, 1)), F.lit(""))


def _procedure(c: Column, category: Column) -> Column:
    """The wording before the category, without days."""
    at = F.coalesce(F.instr(F.lower(c), F.lower(category)), F.lit(0))
    head = F.when(at > 0, F.substr(c, F.lit(1), at - 1)).otherwise(c)
    return _clean(F.regexp_replace(F.regexp_replace(head, DAY, ""), r"\s+", " "))


def listings(pages: DataFrame) -> DataFrame:
    """``crawl``, ``page``, ``n`` and the fields of each listing; ``pages``: crawl, page, html.

    A page is cut at its field marks once; each listing looks into its own fields only.  Number 0 is the table's
    head.  A publication equal to the deadline is none.
    """
    html = F.coalesce("html", F.lit(""))
    pieces = F.slice(F.split(html, r"\Q" + FIELD + r"\E"), 2, 2**31 - 2)

    def field(x: Column, i: Column) -> Column:
        body = F.when(F.contains(x, F.lit(">")), F.regexp_replace(x, r"(?s)^[^>]*>", "")).otherwise("")
        ended = F.when(i == F.size(pieces) - 1, F.substring(body, 1, LONGEST)).otherwise(F.regexp_replace(body, r"(?s)<[^<]*$", ""))
        return F.struct(F.regexp_extract(x, r'^(\d+)_\w+"', 1).alias("n"), F.regexp_extract(x, r'^\d+_(\w+)"', 1).alias("name"), plain(ended).alias("text"))

    ids, orgs = (ROW.format(name, value) for name, value in (("refCons", r"\d+"), ("orgCons", "[A-Za-z0-9]+")))
    pairs = lambda p: F.arrays_zip(F.regexp_extract_all(html, F.lit(p), F.lit(1)), F.regexp_extract_all(html, F.lit(p), F.lit(2)))
    cut = pages.select("crawl", "page", F.transform(pieces, field).alias("fields"), pairs(ids).alias("rows"), pairs(orgs).alias("orgs"))
    # arrays_zip names its fields by position
    one = cut.select("crawl", "page", "orgs", "fields", F.explode("rows").alias("row"))
    number, value = F.col("row")["0"], F.col("row")["1"]
    own = one.filter(number.cast("int") > 0).select(
        "crawl", "page", number.alias("n"), value.alias("consultation"),
        F.try_element_at(F.filter("orgs", lambda o: o["0"] == number), F.lit(-1))["1"].alias("organisation"),
        F.filter("fields", lambda f: f["n"] == number).alias("f"),
    )
    said = lambda name: F.coalesce(F.get(F.filter("f", lambda f: f["name"] == name), F.lit(0))["text"], F.lit(""))
    kind, step = said("panelBlocCategorie"), said("panelBlocTypesProc")
    category = F.coalesce(_kind(kind), _kind(step))
    deadline = _day(said("infosLieuExecutionLtRef"))
    url = canonical_detail(F.concat(F.lit(DETAIL), F.col("consultation"), F.lit("&orgAcronyme="), F.col("organisation")))
    return own.select(
        "crawl", "page", F.col("n").cast("int").alias("n"), "consultation", "organisation", _clean(said("reference")).alias("reference"),
        F.coalesce(_after(said("panelBlocObjet"), "objet"), _after(said("infosBullesObjet"), "objet")).alias("title"), _after(said("panelBlocDenomination"), "acheteur public").alias("buyer"),
        F.coalesce(_day(kind), _day(step)).alias("publication"), deadline.alias("deadline"), _procedure(step, category).alias("procedure"), category.alias("category"),
        _clean(F.regexp_extract(said("infosLieuExecution"), r"(?s)^(.*?)(?:\.\.\.|$)", 1)).alias("location"), url.alias("detail_url"),
    ).withColumn("publication", F.when(~F.col("publication").eqNullSafe(F.col("deadline")), F.col("publication")))


def facts(pages: DataFrame) -> DataFrame:
    """``crawl``, ``page``, declared pages and results, whether a next page is named, the page's state token and signature."""
    html = F.coalesce("html", F.lit(""))
    number = lambda p: F.nullif(F.regexp_extract(html, p, 1), F.lit("")).cast("long")
    p = ROW.format("refCons", r"\d+")
    parts = F.arrays_zip(F.regexp_extract_all(html, F.lit(p), F.lit(1)), F.regexp_extract_all(html, F.lit(p), F.lit(2)))
    return pages.select(
        "crawl", "page", number(PAGES).alias("declared_pages"), number(RESULTS).alias("declared_results"), F.contains(html, F.lit(NEXT)).alias("has_next"),
        F.nullif(F.regexp_extract(html, STATE, 1), F.lit("")).alias("state"), F.array_join(F.transform(parts, lambda x: F.concat(x["0"], F.lit(":"), x["1"])), "|").alias("signature"),
    )


def walk(pages: DataFrame, known: DataFrame, overlap: int | None = None, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(observations: crawl, page, n, identity, digest, class; ends: crawl, pages, stop).

    ``known``: identity, digest of earlier crawls.  A listing seen before in its crawl is DUPLICATE, else NEW, UPDATED
    or UNCHANGED.  A crawl ends before a page whose signature came before; at the ``overlap``-th page in a row without
    a change; at an empty page that names no next; at the ``most``-th page; at the last one named or declared.  The
    pages' texts take part in no shuffle, only what was read from them.
    """
    found = listings(pages)
    rows = found.select(
        "crawl", "page", "n", F.coalesce(listing_identity(*[F.col(c) for c in ("consultation", "organisation", "detail_url", "reference", "buyer")]), F.concat_ws(":", "crawl", "page", "n")).alias("identity"),
        content_digest({c: F.col(c) for c in LISTING}).alias("digest"),
    )
    seen = rows.withColumn("_again", F.row_number().over(Window.partitionBy("crawl", "identity").orderBy("page", "n")) > 1)
    old = known.groupBy("identity").agg(F.max("digest").alias("_digest"))
    kind = F.when(F.col("_again"), "DUPLICATE").when(F.col("_digest").isNull(), "NEW").when(F.col("_digest") != F.col("digest"), "UPDATED").otherwise("UNCHANGED")
    classed = seen.join(old, "identity", "left").select("crawl", "page", "n", "identity", "digest", kind.alias("class"))
    per_page = classed.groupBy("crawl", "page").agg(F.count("*").alias("rows"), F.count_if(F.col("class").isin("NEW", "UPDATED")).alias("changed"))
    met = facts(pages).join(per_page, ["crawl", "page"], "left").fillna(0, ["rows", "changed"])
    w = Window.partitionBy("crawl").orderBy("page")
    reset = ((F.col("changed") > 0) | (F.col("rows") == 0)).cast("int")
    met = met.withColumns({
        "_at": F.row_number().over(w), "_run": F.sum(reset).over(w), "_declared": F.last("declared_pages", ignorenulls=True).over(w),
        "_loop": F.row_number().over(Window.partitionBy("crawl", "signature").orderBy("page")) > 1,
    }).withColumn("_streak", F.sum(1 - reset).over(Window.partitionBy("crawl", "_run").orderBy("page")))
    why = F.when(F.col("_loop"), "pagination_loop")
    if overlap is not None:
        why = why.when((F.col("rows") > 0) & (F.col("_streak") >= overlap), "incremental_overlap")
    why = why.when((F.col("rows") == 0) & ~F.col("has_next"), "empty_page")
    if most is not None:
        why = why.when(F.col("_at") >= most, "max_pages")
    why = why.when(~F.col("has_next") | F.coalesce(F.col("page") >= F.col("_declared"), F.lit(False)), "final_page")
    # a loop is known once its page is there, which then does not count
    ended = met.withColumn("stop", why).groupBy("crawl").agg(F.min_by(F.struct("page", "stop", "_at"), F.when(F.col("stop").isNotNull(), F.col("page"))).alias("e"), F.max(F.struct("page", "_at")).alias("l"))
    looped = F.col("e.stop") == "pagination_loop"
    last = ended.select("crawl", F.coalesce(F.when(looped, F.col("e.page") - 1).otherwise(F.col("e.page")), F.col("l.page")).alias("last"), F.coalesce(F.when(looped, F.col("e._at") - 1).otherwise(F.col("e._at")), F.col("l._at")).cast("long").alias("pages"), F.coalesce("e.stop", F.lit("final_page")).alias("stop"))
    return classed.join(last.select("crawl", "last"), "crawl").filter("page <= last").drop("last"), last.drop("last")


def refresh(pages: DataFrame, known: DataFrame, checkpoint: dict, front: int, deep: int, overlap: int = 2) -> tuple[DataFrame, DataFrame]:
    """(observations of both segments, next checkpoint: cursor, cycle_pages, cycle_new, cycle_updated, cycle_unchanged, complete, stop).

    ``pages``: page, html; ``checkpoint``: the last one as a dict.  The front segment reads from page 1 until nothing
    changes, the deep one goes on from the cursor.  Only the deep one moves the cursor; when it reaches the last page
    the cycle is complete and its counters begin anew.
    """
    cursor = checkpoint.get("cursor", 0)
    parts = [pages.filter(F.col("page") <= front).withColumn("crawl", F.lit("front")), pages.filter((F.col("page") > cursor) & (F.col("page") <= cursor + deep)).withColumn("crawl", F.lit("deep"))]
    (a, ends_a), (b, ends_b) = walk(parts[0], known, overlap, front), walk(parts[1], known, None, deep)
    seen, ends = a.unionByName(b), ends_a.unionByName(ends_b)
    counted = seen.agg(*[F.count_if(F.col("class") == c).alias(c.lower()) for c in ("NEW", "UPDATED", "UNCHANGED")])
    mine = lambda c: F.max(F.when(F.col("crawl") == "deep", F.col(c)))
    walked = ends.agg(F.coalesce(F.sum("pages"), F.lit(0)).alias("pages"), F.coalesce(mine("pages"), F.lit(0)).alias("deep"), F.coalesce(mine("stop"), F.max("stop"), F.lit("empty_page")).alias("stop"))
    done = F.col("stop").isin("final_page", "empty_page")
    add = lambda name, c: F.when(done, 0).otherwise(F.col(c) + checkpoint.get(name, 0)).cast("long").alias(name)
    state = walked.join(F.broadcast(counted)).select(
        F.when(done, 0).otherwise(F.col("deep") + cursor).cast("long").alias("cursor"), add("cycle_pages", "pages"), add("cycle_new", "new"), add("cycle_updated", "updated"),
        add("cycle_unchanged", "unchanged"), done.alias("complete"), "stop",
    )
    return seen, state
