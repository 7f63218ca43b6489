"""Official pages for notices found elsewhere: what to ask, which answer is the same notice, what it changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import procurement_terms as T
from ..functions.text import fold_text, normalize_text

OFFICIAL = ["VERIFIED_DIRECT", "VERIFIED_INSTITUTIONAL"]
TITLE_WORDS = 14  # fixed value: how much of a title a query quotes


def ladder(candidates: DataFrame, domains: list[str]) -> DataFrame:
    """``id``, ``step``, ``query``: by reference, by folded reference, by the start of the title, then on each official domain; an equal query is asked once, at its first step."""
    buyer, quoted = F.coalesce("institution", F.lit("")), lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    start = F.replace(F.array_join(F.slice(F.split(F.trim("title"), r"\s+"), 1, TITLE_WORDS), " "), F.lit('"'), F.lit(""))
    named = F.nullif(F.col("reference"), F.lit(""))
    on = lambda d, *parts: F.concat(F.lit(f"site:{d} "), F.concat_ws(" ", *parts))
    own = [F.when(named.isNotNull(), on(T.OFFICIAL_PLATFORM, quoted(named))), F.when(named.isNotNull(), on(T.OFFICIAL_PLATFORM, quoted(fold_text(named)), quoted(buyer))), on(T.OFFICIAL_PLATFORM, quoted(start), quoted(buyer))]
    more = [on(d, quoted(F.coalesce(named, start)), quoted(buyer), F.lit("consultation")) for d in domains if d != T.OFFICIAL_PLATFORM]
    return candidates.select("id", F.posexplode(F.array_distinct(F.array_compact(F.array(*own, *more)))).alias("step", "query"))


def _buyer(c: Column) -> Column:
    """Folded buyer without a leading code of ministry and service."""
    return fold_text(F.regexp_replace(F.coalesce(c, F.lit("")), r"^[A-Z0-9 ]+/[A-Z0-9 ]+\s+-\s+", ""))


def same_notice(a: Column, b: Column) -> Column:
    """Whether an answer ``b`` is the notice ``a``: buyer and reference, buyer and title, or without a buyer the reference with a title that agrees."""
    reference = fold_text(a["reference"]) == fold_text(b["reference"])
    named, bought = F.coalesce(a["reference"] != "", F.lit(False)), F.coalesce(a["institution"] != "", F.lit(False))
    mine, theirs = fold_text(a["title"]), fold_text(b["title"])
    bare = (mine == fold_text(a["reference"])) | ((F.size(F.split(theirs, " ")) >= 2) & F.contains(mine, theirs))
    return (
        F.when(named & ~bought, reference & bare)
        .when(~bought | (_buyer(a["institution"]) != _buyer(b["institution"])), False)
        .when(named, reference)
        .otherwise(normalize_text(a["title"]) == normalize_text(b["title"]))
    )


def resolve(candidates: DataFrame, answers: DataFrame) -> DataFrame:
    """``id``, ``official_url``, ``status``, ``from_answer`` of each candidate.

    ``candidates``: id, reference, institution, title, official_url, status; ``answers``: id, step, position and the
    same fields.  The first step with an official answer that is the same notice decides, a direct page before an
    institution's, then the earliest; answers of later steps do not count.  A candidate without a buyer whose answers
    name several notices stays as it is, so does one with a direct page.  Answers are aggregated per step to their best
    one and to the least and greatest notice named, so a candidate with any number of them is one row.
    """
    fields = ["reference", "institution", "title"]
    own = candidates.select("id", F.struct(*fields).alias("a"), F.col("official_url").alias("_url"), F.col("status").alias("_status"))
    pair = F.struct(*[F.coalesce(c, F.lit("")).alias(n) for n, c in (("r", F.col("reference")), ("i", F.col("institution")))])
    good = answers.filter(F.col("status").isin(OFFICIAL)).join(own, "id").filter(same_notice(F.col("a"), F.struct(*fields)))
    best = F.min_by(F.struct("official_url", "status"), F.struct((F.col("status") != OFFICIAL[0]).alias("r"), F.col("position")))
    steps = good.groupBy("id", "step").agg(best.alias("best"), F.min(pair).alias("low"), F.max(pair).alias("high"))
    first = steps.groupBy("id").agg(F.min_by(F.struct("best", "low", "high"), "step").alias("f"))
    met = own.join(first, "id", "left")
    mine = F.struct(F.coalesce("a.reference", F.lit("")).alias("r"), F.coalesce("a.institution", F.lit("")).alias("i"))
    several = (F.col("f.low") != F.col("f.high")) | ((F.col("_status") == OFFICIAL[1]) & (F.col("f.low") != mine))
    found = F.col("f").isNotNull() & (F.col("_status") != OFFICIAL[0]) & ~((F.coalesce("a.institution", F.lit("")) == "") & several)
    taken = F.coalesce(found, F.lit(False))
    return met.select("id", F.when(taken, F.col("f.best.official_url")).otherwise(F.col("_url")).alias("official_url"), F.when(taken, F.col("f.best.status")).otherwise(F.col("_status")).alias("status"), taken.alias("from_answer"))


def estimate_of_both(original: Column, official: Column) -> Column:
    """Struct (amount, verified): an official notice without an estimate takes that of the same notice elsewhere, unverified."""
    taken = official["amount"].isNull() & original["amount"].isNotNull() & same_notice(original, official)
    return F.struct(F.when(taken, original["amount"]).otherwise(official["amount"]).alias("amount"), F.when(taken, False).otherwise(official["verified"]).alias("verified"))


def reconcile(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """``row``, ``match``, ``conflict``: records that may be the candidate under a reference written otherwise.

    Both frames: reference, institution, title (candidates also ``row``, existing also ``id``).  The folded reference
    must agree, and the folded buyer, or the title where one side names no buyer.  Existing records are aggregated per
    key first, so one key of any size is one row and no pair within it is made.
    """

    def folded(df: DataFrame, name: str) -> DataFrame:
        # blank without letters or digits: no key
        keys = {c: F.nullif(fold_text(F.col(n)), F.lit("")) for c, n in (("r", "reference"), ("b", "institution"), ("t", "title"))}
        return df.select(name, *[c.alias(k) for k, c in keys.items()]).filter("r IS NOT NULL")

    e, c = folded(existing, "id"), folded(candidates, "row")
    ends = lambda where, tag: [F.min(F.when(where, F.col("id"))).alias(f"{tag}_low"), F.max(F.when(where, F.col("id"))).alias(f"{tag}_high")]
    buyers = e.filter("b IS NOT NULL").groupBy("r", "b").agg(*ends(F.lit(True), "buyer"))
    titles = e.filter("t IS NOT NULL").groupBy("r", "t").agg(*ends(F.lit(True), "any"), *ends(F.col("b").isNull(), "bare"))
    met = c.join(buyers, ["r", "b"], "left").join(titles, ["r", "t"], "left")
    pick = lambda end: F.when(F.col("b").isNull(), F.col(f"any_{end}")).otherwise(F.col(f"bare_{end}"))
    ids = met.select("row", F.least("buyer_low", pick("low")).alias("low"), F.greatest("buyer_high", pick("high")).alias("high"))
    return candidates.select("row").join(ids, "row", "left").select("row", F.when(F.col("low") == F.col("high"), F.col("low")).alias("match"), F.coalesce(F.col("low") != F.col("high"), F.lit(False)).alias("conflict"))
