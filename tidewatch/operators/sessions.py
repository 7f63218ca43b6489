"""Targeted sessions: hits of a brief against known records, decisions of users, versions of briefs, histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.text import fold_text
from .conditions import in_range
from .rules import targeted_score

LEAST_SCORE = 45
DECISIONS = ["PERTINENT", "REJECTED", "TOO_BROAD", "TOO_NARROW", "WRONG_LOCATION", "WRONG_DATE", "WRONG_TYPE"]  # fixed values; the first two decide


def ingest(hits: DataFrame, existing: DataFrame, links: DataFrame, brief: dict) -> DataFrame:
    """``hit``, ``outcome`` (new, known, updated, rejected), ``url``, ``score``, ``fingerprint``, ``pending``.

    ``hits``: hit (order of arrival), title, evidence, institution, location, url, day, status, official; ``existing``:
    id, url; ``links`` of the session: url, fingerprint, review; ``brief``: wanted, excluded, places (folded terms),
    since, until, archive, open_only.  Rejected: a low score, a day outside the range, over where open ones are wished,
    no address.  The hits of one address follow one another: the first is new where no record has the address, a later
    one updates what its predecessor said.
    """
    said = fold_text(F.concat_ws(" ", "title", "evidence", "institution", "location"))
    score = targeted_score(said, brief["wanted"], brief["excluded"], brief["places"], F.coalesce("official", F.lit(False)))
    timely = in_range(F.col("day"), F.lit(brief["since"]).cast("date"), F.lit(brief["until"]).cast("date"), F.lit(False))
    over = F.coalesce(F.lower("status").isin("closed", "expired"), F.lit(False)) & F.lit(brief["open_only"] and not brief["archive"])
    url = urls.canonical_url(F.col("url"))
    # blanks and case of the title do not make another version, a word of the evidence does
    print_ = urls.key_digest(fold_text(F.col("title")), F.coalesce("evidence", F.lit("")))
    judged = hits.select("hit", url.alias("url"), score.cast("int").alias("score"), print_.alias("fingerprint"), ((score >= LEAST_SCORE) & timely & ~over & url.isNotNull()).alias("good"))
    good = judged.filter("good")
    known = existing.select(urls.canonical_url(F.col("url")).alias("url")).filter("url IS NOT NULL").distinct().withColumn("held", F.lit(True))
    before = links.groupBy("url").agg(F.max_by(F.struct(F.col("fingerprint").alias("f"), F.col("review").alias("v")), "fingerprint").alias("l"))
    met = good.join(known, "url", "left").join(before, "url", "left")
    previous = F.coalesce(F.lag("fingerprint").over(Window.partitionBy("url").orderBy("hit")), F.col("l.f"))
    outcome = F.when(previous.isNull(), F.when(F.col("held"), "known").otherwise("new")).when(previous != F.col("fingerprint"), "updated").otherwise("known")
    out = met.select("hit", outcome.alias("outcome"), "url", "score", "fingerprint", (F.coalesce("l.v", F.lit("PENDING")) == "PENDING").alias("pending"))
    rest = judged.filter(~F.coalesce("good", F.lit(False))).select("hit", F.lit("rejected").alias("outcome"), "url", "score", "fingerprint", F.lit(False).alias("pending"))
    return out.unionByName(rest)


def counts(outcomes: DataFrame) -> DataFrame:
    """One row: hits by outcome, and how many wait for a person."""
    n = [F.count_if(F.col("outcome") == o).alias(o) for o in ("new", "known", "updated", "rejected")]
    return outcomes.agg(*n, F.count_if("pending").alias("pending"))


def decide(links: DataFrame, feedback: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links with their review, refused feedback with a reason).

    ``links``: session, result, review; ``feedback``: session, result, decision, at.  Only the last PERTINENT or
    REJECTED changes a review, the other decisions are remembered.
    """
    keys = ["session", "result"]
    met = feedback.join(links.select(*keys, F.lit(True).alias("_held")), keys, "left")
    reason = F.when(~F.coalesce(F.col("decision").isin(DECISIONS), F.lit(False)), "unknown_decision").when(F.col("_held").isNull(), "unknown_result")
    judged = met.withColumn("reason", reason).drop("_held")
    last = judged.filter(F.col("reason").isNull() & F.col("decision").isin(DECISIONS[:2])).groupBy(*keys).agg(F.max_by("decision", F.struct("at", "decision")).alias("_last"))
    return links.join(last, keys, "left").withColumn("review", F.coalesce("_last", "review")).drop("_last"), judged.filter("reason IS NOT NULL")


def transit(sessions: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sessions after the requests, outcome per request): refine, reserve, cancel, complete, by compare and set.

    ``sessions``: session, version, status; ``requests``: request (order), session, version, kind.  Each session serves
    its first request, the others come back as ``again`` for the next batch.  A version other than the present one is
    ``stale``; refine needs a session that does not run, reserve likewise, cancel a draft, complete one that runs.
    """
    first = F.row_number().over(Window.partitionBy("session").orderBy("request")) == 1
    met = requests.withColumn("_first", first).join(sessions.select("session", F.col("version").alias("_v"), F.col("status").alias("_s")), "session", "left")
    free = {"refine": F.col("_s") != "RUNNING", "reserve": F.col("_s") != "RUNNING", "cancel": F.col("_s") == "DRAFT", "complete": F.col("_s") == "RUNNING"}
    may = F.lit(False)
    for kind, ok in free.items():
        may = may | ((F.col("kind") == kind) & ok)
    outcome = F.when(F.col("_v").isNull(), "unknown").when(~F.col("_first"), "again").when(F.col("version") != F.col("_v"), "stale").when(F.coalesce(may, F.lit(False)), "done").otherwise("refused")
    judged = met.withColumn("outcome", outcome)
    done = judged.filter("outcome = 'done'").select("session", "kind")
    after = F.create_map(*[F.lit(x) for x in ("refine", "DRAFT", "reserve", "RUNNING", "cancel", "CANCELLED", "complete", "COMPLETED")])
    out = sessions.join(done, "session", "left")
    out = out.withColumns({"version": F.col("version") + F.coalesce(F.col("kind") == "refine", F.lit(False)).cast("int"), "status": F.coalesce(F.try_element_at(after, F.col("kind")), "status")}).drop("kind")
    return out, judged.select("request", "outcome")


def waiting(sessions: DataFrame, links: DataFrame, most: int = 20) -> DataFrame:
    """The sessions last changed that have results to review, with how many."""
    n = links.filter("review = 'PENDING'").groupBy("session").agg(F.count("*").alias("n"))
    return sessions.join(n, "session").orderBy(F.desc("updated_at"), "session").limit(most)


def history(sessions: DataFrame, most: int = 20) -> DataFrame:
    return sessions.orderBy(F.desc("updated_at"), "session").limit(most)


def query_text(b: Column) -> Column:
    """The question a brief asks: up to eight wanted terms, places, documents, its range."""
    places = F.when(F.size(b["aliases"]) > 0, b["aliases"]).otherwise(b["places"])
    said = F.concat(F.slice(b["wanted"], 1, 8), F.coalesce(places, F.array().cast("array<string>")), b["documents"], F.array(b["since"].cast("string"), b["until"].cast("string")))
    return F.concat(F.lit("Targeted professional research: "), F.array_join(F.filter(said, lambda x: x != ""), "; "))


def payload(links: DataFrame, results: DataFrame, names: dict[str, str]) -> DataFrame:
    """What a card of a session shows: the link, its record, where it comes from; a day that is not known is a dash."""
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    origin = F.when(F.coalesce("targeted_only", F.lit(False)), "targeted").otherwise(F.coalesce(F.try_element_at(known, F.col("collection")), "collection"))
    day = lambda c: F.coalesce(F.col(c).cast("date").cast("string"), F.lit("—")).alias(c)
    return links.join(results, "result").select("session", "result", "title", "url", day("published"), day("deadline"), "match", "review", origin.alias("origin"), "score")
