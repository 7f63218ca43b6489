"""Instruments of policy: their type and legal status, parliamentary stage, and proof of publication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.text import fold_text
from ..functions.values import french_date
from .conditions import bulletin_page
from .notices import once
from .rules import first, phrase

# How an instrument's number and heading are written, words of a law's stages, the clause that puts it in force.
NUMBER = r"\p{Nd}+(?:\s*[./\-٫]\s*\p{Nd}+)+"
LAW_TITLE = rf"(?i)(?:projet de )?loi\s+n[°ºo]?\s*({NUMBER})"
NOT_ADOPTED, ADOPTED_BY_BOTH = "non adopte|pas adopte|pas encore adopte", "adopte definitivement|adopte par les deux chambres"
ADOPTED_WORD, CHAMBER_WORD, COMMITTEE_WORD = "adopte", "chambre", "commission"
SECTION_START = rf"(?im)(?=^\s*(?:projet de |avant-projet de )?(?:dahir|décret|arrêté|loi)\s+n[°ºo]?\s*{NUMBER}\b)"
SECTION_HEAD = rf"(?i)^\s*(projet de |avant-projet de )?(dahir|décret|arrêté|loi)\s+n[°ºo]?\s*({NUMBER})\b"
PROMULGATED_LAW = rf"(?i)promulgation de la loi\s+n[°ºo]?\s*({NUMBER})"
IN_FORCE_CLAUSE = r"(?i)(?:la présente loi|le présent décret|le présent arrêté)\s+entre(?:ra)?\s+en vigueur\s+(?:à compter du|le)\s+([^.\n]{5,60})"


def reference(c: Column) -> Column:
    """An instrument's number in one form: digits of any script as ASCII, separators as dots, no spaces."""
    digits = F.translate(F.coalesce(c, F.lit("")), "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹०१२३४५६७८९０１２３４５６７８９", "0123456789" * 4)
    return F.regexp_replace(F.regexp_replace(digits, r"[./\-٫]", "."), r"\s+", "")


def classify(title: Column, evidence: Column) -> Column:
    """Struct (type, status) of an instrument; null outside the scope.

    The named instrument has the type, whatever law it cites; a status counts only before such a citation, and a denial
    goes before what it denies.
    """

    def texts(_: Column) -> Column:
        head = fold_text(title)
        return F.struct(head.alias("head"), F.trim(F.concat_ws(" ", head, fold_text(evidence))).alias("all"))

    def typed(t: Column) -> Column:
        own = F.regexp_extract(t["head"], r"^(?:projet de |avant projet de )?(decret|arrete|circulaire)\b", 1)
        kind = first([("DECREE", own == "decret"), ("ORDER", own == "arrete"), ("CIRCULAR", own == "circulaire")])
        for text in (t["head"], t["all"]):
            kind = F.coalesce(kind, first([(name, phrase(text, terms)) for name, terms in L.POLICY_TYPES]))
        own_words = F.get(F.split(t["all"], r"\b(?:" + "|".join(L.POLICY_CITATIONS) + r")\b", 2), F.lit(0))
        return F.struct(t["head"].alias("head"), t["all"].alias("all"), own_words.alias("own"), kind.alias("kind"))

    def judged(t: Column) -> Column:
        head, every, own, kind = t["head"], t["all"], t["own"], t["kind"]
        inside = phrase(every, L.POLICY_SCOPE) & ~phrase(every, L.POLICY_OTHER) & (~phrase(every, L.POLICY_TENDER) | (kind == "PUBLIC_CONSULTATION"))
        status = first([
            ("PUBLIC_CONSULTATION", (kind == "DRAFT_LAW") & phrase(every, L.POLICY_CONSULTED)), ("DRAFT", kind == "DRAFT_LAW"),
            ("UNDER_PREPARATION", phrase(head, L.POLICY_DRAFT_TITLES)), ("PUBLIC_CONSULTATION", kind == "PUBLIC_CONSULTATION"),
            ("POLICY_SIGNAL", phrase(own, L.POLICY_DENIED)), ("IN_FORCE", phrase(own, L.POLICY_IN_FORCE)), ("ADOPTED", phrase(own, L.POLICY_ADOPTED)),
            ("IMPLEMENTATION", phrase(every, L.POLICY_APPLIED)), ("UNDER_PREPARATION", phrase(every, L.POLICY_PREPARED)),
        ], "POLICY_SIGNAL")
        loose = kind.isin("STRATEGY", "PROGRAM", "PUBLIC_STUDY", "POLICY_STUDY")  # these are never in force; news of them is an announcement
        weak = F.when(loose & (status == "IN_FORCE"), "POLICY_SIGNAL").otherwise(status)
        final = F.when(loose & (weak == "POLICY_SIGNAL") & phrase(every, L.POLICY_ANNOUNCED), "ANNOUNCED").otherwise(weak)
        return F.when(inside & kind.isNotNull(), F.struct(kind.alias("type"), final.alias("status")))

    return once(once(once(F.lit(0), texts), typed), judged)


def stage(title: Column, text: Column) -> Column:
    """Struct (reference, stage) of a law before parliament; null where the title names none. A vote of one chamber is no adoption."""
    number = F.regexp_extract(title, LAW_TITLE, 1)
    t = fold_text(text)
    at = first([
        ("PRESENTED", t.rlike(NOT_ADOPTED)), ("PARLIAMENT_ADOPTED", t.rlike(ADOPTED_BY_BOTH)),
        ("CHAMBER_ADOPTED", F.contains(t, F.lit(ADOPTED_WORD)) & F.contains(t, F.lit(CHAMBER_WORD))), ("COMMITTEE", F.contains(t, F.lit(COMMITTEE_WORD))),
    ], "PRESENTED")
    return F.when((number != "") & (t != ""), F.struct(reference(number).alias("reference"), at.alias("stage")))


def sections(bulletins: DataFrame, drafts: bool = False) -> DataFrame:
    """Instruments of bulletins (url, text, ...): adds section, reference, document_type, heading, body.

    A heading stands on a line of its own.  A decree that promulgates a law is that law.
    """
    parts = bulletins.select("*", F.posexplode(F.split("text", SECTION_START)).alias("section", "body"))
    found = lambda group: F.regexp_extract("body", SECTION_HEAD, group)
    kind = F.lower(found(2))
    heading = F.trim(F.regexp_replace(F.substring("body", 1, 1400), r"\s+", " "))
    law = F.regexp_extract(heading, PROMULGATED_LAW, 1)
    own = F.when(kind == "dahir", law).otherwise(found(3))
    typed = F.when(kind.isin("dahir", "loi"), "LAW").when(kind == "décret", "DECREE").when(kind == "arrêté", "ORDER")
    kept = parts.withColumns({"document_type": typed, "reference": reference(own), "heading": heading, "draft": found(1) != ""}).filter("document_type IS NOT NULL AND reference <> ''")
    return kept.drop("text", "draft") if drafts else kept.filter("NOT draft").drop("text", "draft")


# The Arabic formula that orders a law's publication, what stands beside it, and how far it reaches.
PROMULGATED, LAW_LABEL, HERITAGE_SUBJECT = r"ينفذ\s+وينشر\s+بالجريدة\s+الرسمية", "القانون رقم", "بحماية التراث"
PROMULGATION, BULLETIN_HEAD = 450, 12000


def arabic_sections(bulletins: DataFrame, registry: DataFrame) -> DataFrame:
    """Promulgations of registered laws in Arabic bulletins: key, url, section, reference, document_type, heading, body.

    ``bulletins``: key, url, text; ``registry``: key, reference, number (of the bulletin), title, a few rows.  A bulletin
    counts only where its registered number stands in its first pages, so another one under the same address gives
    nothing; the formula, the law's number, its label and its subject must stand together.
    """
    known = bulletins.join(registry, "key")
    own = known.filter(F.regexp_like(F.left("text", F.lit(BULLETIN_HEAD)), F.concat(F.lit(r"(?<!\d)"), F.col("number"), F.lit(r"(?!\d)"))))
    blocks = F.regexp_extract_all("text", F.lit(rf"(?sU)(?=({PROMULGATED}.{{0,{PROMULGATION}}}))"), F.lit(1))
    said = own.select("key", "url", "reference", F.col("title").alias("heading"), F.posexplode(blocks).alias("section", "block")).withColumn("body", F.left("block", F.lit(PROMULGATION)))
    numbers = F.transform(F.regexp_extract_all("body", F.lit(f"({NUMBER})"), F.lit(1)), reference)
    good = F.array_contains(numbers, F.col("reference")) & F.contains("body", F.lit(LAW_LABEL)) & F.contains("body", F.lit(HERITAGE_SUBJECT))
    return said.filter(good).select("key", "url", "section", "reference", F.lit("LAW").alias("document_type"), "heading", "body")


def proofs(candidates: DataFrame, bulletins: DataFrame, as_of: Column) -> DataFrame:
    """``id``, ``status`` (PUBLISHED, IN_FORCE or null), ``effective``, ``url``: the first section of an official bulletin that is the candidate's instrument.

    An equality join on number and type; of several sections the first by bulletin and place counts.
    """
    official = sections(bulletins.filter(bulletin_page(F.col("url")))).select("reference", "document_type", "position", "section", "url", "body")
    clause = F.regexp_extract("body", IN_FORCE_CLAUSE, 1)
    wanted = candidates.select("id", reference(F.col("reference_number")).alias("reference"), F.when(F.col("document_type") == "DRAFT_LAW", "LAW").otherwise(F.col("document_type")).alias("document_type"))
    met = wanted.filter("reference <> ''").join(official.withColumn("effective", french_date(clause)), ["reference", "document_type"])
    best = met.groupBy("id").agg(F.min_by(F.struct("effective", "url"), F.struct("position", "section")).alias("p"))
    found = candidates.select("id").join(best, "id", "left")
    return found.select("id", F.when(F.col("p.effective") <= as_of, "IN_FORCE").when(F.col("p").isNotNull(), "PUBLISHED").alias("status"), F.col("p.effective").alias("effective"), F.col("p.url").alias("url"))


def published(rows: DataFrame, proven: DataFrame) -> DataFrame:
    """Candidates with their proof applied: status raised to what is proven, and ``publication_check`` says whether it was."""
    p = proven.select("id", F.col("status").alias("_status"), "effective", F.col("url").alias("status_url"))
    checked = F.when(F.col("_status").isNull(), "NOT_FOUND_IN_CHECKED_BULLETINS").otherwise("VERIFIED")
    return rows.join(p, "id", "left").withColumns({"publication_check": checked, "status": F.coalesce("_status", "status")}).drop("_status")


def newest(bulletins: DataFrame, per: str, most: int = 2) -> DataFrame:
    """The newest bulletins of each edition, by their time in milliseconds."""
    rank = F.row_number().over(Window.partitionBy(per).orderBy(F.desc_nulls_last("at_ms"), "url"))
    return bulletins.withColumn("_rank", rank).filter(F.col("_rank") <= most).drop("_rank").withColumn("day", F.to_date(F.timestamp_millis("at_ms")))
