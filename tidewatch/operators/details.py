"""A record's own page: what its text proves, which documents it offers, what it adds; lists of projects and runs of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.text import fold_text
from . import procurement
from .notices import notice_text
from .rules import first, project_signal

# fixed values: names of tender documents, headings of lists, closing words, how a notice's number is written, sizes
DOCUMENTS = r"\b(dce|cps|rc|bpu|dqe|annexes|plans)\b|dossier de consultation|reglement (?:du |de )?concours"
DOCUMENT_LINK = r"\b(dce|cps|rc|bpu|dqe|plans|annexes)\b|dossier|reglement.*concours"
DOCUMENT_FILE = r"(?i)\.(zip|pdf)(\?|$)"
FORM_WORDS = ["identification", "renseigner", "formulaire"]
LIST_HEADINGS = ["appels d offres", "marches publics", "consultations", "avis d appels d offres"]
CLOSED = r"\b(annule|attribue|cloture)\b"
NOTICE_NUMBER = r"(?i)\b([A-Z0-9-]*\d+[A-Z0-9-]*(?:/[A-Z0-9-]+){1,4})\b"
SIZE = r"(?i)\b(\d+(?:[.,]\d+)?\s*(?:Mo|Ko|MB|KB))\b"
LEAST_BLOCK = 25


def documents(text: Column, links: Column, base: Column, has_form: Column) -> Column:
    """Struct (available, size, access, url) of the tender documents a page offers.  ``links``: array of (href, label).

    A form stands before any link; without one the first link to a document file is given.
    """
    said = fold_text(text)
    named = said.rlike(DOCUMENTS)
    files = F.filter(links, lambda x: x["href"].rlike(DOCUMENT_FILE) & fold_text(F.concat_ws(" ", x["label"], x["href"])).rlike(DOCUMENT_LINK))
    form = named & (F.coalesce(has_form, F.lit(False)) | said.rlike("|".join(FORM_WORDS)))
    some = F.coalesce(F.size(files) > 0, F.lit(False))
    url = urls.resolved(base, F.get(files, F.lit(0))["href"])
    return F.struct(
        (named | some).alias("available"), F.nullif(F.regexp_extract(text, SIZE, 1), F.lit("")).alias("size"),
        first([("FORM_REQUIRED", form), ("DIRECT_DOWNLOAD", some), ("ATTACHMENT_AVAILABLE", named)], "NOT_FOUND").alias("access"),
        F.when(some & ~form & urls.scheme(url).isin("http", "https"), url).alias("url"),
    )


def unproven(r: Column) -> Column:
    """Why a page does not prove a notice, null if it does.  ``r``: title, reference, institution, deadline, url, text, rows, headings.

    Number, title, buyer and deadline must stand in the text; several numbers or a list's heading make a container,
    unless the address itself names one consultation.
    """
    text = notice_text(r["text"])
    stands = lambda c: F.coalesce(F.contains(text, notice_text(c)) & (notice_text(c) != ""), F.lit(False))
    numbers = F.array_distinct(F.flatten(F.transform(r["rows"], lambda x: F.regexp_extract_all(x, F.lit(NOTICE_NUMBER), F.lit(1)))))
    several = F.coalesce(F.size(F.filter(numbers, lambda x: ~x.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"))) > 1, F.lit(False))
    listed = F.coalesce(F.exists(r["headings"], lambda x: fold_text(x).isin(LIST_HEADINGS)), F.lit(False))
    dated = F.exists(F.array(*[F.date_format(r["deadline"], f) for f in ("yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy")]), lambda d: stands(d))
    whole = procurement.notice_page(r["url"]) & ~procurement.list_title(F.array_join(r["headings"], " "))
    good = whole & stands(F.coalesce(F.nullif(r["reference"], F.lit("")), r["title"])) & stands(r["title"]) & stands(r["institution"]) & F.coalesce(dated, F.lit(False))
    return first([("container", ~procurement.direct_notice(r["url"]) & (several | listed)), ("not_verified", ~F.coalesce(good, F.lit(False))), ("closed", text.rlike(CLOSED))])


def enriched(candidates: DataFrame, details: DataFrame, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """(candidates with the facts of their pages; refused: id, reason).

    Both frames have id, reference and ``fields``; ``details`` also url.  A page that is none of one notice, or names
    another reference, changes nothing.  What the page says goes before what was found elsewhere.
    """
    d = details.select("id", F.col("url").alias("_url"), F.col("reference").alias("_reference"), *[F.col(f).alias(f"_{f}") for f in fields])
    met = candidates.join(d, "id", "left")
    other = F.coalesce((fold_text(F.col("reference")) != fold_text(F.col("_reference"))) & (F.col("reference") != "") & (F.col("_reference") != ""), F.lit(False))
    reason = F.when(F.col("_url").isNotNull(), first([("not_detail_page", ~procurement.notice_page(F.col("_url"))), ("detail_reference_mismatch", other)]))
    judged = met.withColumn("_reason", reason)
    use = F.col("_url").isNotNull() & F.col("_reason").isNull()
    taken = {f: F.coalesce(F.when(use, F.col(f"_{f}")), F.col(f)) for f in ["reference", *fields]}
    out = judged.withColumns(taken | {"official_url": F.when(use, F.col("_url")), "confirmed": use})
    return out.select(*candidates.columns, "official_url", "confirmed"), judged.filter("_reason IS NOT NULL").select("id", F.col("_reason").alias("reason"))


def project_blocks(rows: DataFrame, as_of: Column) -> DataFrame:
    """``id``, ``block``, ``text``: a text that lists several projects gives one row per line that tells of one, any other is one row."""
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), r"[\r\n]+"), lambda x: F.btrim(x, F.lit(" \t-*•"))), lambda x: F.length(x) >= LEAST_BLOCK)
    good = F.filter(lines, lambda x: project_signal(x, F.col("published"), as_of)["signal"].isNotNull())
    return rows.select("id", "text", good.alias("good")).select("id", F.posexplode(F.when(F.size("good") >= 2, F.col("good")).otherwise(F.array(F.coalesce("text", F.lit(""))))).alias("block", "text"))


def first_keys(kind: str) -> dict[str, Column]:
    """What makes two observations of a collection the same one: keys by name, for ``identity.first_wins_any``.

    Blank parts make no key of a reference or address.
    """
    f = lambda c: fold_text(F.col(c))
    if kind == "policy":
        return {"text": F.coalesce(F.nullif(f("reference"), F.lit("")), F.nullif(f("title"), F.lit("")))}
    if kind == "funding":
        return {"program": F.concat_ws("|", f("program"), f("funder"))}
    if kind == "institution":
        who = F.coalesce(F.nullif(f("person"), F.lit("")), f("institution"))
        site = urls.host(F.coalesce(F.nullif(F.col("site"), F.lit("")), F.col("url")))
        return {"holder": F.concat_ws("|", who, f("institution"), site), "page": F.when(F.nullif(f("person"), F.lit("")).isNull(), F.col("url"))}
    raise ValueError(kind)


def run_sources(fetched: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items of changed sources, counts in one row, health per source); ``fetched``: source, state."""
    n = lambda *states: F.count_if(F.col("state").isin(*states))
    counts = fetched.agg(F.count("*").alias("requests"), n("NOT_MODIFIED").alias("not_modified"), n("CHANGED").alias("changed"), n("UNCHANGED", "NOT_MODIFIED").alias("unchanged"))
    health = fetched.select("source", F.when(F.col("state").isin("CHANGED", "UNCHANGED", "NOT_MODIFIED"), "HEALTHY").otherwise(F.col("state")).alias("health"))
    return items.join(fetched.filter("state = 'CHANGED'").select("source"), "source", "left_semi"), counts, health
