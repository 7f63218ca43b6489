"""Records from raw pages: title, heading, links; pages that give no record go to a quarantine frame with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import canonical_url
from .markup import tokenized

ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}  # fixed values; & last


def plain(markup: Column) -> Column:
    """Text of markup: tags to spaces, common entities resolved, white space collapsed."""
    t = F.regexp_replace(markup, "<[^>]*>", " ")
    for code, char in ENTITIES.items():
        t = F.replace(t, F.lit(code), F.lit(char))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def visible(html: Column) -> Column:
    """Text of a page without scripts, styles, comments and the head."""
    return plain(F.regexp_replace(html, r"(?is)<(script|style|head|noscript)\b.*?</\1\s*>|<!--.*?-->", " "))


def links(html: Column) -> Column:
    """Array of (href, label) in page order; quotes of either kind."""
    whole = F.regexp_extract_all(html, F.lit(r"""(?is)(<a\b[^>]*>.*?</a\s*>)"""), F.lit(1))
    return F.transform(whole, lambda a: F.struct(F.regexp_extract(a, r"""(?is)^<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["']""", 1).alias("href"), plain(a).alias("label")))


def records(pages: DataFrame, min_label: int = 18) -> DataFrame:
    """page_id, url (canonical), title, n_links, reason: why a page gives no record, null for good ones.

    A null page, an address without an http host and a page without a title are told apart; none stops the job.
    """
    text = lambda c: F.trim(F.regexp_replace(F.array_join(c, " "), r"\s+", " "))
    read = tokenized(pages.select("page_id", "url", "html", (F.coalesce("html", F.lit("")) == "").alias("empty")))
    title = F.coalesce(F.nullif(text("page.h1"), F.lit("")), text("page.headings"))  # headings are those of h1 and title
    url = canonical_url(F.col("url"))
    reason = F.when(F.col("empty"), "empty_page").when(url.isNull(), "bad_address").when(title == "", "no_title")
    said = F.filter(F.transform("page.links", lambda x: F.length(F.trim(F.regexp_replace(x["label"], r"\s+", " ")))), lambda n: n >= min_label)
    return read.select("page_id", url.alias("url"), title.alias("title"), F.size(said).cast("long").alias("n_links"), reason.alias("reason"))
