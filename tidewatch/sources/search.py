"""Answers of a search: what it says it found, held against the addresses it really saw."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import canonical_url, domain

LONGEST = 500  # fixed value: how much of a source's title or snippet is kept


def observed(sources: DataFrame) -> DataFrame:
    """``query``, ``url`` (canonical), title, snippet, day, domain: each address a query saw, once; the last text given for a field counts.

    ``sources``: query, position, url, title, snippet, day.  An address that cannot be one is left out.
    """
    good = sources.withColumn("url", canonical_url(F.col("url"))).filter("url IS NOT NULL")
    last = lambda c: F.max_by(F.substring(c, 1, LONGEST), F.when(F.col(c) != "", F.col("position")))
    kept = good.groupBy("query", "url").agg(*[last(c).alias(c) for c in ("title", "snippet", "day")])
    return kept.select("query", "url", *[F.coalesce(c, F.lit("")).alias(c) for c in ("title", "snippet")], "day", domain(F.col("url")).alias("domain"))


def merged(hits: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits with ``kind``; refused: query, position).

    ``hits``: query, position, url, title, evidence, day.  A hit counts only if its query saw the address; a seen
    address without a hit becomes a ``discovery_page`` of its own.  Both are equality joins by query and address.
    """
    seen, keys = observed(sources), ["query", "url"]
    said = hits.withColumns({"url": canonical_url(F.col("url")), "evidence": F.trim(F.regexp_replace(F.coalesce("evidence", F.lit("")), r"\s+", " "))})
    good = said.join(seen.select(*keys), keys, "left_semi").select(*keys, "title", "evidence", "day", F.lit("hit").alias("kind"))
    pages = seen.join(said.select(*keys), keys, "left_anti").select(*keys, "title", F.col("snippet").alias("evidence"), "day", F.lit("discovery_page").alias("kind"))
    return good.unionByName(pages), said.join(seen.select(*keys), keys, "left_anti").select("query", "position")
