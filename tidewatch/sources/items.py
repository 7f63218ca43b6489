"""Items of watched sources: linked lists, tables, feeds and JSON answers, one row per item.

Each parser takes a frame with ``source``, ``base`` (the source's address) and ``body`` and returns ``source``,
``position`` and the item's fields.  A body that cannot be read gives no item; nothing stops the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import resolved
from .markup import tokenized

LEAST_LABEL, MOST_ITEMS, MOST_RECORDS = 18, 250, 500  # fixed values: bounds of what a source shows
TITLE, EVIDENCE, RAW = 1000, 2000, 4000


def _text(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def _shown(rows: DataFrame, most: int) -> DataFrame:
    """The first ``most`` items of each body, counted among those that are items at all."""
    return rows.filter(F.col("position") < most)


def _spread(pages: DataFrame, items: Column, most: int) -> DataFrame:
    return _shown(pages.select("source", F.posexplode(items).alias("position", "x")), most).select("source", "position", "x.*")


def _links(longest: int | None = TITLE) -> Column:
    good = F.filter(F.transform("page.links", lambda x: F.struct(x["href"].alias("href"), _text(x["label"]).alias("label"))), lambda x: F.length(x["label"]) >= LEAST_LABEL)
    title = lambda c: c if longest is None else F.substring(c, 1, longest)
    return F.transform(good, lambda x: F.struct(title(x["label"]).alias("title"), resolved(F.col("base"), x["href"]).alias("url"), F.substring(x["label"], 1, EVIDENCE).alias("evidence")))


def linked(pages: DataFrame, longest: int | None = TITLE) -> DataFrame:
    """Links whose label says enough: title (of ``longest`` letters at most, None: whole), url, evidence."""
    return _spread(tokenized(pages, "body"), _links(longest), MOST_ITEMS)


def tabled(pages: DataFrame) -> DataFrame:
    """Table rows whose cells together say enough, with the row's first link or the page's own address; a page without any gives its links."""

    def item(row: Column) -> Column:
        title = F.array_join(F.filter(row["cells"], lambda c: c != ""), " ")
        href = F.get(row["links"], F.lit(0))["href"]
        return F.struct(F.substring(title, 1, TITLE).alias("title"), F.coalesce(resolved(F.col("base"), href), F.col("base")).alias("url"), F.substring(title, 1, EVIDENCE).alias("evidence"))

    rows = F.filter(F.transform("page.rows", item), lambda x: F.length(x["title"]) >= LEAST_LABEL)
    found = tokenized(pages, "body").withColumn("items", rows)
    return _spread(found, F.when(F.size("items") > 0, F.col("items")).otherwise(_links()), MOST_ITEMS)


def fed(pages: DataFrame) -> DataFrame:
    """Entries of RSS and Atom feeds: title, url, date, evidence."""
    blocks = F.regexp_extract_all(F.coalesce("body", F.lit("")), F.lit(r"(?is)(<(?:item|entry)\b.*?</(?:item|entry)>)"), F.lit(1))
    bare = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"), "<[^>]+>", " "))

    def entry(b: Column) -> Column:
        value = lambda tag: F.nullif(bare(F.regexp_extract(b, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1)), F.lit(""))
        href = F.nullif(F.regexp_extract(b, r"""(?i)<link\b[^>]*href=["']([^"']+)""", 1), F.lit(""))
        return F.struct(
            F.coalesce(value("title"), F.lit("")).alias("title"), F.coalesce(value("link"), href, F.col("base")).alias("url"),
            F.coalesce(value("pubDate"), value("updated")).alias("date"), F.coalesce(value("description"), value("summary"), F.lit("")).alias("evidence"),
        )

    return _spread(pages, F.transform(blocks, entry), MOST_ITEMS)


def answered(pages: DataFrame) -> DataFrame:
    """Records of JSON answers: title, url, date, reference, evidence (the record itself).

    A list, or the first of ``projects``, ``items``, ``results`` and ``data`` that is a list or an object of records;
    of its first entries those that are objects count.
    """
    body = F.coalesce("body", F.lit(""))
    nested = lambda c: F.when(c.rlike(r"^\s*[\[{]"), c)
    inner = F.coalesce(*[nested(F.get_json_object(body, f"$.{k}")) for k in ("projects", "items", "results", "data")])
    held = F.when(F.startswith(F.trim(body), F.lit("[")), body).otherwise(inner)
    rows = F.slice(F.coalesce(F.from_json(held, "array<string>"), F.map_values(F.from_json(held, "map<string,string>"))), 1, MOST_RECORDS)

    def record(r: Column) -> Column:
        value = lambda *keys: F.coalesce(*[F.nullif(F.get_json_object(r, f"$.{k}"), F.lit("")) for k in keys])
        return F.struct(
            F.coalesce(value("project_name", "name", "title", "projectName"), F.lit("")).alias("title"), F.coalesce(value("url", "link", "project_url"), F.col("base")).alias("url"),
            value("approval_date", "boardapprovaldate", "date").alias("date"), value("id", "project_id").alias("reference"), F.substring(r, 1, RAW).alias("evidence"),
        )

    records = F.transform(F.filter(rows, lambda r: F.startswith(F.trim(r), F.lit("{"))), record)
    return _spread(pages, records, MOST_RECORDS)


def fetched(now: DataFrame, before: DataFrame) -> DataFrame:
    """``source``, ``state`` of each fetch against what was kept: BLOCKED, FAILED, NOT_MODIFIED, UNCHANGED or CHANGED.

    ``now``: source, code, etag, digest; ``before``: source, etag, digest.
    """
    b = before.select("source", F.col("etag").alias("_etag"), F.col("digest").alias("_digest"))
    met = now.join(b, "source", "left")
    state = (
        F.when(F.col("code").isin(403, 429), "BLOCKED")
        .when(F.col("code") == 304, "NOT_MODIFIED")
        .when(F.col("code").isNull() | ~F.col("code").between(200, 299), "FAILED")
        .when(F.col("digest").eqNullSafe(F.col("_digest")) & F.col("_digest").isNotNull(), "UNCHANGED")
        .otherwise("CHANGED")
    )
    return met.select("source", state.alias("state"))


def labelled(text: Column, labels: dict[str, list[str]]) -> Column:
    """Map of field to value for a page's ``label : value`` lines; the longest label that begins a line names the field, the first value of a field counts."""
    pairs = sorted(((alias, name) for name, aliases in labels.items() for alias in aliases), key=lambda p: (-len(p[0]), p[0]))

    def field(line: Column) -> Column:
        label = F.lower(F.trim(F.regexp_extract(line, r"^([^:]{2,60}):", 1)))
        name = F.lit(None).cast("string")
        for alias, n in reversed(pairs):
            near = label == alias if len(alias) < 8 else F.startswith(label, F.lit(alias))
            name = F.when(near, n).otherwise(name)
        return F.struct(name.alias("name"), _text(F.regexp_extract(line, r"^[^:]*:\s*(.*)$", 1)).alias("value"))

    found = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\n"), field), lambda x: x["name"].isNotNull() & (x["value"] != ""))
    names = F.array_distinct(F.transform(found, lambda x: x["name"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.get(F.filter(found, lambda x: x["name"] == n), F.lit(0))["value"]))
