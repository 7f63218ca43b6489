"""Identities and fingerprints of records as Columns.

``norm`` is the normaliser of texts: ``text.normalize_exact`` for any script, or ``text.normalize_text``, which
stays inside code generation and is exact for Latin-1.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text, urls

Normaliser = Callable[[Column], Column]
# fixed values: words of a policy's title that name its stage, not the policy
STAGE_WORDS = r"\b(projet|avant projet|adoption|adopte|entree en vigueur|mise en oeuvre)\b"


def fingerprint(reference: Column, institution: Column, title: Column, url: Column, norm: Normaliser = text.normalize_exact) -> Column:
    """Digest of the strongest identity: reference and institution, else the address as given but for its fragment, else title and institution."""
    ref, org, head = norm(reference), norm(institution), norm(title)
    address = F.concat(urls.scheme(url), F.lit("://"), F.lower(F.regexp_extract(url, r"://([^/?#]*)", 1)), F.coalesce(F.nullif(urls.path(url), F.lit("")), F.lit("/")), F.regexp_extract(url, r"(\?[^#\s]+)", 1))
    return (
        F.when((ref != "") & (org != ""), urls.key_digest(F.lit("v1"), F.lit("reference"), ref, org))
        .when(F.trim(url) != "", F.when(urls.scheme(url).isin("http", "https") & (urls.host(url) != ""), urls.key_digest(F.lit("v1"), F.lit("url"), address)))
        .when(head != "", urls.key_digest(F.lit("v1"), F.lit("title"), head, org))
    )


def identity_keys(r: Column, norm: Normaliser = text.normalize_exact) -> Column:
    """Struct (url, reference, identity) of a record struct, by what kind of record its fields show.

    Programme and funder; legal status and document type; person and institution; institution alone; else a notice by
    its address, its reference with institution, and its title with institution.  A notice without an official page
    (``fallback``) may share its address with others and is not known by it.
    """
    n = lambda name: norm(r[name])
    there = lambda name: F.coalesce(r[name] != "", F.lit(False))
    same = lambda k: F.struct(F.lit(None).cast("string").alias("url"), k.alias("reference"), k.alias("identity"))
    base = F.coalesce(F.nullif(n("reference_number"), F.lit("")), F.regexp_replace(n("title"), STAGE_WORDS, ""))
    site = urls.host(F.coalesce(F.nullif(r["official_site"], F.lit("")), r["url"], F.lit("")))
    fallback = F.coalesce(r["fallback"], F.lit(False))
    ref, org = F.when(fallback, text.fold_text(r["reference"])).otherwise(n("reference")), n("institution")
    notice = F.struct(
        F.when(there("url") & ~fallback, urls.canonical_url(r["url"])).alias("url"),
        F.when((ref != "") & ((org != "") | fallback), urls.key_digest(ref, org)).alias("reference"),
        urls.key_digest(n("title"), org).alias("identity"),
    )
    return (
        F.when(there("program_name") & there("funder"), same(urls.key_digest(n("program_name"), n("funder"))))
        .when(there("legal_status") & there("document_type"), same(urls.key_digest(base, org)))
        .when(there("person") & there("institution_name"), same(urls.key_digest(n("person"), n("institution_name"))))
        .when(there("institution_name"), same(urls.key_digest(site, n("institution_name"))))
        .otherwise(notice)
    )


def content_digest(fields: dict[str, Column]) -> Column:
    """Digest of named values in the order of their names; nulls are told apart from empty values."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"}), 256)


def version_of(digest: Column) -> Column:
    """Short version of a record, to be named by whoever decides about it."""
    return F.substring(digest, 1, 12)


def listing_identity(consultation: Column, organisation: Column, detail_url: Column, reference: Column, buyer: Column, norm: Normaliser = text.normalize_exact) -> Column:
    """Digest of a listing: its number at the organisation, else its page, else reference and buyer; null with none of them."""
    return (
        F.when((F.trim(consultation) != "") & (F.trim(organisation) != ""), urls.key_digest(F.lit("id"), F.trim(consultation), F.trim(organisation)))
        .when(urls.canonical_url(detail_url).isNotNull(), urls.key_digest(F.lit("url"), urls.canonical_url(detail_url)))
        .when(norm(reference) != "", urls.key_digest(F.lit("reference"), norm(reference), norm(buyer)))
    )
