"""Text normalisers and lexicon matching as Columns (inside code generation).

The Column forms are exact for precomposed Latin-1 text, which is folded by a
translation table; ``normalize_exact`` and ``folder`` handle all of Unicode in an
Arrow UDF.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

ACCENTED = "".join(chr(c) for c in range(0xC0, 0x180) if len(unicodedata.normalize("NFKD", chr(c))) > 1 and unicodedata.normalize("NFKD", chr(c))[0].isascii() and unicodedata.normalize("NFKD", chr(c))[0].isalpha() and len([x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x)]) == 1)
PLAIN = "".join(unicodedata.normalize("NFKD", c)[0] for c in ACCENTED)


def normalize_text(c: Column) -> Column:
    """Case-folded, white space collapsed; null is empty."""
    return F.trim(F.regexp_replace(F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("ß"), F.lit("ss")), r"\s+", " "))


def fold_text(c: Column) -> Column:
    """Case-folded, accents dropped, everything but letters and digits one space."""
    plain = F.translate(F.replace(F.coalesce(c, F.lit("")), F.lit("ß"), F.lit("ss")), ACCENTED, PLAIN)
    return F.trim(F.regexp_replace(F.lower(plain), "[^a-z0-9]+", " "))


@F.pandas_udf(StringType())
def normalize_exact(texts: pd.Series) -> pd.Series:
    """``normalize_text`` for any script: compatibility forms composed (NFKC), full case folding, Unicode white space."""
    return texts.map(lambda t: " ".join(unicodedata.normalize("NFKC", t or "").casefold().split()))


def folder(ligature: bool = False, arabic: bool = False, words: bool = False):
    """An Arrow UDF like ``fold_text`` for any script: compatibility forms decomposed, marks dropped.

    ``ligature``: a ligature oe is two letters; ``arabic``: Arabic letters stay; ``words``: letters and digits of
    every script stay.
    """
    keep = re.compile(r"[^\w]+" if words else "[^a-z0-9\u0600-\u06ff]+" if arabic else "[^a-z0-9]+")

    @F.pandas_udf(StringType())
    def fold(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str:
            t = unicodedata.normalize("NFKD", t or "").casefold()
            t = t.replace("œ", "oe") if ligature else t
            return " ".join(keep.sub(" ", "".join(c for c in t if not unicodedata.combining(c))).split())

        return texts.map(one)

    return fold


fold_general = folder(ligature=True, arabic=True)


def shortened(c: Column, most: int) -> Column:
    """White space collapsed; a longer text is cut at the last word end that leaves room for an ellipsis."""
    t = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    head = t.substr(1, most - 1)
    cut = F.when(t.substr(most, 1) == " ", head).otherwise(F.coalesce(F.nullif(F.regexp_extract(head, r"^(.*\S)\s", 1), F.lit("")), head))
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.trim(cut), F.lit("…")))


def lexicon_hits(folded: Column, terms: list[str]) -> Column:
    """Terms that a folded text holds as whole words, in list order."""
    padded = F.concat(F.lit(" "), folded, F.lit(" "))
    return F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(padded, F.concat(F.lit(" "), t, F.lit(" "))))


def first_class(folded: Column, classes: list[tuple[str, list[str]]], other: str) -> Column:
    """Name of the first class with a term in the text."""
    padded = F.concat(F.lit(" "), folded, F.lit(" "))
    out = None
    for name, terms in classes:
        hit = F.lit(False)
        for t in terms:
            hit = hit | F.contains(padded, F.lit(f" {t} "))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(other)
