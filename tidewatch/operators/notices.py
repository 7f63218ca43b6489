"""Titles of procurement notices: a first selection before any detail is read, as Columns.

French and Arabic titles are brought to one folded text, to which the French
equivalent of each known Arabic term is added.  A null title, procedure or
category is empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.text import ACCENTED, PLAIN
from .rules import first, part, phrase


def notice_text(c: Column) -> Column:
    """Lower case, accents and Arabic letter variants dropped, everything but letters, digits and _ one space."""
    plain = F.translate(F.lower(F.coalesce(c, F.lit(""))), ACCENTED + "أإآىـ", PLAIN + "اااي")  # the last letter goes
    plain = F.regexp_replace(F.replace(plain, F.lit("œ"), F.lit("oe")), r"\p{M}", "")
    return F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}_]+", " "))


def with_equivalents(text: Column) -> Column:
    """A notice text with the French equivalents of its Arabic terms that it lacks."""
    added = [F.when(F.contains(text, F.lit(arabic)) & ~phrase(text, [french]), french) for arabic, french in L.TITLE_EQUIVALENTS]
    return F.trim(F.concat_ws(" ", text, *added))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row, however often ``use`` names it (plans stay small)."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def select_title(title: Column, procedure: Column, category: Column) -> Column:
    """Struct (decision, reason, priority): whether a notice is worth reading on, by its title alone.

    Rejections come first; of the rest heritage goes before competitions, those before major
    buildings, and titles that say too little are read on last.
    """
    said = F.coalesce(title, F.lit(""))

    def texts(bare: Column) -> Column:
        return F.struct(bare.alias("bare"), with_equivalents(bare).alias("text"), notice_text(procedure).alias("step"), notice_text(category).alias("kind"))

    def signs(t: Column) -> Column:
        text, both = t["text"], F.concat(t["text"], t["step"])
        return F.struct(
            phrase(text, L.TITLE_SERVICE).alias("service"),
            ((F.contains(both, F.lit("architectur")) & part(both, L.TITLE_CONTEST)) | F.contains(text, F.lit("concours de conception"))).alias("contest"),
            part(text, L.TITLE_HERITAGE).alias("heritage"),
            part(text, L.TITLE_MAJOR).alias("major"),
            part(text, L.TITLE_HERITAGE_PROOF).alias("proof"),
            said.rlike(r"(\.\.\.|…)\s*$").alias("cut"),
            t.alias("t"),
        )

    def reason(s: Column) -> Column:
        text, kind, service, contest, heritage, major, cut = s["t"]["text"], s["t"]["kind"], s["service"], s["contest"], s["heritage"], s["major"], s["cut"]
        spared = (heritage & s["proof"]) | part(text, L.TITLE_UNIVERSITY) | (cut & part(text, L.TITLE_MOSQUE))
        works = (F.contains(text, F.lit("travaux")) | (kind == "travaux")) & ~service & ~contest
        short = text.isin("", "consultation pmmp", "details", "detail") | (F.length(s["t"]["bare"]) < 20)
        return first([
            ("unrelated_scope", part(text, L.TITLE_UNRELATED)),
            ("supply_purchase", (kind == "fournitures") & ~service & ~contest),
            ("ordinary_facility_or_infrastructure", (phrase(text, ["ista"]) | part(text, L.TITLE_ORDINARY)) & ~spared),
            ("unrelated_topography", F.contains(text, F.lit("topograph")) & ~heritage & ~major & ~contest),
            ("pure_execution", works & ~(cut & heritage & ~F.startswith(text, F.lit("travaux")))),
            ("A_heritage_service", heritage & service),
            ("C_architectural_competition", contest),
            ("D_major_architecture", major & service),
            ("incomplete_scope_requires_detail", short | (cut & (heritage | service | major))),
            ("arabic_scope_requires_detail", said.rlike("[؀-ۿ]")),
        ], "no_relevant_title_context")

    def decision(r: Column) -> Column:
        priority = first([(n, r == name) for name, n in L.TITLE_PRIORITY.items()], 9)
        return F.struct(F.when(priority < 9, "continue").otherwise("reject").alias("decision"), r.alias("reason"), priority.alias("priority"))

    return once(once(once(once(notice_text(title), texts), signs), reason), decision)
