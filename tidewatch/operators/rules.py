"""Explainable decisions as Columns: a rule set is a list of rows (outcome, condition), the first that holds decides.

Conditions are built from hits of term lists on folded text, so a whole rule set is one expression inside code
generation.  ``sql`` twins of the hit tests exist for oracles only in the query catalogue.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.text import fold_text


def phrase(folded: Column, terms: list[str]) -> Column:
    """Whether a folded text holds one of the terms as whole words."""
    padded = F.concat(F.lit(" "), folded, F.lit(" "))
    return reduce(or_, [F.contains(padded, F.lit(f" {t} ")) for t in terms])


def part(folded: Column, terms: list[str]) -> Column:
    """Whether a folded text holds one of the terms anywhere."""
    return reduce(or_, [F.contains(folded, F.lit(t)) for t in terms])


def first(rows: list[tuple[object, Column]], other: object = None) -> Column:
    """Outcome of the first row whose condition holds (a null condition does not)."""
    out = None
    for outcome, condition in rows:
        value = outcome if isinstance(outcome, Column) else F.lit(outcome)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(other if isinstance(other, Column) else F.lit(other))


def reasons(rows: list[tuple[str, Column]]) -> Column:
    """Every reason that applies, in order."""
    return F.array_compact(F.array(*[F.when(condition, F.lit(name)) for name, condition in rows]))


def project_signal(text: Column, published: Column, as_of: Column) -> Column:
    """Struct (signal, maturity, rejection, priority) of an announced project.

    News in the text keeps an old or completed project; a null date is never old.
    """
    t = fold_text(F.replace(F.lower(text), F.lit("œ"), F.lit("oe")))
    signal = first([(name, part(t, terms)) for name, terms in L.PROJECT_SIGNALS])
    news = part(t, L.PROJECT_NEWS)
    old = F.coalesce(F.datediff(as_of, published) > 90, F.lit(False))
    rejection = first([
        ("published_tender", part(t, L.PROJECT_TENDER)),
        ("completed", part(t, L.PROJECT_DONE) & ~news),
        ("old", old & ~news),
        ("vague", signal.isNull()),
        ("irrelevant", ~part(t, L.PROJECT_SCOPE) | (part(t, L.PROJECT_OTHER) & ~part(t, L.PROJECT_RESCUE))),
    ])
    maturity = first([(letter, signal.isin(names)) for letter, names in L.MATURITY.items()] + [("C", signal.isNotNull())], "D")
    priority = F.when(part(t, ["patrimoine", "medina", "monument", "historique", "restauration"]), 1).otherwise(2)
    return F.struct(signal.alias("signal"), maturity.alias("maturity"), rejection.alias("rejection"), priority.alias("priority"))


def funding(text: Column) -> Column:
    """Struct (status, letter, mode) of a funding notice; null outside its country or scope.  The text is folded once a row."""
    return F.get(F.transform(F.array(fold_text(text)), _funding), F.lit(0))


def _funding(t: Column) -> Column:
    may_open, may_consult = ~part(t, L.FUNDING_NOT_OPEN), ~part(t, L.FUNDING_NO_CONSULTANT)
    status = first([
        ("closed", phrase(t, L.FUNDING_CLOSED)),
        ("pipeline", part(t, L.FUNDING_FRAMEWORK)),
        ("open", may_open & phrase(t, L.FUNDING_OPEN)),
        ("active", phrase(t, L.FUNDING_ACTIVE)),
        ("preparation", phrase(t, L.FUNDING_PREPARED)),
    ], "pipeline")
    letter = first([(letter, status == name) for name, letter in (("closed", "E"), ("open", "A"), ("active", "B"), ("preparation", "C"))], "D")
    mode = first([
        ("DIRECT_ACCESS", may_open & phrase(t, L.FUNDING_DIRECT)),
        ("CONSULTANT_OPPORTUNITY", may_consult & phrase(t, L.FUNDING_CONSULTANT)),
        ("BENEFICIARY_PROCUREMENT", phrase(t, L.FUNDING_BENEFICIARY)),
        ("TECHNICAL_ASSISTANCE", phrase(t, L.FUNDING_ASSISTANCE)),
        ("GRANT", may_open & phrase(t, L.FUNDING_GRANT)),
        ("PROJECT_PIPELINE", status.isin("preparation", "pipeline")),
    ], "MONITORING_ONLY")
    inside = phrase(t, L.FUNDING_PLACES) & phrase(t, L.FUNDING_SCOPE)
    return F.when(inside, F.struct(status.alias("status"), letter.alias("letter"), mode.alias("mode")))


def institution(text: Column, published: Column, as_of: Column) -> Column:
    """Struct (relevant, activity, role, obsolete, current) of an institution's page; current: dated within 180 days."""
    t = fold_text(text)
    return F.struct(
        phrase(t, L.INSTITUTION_SCOPE).alias("relevant"),
        first([(n, phrase(t, terms)) for n, terms in L.INSTITUTION_ACTIVITIES], "CURRENT_PROFILE").alias("activity"),
        first([(n, phrase(t, terms)) for n, terms in L.INSTITUTION_ROLES]).alias("role"),
        phrase(t, L.INSTITUTION_OBSOLETE).alias("obsolete"),
        F.coalesce(F.datediff(as_of, published).between(0, 180), F.lit(False)).alias("current"),
    )


def boundary(text: Column, domains: dict[str, list[str]], unrelated: list[str], evidence: list[str], review_unsure: bool = True) -> Column:
    """Struct (decision, domains, reason): a text is kept with a domain term and evidence, reviewed without the latter."""
    t = fold_text(text)
    found = reasons([(name, phrase(t, terms)) for name, terms in domains.items()])
    none = F.size(found) == 0
    sure = phrase(t, evidence) if review_unsure else F.lit(True)
    return F.struct(
        first([("reject", none), ("keep", sure)], "review").alias("decision"),
        found.alias("domains"),
        first([("unrelated_generic_content", none & phrase(t, unrelated)), ("outside_scope", none)]).alias("reason"),
    )


def confidence_gate(relevant: Column, confidence: Column, manual: Column, accept: float = 0.80, review: float = 0.55) -> Column:
    """rejected, review or accepted; a doubt that is already marked for a person is never dropped for low confidence."""
    return first([("rejected", ~relevant | ((confidence < review) & ~manual)), ("review", (confidence < accept) | manual)], "accepted")


def targeted_score(folded: Column, wanted: list[str], excluded: list[str], places: list[str], official: Column) -> Column:
    """0 to 100: 35, ten per wanted term up to 35 more, a place found 20 more or else 35 less, official 10 more; 0 if excluded."""
    hits = reduce(lambda a, b: a + b, [F.contains(folded, F.lit(t)).cast("int") for t in wanted], F.lit(0))
    place = F.when(part(folded, places), 20).otherwise(-35) if places else F.lit(0)
    score = F.lit(35) + F.least(F.lit(35), hits * 10) + place + F.when(official, 10).otherwise(0)
    score = F.greatest(F.lit(0), F.least(F.lit(100), score))
    return F.when(part(folded, excluded), 0).otherwise(score) if excluded else score


def lifecycle(is_new: Column, relevant: Column, material: Column, previous: Column) -> Column:
    """Struct (discovery, review, event): a decided row reopens only for a business change of a relevant row."""
    again = relevant & material
    return F.struct(
        F.when(is_new, "NEW").otherwise("UPDATED").alias("discovery"),
        F.when((is_new & relevant) | (~is_new & again), "PENDING").otherwise(previous).alias("review"),
        first([("DISCOVERED", is_new), ("REOPENED", again & previous.isin("APPROVED", "REJECTED"))], "UPDATED").alias("event"),
    )
