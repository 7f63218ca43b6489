"""Who leads an institution: names beside roles in the texts of pages, what their roles are, and who holds them now."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicons import ROLE_SOURCES
from ..functions.text import fold_text
from ..functions.values import french_date
from .notices import once
from .rules import first

# How names and roles are written, titles before names, words that make evidence none, kinds of roles.
NAME = r"[A-ZÀ-ÖØ-Ý][\wÀ-ÿ'-]+(?:\s+[A-ZÀ-ÖØ-Ý][\wÀ-ÿ'-]+){1,5}"
ROLE = r"(?:[Mm]inistre(?:\s+[^,.]{3,120})?|[Dd]irect(?:eur|rice)(?:\s+général(?:e)?)?|[Pp]résident(?:e)?(?:\s+du\s+directoire)?|[Ss]ecrétaire\s+général(?:e)?|[Cc]hef\s+de\s+projet|[Rr]esponsable\s+(?:patrimoine|partenariats|marchés))"
ROLE_MORE = r"(?:\s+(?:technique|de programme|de projet|de l[’']urbanisme|par intérim))?"
LINK = r"\s*(?:,|a été nommé(?:e)?|est nommé(?:e)?|est)\s*"
TITLES, TITLES_OF_MANY = r"^(?:Monsieur|Madame|Mme|M)\s+", r"^(?:Messieurs|Monsieur|Madame|Mme|M)\s+"
NO_EVIDENCE = ["auteur", "journaliste", "contact presse", "recrutement"]
NO_EVIDENCE_BESIDE = ["auteur", "recrutement", "ancien", "journaliste"]
DEPARTED = ["a quitte ses fonctions", "fin de mandat", "ancien directeur", "ancienne directrice"]
HELD_ROLE = r"\b(directeur|directrice|president|presidente|secretaire general|secretaire generale|responsable patrimoine|responsable partenariats|responsable marches|chef de projet|ministre)\b"
NO_ROLE = ["journaliste", "auteur", "recrutement", "ancien", "ancienne", "ex directeur"]
KINDS = [
    (r"direct(?:eur|rice) general", "DIRECTOR_GENERAL"), (r"direct(?:eur|rice) technique", "TECHNICAL_DIRECTOR"), (r"direct(?:eur|rice) de l urbanisme", "URBANISM_DIRECTOR"),
    (r"direct(?:eur|rice) de programme", "PROGRAM_DIRECTOR"), (r"(?:direct(?:eur|rice)|chef) de projet", "PROJECT_DIRECTOR"), (r"responsable patrimoine", "HERITAGE_MANAGER"),
    (r"responsable partenariats", "PARTNERSHIP_MANAGER"), (r"responsable (?:marches|projets)", "PROCUREMENT_PROJECT_MANAGER"), (r"secretaire general", "SECRETARY_GENERAL"), (r"president", "PRESIDENT"), (r"direct(?:eur|rice)", "DIRECTOR"),
]
PAGE_END = r"Dernières actualités|Continuez votre visite|Retour aux actualités"
MINISTER = r"""(?is)<h3[^>]*>(.*?)</h3>\s*<div\s+class="paragraph--gouver">(.*?)</div>"""
MINISTRIES = ["urbanisme", "culture"]
VERIFIED_LABEL, PROBABLE_LABEL, UNKNOWN_LABEL = "rôle actuel vérifié", "probablement actuel, non confirmé", "Responsable actuel non vérifié"
SHORTEST_PROFILE, LONGEST_PROFILE, CURRENT_DAYS = 100, 6000, 180

_PAIR = "array<struct<name:string,role:string,context:string,before:string>>"
_START, _MIDDLE, _END = "\u0001", "\u0002", "\u0003"  # no page's text has them: white space is collapsed and they are taken out first


def role_valid(role: Column) -> Column:
    """Whether a title is a role that leads; that of a press or former office is none."""
    return once(fold_text(role), lambda v: v.rlike(HELD_ROLE) & ~v.rlike("|".join(NO_ROLE)) & (~F.contains(v, F.lit("communication")) | F.startswith(v, F.lit("ministre "))))


def role_kind(role: Column) -> Column:
    """The kind of the first wording that begins a role, null for other roles."""
    return once(fold_text(role), lambda v: first([(kind, v.rlike(rf"^{pattern}\b")) for pattern, kind in KINDS]))


def _spans(text: Column, pattern: Column, swapped: bool, before: int, after: int) -> Column:
    """Array of (name, role, context, before) for each match of ``pattern`` (two groups), in order, without overlap.

    Matches are marked and the text is split at the marks, which gives their places: ``before`` counts characters of
    context in front of a match, ``after`` behind it.
    """
    marked = F.regexp_replace(text, F.concat(F.lit("(?U)("), pattern, F.lit(")")), F.lit(f"{_START}$2{_MIDDLE}$3{_MIDDLE}$1{_END}"))

    def read(pieces: Column) -> Column:
        found = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p: F.struct(F.split(F.substring_index(p, _END, 1), _MIDDLE).alias("g"), F.substring_index(p, _END, -1).alias("rest")))

        def placed(f: Column) -> Column:
            long = lambda x: F.length(x["g"][2])
            starts = lambda i: F.length(pieces[0]) + F.aggregate(F.slice(f, 1, i), F.lit(0), lambda n, x: n + long(x) + F.length(x["rest"]))

            def one(x: Column, i: Column) -> Column:
                def said(at: Column) -> Column:
                    low = F.greatest(at - before, F.lit(0))
                    name, role = (x["g"][1], x["g"][0]) if swapped else (x["g"][0], x["g"][1])
                    return F.struct(name.alias("name"), role.alias("role"), F.substring(text, low + 1, at + long(x) + after - low).alias("context"), F.substring(text, low + 1, at - low).alias("before"))

                return once(starts(i), said)

            return F.transform(f, one)

        return once(found, placed)

    return once(F.split(marked, _START), read).cast(_PAIR)


def _squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), _START + _MIDDLE + _END, "   "), r"(?U)\s+", " "))


def _has(folded: Column, words: list[str]) -> Column:
    return folded.rlike("|".join(words))


RECORD = ("person_name", "role_title", "excerpt", "departed", "interim")


def named(pages: DataFrame, text: str = "text", dated: str | None = None) -> DataFrame:
    """One row per name beside a role: ``pages``' columns but the text, ``position``, person_name, role_title, evidence_date, excerpt, departed, interim.

    The date is the page's own (column ``dated``), else the one its first 800 characters name.
    """
    whole = pages.withColumn(text, _squeezed(F.col(text)))
    own = french_date(F.left(F.col(text), F.lit(800)))
    whole = whole.withColumn("evidence_date", F.coalesce(F.col(dated), own) if dated else own)
    pattern = F.lit(rf"({NAME}){LINK}({ROLE}{ROLE_MORE})")
    spans = whole.select("*", F.posexplode(_spans(F.col(text), pattern, False, 90, 160)).alias("position", "x"))
    near, wide = fold_text(F.left(F.col("x.context"), F.lit(90))), fold_text(F.col("x.context"))
    kept = spans.filter(~_has(near, NO_EVIDENCE))
    return kept.select(
        *[c for c in pages.columns if c != text and c != dated], "position", F.regexp_replace("x.name", TITLES, "").alias("person_name"), F.col("x.role").alias("role_title"), "evidence_date",
        F.left(F.col("x.context"), F.lit(600)).alias("excerpt"), _has(wide, DEPARTED).alias("departed"), F.contains(wide, F.lit("interim")).alias("interim"),
    )


def curated(pages: DataFrame, registry: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Names beside an institution's own role, before or after it, on its registered pages.

    ``pages``: key, page (tokenized, see :mod:`..sources.markup`); ``registry``: key, institution, role_pattern, url,
    source_type, a few rows (Spark's own size check broadcasts them); ``keep`` names columns of the pages to hand on.  Pages without a heading, or with one that is no evidence, give none.
    """
    body = F.get(F.split(_squeezed(F.col("page.body")), PAGE_END, 2), F.lit(0))
    headed = pages.filter(F.size("page.h1") > 0).join(registry, "key").withColumn("text", F.trim(body))
    told = headed.filter((F.col("text") != "") & headline_rejection(F.array_join("page.h1", " ")).isNull()).withColumn("evidence_date", french_date(F.left(F.col("text"), F.lit(400))))
    role = F.col("role_pattern")
    ahead = _spans(F.col("text"), F.concat(F.lit(rf"({NAME})\s*,\s*("), role, F.lit(")")), False, 45, 80)
    behind = _spans(F.col("text"), F.concat(F.lit("("), role, F.lit(rf")\s*,\s*({NAME})")), True, 45, 80)
    keep = keep or []
    spans = told.select(*keep, "key", "institution", "url", "source_type", "evidence_date", F.posexplode(F.concat(ahead, behind)).alias("position", "x"))
    kept = spans.filter(~_has(fold_text(F.col("x.before")), NO_EVIDENCE_BESIDE))
    return kept.select(*keep, "key", "institution", "url", "source_type", "evidence_date", "position", F.regexp_replace("x.name", TITLES_OF_MANY, "").alias("person_name"), F.col("x.role").alias("role_title"), role_kind(F.col("x.role")).alias("kind"), F.col("x.context").alias("excerpt"))


def ministers(pages: DataFrame, html: str = "html") -> DataFrame:
    """Ministers of urbanism or culture on a list of the government: ``pages``' columns but the markup, person_name, role_title, institution, reference."""
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), r"(?U)\s+", " "))
    cut = F.regexp_replace(F.coalesce(F.col(html), F.lit("")), MINISTER, f"{_START}$1{_MIDDLE}$2{_END}")
    rest = once(F.split(cut, _START), lambda p: F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))))
    pieces = F.transform(rest, lambda p: F.split(F.substring_index(p, _END, 1), _MIDDLE))
    rows = pages.select(*[c for c in pages.columns if c != html], F.explode(F.transform(pieces, lambda g: F.struct(plain(g[0]).alias("name"), plain(g[1]).alias("role")))).alias("x"))
    good = F.col("x.name").rlike(r"^M(?:me)?\.") & F.startswith(F.col("x.role"), F.lit("Ministre")) & _has(fold_text(F.col("x.role")), MINISTRIES)
    person = F.regexp_replace("x.name", r"^M(?:me)?\.\s*", "")
    return rows.filter(good).select(*[c for c in pages.columns if c != html], person.alias("person_name"), F.col("x.role").alias("role_title"), F.regexp_replace("x.role", "^Ministre", "Ministère").alias("institution"), F.sha2(F.concat(person, "x.role"), 256).alias("reference"))


def profiles(pages: DataFrame) -> DataFrame:
    """An institution's own page as evidence: name, url, evidence, reference; pages without a heading or with little text are none."""
    said = F.left(F.col("page.body"), F.lit(LONGEST_PROFILE))
    return pages.filter((F.size("page.h1") > 0) & (F.length(said) >= SHORTEST_PROFILE)).select("name", "url", said.alias("evidence"), F.sha2(said, 256).alias("reference"))


def headline_rejection(title: Column) -> Column:
    """Why a headline is no evidence: an offer of work, a former office, an event; null if it is."""
    padded = F.concat(F.lit(" "), fold_text(title), F.lit(" "))
    whole = lambda terms: F.exists(F.array(*[F.lit(f" {t} ") for t in terms]), lambda t: F.contains(padded, t))
    return first([("recruitment_notice", whole(RECRUITMENT)), ("obsolete_role", whole(FORMER)), ("generic_article", whole(EVENTS))])


# Words of headlines that are no evidence.
RECRUITMENT = ["recrutement", "offre d emploi", "offres d emploi", "appel a candidature", "appel a candidatures", "job", "vacancy"]
FORMER = ["ancien directeur", "ancienne directrice", "ancien president", "ex directeur"]
EVENTS = ["conference", "colloque"]


# --- who holds a role -------------------------------------------------------------------------------


def confirmed(evidence: DataFrame, activity: DataFrame, slot: list[str]) -> DataFrame:
    """``evidence`` and what activity pages (same columns) say of people it names: a semi-join by slot and folded name."""
    keys = evidence.select(*slot, fold_text(F.col("person_name")).alias("_name")).distinct()
    again = activity.withColumn("_name", fold_text(F.col("person_name"))).join(keys, [*slot, "_name"], "left_semi").select(*evidence.columns)
    return evidence.unionByName(again)


def resolved(evidence: DataFrame, slot: list[str], as_of: Column) -> DataFrame:
    """Per slot: ``status`` and, unless people contradict one another, ``holder`` (the selected evidence); ``changed``: whether several people are named.

    ``evidence``: slot, person_name, role_title, source_type, evidence_date, url, departed, interim, position (which of
    equal evidence comes first).  Roles that do not lead, unknown sources and dates after ``as_of`` do not count, a
    professional page only where nothing official does; the latest date wins (undated last), then the better source.
    Slots are aggregated with a bounded state, so one of any size never sits in one task; one whose evidence is none
    is UNVERIFIED.
    """
    rank = F.array_position(F.array(*[F.lit(s) for s in ROLE_SOURCES]), F.col("source_type"))
    name = fold_text(F.col("person_name"))
    counts = (rank > 0) & role_valid(F.col("role_title")) & (F.col("evidence_date").isNull() | (F.col("evidence_date") <= as_of))
    order = F.when(counts, F.struct((F.col("source_type") == "PROFESSIONAL").cast("int").alias("unofficial"), F.coalesce(F.datediff(F.lit("9999-12-31").cast("date"), "evidence_date"), F.lit(1 << 30)).alias("age"), rank.alias("rank")))
    record = F.struct("person_name", "role_title", "source_type", "evidence_date", "url", "departed", "interim")
    ranked = evidence.select(*slot, "position", record.alias("record"), name.alias("name"), order.alias("o"))
    place = ranked.groupBy(*slot, "o").agg(F.min("name").alias("low"), F.max("name").alias("high"), F.min_by("record", F.struct("position", "record")).alias("record"))
    best = place.groupBy(*slot).agg(F.min_by(F.struct("low", "high", "record", "o"), "o").alias("b"), F.min("low").alias("least"), F.max("high").alias("most"))
    b = F.col("b")
    old = F.coalesce(F.datediff(as_of, b["record"]["evidence_date"]) > CURRENT_DAYS, F.lit(False))
    status = first([
        ("UNVERIFIED", b.isNull()), ("OBSOLETE", b["record"]["departed"] | old), ("UNVERIFIED", b["low"] != b["high"]),
        ("PROBABLY_CURRENT", (b["record"]["source_type"] == "PROFESSIONAL") | b["record"]["evidence_date"].isNull()),
    ], "VERIFIED_CURRENT")
    return best.select(*slot, status.alias("status"), F.when(status != "UNVERIFIED", b["record"]).alias("holder"), (F.col("least") != F.col("most")).alias("changed"))


def applied(profiles_: DataFrame, holders: DataFrame, slot: list[str]) -> DataFrame:
    """``profiles_`` (slot, institution, activity) with who leads: names only where current, and what that rests on.  Profiles without evidence stay as they are."""
    both = profiles_.join(holders, slot, "left")
    h, sure = F.col("holder"), F.col("status") == "VERIFIED_CURRENT"
    shown = F.when(F.col("status").isin("VERIFIED_CURRENT", "PROBABLY_CURRENT"), h)
    label = F.when(shown.isNotNull(), F.concat(h["role_title"], F.lit(" : "), h["person_name"], F.lit(" — "), F.when(sure, VERIFIED_LABEL).otherwise(PROBABLE_LABEL))).when(F.col("status").isNotNull(), UNKNOWN_LABEL)
    activity = F.when(h.isNotNull() & F.col("changed"), "LEADERSHIP_CHANGE").when(h.isNotNull() & ((h["source_type"] == "APPOINTMENT") | h["interim"]), "NEW_APPOINTMENT").otherwise(F.col("activity"))
    return both.select(
        *[c for c in profiles_.columns if c != "activity"], activity.alias("activity"), "status", shown["person_name"].alias("person_name"), shown["role_title"].alias("role_title"), F.coalesce(sure, F.lit(False)).alias("role_verified"),
        F.when(sure, h["evidence_date"]).alias("role_verified_at"), h["url"].alias("role_source_url"), h["source_type"].alias("role_source_type"), h["evidence_date"].alias("evidence_date"),
        F.when(sure, 0.95).when(shown.isNotNull(), 0.65).when(F.col("status").isNotNull(), 0.0).alias("confidence"), label.alias("label"), F.concat_ws(" — ", "institution", label).alias("title"), F.when(~sure, label).alias("limitation"),
    )
