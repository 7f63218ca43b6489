"""Candidates of the four radars beside procurement, built from items of watched sources.

Every builder takes items (id, title, url, evidence, institution, published as written) and returns one row per
candidate or refused item with the reason (``rejected``, null for candidates), so no item is lost.  The rules stand in
:mod:`rules` and :mod:`policies`; here their outcome becomes a record.  All are projections; nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import urls
from ..functions.text import fold_text
from ..functions.values import date_of, french_date, omit_contacts
from . import details, policies, rules
from .leadership import UNKNOWN_LABEL, headline_rejection
from .rules import first, part

# How budgets, people in office, instruments and amounts are written, and words that decide.
BUDGET = r"\b((?:[\d.,]+)\s*(?:milliards?|millions?|mmdh|mdh|dh))\b"
PERSON = r"(?U)\b(?:M(?:me)?\.?\s+)?([A-ZÀ-ÖØ-Ý][\wÀ-ÿ-]+(?:\s+[A-ZÀ-ÖØ-Ý][\wÀ-ÿ-]+){1,3})\s+(?:a été\s+)?(?:nommé|nommée|a présidé|a preside|préside|preside)"
INSTRUMENT = r"(?iU)\b(?:loi|decret|décret|arrêté|arrete)\s+n?[°º]?\s*([\d.-]+)"
INSTRUMENT_TITLE = r"(?iU)^(?:projet de |avant.projet de )?(?:loi|décret|decret|arrêté|arrete)\s"
AMOUNT_BEFORE = r"(?i)(?<!\d)(\d[\d ., ]*)\s*(million|milliard|mn|bn)?\s*(EUR|USD|MAD|DH|€|\$)"
AMOUNT_AFTER = r"(?i)(EUR|USD|MAD|DH|€|\$)\s*(\d[\d ., ]*)\s*(million|milliard|mn|bn)?"
GENERIC_INSTITUTION, GENERIC_START = "portail officiel", "acteurs publics"
ELIGIBLE = ["eligible", "peut candidater", "apply", "appel a projets"]
STRATEGIC = ["patrimoine", "developpement urbain", "territorial", "rehabilitation"]
SECTORS = ["urban", "heritage", "territorial"]
RESULT_TYPES = {"PROGRAM_LAUNCH": "NEW_PROGRAM", "PARTNERSHIP": "NEW_PARTNERSHIP", "LEADERSHIP_CHANGE": "ROLE_CHANGE"}
PROJECT_REFUSALS = {"vague": "rejected_vague", "old": "rejected_old", "irrelevant": "rejected_irrelevant", "completed": "rejected_completed", "published_tender": "rejected_tender"}
DRAFT_NOTE = " — Version publiée comme projet ; adoption ultérieure et entrée en vigueur actuelles non vérifiées."
DONOR_TEXT = ["project_name", "projectstatusdisplay", "borrower", "impagency", "countryshortname", "lendinginstr"]
MOST_TITLE, MOST_TEXT = 2000, 2000


def _squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def _both(*parts: Column) -> Column:
    return F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts])


def _dated() -> Column:
    return F.coalesce(date_of(F.col("published")), french_date(F.col("evidence")))


def _quality(official: Column) -> Column:
    return F.when(official, "OFFICIAL_PRIMARY").otherwise("RELIABLE_SECONDARY")


def projects(items: DataFrame, official: list[str], as_of: Column) -> DataFrame:
    """Projects that items announce: a list of several gives one each.

    id, block, rejected, project_name, signal, maturity, priority, budget, project_scope, announced, url, official_url,
    source_quality, financing_secured, program_approved, officially_announced, uncertain, summary.
    """
    dated = items.withColumn("_day", _dated())
    lines = F.filter(F.transform(F.split(F.coalesce("evidence", F.lit("")), r"[\r\n]+"), lambda x: F.btrim(x, F.lit(" \t-*•"))), lambda x: F.length(x) >= details.LEAST_BLOCK)
    dated = dated.withColumn("_good", F.filter(lines, lambda x: rules.project_signal(x, F.col("_day"), as_of)["signal"].isNotNull()))
    single = F.size("_good") < 2
    met = dated.select("*", F.posexplode(F.when(single, F.array(F.coalesce("evidence", F.lit("")))).otherwise(F.col("_good"))).alias("block", "text"))
    title = F.when(single, F.col("title")).otherwise(F.left("text", F.lit(500)))
    said = F.when(single, F.coalesce("evidence", F.lit(""))).otherwise(F.col("text"))
    own = urls.domain_match(F.col("url"), official)
    folded = fold_text(_both(title, said))
    scope = F.array_join(F.filter(F.array(*[F.lit(t) for t in L.PROJECT_SCOPE]), lambda t: F.contains(folded, t)), ", ")
    s = F.col("s")
    judged = met.withColumn("s", rules.project_signal(_both(title, said), F.col("_day"), as_of)).withColumn("_title", F.left(title, F.lit(MOST_TITLE)))
    refused = first([(name, s["rejection"] == code) for code, name in PROJECT_REFUSALS.items()])
    return judged.select(
        "id", "block", refused.alias("rejected"), F.col("_title").alias("project_name"), s["signal"].alias("signal"), s["maturity"].alias("maturity"), s["priority"].alias("priority"),
        F.nullif(F.regexp_extract(folded, BUDGET, 1), F.lit("")).alias("budget"), F.left(scope, F.lit(MOST_TEXT)).alias("project_scope"), F.col("_day").alias("announced"), "url", F.when(own, F.col("url")).alias("official_url"),
        _quality(own).alias("source_quality"), F.coalesce(s["signal"] == "FINANCING_APPROVED", F.lit(False)).alias("financing_secured"), F.coalesce(s["signal"] == "PROGRAM_APPROVED", F.lit(False)).alias("program_approved"),
        F.coalesce(s["signal"].isin("PROJECT_ANNOUNCED", "CONVENTION_SIGNED"), F.lit(False)).alias("officially_announced"), (s["maturity"] == "C").alias("uncertain"), F.left(_squeezed(said), F.lit(MOST_TEXT)).alias("summary"),
    )


def institutions(items: DataFrame, official: list[str], as_of: Column) -> DataFrame:
    """Institutions and people in office that items tell of; ``items`` also has profile (whether it is the institution's own page).

    A person stays only where an official, current text names their office; an institution needs a profile of its own
    or news.  id, rejected, institution_name, profile_type, result_type, activity, person, role, verified, verified_at,
    url, official_url, source_quality, excerpt, limitation, confidence.
    """
    day, own = date_of(F.col("published")), urls.domain_match(F.col("url"), official)
    judged = items.withColumn("s", rules.institution(_both(F.col("title"), F.col("evidence")), day, as_of)).withColumn("person", F.nullif(F.regexp_extract(F.coalesce("evidence", F.lit("")), PERSON, 1), F.lit("")))
    s, person, named = F.col("s"), F.col("person"), fold_text(F.col("institution"))
    generic = F.contains(named, F.lit(GENERIC_INSTITUTION)) | F.startswith(named, F.lit(GENERIC_START))
    someone = person.isNotNull()
    sure = someone & own & day.isNotNull() & s["current"] & s["role"].isNotNull()
    profile = F.coalesce("profile", F.lit(False))
    news = (s["activity"] != "CURRENT_PROFILE") & s["current"]
    refused = first([
        (headline_rejection(F.col("title")), headline_rejection(F.col("title")).isNotNull()), ("not_relevant", ~s["relevant"] | s["obsolete"] | (named == "") | generic),
        (F.when(day.isNotNull() & ~s["current"], "obsolete_role").otherwise("officeholder_unverified"), someone & ~sure), ("generic_article", ~someone & ~(own & profile) & ~news),
    ])
    kind = first([("NEW_APPOINTMENT", s["activity"] == "NEW_APPOINTMENT"), ("CURRENT_DECISION_MAKER", someone), ("INSTITUTION_PROFILE", profile), *[(name, s["activity"] == code) for code, name in RESULT_TYPES.items()]], "NEW_STRATEGIC_ACTIVITY")
    return judged.select(
        "id", refused.alias("rejected"), F.left("institution", F.lit(500)).alias("institution_name"), F.when(someone, "PERSON").otherwise("INSTITUTION").alias("profile_type"), kind.alias("result_type"), s["activity"].alias("activity"),
        "person", F.when(someone, F.initcap(F.replace(s["role"], F.lit("_"), F.lit(" ")))).alias("role"), F.coalesce(sure, F.lit(False)).alias("verified"), F.when(sure, day).alias("verified_at"), "url", F.when(own, F.col("url")).alias("official_url"),
        _quality(own).alias("source_quality"), F.left(omit_contacts(F.col("evidence")), F.lit(MOST_TEXT)).alias("excerpt"), F.when(~someone, UNKNOWN_LABEL).alias("limitation"), F.when(sure, 0.95).alias("confidence"),
    )


def instruments(items: DataFrame, official: list[str]) -> DataFrame:
    """Laws, decrees, strategies and studies that official items publish; ``items`` also has listing (url of a list of drafts, or null) and listed_type.

    A page never shows that a text is in force; a draft's list makes it a draft; a number is the text's own only where
    its title begins with the instrument.  id, rejected, title, document_type, status, reference, confidence, reliable,
    status_source, official_url, document_url, summary, published_on.
    """
    found = items.withColumn("s", policies.classify(F.col("title"), F.col("evidence")))
    s, drafted = F.col("s"), F.col("listing").isNotNull()
    kind = F.when(drafted, F.coalesce("listed_type", s["type"])).otherwise(s["type"])
    status = F.when(drafted, "DRAFT").when(s["status"] == "IN_FORCE", "POLICY_SIGNAL").otherwise(s["status"])
    number = F.when(F.col("title").rlike(INSTRUMENT_TITLE), F.nullif(F.regexp_extract(_both(F.col("title"), F.col("evidence")), INSTRUMENT, 1), F.lit("")))
    excerpt = F.coalesce(F.nullif(F.left(_squeezed(F.col("evidence")), F.lit(MOST_TEXT)), F.lit("")), F.col("title"))
    weak = status == "POLICY_SIGNAL"
    return found.select(
        "id", F.when(s.isNull() | ~urls.domain_match(F.col("url"), official), "unrelated_or_nonofficial").alias("rejected"), F.left("title", F.lit(MOST_TITLE)).alias("title"), kind.alias("document_type"), status.alias("status"), number.alias("reference"),
        F.when(drafted, 0.95).when(weak, 0.3).otherwise(0.8).alias("confidence"), (~weak).alias("reliable"), F.when(drafted, "SGG_DRAFT_LIST").otherwise("OFFICIAL_PAGE").alias("status_source"), F.col("url").alias("official_url"),
        F.when(F.endswith(F.lower("url"), F.lit(".pdf")), F.col("url")).alias("document_url"), F.when(drafted, F.concat(F.left(excerpt, F.lit(1750)), F.lit(DRAFT_NOTE))).otherwise(excerpt).alias("summary"), date_of(F.col("published")).alias("published_on"),
    )


def _money(evidence: Column) -> Column:
    """Struct (amount, currency): a number before its currency, else behind it; one that cannot be read leaves the currency."""
    ahead = F.regexp_extract(evidence, AMOUNT_BEFORE, 3) != ""
    pick = lambda i, j: F.when(ahead, F.regexp_extract(evidence, AMOUNT_BEFORE, i)).otherwise(F.regexp_extract(evidence, AMOUNT_AFTER, j))
    unit, code = F.lower(pick(2, 3)), pick(3, 1)
    number = F.replace(F.regexp_replace(pick(1, 2), "[  ]", ""), F.lit(","), F.lit(".")).try_cast("double")
    return F.struct((number * first([(1e9, unit.isin("milliard", "bn")), (1e6, unit != "")], 1.0)).alias("amount"), first([("EUR", code == "€"), ("USD", code == "$"), (None, code == "")], F.upper(code)).alias("currency"))


def programmes(items: DataFrame, domains: list[str], funders: dict[str, str]) -> DataFrame:
    """Funding programmes on readable hosts.  ``items`` may have raw (a donor's own record, JSON text), which then gives the evidence and the figures.

    Direct access needs words of eligibility; without a funder there is no programme.  id, rejected, program, funder,
    letter, status, mode, eligibility, amount, currency, beneficiary, territory, sector, strategic, summary, closing,
    project, official_url.
    """
    raw = lambda k: F.nullif(F.get_json_object("raw", f"$.{k}"), F.lit(""))
    flat = F.from_json("raw", "map<string,string>")
    sectors = F.array_join(F.transform(F.filter(F.array_sort(F.map_entries(flat)), lambda e: F.startswith(e["key"], F.lit("sector")) & F.startswith(e["value"], F.lit("{"))), lambda e: F.coalesce(F.get_json_object(e["value"], "$.Name"), F.lit(""))), " ")
    themes = F.array_join(F.transform(F.from_json(raw("mjtheme_namecode"), "array<struct<name:string>>"), lambda x: F.coalesce(x["name"], F.lit(""))), " ")
    structured = F.coalesce(raw("project_name"), raw("id"), raw("projectstatusdisplay")).isNotNull()
    told = items.withColumn("_said", F.when(structured, _both(*[raw(k) for k in DONOR_TEXT], sectors, themes)).otherwise(F.coalesce(F.nullif("evidence", F.lit("")), F.col("title"), F.lit("")))).withColumn("_raw", structured)
    host = urls.domain(F.col("url"))
    own = first([(name, (host == d) | F.endswith(host, F.lit(f".{d}"))) for d, name in funders.items()], F.nullif(F.trim("institution"), F.lit(""))) if funders else F.nullif(F.trim("institution"), F.lit(""))
    found = told.withColumns({"s": rules.funding(_both(F.col("title"), F.col("_said"))), "funder": own, "m": _money(F.col("_said"))})
    s, excerpt = F.col("s"), F.left(_squeezed(F.col("_said")), F.lit(MOST_TEXT))
    direct = (s["mode"] == "DIRECT_ACCESS") & part(fold_text(excerpt), ELIGIBLE)
    mode = F.when((s["mode"] == "DIRECT_ACCESS") & ~direct, "MONITORING_ONLY").otherwise(s["mode"])
    state = fold_text(F.coalesce(raw("projectstatusdisplay"), raw("status")))
    total = F.replace(F.coalesce(raw("totalamt"), raw("totalcommamt")), F.lit(","), F.lit("")).try_cast("double")
    status = F.when(F.col("_raw") & (state == "active"), "active").when(F.col("_raw") & state.isin("closed", "completed"), "closed").otherwise(s["status"])
    sector = F.nullif(F.array_join(F.filter(F.array(*[F.lit(x) for x in SECTORS]), lambda x: F.contains(fold_text(excerpt), x)), ", "), F.lit(""))
    return found.select(
        "id", first([("not_readable", ~urls.domain_match(F.col("url"), domains)), ("outside_scope", s.isNull()), ("no_funder", F.col("funder").isNull())]).alias("rejected"), F.left("title", F.lit(500)).alias("program"), "funder",
        F.when(F.col("_raw") & (state == "active"), "B").otherwise(s["letter"]).alias("letter"), status.alias("status"), mode.alias("mode"), F.when(direct, excerpt).alias("eligibility"),
        F.when(F.col("_raw"), total).otherwise(F.col("m.amount")).alias("amount"), F.when(F.col("_raw"), F.when(total.isNotNull(), "USD")).otherwise(F.col("m.currency")).alias("currency"),
        F.when(F.col("_raw"), F.coalesce(raw("borrower"), raw("impagency"))).otherwise(F.col("institution")).alias("beneficiary"), F.coalesce(raw("countryshortname"), raw("country_name")).alias("territory"), sector.alias("sector"),
        (F.coalesce(s["status"] != "closed", F.lit(True)) | part(fold_text(excerpt), STRATEGIC)).alias("strategic"), excerpt.alias("summary"), F.when(F.col("_raw"), date_of(raw("closingdate"))).alias("closing"), F.when(F.col("_raw"), raw("id")).alias("project"), F.col("url").alias("official_url"),
    )
