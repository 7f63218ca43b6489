"""Relevance of procurement notices: three tracks (heritage, architectural competitions, major architecture) as one Column.

A notice's text is folded once, every term list is looked up once, and the decision is the first row of a table of
conditions that holds.  No row leaves code generation; a notice costs some forty expressions on its title.

A null text, procedure or amount is empty or unknown.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import procurement_terms as T
from ..functions import urls
from .notices import notice_text, once, with_equivalents
from .rules import first, reasons

#: Reason of each rejection of the heritage track, as the whole decision names it.
_CODES = {
    "non_patrimonial_purchase": "REJECT_IRRELEVANT_DOMAIN",
    "natural_heritage_only": "REJECT_IRRELEVANT_DOMAIN",
    "topography_only": "REJECT_OUT_OF_SCOPE_INFRASTRUCTURE",
    "generic_construction_or_infrastructure": "REJECT_OUT_OF_SCOPE_INFRASTRUCTURE",
    "generic_work_in_historic_location": "REJECT_OUT_OF_SCOPE_INFRASTRUCTURE",
    "no_heritage_scope": "REJECT_NO_HERITAGE_OR_ARCHITECTURE_CONTEXT",
}


def corpus(*parts: Column) -> Column:
    """Folded text of title and scope, with a space at both ends, French equivalents of Arabic terms added."""
    bare = once(notice_text(F.concat_ws(" ", *parts)), with_equivalents)
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(bare, r"[_\s]+", " ")), F.lit(" "))


def any_of(padded: Column, terms: list[str]) -> Column:
    """Whether a padded text holds one of the terms as whole words."""
    return padded.rlike(" (?:" + "|".join(dict.fromkeys(terms)) + ") ")


def signs(t: Column, procedure: Column) -> Column:
    """Which term lists a text meets."""
    lone_ksar = any_of(t, ["ksar sghir"]) & ~any_of(t, ["du ksar"])  # a town's name, not a fortress
    without = lambda terms: F.when(lone_ksar, any_of(t, [x for x in terms if x != "ksar"])).otherwise(any_of(t, terms))
    lists = {
        "professional": T.PROFESSIONAL, "works": T.PURE_WORKS, "execution": T.EXECUTION, "negative": T.NEGATIVE, "assets_managed": T.ASSET_MANAGEMENT,
        "infrastructure": T.INFRASTRUCTURE, "topography": T.TOPOGRAPHY, "fabric": T.OLD_FABRIC, "rescue": T.ARCHITECTURE_RESCUE,
        "scope": T.ARCHITECTURAL_SCOPE, "role": T.ARCHITECTURAL_ROLE, "heritage_work": T.HERITAGE_WORK, "built_work": T.BUILT_WORK, "generic": T.GENERIC_WORK,
        "broad": T.BROAD_CONTEXT, "broad_work": T.BROAD_WORK, "natural": T.NATURAL, "natural_excuse": T.NATURAL_EXCUSE, "facility": T.VISITOR_FACILITY,
        "plain_study": T.PLAIN_STUDY, "old_built": T.OLD_BUILT, "urban_study": T.URBAN_STUDY, "heritage_study": T.HERITAGE_STUDY, "competition": T.COMPETITION,
        "major_asset": T.MAJOR_ASSETS, "major_scale": T.MAJOR_SCALE, "routine": T.ROUTINE, "ordinary": T.ORDINARY, "heritage_project": T.ORDINARY_RESCUE,
    }
    special = {
        "asset": without(T.HERITAGE_ASSETS),
        "built": without(T.BUILT_HERITAGE),
        "any_asset": any_of(t, T.HERITAGE_ASSETS + T.BUILT_HERITAGE),
        "patrimonial": any_of(t, T.PATRIMONIAL_ARCHITECTURE) | (any_of(t, T.PATRIMONIAL) & any_of(t, T.ARCHITECTURE_RESCUE)),
        "historic_structure": any_of(t, T.STRUCTURES) & any_of(t, T.HISTORIC) & any_of(t, T.HERITAGE_WORK),
        "religious": any_of(t, T.RELIGIOUS) & any_of(t, T.RELIGIOUS_HERITAGE),
        "starts_as_works": t.rlike("^ (?:" + "|".join(T.EXECUTION_START) + r")\b"),
        "works_procedure": any_of(F.concat(F.lit(" "), notice_text(procedure), F.lit(" ")), ["travaux"]),
    }
    return F.struct(*[any_of(t, terms).alias(n) for n, terms in lists.items()], *[c.alias(n) for n, c in special.items()])


def pure_execution(s: Column) -> Column:
    """Works without any service of an architect or adviser."""
    return ~s["professional"] & (s["works"] | s["execution"] | s["starts_as_works"] | s["works_procedure"])


def heritage(s: Column) -> Column:
    """Struct (decision, reason): what the heritage track alone would say."""

    def combined(s: Column) -> Column:
        direct = ((s["built"] | s["fabric"]) & s["built_work"]) | s["patrimonial"] | s["religious"] | s["historic_structure"]
        facility = s["facility"] & (s["broad"] | s["built"] | s["fabric"])
        explicit = (s["heritage_work"] & (s["built"] | s["fabric"])) | (s["fabric"] & (s["rescue"] | s["scope"] | s["plain_study"]))
        return F.struct(s.alias("s"), direct.alias("direct"), facility.alias("facility"), ((s["broad"] & s["broad_work"] & ~direct) | (facility & ~direct)).alias("wider"), explicit.alias("explicit"))

    def judged(c: Column) -> Column:
        s, direct, facility, wider, explicit = c["s"], c["direct"], c["facility"], c["wider"], c["explicit"]
        bought, natural = s["negative"] | s["assets_managed"], s["natural"] & ~s["natural_excuse"]
        reason = first([
            ("non_patrimonial_purchase", bought),
            ("natural_heritage_only", natural),
            ("topography_only", s["topography"] & ~(direct & s["rescue"])),
            ("no_heritage_scope", ~(direct | wider)),
            ("generic_construction_or_infrastructure", s["generic"] & ~explicit & ~facility),
            ("generic_work_in_historic_location", s["generic"] & s["fabric"] & ~s["asset"] & ~explicit),
        ])
        loose = ~s["heritage_work"] & ~explicit
        adjacent = (
            (s["fabric"] & ~s["built"] & loose) | (s["old_built"] & ~s["asset"] & loose) | (s["fabric"] & s["urban_study"])
            | s["topography"] | (facility & ~direct) | (wider & ~s["heritage_study"])
        )
        return F.struct(first([("reject", reason.isNotNull()), ("review", adjacent)], "keep").alias("decision"), reason.alias("reason"))

    return once(once(s, combined), judged)


def outside_infrastructure(s: Column) -> Column:
    """Roads, networks and surveys, unless old fabric or a large building comes with a service for it."""
    old = s["fabric"] | s["any_asset"]
    saved = ((old | s["major_asset"]) & (s["rescue"] | s["scope"] | s["professional"])) | (old & s["heritage_work"])
    return (s["infrastructure"] | s["topography"]) & ~saved


def relevance(title: Column, scope: Column, procedure: Column, amount: Column, verified: Column, large: float = T.LARGE_ESTIMATE) -> Column:
    """Struct (decision, category, reason, rejection, priority, score, tracks, role_fit, domain_fit, signals) of a notice.

    keep, review or reject.  ``amount`` counts only where ``verified``; ``procedure`` is a code ('competition') or words.
    """
    return once(noted(title, scope, procedure), lambda s: judged(s, procedure, amount, verified, large))


def noted(title: Column, scope: Column, procedure: Column) -> Column:
    """:func:`signs` of a title and its scope, the text put together once a row; it is most of what a decision costs."""
    return once(corpus(title, scope), lambda t: signs(t, procedure))


def judged(found: Column, procedure: Column, amount: Column, verified: Column, large: float = T.LARGE_ESTIMATE) -> Column:
    """What :func:`relevance` says, from the signs of a notice."""
    costly = F.coalesce(verified & (amount >= large), F.lit(False))

    def gathered(s: Column) -> Column:
        return F.struct(s.alias("s"), heritage(s).alias("h"))

    def tracks(g: Column) -> Column:
        s, h = g["s"], g["h"]
        infra = s["infrastructure"] | s["topography"]
        major = s["scope"] & s["major_asset"] & ~s["routine"]
        proven = major & (costly | s["major_scale"])
        contest = s["competition"] | (F.coalesce(procedure == "competition", F.lit(False)) & (s["scope"] | s["role"]))
        strategic = proven | s["major_scale"] | (costly & ~infra)
        fits = ~(infra & ~s["heritage_project"]) & ~(s["ordinary"] & ~(s["heritage_project"] | strategic)) & (s["heritage_project"] | major | strategic | s["major_asset"])
        return F.struct(
            s.alias("s"), h.alias("h"), pure_execution(s).alias("execution"), (s["negative"] | s["assets_managed"]).alias("unrelated"),
            (outside_infrastructure(s) & (h["decision"] == "reject")).alias("outside"),
            ((h["decision"] != "reject") & (~s["ordinary"] | s["heritage_project"])).alias("heritage"),
            (contest & fits).alias("contest"), proven.alias("proven"), (major & ~proven).alias("possible"),
        )

    def named(g: Column) -> Column:
        s, h = g["s"], g["h"]
        kept = h["decision"] == "keep"
        service = s["professional"]
        case = first([
            ("execution", g["execution"]), ("unrelated", g["unrelated"]), ("outside", g["outside"]),
            ("heritage", g["heritage"] & kept), ("heritage_review", g["heritage"]), ("contest", g["contest"]),
            ("major", service & g["proven"]), ("major_review", service & g["possible"]),
            ("generic", service & (s["role"] | s["scope"])), ("no_role", ~service),
        ], "no_domain")
        return F.struct(case.alias("case"), g.alias("g"))

    def said(c: Column) -> Column:
        case, g = c["case"], c["g"]
        s, h = g["s"], g["h"]
        decision = first([("keep", case.isin("heritage", "contest", "major")), ("review", case.isin("heritage_review", "major_review"))], "reject")
        legacy = F.coalesce(h["reason"], F.lit("no_heritage_scope"))
        rejection = first([
            ("pure_execution_works", case == "execution"), ("non_architectural_purchase", case == "unrelated"),
            ("topography_only", (case == "outside") & h["reason"].eqNullSafe("topography_only")), ("infrastructure_without_architecture", case == "outside"),
            ("generic_architecture_not_strategic", case == "generic"), ("no_architectural_role", case == "no_role"), (legacy, case == "no_domain"),
        ])
        reason = first([
            ("ACCEPT_HERITAGE_PROFESSIONAL_SERVICE", case == "heritage"), ("ACCEPT_ARCHITECTURAL_COMPETITION", case == "contest"), ("ACCEPT_MAJOR_ARCHITECTURAL_SERVICE", case == "major"),
            ("REVIEW_AMBIGUOUS_RELEVANCE", decision == "review"), ("REJECT_PURE_EXECUTION", case == "execution"), ("REJECT_IRRELEVANT_DOMAIN", case == "unrelated"),
            ("REJECT_OUT_OF_SCOPE_INFRASTRUCTURE", case == "outside"), ("REJECT_GENERIC_ARCHITECTURE_NOT_STRATEGIC", case == "generic"), ("REJECT_NO_ARCHITECTURAL_ROLE", case == "no_role"),
        ], first([(code, legacy == name) for name, code in _CODES.items()], "REJECT_NO_HERITAGE_OR_ARCHITECTURE_CONTEXT"))
        category = first([("P1_HERITAGE", case == "heritage"), ("P1_CONCOURS", case == "contest"), ("P1_MAJOR_ARCH", case == "major"), ("P2_REVIEW", decision == "review")], "REJECT")
        signals = reasons([(n, s[f]) for n, f in (("HERITAGE_STRONG", "built"), ("HERITAGE_BROAD", "broad"), ("OLD_FABRIC", "fabric"), ("HERITAGE_WORK", "heritage_work"), ("NEGATIVE", "negative"), ("GENERIC_WORK", "generic"), ("COMPETITION", "competition"), ("MAJOR_ASSET", "major_asset"), ("MAJOR_SCALE", "major_scale"), ("ARCHITECTURAL_SCOPE", "scope"))])
        return F.struct(
            decision.alias("decision"), category.alias("category"), reason.alias("reason"), rejection.alias("rejection"),
            first([(1, decision == "keep"), (2, decision == "review")], 3).alias("priority"),
            first([(5, decision == "keep"), (4, case == "heritage_review"), (3, case == "major_review")], -5).alias("score"),
            F.array_compact(F.array(F.when(case.isin("heritage", "heritage_review"), "HERITAGE"), F.when(case == "contest", "CONCOURS"), F.when(case.isin("major", "major_review"), "MAJOR_ARCH"))).alias("tracks"),
            first([(False, case.isin("execution", "no_role")), (s["professional"], case.isin("unrelated", "outside", "heritage"))], True).alias("role_fit"),
            (decision != "reject").alias("domain_fit"), signals.alias("signals"),
        )

    return once(once(once(once(found, gathered), tracks), named), said)


def plausible(title: Column, scope: Column) -> Column:
    """Struct (decision, reason): a first look before details are read; reject for goods, systems and pure works, else continue."""
    return once(noted(title, scope, F.lit("")), first_look)


def first_look(s: Column) -> Column:
    """What :func:`plausible` says, from the signs of a notice."""
    reason = first([("REJECT_IRRELEVANT_DOMAIN", s["negative"] | s["assets_managed"]), ("REJECT_PURE_EXECUTION", pure_execution(s))])
    return F.struct(F.when(reason.isNull(), "continue").otherwise("reject").alias("decision"), reason.alias("reason"))


def listing_plausible(title: Column, buyer: Column, procedure: Column, category: Column, location: Column, reference: Column) -> Column:
    """The same over all that a list page says, with infrastructure left out that no architecture or heritage comes with."""

    def said(s: Column) -> Column:
        architecture = s["scope"] | s["competition"] | s["role"]
        reason = first([
            ("REJECT_IRRELEVANT_DOMAIN", s["negative"] | s["assets_managed"]), ("REJECT_PURE_EXECUTION", pure_execution(s)),
            ("REJECT_OUT_OF_SCOPE_INFRASTRUCTURE", outside_infrastructure(s) & ~architecture & (heritage(s)["decision"] == "reject")),
        ])
        return F.struct(F.when(reason.isNull(), "continue").otherwise("reject").alias("decision"), reason.alias("reason"))

    return once(once(corpus(title, title, buyer, procedure, category, location, reference), lambda t: signs(t, F.lit(""))), said)


def source_role(url: Column) -> Column:
    """What a notice's address is: the official platform, a gathering site, an institution's own site; null outside the readable hosts."""
    role = first([("OFFICIAL_PROCUREMENT", urls.domain_match(url, [T.OFFICIAL_PLATFORM])), ("PROCUREMENT_AGGREGATOR", urls.domain_match(url, T.AGGREGATORS))], "OFFICIAL_INSTITUTIONAL")
    return F.when(urls.domain_match(url, T.READABLE), role)


def list_title(title: Column) -> Column:
    """Whether a title names a list of notices, not one."""
    return F.trim(corpus(title)).rlike(r"\b\d+ appels? d offres\b|\bappels d offres de services a\b|\bliste des appels\b|\bactualites\b")


_DETAIL = "entreprise.EntrepriseDetailsConsultation"
_DETAILS = ["entreprise.EntrepriseDetailConsultation", _DETAIL]


def direct_notice(url: Column) -> Column:
    """Whether an address of the official platform names one consultation."""
    place = F.lower(F.regexp_replace(urls.path(url), "/+$", ""))
    order = F.contains(place, F.lit("/bdc/entreprise/consultation/show/")) & place.rlike("/[0-9]+$")
    named = urls.parameter(url, "page").isin(_DETAILS) & urls.parameter(url, "refConsultation").rlike("^[0-9]+$")
    return urls.domain_match(url, [T.OFFICIAL_PLATFORM]) & F.coalesce(order | named, F.lit(False))


def _detail(start: Column, url: Column) -> Column:
    organisation = urls.parameter(url, "orgAcronyme")
    return F.concat(start, F.lit(f"?page={_DETAIL}&refConsultation="), urls.parameter(url, "refConsultation"), F.coalesce(F.concat(F.lit("&orgAcronyme="), F.url_encode(organisation)), F.lit("")))


def canonical_detail(url: Column) -> Column:
    """One address for each consultation, however its page was reached; any other address as it is."""
    known = direct_notice(url) & urls.parameter(url, "refConsultation").rlike("^[0-9]+$")
    return F.when(F.coalesce(known, F.lit(False)), _detail(F.lit(f"https://www.{T.OFFICIAL_PLATFORM}/index.php"), url)).otherwise(url)


def detail_of_document(url: Column) -> Column:
    """Where the consultation of an official notice or document should be found; null if the address does not name both its number and its organisation."""
    known = urls.domain_match(url, [T.OFFICIAL_PLATFORM]) & urls.parameter(url, "page").isin("entreprise.EntrepriseDownloadAvisJAL", *_DETAILS)
    known = known & urls.parameter(url, "refConsultation").rlike("^[0-9]+$") & urls.parameter(url, "orgAcronyme").rlike("^[\\p{L}\\p{N}]+$")
    return F.when(F.coalesce(known, F.lit(False)), _detail(F.regexp_extract(url, "^([^?#]*)", 1), url))


def notice_page(url: Column) -> Column:
    """Whether an address is of one notice: no search, news or list page."""

    def named(place: Column) -> Column:
        listed = place.rlike("(^|/)(blog|news|actualites?|articles?|search|recherche|category|categorie|archives|presse)(/|$)") | F.regexp_extract(place, "([^/]*)$", 1).isin(T.LIST_PAGES)
        return (place != "") & ~listed

    # few addresses have a query, whose parameters are read one by one
    searched = F.contains(url, F.lit("?")) & F.exists(urls.parameters(url), lambda x: F.lower(x["key"]).isin("s", "search", "q", "query"))
    own = once(F.lower(F.regexp_replace(urls.path(url), "^/+|/+$", "")), named) & ~searched
    good = F.when(urls.domain_match(url, [T.OFFICIAL_PLATFORM]), direct_notice(url)).otherwise(own)
    return F.coalesce(urls.scheme(url).isin("http", "https") & good, F.lit(False))
