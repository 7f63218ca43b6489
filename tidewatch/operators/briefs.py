"""Search briefs: a sentence of a user becomes the parameters of a query.

A brief is one short text per question, read once where the query is composed; what it yields - terms, places, a range
of days - goes into Columns (``rules.targeted_score``, ``conditions.in_range``).
"""

from __future__ import annotations

import calendar
import re
import unicodedata
from datetime import date, timedelta

from ..functions import lexicons as L

_NAMES = "|".join(L.MONTHS)
_LIST_FIELDS = ["topics", "related", "places", "documents", "wanted", "excluded", "modes"]


def fold(text: str | None) -> str:
    t = unicodedata.normalize("NFKD", text or "").casefold()
    return " ".join(re.sub(r"[^a-z0-9؀-ۿ]+", " ", "".join(c for c in t if not unicodedata.combining(c))).split())


def _holds(folded: str, phrase: str) -> bool:
    return f" {fold(phrase)} " in f" {folded} "


def days(text: str, today: date) -> tuple[date | None, date | None, str]:
    """(since, until, mode) that a brief names: two days, years, a day or month (since, before or in it), today, this week, recently."""
    t = fold(text)
    day = rf"(\d{{1,2}})(?:er)? ({_NAMES}) (20\d{{2}})"
    point = lambda d, m, y: date(int(y), L.MONTHS.index(m) + 1, int(d))
    since = until = None
    mode = "DEFAULT"
    if m := re.search(rf"\bentre {day} et {day}\b", t):
        since, until, mode = point(*m.groups()[:3]), point(*m.groups()[3:]), "EXPLICIT"
    elif m := re.search(r"\b(20\d{2})(?: a | au | )(20\d{2})\b", t):
        since, until, mode = date(int(m[1]), 1, 1), date(int(m[2]), 12, 31), "ARCHIVE"
    elif m := re.search(rf"(?:\b(depuis|avant) )?(?:\ble )?\b{day}\b", t):
        at, mode = point(*m.groups()[1:]), "EXPLICIT"
        since, until = {"avant": (None, at), "depuis": (at, None)}.get(m[1], (at, at))
    elif m := re.search(rf"(?:\b(depuis|avant) )?\b({_NAMES}) (20\d{{2}})\b", t):
        year, number, mode = int(m[3]), L.MONTHS.index(m[2]) + 1, "EXPLICIT"
        low, high = date(year, number, 1), date(year, number, calendar.monthrange(year, number)[1])
        since, until = {"avant": (None, high), "depuis": (low, None)}.get(m[1], (low, high))
    elif "aujourd hui" in t:
        since, until, mode = today, today, "CURRENT"
    elif "cette semaine" in t:
        since, until, mode = today - timedelta(days=today.weekday()), today, "CURRENT"
    elif "recent" in t:
        since, mode = today - timedelta(days=90), "RECENT"
    return since, until, "ARCHIVE" if "archive" in t else mode


def place(text: str) -> tuple[str | None, list[str]]:
    """The place that a brief names with its other names: a known one, else the capitalised words after a preposition."""
    t = fold(text)
    for name, aliases in L.PLACES.items():
        if any(_holds(t, a) for a in aliases):
            return name, list(dict.fromkeys([name, *aliases]))
    if m := re.search(r"\b(?:à|au|aux|dans|sur)\s+([A-ZÀ-ÖØ-Ý][\w’' -]{1,60})", text):
        said = re.split(r"\b(?:depuis|avant|entre|avec|sans|pour)\b", m[1], maxsplit=1)[0].strip(" -")
        if said:
            return said, [said]
    return None, []


def interpret(text: str, today: date) -> dict:
    """Parameters of a brief of 3 to 4,000 characters."""
    if not 3 <= len((text or "").strip()) <= 4000:
        raise ValueError("a brief has 3 to 4000 characters")
    t = fold(text)
    modes = [m for m, terms in L.BRIEF_MODES.items() if any(fold(x) in t for x in terms)]
    topics = [k for k in L.BRIEF_TOPICS if k in t or (k == "muraille" and "rempart" in t)]
    related = list(dict.fromkeys(x for k in topics for x in L.BRIEF_TOPICS[k]))
    since, until, recency = days(text, today)
    where, names = place(text)
    out = re.search(r"\b(?:exclus|exclure|sans) (.+)", t)
    mode = modes[0] if len(modes) == 1 else "MIXED" if modes else "ARTICLES"
    return {
        "mode": mode, "modes": modes or ["ARTICLES"], "topics": topics or [text.strip()[:120]], "related": related, "place": where, "places": names,
        "since": since, "until": until, "recency": recency, "documents": [d for d in L.BRIEF_DOCUMENTS if _holds(t, d)],
        "wanted": list(dict.fromkeys([*topics, *related])), "excluded": [out[1][:200]] if out else [],
        "open_only": mode == "PROCUREMENT" and recency != "ARCHIVE",
        "unclear": ("patrimoine" in t or "heritage" in t) and not modes,
    }


def refine(before: dict, text: str, today: date) -> dict:
    """A brief with a second sentence added: lists grow in order, what the sentence names anew replaces the rest."""
    now, t = interpret(text, today), fold(text)
    named = [x for xs in L.BRIEF_TOPICS.values() for x in xs if fold(x) in t]
    out = dict(before)
    for k in _LIST_FIELDS:
        plain = k == "topics" and not any(x in t for x in L.BRIEF_TOPICS)  # a sentence that is no topic by itself
        fresh = [] if plain or (k == "modes" and now["modes"] == ["ARTICLES"] and "article" not in t) else now[k]
        out[k] = list(dict.fromkeys([*before[k], *fresh, *(named if k == "wanted" else [])]))
    if now["place"]:
        out |= {"place": now["place"], "places": now["places"]}
    if now["since"] or now["until"] or now["recency"] != "DEFAULT":
        out |= {k: now[k] for k in ("since", "until", "recency")}
    out["mode"] = out["modes"][0] if len(out["modes"]) == 1 else "MIXED"
    return out


def recency_days(brief: dict, today: date) -> int | None:
    """Days back that a search should look; None for all of them."""
    return max(1, (today - brief["since"]).days) if brief["since"] and brief["since"] <= today else None
