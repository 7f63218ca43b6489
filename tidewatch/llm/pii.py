"""Offset-preserving deobfuscation of personal data.

A transducer rewrites a text into plain form - homoglyphs and full-width forms
to ASCII, invisible characters dropped, spelled digits to digits, at/dot
disguises to ``@`` and ``.`` - and keeps for every output character the source
span it came from.  Identifiers are detected in the source (base spans) and in
the plain form; spans of the plain form map back to source characters.

Scale: one narrow pass, no shuffle; texts without any trigger byte or word
never become Python strings.

Defined results: a null text is empty and has no spans; offsets count code
points, end exclusive; a span found in both forms is reported once; an added
span that overlaps a base span of its kind is dropped; repeated rows repeat; an
empty table gives no rows; columns of any name pass through; a text of any length
takes time in proportion to it and to its spans.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from . import _text
from ._spark import annotate

KINDS = ("email", "ip", "card", "phone")
SPAN = StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("base", BooleanType())])
FIELDS = StructType([StructField("spans", ArrayType(SPAN))])

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits can only match from its first digit, so the look-behind changes nothing but the time
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses, from one look to both sides of each @."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def detect(text: str) -> list[tuple[str, int, int]]:
    """Valid identifiers of a text by kind, then place."""
    out = [("email", a, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def _homoglyphs() -> dict[str, str]:
    t = {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)}  # full-width forms
    t["　"] = " "
    # fixed values: Cyrillic and Greek letters that look like Latin ones
    t |= dict(zip("аеорсхуіјѕһԁ", "aeopcxyijshd", strict=True))
    t |= dict(zip("АВЕКМНОРСТХІЈЅ", "ABEKMHOPCTXIJS", strict=True))
    t |= dict(zip("οναρΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ovapABEZHIKMNOPTYX", strict=True))
    for base in (0x0660, 0x06F0, 0x0966):  # Arabic-Indic, extended and Devanagari digits
        t |= {chr(base + i): str(i) for i in range(10)}
    t |= {chr(0x2460 + i): str(i + 1) for i in range(9)} | {"⓪": "0", "⁰": "0", "¹": "1", "²": "2", "³": "3"}
    t |= {chr(0x2074 + i): str(i + 4) for i in range(6)} | {chr(0x2080 + i): str(i) for i in range(10)}
    for base in range(0x1D7CE, 0x1D800, 10):  # mathematical digits
        t |= {chr(base + i): str(i) for i in range(10)}
    for base in range(0x1D400, 0x1D6A4, 52):  # mathematical letters
        t |= {chr(base + i): chr((65 if i < 26 else 71) + i) for i in range(52)}
    t |= {"․": ".", "。": ".", "｡": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", " ": " ", " ": " ", " ": " "}
    return t


HOMOGLYPHS = _homoglyphs()
INVISIBLE = frozenset("­​‌‍‎‏⁠﻿")
DIGITS = {w: str(i) for i, w in enumerate("zero one two three four five six seven eight nine".split())}
_WORD = "zero|one|two|three|four|five|six|seven|eight|nine"
_SPELLED = re.compile(rf"(?<![A-Za-z])(?:plus[ -]+)?(?:{_WORD})(?:[ ,.-]{{1,2}}(?:{_WORD}|[0-9]+))*(?![A-Za-z])", re.I)
_PIECE = re.compile(rf"plus|{_WORD}|[0-9]+", re.I)
_BRACKETED = re.compile(r" ?[(\[{<] ?(at|dot) ?[)\]}>] ?", re.I)
# searched from its sign: what stands before it needs one character of a local part only, so a long run costs nothing
_LOOSE = re.compile(r"(?<=[A-Za-z0-9._%+-])(?:(?: at |@)[A-Za-z0-9-]+(?:(?: dot |\.)[A-Za-z0-9-]+)* dot [A-Za-z]{2,}(?![A-Za-z0-9])| at [A-Za-z0-9-]+(?:(?: dot |\.)[A-Za-z0-9-]+)+)", re.I)
_LOOSE_SIGN = re.compile(r" (at|dot) ", re.I)
_MAP = str.maketrans(HOMOGLYPHS | dict.fromkeys(INVISIBLE))
_GONE = np.array(sorted(map(ord, INVISIBLE)), np.uint32)


class Plain:
    """A plain form in the making: its text, and for each character the source span it stands for."""

    def __init__(self, text: str):
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.text = text.translate(_MAP)
        self.start = np.flatnonzero(~np.isin(points, _GONE))
        self.end = self.start + 1

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace ascending, disjoint ranges; each new character stands for the whole range's source."""
        if not edits:
            return
        said, start, end, at = [], [], [], 0
        for a, b, new in edits:
            said += [self.text[at:a], new]
            start += [self.start[at:a], np.repeat(self.start[a], len(new))]
            end += [self.end[at:a], np.repeat(self.end[b - 1], len(new))]
            at = b
        self.text = "".join([*said, self.text[at:]])
        self.start, self.end = np.concatenate([*start, self.start[at:]]), np.concatenate([*end, self.end[at:]])


def loose(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses in words, each from its sign on; its local part may not lie in the one before."""
    out, at, free = [], 0, 0
    while m := _LOOSE.search(text, at):
        if m.start() > free or not out:
            out.append(m.span())
            at = free = m.end()
        else:
            at = m.start() + 1
    return out


def plain(text: str) -> Plain:
    p = Plain(text)
    edits = []
    for m in _SPELLED.finditer(p.text):
        pieces = list(_PIECE.finditer(m[0]))
        if sum(w[0].lower() in DIGITS for w in pieces) < 3:
            continue
        off = m.start()
        for w, nxt in zip(pieces, [*pieces[1:], None], strict=True):
            new = "+" if w[0].lower() == "plus" else DIGITS.get(w[0].lower(), w[0])
            if w[0] != new:
                edits.append((off + w.start(), off + w.end(), new))
            if nxt and nxt.start() > w.end():
                edits.append((off + w.end(), off + nxt.start(), ""))
    p.rewrite(edits)
    p.rewrite([(m.start(), m.end(), "@" if m[1].lower() == "at" else ".") for m in _BRACKETED.finditer(p.text)])
    now = p.text
    p.rewrite([(*s.span(), "@" if s[1].lower() == "at" else ".") for a, b in loose(now) for s in _LOOSE_SIGN.finditer(now, a, b)])
    return p


def find(text: str, disguised: bool = True) -> list[tuple[str, int, int, bool]]:
    """All spans (kind, start, end, base) by kind as listed, then start."""
    base = detect(text)
    spans = [(*s, True) for s in base]
    if disguised:
        p = plain(text)
        now = p.text
        if now != text:
            starts, ends = ({k: [s[i] for s in base if s[0] == k] for k in KINDS} for i in (1, 2))
            free = dict.fromkeys(KINDS, 0)
            for k, a, b in detect(now):  # ascending per kind, and so are their sources
                s, e = int(p.start[a]), int(p.end[b - 1])
                near = bisect_right(ends[k], s)  # the first base span that ends behind s
                met = s < free[k] or (near < len(ends[k]) and starts[k][near] < e)
                if not met and text[s:e] != now[a:b]:
                    free[k] = e
                    spans.append((k, s, e, False))
    return sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1]))


_SIGNS = np.zeros(256, bool)
_SIGNS[[ord("@"), ord("+")]] = True
_SIGNS[48:58] = True
_LEADS = np.zeros(256, bool)  # first bytes of the characters that the transducer maps, Latin letters aside
_LEADS[[0xC2, 0xCE, 0xCF, 0xD0, 0xD1, 0xD2, 0xD3, 0xD4, 0xD9, 0xDB, 0xE0, 0xE2, 0xE3, 0xEF, 0xF0]] = True
# all that plain() rewrites in a text without mapped characters: of three spelled digits in a row the second stands between
# separators, before a spelled digit (its first letter may be a long s) or a numeral; what follows a sign is only looked at,
# so a match never takes bytes that another one needs
_TRIGGER = re.compile(rb"(?<=[ ,.-])(?:zero|one|two|three|four|five|six|seven|eight|nine)(?=[ ,.-]{1,2}[0-9efnostz\x80-\xff])|[(\[{<] ?(?:at|dot) ?[)\]}>]| dot(?= )| at(?= [a-z0-9\x80-\xff-]+\.[a-z0-9\x80-\xff-])")


def _rows(mask: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Rows in which the byte mask holds anywhere."""
    at = np.flatnonzero(mask)
    return np.searchsorted(at, offs[1:], "left") > np.searchsorted(at, offs[:-1], "left")


def _found(col: pa.Array) -> Iterator[tuple[int, str, list]]:
    """Row, text and spans of each text that may hold any."""
    data, offs = _text.flat(col)
    odd = _rows(_LEADS[data], offs)
    for m in _TRIGGER.finditer(_text.LOWER[data].tobytes()):
        odd[np.searchsorted(offs, m.start(), "right") - 1] = True
    for i in np.flatnonzero(odd | _rows(_SIGNS[data], offs)):
        text = col[int(i)].as_py() or ""
        yield int(i), text, find(text, bool(odd[i]))


def _kernel():
    def work(part: pa.RecordBatch) -> dict:
        out: list[list] = [[] for _ in range(part.num_rows)]
        for i, _, spans in _found(part.column(0)):
            out[i] = [{"kind": k, "start": a, "end": b, "base": base} for k, a, b, base in spans]
        return {"spans": out}

    return work


def redacted(text: str, spans: list[tuple[str, int, int, bool]]) -> str:
    """Spans replaced by their kind in brackets; one that starts inside an earlier one is covered with it."""
    said, at = [], 0
    for a, b, k in sorted((a, b, k) for k, a, b, _ in spans):
        if a >= at:
            said += [text[at:a], f"[{k.upper()}]"]
        at = max(at, b)
    return "".join([*said, text[at:]])


def _redactor():
    def work(part: pa.RecordBatch) -> dict:
        out: list[str | None] = [None] * part.num_rows
        for i, text, spans in _found(part.column(0)):
            if spans:
                out[i] = redacted(text, spans)
        return {"text": out}

    return work


def find_pii(docs: DataFrame, keep: list[str] | None = None) -> tuple[DataFrame, str]:
    """``docs`` with a struct column (its name is returned) holding the ``spans`` of personal data."""
    return annotate(docs, _kernel, FIELDS, keep)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in brackets; ``n_chars``, where present, follows."""
    marked, f = annotate(docs, _redactor, StructType([StructField("text", StringType())]))
    new = F.col(f)["text"]
    out = marked.withColumn("text", F.coalesce(new, F.col("text").cast("string")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(new.isNotNull(), F.length(new).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def query(docs: DataFrame) -> DataFrame:
    """Digest columns per document."""
    marked, f = find_pii(docs, keep=["doc_id"])
    spans = F.col(f)["spans"]
    said = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter(spans, lambda s: s["base"])
    of = lambda k: F.filter(base, lambda s: s["kind"] == k)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return marked.select("doc_id", *counts, F.sha2(said(base), 256).alias("base_sha256"), said(spans).alias("spans"))
