"""Interleaved document sequences: ordered text and media references, resolved by digest.

``interleave`` parses HTML into one ordered array of items per page; each item
is text or a reference (``src``, digest, caption), so positions and captions
stay aligned whatever later happens to the payloads.  ``store`` turns payloads
into a stored lossless media form named by its digest, ``measure`` reads stored
bytes back, and ``resolve`` joins references to measured media by digest.

Scale: parsing and measuring are narrow; payload bytes never enter a shuffle,
only digests and measurements do.  Copies of one payload are pre-aggregated to
one row per digest before the join, so a digest that a third of all rows refer
to meets one media row, and the join splits skewed reference partitions (AQE).

Defined results: null HTML is an empty sequence; a reference without a known
digest keeps its place with a null payload; a null payload is empty bytes (and
padded like them); repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from . import _text
from ._spark import annotate, free_name

UNIT = 64
ITEM = StructType([StructField("position", IntegerType()), StructField("kind", StringType()), StructField("text", StringType()), StructField("src", StringType()), StructField("digest", StringType()), StructField("caption", StringType())])
SEQUENCE = StructType([StructField("items", ArrayType(ITEM))])
MEASURES = StructType([StructField("media_sha256", StringType()), StructField("n_bytes", LongType()), StructField("payload_bytes", LongType()), StructField("payload_sha256", StringType()), StructField("tail_crc32", LongType()), StructField("media_bytes", LongType()), StructField("feature", StringType())])

_MEDIA = {"img": "image", "video": "video", "audio": "audio", "iframe": "frame"}
_BREAKS = set("p div br li ul ol tr td th table h1 h2 h3 h4 h5 h6 article section header footer figure blockquote pre hr title nav".split())
_HIDDEN = {"script", "style", "noscript", "template"}


class _Sequence(HTMLParser):
    """Items in document order; a figcaption belongs to the references of its figure, else ``alt`` is the caption.

    A source is of the kind of its open video or audio.  A caption ends with its figure at the latest; in a figure
    without references, or outside of any, it is a text item in its place.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.words: list[str] = []
        self.hidden = 0
        self.figures: list[dict] = []
        self.playing: list[str] = []

    def item(self, kind, said=None, src=None, digest=None, caption=None):
        return {"position": None, "kind": kind, "text": said, "src": src, "digest": digest, "caption": caption}

    def flush(self):
        said = " ".join("".join(self.words).split())
        self.words = []
        if said:
            self.items.append(self.item("text", said))

    def settle(self):
        """The innermost figure ends."""
        self.flush()
        f = self.figures.pop()
        said = " ".join("".join(f["said"]).split())
        for x in f["items"]:
            x["caption"] = said or x["caption"]
        if said and not f["items"]:
            self.items.insert(f["place"], self.item("text", said))

    def handle_starttag(self, tag, attrs):
        if tag in _HIDDEN:
            self.hidden += 1
        if tag in _BREAKS or tag == "figcaption":
            self.flush()
        if tag == "figure":
            self.figures.append({"items": [], "said": [], "place": len(self.items), "open": False})
        if tag == "figcaption" and self.figures:
            f = self.figures[-1]
            f["place"] = f["place"] if f["said"] else len(self.items)
            f["open"] = True
            f["said"].append(" ")
        a = dict(attrs)
        kind = self.playing[-1] if tag == "source" and self.playing else _MEDIA.get(tag)
        if tag in ("video", "audio"):
            self.playing.append(tag)
        if kind and (a.get("src") or a.get("data-digest")):
            self.flush()
            src = a.get("src")
            digest = a.get("data-digest") or (src[7:] if src and src.startswith("sha256:") else None)
            self.items.append(self.item(kind, None, src, digest, a.get("alt") or None))
            if self.figures:
                self.figures[-1]["items"].append(self.items[-1])

    def handle_endtag(self, tag):
        if tag in _HIDDEN and self.hidden:
            self.hidden -= 1
        if tag in self.playing:
            del self.playing[len(self.playing) - 1 - self.playing[::-1].index(tag) :]
        if tag == "figcaption":
            self.flush()
            if self.figures:
                self.figures[-1]["open"] = False
        if tag in _BREAKS:
            self.flush()
        if tag == "figure" and self.figures:
            self.settle()

    def handle_data(self, data):
        if not self.hidden:
            (self.figures[-1]["said"] if self.figures and self.figures[-1]["open"] else self.words).append(data)

    def close(self):
        super().close()
        while self.figures:
            self.settle()
        self.flush()
        for i, x in enumerate(self.items):
            x["position"] = i


def parse(html: str | None) -> list[dict]:
    p = _Sequence()
    p.feed(html or "")
    p.close()
    return p.items


def interleave(pages: DataFrame, html: str = "html", keep: list[str] | None = None) -> tuple[DataFrame, str]:
    """``pages`` with a struct column (its name is returned) whose ``items`` are the page's ordered sequence."""

    def kernel():
        return lambda part: {"items": [parse(x) for x in part.column(0).to_pylist()]}

    return annotate(pages, kernel, SEQUENCE, keep, text=html)


def encode(text: bytes) -> bytes:
    """The stored form: a binary portable graymap of 8-bit samples, ``UNIT`` wide, zero-padded to whole rows."""
    padded = text + bytes(-len(text) % UNIT if text else UNIT)
    return b"P5\n%d %d\n255\n" % (UNIT, len(padded) // UNIT) + padded


def decode(media: bytes) -> bytes:
    """The samples of a stored graymap."""
    magic, size, depth, samples = media.split(b"\n", 3)
    wide, high = map(int, size.split())
    if magic != b"P5" or depth != b"255" or len(samples) != wide * high:
        raise ValueError("not a graymap of 8-bit samples")
    return samples


def features(samples: bytes) -> str:
    """Size, mean, deviation, and energy of the first row differences, as text."""
    x = np.frombuffer(samples, np.uint8).reshape(-1, UNIT)
    step = np.diff(x.astype(np.int16), axis=1)
    return f"{x.shape[1]}x{x.shape[0]};{x.mean():.4f};{x.std():.4f};{np.abs(step).mean():.4f}"


def measure(media: bytes, n_bytes: int) -> dict:
    samples = decode(media)
    return {"media_sha256": hashlib.sha256(media).hexdigest(), "n_bytes": n_bytes, "payload_bytes": len(samples), "payload_sha256": hashlib.sha256(samples).hexdigest(), "tail_crc32": zlib.crc32(samples[-UNIT:]), "media_bytes": len(media), "feature": features(samples)}


def store(docs: DataFrame, text: str = "text") -> DataFrame:
    """The stored media of a text column, one row each: digest, media."""
    media = StructType([StructField("digest", StringType()), StructField("media", BinaryType()), StructField("n_bytes", LongType())])

    def kernel():
        def work(part):
            texts = [(x or "").encode() for x in part.column(0).to_pylist()]
            stored = [encode(x) for x in texts]
            return {"digest": [hashlib.sha256(m).hexdigest() for m in stored], "media": stored, "n_bytes": [len(x) for x in texts]}

        return work

    df, name = annotate(docs, kernel, media, keep=[], text=text)
    return df.select(f"{name}.*")


def measured(media: DataFrame) -> DataFrame:
    """One row per digest of a stored media table (digest, media, n_bytes): its measurements, read back from the bytes."""

    def run(batches):
        for b in batches:
            rows = [measure(m, n) for m, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, schema=out)

    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(MEASURES)
    each = media.select("media", "n_bytes").mapInArrow(run, MEASURES)
    # a digest may come from texts that differ in trailing zero bytes only; the length is part of the key
    return each.groupBy("media_sha256", "n_bytes").agg(*[F.min(c).alias(c) for c in MEASURES.names if c not in ("media_sha256", "n_bytes")])


def resolve(items: DataFrame, media: DataFrame, digest: str = "digest", n_bytes: str | None = None) -> DataFrame:
    """Rows of ``items`` (one per reference) left-joined to measured ``media`` by digest; order columns stay as they are."""
    name = free_name(items, "media")
    m = media.select(F.struct(*media.columns).alias(name))
    on = F.col(f"`{digest}`") == F.col(name)["media_sha256"]
    return items.join(m, on & (F.col(f"`{n_bytes}`") == F.col(name)["n_bytes"]) if n_bytes else on, "left")


def as_page(docs: DataFrame) -> DataFrame:
    """Each document as a small page: its stored form referred to by digest between two captions."""
    fields = StructType([StructField("html", StringType())])

    def kernel():
        def work(part):
            made = []
            for x in part.column(0).to_pylist():
                raw = (x or "").encode()
                made.append(f'<p>document</p><figure><img src="sha256:{hashlib.sha256(encode(raw)).hexdigest()}"><figcaption>{len(raw)}</figcaption></figure>')
            return {"html": made}

        return work

    df, name = annotate(docs, kernel, fields, keep=["doc_id"])
    return df.select("doc_id", F.col(name)["html"].alias("html"))


def query(docs: DataFrame) -> DataFrame:
    """Digest columns per document: its page is parsed, its reference resolved, its caption gives the length it must have."""
    pages, s = interleave(as_page(docs), keep=["doc_id"])
    refs = pages.select("doc_id", F.explode(F.col(s)["items"]).alias("item")).filter("item.kind = 'image'").select("doc_id", F.col("item.digest").alias("digest"), F.col("item.caption").cast("long").alias("said"))
    got = resolve(refs, measured(store(docs)), n_bytes="said")
    return got.select("doc_id", *[F.col("media")[c].alias(c) for c in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")])
