"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A slice of texts is cut into words (a run of spaces and what follows it), equal
words are encoded once.  A word is cut where no piece of the vocabulary holds both
neighbours, as no merge can cross such a place.  All parts of a slice lie in one
flat symbol array; a round finds the best-ranked pair of every part (segmented
minimum) and merges its occurrences in all parts at once, from the left up to the
first one whose new neighbours pair as well or better, so the order of single
merges is kept; then it compacts the arrays, until no part has a pair left.
Symbols outside the vocabulary fall back to bytes.

Scale: one narrow pass, no shuffle; the vocabulary (32 thousand pieces) is the
only thing shipped to tasks, and its size does not depend on the data.

Defined results: a null or empty text has the end id alone; control strings in
a text are ordinary text; U+2581 in a text decodes to a space, as the format
has it; repeated rows repeat; an empty table gives no rows; a column ``ids`` of the
input stays and the new one takes a longer name; a text of any length is one slice,
a text without spaces takes a round per rank its longest part holds, not per merge.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from . import _text
from ._spark import annotate, free_name

SLICE = 2 << 20
ENCODE_SLICE = 1 << 19  # where whole rows of a pipeline pass beside their ids
_NONE = np.int64(1) << 40
ENCODED = StructType([StructField("ids", ArrayType(IntegerType()))])
DIGESTS = StructType([StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())])


class Vocabulary:
    """Pieces of a SentencePiece BPE model, as arrays."""

    def __init__(self, model_path: str):
        from sentencepiece import SentencePieceProcessor

        m = SentencePieceProcessor(model_file=model_path)
        n = m.get_piece_size()
        self.eos, self.unk = m.eos_id(), m.unk_id()
        special = [m.is_control(i) or m.is_unknown(i) or m.is_unused(i) for i in range(n)]
        byte = [m.is_byte(i) for i in range(n)]
        self.pieces = [m.id_to_piece(i) for i in range(n)]
        self.byte_id = np.full(256, self.unk, np.int64)
        for i in range(n):
            if byte[i]:
                self.byte_id[int(self.pieces[i][3:5], 16)] = i
        normal = {p: i for i, p in enumerate(self.pieces) if not special[i] and not byte[i]}
        self.surface = [b"" if special[i] else bytes([int(p[3:5], 16)]) if byte[i] else p.replace("▁", " ").encode() for i, p in enumerate(self.pieces)]
        # higher score first; pieces of equal score share a rank, so the leftmost wins
        score = np.array([m.get_score(i) for i in range(n)])
        self.rank = np.searchsorted(np.unique(-score), -score).astype(np.int64)
        self.char_id = np.full(0x110000, -1, np.int32)
        for p, i in normal.items():
            if len(p) == 1:
                self.char_id[ord(p)] = i
        pairs = {(normal[p[:k]] << 32) | normal[p[k:]]: i for p, i in normal.items() for k in range(1, len(p)) if p[:k] in normal and p[k:] in normal}
        self.pair_key = np.array(sorted(pairs), np.int64)
        self.pair_id = np.array([pairs[k] for k in self.pair_key.tolist()], np.int64)
        self.neighbours = np.unique(np.array([(ord(x) << 32) | ord(y) for p in normal for x, y in zip(p, p[1:])], np.int64))  # noqa: B905
        inner = [p for p in normal if "▁" in p.lstrip("▁")]
        if inner:
            raise ValueError(f"pieces that cross words can't be encoded word by word: {inner[:3]}")

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece each pair of symbols makes, or -1."""
        key = (left.astype(np.int64) << 32) | np.maximum(right, 0)
        at = np.searchsorted(self.pair_key, key)
        at[at == len(self.pair_key)] = 0
        return np.where((self.pair_key[at] == key) & (left >= 0) & (right >= 0), self.pair_id[at], -1)


def merge_rounds(sym: np.ndarray, size: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Final symbols of all words, flat, and each word's number of them.  ``sym``: start symbols; ``size``: per word, above 0."""
    word = np.arange(len(size))
    done_word, done_size, done_sym = [], [], []
    made = np.full(len(sym), -1, np.int64)
    if len(sym) > 1:
        made[:-1] = v.merged(sym[:-1], sym[1:])
    made[np.cumsum(size) - 1] = -1
    while len(word):
        first = np.cumsum(size) - size
        rank = np.where(made >= 0, v.rank[made], _NONE)
        best = np.minimum.reduceat(rank, first)
        live = best < _NONE
        if not live.all():
            keep = np.repeat(live, size)
            done_word.append(word[~live])
            done_size.append(size[~live])
            done_sym.append(sym[~keep])
            sym, made, rank = sym[keep], made[keep], rank[keep]
            word, size, best = word[live], size[live], best[live]
            if not len(word):
                break
            first = np.cumsum(size) - size
        at = np.flatnonzero(rank == np.repeat(best, size))
        owner = np.searchsorted(first, at, "right") - 1
        # of overlapping occurrences (neighbours) every second one, from the left
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (owner[1:] != owner[:-1])
        head = np.flatnonzero(new)
        pick = (np.arange(len(at)) - np.repeat(head, np.diff(np.append(head, len(at))))) % 2 == 0
        at, owner = at[pick], owner[pick]
        if len(at) > len(word):  # some word merges more than once
            pick = in_order(sym, made, at, owner, first, size, best, v)
            at, owner = at[pick], owner[pick]
        sym[at] = made[at]
        gone = np.zeros(len(sym), bool)
        gone[at + 1] = True
        size = size - np.bincount(owner, minlength=len(size))
        kept = ~gone
        place = np.cumsum(kept) - 1
        at = place[at]
        sym, made = sym[kept], made[kept]
        last = np.zeros(len(sym), bool)
        last[np.cumsum(size) - 1] = True
        near = np.zeros(len(sym), bool)
        near[at] = near[at[at > 0] - 1] = True
        made[near] = -1
        touched = np.flatnonzero(near & ~last)
        made[touched] = v.merged(sym[touched], sym[touched + 1])
    if not done_word:
        return sym, size
    word, size, sym = np.concatenate(done_word), np.concatenate(done_size), np.concatenate(done_sym)
    total = np.zeros(len(word), np.int64)
    total[word] = size
    start = (np.cumsum(total) - total)[word]
    out = np.empty(len(sym), sym.dtype)
    out[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(len(sym))] = sym
    return out, total


def in_order(sym, made, at, owner, first, size, best, v: Vocabulary) -> np.ndarray:
    """Which of the merges ``at`` come next in each word: all up to the first whose result pairs, with a neighbour, as well or better."""
    new = made[at]
    last = np.ones(len(at), bool)
    last[:-1] = owner[1:] != owner[:-1]
    first_of = np.ones(len(at), bool)
    first_of[1:] = last[:-1]
    start, end = first[owner], first[owner] + size[owner]
    before = sym[np.maximum(at - 1, 0)].astype(np.int64)
    beside = np.flatnonzero(~first_of & (np.append(-9, at[:-1]) + 2 == at))  # the left neighbour has just been made, too
    before[beside] = new[beside - 1]
    left = np.where(at > start, v.merged(before, new), -1)
    right = np.where(at + 2 < end, v.merged(new, sym[np.minimum(at + 2, len(sym) - 1)]), -1)
    limit = best[owner]
    stop = ((left >= 0) & (v.rank[left] <= limit)) | ((right >= 0) & (v.rank[right] <= limit))
    stops = np.cumsum(stop) - stop  # stops before each merge
    return stops == np.repeat(stops[first_of], np.diff(np.append(np.flatnonzero(first_of), len(at))))


def encode_words(words: list[str], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of distinct words (with their leading spaces), flat, and each word's number of ids."""
    points = np.frombuffer("".join(words).replace(" ", "▁").encode("utf-32-le"), np.uint32).astype(np.int64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    known = v.char_id[points].astype(np.int64)
    starts = np.ones(len(points), bool)
    pair = (points[:-1] << 32) | points[1:]
    at = np.minimum(np.searchsorted(v.neighbours, pair), len(v.neighbours) - 1)
    starts[1:] = v.neighbours[at] != pair
    starts[np.cumsum(size) - size] = True
    begin = np.flatnonzero(starts)
    sym, parts = merge_rounds(np.where(known >= 0, known, -1 - points), np.diff(np.append(begin, len(points))), v)
    n = np.bincount(np.searchsorted(np.cumsum(size), begin, "right"), weights=parts, minlength=len(size)).astype(np.int64)
    lost = np.flatnonzero(sym < 0)
    if not len(lost):
        return sym, n
    raw = [chr(-1 - int(s)).encode() for s in sym[lost]]
    width = np.ones(len(sym), np.int64)
    width[lost] = [len(r) for r in raw]
    owner = np.repeat(np.arange(len(n)), n)
    out = np.repeat(sym, width)
    first = np.cumsum(width) - width
    for i, r in zip(first[lost], raw, strict=True):
        out[i : i + len(r)] = v.byte_id[list(r)]
    return out, np.bincount(owner, weights=width, minlength=len(n)).astype(np.int64)


def cut(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts as one buffer with a space before each, word starts and ends in it, and each row's first word."""
    data, offs = _text.flat(col)
    if data.tobytes().find("▁".encode()) >= 0:
        data, offs = _text.flat(pa.array([(x or "").replace("▁", " ") for x in col.to_pylist()], pa.string()))
    rows = np.flatnonzero(np.diff(offs))
    at = offs[:-1][rows]
    data = np.insert(data, at, 32)
    grown = np.cumsum(np.append(0, np.diff(offs) > 0))
    offs = offs + grown
    space = data == 32
    first = space.copy()
    first[1:] &= ~space[:-1]
    first[offs[:-1][rows]] = True
    starts = np.flatnonzero(first)
    return data, starts, np.append(starts[1:], len(data)), np.searchsorted(starts, offs, "left")


def encode_slice(col: pa.Array, v: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words' ids, flat, and offsets into them; each word's number among the distinct; each row's first word."""
    data, starts, ends, first = cut(col)
    h = _text.hash_words(data, starts, ends)
    _, one, which = np.unique(h, return_index=True, return_inverse=True)
    raw = data.tobytes()
    words = [raw[a:b].decode() for a, b in zip(starts[one].tolist(), ends[one].tolist(), strict=True)]
    ids, n = encode_words(words, v) if words else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    return ids, np.append(0, np.cumsum(n)), which, first


def decode_ids(ids: list[int], v: Vocabulary) -> str:
    """Text of an id sequence: pieces joined, byte pieces as UTF-8, the space put before the text dropped."""
    raw = b"".join([v.surface[i] for i in ids])
    return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def encode(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """``docs`` with a column ``ids`` (named longer on a clash): the text's ids and the end id."""
    v = docs.sparkSession.sparkContext.broadcast(Vocabulary(model_path))

    def kernel():
        voc = v.value

        def work(part: pa.RecordBatch) -> dict:
            ids, at, which, first = encode_slice(part.column(0), voc)
            width = np.diff(at)[which]
            total = np.append(0, np.cumsum(width))
            flat = ids[np.repeat(at[which] - total[:-1], width) + np.arange(total[-1])].astype(np.int32)
            offs = total[first] + np.arange(len(first))
            out = np.insert(flat, total[first[1:]], voc.eos)
            return {"ids": pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(out, pa.int32()))}

        return work

    df, f = annotate(docs, kernel, ENCODED, text=text, limit=ENCODE_SLICE)
    return df.select(*[F.col(f"`{c}`") for c in docs.columns], F.col(f)["ids"].alias(free_name(docs, "ids")))


def digests(docs: DataFrame, model_path: str, keep: list[str] | None = None) -> tuple[DataFrame, str]:
    """``docs`` with a struct column: number of ids, digest of the ids, digest of the text decoded from them."""
    v = docs.sparkSession.sparkContext.broadcast(Vocabulary(model_path))

    def kernel():
        voc = v.value
        end = str(voc.eos).encode()
        shown = [b"%d " % i for i in range(len(voc.pieces))]

        def work(part: pa.RecordBatch) -> dict:
            ids, at, which, first = encode_slice(part.column(0), voc)
            all_ids, bounds = ids.tolist(), at.tolist()
            said = np.array([b"".join([shown[i] for i in all_ids[a:b]]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], dtype=object)
            back = np.array([b"".join([voc.surface[i] for i in all_ids[a:b]]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], dtype=object)
            count = np.append(0, np.cumsum(np.diff(at)[which]))
            n, sha, dec = [], [], []
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                w = which[a:b]
                n.append(int(count[b] - count[a]) + 1)
                sha.append(hashlib.sha256(b"".join(said[w].tolist()) + end).hexdigest())
                text = b"".join(back[w].tolist())
                text = (text[1:] if text[:1] == b" " else text).decode("utf-8", "replace")
                dec.append(hashlib.sha256(text.encode()).hexdigest())
            return {"n_tokens": n, "ids_sha256": sha, "decoded_sha256": dec}

        return work

    return annotate(docs, kernel, DIGESTS, keep, limit=SLICE)


def query(docs: DataFrame, model_path: str) -> DataFrame:
    df, f = digests(docs, model_path, keep=["doc_id"])
    return df.select("doc_id", f"{f}.*")
