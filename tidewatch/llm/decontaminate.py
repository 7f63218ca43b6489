"""Benchmark decontamination with suffix arrays over the training texts.

Each slice of whole documents is a shard: its words become 64-bit symbols, one
suffix array of the shard is built by rank tripling, and every suffix of every
benchmark item is located in it by binary search.  The interval of a suffix
gives all places where its first ``window`` words occur; places that follow one
another on a diagonal join into the longest verbatim match.

Scale: one narrow pass over the documents, no shuffle, for each ``GROUP_BYTES`` of
benchmark text; that much, in blocks of ``BLOCK_BYTES``, is what is broadcast and
what a task holds at once.  A benchmark of one group, as usual, needs no more.  Of
further groups each pass writes its matches only, keyed by a row number, and an
aggregation of these joins the documents at the end.  An item whose words repeat
occurs in a text of the same words at nearly every pair of places; such an item
is followed word by word, so that a task holds its open matches only.

Defined results: a null text, or one without words, has no words and no match;
an item without words matches nothing; an item shorter than the window is one
window by itself; repeated items count once by id; a null ``item_id`` reads as
the empty string; repeated documents are each reported; an empty benchmark
leaves all documents clean.  Symbols are 64-bit hashes of words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from . import _text
from ._spark import annotate, free_name, table

WINDOW = 10
BLOCK_BYTES = 8 << 20
GROUP_BYTES = 16 << 20  # a task holds some eight times as much
OCCURRENCES = 1 << 19  # of an item in a shard, up to which they are joined all at once
_SEPARATOR = np.uint64(0)

MATCH = StructType([StructField("item_id", StringType()), StructField("item_word", IntegerType()), StructField("doc_word", LongType()), StructField("n_words", IntegerType())])
FIELDS = StructType([StructField("n_words", LongType()), StructField("n_hit", LongType()), StructField("items", ArrayType(StringType())), StructField("matches", ArrayType(MATCH))])


def symbols(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word symbols of all rows, each row closed by a separator, and where each row starts."""
    low = _text.LOWER[data]
    starts, ends, first = _text.words(low, offs, _text.ALNUM)
    h = _text.hash_words(low, starts, ends)
    h[h == _SEPARATOR] = np.uint64(1)
    out = np.full(len(h) + len(offs) - 1, _SEPARATOR, np.uint64)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    out[np.arange(len(h)) + row] = h
    return out, first + np.arange(len(first))


def suffix_array(sym: np.ndarray, depth: int) -> np.ndarray:
    """Positions of all suffixes, sorted by at least their first ``depth`` symbols (numeric order of symbols)."""
    n = len(sym)
    order = np.argsort(sym, kind="stable")
    seen, rank = 1, _ranks(sym[order], order)
    while seen < depth and n:
        top = int(rank.max()) + 2
        times = 3 if top < 1 << 21 else 2
        bits = 21 if times == 3 else 31
        key = (rank + 1) << (bits * (times - 1))
        for k in range(1, times):
            key[: max(n - k * seen, 0)] |= (rank[k * seen :] + 1) << (bits * (times - 1 - k))
        order = np.argsort(key, kind="stable")
        rank = _ranks(key[order], order)
        seen *= times
    return order


def _ranks(ordered: np.ndarray, order: np.ndarray) -> np.ndarray:
    rank = np.zeros(len(order), np.int64)
    if len(order):
        rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
    return rank


def _bound(sym: np.ndarray, sa: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: int, want: np.ndarray, right: bool) -> np.ndarray:
    """For each query, the first place in [lo, hi) whose k-th symbol is not below (right: is above) ``want``."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            return lo
        mid = (lo[open_] + hi[open_]) >> 1
        got = sym[np.minimum(sa[mid] + k, len(sym) - 1)]
        below = got <= want[open_] if right else got < want[open_]
        lo[open_[below]] = mid[below] + 1
        hi[open_[~below]] = mid[~below]


def locate(sym: np.ndarray, sa: np.ndarray, items: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix-array interval of each query ``items[at : at + size]``, all searched together."""
    lo, hi = np.zeros(len(at), np.int64), np.full(len(at), len(sa), np.int64)
    for k in range(int(size.max()) if len(size) else 0):
        live = np.flatnonzero((size > k) & (lo < hi))
        if not len(live):
            break
        want = items[at[live] + k]
        a, b = lo[live], hi[live]
        lo[live] = _bound(sym, sa, a, b, k, want, False)
        hi[live] = _bound(sym, sa, lo[live], b, k, want, True)
    return lo, hi


class Block:
    """A block of benchmark items: symbols, and the queries (place, length, item) made of their suffixes."""

    def __init__(self, ids: list[str], texts: list[str], window: int):
        self.size_bytes = sum(map(len, texts))
        self.sym, first = symbols(*_text.flat(pa.array(texts, pa.string())))
        self.ids = np.array(ids, dtype=object)
        length = np.diff(first) - 1
        n = np.where(length >= window, length - window + 1, (length > 0).astype(np.int64))
        self.item = np.repeat(np.arange(len(ids)), n)
        self.word = np.arange(len(self.item)) - np.repeat(np.cumsum(n) - n, n)
        self.at = first[:-1][self.item] + self.word
        self.size = np.minimum(length, window)[self.item]


def blocks(benchmark: DataFrame, window: int) -> Iterator[Block]:
    """Benchmark items in blocks of bounded size, fetched partition by partition."""
    ids, texts, size = [], [], 0
    for r in benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).toLocalIterator():
        text = r[1] or ""
        if texts and size + len(text) > BLOCK_BYTES:
            yield Block(ids, texts, window)
            ids, texts, size = [], [], 0
        ids.append(r[0] or "")
        texts.append(text)
        size += len(text)
    if texts:
        yield Block(ids, texts, window)


def block_groups(benchmark: DataFrame, window: int) -> Iterator[list[Block]]:
    """The blocks in groups of bounded size; one group at least."""
    some, size = [], 0
    for block in blocks(benchmark, window):
        if some and size + block.size_bytes > GROUP_BYTES:
            yield some
            some, size = [], 0
        some.append(block)
        size += block.size_bytes
    yield some


def _joined(sa: np.ndarray, lo: np.ndarray, n: np.ndarray, block: Block, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Longest matches (item, word, place, length) of the queries ``at``, whole items each, all their occurrences at once."""
    n, lo = n[at], lo[at]
    q = np.repeat(np.arange(len(at)), n)
    place = sa[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(len(q))]
    size, item, word = block.size[at][q], block.item[at][q], block.word[at][q]
    # occurrences one word apart on the same diagonal of the same item are one longer match
    order = np.lexsort((place, place - word, item))
    place, size, item, word = place[order], size[order], item[order], word[order]
    new = np.ones(len(place), bool)
    new[1:] = (item[1:] != item[:-1]) | (place[1:] != place[:-1] + 1) | (word[1:] != word[:-1] + 1)
    head = np.flatnonzero(new)
    run = np.diff(np.append(head, len(place)))
    return item[head], word[head], place[head], size[head] + run - 1


def _followed(sa: np.ndarray, lo: np.ndarray, n: np.ndarray, block: Block, at: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """The same for one item of very many occurrences (repeated words): word after word, only the open matches are held."""
    open_, since = np.zeros(0, np.int64), np.zeros(0, np.int64)  # places of the latest word's occurrences, sorted, and the word each match began with
    size, item = int(block.size[at[0]]), int(block.item[at[0]])

    def ended(which: np.ndarray, word: int) -> tuple[np.ndarray, ...]:
        run = word - since[which]
        return np.full(len(run), item), since[which], open_[which] - run + 1, size + run - 1

    before, places = None, None
    for word, q in enumerate(at):
        interval = (int(lo[q]), int(n[q]))
        if interval != before:
            before, places = interval, np.sort(sa[lo[q] : lo[q] + n[q]])
        k = np.searchsorted(open_, places - 1)
        goes_on = np.zeros(len(places), bool)
        inside = k < len(open_)
        goes_on[inside] = open_[k[inside]] == places[inside] - 1
        stops = np.ones(len(open_), bool)
        stops[k[goes_on]] = False
        if stops.any():
            yield ended(np.flatnonzero(stops), word)
        begun = np.full(len(places), word)
        begun[goes_on] = since[k[goes_on]]
        open_, since = places, begun
    if len(open_):
        yield ended(np.arange(len(open_)), len(at))


def longest(sa: np.ndarray, lo: np.ndarray, n: np.ndarray, block: Block, most: int = OCCURRENCES) -> Iterator[tuple[np.ndarray, ...]]:
    """Longest matches (item, word, place, length) of a block, in parts of bounded size.

    Items of at most ``most`` occurrences go together as far as they have twice that many; others go by themselves.
    """
    each = np.bincount(block.item, n, len(block.ids)).astype(np.int64)
    first = np.searchsorted(block.item, np.arange(len(block.ids) + 1))
    light = np.flatnonzero((each > 0) & (each <= most))
    part = np.cumsum(each[light]) // max(1, most)
    for g in np.unique(part):
        yield _joined(sa, lo, n, block, np.flatnonzero(np.isin(block.item, light[part == g]) & (n > 0)))
    for i in np.flatnonzero(each > most):
        yield from _followed(sa, lo, n, block, np.arange(first[i], first[i + 1]))


def search_shard(data: np.ndarray, offs: np.ndarray, some: Iterator[Block], window: int) -> dict:
    """All matches of the blocks' items in one shard, by row."""
    sym, first = symbols(data, offs)
    rows = len(offs) - 1
    sa = suffix_array(sym, window)
    cover = np.zeros(len(sym) + 1, np.int64)
    found: list[list] = [[] for _ in range(rows)]
    for block in some:
        lo, hi = locate(sym, sa, block.sym, block.at, block.size)
        for item, word, place, length in longest(sa, lo, hi - lo, block):
            np.add.at(cover, place, 1)
            np.add.at(cover, place + length, -1)
            row = np.searchsorted(first, place, "right") - 1
            for r, i, w, p, s in zip(row, item, word, place - first[row], length, strict=True):
                found[r].append({"item_id": block.ids[i], "item_word": int(w), "doc_word": int(p), "n_words": int(s)})
    hit = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
    return {"n_words": np.diff(first) - 1, "n_hit": hit[first[1:]] - hit[first[:-1]], "items": [sorted({m["item_id"] for m in f}) for f in found], "matches": found}


def one_pass(docs: DataFrame, group: list[Block], window: int, keep: list[str] | None) -> tuple[DataFrame, str]:
    shipped = [docs.sparkSession.sparkContext.broadcast(b) for b in group]

    def kernel():
        def work(part: pa.RecordBatch) -> dict:
            return search_shard(*_text.flat(part.column(0)), (b.value for b in shipped), window)

        return work

    return annotate(docs, kernel, FIELDS, keep)


def covered(matches: Column) -> Column:
    """Number of words under any match: sorted by place, each adds what lies behind those before it."""
    spans = F.array_sort(F.transform(matches, lambda m: F.struct(m["doc_word"].alias("a"), (m["doc_word"] + m["n_words"]).alias("b"))))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("at"))
    return F.aggregate(spans, zero, lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0), s["b"] - F.greatest(acc["at"], s["a"]))).cast("long").alias("n"), F.greatest(acc["at"], s["b"]).alias("at")), lambda acc: acc["n"])


def find_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep: list[str] | None = None) -> tuple[DataFrame, str]:
    """``docs`` with a struct column (its name is returned): n_words, n_hit, items, matches (longest verbatim matches and their places)."""
    groups = block_groups(benchmark, window)
    first, more = next(groups), next(groups, None)
    if more is None:
        return one_pass(docs, first, window, keep)
    row, name = free_name(docs, "_row"), free_name(docs, "_found")
    numbered = table(docs.withColumn(row, F.monotonically_increasing_id()))
    passes = []
    for group in chain([first, more], groups):
        marked, f = one_pass(numbered, group, window, [row])
        # the first pass counts the words of every row, all passes report their matches
        passes.append(table(marked.select(row, F.col(f)["n_words"].alias("n_words"), F.col(f)["matches"].alias("matches")).filter("size(matches) > 0" if passes else "true")))
    every = reduce(DataFrame.union, passes).groupBy(row).agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("matches")).alias("matches"))
    found = F.struct("n_words", covered(F.col("matches")).alias("n_hit"), F.array_sort(F.array_distinct(F.col("matches.item_id"))).alias("items"), "matches")
    marked = numbered.join(every.select(row, found.alias(name)), row)
    return marked.select(*[F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)], name), name


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents in which no benchmark window occurs, with their own columns."""
    marked, name = find_matches(docs, benchmark, window)
    return marked.filter(F.col(name)["n_hit"] == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Digest columns per document."""
    marked, f = find_matches(docs, benchmark, keep=["doc_id"])
    m = F.col(f)
    return marked.select("doc_id", m["n_words"].alias("n_words"), m["n_hit"].alias("n_hit"), F.size(m["items"]).cast("long").alias("n_items"), F.sha2(F.array_join(m["items"], ","), 256).alias("items_sha256"), (m["n_hit"] > 0).alias("contaminated"))
