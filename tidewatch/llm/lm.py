"""Hashed maximum-entropy language model with a class-factored softmax.

P(token | history) = P(class | history) * P(token | class).  The class softmax
has hashed features of the history: the previous word, the two previous words,
and two skips (the second and the third word back).  Frequent tokens fall into
classes of about equal mass, all others into hashed tail classes.  Inside a
class a token has its add-one share, times a weight for each counted pair of
previous word and token; an unknown token has the share of one unseen token of
its tail class.

The pair weights are those of a log-linear model whose normaliser is known:
with n(u, t) pairs of previous word u and token t of class c, and n(u, c) of
them over the class, P(t | u, c) = (n(u, t) + PRIOR share(t)) / (n(u, c) +
PRIOR), which sums to one over the class.

Training: all counts come from all training texts.  The class weights start at
the class prior and take ``ROUNDS`` distributed gradient steps; every training
text is in exactly one step's batch.  A task sums observed minus expected
feature counts over its texts in numpy, blocks of the table are summed in
streaming tasks, the step is scaled by the expected counts.

Pair counts: a slice of texts asks once for each distinct key it holds - the pair
(u, t), the class pair (u, c), a token that is not a frequent one - and says how
often its training texts hold it.  Keys travel sorted, as compressed gaps, one row
per slice and shard of the key space; a shard adds up and answers each row in its
order; the answers meet the slice's texts, compressed as well, again.  So the pair table is never held
whole anywhere, and grows with the corpus.

Scale: shipped to tasks are the weight table (``BUCKETS`` x ``CLASSES``) and at
most ``HEAVY`` frequent tokens, both bounded by parameters.  Gradient sums are as
large as the table, so a task sums ``TASK_TOKENS`` tokens at least, however finely
the input is dealt; shuffles then follow the tokens, not the partitions.  Shards
hold ``SHARD_KEYS`` tokens' keys on average; the more there are, the shorter the
rows, down to a key each.

Defined results: a null text is empty and scores as its end token alone; a null
doc_id counts as training; without training texts every token is unknown;
repeated rows repeat; an empty table gives no rows; no other column is read.
Tokens are compared by 64-bit hashes; pairs are hashed features, of ``SPARE_BITS``
more than their number needs, so one in a thousand shares its count with another.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from . import _text
from ._spark import drop, table

HEAVY = 1 << 19
CLASSES = 16
TAIL = 3
BUCKETS = 1 << 15
ROUNDS = 4
STEP = 1.5
TASK_TOKENS = 1 << 21
SHARD_KEYS = 1 << 20
SPARE_BITS = 10
FEATURES = 4
PRIOR = 8.0
SLICE = 4 << 20
_END = np.uint64(0x5AFE_C0DE_0000_0001)
_SALTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)
_RUN = 1 << 15  # tokens whose class scores are held at once
_BLOCK = 512  # buckets of a block of the table

def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all rows, each row closed by the end token, and where each row starts."""
    low = _text.LOWER[data]
    starts, ends, first = _text.words(low, offs, _text.NOT_SPACE)
    h = _text.hash_words(low, starts, ends)
    out = np.full(len(h) + len(offs) - 1, _END, np.uint64)
    out[np.arange(len(h)) + np.repeat(np.arange(len(offs) - 1), np.diff(first))] = h
    return out, first + np.arange(len(first))


def token_counts(docs: DataFrame) -> DataFrame:
    """Table (token, n) over all texts of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _text.slices(b, "text", SLICE):
                h, n = np.unique(tokens(*_text.flat(part.column(0)))[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["token", "n"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


class Model:
    """What tasks need to score: frequent tokens, classes, weights."""

    def __init__(self, total: int, distinct: int, heavy: np.ndarray, count: np.ndarray, tail_mass: np.ndarray):
        self.total, self.distinct = total, distinct
        self.key_bits = min(63, (2 * total).bit_length() + SPARE_BITS)
        order = np.argsort(heavy)
        self.heavy, self.count = heavy[order], count[order]
        # classes: the end token's own, the heavy ones by falling count and equal mass, the tail ones by hash
        kinds = CLASSES - TAIL - 1
        rank = np.argsort(-self.count, kind="stable")
        words = rank[self.heavy[rank] != _END]
        mass = np.cumsum(self.count[words])
        klass = np.full(len(self.heavy), CLASSES - 1, np.int32)
        if len(words):
            klass[words] = np.minimum(((mass - self.count[words]) * kinds) // mass[-1], kinds - 1)
        self.klass = klass
        weight = np.bincount(klass, weights=self.count + 1.0, minlength=CLASSES)
        weight[kinds : kinds + TAIL] = tail_mass + 1  # and one unseen token each
        self.log_mass = np.log10(np.maximum(weight, 1))
        share = np.maximum(weight, 0.5)
        self.share = share / share.sum()
        self.bias = np.log(self.share).astype(np.float32)
        self.table = np.zeros((BUCKETS, CLASSES), np.float32)

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class of each token, and its count where it is a frequent one (else -1)."""
        kinds = CLASSES - TAIL - 1
        tail = kinds + (h.view(np.int64) % TAIL)
        if not len(self.heavy):
            return np.where(h == _END, CLASSES - 1, tail).astype(np.int32), np.full(len(h), -1, np.int64)
        at = np.searchsorted(self.heavy, h)
        at[at == len(self.heavy)] = 0
        there = self.heavy[at] == h
        return np.where(there, self.klass[at], np.where(h == _END, CLASSES - 1, tail)).astype(np.int32), np.where(there, self.count[at], -1)


def features(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Buckets of each token's history features; words before a text's first read as 0."""
    n = len(h)
    place = np.arange(n) - np.repeat(first[:-1], np.diff(first))
    back = []
    for k in (1, 2, 3):
        b = np.zeros(n, np.uint64)
        b[k:] = h[: n - k] if n > k else 0
        b[place < k] = 0
        back.append(b)
    keys = (back[0] * _SALTS[0], (back[0] * _SALTS[0]) ^ (back[1] * _SALTS[1]), back[1] * _SALTS[2], back[2] * _SALTS[3])
    out = np.empty((FEATURES, n), np.int32)
    for i, k in enumerate(keys):
        out[i] = (_text.mix(k + _SALTS[i]) & np.uint64(BUCKETS - 1)).astype(np.int32)
    return out


def class_scores(m: Model, f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a run of tokens the natural-log class scores, at most 0, their powers of e, and the sums of these over the classes."""
    z = m.table[f[0]]
    for i in range(1, FEATURES):
        z += m.table[f[i]]
    z += m.bias
    top = z[:, 0].copy()
    for c in range(1, CLASSES):
        np.maximum(top, z[:, c], out=top)
    z -= top[:, None]
    e = np.exp(z)
    total = e[:, 0].copy()
    for c in range(1, CLASSES):
        total += e[:, c]
    return z, e, total


def class_logits(m: Model, f: np.ndarray) -> np.ndarray:
    """Natural-log class probabilities for a run of tokens."""
    z, _, total = class_scores(m, f)
    return z - np.log(total)[:, None]


def gradient(m: Model, h: np.ndarray, first: np.ndarray, observed: np.ndarray, expected: np.ndarray) -> None:
    """Add a slice's observed and expected feature counts."""
    f, klass = features(h, first), m.look_up(h)[0]
    observed += np.bincount((f * CLASSES + klass).ravel(), minlength=BUCKETS * CLASSES).reshape(BUCKETS, CLASSES)
    for a in range(0, len(h), _RUN):
        part = f[:, a : a + _RUN]
        _, p, total = class_scores(m, part)
        p /= total[:, None]
        for b in part.astype(np.uint16):  # BUCKETS fit in 16 bits, which numpy sorts by radix
            order = np.argsort(b, kind="stable")
            b = b[order]
            head = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
            expected[b[head]] += np.add.reduceat(p[order], head, axis=0)


def step(docs: DataFrame, model: Model) -> np.ndarray:
    """Weights after one gradient step over ``docs``."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        observed, expected = np.zeros((BUCKETS, CLASSES), np.float32), np.zeros((BUCKETS, CLASSES), np.float32)
        seen = False
        for b in batches:
            for part in _text.slices(b, "text", 2 << 20):
                seen = True
                gradient(shipped.value, *tokens(*_text.flat(part.column(0))), observed, expected)
        if seen:
            for i in range(0, BUCKETS, _BLOCK):
                both = np.stack([observed[i : i + _BLOCK], expected[i : i + _BLOCK]])
                if both.any():
                    yield pa.RecordBatch.from_pydict({"block": pa.array([i], pa.int32()), "sums": pa.array([both.tobytes()], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for i, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.frombuffer(raw, np.float32).astype(np.float64)
                held[i] = held[i] + x if i in held else x
        for i, x in held.items():
            yield pa.RecordBatch.from_pydict({"block": pa.array([i], pa.int32()), "sums": pa.array([x.astype(np.float32).tobytes()], pa.binary())})

    tasks = max(1, -(-model.total // (ROUNDS * TASK_TOKENS)))
    sums = docs.select(F.col("text").cast("string").alias("text")).coalesce(tasks).mapInArrow(run, "block int, sums binary").repartition("block").mapInArrow(add, "block int, sums binary")
    table_ = model.table.copy()
    for r in sums.toLocalIterator():  # BUCKETS / _BLOCK rows of fixed size
        both = np.frombuffer(bytes(r["sums"]), np.float32).reshape(2, -1, CLASSES)
        move = (both[0] - both[1]) / (both[1] + 1.0)
        table_[r["block"] : r["block"] + _BLOCK] += STEP / FEATURES * np.clip(move, -2, 2)
    return table_


def train(docs: DataFrame) -> Model:
    """Classes and weights from all texts of ``docs`` that are not held out."""
    learn = docs.select("doc_id", "text").filter(~held_out(F.col("doc_id")))
    counts = table(token_counts(learn))
    level = F.floor(F.log2("n") * 16).cast("int")
    sizes = counts.groupBy(level.alias("level")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).orderBy(F.desc("level")).collect()  # some hundred rows at most
    total, distinct, held, least = sum(r["n"] for r in sizes), sum(r["v"] for r in sizes), 0, 1 << 30
    for r in sizes:
        if held + r["v"] > HEAVY:
            break
        held, least = held + r["v"], r["level"]
    counts = counts.withColumn("heavy", level >= least)
    top = counts.filter("heavy").select("token", "n").toArrow()  # at most HEAVY rows
    tail = counts.filter("NOT heavy").groupBy(F.pmod("token", F.lit(TAIL)).alias("k")).agg((F.sum("n") + F.count("*")).alias("mass")).collect()
    mass = np.zeros(TAIL)
    for r in tail:
        mass[r["k"]] = r["mass"]
    model = Model(int(total), int(distinct), top["token"].to_numpy().view(np.uint64), top["n"].to_numpy(), mass)
    turn = F.coalesce(F.pmod(F.floor(F.crc32(F.col("doc_id").cast("string").cast("binary")) / 7), F.lit(ROUNDS)), F.lit(0))
    for r in range(ROUNDS):
        model.table = step(learn.filter(turn == r), model)
    drop(counts)
    return model


def distinct(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of at most ``bits`` bits, and where each key is among them."""
    low = max(1, len(keys) - 1).bit_length()
    if bits + low > 64:
        return np.unique(keys, return_inverse=True)
    # a key and its place in one number: sorting values is several times faster than sorting places
    both = np.sort((keys << np.uint64(low)) | np.arange(len(keys), dtype=np.uint64))
    place = (both & np.uint64((1 << low) - 1)).astype(np.int64)
    both >>= np.uint64(low)
    new = np.ones(len(both), bool)
    new[1:] = both[1:] != both[:-1]
    at = np.empty(len(keys), np.int64)
    at[place] = np.cumsum(new) - 1
    return both[new], at


class Keys:
    """The distinct keys of a slice's tokens, sorted - hashed pairs and class pairs, and tokens that are not frequent - and where each token finds its own."""

    def __init__(self, m: Model, h: np.ndarray, first: np.ndarray):
        self.klass, self.count = m.look_up(h)
        back = np.zeros(len(h), np.uint64)
        back[1:] = h[:-1]
        back[first[:-1]] = 0
        back = _text.mix(back * _SALTS[0] + _SALTS[1])
        pair = _text.mix(back ^ (h * _SALTS[2]))
        group = _text.mix(back ^ ((self.klass.astype(np.uint64) + np.uint64(1)) * _SALTS[3]))
        self.bits = m.key_bits
        self.rare = np.flatnonzero(self.count < 0)
        self.pairs, at = distinct(np.concatenate([pair, group]) >> np.uint64(64 - self.bits), self.bits)
        self.pair, self.group = at[: len(h)], at[len(h) :]
        self.tokens, self.token = np.unique(h[self.rare], return_inverse=True)

    def counted(self, learn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often the tokens marked in ``learn`` hold each pair key, and each token key."""
        pairs = np.bincount(self.pair, weights=learn, minlength=len(self.pairs)) + np.bincount(self.group, weights=learn, minlength=len(self.pairs))
        return pairs, np.bincount(self.token, weights=learn[self.rare], minlength=len(self.tokens))

    def cuts(self, shards: int) -> tuple[np.ndarray, np.ndarray]:
        """Where each shard, an equal part of either key space, begins and ends among the keys."""
        at = lambda keys, bits: np.searchsorted(keys, np.array([-(-(i << bits) // shards) for i in range(shards)], np.uint64)).tolist() + [len(keys)]
        return at(self.pairs, self.bits), at(self.tokens, 64)


def pack(a: np.ndarray) -> bytes:
    """Numbers as compressed byte planes: the high ones are mostly zero."""
    return pa.compress(np.ascontiguousarray(a.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes(), "zstd", asbytes=True) if len(a) else b""


def unpack(raw: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    return np.ascontiguousarray(np.frombuffer(pa.decompress(raw, 8 * n, "zstd"), np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


#: What a slice asks of a shard: how many pair and token keys, their gaps, and the training texts' counts of them.
ASKED = "slice string, shard int, n_pairs int, n_tokens int, pairs binary, tokens binary, counts binary"


def shelves(docs: DataFrame) -> DataFrame:
    """Table of slices of whole rows: a name, and the compressed ids, texts and whether they are held out."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), held_out(F.col("doc_id")).alias("held"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _text.slices(b, "text", SLICE):
                yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.array([shelve(part)])], names=["slice", "texts"])

    return table(rows.mapInArrow(run, "slice string, texts binary"))


def ask(shelved: DataFrame, model: Model, shards: int) -> DataFrame:
    """The rows ``ASKED`` of all slices."""
    shipped = shelved.sparkSession.sparkContext.broadcast(model)
    types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                part = unshelve(raw)
                h, first = tokens(*_text.flat(part.column(1)))
                keys = Keys(m, h, first)
                n_pairs, n_tokens = keys.counted(np.repeat(~part.column(2).to_numpy(zero_copy_only=False).astype(bool), np.diff(first)))
                p, t = keys.cuts(shards)
                out = []
                for i in range(shards):
                    if p[i] < p[i + 1] or t[i] < t[i + 1]:
                        x, y = slice(p[i], p[i + 1]), slice(t[i], t[i + 1])
                        gaps = (pack(np.diff(k, prepend=np.uint64(0))) for k in (keys.pairs[x], keys.tokens[y]))
                        out.append((name, i, p[i + 1] - p[i], t[i + 1] - t[i], *gaps, pack(np.concatenate([n_pairs[x], n_tokens[y]]))))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), types, strict=True)], names=["slice", "shard", "n_pairs", "n_tokens", "pairs", "tokens", "counts"])

    return shelved.mapInArrow(run, ASKED)


def unshelve(raw: pa.BinaryScalar) -> pa.RecordBatch:
    return pa.ipc.open_stream(raw.as_buffer()).read_next_batch()


def shelve(part: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(part)
    return sink.getvalue().to_pybytes()


def totals(n: list[int], gaps: list[bytes], counts: list[np.ndarray]) -> list[np.ndarray]:
    """For each asker's keys their counts over all askers."""
    keys = [np.cumsum(unpack(g, k), dtype=np.uint64) for g, k in zip(gaps, n, strict=True)]
    _, at = np.unique(np.concatenate(keys), return_inverse=True)
    every = np.bincount(at, weights=np.concatenate(counts), minlength=1)[at]
    return np.split(every, np.cumsum(n)[:-1])


def answer(shard: pa.Table) -> pa.Table:
    """A shard's rows with the counts of their keys over all of them."""
    p, t = shard["n_pairs"].to_pylist(), shard["n_tokens"].to_pylist()
    counts = [unpack(c, a + b) for c, a, b in zip(shard["counts"].to_pylist(), p, t, strict=True)]
    of_pairs = totals(p, shard["pairs"].to_pylist(), [c[:a] for c, a in zip(counts, p, strict=True)])
    of_tokens = totals(t, shard["tokens"].to_pylist(), [c[a:] for c, a in zip(counts, p, strict=True)])
    packed = [[pack(x) for x in xs] for xs in (of_pairs, of_tokens)]
    return pa.table({"slice": shard["slice"], "shard": shard["shard"], "n_pairs": shard["n_pairs"], "n_tokens": shard["n_tokens"], "pairs": pa.array(packed[0], pa.binary()), "tokens": pa.array(packed[1], pa.binary())})


def token_logs(m: Model, h: np.ndarray, first: np.ndarray, keys: Keys, pairs: np.ndarray, tokens_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Count of each token, and log10 of its probability after its history."""
    count = keys.count.astype(np.float64)
    count[keys.rare] = tokens_[keys.token]
    share = (count + 1) / 10 ** m.log_mass[keys.klass]
    logs = np.log10((pairs[keys.pair] + PRIOR * share) / (pairs[keys.group] + PRIOR))
    f = features(h, first)
    for a in range(0, len(h), _RUN):
        z, _, total = class_scores(m, f[:, a : a + _RUN])
        logs[a : a + _RUN] += (z[np.arange(len(z)), keys.klass[a : a + _RUN]] - np.log(total)) / np.log(10)
    return count, logs


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score for every row of ``docs``; pairs are counted on the way."""
    shelved = shelves(docs)
    answered = ask(shelved, model, max(1, -(-model.total // SHARD_KEYS))).groupBy("shard").applyInArrow(answer, "slice string, shard int, n_pairs int, n_tokens int, pairs binary, tokens binary")
    back = answered.groupBy("slice").agg(F.sort_array(F.collect_list(F.struct("shard", "n_pairs", "n_tokens", "pairs", "tokens"))).alias("told"))
    met = shelved.join(back, "slice").select("texts", "told")
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), StructField("n_tokens", LongType()), StructField("n_known", LongType()), StructField("base_score", DoubleType()), StructField("score", DoubleType())])
    id_type = to_arrow_schema(schema).field(0).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for b in batches:
            for i in range(b.num_rows):
                told = b.column(1)[i].as_py()
                part = unshelve(b.column(0)[i])
                h, first = tokens(*_text.flat(part.column(1)))
                keys = Keys(m, h, first)
                pairs, some = (np.concatenate([unpack(x[name], x[f"n_{name}"]) for x in told]).astype(np.float64) for name in ("pairs", "tokens"))
                count, logs = token_logs(m, h, first, keys, pairs, some)
                n = part.num_rows
                row = np.repeat(np.arange(n), np.diff(first))
                sums = [np.bincount(row, weights=w, minlength=n) for w in (count > 0, np.log10((count + 1) / (m.total + m.distinct + 1)), logs)]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(id_type), pa.array(np.diff(first)), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])], schema=pa.schema(list(to_arrow_schema(schema))))

    return met.mapInArrow(run, schema)


def query(docs: DataFrame) -> DataFrame:
    model = train(docs)
    got = score(docs, model)
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
