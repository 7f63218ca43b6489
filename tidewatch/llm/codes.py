"""Vector code compression: product codebooks by Lloyd rounds that filter entries through kd-trees.

Components become integers, vectors are cut into four parts, and a codebook of
at most 256 entries is fitted for each part position.  Tasks build kd-trees
over the parts of their rows once, each node with bounding box, count and sum.
A round walks the trees from the root: an entry that another one beats at
every point of a node's box is dropped for the whole subtree, a subtree with
one entry left is assigned at once from its cached sum and count, and only
leaves with several left compare their parts.  All arithmetic is exact.

Scale: trees are written once (blocks of about a megabyte) and read by each
round; a round sends sums and counts by entry only, added up before they are
shuffled, and the driver holds the codebooks alone (four times 256 parts).
Rows meet no other row until errors are added by label; that sum is joined
back, broadcast by Spark where its table is small.

Defined results: rows whose vector is null or holds null or non-finite
components are dropped; nothing else is.  Shorter vectors are padded with
zeros to the longest, and all to a multiple of four.  Integers beyond
``saturation(d)`` (2^27 for 64 components), which no long error could hold,
are cut to it.  Equal ``vec_id`` in the first codebook are ordered by vector,
null ids come last; repeated rows each get a row; a table with fewer than 256
kept rows has shorter codebooks, one with none gives no rows; other columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from ._spark import table

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
LEAF = 48
#: Components a block of trees holds, at most.
BLOCK = 1 << 18


def saturation(components: int) -> int:
    """Largest integer for which the squared distance of two vectors fits a long."""
    return int((2.0**62 / (4 * max(1, components))) ** 0.5)


def scaled(values: np.ndarray, offsets: np.ndarray, width: int) -> np.ndarray:
    """Rows of integers floor(1024 * x) from flat components; missing ones at the end are zero."""
    out = np.zeros((len(offsets) - 1, width), np.int64)
    most = saturation(width)
    lengths = np.diff(offsets)
    row = np.repeat(np.arange(len(lengths)), lengths)
    with np.errstate(over="ignore"):  # a double near the largest saturates like any other
        out[row, np.arange(len(row)) - (offsets[:-1] - offsets[0])[row]] = np.clip(np.floor(values.astype(np.float64) * SCALE), -most, most)
    return out


# --- kd-trees ---------------------------------------------------------------------------------------


def edges(n: int) -> list[np.ndarray]:
    """Row bounds of the nodes of each level: halves of halves down to at most ``LEAF`` rows."""
    levels = [np.array([0, n])]
    while np.diff(levels[-1]).max() > LEAF:
        e = levels[-1]
        levels.append(np.sort(np.concatenate([e, (e[:-1] + e[1:]) // 2])))
    return levels


def build(points: np.ndarray) -> dict[str, np.ndarray]:
    """A kd-tree: order of rows, and by node (level by level) lower and upper corner and sum."""
    levels = edges(len(points))
    order = np.arange(len(points))
    for e in levels[:-1]:  # each node's rows in order of its widest side
        held = points[order]
        wide = (np.maximum.reduceat(held, e[:-1]) - np.minimum.reduceat(held, e[:-1])).argmax(1)
        node = np.repeat(np.arange(len(e) - 1), np.diff(e))
        order = order[np.lexsort((held[np.arange(len(held)), wide[node]], node))]
    held = points[order]
    corner = {"low": np.minimum, "high": np.maximum, "sum": np.add}
    return {"order": order, **{name: np.concatenate([f.reduceat(held, e[:-1]) for e in levels]) for name, f in corner.items()}}


def nearest(points: np.ndarray, entries: np.ndarray, allowed: np.ndarray | None = None) -> np.ndarray:
    """Index of each point's nearest entry (ties to the lower), among those allowed for its row."""
    most = max(int(np.abs(points).max(initial=0)), int(np.abs(entries).max(initial=0)))
    exact = np.float64 if 3 * points.shape[1] * most * most < 1 << 53 else np.int64
    p, z = points.astype(exact), entries.astype(exact)
    away = (z * z).sum(1) - 2 * (p @ z.T)
    if allowed is not None:
        away = np.where(allowed, away, np.inf if exact is np.float64 else np.iinfo(np.int64).max)
    return away.argmin(1)


def walk(tree: dict[str, np.ndarray], points: np.ndarray, entries: np.ndarray) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """("subtrees", nodes, entry) for nodes assigned at once, ("rows", rows, entry) for rows compared in leaves."""
    levels = edges(len(points))
    size = (entries * entries).sum(1)
    index = np.arange(len(entries))
    nodes, first, left = np.zeros(1, np.int64), 0, np.ones((1, len(entries)), bool)
    for depth, e in enumerate(levels):
        low, high = tree["low"][first + nodes], tree["high"][first + nodes]
        best = nearest(low + high, 2 * entries, left)
        turn = entries[None] - entries[best][:, None]
        gain = 2 * (np.maximum(turn, 0) * high[:, None] + np.minimum(turn, 0) * low[:, None]).sum(2)
        least = size[None] - size[best][:, None] - gain  # how much farther than ``best`` an entry is, at least
        left &= ~((least > 0) | (least == 0) & (index[None] > best[:, None]))
        one = left.sum(1) == 1
        yield "subtrees", np.stack([first + nodes[one], e[nodes[one]], e[nodes[one] + 1]], 1), left[one].argmax(1)
        nodes, left = nodes[~one], left[~one]
        if depth == len(levels) - 1:
            lengths = e[nodes + 1] - e[nodes]
            at = np.repeat(np.arange(len(nodes)), lengths)
            rows = tree["order"][np.arange(len(at)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + e[nodes][at]]
            if len(rows):
                yield "rows", rows, nearest(points[rows], entries, left[at])
        else:
            below = levels[depth + 1]
            first += len(e) - 1
            start = np.searchsorted(below, e[nodes])
            nodes, left = np.concatenate([start, start + 1]), np.concatenate([left, left])


def sums(tree: dict[str, np.ndarray], points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """By entry, the sum of its parts and (last column) their count."""
    out = np.zeros((len(entries), points.shape[1] + 1), np.int64)
    for kind, which, entry in walk(tree, points, entries):
        if kind == "subtrees":
            np.add.at(out, entry, np.concatenate([tree["sum"][which[:, 0]], (which[:, 2] - which[:, 1])[:, None]], 1))
        else:
            np.add.at(out, entry, np.concatenate([points[which], np.ones((len(which), 1), np.int64)], 1))
    return out


def assigned(tree: dict[str, np.ndarray], points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """The entry of each part."""
    out = np.zeros(len(points), np.int64)
    for kind, which, entry in walk(tree, points, entries):
        if kind == "rows":
            out[which] = entry
        else:
            for (_, a, b), z in zip(which, entry, strict=True):
                out[tree["order"][a:b]] = z
    return out


# --- on Spark ---------------------------------------------------------------------------------------

TREES = ("order", "low", "high", "sum")


def kept(embeddings: DataFrame) -> DataFrame:
    """vec_id, embedding and label of the rows whose vector is whole and finite."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return embeddings.select("vec_id", "embedding", "label").where(F.col("embedding").isNotNull() & fine)


def _flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = col.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    return col.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], offsets


def forest(rows: DataFrame, width: int) -> DataFrame:
    """Blocks of rows with a kd-tree for each part position: ids, labels, integers, and the trees' arrays."""
    schema = StructType([StructField("vec_id", ArrayType(rows.schema["vec_id"].dataType)), StructField("label", ArrayType(rows.schema["label"].dataType)), StructField("points", BinaryType()), *[StructField(n, ArrayType(BinaryType())) for n in TREES]])
    arrow = to_arrow_schema(schema)
    most, part = max(LEAF, BLOCK // max(1, width)), width // PARTS

    def block(ids: list, labels: list, points: np.ndarray) -> pa.RecordBatch:
        trees = [build(points[:, i * part : (i + 1) * part]) for i in range(PARTS)]
        found = {n: [t[n].astype(np.int32 if n != "sum" else np.int64).tobytes() for t in trees] for n in TREES}
        return pa.RecordBatch.from_pylist([{"vec_id": ids, "label": labels, "points": points.astype(np.int32).tobytes(), **found}], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, points = [], [], np.zeros((0, width), np.int64)
        for b in batches:
            for at in range(0, b.num_rows, most):
                cut = b.slice(at, most)
                ids += cut.column(0).to_pylist()
                labels += cut.column(2).to_pylist()
                points = np.concatenate([points, scaled(*_flat(cut.column(1)), width)])
                if len(ids) >= most:
                    yield block(ids[:most], labels[:most], points[:most])
                    ids, labels, points = ids[most:], labels[most:], points[most:]
        if ids:
            yield block(ids, labels, points)

    return rows.mapInArrow(run, schema)


def _blocks(batch: pa.RecordBatch, width: int) -> Iterator[tuple[dict, list[dict[str, np.ndarray]], list[np.ndarray]]]:
    """Row, trees and parts by position of each block."""
    part = width // PARTS
    for i in range(batch.num_rows):
        row = batch.slice(i, 1).to_pylist()[0]
        points = np.frombuffer(row["points"], np.int32).astype(np.int64).reshape(-1, width)
        as_array = lambda n, raw: np.frombuffer(raw, np.int64 if n == "sum" else np.int32).astype(np.int64).reshape(*((-1, part) if n != "order" else (-1,)))
        yield row, [{n: as_array(n, row[n][p]) for n in TREES} for p in range(PARTS)], [points[:, p * part : (p + 1) * part] for p in range(PARTS)]


def improved(trees: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks (position, entry, component) after one round."""
    _, n, part = books.shape
    width = part * PARTS
    schema = StructType([StructField("slot", IntegerType()), StructField("total", LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((PARTS, n, part + 1), np.int64)
        for b in batches:
            for _, forest_, parts in _blocks(b, width):
                for p in range(PARTS):
                    total[p] += sums(forest_[p], parts[p], books[p])
        used = np.repeat((total[:, :, -1] > 0).ravel(), part + 1).nonzero()[0]
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total.ravel()[used])], schema=arrow)

    found = trees.select("points", *TREES).mapInArrow(run, schema).groupBy("slot").agg(F.sum("total").alias("total")).collect()  # at most the codebooks' own size
    total = np.zeros(PARTS * n * (part + 1), np.int64)
    for slot, value in found:
        total[slot] = value
    total = total.reshape(PARTS, n, part + 1)
    count = total[:, :, -1:]
    return np.where(count > 0, total[:, :, :-1] // np.maximum(count, 1), books)


def encoded(trees: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code, error of every row under the codebooks."""
    width = books.shape[2] * PARTS
    inner = lambda n: trees.schema[n].dataType.elementType
    schema = StructType([StructField("vec_id", inner("vec_id")), StructField("label", inner("label")), StructField("code", StringType()), StructField("error", LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, forest_, parts in _blocks(b, width):
                entry = np.stack([assigned(forest_[p], parts[p], books[p]) for p in range(PARTS)], 1)
                error = sum(((parts[p] - books[p][entry[:, p]]) ** 2).sum(1) for p in range(PARTS))
                codes = [e.tobytes().hex() for e in entry.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([pa.array(row["vec_id"], arrow.field(0).type), pa.array(row["label"], arrow.field(1).type), pa.array(codes), pa.array(error.astype(np.int64))], schema=arrow)

    return trees.mapInArrow(run, schema)


def fit(embeddings: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> tuple[DataFrame, np.ndarray] | None:
    """The written trees of all kept rows and the codebooks after ``rounds``; None without a kept row."""
    rows = kept(embeddings)
    longest = rows.agg(F.max(F.size("embedding"))).first()[0]
    if longest is None:
        return None
    width = -(-longest // PARTS) * PARTS
    first = [r["embedding"] for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).collect()]
    start = scaled(np.array([x for v in first for x in v], np.float64), np.cumsum([0, *map(len, first)]), width)
    books = start.reshape(len(first), PARTS, width // PARTS).transpose(1, 0, 2)
    trees = table(forest(rows, width))
    for _ in range(rounds):
        books = improved(trees, books)
    return trees, books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def query(embeddings: DataFrame) -> DataFrame:
    """Codes and errors of all kept rows, with their label's error and the digest of the codebooks."""
    fitted = fit(embeddings)
    if fitted is None:
        none = embeddings.select("vec_id", "label").limit(0)
        return none.select("vec_id", F.lit("").alias("code"), *[F.lit(0).cast("long").alias(c) for c in ("error", "label_error")], F.lit("").alias("codebooks_sha256"))
    rows = table(encoded(*fitted))
    totals = table(rows.groupBy(F.col("label").alias("label_")).agg(F.sum("error").alias("label_error")))
    both = rows.join(totals, F.col("label").eqNullSafe(F.col("label_")))
    return both.select("vec_id", "code", "error", "label_error", F.lit(digest(fitted[1])).alias("codebooks_sha256"))


# --- the same in SQL --------------------------------------------------------------------------------


def oracle() -> str:
    """Every part against every entry, round by round."""
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"""near{r} as materialized (select i, p, any_value(w) as w, min({{'d': list_dot_product(z, z) - 2 * list_dot_product(w, z), 'e': e}}) as best from parts join book{r} using (p) group by i, p)""")
        if r < ROUNDS:
            steps.append(f"""mean{r} as (select p, e, list(x order by k) as z from (select p, best.e as e, k, floor(sum(w[k]) / count(*)) as x from near{r}, range(1, (select max(len(w)) from parts) + 1) t(k) group by all) group by p, e),
book{r + 1} as materialized (select b.p, b.e, coalesce(m.z, b.z) as z from book{r} b left join mean{r} m on m.p = b.p and m.e = b.e)""")
    return f"""
with kept as materialized (select vec_id, label, row_number() over (order by vec_id nulls last, embedding) as i, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})) as v
    from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
parts as materialized (select i, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] as w from kept, range({PARTS}) t(p)),
book0 as materialized (select p, i - 1 as e, w as z from parts where i <= {ENTRIES}),
{", ".join(steps)},
coded as (select i, string_agg(lower(printf('%02x', best.e)), '' order by p) as code, sum(list_dot_product(w, w) + best.d)::BIGINT as error from near{ROUNDS} group by i),
digest as (select sha256(string_agg(z[k]::BIGINT::VARCHAR, ',' order by p, e, k)) as codebooks_sha256 from book{ROUNDS}, range(1, (select max(len(z)) from book0) + 1) t(k))
select vec_id, code, error, sum(error) over (partition by label)::BIGINT as label_error, codebooks_sha256 from kept join coded using (i), digest
"""
