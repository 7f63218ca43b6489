"""Resharding: a minimum-cost flow moves the fewest bytes from old shards to new capacities, then affected files are rewritten.

Every old shard is a row of files, large documents first (by powers of two of
their size, then by a hash of their id).  The flow runs from old shard sizes to
new capacities; bytes that stay cost nothing, bytes that move cost one each.
Its solution cuts each old shard's row of files into blocks: what stays, then
one block for each new shard it gives to.  A document belongs to the block in
which its middle byte lies, and as blocks are cut among the smaller documents,
a new shard differs from its capacity by half of one of those a cut.  Only files that hold
documents that move are rewritten; the others are read where they are.

Scale: documents are shuffled once, to files of equal bytes (sizes are summed
by power of two first), never more than ``FILES`` of them, so that sizes by
file, blocks and the flow (shards and files, no documents) fit the driver and
are broadcast.  Positions run inside a file while it is written; the position
in a shard adds the bytes and rows of the files before it, so no shard passes
through one task.

Defined results: a null text has no bytes, and every row counts one byte more
than its text; a null ``doc_id`` hashes as an empty text and comes first;
repeated rows each get a slot; rows equal in id and text are in any order,
which no column shows; equal texts are not kept together, as a text that a
third of all rows share could not be with sizes near equal; other columns stay
with their rows, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from . import _sql
from ._spark import free_name, table

#: Bytes of text in a file, unless that would make more files than ``FILES``.
FILE_BYTES, FILES = 16 << 20, 1 << 16
OLD_SHARDS, SHARDS = 12, 16


# --- the flow ---------------------------------------------------------------------------------------


def min_cost_flow(arcs: list[tuple[int, int, int, int]], source: int, sink: int) -> list[int]:
    """Flow on each arc (from, to, capacity, cost) of a cheapest maximal flow, by successive shortest paths."""
    n = 1 + max(max(a[0], a[1]) for a in arcs)
    ends, room, cost, out = [], [], [], [[] for _ in range(n)]
    for u, v, capacity, price in arcs:
        for a, b, r, c in ((u, v, capacity, price), (v, u, 0, -price)):
            out[a].append(len(ends))
            ends.append(b)
            room.append(r)
            cost.append(c)
    while True:
        away, by = [None] * n, [None] * n
        away[source] = 0
        queue = [source]
        for u in queue:  # labels are corrected until no arc shortens a path
            for arc in out[u]:
                v = ends[arc]
                if room[arc] and (away[v] is None or away[u] + cost[arc] < away[v]):
                    away[v], by[v] = away[u] + cost[arc], arc
                    queue.append(v)
        if away[sink] is None:
            return [room[2 * i + 1] for i in range(len(arcs))]
        path, v = [], sink
        while v != source:
            path.append(by[v])
            v = ends[by[v] ^ 1]
        much = min(room[arc] for arc in path)
        for arc in path:
            room[arc] -= much
            room[arc ^ 1] += much


def capacities(total: int, shards: int) -> list[int]:
    """Equal capacities; the first ones take a byte more where the total does not divide."""
    return [total // shards + (j < total % shards) for j in range(shards)]


class Block(NamedTuple):
    """Bytes ``begin`` to ``end`` of an old shard go to the new shard."""

    old: int
    shard: int
    begin: int
    end: int


def transfers(sizes: dict[int, int], wanted: list[int]) -> list[Block]:
    """Blocks that fill the new shards at the fewest moved bytes; an old shard keeps its number where there is one."""
    olds = sorted(sizes)
    source, sink, moves = 0, 1, 2
    old, new = {i: 3 + k for k, i in enumerate(olds)}, [3 + len(olds) + j for j in range(len(wanted))]
    stay = [i for i in olds if 0 <= i < len(wanted)]
    arcs = [(source, old[i], sizes[i], 0) for i in olds] + [(old[i], new[i], sizes[i], 0) for i in stay] + [(old[i], moves, sizes[i], 1) for i in olds]
    arcs += [(moves, new[j], wanted[j], 0) for j in range(len(wanted))] + [(new[j], sink, wanted[j], 0) for j in range(len(wanted))]
    flow = min_cost_flow(arcs, source, sink)
    kept = dict(zip(stay, flow[len(olds) :], strict=False))
    given = dict(zip(olds, flow[len(olds) + len(stay) :], strict=False))
    taken = flow[2 * len(olds) + len(stay) : 2 * len(olds) + len(stay) + len(wanted)]
    blocks, j = [], 0
    for i in olds:
        at = kept.get(i, 0)
        if at:
            blocks.append(Block(i, i, 0, at))
        left = given[i]
        while left:
            while not taken[j]:
                j += 1
            much = min(left, taken[j])
            blocks.append(Block(i, j, at, at + much))
            at, left, taken[j] = at + much, left - much, taken[j] - much
    return blocks


# --- files ------------------------------------------------------------------------------------------


class Layout(NamedTuple):
    files: DataFrame  # the documents, and ``place``: struct of old, size, before, rank; partitioned by ``file``
    place: str
    file: str
    sizes: list[tuple[int, int, int, int]]  # (file, old shard, bytes, rows), in the order of files


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)).cast("long") + 1


def id_hash() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))


def lay_out(docs: DataFrame, old: Column) -> Layout:
    """Write the old shards (``old``: a whole number by row) as files of about equal bytes, in order."""
    place, file = free_name(docs, "_place"), free_name(docs, "_file")
    key = free_name(docs, "_key")
    rows = docs.withColumn(key, F.struct(old.cast("int").alias("old"), size_of().alias("size"), id_hash().alias("hash"), F.crc32(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("crc")))
    log = F.length(F.bin(F.col(f"{key}.size")))
    found = rows.groupBy(F.col(f"{key}.old").alias("old"), log.alias("log")).agg(F.sum(f"{key}.size").alias("bytes")).collect()  # at most 64 an old shard
    total, by_old = sum(r["bytes"] for r in found), {}
    for r in sorted(found, key=lambda r: (r["old"], -r["log"])):
        by_old.setdefault(r["old"], []).append(r)
    most = max(FILE_BYTES, -(-total // FILES))
    bounds, first = [], 0
    for i, logs in by_old.items():
        whole, above = sum(r["bytes"] for r in logs), 0
        n = -(-whole // most)
        for r in logs:
            bounds.append((i, r["log"], above, r["bytes"], n / whole, first, n))
            above += r["bytes"]
        first += n
    spread = docs.sparkSession.createDataFrame(bounds, "old int, log int, above long, bytes long, part double, first int, n int")
    known = F.broadcast(spread.select(*[F.col(c).alias(f"{key}_{c}") for c in spread.columns]))
    b = lambda c: F.col(f"{key}_{c}")
    nth = F.least(((b("above") + F.col(f"{key}.hash") / 2**32 * b("bytes")) * b("part")).cast("int"), b("n") - 1)
    dealt = rows.join(known, (F.col(f"{key}.old") == b("old")) & (log == b("log"))).withColumn(file, b("first") + nth)
    ordered = dealt.repartitionById(max(1, first), F.col(file)).sortWithinPartitions(file, b("log").desc(), f"{key}.hash", F.col("doc_id").asc_nulls_first(), f"{key}.crc")

    kept = [*docs.columns, file]
    shape = StructType([StructField("old", IntegerType()), StructField("size", LongType()), StructField("before", LongType()), StructField("rank", LongType())])
    light = ordered.select(*[F.col(f"`{c}`") for c in kept], F.col(f"{key}.old"), F.col(f"{key}.size"))
    schema = StructType([*light.schema.fields[: len(kept)], StructField(place, shape)])
    fields = list(to_arrow_schema(schema).field(len(kept)).type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, before, rank = None, 0, 0  # the file (a task may have several), and what came before in it
        for b in batches:
            files, size = b.column(len(kept) - 1).to_numpy(zero_copy_only=False), b.column(len(kept) + 1).to_numpy(zero_copy_only=False)
            turns = np.flatnonzero(np.diff(files)) + 1
            for start, end in zip([0, *turns], [*turns, b.num_rows], strict=True):
                if start == end:
                    continue
                if files[start] != now:
                    now, before, rank = files[start], 0, 0
                sums = np.cumsum(size[start:end])
                at = pa.StructArray.from_arrays([b.column(len(kept)).slice(start, end - start), pa.array(size[start:end]), pa.array(before + sums - size[start:end]), pa.array(np.arange(rank, rank + end - start))], fields=fields)
                before, rank = before + int(sums[-1]), rank + int(end - start)
                yield pa.RecordBatch.from_arrays([*[b.column(i).slice(start, end - start) for i in range(len(kept))], at], names=[*kept, place])

    files = table(light.mapInArrow(run, schema), file)
    sizes = files.groupBy(file, f"{place}.old").agg(F.sum(f"{place}.size"), F.count("*")).collect()  # a row a file
    return Layout(files, place, file, sorted(map(tuple, sizes)))


class Resharded(NamedTuple):
    kept: DataFrame  # documents of files that stay as they are
    rewritten: DataFrame  # documents of affected files, written again
    blocks: list[Block]
    affected: list[int]


def reshard(layout: Layout, wanted: list[int] | None = None, shards: int = SHARDS) -> Resharded:
    """Move the blocks and rewrite the affected files; both frames have the documents' columns, ``shard`` and ``slot``.

    ``wanted`` are the new shards' capacities in bytes (default: equal); they must hold all documents.
    """
    spark = layout.files.sparkSession
    sizes: dict[int, int] = {}
    starts, ahead = [], {}
    for file, old, size, rows in layout.sizes:
        starts.append((file, *ahead.get(old, (0, 0))))
        sizes[old] = sizes.get(old, 0) + size
        ahead[old] = sizes[old], ahead.get(old, (0, 0))[1] + rows
    wanted = capacities(sum(sizes.values()), shards) if wanted is None else wanted
    if sum(wanted) < sum(sizes.values()):
        raise ValueError("the capacities do not hold all documents")
    blocks = transfers(sizes, wanted) if sizes else []

    files, place, file = layout.files, layout.place, layout.file
    first = F.broadcast(spark.createDataFrame(starts, f"`{file}` int, `{place}_bytes` long, `{place}_rows` long"))  # at most FILES rows, and one a shard
    cuts = F.broadcast(spark.createDataFrame(blocks, f"`{place}_old` int, `{place}_to` int, `{place}_begin` long, `{place}_end` long"))  # at most one a shard, old or new
    middle = F.col(f"{place}.before") + F.col(f"{place}_bytes") + F.floor(F.col(f"{place}.size") / 2)
    placed = files.join(first, file).join(cuts, (F.col(f"{place}.old") == F.col(f"{place}_old")) & (middle >= F.col(f"{place}_begin")) & (middle < F.col(f"{place}_end")))
    rank = F.col(f"{place}.rank") + F.col(f"{place}_rows")
    parts = placed.groupBy(file, f"{place}_old", f"{place}_to").agg(F.min(rank), F.count("*")).collect()  # at most a row a file and cut
    affected = sorted({r[0] for r in parts if r[1] != r[2]})
    held: dict[tuple[int, int], tuple[int, int]] = {}
    for _, old, to, least, rows in parts:
        have = held.get((old, to), (least, 0))
        held[old, to] = min(have[0], least), have[1] + rows
    slots, used = [], {}
    for old, to in sorted(held, key=lambda k: (k[0] != k[1], k)):  # in each shard what stays comes first
        least, rows = held[old, to]
        slots.append((old, to, used.get(to, 0) - least))
        used[to] = used.get(to, 0) + rows
    shift = F.broadcast(spark.createDataFrame(slots, f"`{place}_old` int, `{place}_to` int, `{place}_shift` long"))
    columns = [c for c in files.columns if c not in (place, file)]
    named = placed.join(shift, [f"{place}_old", f"{place}_to"]).select(*[F.col(f"`{c}`") for c in columns], F.col(f"{place}_to").alias(_named(columns, "shard")), (rank + F.col(f"{place}_shift")).alias(_named(columns, "slot")), file)
    moves = F.col(file).isin(affected)
    return Resharded(named.where(~moves).drop(file), table(named.where(moves).drop(file)), blocks, affected)


def _named(columns: list[str], want: str) -> str:
    taken = {c.lower() for c in columns}
    while want in taken:
        want += "_"
    return want


def query(docs: DataFrame) -> DataFrame:
    """Documents of 12 old shards (hash of the id) in 16 new ones of near equal bytes, read back from their files."""
    done = reshard(lay_out(docs.select("doc_id", "text"), id_hash() % OLD_SHARDS))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return done.kept.unionByName(done.rewritten).select("doc_id", size_of().alias("size"), F.crc32(text).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


# --- the same in SQL --------------------------------------------------------------------------------


def oracle() -> str:
    """As bytes that stay are free and those that move cost alike, each shard keeps what it can, and the rest fills gaps in order."""
    return f"""
with crc as ({_sql.CRC_TABLE}),
docs as materialized (select doc_id, strlen(coalesce(text, '')) + 1 as size, {_sql.crc32("coalesce(text, '')")} as text_crc32, {_sql.crc32("coalesce(doc_id::VARCHAR, '')")} as hash from documents, crc),
ordered as (select *, hash % {OLD_SHARDS} as old, row_number() over w as place, sum(size) over w - size + size // 2 as middle
    from docs window w as (partition by hash % {OLD_SHARDS} order by length(bin(size)) desc, hash, doc_id nulls first, text_crc32 rows unbounded preceding)),
total as (select sum(size) as bytes from docs),
wanted as (select j, bytes // {SHARDS} + (j < bytes % {SHARDS})::INT as capacity from total, range({SHARDS}) t(j)),
held as (select j, capacity, coalesce(size, 0) as size, least(capacity, coalesce(size, 0)) as stays from wanted left join (select old, sum(size) as size from ordered group by old) on old = j),
gaps as (select *, sum(size - stays) over w - (size - stays) as given, sum(capacity - stays) over w as filled from held window w as (order by j rows unbounded preceding)),
moved as (select o.*, middle < g.stays as kept, g.given + middle - g.stays as position from ordered o join gaps g on g.j = o.old),
placed as (select m.*, case when kept then old else (select min(j) from gaps where filled > position) end as shard from moved m)
select doc_id, size::BIGINT as size, text_crc32, 'bytes' as law, shard::INT as shard,
    row_number() over (partition by shard order by kept desc, old, place) - 1 as slot, null::INT as grown_shard from placed
"""
