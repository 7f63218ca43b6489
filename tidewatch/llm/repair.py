"""Repair of damaged conversations: cheapest edits to ``(s?(ua)+)?`` by dynamic programming over a shared trie.

A conversation's rows become a signature, one letter a row for its role and its
fault.  Sorted signatures are inserted into a prefix trie: a layer of the
dynamic program belongs to a trie node, so it is computed once for all
signatures that share the prefix, and a terminal node gives the answer of every
conversation that ends there.  Signatures come in order, so only the nodes of
the latest path are held.

Scale: faults and signatures travel without texts (about 80 bytes a row), dealt
by conversation, role and text, then by ranges of conversation and turn, so
neither a large conversation nor a frequent turn lands in one task.  A
signature takes one byte a row; signatures are dealt by ranges of themselves
and their conversation, so one that a third of all conversations share is
spread.  Texts are shuffled once, by conversation, and streamed: the digest of
a conversation needs its rows in order, so one conversation is one task there,
with a letter a row in memory and rows sorted on disk.

Defined results: a null role or text is one space, as is a null conversation or
turn inside the damage key; null turns come first; equal turns are ordered by
role as given, then by SHA-256 of the text as given; a repeated row is two
rows, the second a duplicate; a null ``conv_id`` is a conversation of its own;
a role of other initial than s, u, a (an empty one too) cannot be kept; other
columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from . import _sql
from ._spark import table

ROLES, FAULTS = "sua", ("clean", "truncated", "blank", "duplicate")
KEEP, REROLE, DELETE, INSERT = "KRDI"
#: State of an edited conversation by what it ends with: nothing, system, user, assistant.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
AFTER = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
WANTED = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: How far a state can cost more than another (column) and still be on a cheapest way; the other one can follow with edits of that cost.
SLACK = {(NOTHING, ASSISTANT): 3, (NOTHING, USER): 5, (SYSTEM, ASSISTANT): 0, (SYSTEM, NOTHING): 0, (SYSTEM, USER): 2, (USER, ASSISTANT): 2, (USER, NOTHING): 2, (USER, SYSTEM): 2, (ASSISTANT, USER): 2, (ASSISTANT, NOTHING): 0}
START = ((0, 0), None, None, None)


def letter(role: str, fault: int) -> str:
    """One letter for a role's initial and a fault."""
    return chr(97 + 4 * (ROLES.find(role) if role in ROLES and role else 3) + fault)


def _inserted(state: int) -> Iterator[tuple[int, int, str]]:
    """States reached by inserting turns, with cost and letters; two inserts reach all that any number reaches."""
    cost, said = 0, ""
    for _ in range(3):
        yield state, cost, said
        state, cost, said = WANTED[state], cost + 2, said + INSERT


@lru_cache(maxsize=1 << 16)
def step(layer: tuple, symbol: str) -> tuple[tuple, int, tuple]:
    """The layer after one more row, what its cheapest state costs more, and each state's way (previous state, letters).

    A layer holds (cost above the cheapest, rank of the edits in ASCII order) by
    state.  All edit strings of a layer consume the same rows and end with the
    last of them, so none is a proper prefix of another and ranks order them.
    """
    role, fault = divmod(ord(symbol) - 97, 4)
    best: list = [None] * 4
    for source, held in enumerate(layer):
        if held is None:
            continue
        for state, more, said in _inserted(source):
            ways = [(state, 3, DELETE)]
            if fault < 2:
                ways += [(AFTER[state, r], 2 + fault, REROLE) for r in "ua" if (state, r) in AFTER]
                if role < 3 and (state, ROLES[role]) in AFTER:
                    ways.append((AFTER[state, ROLES[role]], fault, KEEP))
            for to, cost, edit in ways:
                way = (held[0] + more + cost, held[1], said + edit, source)
                if best[to] is None or way < best[to]:
                    best[to] = way
    low = min(b[0] for b in best if b)
    alive = [b is not None and not any(best[o] and b[0] > best[o][0] + by for (s, o), by in SLACK.items() if s == state) for state, b in enumerate(best)]
    order = sorted((b[1:3], state) for state, b in enumerate(best) if alive[state])
    rank = {state: i for i, (_, state) in enumerate(order)}
    return tuple((b[0] - low, rank[s]) if alive[s] else None for s, b in enumerate(best)), low, tuple((b[3], b[2]) if alive[s] else None for s, b in enumerate(best))


class Trie:
    """Signatures inserted in order; ``answer`` gives (cost, audit) at the terminal node of the latest one.

    ``nodes`` holds the steps on the path to it; nodes that a later signature
    cannot share any more are let go as the path turns away from them.
    """

    def __init__(self) -> None:
        self.path, self.nodes, self.computed = "", [], 0
        self._answer: tuple[int, str] | None = None

    def insert(self, signature: str) -> None:
        if signature == self.path and self._answer is not None:
            return
        shared = 0
        for a, b in zip(self.path, signature, strict=False):
            if a != b:
                break
            shared += 1
        del self.nodes[shared:]
        layer = self.nodes[-1][0] if self.nodes else START
        for symbol in signature[shared:]:
            self.nodes.append(step(layer, symbol))
            layer = self.nodes[-1][0]
        self.computed += len(signature) - shared
        self.path, self._answer = signature, None

    def answer(self) -> tuple[int, str]:
        if self._answer is None:
            layer = self.nodes[-1][0] if self.nodes else START
            ends = [(held[0] + more, held[1], said, source) for source, held in enumerate(layer) if held for state, more, said in _inserted(source) if state in (NOTHING, ASSISTANT)]
            cost, _, said, state = min(ends)
            parts = [said]
            for _, more, ways in reversed(self.nodes):
                cost += more
                state, said = ways[state]
                parts.append(said)
            self._answer = cost, "".join(reversed(parts))
        return self._answer


def edited(rows: Iterator[tuple[str, str]], audit: str) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of a conversation's turns after its edits; ``rows`` are (role, text) in order."""
    state = NOTHING
    for edit in audit:
        role, text = next(rows) if edit != INSERT else ("", "")
        if edit == DELETE:
            continue
        if edit == KEEP:
            state = AFTER[state, role[0]]
        else:
            state = WANTED[state]
            role = "user" if state == USER else "assistant"
        yield edit, role, text


# --- rows, damage, faults ---------------------------------------------------------------------------


def damage_key() -> Column:
    return F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c != ":" else F.lit(":") for c in ("conv_id", ":", "turn")])


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows after damage: conv_id, turn, first_role and tie (their order), copy (null: the row is dropped), role, text."""
    kind, space = F.crc32(damage_key()) % 20, F.lit(" ")
    rows = conversations.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), space).alias("first_role"), F.coalesce(F.col("text").cast("string"), space).alias("text"), kind.alias("kind"))
    copies = F.when(F.col("kind") == 0, F.array(F.lit(None).cast("int"))).when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", "first_role", F.unhex(F.sha2("text", 256)).alias("tie"), F.explode(copies).alias("copy"), F.when(F.col("kind") == 4, "user").otherwise(F.col("first_role")).alias("role"), text.alias("text"))


ORDER = ("turn", "first_role", "tie", "copy")


def marked(rows: DataFrame) -> DataFrame:
    """Rows without their texts: conv_id, the order, and the letter of role and fault (null: no row is left)."""
    from pyspark.sql import Window

    last = F.right(F.expr(r"trim(TRAILING ' \t\n\u000b\u000c\r' FROM text)"), F.lit(1))
    initial = F.left(F.col("role"), F.lit(1))
    place = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    light = rows.select("conv_id", *ORDER, F.when(F.col("copy").isNotNull(), place).alias("place"), F.when(last == "", 2).when(last.isin(".", "!", "?"), 0).otherwise(1).alias("fault"), F.unhex(F.sha2(F.concat("role", F.lit("\n"), "text"), 256)).alias("same"), F.length("role").alias("cut"))
    seen = F.row_number().over(Window.partitionBy("conv_id", "same", "cut").orderBy(*[F.col(c).asc_nulls_first() for c in ORDER]))
    fault = F.when(F.col("fault") == 2, 2).when(F.col("seen") > 1, 3).otherwise(F.col("fault"))
    return light.withColumn("seen", seen).select("conv_id", *ORDER, "seen", F.char(97 + 4 * F.col("place") + fault).alias("letter"))


def signatures(marks: DataFrame) -> DataFrame:
    """conv_id, signature, gaps: one row per conversation, a letter a row left of it.

    Rows are dealt by ranges of conversation and order; every task turns its run
    of a conversation into one piece, and the pieces of a conversation (at most
    one a task) are put together in the order of the ranges.
    """
    kind = marks.schema["conv_id"].dataType
    piece = StructType([StructField("conv_id", kind), StructField("signature", StringType()), StructField("first", LongType()), StructField("last", LongType()), StructField("turns", LongType())])
    arrow = to_arrow_schema(piece)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = object()
        conv, said, first, last, turns, done = none, [], None, None, 0, []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(arrow.names, row, strict=True)) for row in done], schema=arrow)

        for b in batches:
            for c, turn, mark in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
                if conv is none or c != conv:
                    if conv is not none:
                        done.append((conv, "".join(said), first, last, turns))
                    conv, said, first, last, turns = c, [], None, None, 0
                if mark is not None:
                    said.append(mark)
                    if turn is not None:
                        first = turn if first is None else first
                        turns += turn != last
                        last = turn
            if len(done) >= 2000:
                yield batch()
                done.clear()
        if conv is not none:
            done.append((conv, "".join(said), first, last, turns))
        yield batch()

    ordered = marks.withColumn("turn", F.col("turn").cast("long"))
    by = [F.col(c).asc_nulls_first() for c in ("conv_id", *ORDER, "seen")]  # of rows alike in all, the duplicates come later
    runs = ordered.repartitionByRange(*by).sortWithinPartitions(*by).select("conv_id", "turn", "letter").mapInArrow(pieces, piece)
    run = F.struct(F.spark_partition_id().alias("task"), "signature", "first", "last", "turns")
    whole = runs.select("conv_id", run.alias("run")).groupBy("conv_id").agg(F.array_sort(F.collect_list("run")).alias("runs"))
    # a turn that ends one run and begins the next is one turn
    turns = F.aggregate("runs", F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("last")), lambda a, r: F.struct((a["n"] + r["turns"] - F.when(a["last"] == r["first"], 1).otherwise(0)).alias("n"), F.coalesce(r["last"], a["last"]).alias("last")))["n"]
    span = F.array_max("runs.last") - F.array_min("runs.first") + 1
    return whole.select("conv_id", F.array_join("runs.signature", "").alias("signature"), F.coalesce(span - turns, F.lit(0)).alias("gaps"))


ANSWER = (("blank", LongType()), ("duplicate", LongType()), ("truncated", LongType()), ("illegal", LongType()), ("cost", LongType()), ("audit", StringType()))


def facts(signature: str) -> tuple[int, int, int, int]:
    """Blank, duplicate and truncated rows, and pairs of neighbours that do not follow one another."""
    faults = [signature.count(chr(97 + 4 * r + f)) for f in (2, 3, 1) for r in range(4)]
    places = [(ord(c) - 97) // 4 for c in signature]
    legal = sum(pair in ((0, 1), (1, 2), (2, 1)) for pair in zip(places, places[1:], strict=False))
    return sum(faults[:4]), sum(faults[4:8]), sum(faults[8:]), max(0, len(places) - 1) - legal


def audits(signed: DataFrame) -> DataFrame:
    """``signed`` with the facts, cost and audit of its signatures: sorted insertion into one trie a task."""
    schema = StructType([signed.schema["conv_id"], signed.schema["gaps"], *[StructField(n, t) for n, t in ANSWER]])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, known, said = Trie(), None, None
        for b in batches:
            found, size = [], 0
            for conv, gaps, signature in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
                if signature != known:
                    trie.insert(signature)
                    known, said = signature, (*facts(signature), *trie.answer())
                found.append(dict(zip(arrow.names, (conv, gaps, *said), strict=True)))
                size += len(signature) + 100
                if size > 4 << 20:
                    yield pa.RecordBatch.from_pylist(found, schema=arrow)
                    found, size = [], 0
            yield pa.RecordBatch.from_pylist(found, schema=arrow)

    by = [F.col("signature"), F.col("conv_id").asc_nulls_first()]
    return signed.repartitionByRange(*by).sortWithinPartitions(*by).select("conv_id", "gaps", "signature").mapInArrow(run, schema)


# --- repaired turns ---------------------------------------------------------------------------------

FACTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def _streamed(conversations: DataFrame) -> DataFrame:
    """Per conversation a row of its facts (null position), then its repaired turns in order, in one partition."""
    rows = damaged(conversations)
    found = audits(table(signatures(marked(rows))))
    kept = rows.where(F.col("copy").isNotNull())
    names = ("conv_id", "head", *ORDER, "role", "text", *FACTS)
    empty = lambda df, have: df.select(*[F.col(c) if c in have else F.lit(None).cast({"head": "int", "copy": "int", "tie": "binary", "turn": rows.schema["turn"].dataType, "first_role": "string", "role": "string", "text": "string", "audit": "string"}.get(c, "long")).alias(c) for c in names])
    heads = empty(found.withColumn("head", F.lit(0)), {"conv_id", "head", *FACTS})
    turns = empty(kept.withColumn("head", F.lit(1)), {"conv_id", "head", *ORDER, "role", "text"})
    both = heads.unionByName(turns).repartition("conv_id").sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in ("conv_id", "head", *ORDER)])
    schema = StructType([StructField("conv_id", rows.schema["conv_id"].dataType), StructField("position", LongType()), StructField("edit", StringType()), StructField("role", StringType()), StructField("text", StringType()), *[StructField(n, StringType() if n == "audit" else LongType()) for n in FACTS]])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flat() -> Iterator[tuple]:
            for b in batches:
                yield from zip(*[b.column(i).to_pylist() for i in range(b.num_columns)], strict=True)

        rows = flat()
        after: list[tuple] = []  # the head that ended the conversation before

        def texts() -> Iterator[tuple[str, str]]:
            for r in rows:
                if r[1] == 0:
                    after.append(r)
                    return
                yield r[2], r[3]

        def turns() -> Iterator[dict]:
            for head in iter(lambda: after.pop() if after else next(rows, None), None):
                yield {"conv_id": head[0], **dict(zip(FACTS, head[4:], strict=True))}
                said = texts()
                for i, (edit, role, text) in enumerate(edited(said, head[-1])):
                    yield {"conv_id": head[0], "position": i, "edit": edit, "role": role, "text": text}
                for _ in said:  # steps past rows deleted at the end to the next head
                    pass

        held, size = [], 0
        for turn in turns():
            held.append(turn)
            size += 100 + len(turn.get("text") or "") + len(turn.get("audit") or "")
            if size > 4 << 20:
                yield pa.RecordBatch.from_pylist(held, schema=arrow)
                held, size = [], 0
        yield pa.RecordBatch.from_pylist(held, schema=arrow)

    return both.select("conv_id", "head", "role", "text", *FACTS).mapInArrow(run, schema)


def repair(conversations: DataFrame) -> DataFrame:
    """The turns of all damaged conversations after their cheapest edits: conv_id, position, edit, role, text."""
    return _streamed(conversations).where(F.col("position").isNotNull()).select("conv_id", "position", "edit", "role", "text")


def query(conversations: DataFrame) -> DataFrame:
    """One row per conversation: facts, cost and audit, and the digest of its repaired turns."""
    streamed = _streamed(conversations)
    schema = StructType([streamed.schema["conv_id"], *[streamed.schema[n] for n in FACTS], StructField("repaired_sha256", StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, digest = None, None
        for b in batches:
            done = []
            for r in b.to_pylist():
                if r["position"] is None:
                    if head is not None:
                        done.append(head | {"repaired_sha256": digest.hexdigest()})
                    head, digest = {n: r[n] for n in ("conv_id", *FACTS)}, hashlib.sha256()
                else:
                    digest.update(f"{chr(10) if r['position'] else ''}{r['role']}:{r['text']}".encode())
            yield pa.RecordBatch.from_pylist(done, schema=arrow)
        if head is not None:
            yield pa.RecordBatch.from_pylist([head | {"repaired_sha256": digest.hexdigest()}], schema=arrow)

    return streamed.mapInArrow(run, schema)


# --- the same in SQL --------------------------------------------------------------------------------


def oracle() -> str:
    """Row by row over four states, each the cheapest edits so far as (cost, string)."""
    more = lambda s, cost, say: f"if({s} is null, null, {{'c': {s}.c + {cost}, 's': {s}.s || '{say}'}})"
    least = lambda *ways: f"list_min(list_filter([{', '.join(ways)}], lambda w: w is not null))"
    keep = lambda s, role: f"if(dead or ini <> '{role}', null, {more(s, 'cut', 'K')})"
    turn = lambda s: f"if(dead, null, {more(s, '2 + cut', 'R')})"
    gone = lambda s: more(s, 3, "D")
    return f"""
with recursive crc as ({_sql.CRC_TABLE}),
src as (select conv_id, turn, coalesce(role, ' ') as first_role, coalesce(text, ' ') as given,
        {_sql.crc32("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 as kind from conversations, crc),
rows_ as (select conv_id, turn, first_role, sha256(given) as tie, copy, if(kind = 4, 'user', first_role) as role,
        case kind when 1 then '' when 2 then regexp_replace(given, '[.!?]', '', 'g') else given end as text
    from src, (values (0), (1)) c(copy) where kind <> 0 and (copy = 0 or kind = 3)),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, first_role, tie, copy) as rn,
        left(role, 1) as ini, right(regexp_replace(text, '[\\x20\\x09-\\x0D]+\\z', ''), 1) as ending from rows_),
numbered as (select *, row_number() over (partition by conv_id, role, text order by rn) as nth from placed),
judged as (select *, case when ending = '' then 'blank' when nth > 1 then 'duplicate' when ending not in ('.', '!', '?') then 'truncated' else '' end as fault,
        lag(ini) over (partition by conv_id order by rn) as before from numbered),
marks as (select *, fault in ('blank', 'duplicate') as dead, (fault = 'truncated')::BIGINT as cut from judged),
kept as (select conv_id, count(*) as n,
        coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::BIGINT as gaps,
        count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
        count(*) filter (before is not null and before || ini not in ('su', 'ua', 'au')) as illegal
    from marks group by conv_id),
steps as (
    select conv_id, n, 0::BIGINT as i, {{'c': 0::BIGINT, 's': ''}} as nothing, null::STRUCT(c BIGINT, s VARCHAR) as sys, null::STRUCT(c BIGINT, s VARCHAR) as usr, null::STRUCT(c BIGINT, s VARCHAR) as ast from kept
    union all
    select o.conv_id, o.n, o.i + 1, {gone("nothing")}, {least(keep("nothing", "s"), gone("sys"))},
        {least(gone("e_usr"), *[w(s) for s in ("nothing", "sys", "e_ast") for w in (lambda s: keep(s, "u"), turn)])},
        {least(gone("e_ast"), keep("e_usr", "a"), turn("e_usr"))}
    from (select *, {least("ast", more("e_usr", 2, "I"))} as e_ast from (select *, {least("usr", *[more(s, 2, "I") for s in ("nothing", "sys", "ast")])} as e_usr from steps)) o
    join marks m on m.conv_id is not distinct from o.conv_id and m.rn = o.i + 1),
ended as (select conv_id, {least("nothing", "ast", more("usr", 2, "I"), more("nothing", 4, "II"), more("sys", 4, "II"))} as best from steps where i = n),
edits as (select conv_id, best.s as audit, unnest(range(1, len(best.s) + 1)) as p from ended),
written as (select e.conv_id, p, substr(audit, p, 1) as edit,
        len(regexp_replace(substr(audit, 1, p), 'I', '', 'g')) as rn, len(regexp_replace(substr(audit, 1, p), 'D', '', 'g')) as place from edits e),
turns as (select w.conv_id, p, edit, place, m.role, m.text, m.ini from written w left join marks m on m.conv_id is not distinct from w.conv_id and m.rn = w.rn where edit <> 'D'),
opened as (select *, bool_or(place = 1 and edit = 'K' and ini = 's') over (partition by conv_id) as with_system from turns),
said as (select conv_id, sha256(string_agg(case edit when 'K' then role else if((place + with_system::INT) % 2 = 1, 'user', 'assistant') end || ':' || if(edit = 'I', '', text), chr(10) order by p)) as digest from opened group by conv_id)
select c.conv_id, coalesce(gaps, 0)::BIGINT as gaps, coalesce(blank, 0)::BIGINT as blank, coalesce(duplicate, 0)::BIGINT as duplicate, coalesce(truncated, 0)::BIGINT as truncated,
    coalesce(illegal, 0)::BIGINT as illegal, coalesce(e.best.c, 0)::BIGINT as cost, coalesce(e.best.s, '') as audit, coalesce(d.digest, sha256('')) as repaired_sha256
from (select distinct conv_id from conversations) c
left join kept k on k.conv_id is not distinct from c.conv_id left join ended e on e.conv_id is not distinct from c.conv_id left join said d on d.conv_id is not distinct from c.conv_id
"""
