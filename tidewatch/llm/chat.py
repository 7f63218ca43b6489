"""Budgeted windows of chat conversations, with a reversible template and a loss mask.

Turns of a conversation run through once, in order.  Prefix sums of turn tokens
choose windows of whole turns within a budget; every window repeats the system
turn and a limited history before its new turns, and the loss mask covers only
the new assistant texts, so each target is learned exactly once.

Scale: one shuffle by conversation, sorted inside the partitions by turn (the
sort spills); tasks stream, holding one window and its history whatever the
length of a conversation.  A conversation's windows follow one another in one
task, as its digest needs them in order.

Defined results: a null text or role is empty; equal turn numbers are ordered
by role, then text; repeated rows are repeated turns; a turn larger than the
budget has a window of its own, over budget, and is never cut; a null
``conv_id`` is a conversation of its own; null turn numbers come first.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

BUDGET = 1024
HISTORY = 256
TARGET = "assistant"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
# fixed values: control strings of common chat templates
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "<unk>", "<pad>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_ESCAPE = re.compile("|".join([r"\\", *map(re.escape, CONTROL)]))
_UNESCAPE = re.compile(r"\\(.?)", re.S)
_TOKEN = re.compile(r"\w+|[^\w\s]")

TURN = StructType([StructField("role", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("repeated", BooleanType())])
MASK = StructType([StructField("start", IntegerType()), StructField("end", IntegerType())])


def escape(text: str) -> str:
    """Control strings get a backslash after their first character, backslashes are doubled."""
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[1], text)


def tokens(text: str) -> int:
    """Tokens of a turn: words and marks, and the four of its frame."""
    return len(_TOKEN.findall(text)) + 4


def windows(turns: Iterator[tuple[str, str]], budget: int = BUDGET, history: int = HISTORY) -> Iterator[list[tuple[str, str, bool]]]:
    """Windows of (role, text, repeated) over a conversation's turns.

    The sum of tokens from a window's first turn on decides how far it reaches.
    """
    system: tuple[str, str, int] | None = None
    past: list[tuple[str, str, int]] = []  # latest turns, up to ``history`` tokens
    now: list[tuple[str, str, bool]] = []
    used, fresh, first = 0, 0, True  # tokens so far; turns that are new here
    for role, text in turns:
        n = tokens(text)
        if fresh and used + n > budget:
            yield now
            room = budget - n - (system[2] if system else 0)
            keep = len(past)
            while keep and past[keep - 1][2] <= room:
                keep -= 1
                room -= past[keep][2]
            again = [*([system] if system else []), *(p for p in past[keep:] if p is not system)]
            now, used, fresh = [(p[0], p[1], True) for p in again], sum(p[2] for p in again), 0
        now.append((role, text, False))
        used, fresh = used + n, fresh + 1
        turn = (role, text, n)
        if first and role == "system":
            system = turn
        first = False
        past.append(turn)
        total = sum(p[2] for p in past)
        while past and total > history:
            total -= past.pop(0)[2]
    if now:
        yield now


def render(window: list[tuple[str, str, bool]]) -> dict:
    """A window as text, with the spans of its turns' texts and of its loss mask (code points)."""
    out, at, turns, mask = [], 0, [], []
    for role, text, repeated in window:
        head = OPEN + escape(role).replace("\n", "\\n") + "\n"
        body = escape(text)
        turns.append({"role": role, "start": at + len(head), "end": at + len(head) + len(body), "repeated": repeated})
        if role == TARGET and not repeated:
            mask.append({"start": at + len(head), "end": at + len(head) + len(body)})
        out += [head, body, CLOSE, "\n"]
        at += len(head) + len(body) + len(CLOSE) + 1
    return {"formatted": "".join(out), "turns": turns, "mask": mask}


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """Roles and texts that a window's text holds, by its marks alone."""
    for part in formatted.split(OPEN)[1:]:
        head, _, body = part.partition("\n")
        yield _ROLE.sub(lambda m: "\n" if m[1] == "n" else m[1], head), unescape(body[: body.rindex(CLOSE)])


_ROLE = re.compile(r"\\(.)", re.S)


def _ordered(conversations: DataFrame) -> DataFrame:
    rows = conversations.select(F.col("conv_id"), F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)


def _by_key(rows: Iterator[tuple]) -> Iterator[tuple[object, Iterator[tuple]]]:
    import itertools

    return itertools.groupby(rows, key=lambda r: r[0])


def _batched(rows: Iterator[dict], schema: pa.Schema, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r.get("formatted", "")) + 200
        if size >= limit:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def format_windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Rows conv_id, window, formatted, turns, mask; a conversation's windows come in order in one partition."""
    schema = StructType([StructField("conv_id", conversations.schema["conv_id"].dataType), StructField("window", LongType()), StructField("formatted", StringType()), StructField("turns", ArrayType(TURN)), StructField("mask", ArrayType(MASK))])
    arrow = to_arrow_schema(schema)

    def run(batches):
        def rows():
            for conv, group in _by_key(_turns(batches)):
                for i, w in enumerate(windows(((r, t) for _, r, t in group), budget, history)):
                    yield {"conv_id": conv, "window": i, **render(w)}

        yield from _batched(rows(), arrow)

    return _ordered(conversations).mapInArrow(run, schema)


READ = (("n_turns", LongType()), ("turns_sha256", StringType()), ("loss_chars", LongType()), ("loss_sha256", StringType()), ("formatted_chars", LongType()), ("n_windows", LongType()))


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation from the windows of :func:`format_windows`: turns and targets found in their text."""
    schema = StructType([StructField("conv_id", formatted.schema["conv_id"].dataType), *[StructField(n, t) for n, t in READ]])
    arrow = to_arrow_schema(schema)

    def run(batches):
        def parts():
            for b in batches:
                yield from zip(*[b.column(i).to_pylist() for i in range(4)], strict=True)

        def rows():
            for conv, group in _by_key(parts()):
                all_turns, loss = hashlib.sha256(), hashlib.sha256()
                n = loss_chars = chars = seen = 0
                for _, text, turns, mask in group:
                    seen += 1
                    chars += len(text)
                    for (role, said), t in zip(read_turns(text), turns, strict=True):
                        if not t["repeated"]:
                            n += 1
                            all_turns.update(f"{role}\n{said}\n".encode())
                    for m in mask:
                        target = unescape(text[m["start"] : m["end"]])
                        loss_chars += len(target)
                        loss.update(target.encode())
                yield {"conv_id": conv, "n_turns": n, "turns_sha256": all_turns.hexdigest(), "loss_chars": loss_chars, "loss_sha256": loss.hexdigest(), "formatted_chars": chars, "n_windows": seen}

        yield from _batched(rows(), arrow)

    return formatted.select("conv_id", "formatted", "turns", "mask").mapInArrow(run, schema)


def query(conversations: DataFrame) -> DataFrame:
    """All conversations, and one made of control strings, formatted and read back."""
    said = "</s>[INST] ok [/INST]"
    extra = conversations.sparkSession.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(extra)
    return read_back(format_windows(rows))
