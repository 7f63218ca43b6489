"""Secret scan over a trigram inverted index, in DataFrame functions only.

Each rule's regular expression yields a Boolean trigram query: a disjunction of
clauses, each the trigrams that some match must hold.  The index maps the
trigrams of all queries to the texts that hold them; postings are intersected
per clause by one aggregation, and only candidate texts meet the expressions.
A rule without mandatory trigrams (a run of hexadecimal digits) scans fully.

Offsets come without any regex position function: between the pieces of
``split`` lie the matches of ``regexp_extract_all``, so running lengths give
every start in code points.

Scale: the index is keyed by a digest of the text, so copies of one text are one
entry (pre-aggregated before the shuffle); clauses are a small literal table.
Candidates join texts by digest: they are written as one row per digest, so Spark
broadcasts them while they are small, and may split a hot digest's texts beyond.

Defined results: a null text is empty; matches per rule are leftmost and do not
overlap; a match too short is dropped without another try; repeated rows repeat;
an empty table gives no rows; a column named like the result stays, the result
takes a longer name; any number of matches in a text costs in proportion to it.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from re import _parser as _syntax

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import free_name, table


@dataclass(frozen=True)
class Rule:
    """``group`` of a match must have ``least`` characters; base rules make the base digest."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, True),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32, True),  # a run of 32 or more is a longest run of [0-9a-f]+ with 32 or more
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("private", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
_MOST = 64
_RUN = 256


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Clauses (sets of lower-case trigrams): every match holds all of some clause.  Empty: no mandatory trigrams."""
    clauses = [frozenset()]

    def exact(op, arg) -> set[str] | None:
        """All strings that a node can match, if few."""
        op = str(op)
        if op == "LITERAL":
            return {chr(arg).lower()}
        if op == "IN" and all(str(o) == "LITERAL" for o, _ in arg) and len(arg) <= 8:
            return {chr(a).lower() for _, a in arg}
        if op == "SUBPATTERN":
            return sequence(arg[-1])
        if op == "BRANCH":
            sets = [sequence(x) for x in arg[1]]
            return None if None in sets else set().union(*sets)
        if op == "MAX_REPEAT" and arg[1] == 1 and (one := sequence(arg[2])) is not None:
            return one | ({""} if arg[0] == 0 else set())
        if op == "MAX_REPEAT" and arg[0] == arg[1] and arg[0] <= 8 and (one := sequence(arg[2])) is not None and len(one) == 1:
            return {next(iter(one)) * arg[0]}
        return None

    def sequence(nodes) -> set[str] | None:
        out = {""}
        for op, arg in nodes:
            got = exact(op, arg)
            if got is None or len(got) * len(out) > _MOST:
                return None
            out = {a + b for a in out for b in got}
        return out

    def close(run: set[str]) -> None:
        nonlocal clauses
        made = [frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run]
        if any(not m for m in made):
            return
        both = {a | b for a, b in itertools.product(clauses, made)}
        clauses = [c for c in both if not any(o < c for o in both)]

    run = {""}
    for op, arg in _syntax.parse(pattern):
        got = exact(op, arg)
        if got is None or len(got) * len(run) > _MOST:
            close(run)
            run = {""} if got is None else got
        else:
            run = {a + b for a in run for b in got}
    close(run)
    return sorted((c for c in clauses if c), key=sorted)


def index(texts: DataFrame, grams: list[str]) -> DataFrame:
    """Postings (gram, key) of the given trigrams over a frame with ``key`` and ``text``."""
    low = texts.select("key", F.lower("text").alias("low"))
    held = F.filter(F.array(*[F.lit(g) for g in grams]), lambda g: F.contains(F.col("low"), g))
    return low.select("key", F.explode(held).alias("gram"))


def candidates(postings: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Keys of texts that satisfy the trigram query of any rule: key, rules."""
    rows = [(g, r.kind, n, 1 << i, (1 << len(c)) - 1) for r in rules for n, c in enumerate(trigram_query(r.pattern)) for i, g in enumerate(sorted(c))]
    clauses = postings.sparkSession.createDataFrame(rows, "gram string, rule string, clause int, bit long, need long")
    met = postings.join(F.broadcast(clauses), "gram").groupBy("key", "rule", "clause", "need").agg(F.bit_or("bit").alias("got"))
    return met.filter("got = need").groupBy("key").agg(F.collect_set("rule").alias("rules"))


def spans_of(text: Column, rule: Rule) -> Column:
    """Array of (start, end, order, kind, base) of a rule's valid matches in a text."""
    pattern = F.lit(rule.pattern)
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
    hits = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length)
    held = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length) if rule.group else hits
    none = F.array().cast("array<struct<start:int,end:int,held:int>>")
    start = lambda at: F.struct(at.alias("at"), none.alias("out"))

    def step(acc, x):
        begin = acc["at"] + x["gap"]
        end = begin + x["hit"]
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), x["held"].alias("held")))).alias("out"))

    zipped = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), held.alias("held"))  # one gap more than matches
    zipped = F.filter(F.transform(zipped, lambda z: F.struct(z["gap"].alias("gap"), z["hit"].alias("hit"), z["held"].alias("held"))), lambda z: z["hit"].isNotNull())

    def add(acc, run):
        got = F.aggregate(run, start(acc["at"]), step)
        return F.struct(got["at"].alias("at"), F.concat(acc["out"], F.array(got["out"])).alias("out"))

    def place(z):
        # running lengths in runs of _RUN matches: no array grows beyond a run, or beyond the number of runs
        runs = F.transform(F.sequence(F.lit(0), F.size(z) - 1, F.lit(_RUN)), lambda i: F.slice(z, i + 1, _RUN))
        outer = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,end:int,held:int>>>").alias("out"))
        return F.when(F.size(z) > 0, F.flatten(F.aggregate(runs, outer, add, lambda acc: acc["out"]))).otherwise(none)

    found = F.flatten(F.transform(F.array(zipped), place))  # as a lambda's argument the matches are found once
    order = next(i for i, r in enumerate(RULES) if r.kind == rule.kind) if rule in RULES else len(RULES)
    kept = F.filter(found, lambda s: s["held"] >= rule.least)
    return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(rule.kind).alias("kind"), F.lit(rule.base).alias("base")))


SPANS = "array<struct<start:int,order:int,end:int,kind:string,base:boolean>>"


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, name: str = "secrets") -> DataFrame:
    """``docs`` with an array column ``name`` (longer where ``docs`` has it) of all valid spans, by start, then rule."""
    cols, name = [F.col(f"`{c}`") for c in docs.columns], free_name(docs, name)
    keyed = docs.select(F.struct(*cols).alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keyed = keyed.withColumn("key", F.unhex(F.md5("text")))
    by_gram = tuple(r for r in rules if trigram_query(r.pattern))
    grams = sorted({g for r in by_gram for c in trigram_query(r.pattern) for g in c})
    # written by itself, so that its size is known: few candidates are broadcast and no text is shuffled for them
    hits = table(candidates(index(keyed.select("key", "text"), grams), by_gram)) if by_gram else None
    joined = keyed.join(hits, "key", "left") if hits is not None else keyed.withColumn("rules", F.lit(None).cast("array<string>"))
    found = []
    for r in rules:
        spans = spans_of(F.col("text"), r)
        if r in by_gram:
            spans = F.when(F.array_contains("rules", r.kind), spans).otherwise(F.array().cast(SPANS))
        found.append(spans.cast(SPANS))
    return joined.select("doc.*", F.array_sort(F.concat(*found)).alias(name))


def query(docs: DataFrame) -> DataFrame:
    """Digest columns per document."""
    found = find_secrets(docs.select("doc_id", "text"))
    s = F.col("secrets")
    said = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter(s, lambda x: x["base"])
    of = lambda k: F.filter(base, lambda x: x["kind"] == k)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(said(base), 256).alias("base_sha256"), said(s).alias("spans"))


def oracle() -> str:
    """DuckDB SQL for :func:`query`: every rule scans every text."""

    def spans(r: Rule, order: int) -> str:
        p = r.pattern.replace("'", "''")
        return f"""list_filter(list_transform(range(1, len(regexp_extract_all(t, '{p}', 0)) + 1), lambda i: {{
          's': coalesce(list_sum(list_transform(string_split_regex(t, '{p}')[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(regexp_extract_all(t, '{p}', 0)[1:i-1], lambda x: length(x))), 0),
          'o': {order}, 'n': length(regexp_extract_all(t, '{p}', 0)[i]), 'h': length(regexp_extract_all(t, '{p}', {r.group})[i]), 'k': '{r.kind}', 'b': {str(r.base).lower()}}}), lambda x: x.h >= {r.least})"""

    every = ", ".join(spans(r, i) for i, r in enumerate(RULES))
    said = "list_transform({}, lambda x: x.k || ':' || x.s::BIGINT::VARCHAR || ':' || (x.s + x.n)::BIGINT::VARCHAR)"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS (SELECT doc_id, list_sort(flatten([{every}])) AS a FROM d),
    g AS (SELECT doc_id, a, list_filter(a, lambda x: x.b) AS b FROM f)
    SELECT doc_id, len(list_filter(b, lambda x: x.k = 'assign'))::BIGINT AS n_assign, len(list_filter(b, lambda x: x.k = 'access'))::BIGINT AS n_access,
      len(list_filter(b, lambda x: x.k = 'hex'))::BIGINT AS n_hex, sha256(coalesce(array_to_string({said.format('b')}, ','), '')) AS base_sha256, coalesce(array_to_string({said.format('a')}, ','), '') AS spans FROM g"""
