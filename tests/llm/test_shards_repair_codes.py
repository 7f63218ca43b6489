"""Resharding, conversation repair and vector codes against brute force, odd rows and the SQL on small tables."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from tidewatch.llm import codes, repair, reshard

DIR = "/root/testdata/sf0.001"


def by_sql(sql, name, rows, types):
    con = duckdb.connect()
    con.execute(f"create table {name} ({types})")
    if rows:
        con.executemany(f"insert into {name} values ({', '.join('?' * len(rows[0]))})", rows)
    got = con.sql(sql)
    return sorted(map(repr, got.fetchall())), got.columns


def agree(frame, sql, name, rows, types):
    want, columns = by_sql(sql, name, rows, types)
    assert sorted(repr(tuple(r[c] for c in columns)) for r in frame.collect()) == want


# --- resharding ---


def test_flow_moves_the_fewest_bytes():
    random.seed(1)
    for _ in range(60):
        old = {i: random.randint(0, 50) for i in random.sample(range(9), random.randint(1, 7))}
        total, new = sum(old.values()), random.randint(1, 8)
        cuts = sorted(random.randint(0, total) for _ in range(new - 1))
        wanted = [b - a for a, b in itertools.pairwise([0, *cuts, total])]
        blocks = reshard.transfers(old, wanted)
        stays = sum(min(old.get(j, 0), w) for j, w in enumerate(wanted))
        assert sum(b.end - b.begin for b in blocks if b.old != b.shard) == total - stays
        assert all(sum(b.end - b.begin for b in blocks if b.shard == j) == w for j, w in enumerate(wanted))
        for i, size in old.items():  # each old shard is covered once, in order
            mine = [b for b in blocks if b.old == i]
            assert [b.begin for b in mine] == [0, *[b.end for b in mine[:-1]]][: len(mine)] and (not size or mine[-1].end == size)


def test_min_cost_flow_against_all_flows():
    arcs = [(0, 2, 3, 0), (0, 3, 2, 0), (2, 4, 2, 5), (2, 5, 2, 1), (3, 4, 2, 2), (3, 5, 1, 1), (4, 1, 3, 0), (5, 1, 2, 0)]
    best = min(
        (-sum(f[:2]), sum(x * a[3] for x, a in zip(f, arcs, strict=True)))
        for f in itertools.product(*[range(a[2] + 1) for a in arcs])
        if all(sum(x for x, a in zip(f, arcs, strict=True) if a[1] == n) == sum(x for x, a in zip(f, arcs, strict=True) if a[0] == n) for n in (2, 3, 4, 5))
    )
    flow = reshard.min_cost_flow(arcs, 0, 1)
    assert (-sum(flow[:2]), sum(x * a[3] for x, a in zip(flow, arcs, strict=True))) == best


def test_resharding_of_odd_documents(spark, monkeypatch):
    monkeypatch.setattr(reshard, "FILE_BYTES", 2000)  # several files a shard, so that some stay as they are
    random.seed(2)
    rows = [(i, "w é" * random.choice([0, 1, 3, 40, 200])) for i in range(400)] + [(7, "w é"), (7, "w é"), (None, "x"), (None, None), (900, None), (901, "long " * 3000)]
    rows += [(1000 + i, "a copy that many share") for i in range(150)]
    df = spark.createDataFrame([(*r, "s", 1, 2, "p") for r in rows], "doc_id long, text string, shard string, slot int, _place int, source string")
    layout = reshard.lay_out(df, reshard.id_hash() % reshard.OLD_SHARDS)
    done = reshard.reshard(layout)
    assert done.affected and set(done.kept.columns) == {"doc_id", "text", "shard", "slot", "_place", "source", "shard_", "slot_"}
    files = {r["_file"] for r in layout.files.select("_file").distinct().collect()}
    assert files - set(done.affected), "no file stayed"
    out = done.kept.unionByName(done.rewritten).collect()
    assert sorted(map(repr, [(r["doc_id"], r["text"]) for r in out])) == sorted(map(repr, rows))
    for j in range(reshard.SHARDS):
        mine = [r for r in out if r["shard_"] == j]
        assert sorted(r["slot_"] for r in mine) == list(range(len(mine)))
    agree(reshard.query(df), reshard.oracle(), "documents", rows, "doc_id bigint, text varchar")


def test_resharding_on_the_table_and_empty(spark):
    df = spark.read.parquet(f"{DIR}/documents.parquet")
    got = reshard.query(df)
    agree(got, reshard.oracle(), "documents", [tuple(r) for r in df.select("doc_id", "text").collect()], "doc_id bigint, text varchar")
    text = {r["doc_id"]: (r["text"] or "").encode() for r in df.collect()}
    assert all(r["size"] == len(text[r["doc_id"]]) + 1 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]]) for r in got.collect())
    assert reshard.query(df.limit(0)).collect() == []


# --- conversation repair ---


def cheapest(rows):
    """(cost, audit) over all edit strings, shortest ways first."""
    found, bound = [], 3 * len(rows)

    def go(i, cost, audit, roles):
        nonlocal bound
        if cost > bound or len(roles) > len(rows) + 2:
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            bound = min(bound, cost)
            found.append((cost, audit))
        if i < len(rows):
            initial, fault = rows[i]
            go(i + 1, cost + 3, audit + "D", roles)
            if fault not in ("blank", "duplicate"):
                cut = int(fault == "truncated")
                go(i + 1, cost + cut, audit + "K", roles + (initial or "?"))
                for r in "ua":
                    go(i + 1, cost + 2 + cut, audit + "R", roles + r)
        for r in "ua":
            go(i, cost + 2, audit + "I", roles + r)

    go(0, 0, "", "")
    return min(found)


def test_audits_are_the_cheapest_and_least():
    random.seed(3)
    for _ in range(300):
        rows = [(random.choice(["s", "u", "a", "o", ""]), random.choice(["clean", "clean", "truncated", "blank", "duplicate"])) for _ in range(random.randint(0, 4))]
        trie = repair.Trie()
        trie.insert("".join(repair.letter(i, repair.FAULTS.index(f)) for i, f in rows))
        assert trie.answer() == cheapest(rows), rows


def test_shared_prefixes_are_computed_once():
    random.seed(4)
    signed = sorted("".join(random.choice("aeijm") for _ in range(random.randint(0, 12))) for _ in range(800))
    trie, nodes = repair.Trie(), set()
    for s in signed:
        trie.insert(s)
        alone = repair.Trie()
        alone.insert(s)
        assert trie.answer() == alone.answer()
        nodes |= {s[:i] for i in range(1, len(s) + 1)}
    assert trie.computed == len(nodes) < sum(map(len, signed))
    long = repair.Trie()
    long.insert("ei" * 200_000)
    assert long.answer() == (0, "K" * 400_000)


def test_repair_of_odd_conversations(spark):
    random.seed(5)
    rows = []
    for c in [*range(150), None]:
        for t in range(random.randint(0, 6)):
            role = random.choice(["user", "assistant", "system", "tool", "", None, "User"]) if random.random() < 0.4 else ("user", "assistant")[t % 2]
            rows.append((c, random.choice([t, t, t, None, t + 2]), role, random.choice(["a.", "b f", "off\f", "", "  \t\x0b", None, "q?\n", "c!"])))
    rows += [(500, 0, "user", "same."), (500, 0, "user", "same."), (501, None, None, None)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, copy int")
    agree(repair.query(df), repair.oracle(), "conversations", rows, "conv_id bigint, turn bigint, role varchar, text varchar")
    assert repair.query(df.limit(0)).collect() == []


def test_repaired_turns_and_a_large_conversation(spark):
    """One conversation of most rows: its runs come from several tasks, and the digest is that of its turns."""
    rows = [(1, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(6000)] + [(2, 0, "user", "hi.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    agree(repair.query(df), repair.oracle(), "conversations", rows, "conv_id bigint, turn bigint, role varchar, text varchar")
    turns = sorted((r["conv_id"], r["position"], r["role"], r["text"]) for r in repair.repair(df).collect())
    said = "\n".join(f"{r}:{t}" for c, _, r, t in turns if c == 1)
    assert hashlib.sha256(said.encode()).hexdigest() == {r["conv_id"]: r["repaired_sha256"] for r in repair.query(df).collect()}[1]
    assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for c, _, r, _ in turns if c == 1))


# --- vector codes ---


@pytest.mark.parametrize("n", [1, 48, 49, 700, 3000])
@pytest.mark.parametrize("spread", [1, 100, 30000])
def test_filtered_assignment_is_the_plain_one(n, spread):
    """Uniform, tied and far apart clumps; the last are mostly assigned by subtree."""
    rng = np.random.default_rng(n)
    points = rng.integers(-300, 300, (n, 16)) // spread if spread < 1000 else rng.integers(0, 9, (n, 1)) * spread + rng.integers(0, 5, (n, 16))
    entries = points[rng.integers(0, n, min(n, 40))]
    tree = codes.build(points)
    want = ((points[:, None] - entries[None]) ** 2).sum(2).argmin(1)
    assert (codes.assigned(tree, points, entries) == want).all()
    total = np.zeros((len(entries), 17), np.int64)
    np.add.at(total, want, np.concatenate([points, np.ones((n, 1), np.int64)], 1))
    assert (codes.sums(tree, points, entries) == total).all()


def test_far_clumps_are_assigned_as_subtrees():
    rng = np.random.default_rng(0)
    points = np.repeat(np.arange(8), 400)[:, None] * 10_000 + rng.integers(0, 50, (3200, 16))
    compared = sum(len(which) for kind, which, _ in codes.walk(codes.build(points), points, points[::400]) if kind == "rows")
    assert compared == 0


def test_codes_of_odd_vectors(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 8)], i % 3 if i % 7 else None) for i in range(700)]
    rows += [(10_000 + i, [0.5] * 8, 1) for i in range(300)]  # one frequent vector
    bad = [(-5, None, 1), (-4, [0.1] * 7 + [None], 1), (-3, [float("nan")] * 8, 1), (-2, [float("inf")] + [0.0] * 7, 2)]
    df = spark.createDataFrame([(*r, "x") for r in rows + bad], "vec_id long, embedding array<double>, label int, code string").repartition(5)
    agree(codes.query(df), codes.oracle(), "embeddings", rows + bad, "vec_id bigint, embedding double[], label int")
    few = [(2, [0.1, 0.2, 0.3, 0.4], None), (1, [0.5, 0.2, -0.3, 0.4], None), (1, [0.5, 0.2, -0.3, 0.4], 5)]
    got = codes.query(spark.createDataFrame(few, "vec_id long, embedding array<float>, label int")).collect()
    assert len(got) == 3 and {r["error"] for r in got} == {0}
    ragged = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0, 5.0], 1), (2, [], 1), (None, [1e300], 2)], "vec_id long, embedding array<double>, label int")
    assert len(codes.query(ragged).collect()) == 3
    for none in (df.limit(0), df.where("vec_id < 0")):
        assert codes.query(none).collect() == []


def test_codes_on_the_table(spark):
    df = spark.read.parquet(f"{DIR}/embeddings.parquet")
    agree(codes.query(df), codes.oracle(), "embeddings", [tuple(r) for r in df.collect()], "vec_id bigint, embedding float[], label int")


# --- the sieve of looked-up texts (near duplicates) ---


def test_sieve_lets_all_wanted_and_few_others_pass(spark):
    from tidewatch.llm import jaccard

    keys = spark.range(20_000).selectExpr("xxhash64(id) as k")
    sieve = jaccard.Sieve(keys, "k")
    wanted = keys.toPandas()["k"].to_numpy()
    others = spark.range(20_000, 120_000).selectExpr("xxhash64(id) as k").toPandas()["k"].to_numpy()
    assert sieve.passes(wanted).all() and sieve.passes(others).mean() < 0.02 and sieve.bits < 1 << 20
    assert not jaccard.Sieve(keys.limit(0), "k").passes(others).any()
    assert jaccard.Sieve(keys, "k", 64).passes(others).mean() > 0.5  # a full sieve keeps nothing back


def test_near_duplicates_are_the_same_whatever_the_sieve_holds(spark, monkeypatch):
    from tidewatch.llm import jaccard

    docs = spark.read.parquet(f"{DIR}/documents.parquet").unionByName(spark.createDataFrame([(None, None, "x", "s", 0), (None, None, "x", "s", 0), (3, "one two", "x", "s", 7)], "doc_id long, text string, lang string, source string, n_chars long"))
    rows = lambda: (sorted(map(repr, jaccard.cluster(docs).collect())), sorted(map(repr, jaccard.keep_one(docs).collect())))
    thin = rows()
    monkeypatch.setattr(jaccard.Sieve.__init__, "__defaults__", (64,))
    assert rows() == thin


def test_near_duplicates_write_narrow_tables_in_few_files(spark, monkeypatch):
    """However many partitions a shuffle has: an executor forks for each file it writes, and counts twice while it does."""
    from glob import glob

    from tidewatch.llm import _spark, jaccard

    texts = [(d, " ".join(f"w{d // 2}x{i}" for i in range(30)) + (" end" if d % 2 else "")) for d in range(240)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    files = []

    def counted(df, *by):
        out = _spark.table(df, *by)
        if not {"shingles", "kind"} & set(df.columns):  # sets are wide; surveys and scans of lists are made by Python
            files.append(len(glob(f"{_spark._PATHS[out].removeprefix('file://')}/part-*")))
        return out

    monkeypatch.setattr(jaccard, "table", counted)
    many = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in many}
    try:
        for name, value in many.items():
            spark.conf.set(name, value)
        got = {r["doc_id"]: r["component_id"] for r in jaccard.cluster(docs).collect()}
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert got == {d: d - d % 2 for d, _ in texts}
    assert 8 < max(files) <= _spark.FEW_FILES


def test_few_links_are_joined_up_without_a_table_of_their_own(spark, monkeypatch):
    from tidewatch.llm import _spark, jaccard

    links = spark.createDataFrame([(1, 2), (2, 1), (2, 1), (2, 3), (4, 4)], "a long, b long")
    tables = []
    monkeypatch.setattr(jaccard, "table", lambda df, *by: tables.append(df.columns) or _spark.table(df, *by))
    for most, made in ((4, 1), (2, 2)):  # two distinct links in four rows
        tables.clear()
        assert {tuple(r) for r in jaccard.components(links, most).collect()} == {(1, 1), (2, 1), (3, 1)}
        assert len(tables) == made


# --- repeated words against a benchmark, and very long addresses ---


def matched(texts, items, window, most):
    import pyarrow as pa

    from tidewatch.llm import _text, decontaminate

    block = decontaminate.Block([str(i) for i in range(len(items))], items, window)
    before = decontaminate.longest.__defaults__
    decontaminate.longest.__defaults__ = (most,)
    try:
        out = decontaminate.search_shard(*_text.flat(pa.array(texts)), [block], window)
    finally:
        decontaminate.longest.__defaults__ = before
    return [(int(h), i, sorted((m["item_id"], m["item_word"], m["doc_word"], m["n_words"]) for m in f)) for h, i, f in zip(out["n_hit"], out["items"], out["matches"], strict=True)]


def test_matches_of_repeated_words_by_brute_force():
    random.seed(8)
    say = lambda n: " ".join(random.choice("aab") for _ in range(n))
    for _ in range(120):
        texts, items = [say(random.randint(0, 40)) for _ in range(4)], [say(random.randint(0, 25)) for _ in range(5)] + ["z y"]
        want = []
        for t in (x.split() for x in texts):
            hit, ids, longest = set(), set(), []
            for i, item in enumerate(x.split() for x in items):
                k = min(4, len(item))
                met = {(w, p) for w in range(len(item) - k + 1) for p in range(len(t) - k + 1) if k and item[w : w + k] == t[p : p + k]}
                for w, p in met:
                    hit |= set(range(p, p + k))
                    ids.add(str(i))
                    if (w - 1, p - 1) not in met:
                        longest.append((str(i), w, p, k - 1 + next(n for n in itertools.count() if (w + n, p + n) not in met)))
            want.append((len(hit), sorted(ids), sorted(longest)))
        assert all(matched(texts, items, 4, most) == want for most in (0, 7, 1 << 19))


def test_one_repeated_word_takes_little_memory():
    import tracemalloc

    tracemalloc.start()
    ((hit, ids, longest),) = matched(["w " * 20_000], ["w " * 5000], 10, 1 << 19)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert hit == 20_000 and ids == ["0"] and len(longest) == 20_000 - 9 + 5000 - 9 - 1 and peak < 300e6


def test_long_addresses_and_odd_events(spark):
    import time
    from datetime import date

    from tidewatch.llm import url_filters

    urls = ["https://www.a.example/" + "x/" * 50_000, "https://" + "a." * 50_000 + "b.example/x", "http://b.example/x//y/", None, "nohost"]
    caps = spark.createDataFrame([(i, u, date(2024, 1, 2), "own") for i, u in enumerate(urls)], "id int, url string, fetched_at date, entries string")
    day = date(2024, 1, 1)
    tied = [("l", "b.example", "add", date(2024, 1, 2), "c"), ("l", "b.example", "remove", date(2024, 1, 2), "c")]  # at one time: the removal wins
    events = [("l", k, "add", day, "c") for k in ("a.example", "www.a.example/x/x/x", "example", "b.example/x/y", "b.example", None, "")] + tied
    df = spark.createDataFrame(events, "list string, key string, action string, at date, category string")
    url_filters.evaluate(caps, df).collect()
    began = time.time()
    got = {r["id"]: [e["key"] for e in r["entries_"]] for r in url_filters.evaluate(caps, df).collect()}
    assert time.time() - began < 20
    assert got == {0: ["a.example", "example", "www.a.example/x/x/x"], 1: ["example"], 2: ["b.example/x/y", "example"], 3: [], 4: []}
    assert url_filters.evaluate(caps.limit(0), df).collect() == [] and all(r["entries_"] == [] for r in url_filters.evaluate(caps, df.limit(0)).collect())


def rows_made(spark, since, what):
    """Rows that operators matching ``what`` have made in executions after ``since``, and the last execution."""
    store = spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    runs, made, last = store.executionsList(), 0, since
    for run in (runs.apply(i).executionId() for i in range(runs.size())):
        last = max(last, run)
        if run > since:
            told, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
            for node in (nodes.apply(i) for i in range(nodes.size())):
                for m in (node.metrics().apply(i) for i in range(node.metrics().size())):
                    if m.name() == "number of output rows" and re.search(what, node.desc()) and told.get(m.accumulatorId()).isDefined():
                        made += int(told.get(m.accumulatorId()).get().replace(",", ""))
    return made, last


def test_long_lists_settle_in_few_rounds(spark, monkeypatch):
    """Near copies that do not link: rounds double their pivots, and a node meets its root once a round, not once a list."""
    from tidewatch.llm import jaccard

    common = " ".join(f"c{i}" for i in range(40))
    own = lambda d, k: " ".join(f"o{d}x{i}" for i in range(k))
    texts = [(d, f"{common} {own(d, 10)}") for d in range(14)] + [(20, f"{common} {own(3, 9)} other"), (21, f"{common} {own(3, 8)} some other")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    rounds, lists = [], []
    components, settle = jaccard.components, jaccard.settle
    monkeypatch.setattr(jaccard, "components", lambda *a: rounds.append(1) or components(*a))
    monkeypatch.setattr(jaccard, "settle", lambda *a: lists.append(a[4].count()) or settle(*a))
    monkeypatch.setattr(jaccard, "PIVOTS", 1)
    since = rows_made(spark, -1, "$^")[1]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.cluster(docs, 2).collect()}
    assert got == {d: 3 if d > 14 else d for d, _ in texts}
    assert lists and lists[0] > 3 * len(texts)  # every node is in several long lists
    assert len(rounds) <= 2 + 4  # pivots 1, 2, 4, 8
    made = rows_made(spark, since, r"Join \[node#\d+L?\], \[node#\d+L?\], LeftOuter")[0]
    assert len(texts) < made <= (len(rounds) + 2) * len(texts)


# --- kernels of the language model ---


def test_distinct_keys_are_those_of_unique_by_either_way():
    from tidewatch.llm import lm

    keys = np.random.default_rng(3).integers(0, 1 << 20, 5000).astype(np.uint64)
    for some in (keys, keys % np.uint64(7), keys[:1], keys[:0]):
        for bits in (20, 63):  # key and place in one number, and too wide for that
            for got, want in zip(lm.distinct(some, bits), np.unique(some, return_inverse=True), strict=True):
                assert np.array_equal(got, want)


def test_gradient_is_the_plain_sum():
    from tidewatch.llm import lm

    rng = np.random.default_rng(4)
    h, first = rng.integers(0, 50, 300).astype(np.uint64), np.array([0, 100, 100, 300])
    m = lm.Model(1000, 50, np.arange(40, dtype=np.uint64), np.arange(1, 41), np.ones(lm.TAIL))
    m.table = rng.normal(size=m.table.shape).astype(np.float32)
    got, want = np.zeros((2, 2, lm.BUCKETS, lm.CLASSES), np.float32)
    lm.gradient(m, h, first, *got)
    f, klass = lm.features(h, first), m.look_up(h)[0]
    for t in range(len(h)):
        p = np.exp(sum(m.table[b].astype(float) for b in f[:, t]) + m.bias)
        for b in f[:, t]:
            want[0, b, klass[t]] += 1
            want[1, b] += p / p.sum()
    assert np.array_equal(got[0], want[0]) and np.allclose(got[1], want[1], atol=1e-4)
