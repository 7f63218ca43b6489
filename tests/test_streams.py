"""Walks that stop and go on, and the life of runs with timers, against plain readings of the whole log."""

import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewatch.sources import notice_pages, walks
from tidewatch.sources.markup import tokenized
from tidewatch.streaming import runs


def walk(spark, root, out, pages=2, **more):
    spark.dataSource.register(walks.PageWalk)
    options = {"collector": "tidewatch.sources.walks:FolderWalk", "sources": "a, b,empty", "pages": pages, "path": str(root), **more}
    stream = spark.readStream.format("page_walk").options(**options).load()
    return stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint")


def rest(query, spark, out, n):
    """Runs until ``n`` pages are there; a source without an end has no trigger that stops by itself."""
    run = query.trigger(processingTime="0 seconds").start()
    try:
        for _ in range(600):
            if run.exception():
                raise run.exception()
            got = spark.read.parquet(f"{out}/rows").collect() if list(out.glob("rows/_spark_metadata/*")) else []
            if len(got) >= n:
                return got
            run.awaitTermination(0.2)
        raise AssertionError("the walk did not end")
    finally:
        run.stop()


def test_a_walk_that_stops_goes_on(spark, tmp_path):
    root, out = tmp_path / "pages", tmp_path / "out"
    out.mkdir()
    for source, n in (("a", 7), ("b", 3), ("empty", 0)):
        (root / source).mkdir(parents=True)
        for i in range(n):
            (root / source / f"{i:03}").write_text(f"<a href='/n/{source}{i}'>A label of more than twenty-five signs</a>")
    broken = root / "a" / "004"
    broken.unlink()
    broken.mkdir()  # a page that cannot be read: the walk stops in its third batch
    with pytest.raises(Exception, match="004"):
        rest(walk(spark, root, out), spark, out, 10)
    seen = spark.read.parquet(f"{out}/rows").collect()
    assert 0 < len(seen) < 10
    broken.rmdir()
    broken.write_text("mended")
    got = rest(walk(spark, root, out), spark, out, 10)
    assert sorted((r["source"], r["token"]) for r in got) == [*[("a", f"{i:03}") for i in range(7)], *[("b", f"{i:03}") for i in range(3)]]
    hits = notice_pages.inspected(tokenized(spark.read.parquet(f"{out}/rows")).withColumn("url", F.lit("https://v.example/x/appels-offres")))
    assert hits.agg(F.sum("n_hits")).first()[0] == 9


def whole(events, stale, passed):
    """The log of all events up to a time, read in order, and what went stale by then."""
    active, rows = {}, []
    for scope, *event in sorted((e for e in events if e[2] <= passed), key=lambda e: (e[2], e[1])):
        for now, row in runs.taken(active.get(scope), tuple(event), stale):
            active[scope] = now
            rows.append((scope, *row))
    rows += [(s, a[0], a[2] + stale, "FAILED", runs.STALE) for s, a in active.items() if a and a[2] + stale <= passed]
    return sorted(rows, key=repr)


def test_runs_follow_the_log_whatever_the_batches(spark, tmp_path):
    random.seed(6)
    start, stale = datetime(2024, 1, 1, tzinfo=UTC), timedelta(minutes=4)
    events = [(f"s{random.randint(0, 3)}", i, start + timedelta(seconds=40 * i), random.choice(runs.STEPS), "x") for i in range(240)]
    late = [*events[:100], *events[110:], *events[100:110]]  # some come after later ones, within the hour
    schema = "scope string, id long, at timestamp, step string, detail string"
    for i in range(0, 240, 60):
        spark.createDataFrame(late[i : i + 60], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i:03}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    got = runs.followed(runs.log(stream, stale, "1 hour"), str(tmp_path / "out")).collect()
    passed = max(e[2] for e in events) - timedelta(hours=1)
    rows = sorted(((r["scope"], r["run"], r["at"].replace(tzinfo=UTC), r["status"], r["detail"]) for r in got), key=repr)
    assert rows == whole(events, stale, passed) and any(r[4] == runs.STALE for r in rows)
    # a later event moves the watermark: what waited is taken, and the run that nobody ended is failed by its timer
    last = ("s9", 999, start + timedelta(days=1), "reserve", "x")
    spark.createDataFrame([last, ("s0", None, None, "claim", "x")], schema).coalesce(1).write.parquet(str(tmp_path / "in/900"))
    got = runs.followed(runs.log(stream, stale, "1 hour"), str(tmp_path / "out")).collect()
    rows = sorted(((r["scope"], r["run"], r["at"].replace(tzinfo=UTC), r["status"], r["detail"]) for r in got), key=repr)
    assert rows == whole([*events, last], stale, last[2] - timedelta(hours=1))


def test_states_follow_the_newest_row_whatever_the_batches(spark, tmp_path):
    from tidewatch.streaming import states

    random.seed(9)
    start = datetime(2024, 1, 1, tzinfo=UTC)
    rows = [(random.randint(0, 5), i, start + timedelta(seconds=i), random.choice("ab")) for i in range(120)]
    given = [*rows[:40], rows[60], *rows[40:60], *rows[61:], rows[3], (None, 1, start, "a"), (1, 500, None, "a"), (7, None, start, None)]  # one before others of its key, one again
    schema = "key int, id long, at timestamp, digest string"
    for i in range(0, len(given), 41):
        spark.createDataFrame(given[i : i + 41], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i:03}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    got = sorted((r["key"], r["id"], r["state"]) for r in runs.followed(states.changes(stream), str(tmp_path / "out")).collect())
    newest, want = {}, []
    for i in range(0, len(given), 41):
        batch = sorted((r for r in given[i : i + 41] if r[0] is not None and r[2] is not None), key=lambda r: (r[2], r[1] or 0))
        for key, number, at, digest in batch:
            newest[key], (state,) = states.classed(newest.get(key), [(digest or "", at, number or 0)])
            want.append((key, number or 0, state))
    assert got == sorted(want) and {"NEW", "UPDATED", "UNCHANGED", "LATE"} == {s for *_, s in got}
