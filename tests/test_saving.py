"""Tables that change together, results after a run, reopenings: what dies in between, what is refused, odd rows."""

from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import saving
from tidewatch.operators.snapshots import Refused, TableSet

REFERS = {"lines": ["orders"], "orders": ["customers"]}


def rows(spark, n, name="x"):
    return spark.range(n).select("id", F.lit(name).alias("name"))


@pytest.fixture
def tables(spark, tmp_path):
    t = TableSet(spark, str(tmp_path / "set"))
    t.commit({"orders": rows(spark, 5), "lines": rows(spark, 9), "customers": rows(spark, 2)})
    return t


def test_a_commit_that_dies_changes_nothing(spark, tables, monkeypatch):
    before, wrote = tables.manifest(), []
    real = TableSet._written

    def dies(self, df):
        if wrote:
            raise OSError("lost")
        wrote.append(real(self, df))
        return wrote[-1]

    monkeypatch.setattr(TableSet, "_written", dies)
    with pytest.raises(OSError):
        tables.commit({"orders": rows(spark, 50), "lines": rows(spark, 90)})
    monkeypatch.undo()
    assert wrote and tables.manifest() == before and tables.read("orders").count() == 5
    assert tables.commit({"orders": rows(spark, 50), "lines": rows(spark, 90)}) == 2 and tables.counts() == {"orders": 50, "lines": 90, "customers": 2}
    assert tables.read("orders", 1).count() == 5


def test_a_second_writer_is_refused(spark, tables, monkeypatch):
    held = tables.manifest()
    tables.append({"audit": rows(spark, 1)})
    monkeypatch.setattr(TableSet, "manifest", lambda self, number=None: held)
    with pytest.raises(Refused, match="another writer"):
        tables.commit({"orders": rows(spark, 1)})


def test_appends_add_only_their_rows(spark, tables):
    tables.append({"audit": rows(spark, 3, "a")})
    tables.append({"audit": rows(spark, 0, "b"), "orders": rows(spark, 1, "c")})
    assert tables.counts() == {"orders": 6, "lines": 9, "customers": 2, "audit": 3} and {r["name"] for r in tables.read("orders").collect()} == {"x", "c"}
    with pytest.raises(Refused, match="other columns"):
        tables.append({"audit": spark.range(1)})


def test_reset_and_restore(spark, tables):
    held = tables.latest()
    assert tables.reset(["lines", "orders"], REFERS) == {"snapshot": 1, "delete": {"lines": 9, "orders": 5}, "preserve": {"customers": 2}, "confirmed": False}
    assert tables.latest() == held
    with pytest.raises(Refused, match="depend"):
        tables.reset(["orders"], REFERS, confirm=True)
    with pytest.raises(Refused, match="missing"):
        tables.reset(["other"], REFERS, confirm=True)
    with pytest.raises(Refused, match="active"):
        tables.reset(["lines", "orders"], REFERS, spark.range(1), confirm=True)
    assert tables.reset(["lines", "orders"], REFERS, spark.range(0), confirm=True)["after"] == {"customers": 2, "lines": 0, "orders": 0}
    assert tables.read("orders").columns == ["id", "name"]
    tables.append({"orders": rows(spark, 1)})
    with pytest.raises(Refused, match="not empty"):
        tables.restore(held, ["lines", "orders"])
    tables.commit({"orders": rows(spark, 0)})
    assert tables.restore(held, ["lines", "orders"])["counts"] == {"customers": 2, "lines": 9, "orders": 5}
    tables.commit({"customers": rows(spark, 3), "orders": rows(spark, 0), "lines": rows(spark, 0)})
    with pytest.raises(Refused, match="preserved"):
        tables.restore(held, ["lines", "orders"])


def test_what_was_changed_behind_is_noticed(spark, tables):
    part = tables.manifest()["tables"]["orders"]["parts"][0]["path"]
    rows(spark, 5, "y").write.mode("overwrite").parquet(part)
    with pytest.raises(Refused, match="not what was written"):
        tables.reset(["lines", "orders"], REFERS, confirm=True)


def test_states_of_results(spark):
    then, now = datetime(2024, 1, 1), datetime(2024, 6, 1)
    old = [("a", 1, None, "NEW", then, then, then, None), ("b", 1, None, "ARCHIVED", then, then, then, None), ("c", 1, None, "MANUAL_REVIEW", then, then, then, None), ("d", 1, None, "NEW", then, then, then, "UNVERIFIED_BUT_CREDIBLE"), ("e", 1, None, "NEW", then, then, then, None)]
    new = [("a", 2, "u", True, False, True, None), ("b", 2, "u", True, False, True, None), ("c", 2, "u", True, False, False, None), ("d", 1, "u", True, True, True, "VERIFIED_OFFICIAL"), ("f", 3, "u", False, True, True, None), ("g", 3, "u", True, True, True, None)]
    e = spark.createDataFrame(old, "key string, price int, official_url string, status string, first_seen timestamp, last_seen timestamp, last_changed timestamp, resolution string")
    n = spark.createDataFrame(new, "key string, price int, official_url string, relevant boolean, manual boolean, analysed boolean, resolution string")
    got = {r["key"]: (r["state"], r["status"], r["price"], r["official_url"], r["last_changed"], r["event"]) for r in saving.saved(e, n, ["price", "official_url"], F.lit(now)).collect()}
    assert got == {
        "a": ("UPDATED", "UPDATED", 2, "u", now, None), "b": ("UPDATED", "ARCHIVED", 2, "u", now, None), "c": ("UNCHANGED", "MANUAL_REVIEW", 1, None, then, None), "d": ("UNCHANGED", "UNCHANGED", 1, "u", then, "OFFICIAL_ENRICHED"),
        "e": (None, "NEW", 1, None, then, None), "f": ("REJECTED", "REJECTED", 3, "u", now, None), "g": ("MANUAL_REVIEW", "MANUAL_REVIEW", 3, "u", now, None),
    }


def test_yield_of_odd_metadata(spark):
    day = datetime(2024, 1, 1, tzinfo=UTC)
    meta = ['{"collection_queries": [{"source_strategy": "D", "query_family": "f", "raw_results_count": 3}, {"source_strategy": "D"}, 7, {"source_strategy": "CONTROL", "query_family": "f"}]}', "no json", None, '{"other": 1}', '{"collection_queries": {"a": 1}}', '{"collection_queries": [{"source_strategy": "D", "query_family": "f", "raw_results_count": "x", "extra": {"y": 1}}]}']
    df = spark.createDataFrame([(1, i, "completed", day, m) for i, m in enumerate(meta)], "scope int, run int, status string, started timestamp, metadata string")
    got = saving.query_yield(df).collect()
    assert [(r["query"], r["executions"], r["raw_results"], r["zero_results"]) for r in got] == [("D:f", 2, 3, 1)]
    assert saving.query_yield(df.limit(0)).collect() == []


def test_reopenings_without_observations(spark):
    at = lambda d: datetime(2024, 1, d)
    events = spark.createDataFrame([(1, at(5), "REOPENED"), (1, at(9), "REOPENED"), (2, at(5), "REOPENED"), (1, at(6), "SEEN")], "id int, at timestamp, event string")
    seen = spark.createDataFrame([(1, at(1), "a"), (1, at(5), "b"), (1, at(8), None)], "id int, seen_at timestamp, title string")
    got = {(r["id"], r["at"].day): (r["changed"], r["justified"]) for r in saving.reopened(events, seen, ["title"]).collect()}
    assert got == {(1, 5): (["title"], True), (1, 9): (None, None), (2, 5): (None, None)}
