"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from tidewatch.plans import accounting, candidates, catalog, clocks, crossed, decisions, flows, gates, judgements, leadership, notices, records, resolving, saving, validation, views  # noqa: F401

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def plain(df):
    def one(v):
        if pd.isna(v):
            return "-"
        return f"{float(v):.5f}" if not isinstance(v, (str, bool)) and hasattr(v, "__float__") else str(v)

    cols = sorted(df.columns)
    return cols, sorted(tuple(one(v) for v in r) for r in df[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_same_as_sql(spark, con, name):
    assert plain(catalog.QUERIES[name](spark, DIR).toPandas()) == plain(con.execute(catalog.ORACLE[name]).df())


def test_whole_queries_drop_no_user(spark, con):
    """Every user's official evidence counts, and every user has a change class."""
    n = con.execute("select count(distinct user_id) from events").fetchone()[0]
    assert catalog.QUERIES["q_cdc_classify"](spark, DIR).groupBy().sum("n").first()[0] == n
    assert "user_id %" not in catalog.ORACLE["q_role_resolution"] + catalog.ORACLE["q_cdc_classify"]
    official = {r[0] for r in con.execute("select user_id from events where event_type <> 'error' and event_id % 10 > 0 and ts < date '2024-01-26'").fetchall()}
    got = {r["user_id"]: r["status"] for r in catalog.QUERIES["q_role_resolution"](spark, DIR).collect()}
    assert official <= set(got) and not any(got[u] == "PROBABLY_CURRENT" for u in official)


def test_whole_features(spark, con):
    """Rejected and rare terms, and words after a text's twelfth, count."""
    assert "[1:12]" not in catalog.ORACLE["q_feedback_score_whole"]
    profile = catalog.QUERIES["q_feature_profile_classes"](spark, DIR).toPandas()
    assert (profile.rejected > 0).any() and (profile[["approved", "rejected"]].max(axis=1) < 20).any()
    least, whole = (catalog.QUERIES[n](spark, DIR).selectExpr("sum(positive + negative)").first()[0] for n in ("q_feedback_score", "q_feedback_score_whole"))
    assert whole > least
    d, b = (con.execute(f"select count(distinct text) from {n}").fetchone()[0] for n in ("documents", "benchmark"))
    got = catalog.QUERIES["q_set_overlap_texts"](spark, DIR).first()
    assert 0 < got["both_"] + got["left_"] <= d and 0 < got["both_"] + got["right_"] <= b


def test_fold_forms_agree(spark):
    from pyspark.sql import functions as F

    from tidewatch.functions import text

    rows = [("Été à la Plage",), ("Straße  Nr. 5",), ("señor Ñandú",), ("",), (None,), ("a_b-c",)]
    df = spark.createDataFrame(rows, "t string")
    got = df.select(text.fold_text(F.col("t")).alias("a"), text.fold_general("t").alias("b")).collect()
    assert all(r["a"] == r["b"] for r in got)


def test_daily_totals_stream_equals_batch(spark, tmp_path):
    import shutil

    from tidewatch.streaming import changes

    (tmp_path / "in").mkdir()
    shutil.copy(f"{DIR}/events.parquet", tmp_path / "in/events.parquet")
    schema = spark.read.parquet(f"{DIR}/events.parquet").schema
    q = changes.daily_totals(changes.events(spark, str(tmp_path / "in"), schema)).writeStream.outputMode("complete").format("memory").queryName("totals").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("totals").selectExpr("sum(n)").first()[0] == spark.read.parquet(f"{DIR}/events.parquet").count()
