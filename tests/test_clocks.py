"""Clocks and caps of runs, keys of comparison, promulgations, on rows with gaps."""

from datetime import date, datetime

from pyspark.sql import functions as F

from tidewatch.operators import clocks, policies
from tidewatch.plans import catalog
from tidewatch.plans import clocks as clock_queries  # noqa: F401


def test_reconciliation_is_due(spark):
    meta = '{"collector_metrics": {"pmmp_sync_mode": "reconciliation", "pmmp_sync_complete": true}}'
    d = lambda day, h=0: datetime(2024, 6, day, h)
    rows = [(1, "completed", d(1), d(2), meta), (1, "completed", d(3), None, "{}"), (2, "failed", d(3), None, meta), (3, "completed", d(3), None, "no json"), (4, "completed", d(1), None, meta.replace("true", "false")), (5, "completed", d(3, 1), None, meta), (6, None, None, None, None)]
    df = spark.createDataFrame(rows, "scope int, status string, started timestamp, finished timestamp, metadata string")
    got = {r["scope"]: r["due"] for r in clocks.reconciliation_due(df, F.lit(d(4)), 48).collect()}
    assert got == {1: True, 2: True, 3: True, 4: True, 5: False, 6: True}


def test_calls_that_are_left(spark):
    a, b = date(2024, 6, 1), date(2024, 6, 2)
    runs = spark.createDataFrame([(1, a, 5), (2, a, 4), (2, a, None), (3, b, 50)], "run int, day date, search_calls long")
    planned = spark.createDataFrame([(2, a, 20, True), (4, a, 20, True), (4, b, 3, True), (4, b, 3, False), (5, None, 2, True), (6, a, 1, None)], "run int, day date, wanted long, paid boolean")
    got = sorted(((r["run"], str(r["day"]), r["remaining"], r["allowed"], r["error"]) for r in clocks.allowed_calls(runs, planned, 10).collect()), key=str)
    assert got == sorted([(2, str(a), 5, 5, None), (4, str(a), 1, 1, None), (4, str(b), 0, 0, "daily_search_limit_reached"), (4, str(b), None, 3, None), (5, "None", 10, 2, None), (6, str(a), None, 1, None)], key=str)
    assert all(r["remaining"] is None for r in clocks.allowed_calls(runs, planned, 0).collect())


def test_promulgations(spark):
    formula = "ينفذ وينشر بالجريدة الرسمية، القانون رقم 33.22 المتعلق بحماية التراث"
    texts = [f"عدد 7415 {formula}", f"عدد 7415 {formula.replace('33.22', '44.22')}", f"{'x' * 12000} 7415 {formula}", f"عدد 7415 {formula.replace('القانون رقم', '')}", "7415", None, f"7415 ينفذ وينشر بالجريدة الرسمية {'y' * 450} القانون رقم 33.22 المتعلق بحماية التراث"]
    df = spark.createDataFrame([("a", f"u{i}", t) for i, t in enumerate(texts)] + [("b", "other", texts[0])], "key string, url string, text string")
    registry = spark.createDataFrame([("a", "33.22", "7415", "Loi")], "key string, reference string, number string, title string")
    assert [(r["url"], r["reference"], r["section"]) for r in policies.arabic_sections(df, registry).collect()] == [("u0", "33.22", 0)]


def test_bulletins_stay_where_they_are(spark):
    """the registry travels to the bulletins; their texts were sent to the driver and from there to all executors."""
    plan = catalog.QUERIES["q_arabic_sections"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    sent = plan[plan.index("BroadcastExchange") :]
    assert "LocalTableScan" in sent and "FileScan" not in sent
