"""Queries on what is shown of runs and results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import views
from .catalog import query


@query("""SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'P' THEN 'failed' ELSE 'completed' END AS status, o_totalprice::DECIMAL(14,2)::VARCHAR AS cost, strftime(o_orderdate::TIMESTAMP, '%Y-%m-%dT%H:%M:%S.%f+00:00') AS started, NULL::VARCHAR AS finished, c_name AS launcher, 28 + 4 AS fields
FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 3 > 0""")
def q_public_runs(t):
    """Every order as a run's JSON, with its launcher where there is one."""
    runs = t("orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "P", "failed").otherwise("completed").alias("status"), F.col("o_totalprice").cast("decimal(14,2)").alias("estimated_ai_cost"), F.col("o_orderdate").alias("started_at"), F.lit(None).cast("timestamp").alias("finished_at"), F.col("o_custkey").alias("launcher_id"))
    shown = views.public_runs(runs, t("customer").filter("c_custkey % 3 > 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")))
    got = lambda p: F.get_json_object("shown", p)
    return shown.select("id", got("$.status").alias("status"), got("$.estimated_ai_cost").alias("cost"), got("$.started_at").alias("started"), got("$.finished_at").alias("finished"), got("$.launched_by.name").alias("launcher"), F.size(F.json_object_keys("shown")).alias("fields"))


@query("""WITH top AS (SELECT max(o_orderkey) AS k FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P')
SELECT DISTINCT p_partkey AS id FROM part JOIN lineitem ON l_partkey = p_partkey JOIN top ON l_orderkey = k WHERE p_partkey % 2 = 0 AND l_returnflag <> 'N'""")
def q_run_results(t):
    """Parts of one collection that the newest completed order brought up."""
    o = t("orders").join(t("lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct(), "o_orderkey", "left_semi")
    run = o.filter("o_orderstatus <> 'P'").agg(F.max("o_orderkey")).first()[0]
    results = t("part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 2 == 0, "even").otherwise("odd").alias("scope"))
    seen = t("lineitem").select(F.col("l_partkey").alias("result_id"), F.col("l_orderkey").alias("run_id"), F.when(F.col("l_returnflag") == "N", "UNCHANGED").otherwise("NEW").alias("state"))
    runs = t("orders").select(F.col("o_orderkey").alias("id"), F.lit("even").alias("scope"), F.when(F.col("o_orderstatus") == "P", "failed").otherwise("completed").alias("status"))
    return views.visible_in(results, seen, runs, "even", run).select("id")
