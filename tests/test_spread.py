"""Costly projections over small files are dealt out, and do their costly part once."""

import pytest

from tidewatch.functions import procurement_terms as T
from tidewatch.plans import candidates, catalog, flows, notices  # noqa: F401

DIR = "/root/testdata/sf0.001"


def plan_of(spark, name):
    return catalog.QUERIES[name](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["q_funding_candidates", "q_notice_flow", "q_index_backfill"])
def test_one_file_is_more_than_one_task(spark, name):
    """a table of one file was one task for all that its rows cost."""
    assert "Repartition" in plan_of(spark, name)


def test_signs_are_found_once_a_title(spark):
    """three sets of signs a hit before; now those of the title as found, and of a page's title that differs."""
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    plan = plan_of(spark, "q_notice_flow")
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert plan.count(f"(?:{'|'.join(dict.fromkeys(T.URBAN_STUDY))})") == 2


def test_facts_of_a_row_are_put_together_once(spark):
    """the facts under a table's headers stood many times in one expression, and were computed for each key of a map."""
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    plan = plan_of(spark, "q_notice_rows")
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert plan.count("zip_with(") == 1
