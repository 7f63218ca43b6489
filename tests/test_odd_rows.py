"""Queries against their SQL on tables with rows that the given ones lack."""

import duckdb
import pytest

from tidewatch.plans import accounting, catalog, judgements  # noqa: F401

DIR = "/root/testdata/sf0.001"


@pytest.fixture
def agree(spark, tmp_path):
    """Whether a query gives its SQL's rows on tables that DuckDB writes."""

    def run(name, **tables):
        con = duckdb.connect()
        con.execute("set timezone='UTC'")
        for t, sql in tables.items():
            con.execute(f"create table {t} as {sql}")
            con.execute(f"copy {t} to '{tmp_path}/{t}.parquet' (format parquet)")
        wanted = con.execute(catalog.ORACLE[name]).fetchall()
        got = [tuple(r) for r in catalog.QUERIES[name](spark, str(tmp_path)).select(*[c[0] for c in con.description]).collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, wanted)) and wanted
        return got

    return run


def test_a_part_of_a_day_is_due(agree):
    """balances between 1999 and 2000, the bound itself, and numbers that no date reaches."""
    said = "1998.99, 1999.0, 1999.01, 1999.999999, 2000.0, 2000.01, 1e300, -1e300, 'nan'::DOUBLE, 'infinity'::DOUBLE, '-infinity'::DOUBLE, NULL"
    agree("q_refresh_due", supplier=f"SELECT row_number() OVER () AS s_suppkey, x::DOUBLE AS s_acctbal FROM (SELECT unnest([{said}]) AS x)")


def test_links_of_a_page_are_not_its_title(agree):
    """long labels of a page's own links, titles cut inside an entity, pages that end inside a comment, long titles."""
    long = "Un titre assez long pour compter"
    pages = [
        f"<title>{long} 1</title><a href=/x>Enbescherverauheit</a><a href=/p/1>{long} 1</a>", f"<title>{long} 2 &&amp;&&amp</title>", f"<title>{long} &copy; &amp;lt; 3</title><!-- open", "<title>kurz</title><a href=/p/4>Enbescherverauheit</a>",
        f"<title>{long} 5</title>" + f"<a href=/x>{long} x</a>" * 300, f"<title> {long}\n  {'x' * 1200} </title><script>", "",
    ]
    rows = ", ".join(f"({i + 1}, 'http://a.example/b/{i}?c', '" + p.replace("'", "''") + "')" for i, p in enumerate(pages))
    got = agree("q_linked_items", pages=f"SELECT * FROM (VALUES {rows}, (8, NULL, '<title>{long} 8</title>'), (9, 'http://a.example', NULL)) v(page_id, url, html)")
    assert len(got) == 6
