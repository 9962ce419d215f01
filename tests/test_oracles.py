"""Every query of the engine's own operators against its SQL in DuckDB."""

import pytest
from conftest import same_rows

from loomline.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db(duck):
    return duck(SF)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows(spark, db, name):
    same_rows(registry.QUERIES[name](spark, SF).toPandas(), db.sql(registry.SQL[name]).df())


def test_entry_has_every_query(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.QUERIES) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


@pytest.fixture
def odd(spark, tmp_path):
    """Runs a query and its SQL over pages (page_id, url, html) of the test's own."""
    import duckdb

    def same(name, rows):
        spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
        db = duckdb.connect()
        db.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
        same_rows(registry.QUERIES[name](spark, str(tmp_path)).toPandas(), db.sql(registry.SQL[name]).df())

    return same


HEAD = "Says &quot;so&quot; and &amp"
CUT = f"<html><head><title>{HEAD}</title></head><body><article><h1>{HEAD}</h1><p>{'Prose of the page &amp; more. ' * 40}</p></article></body></html>"


@pytest.mark.parametrize("name", ["articles_selected", "selected_html", "selector_candidates"])
def test_references_cut_short(odd, name):
    odd(name, [(1, "https://a.b/x", CUT)])


def test_an_answer_wins_over_the_longest_page(odd):
    page = f"<html><body><article>{'<p>Some prose, of the page, that goes on and on.</p>' * 4000}</article></body></html>"
    odd("fetch_cascade", [(3, "https://a.b/x", page), (6, "https://a.b/y", page[:4000]), (7, "https://a.b/z", page)])
