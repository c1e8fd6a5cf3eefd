"""Registered queries of the document operators against their SQL."""

from collections import Counter

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from quillstream.plans import book_queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in ("documents", "pages", "conversations", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(book_queries.QUERIES))
def test_query(spark, con, name):
    df = book_queries.QUERIES[name](spark, SF)
    result = con.execute(book_queries.ORACLE_SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert Counter(map(tuple, df.select(*columns).collect())) == Counter(result.fetchall())


CUT = ["book_report", "html_to_text", "epub_chapters", "page_titles", "pipeline_text"]


@pytest.mark.parametrize("name", CUT)
def test_cut_entities(spark, tmp_path, name):
    """Titles and headings cut off inside an entity, as the larger tables have them."""
    page = "<html><head><title>{0}</title></head><body><h1>{0}</h1><p>x &amp; {0}</p><li>{0}</li></body></html>"
    ends = ["&amp;&amp;&amp", "&am", "&", "&amp;", "&quo", "&copy", "a &ampb", "&AMP", "&amp;copy;", "&amp;quot"]
    rows = [(i, f"https://h/{i}", page.format(f"Ly {e}")) for i, e in enumerate(ends)]
    pq.write_table(pa.table({"page_id": [r[0] for r in rows], "url": [r[1] for r in rows], "html": [r[2] for r in rows]}), f"{tmp_path}/pages.parquet")
    result = duckdb.connect().execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet')").execute(book_queries.ORACLE_SQL[name])
    columns = [c[0] for c in result.description]
    got = book_queries.QUERIES[name](spark, str(tmp_path)).select(*columns).collect()
    assert Counter(map(tuple, got)) == Counter(result.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
