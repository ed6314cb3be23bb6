"""Every registered query of the library against its oracle on the smallest tables, as far as they are there."""

from pathlib import Path

import duckdb
import pytest

from quoin.plans.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(DATA).is_dir(), reason="the given tables are not here")


def plain(v):
    return str(round(v, 9)) if isinstance(v, float) else str(v)


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("|".join(plain(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, db, name):
    df = QUERIES[name](spark, DATA)
    got = db.execute(ORACLES[name])
    columns = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(columns)
    assert sorted_rows(df.columns, df.collect()) == sorted_rows(columns, got.fetchall())


def test_pages_cut_off_anywhere_read_as_in_the_oracle(spark, tmp_path):
    pages = [
        "<h1>token = &quot</h1><p>x", "a&lt b&gt;c &nbsp &middot&copy;d &amp&amp;e &ampquot; &amp;quot; &apos;&#39;", "&eacute; &#1055;&#x41;&frac12x &#390; &", "x <a href='y", "a < b <c &quo", "<> <", "&am", "",
        "&amp;&amp</title><i>&am", None, "&l&lt;t; &amp#39; &amplt; R&D &AMP; \t\u00a0\u2028 y",
    ]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.text for r in QUERIES["html_strip_text"](spark, str(tmp_path)).collect()}
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == dict(c.execute(ORACLES["html_strip_text"]).fetchall())
    assert got[0].startswith("token = &quot x ") and got[9] is None


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
