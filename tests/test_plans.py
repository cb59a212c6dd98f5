import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__  # noqa: F401 (registers the queries)
from lectern.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def plain(v):
    if pd.isna(v):
        return None
    return float(round(v, 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name not in ORACLE_SQL:
        assert len(got)
        return
    want = duck.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)
    assert rows(got) == rows(want)


def test_page_texts_cut_references(spark, tmp_path):
    ends = ["", *("&quot"[:n] for n in range(1, 6)), *("&amp"[:n] for n in range(2, 5))]
    ends += ["&copy", "&middot", "&nbsp", "&lt", "&#39", "&#x27", "&#39x;", "&notit;", "&zz;", "&ampquot;", "&amp;quot", "&quot&quot;"]
    ends += ["&copy;", "&middot;", "&nbsp;", "&quot;", "&amp;", "&ampoule"]
    pages = [(i, f"<title>a {e}</title><p title='&quot'>{e}x {e} y{e}<br>{e}</p><!-- {e} --><script>{e}</script>&copy; z {e}") for i, e in enumerate(ends)]
    spark.createDataFrame([*pages, (len(pages), None), (len(pages) + 1, "")], "page_id long, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    rows = lambda df: sorted(tuple(map(plain, r)) for r in df[["page_id", "n_chars", "digest", "words"]].itertuples(index=False))
    assert rows(QUERIES["page_texts"](spark, str(tmp_path)).toPandas()) == rows(con.sql(ORACLE_SQL["page_texts"]).df())


def test_streaming_progress(spark, tmp_path):
    from lectern.streaming.progress import furthest_progress

    spark.createDataFrame([("u", 3), ("u", 9), ("v", 1)], "user_id string, position int").write.parquet(str(tmp_path / "in"))
    moves = spark.readStream.schema("user_id string, position int").parquet(str(tmp_path / "in"))
    q = furthest_progress(moves).writeStream.outputMode("complete").format("memory").queryName("furthest")
    q.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.table("furthest").collect())) == [("u", 9, 2), ("v", 1, 1)]
