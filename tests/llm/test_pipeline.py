"""Queries with SQL against DuckDB, and every pipeline stage on real, odd and empty documents."""

import duckdb
import pytest

import corpus_pipeline
from check import rows_of
from trailmark.llm.queries import QUERIES, SQL

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(llm, name):
    got = QUERIES[name](llm, SF_DIR).toPandas()
    assert len(got)
    if name in SQL:
        con = duckdb.connect()
        for t in ("documents", "embeddings", "labels"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
        want = con.sql(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and rows_of(got) == rows_of(want)


def test_stages(llm, odd, none):
    docs = llm.read.parquet(f"{SF_DIR}/documents.parquet")
    for start in (docs, odd, none):
        kept = start
        for name, stage in corpus_pipeline.STAGES:
            out = stage(llm, kept, SF_DIR)
            if name != "packing":
                assert out.columns == kept.columns
                out = out.cache()
                ids = {r["doc_id"] for r in out.select("doc_id").collect()}
                assert ids <= {r["doc_id"] for r in kept.select("doc_id").collect()}
                if name == "line_dedup":
                    assert out.count() == kept.count()
                if name == "near_dedup" and start is docs:
                    from trailmark.llm.near_dedup import near_duplicates

                    assert near_duplicates(out, 5).where("not kept").count() == 0
                kept = out
            else:
                assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} == {r["doc_id"] for r in kept.select("doc_id").collect()}


def test_run(llm):
    assert corpus_pipeline.run(llm, SF_DIR).count() > 0


def test_mixing_takes_all_copies_of_equal_rows(llm):
    import collections

    from trailmark.llm.mixing import mix

    rows = [(i, f"word{i} " * (5 + i % 3), f"s{i % 3}") for i in range(12)]
    rows += [(50, "the same row " * 3, "s0")] * 7 + [(51, "another " * 4, "s1")] * 4 + [(None, "no id " * 3, None)] * 3 + [(None, "x", None)]
    docs = llm.createDataFrame(rows, "doc_id long, text string, source string")
    want = collections.Counter()
    for r in mix(docs).collect():
        want[(r["doc_id"], r["source"], r["size"])] += r["copies"]
    assert any(want[(d, s, n)] % m for d, s, n, m in ((50, "s0", 9, 7), (51, "s1", 4, 4), (None, None, 6, 3)))
    got = collections.Counter((r["doc_id"], r["source"], len(r["text"].split())) for r in corpus_pipeline.mixing(llm, docs, SF_DIR).collect())
    assert got == +want
