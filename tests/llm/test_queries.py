"""The registered queries against their SQL, and the pipeline against its stages."""

import os

import duckdb
import pytest

import corpus_pipeline
from tierstats.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    rows = sorted((tuple(df.columns[i] + repr(round(x, 9) if isinstance(x, float) else x) for i, x in sorted(enumerate(r), key=lambda e: df.columns[e[0]])) for r in df.collect()))
    assert rows
    if name in ORACLES:
        c = duckdb.connect()
        for t in ("documents", "conversations", "embeddings"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        want = c.execute(ORACLES[name])
        names = [d[0] for d in want.description]
        assert rows == sorted(tuple(names[i] + repr(round(x, 9) if isinstance(x, float) else x) for i, x in sorted(enumerate(r), key=lambda e: names[e[0]])) for r in want.fetchall())


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept, SF)
        before, after = kept.count(), out.count()
        assert 0 < after <= before
        if name != "mixing":
            assert out.columns == docs.columns
        if name == "line_dedup":
            assert after == before
        kept = out
    ids = {r.doc_id for r in kept.collect()}
    assert ids == {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()}
