"""The registered queries: SQL where there is some, and the pipeline stage by stage."""

import os

import duckdb
import pytest

import corpus_pipeline
from hrefsieve.llm.queries import ORACLES, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    df = QUERIES[name](spark, SF_DIR)
    result = con.execute(ORACLES[name])
    columns = sorted(c[0] for c in result.description)
    at = [[c[0] for c in result.description].index(c) for c in columns]
    assert sorted(df.columns) == columns
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in result.fetchall()), key=repr)


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline_stages(spark, docs, tmp_path):
    """Each stage keeps the columns and survives odd rows and an empty table."""
    for frame in (spark.read.parquet(f"{SF_DIR}/documents.parquet"), docs.limit(0).select("doc_id", "text", "lang", "source", "n_chars")):
        columns, rows = frame.columns, frame.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            stage(spark, frame, SF_DIR).write.parquet(path := f"{tmp_path}/{name}-{rows}")
            frame = spark.read.parquet(path)
            assert frame.columns == columns
        encoded = corpus_pipeline.STAGES[-1][1](spark, frame, SF_DIR)
        assert encoded.count() == frame.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "bpe"]
