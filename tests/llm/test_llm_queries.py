"""The registered queries against their SQL, and the pipeline, on the smallest data."""

import os

import duckdb
import pytest

import check
import corpus_pipeline
import llm_brute as brute
from lexivec.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for name in check.TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    report = check.compare(spark, con, name, SF_DIR)
    assert ": ok" in report or ": rows only" in report, report


def test_thirteen_operators():
    assert [name.split("_")[0] for name in QUERIES] == [f"op{k}" for k in range(1, 14)]
    assert set(ORACLES) <= set(QUERIES)


def test_pipeline(spark):
    """Each stage decides as the plain versions do on the stage's own input."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, rows = docs.columns, [tuple(r) for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, spark.createDataFrame(rows, docs.schema), SF_DIR)
        if name == "packing":
            sizes = {i: len((t or "").split()) + 1 for i, t, *_ in rows}
            assert sum(r["n_tokens"] for r in out.collect()) == sum(sizes.values())
            break
        assert out.columns == columns
        after = [tuple(r) for r in out.collect()]
        if name == "minhash_neardup":
            groups = brute.components([(i, t) for i, t, *_ in rows], 5)
            assert sorted(r[0] for r in after) == sorted(i for i, (_, c) in groups.items() if i == c)
        if name == "suffix_dedup":
            plain = {i: k for i, _, k, _ in brute.without_repeats([(i, t) for i, t, *_ in rows], corpus_pipeline.PASSAGE)}
            assert len(after) == len(rows)
            for i, t, *_ in after:
                assert plain[i].decode(errors="ignore") == t.encode().decode() or len(t.encode()) - len(plain[i]) < 40
        if name == "decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select("item_id", "text").collect()]
            hits = brute.contamination([(i, t) for i, t, *_ in rows], items)
            assert sorted(r[0] for r in after) == sorted(i for i, _, n, *_ in hits if n == 0)
        rows = after


def test_run_is_the_stages(spark):
    out = corpus_pipeline.run(spark, SF_DIR)
    assert out.columns == ["doc_id", "piece", "token_start", "n_tokens", "bin_id", "bin_offset"] and out.count() > 0
