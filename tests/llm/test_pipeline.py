"""The pipeline against its stages' definitions, and the entry's queries against SQL."""

from __future__ import annotations

import os

import pytest

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_stages(spark):
    import corpus_pipeline
    from tests.llm.test_operators import class_truth, split, statistics

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    inputs = {r["doc_id"]: r for r in docs.collect()}
    columns, kept = docs.columns, None
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA).cache()
        rows = out.collect()
        if k < 4:
            assert out.columns == columns
        if k == 0:
            for r in rows:
                n, *_, again = statistics(r["text"])
                assert n >= 50 and 100 * again <= 50 * n
            assert len(rows) > 0.6 * len(inputs)
        if k == 1:
            truth = class_truth([(r["doc_id"], r["text"]) for r in kept])
            assert sorted(r["doc_id"] for r in rows) == sorted({v[0] for v in truth.values()})
        if k == 2:
            items = [r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
            assert not any(i in r["text"] for i in items for r in rows)
            gone = {r["doc_id"] for r in kept} - {r["doc_id"] for r in rows}
            assert gone <= {r["doc_id"] for r in kept}
        if k == 3:
            taken = sum(len(split(r["text"])) for r in rows)
            assert abs(taken / sum(len(split(r["text"])) for r in kept) - 1.5) < 0.2
        if k == 4:
            assert len(rows) == len(kept) and max(r["shard_bytes"] for r in rows) <= 64 << 20
        kept = rows
        docs = out


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_oracles(spark):
    import duckdb

    from voxelspark.llm import queries

    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    for name, sql in queries.ORACLE.items():
        got = queries.QUERIES[name](spark, DATA)
        names = sorted(got.columns)
        want = con.sql(f"select {', '.join(names)} from ({sql})").fetchall()
        assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.select(*names).collect()), name
