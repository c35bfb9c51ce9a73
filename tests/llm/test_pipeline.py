"""The registered operator queries against SQL, and the pipeline against its stages' own rules."""

import duckdb
import pytest

import corpus_pipeline
from weirflow.llm import decontam, queries, toxicity

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    df = queries.queries()[name](spark, SF)
    got = sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)
    assert got
    if sql := queries.oracle_sql().get(name):
        con = duckdb.connect()
        for t in ("documents", "pages"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        out = con.execute(sql)
        names = [c[0] for c in out.description]
        assert sorted(names) == sorted(df.columns)
        assert got == sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in out.fetchall()), key=repr)


def test_stages(spark):
    from test_operators import brute_components

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        rows = docs.collect()
        if name != "shard":
            assert docs.columns == columns
        if name == "toxicity":
            start = spark.read.parquet(f"{SF}/documents.parquet")
            bad = {r.doc_id for r in toxicity.score(start, toxicity.train(start, spark.read.parquet(f"{SF}/labels.parquet"))).filter("toxic").collect()}
            assert bad and {r.doc_id for r in rows} == set(before) - bad
        if name == "near_dedup":
            assert {r.doc_id for r in rows} == {i for i, _, _, k in brute_components(list(kept.items())) if k}
        if name == "decontaminate":
            items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert not any(x in r.text for r in rows for x in items)
            assert len(kept) - len(rows) <= 2 + sum(any(x in t for x in items) for t in kept.values())
        if name == "mix":
            assert {r.doc_id for r in rows} <= set(kept) and len(rows) > len(kept)
        kept = {r.doc_id: r.text for r in rows}
    assert {"shard", "shard_bytes"} <= set(docs.columns)
    assert decontam.WIDTH == 5


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 100 and [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontaminate", "mix", "shard"]
