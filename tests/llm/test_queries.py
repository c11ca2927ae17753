"""The registered queries and the pipeline on the smallest driver tables."""

import duckdb

import __spark_entry__ as entry
from tessera.llm.queries import ORACLE_SQL, QUERIES


def test_every_operator_is_registered():
    names = set(entry.queries())
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and set(QUERIES) <= names


def test_exact_search_equals_sql(spark, tiny):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tiny}/embeddings.parquet'")
    want = con.sql(ORACLE_SQL["op3_exact_topk"]).fetchall()
    assert sorted(map(tuple, QUERIES["op3_exact_topk"](spark, tiny).collect())) == sorted(want)


def test_pipeline_stages(spark, tiny):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    columns = docs.columns
    seen = [docs.count()]
    for name, stage in p.STAGES:
        out = stage(spark, docs, tiny).cache()
        if name == "near_dedup":
            assert out.groupBy("text").count().where("count > 1").isEmpty()
        if name == "secrets":
            assert out.count() == seen[-1] and out.where("n_chars <> char_length(text)").isEmpty()
        if name != "tokenize":
            assert out.columns == columns
            assert {r.doc_id for r in out.select("doc_id").collect()} <= {r.doc_id for r in docs.select("doc_id").collect()}
        seen.append(out.count())
        docs = out
    assert docs.where("NOT decoded_ok").isEmpty() and seen[-1] == seen[-2]
