"""The pipeline on awkward documents: nulls, empties, long texts, repeated rows, an empty table, clashing columns."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from tests.llm.conftest import words

#: Names that operators use within.
EXTRA = ["tokens", "kept", "ids", "_text", "email", "row", "key", "_key", "secret_spans", "mix_size", "mix_taken", "log_weight", "a.b", "n_tokens", "assign"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    good = [(i, words(rng, rng.randint(20, 80)), "s%d" % (i % 3)) for i in range(200)]
    bad = [(300 + i, "".join(rng.choice("#$%&*!@~") for _ in range(200)), "s0") for i in range(40)]
    odd = [(None, None, None), (None, good[0][1], None), (1000, "", "s1"), (1001, None, "s1"), (1002, " \t\n", "s2"), (1003, words(rng, 30_000), "s2"), (1004, good[5][1] + " and one", "s0")]
    odd += [(1005, "see password=abcdefgh1 " + good[7][1], "s1"), (1006, "é" * 100_000, None), *[good[3]] * 3]
    schema = "doc_id long, text string, source string"
    docs = spark.createDataFrame(good + bad + odd, schema).repartition(4)
    docs = docs.select("doc_id", "text", F.lit("en").alias("lang"), "source", F.char_length("text").cast("long").alias("n_chars"), *[F.col("doc_id").cast("string").alias(c) for c in EXTRA])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(150)] + [(300 + i, 0, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    path = tmp_path_factory.mktemp("corpus")
    docs.write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages_keep_columns_and_whole_rows(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns, sizes = docs.columns, {}
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, corpus).cache()
        assert out.columns == columns
        # Extra columns still belong to their row.
        q = lambda c: F.col(f"`{c}`")
        assert out.where(~F.coalesce(*[q(c).eqNullSafe(F.col("doc_id").cast("string")) for c in EXTRA])).isEmpty()
        sizes[name] = out.count()
        docs = out
    assert 0 < sizes["near_dedup"] < sizes["quality"] and sizes["secrets"] == sizes["near_dedup"]
    last = p.STAGES[-1][1](spark, docs, corpus)
    assert last.where("NOT decoded_ok").isEmpty() and last.count() == sizes["mix"]


def test_what_each_stage_decides(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    kept = {r.doc_id for r in p.keep_quality(spark, docs, corpus).select("doc_id").collect()}
    assert len(kept & set(range(200))) >= 190 and len(kept & set(range(300, 340))) <= 4 and not kept & {1000, 1001}
    single = [r.doc_id for r in p.drop_near_copies(spark, docs, corpus).select("doc_id").collect()]
    assert single.count(3) == 1 and 1004 not in single and 5 in single and len([i for i in single if i in (1000, 1001, 1002)]) <= 1
    masked = {r.doc_id: r for r in p.redact_secrets(spark, docs, corpus).where("doc_id IN (1001, 1005)").collect()}
    assert "[SECRET]" in masked[1005].text and "abcdefgh1" not in masked[1005].text and masked[1005].n_chars == len(masked[1005].text)
    assert masked[1001].text is None and masked[1001].n_chars is None


def test_an_empty_table(spark, corpus, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{corpus}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0


def test_operators_keep_columns_of_any_name(spark, corpus):
    from tessera.llm import mixing, pii, quality, secrets
    from tessera.llm import sentencepiece_unigram as sp

    docs = spark.read.parquet(f"{corpus}/documents.parquet").where("doc_id < 20 OR doc_id = 1005")
    labels = spark.read.parquet(f"{corpus}/labels.parquet")
    model = sp.load(spark)
    made = {
        ("secret_spans",): secrets.scan(docs), ("base_spans", "pii_spans"): pii.detect(docs), (): pii.redact(docs), ("log_weight", "gumbel_key", "kept"): quality.by_labels(docs, labels),
        ("mix_size", "mix_taken"): mixing.mix(docs, F.array("source"))[0], ("ids", "n_tokens", "n_bytes", "decoded_ok"): sp.tokenize(docs, model),
    }
    for new, out in made.items():
        left = [c for c in EXTRA if c not in new]
        assert set(docs.columns) - {"text"} <= set(out.columns) and set(new) <= set(out.columns) and len(out.columns) == len(set(out.columns))
        assert out.count() == docs.count() and out.where(~F.coalesce(*[F.col(f"`{c}`").eqNullSafe(F.col("doc_id").cast("string")) for c in left])).isEmpty()
