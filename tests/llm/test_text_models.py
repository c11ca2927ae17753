"""Language ID, quality, mixing, language-model scores and SentencePiece."""

import math
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import brown, language_id, mixing, quality
from tessera.llm import sentencepiece_unigram as sp
from tests.llm.conftest import words

# Language ID


def test_ngrams_are_those_of_padded_words():
    want = []
    for w in ("aé", "b"):
        p = f" {w} "
        want += list(w) + [p[i : i + 2] for i in range(len(p) - 1)] + [p[i : i + 3] for i in range(len(p) - 2)]
    pack = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    assert sorted(language_id.ngrams("Aé, 3--B!").tolist()) == sorted(map(pack, want))
    assert not len(language_id.ngrams("12 --")) and not len(language_id.ngrams(""))


def test_language_id_learns_held_out(spark, docs, no_docs):
    rng = random.Random(1)
    rows = [(i, words(rng, 40, "abcdefg" if i % 2 else "tuvwxyz"), "l1" if i % 2 else "l2") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = language_id.learn(df.where("doc_id < 100"))
    out = df.where("doc_id >= 100").select("lang", language_id.predict(df, profiles).alias("p")).collect()
    assert all(r.p.lang == r.lang and 0 <= r.p.score <= 1 for r in out)
    edge = docs.select("text", language_id.predict(docs, profiles).alias("p")).collect()
    for r in edge:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.p.lang in profiles) == letters and (letters or (r.p.lang, r.p.score) == ("und", 0.0))
    assert language_id.learn(no_docs) == {}
    assert {r.p.lang for r in docs.select(language_id.predict(docs, {}).alias("p")).collect()} == {"und"}
    assert no_docs.select(language_id.predict(no_docs, profiles)).count() == 0


def test_language_query_on_driver_tables(spark, tiny):
    out = language_id.op7(spark, tiny).join(spark.read.parquet(f"{tiny}/documents.parquet"), "doc_id")
    held = out.where("held_out AND lang IS NOT NULL").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert held >= 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out.select("doc_id", "held_out").collect())


# Quality


def test_quality_parts_good_from_bad(spark, no_docs):
    rng = random.Random(4)
    rows = [(i, words(rng, 60) if i % 4 else "".join(rng.choice("#$%&*! ab") for _ in range(300))) for i in range(800)] + [(900, None), (901, ""), (None, words(rng, 50))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = df.where("doc_id < 400")
    out = quality.resample(df, labels.where("doc_id % 4 <> 0"), labels.where("doc_id % 4 = 0"), bits=14)
    got = out.select("doc_id", "kept", "log_weight").collect()
    held = [r for r in got if r.doc_id is not None and 400 <= r.doc_id < 800]
    assert sum(r.kept == (r.doc_id % 4 != 0) for r in held) / len(held) > 0.97
    assert [(r.kept, r.log_weight) for r in got if r.doc_id in (900, 901)] == [(False, None)] * 2
    again = {r.doc_id: r.kept for r in quality.resample(df.repartition(7), labels.where("doc_id % 4 <> 0"), labels.where("doc_id % 4 = 0"), bits=14).collect()}
    assert again == {r.doc_id: r.kept for r in got}
    top = quality.resample(df, labels.where("doc_id % 4 <> 0"), labels.where("doc_id % 4 = 0"), k=50, bits=14)
    assert top.where("kept").count() == 50
    none = labels.limit(0)
    assert quality.resample(df, none, none, bits=14).where("kept").count() == 801
    assert quality.resample(no_docs, none, none, bits=14).count() == 0


def test_kth_largest(spark):
    rng = random.Random(0)
    values = [rng.choice([rng.gauss(0, 1), 1e9 * rng.random(), 5.0]) for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 7, 500, 1999, 2000, 3000):
        assert quality.kth_largest(df, k, bins=16) == sorted(values, reverse=True)[min(k, 2000) - 1]


# Mixing


def test_targets():
    t = mixing.targets({"b": 100, "a": 1, "c": 50, None: 49})
    assert t["a"] == 3 and math.isclose(sum(t.values()), 200) and all(t[s] <= 3 * n + 1e-9 for s, n in {"b": 100, "a": 1, "c": 50, None: 49}.items())
    assert math.isclose(t["b"] / t["c"], 2) and math.isclose(t[None] / t["c"], 5)
    assert mixing.targets({"a": 0, "b": 0}) == {"a": 0, "b": 0} and mixing.targets({}) == {}


def test_flow_repeats_as_little_as_it_can():
    taken = mixing.route({("x",): 10, ("x", "y"): 10, ("y",): 100}, {"x": 20, "y": 40})
    assert taken == {("x",): 10, ("x", "y"): 10, ("y",): 40}
    assert mixing.route({("x",): 10}, {"x": 25}) == {("x",): 25}
    assert mixing.route({("x",): 10}, {"x": 99}) == {("x",): 30}


def test_mix_meets_every_target(docs, no_docs):
    out, sources = mixing.mix(docs, F.array("source"))
    rows = out.collect()
    assert len(rows) == docs.count() and out.columns == [*docs.columns, "mix_size", "mix_taken"]
    taken, size = Counter(), Counter()
    for r in rows:
        n = len((r.text or "").encode().split())
        assert r.mix_size == n and 0 <= r.mix_taken <= 3 * n
        taken[r.source] += r.mix_taken
        size[r.source] += n
    assert sources == {s: (size[s], t) for s, t in mixing.targets(dict(size)).items()}
    assert all(abs(taken[s] - t) <= 2 for s, (_, t) in sources.items())
    again, _ = mixing.mix(docs.repartition(3), F.array("source"))
    key = lambda rs: sorted(map(str, ((r.doc_id, r.text, r.mix_taken) for r in rs)))
    assert key(again.collect()) == key(rows)
    assert mixing.mix(no_docs, F.array("source"))[0].count() == 0


def test_mix_of_overlapping_sources(spark):
    rows = [(i, "w " * (1 + i % 5), ["x"] if i % 3 else ["x", "y"]) for i in range(300)] + [(999, "w " * 40, ["y"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, member array<string>")
    out, sources = mixing.mix(df, F.col("member"), weights=(1, 1))
    total = sum(r.mix_taken for r in out.collect())
    assert total == sum(round(t) for _, t in sources.values())


# Language-model scores


def plain_scores(rows, end=""):
    train = Counter()
    toks = {}
    for k, (i, t) in enumerate(rows):
        b = bytes(t or "", "utf8").lower().split()
        toks[k] = [*b, end]
        if i is None or zlib.crc32(str(i).encode()) % 5 != 1:
            train.update(toks[k])
    n, v = sum(train.values()), len(train)
    base = {k: sum(math.log10((train[x] + 0.5) / (n + 0.5 * (v + 1))) for x in ts) for k, ts in toks.items()}
    return toks, train, n, base


@pytest.mark.parametrize("settings", [{}, {"clustered": 20, "dictionary": 50, "classes": 4}])
def test_lm_counts_and_base_scores(docs, settings):
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    got = brown.score(docs, ~held, **settings).collect()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    toks, train, n, base = plain_scores(rows)
    want = sorted((str(i), len(toks[k]), sum(train[x] > 0 for x in toks[k]), round(base[k], 6)) for k, (i, _) in enumerate(rows))
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert {r.train_tokens for r in got} == {n}
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_classes_beat_the_unigram_base(spark, no_docs):
    rng = random.Random(6)
    nouns, verbs = [f"n{i}" for i in range(40)], [f"v{i}" for i in range(40)]
    rows = [(i, " ".join(f"{rng.choice(nouns)} {rng.choice(verbs)}" for _ in range(30))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    out = brown.score(df, ~held, classes=8).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert out[0] > 0.9 * out[1]
    assert brown.score(no_docs, ~held).count() == 0


def test_exchange_finds_two_classes():
    b = np.zeros((21, 21))
    b[1:11, 11:21] = 5
    b[11:21, 1:11] = 5
    fixed = np.full(21, -1)
    fixed[0] = 2
    rng = np.random.default_rng(0)
    shuffle = np.r_[0, rng.permutation(20) + 1]
    label = brown.exchange(b[np.ix_(shuffle, shuffle)], fixed, 2)
    side = shuffle[1:] <= 10
    assert len(set(label[1:][side])) == len(set(label[1:][~side])) == 1 and label[1:][side][0] != label[1:][~side][0]


def test_probabilities_sum_to_one(docs):
    rows = docs.select(F.col("text"))
    counts = brown.count_tokens(rows, "text").cache()
    m = brown.train(counts, rows, "text", clustered=20, dictionary=50, classes=4)
    assert np.allclose((10**m.step).sum(1), 1, atol=1e-6)
    for c in set(m.label[:-1].tolist()):
        assert math.isclose((10 ** m.emit[:-1][m.label[:-1] == c]).sum(), 1, rel_tol=1e-6)


def test_words_beyond_the_start_get_classes_by_their_neighbours(spark):
    rng = random.Random(9)
    nouns, verbs = [f"n{i}" for i in range(60)], [f"v{i}" for i in range(60)]
    pick = lambda x: x[min(int(rng.expovariate(0.06)), 59)]
    rows = [(i, " ".join(f"{pick(nouns)} {pick(verbs)}" for _ in range(30))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    counts = brown.count_tokens(df, "text").cache()
    m, rare = brown.spread(brown.train(counts, df, "text", clustered=30, dictionary=50, classes=2), counts, df, "text")
    label = {w.decode(): int(k) for w, k in zip(m.ids, m.label)} | {bytes(x.word).decode(): x.label for x in rare.collect()}
    assert len(label) == counts.count()
    sides = [{k for w, k in label.items() if w.startswith(c)} for c in "nv"]
    assert [len(x) for x in sides] == [1, 1] and sides[0] != sides[1]
    assert np.allclose((10**m.step).sum(1), 1, atol=1e-6)
    for c in set(label.values()):
        assert math.isclose((10 ** m.emit[:-1][m.label[:-1] == c]).sum() + sum(10**x.emit for x in rare.collect() if x.label == c), 1, rel_tol=1e-6)


# SentencePiece


def varint(n):
    out = b""
    while True:
        out += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out


def field(n, data):
    return varint(n << 3 | 2) + varint(len(data)) + data


@pytest.fixture(scope="module")
def unigram(tmp_path_factory):
    """A unigram model file: the public vocabulary's pieces with Zipf scores, or a small one of our own."""
    import os

    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    if os.path.exists(sp.DEFAULT_MODEL):
        base = sp.Unigram(open(sp.DEFAULT_MODEL, "rb").read())
        pieces = [(p, float(s), k) for (p, _, k), s in zip(base.pieces, base.scores)]
    else:
        pieces += [(p, -1.0 - i / 7, 1) for i, p in enumerate(["▁", "▁th", "e", "t", "h", "he", "▁the", "er", "n", "▁n"])]
    body = b"".join(field(1, field(1, p.encode()) + varint(2 << 3 | 5) + struct.pack("<f", s) + varint(3 << 3) + varint(k)) for p, s, k in pieces)
    trainer = varint(3 << 3) + varint(1) + varint(35 << 3) + varint(1)
    normal = field(1, b"identity") + varint(3 << 3) + varint(1) + varint(4 << 3) + varint(0) + varint(5 << 3) + varint(1)
    path = tmp_path_factory.mktemp("sp") / "unigram.model"
    path.write_bytes(body + field(2, trainer) + field(3, normal))
    return str(path)


TEXTS = ["", "the", "Hello  wörld\n\tx 😀", "   leading", "trailing  ", "then there\nthe", "a" * 300, "日本語 text…", "x\x00y", "the " * 50, "éàü" * 10]


def test_encoding_equals_the_library(unigram):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=unigram)
    mine = sp.Unigram(open(unigram, "rb").read(), remember=5)
    rng = random.Random(8)
    texts = TEXTS + [words(rng, 30, "thern ") for _ in range(50)]
    whole = sp.Unigram(open(unigram, "rb").read())
    whole.by_word = False
    exact = whole.scores.astype(np.float64)
    cost = lambda ids: exact[[i for i in ids if i not in whole.byte_ids.values()]].sum()
    for text, ids, long in zip(texts, mine.encode_batch(texts), whole.encode_batch(texts)):
        want = lib.encode(text)
        assert long.tolist() == want, text
        # Word by word, paths that differ by less than single floats can tell may change places.
        assert ids.tolist() == want or math.isclose(cost(ids), cost(want), rel_tol=1e-5)
        assert mine.decode(ids) == text and len(ids) > 0 or not text


def test_double_array_holds_every_word():
    rng = random.Random(1)
    vocab = {"".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6))): k for k in range(500)}
    t = sp.DoubleArray.build(vocab)

    def find(w):
        s = 0
        for c in w:
            n = t.base[s] + t.codes.get(c, 0)
            if c not in t.codes or n >= len(t.check) or t.check[n] != s:
                return -1
            s = n
        return t.value[s]

    assert all(find(w) == v for w, v in vocab.items())
    assert all(find(w) == vocab.get(w, -1) for w in ("".join(rng.choice("abcdéz") for _ in range(rng.randint(1, 7))) for _ in range(2000)))


def test_tokenize(spark, docs, no_docs, unigram):
    model = sp.Unigram(open(unigram, "rb").read())
    again = sp.tokenize(docs.withColumn("copy", F.col("text")), model)
    assert again.columns == [c for c in docs.columns if c != "text"] + ["copy", "ids", "n_tokens", "n_bytes", "decoded_ok"]
    out = again.collect()
    assert len(out) == docs.count() and all(r.decoded_ok for r in out)
    assert all(r.n_tokens == len(r.ids) and (r.n_tokens > 0) == bool(r["copy"]) for r in out)
    assert not sp.tokenize(spark.createDataFrame([("a▁b",)], "text string"), model).first().decoded_ok
    assert sp.tokenize(no_docs, model).count() == 0
    assert sp.load(spark, f"file://{unigram}").pieces == model.pieces
