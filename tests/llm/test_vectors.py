"""Both vector searches against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann, topk

SCHEMA = "vec_id long, embedding array<float>, label int, id long, copy long, vec string"


@pytest.fixture(scope="module")
def vectors(spark):
    rng = random.Random(3)
    out = [(None, [1.0] * 8), (5000, None), (5001, [1.0, None] + [0.0] * 6), (5002, [float("nan")] * 8), (5003, [float("inf")] + [0.0] * 7), (5004, []), (5005, [0.0] * 8), (5006, [1.0, 2.0])]
    out += [(i, [rng.gauss(0, 1) * (10 if i % 7 == 0 else 1) for _ in range(8)]) for i in range(600)]
    out += [(1000 + i, [0.5, -0.5] * 4) for i in range(200)]  # a very common vector
    out += [(0, out[8][1])]  # a repeated row
    return spark.createDataFrame([(i, v, None, None, 1, None) for i, v in out], SCHEMA).repartition(6)


def valid(df, zero):
    rows = []
    for r in df.collect():
        v = r.embedding
        if r.vec_id is None or not v or any(x is None or not math.isfinite(x) for x in v) or (not zero and not any(v)):
            continue
        rows.append((r.vec_id, np.array(v, dtype=np.float64)))
    return rows


def brute(rows, step, k, score, sign):
    want = {}
    for i, v in rows:
        if i % step:
            continue
        near = sorted((sign * score(v, w), j) for j, w in rows if j != i and len(w) == len(v))[:k]
        want[i] = [(j, sign * s) for s, j in near]
    return {i: x for i, x in want.items() if x}


def got(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


@pytest.mark.parametrize("block,seed", [(64, 16), (4096, 1024)])
def test_top_k_is_exact(vectors, block, seed):
    rows = [(i, np.floor(64 * v)) for i, v in valid(vectors, zero=True)]
    assert got(topk.top_k(vectors, F.col("id") % 20 == 0, block=block, seed=seed)) == brute(rows, 20, 20, lambda a, b: int(a @ b), -1)


def test_coordinate_pruning_loses_nothing():
    rng = np.random.default_rng(0)
    cand, query = np.floor(rng.standard_normal((900, 16)) * 40), np.floor(rng.standard_normal((30, 16)) * 40)
    ids = np.arange(900)
    score = query @ cand.T
    theta = np.sort(score, axis=1)[:, -30].astype(float)
    for start in (0.0, 2.0):  # everything by coordinate, everything by length
        qi, found, s = topk.search_block(ids, cand, np.full(30, -1), query, theta, 10, bucket_rows=100, coordinate_from=start)
        for q in range(30):
            best = np.lexsort((ids, -score[q]))[:10]
            mine = sorted(zip(-s[qi == q], found[qi == q]))
            assert mine == [(-score[q, b], b) for b in best]


def test_nearest_has_exact_distances_and_high_recall(vectors):
    rows = valid(vectors, zero=False)
    want = brute(rows, 100, 10, lambda a, b: float(np.sqrt(((a - b) ** 2).sum())), 1)
    found = got(ann.nearest(vectors, F.col("id") % 100 == 0, block=64))
    assert found.keys() == want.keys()
    vec = dict(rows)
    hits = total = 0
    for i, near in found.items():
        assert len(near) == len(want[i])
        for j, s in near:
            assert s == float(np.sqrt(((vec[i] - vec[j]) ** 2).sum()))
        assert near == sorted(near, key=lambda x: (x[1], x[0]))
        hits += len({j for j, _ in near} & {j for j, _ in want[i]})
        total += len(near)
    assert hits / total >= 0.9


def test_recall_on_unclustered_vectors(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((3000, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    found = got(ann.nearest(df, F.col("id") % 100 == 0))
    v = v.astype(np.float64)
    hits = 0
    for i, near in found.items():
        far = ((v - v[i]) ** 2).sum(1)
        far[i] = np.inf
        hits += len({j for j, _ in near} & set(np.argsort(far, kind="stable")[:10].tolist()))
    assert hits / (10 * len(found)) >= 0.9


def test_few_and_no_vectors(spark):
    some = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<float>")
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert [r.vec_id for r in topk.top_k(some, F.col("id") % 20 == 0).collect()] == [1]
    assert [r.vec_id for r in ann.nearest(some, F.col("id") % 100 == 0).collect()] == [1]
    assert topk.top_k(none, F.col("id") % 20 == 0).count() == ann.nearest(none, F.col("id") % 100 == 0).count() == 0
