"""Exact top-k by inner product with norm-bucketed retrieval.

Candidates are grouped by length: buckets whose lengths lie within a tenth of each other, counted down from the greatest length,
the last one open; small buckets are put together with the next. A query's starting threshold is its k-th best score among a bounded seed of real candidates (the `seed` longest ones
and `seed` more by a hash of the id), so it is a true lower bound and prunes without losing any result; ties with it stay. The threshold over the query's
length is the length that a candidate needs at least, and queries are grouped by it in the same way. Before any row is
sent, the two small tables of groups tell which meet: only where a bucket's longest vector reaches what some query of the group needs.

Where they meet, rows stand by length, in steps. The score to beat divided by the query's length and the step's greatest length is the cosine that
a candidate must reach there: over one, the step is skipped; if high, coordinate pruning keeps only candidates whose strongest
query coordinates lie in the feasible interval; else length pruning multiplies only the prefix of those long enough. What is left
is verified with exact products, and thresholds rise with what is found.

Rows whose vector is null, empty or holds a null or non-finite component, or whose id is null, take
no part. Vectors meet only those of equal dimension. A row never meets rows of its own id; a row
repeated with the same id and vector is asked once, and answers as often as it occurs. Ties go to the smaller id. An empty table gives an
empty one; columns other than the id and the vector are not read. Scores are
exact while every |product sum| stays below 2^53 (components below about 2^23 for 64 dimensions).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize
from tessera.llm.vectors import best_rows, counted, dealt, filled, final_top, grid, matrix, seed_rows, valid_vectors

_SLACK = 1e-9


def _feasible(cosine: float, along: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Interval of a unit candidate's coordinate, given the unit query's and the cosine to reach."""
    rest = np.sqrt(np.maximum(0.0, 1 - along**2) * max(0.0, 1 - cosine**2))
    low = np.where(along < -cosine, -1.0, along * cosine - rest)
    high = np.where(along > cosine, 1.0, along * cosine + rest)
    return low - _SLACK, high + _SLACK


def search_block(cid: np.ndarray, cand: np.ndarray, qid: np.ndarray, query: np.ndarray, theta: np.ndarray, k: int, bucket_rows: int = 512, coordinate_from: float = 0.6, probes: int = 3, tally: dict | None = None):
    """(query index, candidate index, score) of the k best of this block for each query. `tally` counts the exact products made."""
    length, asked = np.sqrt((cand**2).sum(1)), np.sqrt((query**2).sum(1))
    order = np.argsort(-length, kind="stable")
    cid, cand, length, theta = cid[order], cand[order], length[order], theta.astype(np.float64)
    tally = {} if tally is None else tally
    unit_q = query / np.maximum(asked, 1e-300)[:, None]
    strongest = np.argsort(-np.abs(unit_q), axis=1)[:, :probes]
    best = np.full((len(query), k), -np.inf)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def keep(qi: np.ndarray, ci: np.ndarray) -> None:
        if not len(qi):
            return
        tally["verified"] = tally.get("verified", 0) + len(qi)
        score = np.concatenate([(query[qi[i : i + 65536]] * cand[ci[i : i + 65536]]).sum(1) for i in range(0, len(qi), 65536)])
        fit = (score >= theta[qi]) & (cid[ci] != qid[qi])
        qi, ci, score = qi[fit], ci[fit], score[fit]
        top = best_rows(qi, cid[ci], score, k)
        qi, ci, score = qi[top], ci[top], score[top]
        found.append((qi, ci, score))
        if len(qi):
            at = np.flatnonzero(np.r_[True, qi[1:] != qi[:-1]])
            rank = np.arange(len(qi)) - np.repeat(at, np.diff(np.r_[at, len(qi)]))
            more = np.full((len(at), k), -np.inf)
            more[np.repeat(np.arange(len(at)), np.diff(np.r_[at, len(qi)])), rank] = score
            rows = qi[at]
            best[rows] = -np.sort(-np.concatenate([best[rows], more], axis=1), axis=1)[:, :k]
            theta[rows] = np.maximum(theta[rows], best[rows, k - 1])

    for start in range(0, len(cand), bucket_rows):
        rows = slice(start, start + bucket_rows)
        own, longest = length[rows], length[start]
        with np.errstate(invalid="ignore", divide="ignore"):
            # A threshold of at most 0, or a zero query or bucket, prunes nothing.
            local = np.where(theta > 0, theta / (asked * longest), -1.0)
        live = ~(local > 1 + _SLACK)
        by_coordinate = np.flatnonzero(live & (local >= coordinate_from))
        by_length = np.flatnonzero(live & ~(local >= coordinate_from))
        if len(by_length):
            # length pruning: rows stand by length, so those long enough for the least demanding query are a prefix
            need = np.where(theta[by_length] > 0, theta[by_length] / np.maximum(asked[by_length], 1e-300), -1.0)
            long = int(np.searchsorted(-own, -(need.min() * (1 - _SLACK)), "right")) if need.min() > 0 else len(own)
            tally["products"] = tally.get("products", 0) + long * len(by_length)
            ci, at = np.nonzero(cand[start : start + long] @ query[by_length].T >= theta[by_length][None, :])
            keep(by_length[at], ci + start)
        if len(by_coordinate):
            unit = cand[rows] / np.maximum(own, 1e-300)[:, None]
            sorted_at = np.argsort(unit, axis=0)
            values = np.take_along_axis(unit, sorted_at, axis=0)
            pick_q, pick_c = [], []
            for x in by_coordinate.tolist():
                dims = strongest[x]
                low, high = _feasible(min(1.0, local[x]), unit_q[x, dims])
                spans = [(np.searchsorted(values[:, d], lo), np.searchsorted(values[:, d], hi, "right"), d) for d, lo, hi in zip(dims.tolist(), low, high)]
                a, b, d = min(spans, key=lambda s: s[1] - s[0])
                if b <= a:
                    continue
                hit = sorted_at[a:b, d]
                for e, lo, hi in zip(dims.tolist(), low, high):
                    if e != d and len(hit):
                        u = unit[hit, e]
                        hit = hit[(u >= lo) & (u <= hi)]
                pick_q.append(np.full(len(hit), x))
                pick_c.append(hit + start)
            if pick_q:
                keep(np.concatenate(pick_q), np.concatenate(pick_c))
    if not found:
        return tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.float64))
    qi, ci, score = (np.concatenate(x) for x in zip(*found))
    top = best_rows(qi, cid[ci], score, k)
    return qi[top], order[ci[top]], score[top]


def _bucket(length: Column, longest: float, ratio: float = 1.1, buckets: int = 64) -> Column:
    """0 for lengths from the greatest down to a tenth less, and so on; the last bucket is open."""
    step = F.floor(F.log(F.lit(longest) / length) / math.log(ratio))
    return F.when(length > 0, F.greatest(F.lit(0), F.least(F.lit(buckets - 1), step))).otherwise(buckets - 1).cast("int")


def meetings(candidates: DataFrame, queries: DataFrame) -> DataFrame:
    """(dim, bucket, group, tiles, qtiles) of the buckets and query groups that must meet: at most 64 x 64 for a dimension."""
    return candidates.join(queries, "dim").where(F.col("longest") >= F.col("need") * (1 - _SLACK)).select("dim", "bucket", "group", "tiles", "qtiles")


def top_k(df: DataFrame, is_query: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding", seed: int = 1024, block: int = 8192, tally: dict | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products of floor(scale * x)
    over all other rows. `is_query` is a condition on the column `id`. `tally` gets the rows sent and the pairs of rows that met, of all."""
    rows = valid_vectors(df, id_col, vec_col, zero=True)
    rows = rows.withColumn("vec", F.transform("vec", lambda x: F.floor(x * F.lit(scale)).cast("double")))
    rows = materialize(counted(rows).withColumn("length", F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))))
    seeds = {(r.id, tuple(r.vec)) for r in [*seed_rows(rows, seed, F.desc("length")), *seed_rows(rows, seed)]}
    longest = rows.agg(F.max("length")).first()[0] or 1.0
    by_dim: dict = {}
    for i, v in seeds:
        by_dim.setdefault(len(v), []).append((i, v))
    by_dim = {d: (np.array([i for i, _ in x]), np.array([v for _, v in x], dtype=np.float64)) for d, x in by_dim.items()}

    def thresholds(batches):
        for batch in batches:
            out = []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
                sid, sv = by_dim.get(len(v), (np.zeros(0, dtype=np.int64), np.zeros((0, len(v)))))
                score = (sv @ np.array(v))[sid != i]
                out.append(float(np.partition(score, len(score) - k)[len(score) - k]) if len(score) >= k else -np.inf)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], [*batch.schema.names, "theta"])

    asked = rows.where(is_query).select("id", "copy", "dim", "vec", "length")
    asked = asked.mapInArrow(thresholds, "id long, copy long, dim int, vec array<double>, length double, theta double")
    need = F.when((F.col("theta") > 0) & (F.col("length") > 0), F.col("theta") / F.col("length")).otherwise(0.0)
    asked = filled(materialize(asked.withColumn("need", need).withColumn("group", _bucket(need, longest)).drop("length")), "group", block)
    rows = filled(rows.withColumn("bucket", _bucket(F.col("length"), longest)), "bucket", block)
    rows, own = dealt(rows, rows.groupBy("dim", "bucket").agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("longest")), ["dim", "bucket"], block, "tile")
    asked, ask = dealt(asked, asked.groupBy("dim", "group").agg(F.count(F.lit(1)).alias("n"), F.min("need").alias("need")), ["dim", "group"], block, "qtile")
    if tally is not None:
        met = own.join(ask.withColumnRenamed("n", "m"), "dim").withColumn("met", F.col("longest") >= F.col("need") * (1 - _SLACK))
        sums = met.agg(F.sum(F.col("n") * F.col("m")), F.sum(F.when(F.col("met"), F.col("n") * F.col("m"))), F.sum(F.when(F.col("met"), F.col("n") * F.col("qtiles") + F.col("m") * F.col("tiles"))))
        tally.update(zip(("pairs", "met", "sent"), sums.first()))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("query_id", "qcopy", "vec_id", "times", "score")})
        dim = left["dim"][0].as_py()
        cid, cand, times = left["id"].to_numpy(), matrix(left["vec"], dim), left["times"].to_numpy()
        out = []
        for at in range(0, right.num_rows, 4096):
            b = right.slice(at, 4096)
            qi, ci, score = search_block(cid, cand, b["id"].to_numpy(), matrix(b["vec"], dim), b["theta"].to_numpy(), k)
            out.append((b["id"].to_numpy()[qi], b["copy"].to_numpy()[qi], cid[ci], times[ci], score.astype(np.int64)))
        return pa.table(dict(zip(("query_id", "qcopy", "vec_id", "times", "score"), map(np.concatenate, zip(*out)))))

    rows, asked = rows.select("id", "dim", "bucket", "tile", "vec", "times"), asked.select("id", "copy", "dim", "group", "qtile", "vec", "theta")
    partial = grid(rows, asked, meetings(own, ask), ["dim", "bucket"], ["dim", "group"], run, "query_id long, qcopy long, vec_id long, times long, score long")
    return final_top(partial, k, ascending=False)


def op3(spark, sf_dir: str) -> DataFrame:
    from tessera.llm.common import table

    return top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
