"""Approximate nearest neighbours with randomly rotated one-bit codes.

Vectors of a dimension are centred (on the mean, for the commonest dimension), turned by `turns` independent random rotations (fixed seeds) and kept as the
packed signs of their coordinates plus scalars: the distance to the centre, and for each rotation the inner product
of the unit vector with its own code. A query is turned likewise and rounded to four bits a coordinate, so its product with a code
is four bitwise-and population counts over packed words. The scalars correct that to an estimate of the distance with a standard error;
the mean over the rotations has half the error with four of them, at 32 bytes for 64 dimensions.

Only codes and scalars are sent to meet the queries, not vectors, and twice. First each query's `first` nearest by estimate are fetched
and reranked on the original vectors: their k-th distance is a true upper bound. Then all candidates whose lower bound (`epsilon`
standard errors under the estimate) doesn't exceed it are fetched and reranked as well. So scores are exact, and a neighbour is missed only
if its estimate errs by more than the bound allows. Every row is coded and meets every query; nothing is sampled.

Rows whose vector is null, empty, zero or holds a null or non-finite component, or whose id is null,
take no part. Vectors meet only those of equal dimension. A row never meets rows of its own id; a row repeated with the same id
and vector is asked once and answers as often as it occurs. Ties go to the smaller id. An empty table gives an empty one; columns other
than the id and the vector are not read.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize
from tessera.llm.vectors import counted, dealt, final_top, grid, matrix, valid_vectors

_PLANES = 4  # bits of a query's coordinate


@functools.lru_cache(64)
def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _unit(vectors: np.ndarray, centre: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors from the centre, and the distances to it."""
    rest = vectors if centre is None else vectors - centre
    norm = np.sqrt((rest**2).sum(1))
    return rest / np.maximum(norm, 1e-300)[:, None], norm


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of 64-bit words."""
    out = np.packbits(bits, axis=1)
    return np.ascontiguousarray(np.pad(out, ((0, 0), (0, -out.shape[1] % 8)))).view(np.uint64)


def encode(vectors: np.ndarray, centre: np.ndarray | None, turns: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs (the words of one rotation after those of the other), distance to the centre, and the unit vector's product with each code."""
    unit, norm = _unit(vectors, centre)
    turned = [unit @ rotation(vectors.shape[1], r) for r in range(turns)]
    own = np.stack([np.abs(t).sum(1) for t in turned], axis=1) / np.sqrt(vectors.shape[1])
    return np.concatenate([_packed(t > 0) for t in turned], axis=1), norm, np.maximum(own, 1e-12)


def estimates(codes: np.ndarray, norm: np.ndarray, own: np.ndarray, query: np.ndarray, centre: np.ndarray | None, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimates of the squared distances and their lower bounds, queries by candidates, from packed words and scalars alone."""
    dim, turns = query.shape[1], own.shape[1]
    width = codes.shape[1] // turns
    flat, q_norm = _unit(query, centre)
    product, variance = np.zeros((len(query), len(codes))), np.zeros((len(query), len(codes)))
    for r in range(turns):
        unit, words = flat @ rotation(dim, r), codes[:, r * width : (r + 1) * width]
        low = unit.min(1)
        step = np.maximum((unit.max(1) - low) / (2**_PLANES - 1), 1e-300)
        level = np.rint((unit - low[:, None]) / step[:, None]).astype(np.int64)
        ones = np.bitwise_count(words).sum(1, dtype=np.int32)
        dot = np.zeros((len(query), len(codes)), dtype=np.int32)
        for j in range(_PLANES):
            plane = _packed((level >> j) & 1)
            for w in range(width):
                dot += np.bitwise_count(plane[:, w, None] & words[None, :, w]).astype(np.int32) << j
        # A code's signs are 2 * bit - 1; a coordinate is low + step * level.
        signs = 2 * (step[:, None] * dot + low[:, None] * ones[None, :]) - (step * level.sum(1) + low * dim)[:, None]
        product += signs / np.sqrt(dim) / own[None, :, r] / turns
        # The part of a unit vector across its code, and the rounding of the query's coordinates.
        variance += (np.maximum(0, 1 - own[:, r] ** 2)[None, :] / max(1, dim - 1) + (step**2 / 12)[:, None]) / own[None, :, r] ** 2 / turns**2
    base, scale = norm[None, :] ** 2 + q_norm[:, None] ** 2, 2 * norm[None, :] * q_norm[:, None]
    estimate = base - scale * product
    return estimate, estimate - scale * epsilon * np.sqrt(variance)


def nearest(df: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", epsilon: float = 1.9, first: int = 80, turns: int = 4, block: int = 65_536, query_block: int = 16_384) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each query, nearest first."""
    rows = materialize(counted(valid_vectors(df, id_col, vec_col, zero=False)))
    common = rows.groupBy("dim").agg(F.sum("times").alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    dim = common[0].dim if common else 1
    # The mean of each coordinate: one row per coordinate.
    mean = {r.pos: r.mean for r in rows.where(F.col("dim") == dim).select(F.posexplode("vec")).groupBy("pos").agg(F.avg("col").alias("mean")).collect()}
    middle = np.array([mean.get(i, 0.0) for i in range(dim)])
    centre_of = lambda d: middle if d == dim else None

    def coded(batches):
        for batch in batches:
            dims = batch.column(2).to_numpy()
            bits, norm, own = np.empty(len(dims), dtype=object), np.zeros(len(dims)), np.ones((len(dims), turns), dtype=np.float32)
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                words, norm[at], own[at] = encode(matrix(batch.column(3).take(pa.array(at)), d), centre_of(d), turns)
                bits[at] = [w.tobytes() for w in words]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(bits, pa.binary()), pa.array(norm.astype(np.float32)), pa.array([x.tobytes() for x in own], pa.binary())], ["id", "copy", "dim", "bits", "norm", "own"])

    codes = materialize(rows.select("id", "copy", "dim", "vec").mapInArrow(coded, "id long, copy long, dim int, bits binary, norm float, own binary"))
    asked = rows.where(is_query).select("id", "copy", "dim", "vec")
    # Dimensions aren't grouped further, so there is one row of sizes for each.
    codes, sizes = dealt(codes, codes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")), ["dim"], block, "tile")
    asked, asks = dealt(asked, asked.groupBy("dim").agg(F.count(F.lit(1)).alias("n")), ["dim"], query_block, "qtile")
    pairs = sizes.select("dim", "tiles").join(asks.select("dim", "qtiles"), "dim")

    def search(within: bool):
        """The candidates whose lower bound is within the query's bound, or else the `first` nearest by estimate."""

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            out = [np.zeros((0, 4), dtype=np.int64)]
            far = [np.zeros(0)]
            if left.num_rows and right.num_rows:
                d = left["dim"][0].as_py()
                words = np.frombuffer(b"".join(left["bits"].to_pylist()), dtype=np.uint64).reshape(left.num_rows, -1)
                cid, copy, norm = left["id"].to_numpy(), left["copy"].to_numpy(), left["norm"].to_numpy().astype(np.float64)
                own = np.frombuffer(b"".join(left["own"].to_pylist()), dtype=np.float32).reshape(left.num_rows, turns).astype(np.float64)
                for at in range(0, right.num_rows, 32):
                    b = right.slice(at, 32)
                    qid, qcopy = b["id"].to_numpy(), b["copy"].to_numpy()
                    estimate, low = estimates(words, norm, own, matrix(b["vec"], d), centre_of(d), epsilon)
                    same = qid[:, None] == cid[None, :]
                    if within:
                        qi, ci = np.nonzero((low <= b["bound"].to_numpy()[:, None] ** 2 * (1 + 1e-9)) & ~same)
                    else:
                        estimate[same] = np.inf
                        ci = np.argpartition(estimate, first - 1, axis=1)[:, :first] if len(cid) > first else np.tile(np.arange(len(cid)), (len(qid), 1))
                        qi, ci = np.repeat(np.arange(len(qid)), ci.shape[1]), ci.ravel()
                        keep = ~same[qi, ci]
                        qi, ci = qi[keep], ci[keep]
                    out.append(np.stack([qid[qi], qcopy[qi], cid[ci], copy[ci]], axis=1))
                    far.append(estimate[qi, ci])
            found = np.concatenate(out)
            return pa.table([*(pa.array(found[:, j]) for j in range(4)), pa.array(np.concatenate(far))], ["query_id", "qcopy", "vec_id", "copy", "estimate"])

        return run

    schema = "query_id long, qcopy long, vec_id long, copy long, estimate double"
    best = Window.partitionBy("query_id", "qcopy").orderBy("estimate", "vec_id", "copy")
    near = grid(codes, asked, pairs, ["dim"], ["dim"], search(False), schema).withColumn("place", F.row_number().over(best))
    near = materialize(_exact(near.where(F.col("place") <= first).drop("place", "estimate"), rows))
    # A query with fewer than k rows in reach has no bound.
    ranked = near.withColumn("upto", F.sum("times").over(Window.partitionBy("query_id", "qcopy").orderBy("score", "vec_id", "copy").rowsBetween(Window.unboundedPreceding, 0)))
    bounds = ranked.where(F.col("upto") >= k).groupBy("query_id", "qcopy").agg(F.min("score").alias("bound"))
    bounds = bounds.select(F.col("query_id").alias("id"), F.col("qcopy").alias("copy"), "bound")
    asked = asked.join(bounds, ["id", "copy"], "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    more = grid(codes, asked, pairs, ["dim"], ["dim"], search(True), schema).drop("estimate")
    more = more.join(near.select("query_id", "qcopy", "vec_id", "copy"), ["query_id", "qcopy", "vec_id", "copy"], "left_anti")
    return final_top(near.unionByName(_exact(more, rows)), k, ascending=True)


def _exact(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs with `times` and `score`, the Euclidean distance in double precision, from both original vectors."""
    asked = rows.select(F.col("id").alias("query_id"), F.col("copy").alias("qcopy"), F.col("vec").alias("asked"))
    found = rows.select(F.col("id").alias("vec_id"), "copy", "times", "vec")
    both = pairs.join(asked, ["query_id", "qcopy"]).join(found, ["vec_id", "copy"]).select("query_id", "qcopy", "vec_id", "copy", "times", "asked", "vec")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                size = np.diff(batch.column(6).offsets.to_numpy())
                score = np.zeros(len(size))
                for d in np.unique(size).tolist():
                    at = pa.array(np.flatnonzero(size == d))
                    a, b = (matrix(batch.column(c).take(at), d) for c in (5, 6))
                    score[at.to_numpy()] = np.sqrt(((a - b) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(score)], [*batch.schema.names[:5], "score"])

    return both.mapInArrow(run, "query_id long, qcopy long, vec_id long, copy long, times long, score double")


def op10(spark, sf_dir: str) -> DataFrame:
    from tessera.llm.common import table

    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)
