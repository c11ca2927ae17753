"""Quality classifier by importance resampling.

Two generative models over hashed byte n-grams are compared: of the target (documents labelled good)
and of the raw text (all documents). Each gives the next byte after the n-1 bytes before it (order 1: of any byte), so the shares of
languages or topics in the labels don't matter; the target's counts are smoothed by the raw model. A document's
log weight is the log ratio of the probabilities that both give its whole text, summed over the orders. Standard Gumbel noise is
added, and the k highest keys are drawn: importance resampling without replacement, each draw in proportion to the weights.
Unless k is given it is `share` of the documents with text, by default the share of good ones among the labelled.

The target model is fitted on at most `labelled` good documents (the first by a hash of the id; a document whose id repeats
brings all its rows). Raw counts, weights and the draw cover all documents. The k-th key is found by counting in bins, not by sorting on one
machine. The noise depends on the id, the text and the seed only, so reruns agree.

A null or empty text has no weight and is never drawn. Equal keys at the border are all kept, so repeated rows, which
get equal keys, stay or go together. Without labelled good documents every weight is 0 and all documents are drawn unless a share is given; an empty
table gives an empty one. Long texts are read whole, one at a time. Extra columns stay, whatever their names; log_weight, gumbel_key and kept are replaced
at the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import as_bytes, each_as_bytes, map_text, materialize, quoted, slices

_ORDERS = (1, 3, 5)
_MIX = np.uint32(0x9E3779B1)  # golden-ratio multiplier of multiplicative hashing


def hashed(text: bytes, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of every n-gram's context (its first n-1 bytes) and of the n-gram itself."""
    if n == 1:
        return np.zeros(len(text), dtype=np.int32), np.frombuffer(text, dtype=np.uint8).astype(np.int32)
    code = np.frombuffer(text, dtype=np.uint8).astype(np.uint32)
    m = max(0, len(code) - n + 1)
    h, shift = code[:m].copy(), np.uint32(32 - bits)
    for i in range(1, n - 1):
        h *= _MIX
        h += code[i : m + i]
    h *= _MIX
    context = (h >> shift).astype(np.int32)
    h += code[n - 1 : m + n - 1]
    h *= _MIX
    return context, (h >> shift).astype(np.int32)


def blocks(text: bytes, n: int, bits: int, size: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """`hashed` of a text by blocks, so that a long one needs no long arrays: each block overlaps the next by n-1 bytes."""
    for at in range(0, max(1, len(text) - n + 1), size):
        yield hashed(text[at : at + size + n - 1], n, bits)


def bucket_counts(docs: DataFrame, text_col: str, bits: int) -> np.ndarray:
    """Counts by order, context or n-gram, and bucket: a table of bounded size whatever the input."""
    size = 1 << bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(_ORDERS), 2, size), dtype=np.int64)
        waiting: list[list[list[np.ndarray]]] = [[[], []] for _ in _ORDERS]
        held = np.zeros(len(_ORDERS), dtype=np.int64)

        def add(k: int) -> None:
            for j in range(2):
                if waiting[k][j]:
                    counts[k, j] += np.bincount(np.concatenate(waiting[k][j]), minlength=size)
                    waiting[k][j].clear()
            held[k] = 0

        for batch in (part for whole in batches for part in slices(whole, 0)):
            for text in as_bytes(batch.column(0)):
                for k, n in enumerate(_ORDERS):
                    for both in blocks(text, n, bits):
                        for j, b in enumerate(both):
                            waiting[k][j].append(b)
                        held[k] += len(both[0])
                        if held[k] > 1 << 20:
                            add(k)
        for k in range(len(_ORDERS)):
            add(k)
        flat = counts.ravel()
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at])], ["bucket", "n"])

    found = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(_ORDERS) * 2 * size)
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out.reshape(len(_ORDERS), 2, size)


@dataclass
class Ratio:
    """What a log weight needs, by order and bucket."""

    bits: int
    share: np.ndarray  # target's count of an n-gram over the raw count
    raw: np.ndarray  # raw count of a context
    known: np.ndarray  # log of the target's count of a context and the smoothing
    smoothing: float

    @classmethod
    def of(cls, target: np.ndarray, raw: np.ndarray, bits: int, smoothing: float) -> Ratio:
        share = np.divide(target[:, 1], raw[:, 1], out=np.zeros_like(raw[:, 1]), where=raw[:, 1] > 0)
        return cls(bits, share.astype(np.float32), raw[:, 0].astype(np.float32), np.log(target[:, 0] + smoothing).astype(np.float32), smoothing)

    def __call__(self, text: bytes) -> float:
        total = 0.0
        for k, n in enumerate(_ORDERS):
            for context, gram in blocks(text, n, self.bits):
                total += float((np.log(self.share[k][gram] * self.raw[k][context] + np.float32(self.smoothing)) - self.known[k][context]).sum(dtype=np.float64))
        return total


def with_log_weight(docs: DataFrame, ratio: Ratio, text_col: str, keep_text: bool = True) -> DataFrame:
    """docs with the column log_weight; NULL for a null or empty text."""
    return map_text(docs, text_col, "log_weight double", lambda texts: [pa.array([ratio(t) if t else None for t in each_as_bytes(texts)], pa.float64())], keep_text)


def _labelled(labels: DataFrame, id_col: str, n: int) -> DataFrame:
    """At most n labelled ids, a bounded table."""
    ids = labels.select(F.col(quoted(id_col)).alias("_id")).where("_id IS NOT NULL").distinct()
    return ids.orderBy(F.xxhash64("_id"), "_id").limit(n)


def fit(docs: DataFrame, good: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 18, smoothing: float = 50.0, labelled: int = 10_000) -> Ratio:
    """The models of the target and of the raw text."""
    text = docs.select(F.col(quoted(id_col)).alias("_id"), F.col(quoted(text_col)).alias("_text"))
    target = bucket_counts(text.join(F.broadcast(_labelled(good, id_col, labelled)), "_id", "left_semi"), "_text", bits)
    return Ratio.of(target, bucket_counts(docs, text_col, bits), bits, smoothing)


def good_share(good: DataFrame, bad: DataFrame, id_col: str) -> float:
    """The share of good ids among the labelled ones; 1 without any."""
    n, m = (x.select(F.count_distinct(F.col(quoted(id_col)))).first()[0] for x in (good, bad))
    return n / (n + m) if n else 1.0


def kth_largest(values: DataFrame, k: int, bins: int = 1024) -> float:
    """The k-th largest of the column v, by counting in ever finer bins."""
    low, high, n = values.agg(F.min("v"), F.max("v"), F.count("v")).first()
    if not n or k <= 0:
        return float("inf")
    if k >= n:
        return low
    above = 0
    while True:
        inside = values.where(F.col("v").between(low, high))
        width = (high - low) / bins
        if width <= 0 or low + width == low:
            return low
        at = F.least(F.lit(bins - 1), F.floor((F.col("v") - F.lit(low)) / F.lit(width)))
        found = {r.b: r for r in inside.groupBy(at.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()}
        for b in sorted(found, reverse=True):
            if above + found[b].n >= k:
                break
            above += found[b].n
        if found[b].lo == found[b].hi or (low, high) == (found[b].lo, found[b].hi):
            return found[b].lo
        low, high = found[b].lo, found[b].hi


def _draw(docs: DataFrame, good: DataFrame, bad: DataFrame, id_col: str, text_col: str, k: int | None, share: float | None, seed: int, keep_text: bool, **settings) -> DataFrame:
    """(row, text, log_weight, gumbel_key, kept), row without the text; texts are scored once, into a table in the shared folder."""
    ratio = fit(docs, good, id_col, text_col, **settings)
    fields = [F.col(quoted(c)) for c in docs.columns if c != text_col]
    uniform = (F.shiftrightunsigned(F.xxhash64(F.col(quoted(id_col)), F.col(quoted(text_col)), F.lit(seed)), 11) + 0.5) / float(1 << 53)
    rows = docs.select(F.struct(*fields).alias("row"), F.col(quoted(text_col)).alias("text"), (-F.log(-F.log(uniform))).alias("noise"))
    scored = with_log_weight(rows, ratio, "text", keep_text)
    scored = scored.select("row", *["text"] * keep_text, "log_weight", (F.col("log_weight") + F.col("noise")).alias("gumbel_key"))
    scored = materialize(scored)
    keys = scored.select(F.col("gumbel_key").alias("v")).where("v IS NOT NULL")
    if k is None:
        k = round(keys.count() * (good_share(good, bad, id_col) if share is None else share))
    return scored.withColumn("kept", F.coalesce(F.col("gumbel_key") >= F.lit(kth_largest(keys, k)), F.lit(False)))


def _columns(made: DataFrame, docs: DataFrame, text_col: str, *added: str) -> DataFrame:
    """The columns of docs in their order, and those added, from what `_draw` gives."""
    own = [F.col("text").alias(c) if c == text_col else F.col(f"row.{quoted(c)}") for c in docs.columns if c not in added and (c != text_col or "text" in made.columns)]
    return made.select(*own, *added)


def resample(docs: DataFrame, good: DataFrame, bad: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int | None = None, share: float | None = None, seed: int = 42, keep_text: bool = True, **settings) -> DataFrame:
    """docs with the columns log_weight, gumbel_key and kept added. `good` and `bad` hold labelled ids; the bad ones only tell the share."""
    made = _draw(docs, good, bad, id_col, text_col, k, share, seed, keep_text, **settings)
    return _columns(made, docs, text_col, "log_weight", "gumbel_key", "kept")


def by_labels(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    return resample(docs, labels.where("quality = 1"), labels.where("quality = 0"), **settings)


def drawn(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are drawn, with their own columns."""
    made = _draw(docs, labels.where("quality = 1"), labels.where("quality = 0"), "doc_id", "text", None, None, 42, True)
    return _columns(made.where("kept"), docs, "text")


def op2(spark, sf_dir: str) -> DataFrame:
    from tessera.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return by_labels(docs, table(spark, sf_dir, "labels"), keep_text=False).select("doc_id", "log_weight", "gumbel_key", "kept")
