"""SimHash near-duplicates: exact tiled comparison of 64-bit fingerprints.

A fingerprint is the majority of the XXH64 bits (seed 42) of a text's word shingles. Equal
fingerprints form one class, so exact copies are never compared with each other. Classes are
grouped into cells by the population counts of the four 16-bit quarters; two fingerprints within
the radius lie in cells whose counts differ by at most the radius in total, so only such cells
meet. A cell is split into tiles of bounded size; a pair of tiles is compared in full with
exclusive-or and bit counts, and gives a spanning forest of its links, not all of them: the
components are the same and a dense group of near copies costs no more than its nodes.

Nulls and empty texts have no words: their fingerprint is zero and links like any other. A null
id is kept as a row and never becomes a component id while another id is in reach. Repeated rows
stay repeated. Equal distances need no rule: components don't depend on the order of links. Extra columns are not read; an empty
table gives an empty one. A long text is hashed whole, its bits summed in blocks.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import as_bytes, connected_components, materialize, slices, words_ascii_lower

_SEED = 42
_QUARTERS = 4


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Fingerprint of UTF-8 text as an unsigned number."""
    words = words_ascii_lower(text)
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), _SEED)
    joined = b" ".join(words)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    digest, last = xxhash.xxh64_intdigest, shingle - 1
    hashes = np.array([digest(joined[a : b - 1], _SEED) for a, b in zip(starts, ends[last:])], dtype=">u8")
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 14):
        counts += np.unpackbits(hashes[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id_col, fp): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            made = np.array([fingerprint(t, shingle) for t in as_bytes(batch.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], ["id", "fp"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(source.dtypes)["id"]
    return source.mapInArrow(run, f"id {kind}, fp long").withColumnRenamed("id", id_col)


def _forest(a: np.ndarray, b: np.ndarray, same: bool, radius: int) -> tuple[list[int], list[int]]:
    """A spanning forest of the links between two tiles (or within one)."""
    parent = list(range(len(a) if same else len(a) + len(b)))
    shift = 0 if same else len(a)
    out_a: list[int] = []
    out_b: list[int] = []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    label = np.arange(len(parent))
    step = max(1, (1 << 18) // max(1, len(b)))
    for at in range(0, len(a), step):
        near = np.bitwise_count(a[at : at + step, None] ^ b[None, :]) <= radius
        i, j = np.nonzero(near)
        i = i + at
        if same:
            keep = i < j
            i, j = i[keep], j[keep]
        left, right = label[i], label[j + shift]
        keep = left != right
        if not keep.any():
            continue
        for x, y in zip(i[keep].tolist(), j[keep].tolist()):
            rx, ry = root(x), root(y + shift)
            if rx != ry:
                parent[ry] = rx
                out_a.append(x)
                out_b.append(y)
        label = np.array([root(x) for x in range(len(parent))])
    return out_a, out_b


def link_fingerprints(classes: DataFrame, radius: int = 3, tile_rows: int = 2048) -> DataFrame:
    """Links (a, b) between distinct fingerprints fp, enough to connect all within the radius."""
    quarter = [F.bit_count(F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF))) for k in range(_QUARTERS)]
    # A margin of `radius` around the counts keeps cell numbers unique after an offset is added.
    width = 17 + 2 * radius
    weight = [width**k for k in range(_QUARTERS)]
    cell = sum((q.cast("long") + radius) * w for q, w in zip(quarter, weight))
    cells = classes.select("fp", cell.alias("cell"))
    # At most 17^4 cells exist, so their sizes are a small table whatever the input.
    sizes = materialize(cells.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / tile_rows).cast("int").alias("tiles")))
    tiles = cells.join(F.broadcast(sizes), "cell").withColumn("tile", F.expr("pmod(hash(fp, 7), tiles)")).groupBy("cell", "tile").agg(F.collect_list("fp").alias("fps"))
    tiles = materialize(tiles)
    offsets = [
        sum(d * w for d, w in zip(v, weight))
        for v in itertools.product(range(-radius, radius + 1), repeat=_QUARTERS)
        if sum(map(abs, v)) <= radius and (v == (0,) * _QUARTERS or next(d for d in v if d) > 0)
    ]
    # A tile meets those of its own cell with a number not below its own, and all of the cells around. Pairs are dealt by cell and
    # tile, so the fullest cell's comparisons are spread as well.
    left = tiles.select(F.col("cell").alias("own"), F.col("tile").alias("own_tile"), F.col("fps").alias("own_fps"), F.explode(F.array(*[F.col("cell") + F.lit(o) for o in offsets])).alias("cell"))
    left = left.join(F.broadcast(sizes), "cell").withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).where("own != cell or own_tile <= tile")
    pairs = left.join(tiles, ["cell", "tile"])
    pairs = pairs.select(F.expr("own = cell and own_tile = tile").alias("same"), "own_fps", "fps")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found_a, found_b = [], []
            left_at, right_at = batch.column(1).offsets.to_numpy(), batch.column(2).offsets.to_numpy()
            left_all = batch.column(1).values.to_numpy(zero_copy_only=False).view(np.uint64)
            right_all = batch.column(2).values.to_numpy(zero_copy_only=False).view(np.uint64)
            for k, same in enumerate(batch.column(0).to_pylist()):
                a, b = left_all[left_at[k] : left_at[k + 1]], right_all[right_at[k] : right_at[k + 1]]
                i, j = _forest(a, b, same, radius)
                if i:
                    found_a.append(a[i])
                    found_b.append(b[j])
            if found_a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (found_a, found_b)], ["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """(id_col, fp, component_id): component_id is the smallest id among the texts that links of at
    most `radius` differing bits reach, the text's own id included."""
    prints = materialize(fingerprints(docs, id_col, text_col, shingle))
    classes = prints.groupBy("fp").agg(F.min(id_col).alias("low"))
    linked = connected_components(link_fingerprints(classes, radius))
    members = classes.join(linked, classes.fp == linked.node, "left").select("fp", "low", F.coalesce("component", "fp").alias("component"))
    members = materialize(members)
    lows = members.groupBy("component").agg(F.min("low").alias("component_id"))
    # Only classes that some link touches need the join; the component of the rest is their own.
    whole = members.join(lows, "component").select(F.col("fp"), "component_id")
    return prints.join(whole, "fp").select(id_col, "fp", "component_id")


def op6(spark, sf_dir: str) -> DataFrame:
    from tessera.llm.common import table

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
