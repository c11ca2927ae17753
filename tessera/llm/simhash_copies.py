"""Near copies above a shingle similarity, by wide SimHash fingerprints and verified links.

At a Jaccard similarity of 0.8 two 64-bit fingerprints differ in about ten bits, too near to what unrelated
texts reach by chance in a large corpus. So this variant takes two independent 64-bit halves (128 bits), and a
radius that a pair at the wanted similarity exceeds about once in 200 times. Three steps:

1. Classes (equal fingerprint and number of distinct shingles) are tiled by that number: sets at similarity s have
   sizes within a factor s of each other, so only tiles of the same or the next size step meet. Within two tiles,
   rows stand by population count, and blocks whose counts differ beyond the radius are skipped; the rest
   is compared with exclusive-or and bit counts. Each pair of tiles gives a spanning forest of its links.
2. The components of these links are families: nothing outside a family can be linked.
3. Within families, tiles meet again with the bottom-k sketches of their shingle sets (k smallest hashes; exact for sets of at
   most k shingles, else with a standard error of about 0.025). Pairs within the radius whose estimated similarity
   reaches the bound are linked, nearest first; pairs that are connected already need no check. Again each
   pair of tiles gives a spanning forest, so a dense group of copies costs no more links than members.

A null or empty text has no shingles; all such texts are copies of each other. A text of fewer words than a shingle is one
shingle. Of each group the row with the smallest id stays (null ids last); of identical rows one. Extra columns stay, whatever their names.
An empty table gives an empty one. Long texts are hashed whole, one at a time.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import as_bytes, connected_components, materialize, quoted, slices, unwrapped, words_ascii_lower

_SEED = 42


def radius_for(similarity: float, bits: int = 128, deviations: float = 2.6) -> int:
    """Differing bits that pairs at the similarity seldom exceed: the expected number (the angle between
    two sets' indicator vectors) and some standard deviations."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(bits * p + deviations * math.sqrt(bits * p * (1 - p)))


def _majority(hashes: np.ndarray) -> np.ndarray:
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 14):
        counts += np.unpackbits(hashes[i : i + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > len(hashes)).view(">u8").astype(np.uint64)[0]


def profile(text: bytes, shingle: int, k: int) -> tuple[int, int, int, bytes]:
    """Both halves of the fingerprint, the number of distinct shingles and their sketch."""
    words = words_ascii_lower(text)
    if not words:
        return 0, 0, 0, b""
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= shingle:
        raw = [digest(joined, _SEED)]
    else:
        ends = list(itertools.accumulate(len(w) + 1 for w in words))
        raw = [digest(joined[a : b - 1], _SEED) for a, b in zip([0, *ends], ends[shingle - 1 :])]
    hashes = np.unique(np.array(raw, dtype=np.uint64))
    # The second half: the same hashes through a full-width mixer.
    other = hashes ^ (hashes >> np.uint64(33))
    other = other * np.uint64(0xFF51AFD7ED558CCD)
    other ^= other >> np.uint64(33)
    return int(_majority(hashes)), int(_majority(other)), len(hashes), (hashes[:k] >> np.uint64(32)).astype("<u4").tobytes()


def profiles(docs: DataFrame, key: str, text_col: str, shingle: int, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 2)):
            a, b, n, sketch = zip(*[profile(t, shingle, k) for t in as_bytes(batch.column(2))])
            halves = [pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (a, b)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *halves, pa.array(n, pa.int32()), pa.array(sketch, pa.binary())], ["key", "id", "a", "b", "n", "sketch"])

    rows = docs.select(key, "id", F.col(text_col).cast("string"))
    return rows.mapInArrow(run, f"key long, id {dict(rows.dtypes)['id']}, a long, b long, n int, sketch binary")


class _Forest:
    """Union-find over the rows of one or two tiles; keeps the links that joined something."""

    def __init__(self, n: int) -> None:
        self.parent, self.left, self.right = list(range(n)), [], []
        self.label = np.arange(n)

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return self.label[i] != self.label[j]

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        for x, y in zip(i.tolist(), j.tolist()):
            rx, ry = self.root(x), self.root(y)
            if rx != ry:
                self.parent[ry] = rx
                self.left.append(x)
                self.right.append(y)
        self.label = np.array([self.root(x) for x in range(len(self.parent))])


def similar(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, k: int) -> np.ndarray:
    """Estimated Jaccard similarities of pairs of sketches (rows of k sorted hashes, padded with the greatest)."""
    pad = np.iinfo(np.uint32).max
    both = np.sort(np.concatenate([x, y], axis=1), axis=1)
    fresh = np.concatenate([np.ones((len(both), 1), bool), both[:, 1:] != both[:, :-1]], axis=1) & (both != pad)
    rank = np.cumsum(fresh, axis=1)
    # Of the union's k smallest hashes (all, where both sets are whole), how many are in both?
    whole = (nx <= k) & (ny <= k)
    size = np.where(whole, rank[:, -1], np.minimum(k, rank[:, -1]))
    twice = np.concatenate([np.zeros((len(both), 1), bool), both[:, 1:] == both[:, :-1]], axis=1) & (both != pad)
    return (twice & (rank <= size[:, None])).sum(axis=1) / np.maximum(1, size)


def _links(tile_a: tuple, tile_b: tuple, same: bool, radius: int, similarity: float | None, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links of two tiles (fingerprint halves, sizes, sketches), by row numbers."""
    (a1, a2, an, asx), (b1, b2, bn, bsx) = tile_a, tile_b
    forest, shift = _Forest(len(a1) if same else len(a1) + len(b1)), 0 if same else len(a1)
    pops_a, pops_b = (np.bitwise_count(x).astype(np.int64) + np.bitwise_count(y) for x, y in ((a1, a2), (b1, b2)))
    order_a, order_b = np.argsort(pops_a, kind="stable"), np.argsort(pops_b, kind="stable")
    pops_b = pops_b[order_b]
    o1, o2 = b1[order_b], b2[order_b]
    step = max(1, (1 << 18) // max(1, len(b1)))
    for at in range(0, len(order_a), step):
        rows = order_a[at : at + step]
        low, high = np.searchsorted(pops_b, pops_a[rows[0]] - radius), np.searchsorted(pops_b, pops_a[rows[-1]] + radius, "right")
        if low >= high:
            continue
        far = np.bitwise_count(a1[rows, None] ^ o1[None, low:high]) + np.bitwise_count(a2[rows, None] ^ o2[None, low:high])
        i, j = np.nonzero(far <= radius)
        far = far[i, j]
        i, j = rows[i], order_b[j + low]
        keep = forest.apart(i, j + shift)
        if similarity is not None:
            small, large = np.minimum(an[i], bn[j]), np.maximum(an[i], bn[j])
            keep &= small >= similarity * large
        i, j, far = i[keep], j[keep], far[keep]
        if similarity is None:
            forest.join(i, j + shift)
            continue
        order = np.argsort(far, kind="stable")
        i, j = i[order], j[order]
        while len(i):
            x, y = i[:2000], j[:2000]
            hit = similar(asx[x], bsx[y], an[x], bn[y], k) >= similarity
            forest.join(x[hit], y[hit] + shift)
            i, j = i[2000:], j[2000:]
            keep = forest.apart(i, j + shift)
            i, j = i[keep], j[keep]
    return np.array(forest.left, dtype=np.int64), np.array(forest.right, dtype=np.int64) - shift


def _tile_links(classes: DataFrame, group: str | None, radius: int, similarity: float, tile_rows: int, k: int, verify: bool) -> DataFrame:
    """Links (a, b) between class numbers `cid` of the same group (all, if none) by tiles of size steps."""
    columns = ["cid", "a", "b", "n", *["sketch"] * verify]
    level = F.when(F.col("n") <= 0, -1).otherwise(F.floor(F.log("n") / math.log(1 / similarity) + 1e-9)).cast("int")
    rows = classes.withColumn("level", level).withColumn("grp", F.col(group) if group else F.lit(0).cast("long"))
    sizes = rows.groupBy("grp", "level").agg(F.ceil(F.count(F.lit(1)) / tile_rows).cast("int").alias("tiles"))
    # Without groups there are only as many sizes as size steps; with them the join may be large, and a large group's
    # rows must leave its partition again, tile by tile.
    rows = rows.join(sizes if group else F.broadcast(sizes), ["grp", "level"]).withColumn("tile", F.expr("cast(pmod(hash(cid, 3), tiles) as int)"))
    rows = rows.repartition("grp", "level", "tile") if group else rows
    tiles = materialize(rows.groupBy("grp", "level", "tile").agg(F.collect_list(F.struct(*columns)).alias("rows")))
    # A tile meets those of its own size step with a number not below its own, and all of the next step.
    own = sizes.select("grp", F.col("level").alias("meets"), F.col("tiles"))
    left = tiles.select("grp", F.col("level").alias("from_level"), F.col("tile").alias("from_tile"), F.col("rows").alias("from_rows"), F.explode(F.array("level", F.col("level") + 1)).alias("meets"))
    left = left.join(own, ["grp", "meets"]).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).where("from_level <> meets or from_tile <= other")
    right = tiles.select("grp", F.col("level").alias("meets"), F.col("tile").alias("other"), F.col("rows"))
    pairs = left.join(right, ["grp", "meets", "other"]).select(F.expr("from_level = meets and from_tile = other").alias("same"), "from_rows", "rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                one = batch.slice(r, 1)
                both = []
                for c in (1, 2):
                    v = one.column(c).flatten()
                    num = [v.field(x).to_numpy(zero_copy_only=False) for x in ("cid", "a", "b", "n")]
                    sketch = None
                    if verify:
                        sketch = np.full((len(num[0]), k), np.iinfo(np.uint32).max, dtype=np.uint32)
                        for at, s in enumerate(v.field("sketch").to_pylist()):
                            sketch[at, : len(s) // 4] = np.frombuffer(s, "<u4")
                    both.append((num[0], (num[1].view(np.uint64), num[2].view(np.uint64), num[3].astype(np.int64), sketch)))
                i, j = _links(both[0][1], both[1][1], one.column(0)[0].as_py(), radius, similarity if verify else None, k)
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(both[0][0][i]), pa.array(both[1][0][j])], ["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, sketch: int = 256, tile_rows: int = 4096) -> DataFrame:
    """(key, keeps): a key for each different row (id and text), and whether it is its group's one to stay."""
    rows = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"), row_key(id_col, text_col).alias("key"))
    made = materialize(profiles(rows, "key", "text", shingle, sketch))
    made = made.withColumn("cid", F.xxhash64("a", "b", "n"))
    radius = radius_for(similarity)
    classes = materialize(made.groupBy("cid").agg(F.min("a").alias("a"), F.min("b").alias("b"), F.min("n").alias("n"), F.min("sketch").alias("sketch")))
    families = connected_components(_tile_links(classes, None, radius, similarity, tile_rows, sketch, verify=False))
    kin = classes.join(families.withColumnRenamed("node", "cid"), "cid")
    groups = connected_components(_tile_links(kin, "component", radius, similarity, tile_rows // 16, sketch, verify=True))
    member = made.select("key", "id", "cid").join(groups.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    best = member.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("best"))
    return best.select(F.col("best.key").alias("key"))


def row_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(quoted(id_col)), F.col(quoted(text_col)))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """docs with one row of each group of near copies."""
    rows = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"), row_key(id_col, text_col).alias("key"))
    left = rows.join(copies(docs, id_col, text_col, **settings).distinct(), "key", "left_semi")
    # Identical rows have one key; the join has them in one partition already.
    return unwrapped(left.dropDuplicates(["key"]).drop("key"))
