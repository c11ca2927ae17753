"""Mixing overlapping sources to target weights by min-cost flow.

Documents with the same set of sources form one membership pattern. Only the patterns' total sizes
reach the driver (at most `max_patterns`, some hundred megabytes), where token capacity is routed from patterns to source quotas; sources that share no
document with others need no routing, and their quota is met from their own documents.
A pattern can be passed `repeats` times; each further pass costs more (a convex cost), so the flow
repeats as little as it can. Which documents the last, partial pass takes is decided on the cluster: documents
stand in the order of a seeded hash, and a radix search over its bits finds, by small counts,
where the quota ends. The document there is taken in part, so that each quota is met to the word.

Null and empty texts have size 0 and are never taken. A null source is a source of its own, last in order. Repeated rows count each
time; where the cut falls on rows that are the same, they share it evenly. A document's `taken` never
exceeds `repeats` times its size. Reruns agree, whatever the partitioning. An empty table gives an empty one. Texts of any length are only
counted. Extra columns stay, whatever their names; mix_size and mix_taken are replaced.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, quoted, unwrapped

_STEP = 10  # bits of the hash that each round of the radix search looks at


def word_count(text: Column) -> Column:
    """Words between ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")


def targets(sizes: dict, weights: Sequence[float] = (5, 2, 1), repeats: int = 3, total: int | None = None) -> dict:
    """Words for each source: `total` (all sizes) by weight, in the sources' order (None last), none above
    `repeats` times the source's size; what is above is shared again by weight."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = dict(zip(names, itertools.cycle(weights)))
    total = sum(sizes.values()) if total is None else total
    fixed: dict = {}
    while True:
        free = [s for s in names if s not in fixed]
        left, by = total - sum(fixed.values()), sum(weight[s] for s in free)
        share = {s: left * weight[s] / by for s in free}
        over = [s for s in free if share[s] > repeats * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: float(repeats * sizes[s]) for s in over}


def route(patterns: dict[tuple, int], quotas: dict, repeats: int = 3) -> dict[tuple, int]:
    """Words to take of each pattern: a maximal flow to the quotas with the least repetition.

    Successive shortest paths over source -> pattern (an arc for each pass, at cost 0, 1, 2, ...) -> the pattern's sources -> sink.
    """
    names = list(patterns)
    place = {p: i + 1 for i, p in enumerate(names)}
    place |= {("source", s): len(names) + 1 + i for i, s in enumerate(quotas)}
    sink = len(place) + 1
    arcs: list[list[int]] = []  # to, capacity, cost; an arc's reverse is its neighbour
    out: list[list[int]] = [[] for _ in range(sink + 1)]

    def arc(a: int, b: int, cap: int, cost: int) -> None:
        for x, y, c, w in ((a, b, cap, cost), (b, a, 0, -cost)):
            out[x].append(len(arcs))
            arcs.append([y, c, w])

    for p in names:
        for k in range(repeats):
            arc(0, place[p], patterns[p], k)
        for s in p:
            arc(place[p], place["source", s], repeats * patterns[p], 0)
    for s, q in quotas.items():
        arc(place["source", s], sink, q, 0)
    while True:
        dist, via, queue = {0: 0}, {}, [0]
        while queue:
            nxt = []
            for x in queue:
                for e in out[x]:
                    y, cap, cost = arcs[e]
                    if cap > 0 and dist[x] + cost < dist.get(y, float("inf")):
                        dist[y], via[y] = dist[x] + cost, e
                        nxt.append(y)
            queue = nxt
        if sink not in dist:
            break
        path, x = [], sink
        while x:
            path.append(via[x])
            x = arcs[via[x] ^ 1][0]
        push = min(arcs[e][1] for e in path)
        for e in path:
            arcs[e][1] -= push
            arcs[e ^ 1][1] += push
    return {p: sum(arcs[e][1] for e in out[place[p]] if arcs[e][0] == 0) for p in names}


def _cuts(rows: DataFrame, rest: dict[str, int]) -> dict[str, tuple[int, int]]:
    """For each pattern the hash at which its rest of words ends, and the words to take there."""
    spark, done, at = rows.sparkSession, {}, {p: (0, n) for p, n in rest.items()}
    for shift in range(63 - _STEP, -_STEP, -_STEP):
        width = min(_STEP, _STEP + shift)
        shift = max(0, shift)
        if not at:
            break
        open_ = spark.createDataFrame([(p, prefix) for p, (prefix, _) in at.items()], "pattern string, prefix long")
        inside = rows.join(F.broadcast(open_), "pattern").where(F.shiftright("order", shift + width) == F.col("prefix"))
        # At most 2^_STEP buckets for each pattern.
        sums: dict[str, dict] = {}
        for r in inside.groupBy("pattern", F.shiftright("order", shift).alias("b")).agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n"), F.min("order").alias("lo"), F.max("order").alias("hi")).collect():
            sums.setdefault(r.pattern, {})[r.b] = r
        following = {}
        for p, (_, left) in at.items():
            for b in sorted(sums[p]):
                r = sums[p][b]
                if r.s >= left:
                    if r.lo == r.hi:
                        done[p] = (r.lo, left // r.n)
                    else:
                        following[p] = (b, left)
                    break
                left -= r.s
        at = following
    return done


def mix(docs: DataFrame, members: Column, id_col: str = "doc_id", text_col: str = "text", weights: Sequence[float] = (5, 2, 1), repeats: int = 3, seed: int = 42, max_patterns: int = 1_000_000):
    """The documents' columns with `mix_size` and `mix_taken` added, and each source's (size, target).

    `members` is an array column: the sources to which a document belongs.
    """
    spark = docs.sparkSession
    size = word_count(F.col(quoted(text_col)).cast("string")).alias("size")
    pattern = F.to_json(F.array_sort(F.array_distinct(members)), {"ignoreNullFields": "false"}).alias("pattern")
    order = F.shiftrightunsigned(F.xxhash64(F.col(quoted(id_col)), F.col(quoted(text_col)), F.lit(seed)), 1).alias("order")
    rows = materialize(docs.select(pattern, size, order))
    found = rows.groupBy("pattern").agg(F.sum("size").alias("size")).limit(max_patterns + 1).collect()
    if len(found) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    patterns = {tuple(json.loads(r.pattern)): r.size for r in found}
    sizes: dict = {}
    for p, n in patterns.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    wanted = targets(sizes, weights, repeats, sum(patterns.values()))
    # A source that shares no document with another needs no flow: it gives what it has, up to its quota.
    shared = {s for p in patterns if len(p) > 1 for s in p}
    quotas = {s: round(t) for s, t in wanted.items()}
    taken = {p: min(quotas[p[0]], repeats * n) if p else 0 for p, n in patterns.items() if not shared.intersection(p)}
    taken |= route({p: n for p, n in patterns.items() if p not in taken}, {s: q for s, q in quotas.items() if s in shared}, repeats)
    rest = {}
    plan = []
    for r in found:
        full, left = divmod(taken[tuple(json.loads(r.pattern))], r.size) if r.size else (0, 0)
        plan.append([r.pattern, full])
        if left:
            rest[r.pattern] = left
    cuts = _cuts(rows, rest)
    plan = [(p, full, *cuts.get(p, (-1, 0))) for p, full in plan]
    plan = spark.createDataFrame(plan, "pattern string, full long, cut long, part long")
    plan = F.broadcast(plan.select(F.col("pattern").alias("mix_pattern"), F.col("full").alias("mix_full"), F.col("cut").alias("mix_cut"), F.col("part").alias("mix_part")))
    made = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"), pattern.alias("mix_pattern"), size.alias("mix_size"), order.alias("mix_order")).join(plan, "mix_pattern")
    last = F.when(F.col("mix_order") < F.col("mix_cut"), F.col("mix_size")).when(F.col("mix_order") == F.col("mix_cut"), F.least("mix_size", "mix_part")).otherwise(0)
    made = unwrapped(made, mix_size=F.col("mix_size"), mix_taken=F.col("mix_full") * F.col("mix_size") + last)
    return made, {s: (sizes[s], float(wanted[s])) for s in sizes}


def op8(spark, sf_dir: str) -> DataFrame:
    from tessera.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    made, sources = mix(docs, F.array("source"))
    info = spark.createDataFrame([(s, *x) for s, x in sources.items()], "mix_source string, source_size long, target double")
    out = made.join(F.broadcast(info), F.col("source").eqNullSafe(F.col("mix_source")))
    return out.select("doc_id", F.col("mix_size").alias("size"), "source_size", "target", F.col("mix_taken").alias("taken"))
