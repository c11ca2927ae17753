"""Near-duplicates against brute force."""

import random

import xxhash

from tessera.llm import simhash, simhash_copies
from tests.llm.conftest import words


def plain_fingerprint(text, n=3):
    w = [x for x in (text or "").encode().lower().split()]
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))]
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(keys, linked):
    parent = {k: k for k in keys}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    keys = list(keys)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if linked(a, b):
                parent[root(a)] = root(b)
    return {k: root(k) for k in keys}


def test_fingerprints_and_components(docs):
    got = simhash.near_duplicates(docs).collect()
    rows = docs.collect()
    assert len(got) == len(rows)
    prints = sorted((r.doc_id if r.doc_id is not None else -1, plain_fingerprint(r.text)) for r in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.fp % (1 << 64)) for r in got) == prints
    groups = components({p for _, p in prints}, lambda a, b: (a ^ b).bit_count() <= 3)
    low = {}
    for i, p in prints:
        if i >= 0:
            low[groups[p]] = min(low.get(groups[p], i), i)
    for r in got:
        assert r.component_id == low.get(groups[r.fp % (1 << 64)])


def test_chains_of_links_across_cells_and_tiles(spark):
    rng = random.Random(9)
    values = {rng.getrandbits(64) for _ in range(300)}
    x = rng.getrandbits(64)
    for _ in range(60):  # a chain, three bits a step
        values.add(x)
        for b in rng.sample(range(64), 3):
            x ^= 1 << b
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    classes = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    links = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.link_fingerprints(classes, tile_rows=8).collect()]
    assert all(0 < (a ^ b).bit_count() <= 3 for a, b in links)
    want = components(values, lambda a, b: (a ^ b).bit_count() <= 3)
    found = components(values, lambda a, b, s=set(links): (a, b) in s or (b, a) in s)
    same = lambda m: sorted(sorted(k for k in m if m[k] == r) for r in set(m.values()))
    assert same(want) == same(found)


def test_empty_table(no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0
    assert simhash_copies.drop_copies(no_docs).count() == 0


def shingles(text, n=5):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_one_of_each_group_of_copies_stays(spark):
    rng = random.Random(2)
    rows, i = [], 0
    for _ in range(12):
        base = words(rng, 250).split(" ")
        for edits in (0, 0, 1, 3, 5, 60):
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(250)] = words(rng, 1)
            rows.append((i, " ".join(w)))
            i += 1
    rows += [(500, None), (501, ""), (502, "short"), (503, "SHORT"), (503, "SHORT"), (None, "alone with no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = sorted((r.doc_id if r.doc_id is not None else -1) for r in simhash_copies.drop_copies(df, tile_rows=16).collect())
    sets = {k: shingles(t) for k, (_, t) in enumerate(rows)}
    groups = components(sets, lambda a, b: similarity(sets[a], sets[b]) >= 0.8)
    best = {}
    for k, (d, _) in enumerate(rows):
        best[groups[k]] = min(best.get(groups[k], (True, 0)), (d is None, d if d is not None else -1))
    want = sorted(d for _, d in best.values())
    assert abs(len(kept) - len(want)) <= 1 and len(set(kept) ^ set(want)) <= 2
