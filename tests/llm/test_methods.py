"""The dealt methods against plain versions: spans, randomness battery and false discoveries, features and labels, weights and
draw, profiles, flows and cuts, class scores, pruning counts and bit codes."""

import collections
import itertools
import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann, brown, language_id, mixing, pii, quality, secrets, spans, topk
from tests.llm.conftest import words

# Spans


def test_many_matches_in_one_text_take_seconds(spark):
    text = "é" + "token=abcdef1234 mail a@b.cd, " * 50_000
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    began = time.time()
    found = secrets.scan(df).select("secret_spans").first().secret_spans
    assert [(s.start, s.end) for s in found] == [m.span() for m in re.finditer("token=abcdef1234", text)]
    assert pii.detect(df).select(F.size("base_spans")).first()[0] == 50_000
    masked = secrets.redact(df).first().text
    assert masked == text.replace("token=abcdef1234", "[SECRET]")
    assert pii.redact(df).first().text == text.replace("a@b.cd", "[PII]")
    assert time.time() - began < 100


def test_masks_of_overlapping_and_touching_spans(spark):
    rng = random.Random(0)
    rows = []
    for k in range(60):
        text = "".join(rng.choice("ab😀é﻿ ") for _ in range(rng.randint(0, 30)))
        some = sorted((a, b) for a, b in (sorted(rng.sample(range(len(text) + 1), 2)) for _ in range(rng.randint(0, 5) if len(text) > 1 else 0)))
        rows.append((k, text, some))

    def plain(text, some):
        out, at = "", 0
        for i, (a, b) in enumerate(some):
            if i == 0 or a > at:
                out += text[at:a] + "#"
            at = max(at, b)
        return out + text[at:]

    df = spark.createDataFrame(rows, "k int, t string, s array<struct<start:int,end:int>>")
    got = {r.k: r.m for r in df.select("k", spans.masked(F.col("t"), F.col("s"), "#").alias("m")).collect()}
    assert got == {k: plain(t, s) for k, t, s in rows}


# Secrets


def upper(z):
    return 0.5 * math.erfc(z / 2**0.5)


def plain_p(token, fit=0.001):
    body = token.rstrip("=")
    alpha = next(a for r, a in secrets.ENCODINGS if re.search(r, body))
    n, a = len(body), len(alpha)
    v = [alpha.index(c) for c in body]
    squares = lambda s: sum(k * k for k in collections.Counter(s).values())
    chi = squares(body) * a / n - n
    ps = [upper((chi - (a - 1)) / math.sqrt(2 * (a - 1) * (n - 1) / n))]
    high = sum(x >= a / 2 for x in v)
    both = 2 * high * (n - high)
    runs = 1 + sum((x >= a / 2) != (y >= a / 2) for x, y in zip(v, v[1:]))
    sd = math.sqrt(max(1e-9, both * (both - n) / (n * n * (n - 1))))
    ps.append(1e-20 if both <= n else 2 * upper(abs(runs - 1 - both / n) / sd))
    mean = sum(v) / n
    var = sum((x - mean) ** 2 for x in v)
    ps.append(1e-20 if var <= 0 else 2 * upper(abs(math.sqrt(n) * sum((x - mean) * (y - mean) for x, y in zip(v, v[1:])) / max(var, 1e-9))))
    if 3 * min(ps) < fit:
        return 1.0
    c2, c3, s0 = secrets.COINCIDENCE, secrets.TRIPLES, secrets.SWITCHES
    pairs = n * (n - 1) / 2
    rare = (pairs * c2 - (squares(body.lower()) - n) / 2) / math.sqrt(pairs * (c2 - c2**2) + pairs * (n - 2) * 2 * (c3 - c2**2))
    kind = lambda c: "A" if c.isupper() else "a" if c.islower() else "0" if c.isdigit() else "-"
    kinds = [kind(c) for c in body]
    if len(set(kinds)) == 1 and kinds[0] in "Aa":
        return upper(rare)
    changes = sum(x != y for x, y in zip(kinds, kinds[1:]))
    return upper((rare + (changes - (n - 1) * s0) / math.sqrt((n - 1) * s0 * (1 - s0))) / 2**0.5)


def some_tokens(rng, n):
    alphabets = [a for _, a in secrets.ENCODINGS]
    vocabulary = "the internationalization vaccination programme get element by tag name service account configuration manager request handler session".split()
    secret = ["".join(rng.choice(a) for _ in range(rng.choice([24, 32, 40, 64]))) for a in (rng.choice(alphabets[8:11]) for _ in range(n))]
    plain = []
    for _ in range(4 * n):
        parts = [rng.choice(vocabulary) for _ in range(rng.randint(3, 6))]
        style = rng.randrange(4)
        t = "".join(p.title() for p in parts) if style == 0 else "_".join(parts) if style == 1 else "-".join(parts) + str(rng.randrange(10_000)) if style == 2 else "/".join(parts)
        if len(t) >= 20:
            plain.append(t)
    return [t for t in secret if re.search("[A-Za-z]", t)], plain


def test_battery_equals_a_plain_version(spark):
    secret, plain = some_tokens(random.Random(1), 40)
    tokens = [t for t in secret + plain + ["a" * 30, "internationalization1", "COVID19vaccinationProgramme2021", "Ab1" * 10] if len(t) >= 20]
    df = spark.createDataFrame([(t, [(0, len(t), t)]) for t in tokens], "t string, tokens array<struct<start:int,end:int,hit:string>>")
    got = {r.t: r.tokens[0] for r in secrets.battery(df, "tokens").collect()}
    for t in tokens:
        p = max(1e-20, plain_p(t))
        # The approximation of the normal tail moves few values across a bin's border.
        assert abs(got[t].bin - min(400, math.floor(-math.log10(p) * 20))) <= 1, (t, p, got[t])
        assert got[t].band == min(11, math.floor(math.log2(len(t.rstrip("="))) * 2 - 8))


def test_false_discoveries_are_few_and_secrets_found(spark):
    secret, plain = some_tokens(random.Random(7), 150)
    rows = [(i, f"see {t} there") for i, t in enumerate(secret + plain)]
    out = {r.doc_id: any(s.kind == "random" for s in r.secret_spans) for r in secrets.scan(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    found = [i for i, x in out.items() if x]
    wrong = [i for i in found if i >= len(secret)]
    assert len(wrong) <= 0.05 * len(found) + 2
    assert len(found) - len(wrong) >= 0.85 * len(secret)
    for t in ("internationalization1", "COVID19vaccinationProgramme2021"):
        df = spark.createDataFrame([(1, f"on {t} now")], "doc_id int, text string")
        assert not secrets.scan(df).first().secret_spans


def test_benjamini_hochberg_by_band(spark):
    rng = random.Random(3)
    rows = [(b, min(400, int(rng.expovariate(0.03 if rng.random() < 0.3 else 0.12)))) for b in (1, 2, 5) for _ in range(200)]
    got = secrets.fdr_cuts(spark.createDataFrame(rows, "band int, bin int"), 0.05)
    for b in (1, 2, 5):
        bins = sorted((x for c, x in rows if c == b), reverse=True)
        ok = [x for x in set(bins) if 10 ** (-x / 20) <= 0.05 * sum(y >= x for y in bins) / len(bins)]
        assert got.get(b) == (min(ok) if ok else None)


# Personal data


def plain_candidate(hit, before, after):
    digits = re.sub("[^0-9]", "", hit)
    n = len(digits)
    luhn = lambda x: sum((d - 9 if d > 9 else d) for d in (int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(x)))) % 10 == 0
    address = re.sub(r" ?[(\[]dot[)\]] ?", ".", re.sub(r" ?[(\[]at[)\]] ?", "@", hit))
    is_address = bool(re.match(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+$", address))
    quad = re.match(r"^\d{1,3}(\.\d{1,3}){3}$", hit)
    call = re.search(r"(?i)(?<!\w)(call|phone|mobile|tel|contact)(?!\w)[^0-9\n]*$", before)
    f = {
        "at": 1 if "@" in hit else 2 if re.search(r"[(\[]at[)\]]", hit) else 0,
        "digits": next(i for i, top in enumerate((7, 10, 12, 13, 16, 20, 10**9)) if n < top),
        "groups": min(3, max(0, len(re.findall("[0-9]+", hit)) - 1)), "plus": int(hit.startswith("+")), "parens": int("(" in hit),
        "dots": 2 if quad else int(is_address) if re.search("[A-Za-z@]", hit) else int("." in hit), "dashes": int("-" in hit),
        "glued": int(bool(re.search(r"\w$", before) or re.match(r"\w", after))),
        "cue": 2 if call else 1 if re.search("(?i)mail|phone|tel|call|mobile|card|visa|ip|host|contact|ssn", before) else 3 if re.search(r"(?i)(?<!\w)(order|no|ref|id|part)\W{0,4}$", before) else 0,
        "letters": int(bool(re.search("[A-Za-z]", hit))), "checksum": int(13 <= n <= 19 and luhn(digits)),
        "national": int(bool(re.match(r"^(\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}$", hit))),
    }
    number = f["at"] == 0 and f["glued"] == 0 and f["dots"] < 2
    network = n in (13, 16, 19) and digits[0] == "4" or n == 16 and 51 <= int(digits[:2]) <= 55 or n == 16 and 2221 <= int(digits[:4]) <= 2720 or n == 15 and digits[:2] in ("34", "37") or n == 16 and digits[:2] in ("35", "65") or n == 16 and digits[:4] == "6011" or n == 14 and (300 <= int(digits[:3]) <= 305 or digits[:2] in ("36", "38"))
    label = f["at"] > 0 and f["dots"] == 1 or bool(quad) and all(int(x) <= 255 for x in hit.split(".")) or number and (bool(f["checksum"]) or bool(n) and network and not f["plus"])
    label = label or hit.startswith("+") and 8 <= n <= 15 or number and bool(f["national"]) and bool(re.match(r"^[2-9]\d{2}[2-9]\d{6}$", digits)) or number and f["cue"] == 2 and 7 <= n <= 15
    return f, bool(label)


def test_features_labels_and_selection_equal_a_plain_version(spark):
    rng = random.Random(4)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    makers = [lambda: digits(16), lambda: "4" + digits(15), lambda: "37" + digits(13), lambda: f"({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"{digits(3)}-{digits(3)}-{digits(4)}", lambda: "+" + digits(11), lambda: digits(9), lambda: f"{rng.randrange(300)}.{rng.randrange(300)}.1.2", lambda: f"a{digits(2)} (at) host (dot) org", lambda: f"b{digits(2)}@host.org", lambda: digits(14)]
    contexts = ["we saw ", "call me: ", "order no ", "x", "card "]
    rows = [(i, rng.choice(contexts) + rng.choice(makers)() + rng.choice([" and", ".", "z"])) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    texts, seen = dict(rows), collections.defaultdict(list)
    tested = pii._tested(df, "text", True).select("row.doc_id", "candidates").collect()
    assert sum(len(r.candidates) for r in tested) > 500
    for r in tested:
        t = texts[r.doc_id]
        for c in r.candidates:
            f, label = plain_candidate(t[c.start : c.end], t[max(0, c.start - 24) : c.start], t[c.end : c.end + 24])
            assert (c.f.asDict(), c.label) == (f, label), (t, c)
            seen[tuple(f.values())].append(label)
    cells = np.array(list(seen))
    weight, share = np.array([len(v) for v in seen.values()], float), np.array([np.mean(v) for v in seen.values()])
    # The trees see what the labels don't tell by format alone: some cells are mixed.
    assert ((share > 0.02) & (share < 0.98)).any()
    trees, base = pii.boost(cells, weight, share)
    score = {tuple(c.tolist()): base + sum(pii._leaf(t, c) for t in trees) for c in cells}
    cut = pii.threshold(np.array([score[tuple(c.tolist())] for c in cells]), weight, share, 0.5)
    want = {(r.doc_id, c.start, c.end) for r in tested for c in r.candidates if score[tuple(c.f.asDict().values())] >= cut - 1e-9}
    out = pii.detect(df).collect()
    picked = {(r.doc_id, s.start, s.end) for r in out for s in r.pii_spans if s.kind == "pii"}
    base_spans = {(r.doc_id, s.start, s.end) for r in out for s in r.base_spans}
    assert picked == want - base_spans and picked


# Quality


def test_weights_and_draw_equal_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, words(rng, rng.randint(1, 12), "etaoin" if i % 3 else "etaoinshr")) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    good = df.where("doc_id % 3 <> 0 AND doc_id < 150")
    out = {r.doc_id: r for r in quality.resample(df, good, df.where("doc_id % 3 = 0 AND doc_id < 150"), bits=16, smoothing=5.0).collect()}

    def grams(text, n):
        """(context, n-gram) of each place, as buckets of a multiplicative hash."""
        b, out = text.encode(), []
        for at in range(len(b) - n + 1):
            if n == 1:
                out.append((0, b[at]))
                continue
            h = 0
            for x in b[at : at + n - 1]:
                h = (h + x) * 0x9E3779B1 % 2**32
            out.append((h >> 16, (h + b[at + n - 1]) * 0x9E3779B1 % 2**32 >> 16))
        return out

    labelled = {i for i, _ in rows if i % 3 and i < 150}
    raw, target = collections.Counter(), collections.Counter()
    for i, t in rows:
        for n in (1, 3, 5):
            for c, g in grams(t, n):
                for count in (raw, target) if i in labelled else (raw,):
                    count[n, "c", c] += 1
                    count[n, "g", g] += 1
    for i, t in rows:
        want = 0.0
        for n in (1, 3, 5):
            for c, g in grams(t, n):
                share = target[n, "g", g] / raw[n, "g", g]
                want += math.log(share * raw[n, "c", c] + 5.0) - math.log(target[n, "c", c] + 5.0)
        assert math.isclose(out[i].log_weight, want, rel_tol=1e-3, abs_tol=2e-2), i
    noise = {r.doc_id: -math.log(-math.log(r.u)) for r in df.select("doc_id", ((F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit(42)), 11) + 0.5) / float(1 << 53)).alias("u")).collect()}
    keys = {i: r.log_weight + noise[i] for i, r in out.items()}
    assert all(math.isclose(out[i].gumbel_key, keys[i], rel_tol=1e-9, abs_tol=1e-9) for i in keys)
    k = round(300 * 100 / 150)
    assert {i for i, r in out.items() if r.kept} == set(sorted(keys, key=keys.get)[-k:])
    # The draw isn't the cut of the best k: its noise changes places around the border.
    assert {i for i, r in out.items() if r.kept} != set(sorted(keys, key=lambda i: out[i].log_weight)[-k:])
    values = np.array(list(noise.values()))
    assert abs(values.mean() - 0.5772) < 0.25 and abs(values.std() - math.pi / 6**0.5) < 0.25


# Language ID


def test_profiles_and_distances_equal_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, words(rng, 15, ["abcde fg", "cdefghij", "fghijklm"][i % 3].replace(" ", "")), f"l{i % 3}") for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)

    def grams(text):
        out = collections.Counter()
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            p = f" {w} "
            out.update(w)
            out.update(p[i : i + 2] for i in range(len(p) - 1))
            out.update(p[i : i + 3] for i in range(len(p) - 2))
        return out

    pack = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    order = lambda c: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], pack(x[0])))][:50]
    total = collections.defaultdict(collections.Counter)
    for i, t, lang in rows:
        if i < 60:
            total[lang] += grams(t)
    profiles = language_id.learn(df.where("doc_id < 60"), profile=50)
    assert {k: [pack(g) for g in order(c)] for k, c in total.items()} == {k: v.tolist() for k, v in profiles.items()}
    got = {r.doc_id: r.p for r in df.select("doc_id", language_id.predict(df, profiles, profile=50).alias("p")).collect()}
    for i, t, _ in rows:
        own, far = order(grams(t)), {}
        for lang in sorted(total):
            rank = {g: r for r, g in enumerate(order(total[lang]))}
            far[lang] = sum(abs(rank[g] - r) if g in rank else 50 for r, g in enumerate(own))
        best = min(sorted(far), key=far.get)
        second = min(v for k, v in far.items() if k != best)
        assert got[i].lang == best and math.isclose(got[i].score, 1 - far[best] / second if second else 0.0)


# Mixing


def test_flow_is_the_cheapest_of_all():
    rng = random.Random(5)
    for _ in range(40):
        names = ["x", "y"]
        patterns = {p: rng.randint(0, 4) for p in (("x",), ("y",), ("x", "y"))}
        quotas = {s: rng.randint(0, 9) for s in names}
        cost = lambda taken, n: sum(max(0, min(taken - k * n, n)) * k for k in range(3)) if n else 0
        best = None
        for tx, ty, bx, by in itertools.product(range(3 * patterns["x",] + 1), range(3 * patterns["y",] + 1), range(3 * patterns["x", "y"] + 1), range(3 * patterns["x", "y"] + 1)):
            if tx + bx <= quotas["x"] and ty + by <= quotas["y"] and bx + by <= 3 * patterns["x", "y"]:
                value = (-(tx + ty + bx + by), cost(tx, patterns["x",]) + cost(ty, patterns["y",]) + cost(bx + by, patterns["x", "y"]))
                best = value if best is None else min(best, value)
        taken = mixing.route(patterns, quotas)
        assert (-sum(taken.values()), sum(cost(t, patterns[p]) for p, t in taken.items())) == best


def test_documents_are_taken_in_the_order_of_the_hash(spark):
    rng = random.Random(6)
    rows = [(i, "w " * rng.randint(0, 9), rng.choice("abc")) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    out, sources = mixing.mix(df, F.array("source"))
    order = {r.doc_id: r.o for r in df.select("doc_id", F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit(42)), 1).alias("o")).collect()}
    got = {r.doc_id: r.mix_taken for r in out.collect()}
    for s, (size, target) in sources.items():
        own = sorted(((order[i], i, t.count("w")) for i, t, x in rows if x == s))
        full, left = divmod(round(target), size)
        for _, i, n in own:
            part = min(n, left)
            assert got[i] == full * n + part
            left -= part


# Language-model scores


def test_class_scores_equal_brute_force(spark):
    rng = random.Random(12)
    texts = [words(rng, rng.randint(0, 40), "abcd") for _ in range(150)]
    rows = list(enumerate(texts)) + [(None, texts[0]), (3, texts[3]), (500, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    settings = {"clustered": 10, "exchanged": 20, "dictionary": 40, "classes": 4}
    got = {(r.doc_id, r.held_out): r for r in brown.score(df, ~held, **settings).collect()}
    training = df.where(F.coalesce(~held, F.lit(True))).select("text")
    counts = brown.count_tokens(training, "text").cache()
    model, rare = brown.spread(brown.train(counts, training, "text", **settings), counts, training, "text")
    label = {w: int(k) for w, k in zip(model.ids, model.label)} | {bytes(r.word): r.label for r in rare.collect()}
    n = {bytes(r.word): r.n for r in counts.collect()}
    assert label.keys() == n.keys() and len(label) > 60
    total = model.total
    between, size = np.zeros((total, total)), np.zeros(total)
    split = lambda t: [*(t or "").encode().lower().split(), b""]
    for r in training.collect():
        before = label[b""]
        for w in split(r.text):
            between[before, label[w]] += 1
            size[label[w]] += 1
            before = label[w]
    assert np.array_equal(between, model.between)
    share = (between.sum(0) + 0.5) / (between.sum() + 0.5 * total)
    chance = (between + 20 * share) / (between.sum(1) + 20)[:, None]
    unknown = min(0.5, 0.5 / (sum(n.values()) + 0.5 * (len(n) + 1)))
    chance[:, :-1] *= (1 - unknown) / chance[:, :-1].sum(1, keepdims=True)
    chance[:, -1] = unknown
    for (i, h), r in got.items():
        text = next(t for j, t in rows if j == i)
        want, before = 0.0, label[b""]
        for w in split(text):
            k = label.get(w, total - 1)
            want += math.log10(chance[before, k]) + (math.log10(n[w] / size[k]) if w in n else 0.0)
            before = k
        assert math.isclose(r.score, want, rel_tol=1e-9, abs_tol=1e-9), (i, h)


# Vectors


def test_buckets_that_cannot_reach_a_threshold_are_not_sent(spark):
    rng = np.random.default_rng(3)
    length = np.exp(rng.normal(0, 1.0, 4000))
    v = rng.standard_normal((4000, 16)) * length[:, None]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    tally = {}
    got = topk.top_k(df, F.col("id") % 20 == 0, block=200, tally=tally).collect()
    assert tally["pairs"] == 200 * 4000 and tally["met"] < 0.5 * tally["pairs"]
    whole = np.floor(64 * v)
    for i in range(0, 4000, 400):
        score = whole @ whole[i]
        score[i] = -np.inf
        best = np.lexsort((np.arange(4000), -score))[:20]
        assert [(r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == i), key=lambda r: r["rank"])] == [(b, score[b]) for b in best]
    # Within a block only the prefix of those long enough is multiplied, and coordinates leave few to verify.
    query = whole[::20]
    theta = np.sort(query @ whole.T, axis=1)[:, -21]
    work = {}
    topk.search_block(np.arange(4000), whole, np.full(200, -1), query, theta, 20, tally=work)
    assert work.get("products", 0) + work["verified"] < 0.3 * 200 * 4000


def test_bit_codes_estimate_within_their_error():
    rng = np.random.default_rng(4)
    v = rng.standard_normal((3000, 64)) * np.exp(rng.normal(0, 0.3, 3000))[:, None]
    centre = v.mean(0)
    codes, norm, own = ann.encode(v, centre, 4)
    assert codes.shape == (3000, 4) and codes.dtype == np.uint64
    q = v[:40]
    estimate, low = ann.estimates(codes, norm, own, q, centre, 1.9)
    far = ((q[:, None] - v[None]) ** 2).sum(2)
    # One rotation by hand: signs against the rounded query.
    unit = (q - centre) / np.linalg.norm(q - centre, axis=1)[:, None]
    plain = np.zeros_like(far)
    for r in range(4):
        turned = unit @ ann.rotation(64, r)
        lo, step = turned.min(1)[:, None], (turned.max(1) - turned.min(1))[:, None] / 15
        rounded = lo + step * np.rint((turned - lo) / step)
        signs = np.where((v - centre) @ ann.rotation(64, r) > 0, 1.0, -1.0)
        plain += rounded @ signs.T / 8 / own[:, r] / 4
    n, m = norm[None, :], np.linalg.norm(q - centre, axis=1)[:, None]
    assert np.allclose(estimate, n**2 + m**2 - 2 * n * m * plain)
    error = (estimate - far) / ((estimate - low) / 1.9)
    apart = ~np.eye(40, 3000, dtype=bool)
    assert abs(error[apart].mean()) < 0.05 and 0.9 < error[apart].std() < 1.1 and (far < low)[apart].mean() < 0.05


@pytest.mark.parametrize("dim", [3, 64, 70])
def test_codes_of_any_dimension(spark, dim):
    rng = np.random.default_rng(dim)
    v = rng.standard_normal((400, dim))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = ann.nearest(df, F.col("id") % 100 == 0, block=100).collect()
    hits = 0
    for i in range(0, 400, 100):
        far = np.linalg.norm(v - v[i], axis=1)
        far[i] = np.inf
        hits += len(set(np.argsort(far)[:10].tolist()) & {r.vec_id for r in got if r.query_id == i})
    assert hits >= 36


def test_long_texts_by_blocks():
    rng = random.Random(1)
    text = words(rng, 60_000)
    for n in (1, 3, 5):
        whole = quality.hashed(text.encode(), n, 18)
        parts = list(quality.blocks(text.encode(), n, 18))
        assert len(parts) > 3 and all(np.array_equal(w, np.concatenate(p)) for w, p in zip(whole, zip(*parts)))
    assert "".join(language_id.pieces(text, 1000)) == text and max(map(len, language_id.pieces(text, 1000))) < 1010
    keys, counts = language_id.counted(text)
    found, want = np.unique(language_id.ngrams(text), return_counts=True)
    assert np.array_equal(keys, found) and np.array_equal(counts, want)
    assert list(language_id.pieces("x" * 5000, 1000)) == ["x" * 5000] and list(language_id.pieces("")) == []
