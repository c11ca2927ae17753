"""Personal data: candidate spans scored by gradient-boosted trees, in DataFrame expressions only.

Fixed patterns with their checks (octets, digits, Luhn) give the base spans, which always stay. Generators
with high recall propose further, overlapping candidates: addresses written with (at) and (dot), digit groups
with any separators, runs of 13 to 19 digits. Each candidate has a few small-valued features of its
format and of the text around it. Their values are counted over all documents into one small table (a cell for each
combination), with the share of candidates with a weak label; the trees are boosted on that table, so
training sees every document and only the table reaches the driver.

The weak label comes from checks that a format doesn't tell: what a candidate holds passes a base pattern's checks, is an address once (at) and
(dot) are rewritten, passes Luhn or has the prefix and length of a card network, is a national number whose area and exchange codes
the numbering plan allows, or a number straight after a word for telephones. Which digits stand where is seen by the labels alone, so a cell
holds labelled and unlabelled candidates, and the trees carry the label to those of the same format and context that fail each check
(a card number with a wrong digit). Each leaf sum's probability is calibrated on the table as well (rising with
the score), and the threshold is the least one at which the share of labelled ones reaches `precision`: at 0.5, what is likelier than not
personal is redacted. Trees are evaluated as nested CASE expressions. Selected candidates are reported as kind `pii`.

A null text counts as empty. Repeated rows give equal rows and count each time in training. A null id keeps its
row. Candidates with equal features are picked or left together. With no candidate, or none with a label, nothing is added; an empty table
gives an empty one. Extra columns stay, whatever their names; base_spans and pii_spans are replaced. Cost grows about in
proportion to a text's length and to its number of matches.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, quoted, unwrapped, wrapped
from tessera.llm.spans import located, masked, text_of

# The base patterns (fixed values, given with the query's contract), with possessive loops: none of them
# could match otherwise by giving back. A run is tried from its start, or from where the last match ended, only:
# later starts could not match where these fail.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = (("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE))
_OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])){3}$"

# Generators of candidates.
LOOSE_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++(?:@|\x20?[(\[]at[)\]]\x20?)[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[]dot[)\]]\x20?)[A-Za-z0-9-]++)*+"
NUMBERS = r"\+?(?:\((?=[0-9]{2,4}\)))?(?<![0-9])[0-9](?:[\x20().-]{0,3}+[0-9]){6,}+"
GENERATORS = (("loose_email", LOOSE_EMAIL), ("numbers", NUMBERS))
_CONTEXT = 24  # characters of context on each side
_ADDRESS = r"^[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++$"
_QUAD = r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"
_NATIONAL = r"^(?:\([0-9]{3}\)[\x20.-]?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}$"
# Area and exchange codes of the North American numbering plan start with 2 to 9.
_PLAN = r"^[2-9][0-9]{2}[2-9][0-9]{6}$"
# Prefixes and lengths of card networks (fixed values, public ranges).
_NETWORK = r"^(?:4[0-9]{12}(?:[0-9]{3}){0,2}|5[1-5][0-9]{14}|2(?:22[1-9]|2[3-9][0-9]|[3-6][0-9]{2}|7[01][0-9]|720)[0-9]{12}|3[47][0-9]{13}|3(?:0[0-5]|[68][0-9])[0-9]{11}|6(?:011|5[0-9]{2})[0-9]{12}|35[0-9]{14})$"
# Words for a telephone with no digits between them and the number.
_CALL = r"(?i)(?<![\p{L}])(?:(?:tele?|mobile\x20?|cell\x20?)?(?:phone|fax)|tel|telefon|telefono|teléfono|téléphone|tlf|call|mobile|móvil|cell|contact|whatsapp)(?![\p{L}])[^0-9\n]*$"
# Words for other things that have numbers.
_OTHER = r"(?i)(?<![\p{L}])(?:order|invoice|ref|reference|id|no|nr|version|part|serial|tracking|ticket|isbn|build|total)\P{L}{0,4}$"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _address(hit: Column) -> Column:
    """A loose address as it would be written plainly."""
    return F.regexp_replace(F.regexp_replace(hit, r"\x20?[(\[]at[)\]]\x20?", "@"), r"\x20?[(\[]dot[)\]]\x20?", ".")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def add(acc: Column, c: Column) -> Column:
        d = c.cast("int") * F.when(acc["twice"], 2).otherwise(1)
        return F.struct((acc["sum"] + F.when(d > 9, d - 9).otherwise(d)).alias("sum"), (~acc["twice"]).alias("twice"))

    start = F.struct(F.lit(0).alias("sum"), F.lit(False).alias("twice"))
    return F.aggregate(F.split(F.reverse(digits), ""), start, add, lambda acc: acc["sum"] % 10 == 0)


def _check(kind: str):
    """The condition that a match of a base pattern must meet."""
    n = lambda t: F.char_length(_digits(t["hit"]))
    return {
        "email": lambda t: t["hit"].isNotNull(),
        "ip": lambda t: t["hit"].rlike(_OCTETS),
        "card": lambda t: F.when(n(t).between(16, 19), luhn(_digits(t["hit"]))).otherwise(False),
        "phone": lambda t: n(t).between(8, 15),
    }[kind]


#: Each feature's number of values.
FEATURES = {"at": 3, "digits": 7, "groups": 4, "plus": 2, "parens": 2, "dots": 3, "dashes": 2, "glued": 2, "cue": 4, "letters": 2, "checksum": 2, "national": 2}


def _features(t: Column) -> dict[str, Column]:
    hit, before, after = t["hit"], t["before"], t["after"]
    n = F.char_length(_digits(hit))
    return {
        "at": F.when(hit.contains("@"), 1).when(hit.rlike(r"[(\[]at[)\]]"), 2).otherwise(0),
        "digits": F.when(n < 7, 0).when(n < 10, 1).when(n < 12, 2).when(n < 13, 3).when(n < 16, 4).when(n < 20, 5).otherwise(6),
        "groups": F.least(F.lit(3), F.greatest(F.lit(0), F.regexp_count(hit, F.lit("[0-9]++")) - 1)),
        "plus": hit.startswith("+").cast("int"),
        "parens": hit.contains("(").cast("int"),
        # Of an address the dots of its host count, however they are written.
        "dots": F.when(hit.rlike(_QUAD), 2).when(hit.rlike("[A-Za-z@]"), _address(hit).rlike(_ADDRESS).cast("int")).when(hit.contains("."), 1).otherwise(0),
        "dashes": hit.contains("-").cast("int"),
        "glued": (before.rlike(r"[A-Za-z0-9_]$") | after.rlike(r"^[A-Za-z0-9_]")).cast("int"),
        "cue": F.when(before.rlike(_CALL), 2).when(before.rlike(r"(?i)(?:mail|phone|tel|call|mobile|card|visa|ip|host|contact|ssn)"), 1).when(before.rlike(_OTHER), 3).otherwise(0),
        "letters": hit.rlike("[A-Za-z]").cast("int"),
        "checksum": F.when(n.between(13, 19), luhn(_digits(hit)).cast("int")).otherwise(0),
        "national": hit.rlike(_NATIONAL).cast("int"),
    }


def _label(t: Column, f: Column) -> Column:
    """Whether a candidate passes a check, as it stands or normalised."""
    hit, digits = t["hit"], _digits(t["hit"])
    n = F.char_length(digits)
    number = (f["at"] == 0) & (f["glued"] == 0) & (f["dots"] < 2)
    address = (f["at"] > 0) & (f["dots"] == 1)
    quad = hit.rlike(_OCTETS)
    card = number & (f["checksum"] == 1) | number & digits.rlike(_NETWORK) & (f["plus"] == 0)
    phone = hit.startswith("+") & n.between(8, 15) | number & (f["national"] == 1) & digits.rlike(_PLAN) | number & (f["cue"] == 2) & n.between(7, 15)
    return address | quad | card | phone


def boost(cells: np.ndarray, weight: np.ndarray, share: np.ndarray, rounds: int = 24, rate: float = 0.4, depth: int = 3) -> tuple[list, float]:
    """Trees of the log odds on a table of feature cells: (feature, value, left, right) where the feature's
    value is at most that, or a leaf's number. Newton steps on the logistic loss."""
    prior = float(np.clip((weight * share).sum() / weight.sum(), 1e-6, 1 - 1e-6))
    base = float(np.log(prior / (1 - prior)))
    f, trees = np.full(len(cells), base), []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, left: int):
        total_g, total_h = g[rows].sum(), h[rows].sum()
        best = (1e-6, None)
        if left:
            for j in range(cells.shape[1]):
                for v in range(int(cells[rows, j].max())):
                    low = rows & (cells[:, j] <= v)
                    lg, lh = g[low].sum(), h[low].sum()
                    gain = lg * lg / (lh + 1) + (total_g - lg) ** 2 / (total_h - lh + 1) - total_g**2 / (total_h + 1)
                    if gain > best[0]:
                        best = (gain, (j, v, low))
        if best[1] is None:
            return float(rate * total_g / (total_h + 1))
        j, v, low = best[1]
        return (j, v, grow(low, g, h, left - 1), grow(rows & ~low, g, h, left - 1))

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f))
        tree = grow(np.ones(len(cells), bool), weight * (share - p), weight * p * (1 - p), depth)
        trees.append(tree)
        f = f + np.array([_leaf(tree, c) for c in cells])
    return trees, base


def _leaf(tree, cell) -> float:
    while not isinstance(tree, float):
        j, v, low, high = tree
        tree = low if cell[j] <= v else high
    return tree


def threshold(score: np.ndarray, weight: np.ndarray, share: np.ndarray, precision: float) -> float:
    """The least score such that at each score from there on the share of hits, smoothed over
    neighbours so that it rises with the score, reaches `precision`; infinite if none does. One more candidate without a label
    counts with each, so that a single one in two is no evidence."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # pool adjacent violators: hits, weight, least score
    for i in order.tolist():
        blocks.append([weight[i] * share[i], weight[i], score[i]])
        while len(blocks) > 1 and (blocks[-2][2] == blocks[-1][2] or blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]):
            hits, n, _ = blocks.pop()
            blocks[-1][0] += hits
            blocks[-1][1] += n
    return next((low for hits, n, low in blocks if hits >= precision * (n + 1)), float("inf"))


def _tree_column(tree, features: Column) -> Column:
    names = list(FEATURES)
    if isinstance(tree, float):
        return F.lit(tree)
    j, v, low, high = tree
    return F.when(features[names[j]] <= v, _tree_column(low, features)).otherwise(_tree_column(high, features))


def _tested(docs: DataFrame, text_col: str, keep_text: bool) -> DataFrame:
    """The rows as `row`, their base spans, and candidates with features and label, all written once."""
    text = F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")).alias("_text")
    df = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns if keep_text or c != text_col]).alias("row"), text)
    for kind, pattern in KINDS:
        df = located(df, kind, pattern, context=_CONTEXT if kind == "card" else 0)
        if kind == "card":
            df = df.withColumn("runs", F.filter(kind, lambda t: F.char_length(_digits(t["hit"])).between(13, 19)))
        df = df.withColumn(kind, F.filter(kind, _check(kind)))
    for name, pattern in GENERATORS:
        df = located(df, name, pattern, context=_CONTEXT)

    def of(order: int, kind: str) -> Column:
        return F.transform(kind, lambda t: F.struct(F.lit(order).alias("order"), t["start"].alias("start"), t["end"].alias("end"), F.lit(kind).alias("kind")))

    df = df.withColumn("base_spans", F.sort_array(F.concat(*[of(i, kind) for i, (kind, _) in enumerate(KINDS)])))
    df = df.withColumn("candidates", F.sort_array(F.concat(*[F.col(name) for name, _ in GENERATORS], F.col("runs"))))
    # Generators may propose the same span: of equal neighbours the first stays.
    again = lambda t, i: (i > 0) & (F.get("candidates", i - 1)["start"] == t["start"]) & (F.get("candidates", i - 1)["end"] == t["end"])
    df = df.withColumn("candidates", F.filter("candidates", lambda t, i: ~again(t, i)))
    df = df.withColumn("candidates", F.transform("candidates", lambda t: F.struct(t.alias("t"), F.struct(*[c.cast("int").alias(n) for n, c in _features(t).items()]).alias("f"))))
    tested = F.transform("candidates", lambda x: F.struct(x["t"]["start"].alias("start"), x["t"]["end"].alias("end"), _label(x["t"], x["f"]).alias("label"), x["f"].alias("f")))
    return materialize(df.select("row", "base_spans", tested.alias("candidates")))


def detect(docs: DataFrame, text_col: str = "text", precision: float = 0.5, keep_text: bool = True) -> DataFrame:
    """docs with the array columns base_spans and pii_spans (order, start, end, kind) added; the latter has all
    base spans and the candidates that the trees select. The texts are searched once: candidates go to a table in the shared
    folder, for training and for the result (without the text unless `keep_text`)."""
    df = _tested(docs, text_col, keep_text)
    names = list(FEATURES)
    table = df.select(F.explode("candidates").alias("c")).groupBy("c.f").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("c.label").cast("double")).alias("share")).collect()
    picked = F.expr("cast(array() as array<struct<order:int,start:int,end:int,kind:string>>)")
    if table:
        cells, weight, share = np.array([[r.f[n] for n in names] for r in table]), np.array([r.n for r in table], float), np.array([r.share for r in table])
        trees, base = boost(cells, weight, share)
        cut = threshold(np.array([base + sum(_leaf(t, c) for t in trees) for c in cells]), weight, share, precision)
        if np.isfinite(cut) and (weight * share).sum() > 0:

            def scored(c: Column) -> Column:
                total = F.lit(base)
                for t in trees:
                    total = total + _tree_column(t, c["f"])
                return total >= cut - 1e-9

            picked = F.transform(F.filter("candidates", scored), lambda c: F.struct(F.lit(len(KINDS)).alias("order"), c["start"].alias("start"), c["end"].alias("end"), F.lit("pii").alias("kind")))
    # A candidate that is the same as a base span adds nothing. Sorted by place, it follows that span.
    df = df.withColumn("all", F.array_sort(F.transform(F.concat("base_spans", picked), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["order"].alias("order"), s["kind"].alias("kind")))))
    twice = lambda s, i: (i > 0) & (s["kind"] == "pii") & (F.get("all", i - 1)["start"] == s["start"]) & (F.get("all", i - 1)["end"] == s["end"])
    left = F.filter("all", lambda s, i: ~twice(s, i))
    spans = F.array_sort(F.transform(left, lambda s: F.struct(s["order"].alias("order"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return unwrapped(df, base_spans=F.col("base_spans"), pii_spans=spans)


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[PII]", precision: float = 0.5) -> DataFrame:
    """docs with personal data in the text masked; null texts stay null. Columns are those of docs."""
    own = wrapped(docs).withColumn("text", F.col(f"row.{quoted(text_col)}").cast("string"))
    found = detect(own, "text", precision)
    spans = F.array_sort(F.transform("pii_spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    return unwrapped(found.select("row", masked(F.col("text"), spans, mask).alias("text")), **{text_col: F.col("text")})


def op4(spark, sf_dir: str) -> DataFrame:
    from tessera.llm.common import table

    found = detect(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    n = lambda kind: F.size(F.filter("pii_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[n(k) for k, _ in KINDS], F.sha2(text_of(F.col("base_spans")), 256).alias("base_sha256"), text_of(F.col("pii_spans")).alias("spans"), n("pii"), F.size("pii_spans").cast("long").alias("n_spans"))
