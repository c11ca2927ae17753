"""Secret scans: fixed patterns and a battery of randomness tests, in DataFrame expressions only.

Fixed patterns give the base spans. Besides, each run of 20 or more token characters with a letter gets an encoding (the
smallest alphabet that fits). Three tests ask whether its characters could be drawn uniformly and independently from that
alphabet: chi-squared over all its symbols, runs above and below its middle, and serial correlation. A token for which the least of
the three p-values, times three, is under `fit` is no random string, whatever else.

For the others the same counts are held against ordinary text: words repeat letters (the share of equal pairs is `COINCIDENCE`),
and identifiers seldom change between capitals, small letters, digits and separators (`SWITCHES`). The token's p-value is that of
text with so few equal pairs and so many changes. Tokens of similar length form a band, and within each band the
Benjamini-Hochberg rule at level `alpha` picks those that ordinary text doesn't explain: of the tokens reported, at most
that share are ordinary. Bands keep the many short tokens, on which tests have little power, from deciding about long ones.
The p-values of all tokens are counted in fixed bins for each band, so the rule needs one small table (bands by bins),
however many tokens there are.

A null text counts as empty: no spans, the digest of nothing. Repeated rows give equal rows, and each counts in its band. Tokens
with equal p-values are picked or left together. Extra columns stay, whatever their names; one named `secret_spans` is replaced. A null id
keeps its row. An empty table gives an empty one. Cost grows about in proportion to a text's length and to its number of matches.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize, quoted, unwrapped, wrapped
from tessera.llm.spans import located, masked, text_of

# The base patterns (fixed values, given with the query's contract).
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# A run that is too short matches nowhere inside itself, so the length can be part of these two.
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
TOKEN = r"[A-Za-z0-9+/_-]{20,}+={0,2}"

_DIGITS, _LOW, _UP = string.digits, string.ascii_lowercase, string.ascii_uppercase
#: (what fits, alphabet in order of code), smallest first.
ENCODINGS = [
    ("^[0-9a-f]+$", _DIGITS + "abcdef"),
    ("^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    ("^[a-z]+$", _LOW),
    ("^[A-Z]+$", _UP),
    ("^[A-Z2-7]+$", _UP + "234567"),
    ("^[A-Z0-9]+$", _DIGITS + _UP),
    ("^[a-z0-9]+$", _DIGITS + _LOW),
    ("^[A-Za-z]+$", _UP + _LOW),
    ("^[A-Za-z0-9]+$", _UP + _LOW + _DIGITS),
    ("^[A-Za-z0-9+/]+$", _UP + _LOW + _DIGITS + "+/"),
    ("^[A-Za-z0-9_-]+$", _UP + _LOW + _DIGITS + "-_"),
    ("", _UP + _LOW + _DIGITS + "+/-_"),
]
#: Share of equal pairs of letters in ordinary English text, and of equal triples; other languages repeat more.
COINCIDENCE, TRIPLES = 0.0655, 0.0056
#: Share of neighbours of different classes (capital, small, digit, separator) in ordinary identifiers and paths.
SWITCHES = 0.2
_ALL = _UP + _LOW + _DIGITS + "+/-_"
_CLASS = "A" * 26 + "a" * 26 + "0" * 10 + "----"
_BINS = 400  # of -log10 p, 20 to a unit


def _two_sided(z: Column) -> Column:
    """p-value of a normal deviate (the usual rational approximation of erfc; error below 2e-7)."""
    x = F.abs(z) / F.lit(2.0**0.5)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.greatest(F.lit(1e-20), poly * F.exp(-x * x))


def _upper(z: Column) -> Column:
    return F.when(z > 0, _two_sided(z) / 2).otherwise(1 - _two_sided(z) / 2)


def _squares(body: Column, symbols: Column) -> Column:
    """Sum of the squared counts of the symbols."""
    count = lambda c: (F.char_length(body) - F.char_length(F.replace(body, c, F.lit("")))).cast("double")
    return F.aggregate(F.transform(symbols, lambda c: F.pow(count(c), 2)), F.lit(0.0), lambda x, y: x + y)


def battery(df: DataFrame, column: str, fit: float = 0.001) -> DataFrame:
    """(start, end, band, bin) of the structs (start, end, hit) of an array column that have a letter: the band of their length, and
    the bin of the p-value that ordinary text has of looking so random."""

    def stage(df: DataFrame, **new) -> DataFrame:
        return df.withColumn(column, F.transform(column, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), *[make(t).alias(n) for n, make in new.items()])))

    def alphabet(t: Column) -> Column:
        out = F.when(F.lit(False), F.lit(""))
        for fits, letters in ENCODINGS:
            out = out.when(t["body"].rlike(fits), F.lit(letters))
        return out

    def same(*names: str) -> dict:
        return {n: (lambda t, n=n: t[n]) for n in names}

    df = stage(df, body=lambda t: F.regexp_replace(t["hit"], "=+$", ""))
    df = df.withColumn(column, F.filter(column, lambda t: t["body"].rlike("[A-Za-z]")))
    df = stage(df, **same("body"), alpha=alphabet)
    df = stage(
        df,
        **same("body", "alpha"),
        v=lambda t: F.transform(F.split(t["body"], ""), lambda c: (F.position(c, t["alpha"]) - 1).cast("double")),
        n=lambda t: F.char_length(t["body"]).cast("double"),
        a=lambda t: F.char_length(t["alpha"]).cast("double"),
        classes=lambda t: F.translate(t["body"], _ALL, _CLASS),
    )

    def total(array: Column) -> Column:
        return F.aggregate(array, F.lit(0.0), lambda x, y: x + y)

    df = stage(
        df,
        **same("n", "a", "v", "classes"),
        mean=lambda t: total(t["v"]) / t["n"],
        high=lambda t: F.size(F.filter(t["v"], lambda x: x >= t["a"] / 2)).cast("double"),
        runs=lambda t: F.regexp_count(F.array_join(F.transform(t["v"], lambda x: F.when(x >= t["a"] / 2, "h").otherwise("l")), ""), F.lit("h++|l++")).cast("double"),
        equal=lambda t: _squares(t["body"], F.split(t["alpha"], "")),
        folded=lambda t: _squares(F.lower(t["body"]), F.array_distinct(F.split(F.lower(t["alpha"]), ""))),
    )
    df = stage(
        df,
        **same("n", "a", "runs", "equal", "folded", "classes"),
        both=lambda t: 2 * t["high"] * (t["n"] - t["high"]),
        lag=lambda t: total(F.zip_with(F.slice(t["v"], F.lit(2), F.size(t["v"]) - 1), F.slice(t["v"], F.lit(1), F.size(t["v"]) - 1), lambda x, y: (x - t["mean"]) * (y - t["mean"]))),
        var=lambda t: total(F.transform(t["v"], lambda x: F.pow(x - t["mean"], 2))),
    )

    def uneven(t: Column) -> Column:
        """Upper tail of chi-squared over all symbols. Most occur once or never, so its mean and variance are those of few draws."""
        chi, k = t["equal"] * t["a"] / t["n"] - t["n"], t["a"] - 1
        return _upper((chi - k) / F.sqrt(2 * k * (t["n"] - 1) / t["n"]))

    def few_or_many_runs(t: Column) -> Column:
        sd = F.sqrt(F.greatest(F.lit(1e-9), t["both"] * (t["both"] - t["n"]) / (t["n"] * t["n"] * (t["n"] - 1))))
        return F.when(t["both"] <= t["n"], 1e-20).otherwise(_two_sided((t["runs"] - 1 - t["both"] / t["n"]) / sd))

    def correlated(t: Column) -> Column:
        return F.when(t["var"] <= 0, 1e-20).otherwise(_two_sided(F.sqrt(t["n"]) * t["lag"] / F.greatest(t["var"], F.lit(1e-9))))

    def ordinary(t: Column) -> Column:
        """p-value of ordinary text: few equal pairs and many changes of class, as one normal deviate."""
        n, pairs = t["n"], t["n"] * (t["n"] - 1) / 2
        variance = pairs * (COINCIDENCE - COINCIDENCE**2) + pairs * (n - 2) * 2 * (TRIPLES - COINCIDENCE**2)
        rare = (pairs * COINCIDENCE - (t["folded"] - n) / 2) / F.sqrt(variance)
        changes = F.regexp_count(t["classes"], F.lit("A++|a++|0++|-++")) - 1
        switching = (changes - (n - 1) * SWITCHES) / F.sqrt((n - 1) * SWITCHES * (1 - SWITCHES))
        # An alphabet of one class has no changes to count.
        return _upper(F.when(t["classes"].rlike("^(?:A+|a+)$"), rare).otherwise((rare + switching) / 2**0.5))

    p = lambda t: F.when(3 * F.least(uneven(t), few_or_many_runs(t), correlated(t)) >= fit, ordinary(t)).otherwise(1.0)
    return stage(
        df,
        band=lambda t: F.least(F.lit(11), F.floor(F.log2(t["n"]) * 2 - 8).cast("int")),
        bin=lambda t: F.least(F.lit(_BINS), F.floor(-F.log10(F.least(F.lit(1.0), F.greatest(F.lit(1e-20), p(t)))) * 20).cast("int")),
    )


def fdr_cuts(tokens: DataFrame, alpha: float) -> dict[int, int]:
    """For each band the least bin of -log10 p at which ordinary text is rejected."""
    counts = tokens.groupBy("band", "bin").agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("band")
    ranked = counts.withColumn("m", F.sum("n").over(by)).withColumn("rank", F.sum("n").over(by.orderBy(F.desc("bin"))))
    # A bin's p-values are at most 10^(-bin/20).
    passed = ranked.where(F.pow(F.lit(10.0), -F.col("bin") / 20.0) <= F.lit(alpha) * F.col("rank") / F.col("m"))
    return {r.band: r.bin for r in passed.groupBy("band").agg(F.min("bin").alias("bin")).collect()}


def scan(docs: DataFrame, text_col: str = "text", alpha: float = 0.05, fit: float = 0.001, keep_text: bool = True) -> DataFrame:
    """docs with the array column secret_spans (kind, start, end) added, by start, then kind. The texts are searched once: spans and
    tokens go to a table in the shared folder, from which the cuts and the result are made (without the text unless `keep_text`)."""
    text = F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")).alias("_text")
    fields = [c for c in docs.columns if keep_text or c != text_col]
    df = docs.select(F.struct(*[F.col(quoted(c)) for c in fields]).alias("row"), text)
    for kind, pattern in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("tokens", TOKEN)):
        df = located(df, kind, pattern)
    df = df.withColumn("assign", F.filter("assign", lambda t: F.char_length(F.regexp_extract(t["hit"], ASSIGN, 1)) >= 6))
    place = lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"))
    df = df.withColumns({kind: F.transform(kind, place) for kind in ("assign", "access", "hex")})
    df = materialize(battery(df.drop("_text"), "tokens", fit))
    cuts = fdr_cuts(df.select(F.explode("tokens").alias("t")).select("t.band", "t.bin"), alpha)
    cut = F.create_map(*[F.lit(x) for pair in cuts.items() for x in pair]) if cuts else F.expr("cast(map() as map<int,int>)")
    random = F.filter("tokens", lambda t: t["bin"] >= F.coalesce(F.try_element_at(cut, t["band"]), F.lit(_BINS + 1)))

    def of(kind: str, order: int, array: Column) -> Column:
        return F.transform(array, lambda t: F.struct(t["start"].alias("start"), F.lit(order).alias("order"), t["end"].alias("end"), F.lit(kind).alias("kind")))

    spans = F.sort_array(F.concat(of("assign", 0, F.col("assign")), of("access", 1, F.col("access")), of("hex", 2, F.col("hex")), of("random", 3, random)))
    return unwrapped(df, secret_spans=spans)


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]", alpha: float = 0.05) -> DataFrame:
    """docs with every secret in the text masked; null texts stay null. Columns are those of docs."""
    own = wrapped(docs).withColumn("text", F.col(f"row.{quoted(text_col)}").cast("string"))
    found = scan(own, "text", alpha).withColumn("text", masked(F.col("text"), F.col("secret_spans"), mask))
    return unwrapped(found.select("row", "text"), **{text_col: F.col("text")})


def op1(spark, sf_dir: str) -> DataFrame:
    from tessera.llm.common import table

    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    base = F.filter("secret_spans", lambda s: s["kind"] != "random")
    n = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(text_of(base), 256).alias("base_sha256"), text_of(F.col("secret_spans")).alias("spans"), n("random"))
