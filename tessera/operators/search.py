"""Text search: a postings table, queries with phrases and negations, TF-IDF scores."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.scratch import materialize

# English words that are neither indexed nor searched (fixed values).
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from",
    "has", "he", "in", "is", "it", "its", "of", "on", "or", "that",
    "the", "to", "was", "were", "will", "with", "this", "but",
    "they", "have", "had", "what", "when", "where", "who", "which",
    "why", "how", "all", "each", "every", "both", "few", "more", "most",
    "other", "some", "such", "no", "nor", "not", "only", "own", "same",
    "so", "than", "too", "very", "just", "can", "should", "now",
)
PHRASE_BONUS = 1.5


#: Latin letters and what is left of them without their marks (fixed values, by Unicode decomposition).
def _unmarked() -> tuple[str, str]:
    marked = [chr(i) for i in range(0xC0, 0x250) if len(d := unicodedata.normalize("NFD", chr(i))) > 1 and d[0].isascii()]
    return "".join(marked), "".join(unicodedata.normalize("NFD", c)[0] for c in marked)


_MARKED, _PLAIN = _unmarked()


def plain(text: Column, case: bool = False, diacritics: bool = True) -> Column:
    """The text in lower case (unless `case` counts), and without marks of Latin letters unless these count."""
    text = text if case else F.lower(text)
    return text if diacritics else F.translate(F.regexp_replace(text, r"\p{Mn}+", ""), _MARKED, _PLAIN)


def tokens(text: Column, diacritics: bool = True, case: bool = False) -> Column:
    """Words of two letters or more that are no stop words."""
    words = F.split(plain(text, case, diacritics), r"\W+")
    return F.filter(words, lambda t: (F.char_length(t) >= 2) & ~F.lower(t).isin(*STOP_WORDS))


@dataclass
class TextQuery:
    terms: list[str] = field(default_factory=list)
    phrases: list[list[str]] = field(default_factory=list)
    negated: list[str] = field(default_factory=list)

    @classmethod
    def parse(cls, query: str, case: bool = False, diacritics: bool = True) -> TextQuery:
        """Quoted phrases, words after a minus, and terms."""
        if not diacritics:
            query = "".join(c for c in unicodedata.normalize("NFD", query) if not unicodedata.combining(c))
        query = query if case else query.lower()
        split = lambda s: [t for t in re.split(r"[^A-Za-z0-9_]+", s) if len(t) >= 2 and t.lower() not in STOP_WORDS]
        phrases = [p for p in (split(m) for m in re.findall(r'"([^"]+)"', query)) if p]
        words = re.sub(r'"[^"]+"', "", query).split()
        negated = [w[1:] for w in words if w.startswith("-") and len(w) > 2 and w[1:].lower() not in STOP_WORDS]
        terms = [t for w in words if not (w.startswith("-") and len(w) > 1) for t in split(w)]
        return cls(terms, phrases, negated)


def _weights(fields: dict[str, float] | list[str]) -> dict[str, float]:
    return fields if isinstance(fields, dict) else dict.fromkeys(fields, 1.0)


def matches(query: str, fields: list[Column], case: bool = False, diacritics: bool = True) -> Column:
    """Whether a row's texts match a query, as a predicate on the row alone: no index and no join."""
    q = TextQuery.parse(query, case, diacritics)
    words = F.concat(*[tokens(F.coalesce(f.cast("string"), F.lit("")), diacritics, case) for f in fields])
    has = lambda ts: F.arrays_overlap(words, F.array(*map(F.lit, ts)))
    keep = F.lit(bool(q.terms or q.phrases))
    if q.terms:
        keep = keep & has(q.terms)
    for t in dict.fromkeys(t for p in q.phrases for t in p):
        keep = keep & has([t])
    return keep & ~has(q.negated) if q.negated else keep


def _starts(items: Column, same: Callable[[Column], Column] = lambda x: x) -> Column:
    """The places where an element of a sorted array differs from the one before."""
    return F.filter(F.transform(items, lambda x, i: F.when((i == 0) | (same(x) != same(F.get(items, i - 1))), i)), lambda i: i.isNotNull())


def _run(items: Column, starts: Column, s: Column, j: Column) -> Column:
    """The length of the run that begins at s, the place j of `starts`."""
    return F.coalesce(F.get(starts, j + 1), F.size(items)) - s


def postings(df: DataFrame, key: str, fields: dict[str, float] | list[str], case: bool = False, diacritics: bool = True, wanted: set[str] | None = None) -> DataFrame:
    """(key, term, tf, weight, length): how often a document has a term, the mean weight of the fields that have it, and the
    document's number of terms. Only `wanted` terms are taken, if given.

    Each row is a document. Its words are sorted and counted within the row, so nothing is moved, and a task holds one document's
    words at a time. What a lambda looks up is a column of the step before, named twice or more, so it is computed once a row.
    """
    weights = _weights(fields)
    n = range(len(weights))
    rows = df.select(F.col(key).alias("key"), *[tokens(F.coalesce(F.col(f), F.lit("")), diacritics, case).alias(f"w{j}") for j, f in enumerate(weights)])
    kept = lambda j: F.filter(f"w{j}", lambda t: t.isin(*wanted)) if wanted is not None else F.col(f"w{j}")
    rows = rows.select("key", sum((F.size(f"w{j}") for j in n), F.lit(0)).alias("length"), *[F.sort_array(kept(j)).alias(f"w{j}") for j in n])
    rows = rows.select("*", *[_starts(F.col(f"w{j}")).alias(f"s{j}") for j in n])

    def counts(w: Column, starts: Column, weight: float) -> Column:
        return F.transform(starts, lambda s, j: F.struct(F.get(w, s).alias("term"), _run(w, starts, s, j).cast("long").alias("tf"), F.lit(float(weight)).alias("weight")))

    by_field = [counts(F.col(f"w{j}"), F.col(f"s{j}"), w) for j, w in enumerate(weights.values())]
    if len(weights) == 1:
        rows = rows.select("key", "length", by_field[0].alias("terms"))
    else:
        rows = rows.select("key", "length", F.sort_array(F.concat(*by_field)).alias("c"))
        rows = rows.select("*", _starts(F.col("c"), lambda x: x["term"]).alias("s"))
        runs = F.transform("s", lambda s, j: F.slice("c", s + 1, _run(F.col("c"), F.col("s"), s, j)))
        added = lambda g, name, zero: F.aggregate(g, zero, lambda x, y: x + y[name])
        one = lambda g: F.struct(F.get(g, 0)["term"].alias("term"), added(g, "tf", F.lit(0).cast("long")).alias("tf"), (added(g, "weight", F.lit(0.0)) / F.size(g)).alias("weight"))
        rows = rows.select("key", "length", F.transform(runs, one).alias("terms"))
    # A plain explode would push size(terms) > 0 below all of this, with the arrays computed anew for each element.
    return rows.select("key", "length", F.explode_outer("terms").alias("t")).where("t IS NOT NULL").select("key", "length", "t.term", "t.tf", "t.weight")


def search(df: DataFrame, key: str, fields: dict[str, float] | list[str], query: str, index: DataFrame | None = None, case: bool = False, diacritics: bool = True) -> DataFrame:
    """(key, score) of the documents that match, best first.

    Terms are alternatives; of a phrase all words must be there, of every phrase; a negated word must not. A term scores
    tf / length * (ln((N + 1) / (df + 1)) + 1) * weight, words of phrases half as much again. With stored postings (`index`) only
    those of the query's words are read. Without, each document's words are counted in its own row: nothing but the matching documents'
    counts is moved, and the frequencies of the words and of all documents come from one aggregate over the same pass.
    """
    q = TextQuery.parse(query, case, diacritics)
    wanted = list(dict.fromkeys([*q.terms, *(t for p in q.phrases for t in p), *q.negated]))
    scored = [t for t in wanted if t in q.terms or any(t in p for p in q.phrases)]
    if not scored:
        return df.select(F.col(key), F.lit(0.0).alias("score")).limit(0)
    if index is not None:
        total = df.count()
        rows = index.where(F.col("term").isin(*wanted)).groupBy("key", "length").agg(F.map_from_entries(F.collect_list(F.struct("term", F.struct("tf", "weight")))).alias("m"))
        found = rows.select("key", "length", *[F.struct(F.coalesce(F.col("m")[t]["tf"], F.lit(0)).alias("tf"), F.col("m")[t]["weight"].alias("weight")).alias(f"t{i}") for i, t in enumerate(wanted)])
        freq = found.agg(*[F.sum((F.col(f"t{i}.tf") > 0).cast("long")).alias(f"d{i}") for i in range(len(wanted))]).first()
    else:
        weights = _weights(fields)
        words = {f: tokens(F.coalesce(F.col(f), F.lit("")), diacritics, case) for f in weights}
        rows = df.select(F.col(key).alias("key"), *[w.alias(f"w{j}") for j, w in enumerate(words.values())])
        count = lambda t, j: F.size(F.filter(f"w{j}", lambda x: x == F.lit(t)))
        n = range(len(weights))
        length = sum((F.size(f"w{j}") for j in n), F.lit(0))
        rows = rows.select("key", length.alias("length"), *[F.array(*[count(t, j) for j in n]).alias(f"c{i}") for i, t in enumerate(wanted)])
        by_weight = F.array(*[F.lit(float(w)) for w in weights.values()])
        total_of = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)

        def term(i: int) -> Column:
            c = F.col(f"c{i}")
            there = F.transform(c, lambda x: (x > 0).cast("double"))
            return F.struct(total_of(F.transform(c, lambda x: x.cast("double"))).alias("tf"), F.try_divide(total_of(F.zip_with(there, by_weight, lambda x, y: x * y)), total_of(there)).alias("weight")).alias(f"t{i}")

        every = materialize(rows.select("key", "length", *[term(i) for i in range(len(wanted))]))
        freq = every.agg(F.count(F.lit(1)).alias("total"), *[F.sum((F.col(f"t{i}.tf") > 0).cast("long")).alias(f"d{i}") for i in range(len(wanted))]).first()
        total, found = freq.total, every
    has = lambda t: F.col(f"t{wanted.index(t)}.tf") > 0
    any_of = lambda ts: reduce(or_, [has(t) for t in ts])
    keep, score = F.lit(True), F.lit(0.0)
    if q.terms:
        keep = keep & any_of(q.terms)
    for p in q.phrases:
        keep = keep & reduce(and_, [has(t) for t in p])
    if q.negated:
        keep = keep & ~any_of(q.negated)
    for t in scored:
        i = wanted.index(t)
        times = q.terms.count(t) + PHRASE_BONUS * sum(p.count(t) for p in q.phrases)
        idf = math.log((total + 1) / ((freq[f"d{i}"] or 0) + 1)) + 1
        score = score + F.when(has(t), F.col(f"t{i}.tf") / F.col("length") * F.lit(idf) * F.col(f"t{i}.weight") * F.lit(float(times))).otherwise(0.0)
    return found.where(keep).select(F.col("key").alias(key), score.alias("score")).orderBy(F.desc("score"), F.asc(key))
