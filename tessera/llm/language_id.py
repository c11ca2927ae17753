"""Language ID by rank-order profiles.

Each language's profile is its `profile` most frequent 1- to 3-grams over all its training texts.
A text gets the language whose profile is nearest to its own by out-of-place distance: for each of the
text's most frequent n-grams the difference of ranks, or `profile` where the language lacks it.

N-grams are of lower-cased letters, anything else being one blank between words; an n-gram holds a
blank only at its ends. Ties among n-grams go to smaller code points, ties among languages to the smaller name.

A null text, one without a letter, or any text when nothing was learned, gives `und` and score 0. Rows with a
null language or text teach nothing. Repeated rows count each time. Extra columns aren't read; an empty table gives no profiles and no
rows. A long text is read in parts cut at blanks, whose counts are added up.
The languages' profiles (`profile` n-grams for each of at most `max_languages`) are all that reaches the driver.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import slices

_BITS = 21
_BLANK = re.compile(r"\s")


@functools.cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def ngrams(text: str) -> np.ndarray:
    """Every 1- to 3-gram of the text, packed into one number each."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    letter = _letters()[code]
    if not letter.any():
        return np.zeros(0, dtype=np.int64)
    code = np.r_[32, np.where(letter, code, 32), 32]
    blank = code == 32
    keep = np.r_[True, ~(blank[1:] & blank[:-1])]
    code, blank = code[keep], blank[keep]
    two = (code[:-1] << _BITS) | code[1:]
    three = ((two[:-1] << _BITS) | code[2:])[~blank[1:-1]]
    return np.concatenate([code[~blank], two, three])


def pieces(text: str, size: int = 1 << 16) -> Iterator[str]:
    """A text in parts of about that many characters, cut behind a blank: no n-gram holds one inside. A longer word stays whole."""
    at = 0
    while at < len(text):
        to = at + size
        if to < len(text):
            blank = _BLANK.search(text, to)
            to = blank.end() if blank else len(text)
        yield text[at:to]
        at = to


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a text and how often each occurs, part by part."""
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for part in pieces(text):
        found, n = np.unique(ngrams(part), return_counts=True)
        if not len(keys):
            keys, counts = found, n
            continue
        keys, at = np.unique(np.concatenate([keys, found]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([counts, n]), len(keys)).astype(np.int64)
    return keys, counts


def profile_of(found: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    if len(found) > n:
        least = np.partition(count, len(count) - n)[len(count) - n]
        some = count >= least
        found, count = found[some], count[some]
    return found[np.lexsort((found, -count))][:n]


class _Counts:
    """N-gram counts of one language, merged whenever many are waiting."""

    def __init__(self) -> None:
        self.keys, self.counts, self.waiting, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def add(self, keys: np.ndarray) -> None:
        self.waiting.append(keys)
        self.n += len(keys)
        if self.n > 1 << 21:
            self.merge()

    def merge(self) -> None:
        if self.waiting:
            found, count = np.unique(np.concatenate(self.waiting), return_counts=True)
            keys, at = np.unique(np.concatenate([self.keys, found]), return_inverse=True)
            self.counts = np.bincount(at, np.concatenate([self.counts, count]), len(keys)).astype(np.int64)
            self.keys, self.waiting, self.n = keys, [], 0


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", profile: int = 400, max_languages: int = 10_000) -> dict[str, np.ndarray]:
    """Each language's n-grams by rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, _Counts] = {}

        def flush(lang: str) -> pa.RecordBatch:
            c = counts.pop(lang)
            c.merge()
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(c.keys)), pa.array(c.keys), pa.array(c.counts)], ["lang", "gram", "n"])

        for batch in (part for whole in batches for part in slices(whole, 1)):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for part in pieces(text):
                    if len(keys := ngrams(part)):
                        counts.setdefault(lang, _Counts()).add(keys)
            for lang in [x for x, c in counts.items() if len(c.keys) > 1 << 20]:
                yield flush(lang)
        for lang in list(counts):
            yield flush(lang)

    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    counts = rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    ranked = counts.withColumn("r", F.row_number().over(best)).where(F.col("r") <= profile)
    found = ranked.select("lang", "r", "gram").limit(profile * max_languages + 1).collect()
    if len(found) > profile * max_languages:
        raise ValueError(f"more than {max_languages} languages")
    out: dict[str, list] = {}
    for r in sorted(found):
        out.setdefault(r.lang, []).append(r.gram)
    return {k: np.array(v, dtype=np.int64) for k, v in out.items()}


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], text_col: str = "text", profile: int = 400) -> Column:
    """A struct column (lang, score) for the text."""
    names = sorted(profiles)
    by_key = [(np.sort(profiles[n]), np.argsort(profiles[n], kind="stable")) for n in names]

    def one(text: str | None) -> tuple[str, float]:
        keys, count = counted(text) if text else (np.zeros(0), None)
        if not len(keys) or not names:
            return "und", 0.0
        own = profile_of(keys, count, profile)
        rank, far = np.arange(len(own)), []
        for ordered, place in by_key:
            at = np.minimum(np.searchsorted(ordered, own), len(ordered) - 1)
            far.append(int(np.where(ordered[at] == own, np.abs(place[at] - rank), profile).sum()))
        best = int(np.argmin(far))
        second = min((x for i, x in enumerate(far) if i != best), default=profile * len(own))
        return names[best], 1 - far[best] / second if second else 0.0

    @F.arrow_udf("struct<lang:string,score:double>")
    def run(texts: pa.Array) -> pa.Array:
        made = [one(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays([pa.array([x for x, _ in made], pa.string()), pa.array([x for _, x in made], pa.float64())], ["lang", "score"])

    return run(F.col(text_col).cast("string"))


def op7(spark, sf_dir: str) -> DataFrame:
    from tessera.llm.common import table

    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)))
    profiles = learn(docs.where("NOT held_out"))
    out = docs.select("doc_id", "held_out", predict(docs, profiles).alias("p"))
    return out.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))
