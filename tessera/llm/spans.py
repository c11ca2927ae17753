"""Spans of patterns as DataFrame expressions: matches with their places, masking and digests.

Spark gives the matches of a pattern but not where they are. Splitting a text at the matches gives the
gaps between them, and running sums of the lengths of both give the places, in code points. Running values are made
by doubling (n log n for n matches), and masking cuts pieces out of a fixed-width copy of the text, so a text of any
length with any number of matches costs about in proportion to both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def running(values: Column, n: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """The values of an int array merged with all before them. `n` is the array's size (at least 1), `merge` takes null as nothing.

    Each step merges every value with the one 2^k places before it.
    """

    def step(acc: Column, k: Column) -> Column:
        shift = F.least(F.call_function("shiftleft", F.lit(1), k), F.size(acc))
        before = F.concat(F.array_repeat(F.lit(None).cast("int"), shift), F.slice(acc, F.lit(1), F.size(acc) - shift))
        return F.zip_with(acc, before, merge)

    return F.when(n > 1, F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(n)).cast("int") - 1), values, step)).otherwise(values)


def _sum(x: Column, y: Column) -> Column:
    return x + F.coalesce(y, F.lit(0))


def located(df: DataFrame, name: str, pattern: str, text: str = "_text", context: int = 0) -> DataFrame:
    """df with an array column of the pattern's matches, struct<start, end, hit>. With `context`, also `before` and
    `after`: up to that many characters on each side, as far as the neighbouring match."""
    hits, gaps, ends = (f"_{name}_{x}" for x in ("hits", "gaps", "ends"))
    df = df.withColumn(hits, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    df = df.withColumn(gaps, F.when(F.size(hits) > 0, F.split(text, pattern, -1)))
    lengths = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.char_length(g) + F.char_length(h))
    df = df.withColumn(ends, F.when(F.size(hits) > 0, running(lengths, F.size(hits), _sum)))

    def place(h: Column, i: Column) -> Column:
        end = F.get(ends, i)
        near = [F.right(F.get(gaps, i), F.lit(context)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(context)).alias("after")] if context else []
        return F.struct((end - F.char_length(h)).alias("start"), end.alias("end"), h.alias("hit"), *near)

    return df.withColumn(name, F.transform(hits, place)).drop(hits, gaps, ends)


def text_of(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, spans: Column, mask: str) -> Column:
    """The text with `mask` in place of what any of the spans (sorted by start) covers; overlapping
    and touching spans give one mask."""
    n = F.size(spans)
    reach = running(F.transform(spans, lambda s: s["end"]), n, lambda x, y: F.greatest(x, y))
    # Four bytes a character, so that a piece is cut out by its place. A blank in front keeps a leading U+FEFF from
    # being taken for a byte order mark.
    wide = F.encode(F.concat(F.lit(" "), text), "UTF-32")
    blank = F.encode(F.lit(" "), "UTF-32")

    def piece(x: Column, start: Column, end: Column) -> Column:
        bits = F.substring(x["wide"], 4 * start + 5, 4 * (end - start))
        return F.substring(F.decode(F.concat(blank, bits), "UTF-32"), F.lit(2), end - start)

    def whole(x: Column) -> Column:
        reached = lambda i: F.when(i > 0, F.get(x["reach"], i - 1)).otherwise(F.lit(0))
        pieces = F.transform(spans, lambda s, i: F.when((i == 0) | (s["start"] > reached(i)), piece(x, reached(i), s["start"])))
        last = piece(x, F.element_at(x["reach"], -1), F.char_length(text))
        return F.array_join(F.concat(F.filter(pieces, lambda p: p.isNotNull()), F.array(last)), mask)

    made = F.get(F.transform(F.array(F.struct(wide.alias("wide"), reach.alias("reach"))), whole), 0)
    return F.when(n > 0, made).otherwise(text)
