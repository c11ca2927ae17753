"""LM scoring with Brown class-based bigrams.

Words of the training texts are counted on the cluster. The most frequent ones are put into classes by exchange
clustering, each moving to the class that raises the likelihood of the class bigrams most: one at a time on the driver
for the first `clustered` as a start, then for the first `exchanged` in Spark jobs over the table of their bigrams, half of the words at a time
(moves made at once may undo each other), until a sweep gains less than a thousandth or after `sweeps`; the best classes stay. Every other training
word, however many there are, gets the class that its exchanged neighbours make likeliest, by its bigram counts in a table.
Unknown words have one class, the end of a text its own. A token's probability is that of
its class after the class before it, smoothed towards the class's own share, times that of the word in its class. Class bigrams are counted over
all neighbours in all training texts, once every word has its class.

The driver and the tasks hold the classes and counts of the `dictionary` most frequent words only (a bounded number). Those of the remaining words stay
in a table on the cluster, as large as the corpus makes it; the rare words of the documents join it, a row for each place where one stands.

A null or empty text is one end token. A null id trains (held_out is false) and keeps its row. Repeated rows
train each time and get a row each, with equal scores. Words of equal count enter the dictionary by their bytes; of equally good classes the
first is taken. With no training text every word is unknown and scores stay finite; an empty table gives an empty one. Columns other
than the id and the text are not read. Texts are read whole, a few at a time.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import as_bytes, materialize, quoted, slices, words_ascii_lower

_END = b""  # no word is empty
_FLUSH = 1 << 18


def count_tokens(docs: DataFrame, text_col: str) -> DataFrame:
    """(word, n) over all texts, the end token included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return out

        for batch in (part for whole in batches for part in slices(whole, 0)):
            for text in as_bytes(batch.column(0)):
                counts.update(words_ascii_lower(text))
                counts[_END] += 1
                if len(counts) > _FLUSH:
                    yield flush()
        if counts:
            yield flush()

    return docs.select(F.col(text_col).cast("string")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def exchange(bigrams: np.ndarray, fixed: np.ndarray, classes: int, sweeps: int = 6) -> np.ndarray:
    """Classes of the words. `fixed` holds a class for words that don't move, -1 for the others;
    these start in classes 0 .. classes-1 by rank and move where the likelihood is highest."""
    n = len(bigrams)
    movable = np.flatnonzero(fixed < 0)
    label = fixed.copy()
    label[movable] = np.arange(len(movable)) % classes
    total = int(label.max(initial=0)) + 1
    member = np.zeros((n, total))
    member[np.arange(n), label] = 1
    right, left = bigrams @ member, bigrams.T @ member  # word before each class, word after each class
    between = member.T @ right
    h = lambda x: x * np.log(np.maximum(x, 1))

    def gain(row: np.ndarray, col: np.ndarray, own: float, between: np.ndarray) -> np.ndarray:
        """Change of the likelihood when a word with these class bigrams enters each movable class."""
        k = np.arange(classes)
        after_row, after_col = between[k] + row, between[:, k].T + col
        delta = (h(after_row) - h(between[k])).sum(1) + (h(after_col) - h(between[:, k].T)).sum(1)
        # the class's own cell is in both sums, and gets the word's bigrams with itself as well
        d = between[k, k]
        delta += -(h(d + row[k]) - h(d)) - (h(d + col[k]) - h(d)) + h(d + row[k] + col[k] + own) - h(d)
        # wherever the word goes, its neighbours' classes get its bigrams back
        out, into = (between.sum(1) + col)[k], (between.sum(0) + row)[k]
        all_out, all_in = row.sum() + own, col.sum() + own
        return delta - (h(out + all_out) - h(out)) - (h(into + all_in) - h(into))

    for _ in range(sweeps):
        moved = 0
        for w in movable.tolist():
            old, own = label[w], bigrams[w, w]
            row, col = right[w].copy(), left[w].copy()
            row[old] -= own
            col[old] -= own
            # row and col now have no bigrams of the word with itself
            between[old] -= row
            between[:, old] -= col
            between[old, old] -= own
            score = gain(row, col, own, between)
            new = int(score.argmax())
            if score[new] <= score[old] + 1e-9:
                new = old
            between[new] += row
            between[:, new] += col
            between[new, new] += own
            if new != old:
                moved += 1
                label[w] = new
                right[:, old] -= bigrams[:, w]
                right[:, new] += bigrams[:, w]
                left[:, old] -= bigrams[w]
                left[:, new] += bigrams[w]
        if not moved:
            break
    return label


@dataclass
class Model:
    ids: _Ids  # dictionary words; the end token is 0, any other word len(ids)
    n: np.ndarray  # training counts by id
    label: np.ndarray  # class by id, the last one that of words outside
    step: np.ndarray  # log10 of each class after each class
    emit: np.ndarray  # by id: log10 of the word in its class; 0 for words outside
    tokens: int  # training tokens
    types: int  # different ones
    exchanged: int  # the ids up to this one have their classes by exchange
    between: np.ndarray  # class bigrams

    @property
    def total(self) -> int:
        """Number of classes: the words', then the end's, then that of unknown words."""
        return len(self.step)

    @property
    def base_norm(self) -> float:
        return float(np.log10(self.tokens + 0.5 * (self.types + 1)))


class _Ids(dict):
    """Ids of words; any other word has the number of ids."""

    def __missing__(self, word: bytes) -> int:
        return len(self)


def _sequences(texts: list[bytes], ids: _Ids) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Ids of all tokens of some texts, each text's closed by the end's 0, each text's number of tokens, and the tokens."""
    tokens, lengths = [], []
    for t in texts:
        w = words_ascii_lower(t)
        tokens += w
        tokens.append(_END)
        lengths.append(len(w) + 1)
    return np.fromiter(map(ids.__getitem__, tokens), np.int64, len(tokens)), np.array(lengths, dtype=np.int64), tokens


def _parts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from slices(batch, column)


def _encoded(rows: DataFrame, ids: _Ids) -> DataFrame:
    """rows (key, held_out, ..., text) with, in place of the text, the ids of its tokens as packed 32-bit numbers (the end's 0 last, `other` = len(ids)
    for words outside) and those words, blank between them. Texts are cut into words once, and every later pass reads numbers."""
    shared, kept = rows.sparkSession.sparkContext.broadcast(ids), [c for c in rows.columns if c != "text"]
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        other = len(shared.value)
        for batch in _parts(batches, len(kept)):
            flat, lengths, tokens = _sequences(as_bytes(batch.column(len(kept))), shared.value)
            ends = np.cumsum(lengths)
            packed, own = flat.astype("<i4"), np.flatnonzero(flat == other)
            cuts = np.searchsorted(own, np.r_[0, ends])
            words, own = [tokens[i] for i in own.tolist()], []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                own.append(b" ".join(words[a:b]))
            numbers = [packed[a:b].tobytes() for a, b in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(numbers, pa.binary()), pa.array(own, pa.binary())], [*kept, "ids", "words"])

    return rows.select(*kept, "text").mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in kept), "ids binary", "words binary"]))


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all tokens of the batch's texts, and each text's number of tokens."""
    column = batch.column(batch.schema.get_field_index("ids"))
    blobs = column.to_pylist()
    return np.frombuffer(b"".join(blobs), "<i4").astype(np.int64), np.array([len(x) // 4 for x in blobs], dtype=np.int64)


def _rare_words(batch: pa.RecordBatch) -> list[bytes]:
    """The words outside the dictionary of all texts, in order."""
    return [w for x in batch.column(batch.schema.get_field_index("words")).to_pylist() if x for w in x.split(b" ")]


def _small(batches: Iterator[pa.RecordBatch], column: str = "ids") -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from slices(batch, batch.schema.get_field_index(column), rows=2000)


def _bigrams(encoded: DataFrame, some: int) -> DataFrame:
    """(a, b, n) of neighbours whose ids are both under `some`, dealt by the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held = [], 0

        def flush() -> pa.RecordBatch:
            at, n = np.unique(np.concatenate(waiting), return_counts=True)
            waiting.clear()
            return pa.RecordBatch.from_arrays([pa.array((at // some).astype(np.int32)), pa.array((at % some).astype(np.int32)), pa.array(n)], ["a", "b", "n"])

        for batch in _small(batches):
            flat, _ = _unpacked(batch)
            before = np.r_[0, flat[:-1]]
            both = (before < some) & (flat < some)
            waiting.append(before[both] * some + flat[both])
            held += len(flat)
            if held > 1 << 23:
                yield flush()
                held = 0
        if waiting:
            yield flush()

    found = encoded.select("ids").mapInArrow(run, "a int, b int, n long")
    # Added up by both words first: a common word's rows from all tasks would be too many for one.
    return found.groupBy("a", "b").agg(F.sum("n").alias("n")).repartition("a")


def _neighbours_of(pairs: DataFrame, own: int, label: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, class, n): the classes of the neighbours of the word in column `own` of the pairs. The pairs are dealt by that word, so there are at
    most as many rows as words times classes, and the driver gets them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(len(label) * total, dtype=np.int64)
        for batch in batches:
            word, near, n = batch.column(own).to_numpy(), label[batch.column(1 - own).to_numpy()], batch.column(2).to_numpy()
            keep = near >= 0
            cells += np.bincount(word[keep].astype(np.int64) * total + near[keep], n[keep], len(cells)).astype(np.int64)
        at = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array((at // total).astype(np.int32)), pa.array((at % total).astype(np.int32)), pa.array(cells[at])], ["word", "near", "n"])

    found = pairs.mapInArrow(run, "word int, near int, n long").toArrow()
    return tuple(found[c].to_numpy() for c in ("word", "near", "n"))


def _weights(between: np.ndarray) -> np.ndarray:
    """What a neighbour of each class after a word (first), or before it, adds to the likelihood of each class of the word."""
    total = len(between)
    used = total - 2
    after = np.log((between[:used] + 0.5) / (between[:used].sum(1) + 0.5 * total)[:, None]).T
    ahead = np.log((between[:, :used] + 0.5) / (between[:, :used].sum(0) + 0.5 * total))
    return np.r_[after, ahead]


def _choose(vectors: DataFrame, between: np.ndarray) -> DataFrame:
    """(word, label): the class where each word's bigrams with its neighbours' classes (word, slot, n) are likeliest."""
    total, weight = len(between), _weights(between)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(at, 1000) for at in range(0, whole.num_rows, 1000)):
                cells = batch.column(1)
                flat, lengths = cells.flatten(), np.diff(cells.offsets.to_numpy())
                slot, n = flat.field("slot").to_numpy(), flat.field("n").to_numpy()
                own = np.repeat(np.arange(len(lengths)), lengths)
                by_slot = np.zeros((len(lengths), 2 * total))
                by_slot[own, slot] = n
                value = by_slot @ weight
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(value.argmax(1).astype(np.int32))], ["word", "label"])

    # `vectors` are dealt by word already, so neither step moves rows.
    summed = vectors.groupBy("word", "slot").agg(F.sum("n").alias("n"))
    return summed.groupBy("word").agg(F.collect_list(F.struct("slot", "n")).alias("cells")).mapInArrow(run, f"word {dict(vectors.dtypes)['word']}, label int")


def _likelihood(between: np.ndarray) -> float:
    h = lambda x: (x * np.log(np.maximum(x, 1))).sum()
    return float(h(between) - h(between.sum(0)) - h(between.sum(1)) + h(between.sum()))


def _exchange_all(pairs: tuple[DataFrame, DataFrame], label: np.ndarray, total: int, sweeps: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all words of the pairs (those at -1 have none yet; the first, the end, stays) and the class bigrams. The pairs come dealt by their first
    and by their second word."""
    fresh = label < 0
    best = None
    for k in range(sweeps + 1):
        near = np.zeros((len(label), 2 * total))
        for own, table in enumerate(pairs):
            word, slot, n = _neighbours_of(table, own, label, total)
            np.add.at(near, (word, slot + own * total), n)
        between = np.zeros((total, total))
        np.add.at(between, label[label >= 0], near[label >= 0, :total])
        # The start has no classes but for some words, so its likelihood isn't comparable.
        gained = _likelihood(between) if k else -np.inf
        if best is None or gained > best[0]:
            small = k > 1 and gained < best[0] + least * abs(best[0])
            best = (gained, label, between)
        else:
            small = True
        if k == sweeps or small or len(label) < 2:
            break
        moves = fresh.copy() if not k and fresh.any() else np.arange(len(label)) % 2 == k % 2
        moves[0] = False
        label = label.copy()
        # Words that stand beside no classed one get the first class.
        label[moves] = (near[moves] @ _weights(between)).argmax(1)
    return best[1], best[2]


def _outside(encoded: DataFrame, other: int, label: np.ndarray, total: int) -> DataFrame:
    """(id, word, before, after, n) of the words without a class yet: the id of those in the dictionary, the word itself of others; and the classes
    on both sides, or -1."""
    exchanged = len(label)
    classes = np.r_[label, np.full(other + 1 - exchanged, -1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        waiting, held = [], 0
        empty = lambda n, t: pa.nulls(n, t)

        def of(keys: np.ndarray) -> list[pa.Array]:
            return [pa.array((keys // (total + 1) - 1).astype(np.int32)), pa.array((keys % (total + 1) - 1).astype(np.int32))]

        def flush_words() -> pa.RecordBatch:
            words, around = zip(*seen)
            out = [empty(len(words), pa.int32()), pa.array(words, pa.binary()), *of(np.array(around, dtype=np.int64)), pa.array(list(seen.values()), pa.int64())]
            seen.clear()
            return pa.RecordBatch.from_arrays(out, ["id", "word", "before", "after", "n"])

        def flush_ids() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(waiting), return_counts=True)
            waiting.clear()
            width = (total + 1) ** 2
            return pa.RecordBatch.from_arrays([pa.array((keys // width).astype(np.int32)), empty(len(keys), pa.binary()), *of(keys % width), pa.array(n)], ["id", "word", "before", "after", "n"])

        for batch in _small(batches):
            flat, _ = _unpacked(batch)
            cls = classes[flat]
            at = np.flatnonzero(flat >= exchanged)
            before = np.where(at > 0, cls[at - 1], label[0])
            around = (before + 1) * (total + 1) + cls[np.minimum(at + 1, len(cls) - 1)] + 1
            rare = flat[at] == other
            seen.update(zip(_rare_words(batch), around[rare].tolist()))
            waiting.append(flat[at[~rare]] * (total + 1) ** 2 + around[~rare])
            held += len(waiting[-1])
            if len(seen) > 2 * _FLUSH:
                yield flush_words()
            if held > 1 << 21:
                yield flush_ids()
                held = 0
        if seen:
            yield flush_words()
        if waiting:
            yield flush_ids()

    return encoded.select("ids", "words").mapInArrow(run, "id int, word binary, before int, after int, n long")


def _ids_by_neighbours(outside: DataFrame, first: int, last: int, total: int, between: np.ndarray) -> np.ndarray:
    """Classes of the dictionary's words from one id to another by the classes on both sides of them. Their rows are dealt by id, and a task adds them up
    in a matrix, of bounded size as the dictionary is."""
    weight = _weights(between).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(last - first + 1, -1, dtype=np.int32)
        near, used = np.zeros((1024, 2 * total), dtype=np.float32), 0
        for batch in batches:
            word, before, after, n = (batch.column(c).to_numpy() for c in range(4))
            word = word - first
            new = np.unique(word[place[word] < 0])
            place[new] = np.arange(used, used + len(new))
            used += len(new)
            if used > len(near):
                near = np.concatenate([near, np.zeros((max(used - len(near), len(near)), 2 * total), dtype=np.float32)])
            for slot, shift in ((after, 0), (before, total)):
                keep = slot >= 0
                np.add.at(near, (place[word[keep]], slot[keep] + shift), n[keep])
        found = np.flatnonzero(place >= 0)
        yield pa.RecordBatch.from_arrays([pa.array((found + first).astype(np.int32)), pa.array((near[place[found]] @ weight).argmax(1).astype(np.int32))], ["word", "label"])

    rows = outside.where("id IS NOT NULL").select("id", "before", "after", F.col("n").cast("int")).repartition("id")
    found = rows.mapInArrow(run, "word int, label int").toArrow()
    label = np.zeros(last - first + 1, dtype=np.int64)
    label[found["word"].to_numpy() - first] = found["label"].to_numpy()
    return label


def _by_neighbours(outside: DataFrame, total: int, between: np.ndarray) -> DataFrame:
    """(word, label) of words by the classes on both sides of them; words with none take part with no weight."""
    # Moved once, a row for both sides.
    rows = outside.where("word IS NOT NULL").select("word", "before", "after", F.col("n").cast("int")).repartition("word")
    slots = F.array_compact(F.array(F.when(F.col("after") >= 0, F.col("after")), F.when(F.col("before") >= 0, F.col("before") + total)))
    slots = F.when(F.size(slots) > 0, F.transform(slots, lambda s: F.struct(s.alias("slot"), F.col("n").alias("n")))).otherwise(F.array(F.struct(F.lit(0).alias("slot"), F.lit(0).alias("n"))))
    return _choose(rows.select("word", F.explode(slots).alias("x")).select("word", "x.slot", "x.n"), between)


def _most_frequent(counts: DataFrame, most: int) -> pa.Table:
    """(word, n) of the most frequent words but the end, those of equal count by their bytes. A table of how many words have each count tells
    from which count on all are in, so only the ties there are sorted."""
    words = counts.where(F.length("word") > 0)
    held, least = 0, 0
    for r in words.groupBy("n").agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("n")).limit(most).toLocalIterator():
        if held + r.k > most:
            least = r.n
            break
        held += r.k
    found = words.where(F.col("n") > least).toArrow()
    if least and held < most:
        found = pa.concat_tables([found, words.where(F.col("n") == least).orderBy("word").limit(most - held).toArrow()])
    return found.sort_by([("n", "descending"), ("word", "ascending")])


def _rows(docs: DataFrame, text_col: str) -> DataFrame:
    text = F.col(quoted(text_col))
    return docs.select(F.xxhash64(text).alias("key"), F.lit(False).alias("held_out"), text.cast("string").alias("text"))


def train(counts: DataFrame, docs: DataFrame, text_col: str, **settings) -> Model:
    """The model with a class for each dictionary word; its transitions are those of the exchanged words yet."""
    return _train(counts, _rows(docs, text_col), **settings)[0]


def _train(counts: DataFrame, rows: DataFrame, clustered: int = 2048, exchanged: int = 20_000, dictionary: int = 400_000, classes: int = 64, smoothing: float = 20.0, sweeps: int = 3, least: float = 1e-3) -> tuple[Model, DataFrame, DataFrame]:
    """The same, the table of `_outside`, and all rows encoded; those not held out train."""
    tokens, types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    top = _most_frequent(counts, dictionary)
    ends = counts.where(F.length("word") == 0).collect()
    ids = _Ids({_END: 0} | {w: i for i, w in enumerate(top["word"].to_pylist(), 1)})
    n = np.r_[float(ends[0].n if ends else 0), top["n"].to_numpy().astype(np.float64)]
    some = range(min(len(ids), exchanged + 1))  # the ids of the words that are exchanged, and the end's
    first, used = min(clustered, len(ids) - 1), min(classes, max(1, min(clustered, len(ids) - 1)))
    total = used + 2
    encoded = materialize(_encoded(rows, ids))
    training = encoded.where("NOT held_out")
    by_first = materialize(_bigrams(training, len(some)))
    by_second = materialize(by_first.repartition("b"))
    bigrams = np.zeros((first + 1, first + 1))
    near = by_first.where((F.col("a") <= first) & (F.col("b") <= first)).toArrow()
    bigrams[near["a"].to_numpy(), near["b"].to_numpy()] = near["n"].to_numpy()
    fixed = np.full(first + 1, -1)
    fixed[0] = used
    label = np.r_[exchange(bigrams, fixed, used), np.full(len(some) - first - 1, -1)]
    label, between = _exchange_all((by_first, by_second), label, total, sweeps, least)
    outside = materialize(_outside(training, len(ids), label, total))
    if len(some) < len(ids):
        label = np.r_[label, _ids_by_neighbours(outside, len(some), len(ids) - 1, total, between)]
    model = Model(ids, n, np.r_[label, total - 1], between, np.zeros(len(ids) + 1), int(tokens), int(types), len(some) - 1, between)
    return _estimated(model, between, np.bincount(label, n, total), smoothing), outside.where("word IS NOT NULL"), encoded


def _estimated(model: Model, between: np.ndarray, size: np.ndarray, smoothing: float) -> Model:
    """The model with transitions and emissions from class bigrams and the classes' sizes."""
    total = len(between)
    share = (between.sum(0) + 0.5) / (between.sum() + 0.5 * total)
    chance = (between + smoothing * share[None, :]) / (between.sum(1) + smoothing)[:, None]
    # No count tells where unknown words stand: after any class they have their share of the unigram base.
    unknown = min(0.5, 0.5 * 10**-model.base_norm)
    chance[:, :-1] *= (1 - unknown) / chance[:, :-1].sum(1, keepdims=True)
    chance[:, -1] = unknown
    label = model.label[:-1]
    emit = np.r_[np.log10(np.maximum(model.n, 0.5) / np.maximum(size[label], 0.5)), 0.0]
    return replace(model, step=np.log10(chance), emit=emit, between=between)


def _places(encoded: DataFrame, model: Model) -> DataFrame:
    """One pass over encoded rows: class bigrams of neighbours in the dictionary in training texts (cell, n); each place of
    a word outside it, with the classes on both sides or -1 (key, held_out, word, before, after); and pairs of two such words (the first is `other`)."""
    label, other, total = model.label, len(model.ids), model.total
    schema = "key long, held_out boolean, word binary, other binary, before int, after int, cell long, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(total * total, dtype=np.int64)
        names = [c.split(" ")[0] for c in schema.split(", ")]
        none = lambda k, t: pa.nulls(k, t)

        def of(batch: pa.RecordBatch, own: np.ndarray, words: list, others: list | None, before=None, after=None) -> pa.RecordBatch:
            k, at = len(words), pa.array(own)
            side = lambda x: none(k, pa.int32()) if x is None else pa.array(x.astype(np.int32))
            made = [batch.column(0).take(at), batch.column(1).take(at), pa.array(words, pa.binary()), none(k, pa.binary()) if others is None else pa.array(others, pa.binary()), side(before), side(after), none(k, pa.int64()), none(k, pa.int64())]
            return pa.RecordBatch.from_arrays(made, names)

        for batch in _small(batches):
            flat, lengths = _unpacked(batch)
            cls = label[flat]
            rare = flat == other
            cls[rare] = -1
            before = np.r_[label[0], cls[:-1]]
            train = np.repeat(~batch.column(1).to_numpy(zero_copy_only=False), lengths)
            both = train & (cls >= 0) & (before >= 0)
            cells += np.bincount(before[both] * total + cls[both], minlength=total * total)
            at = np.flatnonzero(rare)
            if len(at):
                words, own = _rare_words(batch), np.repeat(np.arange(len(lengths)), lengths)
                # A text ends with the end token, so a place after a word is in the same text.
                yield of(batch, own[at], words, None, before[at], cls[at + 1])
                two = np.flatnonzero(np.diff(at) == 1) + 1
                yield of(batch, own[at[two]], [words[i] for i in two.tolist()], [words[i - 1] for i in two.tolist()])
        at = np.flatnonzero(cells)
        k = len(at)
        made = [none(k, pa.int64()), none(k, pa.bool_()), none(k, pa.binary()), none(k, pa.binary()), none(k, pa.int32()), none(k, pa.int32()), pa.array(at), pa.array(cells[at])]
        yield pa.RecordBatch.from_arrays(made, names)

    return encoded.select("key", "held_out", "ids", "words").mapInArrow(run, schema)


def _looked_up(places: DataFrame, table: DataFrame, total: int) -> DataFrame:
    """Each place of a rare word with its count and class, and each pair of two with both classes; without the words."""
    none = F.lit(total - 1)
    alone = places.where("word IS NOT NULL AND other IS NULL").select("key", "held_out", "word", "before", "after").join(table, "word", "left")
    alone = alone.select("key", "held_out", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce("label", none).alias("label"), "before", "after")
    labels = table.select("word", "label")
    twice = places.where("other IS NOT NULL").select("key", "held_out", "word", "other").join(labels, "word", "left")
    twice = twice.join(labels.select(F.col("word").alias("other"), F.col("label").alias("first")), "other", "left")
    # A pair has no count: it is the step from `before` to `label` alone.
    twice = twice.select("key", "held_out", F.lit(None).cast("long").alias("n"), F.coalesce("label", none).alias("label"), F.coalesce("first", none).alias("before"), F.lit(-1).alias("after"))
    return alone.unionByName(twice)


def _complete(model: Model, counts: DataFrame, outside: DataFrame, encoded: DataFrame, smoothing: float) -> tuple[Model, DataFrame, DataFrame, np.ndarray]:
    """The model over all bigrams, (word, n, label) of the words outside the dictionary, what `_looked_up` gives, and the classes' sizes."""
    total = model.total
    table = materialize(counts.join(_by_neighbours(outside, total, model.between), "word"))
    places = materialize(_places(encoded, model))
    found = materialize(_looked_up(places, table, total))
    between = np.zeros((total, total))
    for x in places.where("cell IS NOT NULL").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        between[divmod(x.cell, total)] += x.n
    # Of a place both steps count, of a pair its one; at most total x total rows a side.
    trained = found.where("NOT held_out")
    for x in trained.where("before >= 0").groupBy("before", "label").agg(F.count(F.lit(1)).alias("n")).collect():
        between[x.before, x.label] += x.n
    for x in trained.where("after >= 0").groupBy("label", "after").agg(F.count(F.lit(1)).alias("n")).collect():
        between[x.label, x.after] += x.n
    size = np.bincount(model.label[:-1], model.n, total)
    for x in table.groupBy("label").agg(F.sum("n").alias("n")).collect():
        size[x.label] += x.n
    return _estimated(model, between, size, smoothing), table, found, np.maximum(size, 0.5)


def spread(model: Model, counts: DataFrame, docs: DataFrame, text_col: str, smoothing: float = 20.0) -> tuple[Model, DataFrame]:
    """The model with every training word in a class, and (word, n, label, emit) of the words outside the dictionary.
    A word never seen in training has a class of its own."""
    encoded = materialize(_encoded(_rows(docs, text_col), model.ids))
    outside = materialize(_outside(encoded, len(model.ids), model.label[: model.exchanged + 1], model.total)).where("word IS NOT NULL")
    model, table, _, size = _complete(model, counts, outside, encoded, smoothing)
    return model, table.withColumn("emit", F.log10(F.col("n") / F.get(F.array(*map(F.lit, size.tolist())), F.col("label"))))


def score(docs: DataFrame, trains: Column, id_col: str = "doc_id", text_col: str = "text", smoothing: float = 20.0, **settings) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) for each row of
    docs; the rows where `trains` holds are learned from. Scores are log10 probabilities."""
    text = F.col(quoted(text_col))
    rows = docs.select(F.col(quoted(id_col)).alias("id"), F.xxhash64(F.col(quoted(id_col)), text).alias("key"), (~F.coalesce(trains, F.lit(True))).alias("held_out"), text.cast("string").alias("text"))
    counts = materialize(count_tokens(rows.where("NOT held_out"), "text"))
    model, outside, encoded = _train(counts, rows, smoothing=smoothing, **settings)
    model, _, found, size = _complete(model, counts, outside, encoded, smoothing)
    total, other = model.total, len(model.ids)
    base, known = np.r_[np.log10(model.n + 0.5), 0.0], np.r_[model.n > 0, False].astype(np.int64)
    label, emit, step = model.label, model.emit, model.step

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            flat, lengths = _unpacked(batch)
            at = np.r_[0, np.cumsum(lengths)[:-1]].astype(np.int64)
            cls = label[flat]
            before = np.r_[label[0], cls[:-1]]
            add = lambda x: np.add.reduceat(x, at) if len(at) else x[:0]
            rare = flat == other
            # Steps to and from a word outside the dictionary come from its look-up.
            plain = ~(rare | np.r_[False, rare[:-1]])
            cols = [lengths, add(known[flat]), add(rare.astype(np.int64)), add(base[flat]), add(np.where(rare, 0.0, emit[flat]) + np.where(plain, step[before, cls], 0.0))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *map(pa.array, cols)], ["id", "key", "held_out", "n_tokens", "n_known", "n_rare", "base", "own"])

    kind = dict(rows.dtypes)["id"]
    summary = encoded.select("id", "key", "held_out", "ids").mapInArrow(whole, f"id {kind}, key long, held_out boolean, n_tokens long, n_known long, n_rare long, base double, own double")
    steps, width = F.lit(model.step.ravel().tolist()), F.lit(total)
    step_of = lambda a, b: F.when((a >= 0) & (b >= 0), F.get(steps, a * width + b)).otherwise(0.0)
    before, cls, after, n = F.col("before"), F.col("label"), F.col("after"), F.col("n")
    rare_emit = F.when(n > 0, F.log10(n / F.get(F.lit(size.tolist()), cls))).otherwise(0.0)
    rare = found.select(
        "key", n.isNotNull().cast("int").alias("r_tokens"), F.coalesce((n > 0).cast("int"), F.lit(0)).alias("r_known"),
        F.coalesce(F.log10(n + 0.5), F.lit(0.0)).alias("r_log"), (F.coalesce(rare_emit, F.lit(0.0)) + step_of(before, cls) + step_of(cls, after)).alias("r_own"),
    )
    # Rows with the same id and text have the same words: they are summed together and shared evenly below.
    rare = rare.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("r_known", "r_tokens", "r_log", "r_own")])
    both = summary.join(rare, "key", "left")
    copies = F.greatest(F.coalesce(F.col("r_tokens") / F.col("n_rare"), F.lit(1.0)), F.lit(1.0))
    out = both.select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce(F.round(F.col("r_known") / copies).cast("long"), F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce(F.col("r_log") / copies, F.lit(0.0)) - F.col("n_tokens") * F.lit(model.base_norm)).alias("base_score"),
        (F.col("own") + F.coalesce(F.col("r_own") / copies, F.lit(0.0))).alias("score"),
    )
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def op9(spark, sf_dir: str) -> DataFrame:
    from tessera.llm.common import table

    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    return score(table(spark, sf_dir, "documents"), ~held_out)
