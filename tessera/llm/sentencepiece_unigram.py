"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

The vocabulary is a SentencePiece model file whose path is a parameter. A unigram model's scores are used as
they are. A BPE model has merge ranks in place of log probabilities; they become a Zipf law's log
probabilities of those ranks. Text that no piece covers falls back to bytes.

A text gets the white-space marker in front and in place of each blank. No piece of such a vocabulary
holds a marker after another character, nor a character that only bytes can give; so the best path of a text is
that of its words, each found once and remembered by its task (`remember` words at most at a time). If
a vocabulary has pieces across words, texts are searched whole.

Texts are normalised first as the model says: its table of replacements (longest match first), runs of blanks made one and
stripped at the ends, the marker in front. User-defined pieces stay as they are in that, and get SentencePiece's bonus. A model that puts the marker
behind words is refused.

A null or empty text has no pieces. `decoded_ok` compares with the normalised text. A literal marker in a text decodes to a blank, as in SentencePiece itself:
`decoded_ok` is then false, else true. Repeated rows are encoded alike. Of equally good paths the first found stays, as in SentencePiece. Extra
columns stay, whatever their names; ids, n_tokens, n_bytes and decoded_ok are replaced. An empty table gives an empty one. A very long word costs a step
of a few array operations for each of its characters.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import map_text

MARK = "▁"
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
# Kinds of pieces and models in the file format (fixed values).
NORMAL, USER_DEFINED, BYTE, UNIGRAM = 1, 4, 6, 1
_UNKNOWN_PENALTY = 10.0


def _fields(data: bytes) -> Iterator[tuple[int, int, object]]:
    """(field, wire type, value) of one protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        field, wire = key >> 3, key & 7
        if wire == 0:
            yield field, wire, varint()
        else:
            n = {1: 8, 5: 4}.get(wire) or varint()
            yield field, wire, data[at : at + n]
            at += n


def read_model(data: bytes) -> tuple[list[tuple[str, float, int]], int, Normalizer]:
    """The pieces (text, score, kind) by id, the model's kind and its normaliser."""
    pieces, kind, normal = [], UNIGRAM, {}
    for field, _, value in _fields(data):
        if field == 1:
            p = {f: v for f, _, v in _fields(value)}
            pieces.append((p[1].decode(), struct.unpack("<f", p.get(2, bytes(4)))[0], p.get(3, NORMAL)))
        elif field == 2:
            trainer = {f: v for f, _, v in _fields(value)}
            kind = trainer.get(3, UNIGRAM)
            if trainer.get(24):
                raise ValueError("models with the white-space marker behind words aren't supported")
        elif field == 3:
            normal = {f: v for f, _, v in _fields(value)}
    own = [p for p, _, k in pieces if k == USER_DEFINED and p]
    return pieces, kind, Normalizer(normal.get(2, b""), bool(normal.get(3, 1)), bool(normal.get(4, 1)), own)


class Normalizer:
    """What a model does to a text before it is cut: replacements, blanks, the marker in front.

    The table of replacements is a compiled double-array trie over UTF-8 bytes: a little-endian 32-bit size, that many bytes of 32-bit units, then the
    new strings, each closed by a zero byte. The file format fixes how a unit packs offset, label and leaf.
    """

    def __init__(self, table: bytes, prefix: bool, one_blank: bool, keep: list[str]) -> None:
        self.prefix, self.one_blank = prefix, one_blank
        size = struct.unpack("<I", table[:4])[0] if table else 0
        self.units, self.strings = np.frombuffer(table[4 : 4 + size], "<u4").tolist(), table[4 + size :]
        self.keep = re.compile("|".join(re.escape(p) for p in sorted(keep, key=len, reverse=True)).replace(MARK, " ")) if keep else None
        self._seen: dict[str, str] = {}

    def _longest(self, text: bytes, at: int) -> tuple[int, int]:
        """Length of the longest replaced prefix from a place, and where its new string starts; 0 if none."""
        units, found = self.units, (0, 0)
        place = self._offset(units[0])
        for i in range(at, len(text)):
            place ^= text[i]
            if place >= len(units) or units[place] & 0x800000FF != text[i]:
                break
            unit = units[place]
            place ^= self._offset(unit)
            if unit >> 8 & 1:
                found = (i + 1 - at, units[place] & 0x7FFFFFFF)
        return found

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def _replaced(self, part: str) -> str:
        if not self.units or part in self._seen:
            return self._seen.get(part, part)
        text, out, at = part.encode("utf-8", "surrogatepass"), [], 0
        while at < len(text):
            n, start = self._longest(text, at)
            if n:
                out.append(self.strings[start : self.strings.index(0, start)])
            else:
                n = 1
                while at + n < len(text) and text[at + n] & 0xC0 == 0x80:
                    n += 1
                out.append(text[at : at + n])
            at += n
        made = b"".join(out).decode("utf-8", "surrogatepass")
        if len(self._seen) < 100_000:
            self._seen[part] = made
        return made

    def __call__(self, text: str) -> str:
        """The normalised text, with blanks and without the marker in front."""
        if self.units:
            parts = self.keep.split(text) if self.keep else [text]
            kept = self.keep.findall(text) if self.keep else []
            # Replacements of one blank-free part don't depend on others: none of the standard tables has a blank within.
            fresh = ["".join(map(self._replaced, re.findall(" +|[^ ]+", p))) for p in parts]
            text = "".join(x for pair in zip(fresh, [*kept, ""]) for x in pair)
        return re.sub(" {2,}", " ", text).strip(" ") if self.one_blank else text


def zipf(ranks: np.ndarray) -> np.ndarray:
    """Log probabilities of ranks 0, 1, ... under Zipf's law."""
    place = ranks + 1
    return -np.log(place) - np.log((1 / place).sum())


@dataclass
class DoubleArray:
    """A trie as two arrays: the child of state s by code c is base[s] + c if check of that is s."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray  # piece ended at a state, or -1
    codes: dict[str, int]
    longest: int

    @classmethod
    def build(cls, words: dict[str, int]) -> DoubleArray:
        codes = {c: i + 1 for i, c in enumerate(sorted({c for w in words for c in w}))}
        trie: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for w, v in words.items():
            node = 0
            for c in w:
                k = codes[c]
                if k not in trie[node]:
                    trie[node][k] = len(trie)
                    trie.append({})
                node = trie[node][k]
            ends[node] = v
        size = 2 * len(trie) + 2 * len(codes) + 2
        base, check, value = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        used = np.zeros(size, bool)
        used[0] = True
        state, low = {0: 0}, 1
        # Wide nodes first, each at the first place where all its children fit.
        order = sorted(range(len(trie)), key=lambda n: -len(trie[n]))
        bases: dict[int, int] = {}
        for n in order:
            kids = np.array(sorted(trie[n]), dtype=np.int64)
            if not len(kids):
                continue
            while used[low]:
                low += 1
            at = low
            while True:
                if at + len(codes) + 1 >= len(used):
                    grow = len(used)
                    base, value, used = np.r_[base, np.zeros(grow, np.int64)], np.r_[value, np.full(grow, -1)], np.r_[used, np.zeros(grow, bool)]
                    check = np.r_[check, np.full(grow, -1)]
                free = np.flatnonzero(~used[at : at + 4096]) + at
                spots = free[free >= kids[0]] - kids[0]
                spots = spots[spots + kids[-1] < len(used)]
                fits = spots[~used[spots[:, None] + kids[None, :]].any(1)] if len(spots) else spots
                if len(fits):
                    bases[n] = int(fits[0])
                    used[bases[n] + kids] = True
                    break
                at += 4096
        todo = [0]
        while todo:
            n = todo.pop()
            s = state[n]
            if n in ends:
                value[s] = ends[n]
            if n in bases:
                base[s] = bases[n]
                for k, child in trie[n].items():
                    check[bases[n] + k] = s
                    state[child] = bases[n] + k
                    todo.append(child)
            else:
                base[s] = len(base)  # no child: every look-up falls off the end
        pad = len(codes) + 2
        return cls(base, np.r_[check, np.full(pad, -2)], np.r_[value, np.full(pad, -1)], codes, max(map(len, words), default=1))


class Unigram:
    """Encoder and decoder of one vocabulary; sent to the tasks whole (a vocabulary's size is bounded)."""

    def __init__(self, data: bytes, remember: int = 100_000) -> None:
        pieces, kind, self.normal = read_model(data)
        self.pieces, self.remember = pieces, remember
        scores = np.array([s for _, s, _ in pieces], dtype=np.float64)
        usable = [i for i, (p, _, k) in enumerate(pieces) if k in (NORMAL, USER_DEFINED) and p]
        if kind != UNIGRAM:
            scores[usable] = zipf(-np.minimum(scores[usable], 0))
        normal = [i for i, (p, _, k) in enumerate(pieces) if k == NORMAL and p]
        highest = scores[normal].max() if normal else 0.0
        for i in usable:
            if pieces[i][2] == USER_DEFINED:
                scores[i] = len(pieces[i][0].encode()) * highest - 0.1
        self.scores = scores.astype(np.float32)
        self.unknown = np.float32(self.scores[normal or usable].min() - np.float32(_UNKNOWN_PENALTY))
        self.byte_ids = {int(p[1:-1], 16): i for i, (p, _, k) in enumerate(pieces) if k == BYTE}
        self.unk_id = next((i for i, (_, _, k) in enumerate(pieces) if k == 2), 0)
        self.trie = DoubleArray.build({pieces[i][0]: i for i in usable})
        self.by_word = not any(MARK in pieces[i][0].lstrip(MARK) or "\n" in pieces[i][0] for i in usable)
        self._raw = [bytes([int(p[1:-1], 16)]) if k == BYTE else p.replace(MARK, " ").encode() if k in (NORMAL, USER_DEFINED) else b"" for p, _, k in pieces]
        self._cut = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n", re.S)
        self._known: dict[str, bytes] = {}

    def _paths(self, words: list[str]) -> list[list[tuple[int, int]]]:
        """The best path of each word, as (end, id); id -1 where no piece covers the character. Words
        are searched side by side: one array step advances all of them."""
        t, n = self.trie, np.array([len(w) for w in words])
        width = int(n.max())
        code = np.zeros((len(words), width), np.int64)
        get = t.codes.get
        for r, w in enumerate(words):
            code[r, : len(w)] = [get(c, 0) for c in w]
        best = np.full((len(words), width + 1), -np.inf, np.float32)  # sums as single floats, as in SentencePiece
        best[:, 0] = 0
        came, piece = np.zeros((len(words), width + 1), np.int32), np.full((len(words), width + 1), -1, np.int32)
        for i in range(width):
            row = np.flatnonzero(n > i)
            alive, state, single = row, np.zeros(len(row), np.int64), np.zeros(len(words), bool)
            for k in range(min(t.longest, width - i)):
                c = code[alive, i + k]
                nxt = t.base[state] + c
                ok = (c > 0) & (t.check[np.minimum(nxt, len(t.check) - 1)] == state)
                alive, state = alive[ok], nxt[ok]
                if not len(alive):
                    break
                ends = t.value[state]
                has = ends >= 0
                if not k:
                    single[alive[has]] = True
                r, e = alive[has], ends[has]
                made = best[r, i] + self.scores[e]
                up = made > best[r, i + k + 1]
                best[r[up], i + k + 1], came[r[up], i + k + 1], piece[r[up], i + k + 1] = made[up], i, e[up]
            r = row[~single[row]]
            made = best[r, i] + self.unknown
            up = made > best[r, i + 1]
            best[r[up], i + 1], came[r[up], i + 1], piece[r[up], i + 1] = made[up], i, -1
        out = []
        for r, m in enumerate(n.tolist()):
            path, to, by = [], came[r].tolist(), piece[r].tolist()
            while m:
                path.append((m, by[m]))
                m = to[m]
            out.append(path[::-1])
        return out

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words, as packed 32-bit numbers."""
        out = {}
        words.sort(key=len)
        at = 0
        while at < len(words):
            # words of like length together, about a million cells at a time
            step = max(1, (1 << 20) // max(1, len(words[min(len(words) - 1, at + 4095)])))
            some = words[at : at + min(step, 4096)]
            at += len(some)
            for w, path in zip(some, self._paths(some)):
                ids, start = [], 0
                for end, p in path:
                    if p >= 0:
                        ids.append(p)
                    elif self.byte_ids:
                        ids += [self.byte_ids[b] for b in w[start:end].encode("utf-8", "surrogatepass")]
                    else:
                        ids.append(self.unk_id)
                    start = end
                out[w] = struct.pack(f"<{len(ids)}i", *ids)
        return out

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        texts = [self.normal(t) if t else "" for t in texts]
        marked = [(MARK if self.normal.prefix else "") + t.replace(" ", MARK) if t else "" for t in texts]
        cut = [self._cut.findall(t) if self.by_word else [t] if t else [] for t in marked]
        fresh = {w for words in cut for w in words} - self._known.keys()
        if len(self._known) + len(fresh) > self.remember:
            self._known = {}
            fresh = {w for words in cut for w in words}
        self._known |= self._learn(list(fresh))
        known = self._known
        return [np.frombuffer(b"".join([known[w] for w in words]), dtype="<i4") for words in cut]

    def forget(self) -> None:
        """Frees the words found so far; a Python worker may idle for long with them."""
        self._known = {}
        pa.default_memory_pool().release_unused()

    def decode(self, ids: np.ndarray) -> str:
        raw = self._raw
        text = b"".join([raw[i] for i in ids.tolist()])
        return (text[1:] if text[:1] == b" " and self.normal.prefix else text).decode("utf-8", "replace")


def load(spark, path: str = DEFAULT_MODEL) -> Unigram:
    """Reads the model where the driver sees it: a local file, or any path Spark can read."""
    if "://" in path:
        data = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    else:
        with open(path, "rb") as f:
            data = f.read()
    return Unigram(data)


def tokenize(docs: DataFrame, model: Unigram, text_col: str = "text") -> DataFrame:
    """docs without the text, with ids, n_tokens, n_bytes (tokens of the byte fallback) and decoded_ok."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    is_byte = np.zeros(len(model.pieces) + 1, bool)
    is_byte[list(model.byte_ids.values())] = True

    def run(texts: pa.Array) -> list[pa.Array]:
        m, all_ids, sizes, falls, same = shared.value, [], [], [], []
        for at in range(0, len(texts), 250):
            some = texts[at : at + 250].to_pylist()
            for text, ids in zip(some, m.encode_batch(some)):
                all_ids.append(ids)
                sizes.append(len(ids))
                falls.append(int(is_byte[ids].sum()))
                same.append(m.decode(ids) == (m.normal(text) if text else ""))
        flat = pa.array(np.concatenate(all_ids) if all_ids else np.zeros(0, np.int32), pa.int32())
        ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), flat)
        return [ids, pa.array(sizes, pa.int32()), pa.array(falls, pa.int32()), pa.array(same, pa.bool_())]

    return map_text(docs, text_col, "ids array<int>, n_tokens int, n_bytes int, decoded_ok boolean", run, keep_text=False, done=lambda: shared.value.forget())


def op5(spark, sf_dir: str) -> DataFrame:
    from tessera.llm.common import table

    return tokenize(table(spark, sf_dir, "documents").select("doc_id", "text"), load(spark))
