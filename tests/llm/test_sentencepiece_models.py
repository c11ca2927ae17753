"""Normalisers and user-defined pieces against the library."""

import random
import struct

import pytest
import sentencepiece

from tessera.llm import sentencepiece_unigram as sp
from tests.llm.test_text_models import field, varint

TEXTS = ["", "  the  thing ", "Ａｌｌ ｗｉｄｅ", "tab\there\nnew line", "é ñ ﬁne ½ ①", "a  b   c", " ", "日本 ﾃｽﾄ", "x​y z", "<sep>the<sep> [USER] [US", "...thethe"]
PIECES = ["▁", "▁th", "e", "t", "h", "he", "▁the", "er", "n", "▁n", "a", "b", "c", "l", "i", "w", "d", "▁a", "s", "p", "."]


def model_file(path, normal: bytes, own: list[str]) -> str:
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    pieces += [(p, 0.0, 4) for p in own] + [(p, -1.0 - i / 7, 1) for i, p in enumerate(PIECES)]
    body = b"".join(field(1, field(1, p.encode()) + varint(2 << 3 | 5) + struct.pack("<f", s) + varint(3 << 3) + varint(k)) for p, s, k in pieces)
    trainer = varint(3 << 3) + varint(1) + varint(35 << 3) + varint(1)
    path.write_bytes(body + field(2, trainer) + field(3, normal))
    return str(path)


def normal_spec(rule: str, prefix: int, one_blank: int) -> bytes:
    whole = sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()
    table = next((dict((f, v) for f, _, v in sp._fields(v)).get(2, b"") for f, _, v in sp._fields(whole) if f == 3), b"")
    return field(1, rule.encode()) + (field(2, table) if table else b"") + varint(3 << 3) + varint(prefix) + varint(4 << 3) + varint(one_blank) + varint(5 << 3) + varint(1)


@pytest.mark.parametrize("rule,prefix,one_blank", [("nmt_nfkc", 1, 1), ("nfkc_cf", 1, 0), ("identity", 1, 1), ("nmt_nfkc", 0, 0)])
@pytest.mark.parametrize("own", [[], ["<sep>", "[USER]", "thethe"]])
def test_normalised_encoding_equals_the_library(tmp_path, rule, prefix, one_blank, own):
    path = model_file(tmp_path / "m.model", normal_spec(rule, prefix, one_blank), own)
    lib, mine = sentencepiece.SentencePieceProcessor(model_file=path), sp.Unigram(open(path, "rb").read())
    rng = random.Random(2)
    texts = TEXTS + ["".join(rng.choice("the nabc\tＡé½ ﬁ é<sep>") for _ in range(40)) for _ in range(100)]
    for text, ids in zip(texts, mine.encode_batch(texts)):
        assert ids.tolist() == lib.encode(text), (text, lib.encode(text, out_type=str), [mine.pieces[i][0] for i in ids])
        assert mine.decode(ids) == mine.normal(text)


def test_marker_behind_words_is_refused():
    with pytest.raises(ValueError):
        sp.read_model(field(2, varint(24 << 3) + varint(1)))
