import hashlib
import random

import numpy as np
import pytest

from cytoplan.llm import piece_encoding
from cytoplan.llm.queries import tokenizer

spm = pytest.importorskip("sentencepiece")
PATH = tokenizer("piece_bpe_32k.model")
ODD = [None, "", " ", "   ", " a", "a  b", "▁x", "a▁ b", "▁ ▁", "a\x00b", "<s>hi</s>", "<0x0A>", "\n\nx", " x", "ﬁ", "é", "日本語 テ", "😀 x", " " * 700, "aa" * 3000, "x" + " " * 19 + "1", "\r\n);\r", "\t\ta"]


def test_matches_the_library(table, prose):
    rng = random.Random(1)
    bits = [" ", "  ", "▁", "\n", "a", "b", "the", "ing", " th", "er", "1", ".", "é", "日", "\r", ";\r", "Ħ"]
    texts = ODD + [t for _, t in prose] + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 30))) for _ in range(600)]
    lib = spm.SentencePieceProcessor(model_file=PATH)
    rows = list(enumerate(texts))
    for r in piece_encoding.encode_decode(table(rows), PATH).collect():
        ids = lib.encode(texts[r.doc_id] or "", add_bos=True, add_eos=True)
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids), repr(texts[r.doc_id])
        assert r.decoded == lib.decode(ids)


def test_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(piece_encoding, "CACHE_SEGMENTS", 3)
    with open(PATH, "rb") as f:
        e = piece_encoding.Encoder(f.read())
    lib = spm.SentencePieceProcessor(model_file=PATH)
    for text in ["some words here", "other words there", "some words here"]:
        data = np.frombuffer(text.encode(), np.uint8)
        ids, at = e.chunk(data, np.array([0, len(data)]))
        assert ids.tolist() == lib.encode(text) and at.tolist() == [0, len(ids)]


def test_prefix_table_and_merging_agree():
    with open(PATH, "rb") as f:
        m = piece_encoding.PieceModel(f.read())
    for text in ["▁the", "▁internationalisation", "▁ab", "zzzzzzz", "▁Donaudampfschiff"]:
        assert [m.pieces[i][0] for i in m.encode(text)] == m.merged(text) == m.merged_agenda(text)
    with pytest.raises(ValueError):
        piece_encoding.PieceModel(b"")


def test_edge_cases(spark, table):
    assert piece_encoding.encode_decode(table([]), PATH).collect() == []
    odd = table([(1, "a b"), (1, "a b")]).selectExpr("*", "1 as score", "'q' as segment")
    rows = piece_encoding.encode_decode(odd, PATH, ("doc_id", "score", "segment")).collect()
    assert len(rows) == 2 and rows[0] == rows[1] and rows[0].decoded == "a b"
    from cytoplan.llm.queries import op7_sentencepiece

    r = op7_sentencepiece(spark, "/root/testdata/sf0.001").first()
    assert len(r.ids_sha256) == len(r.decoded_sha256) == len(hashlib.sha256().hexdigest())
