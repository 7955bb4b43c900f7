import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", " ", "  two  gaps ", "▁", "a▁b ▁ c", "Straße\nund Öl", "\t x\n\n", "日本語 テキスト", "\U0001f600 x", "\x00\x01 z", "word " * 5000, "é" * 300, "ａｂｃ ﬁ ½ ①", "　wide　", "ẹ́"]


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel(PATH)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def check(model, library, text):
    ids, spans = model.encode(text.encode())
    expected = library.encode(text, add_bos=True, add_eos=True)
    assert np.frombuffer(ids, "<u4").tolist() == expected
    assert model.decode(ids) == library.decode(expected)
    assert len(spans) == len(expected) - 2
    if len(spans):
        assert spans[0, 0] == 0 and spans[-1, 1] == len(text.encode())
        assert (spans[1:, 0] == spans[:-1, 1]).all()


@pytest.mark.parametrize("text", TEXTS)
def test_ids_and_spans(model, library, text):
    check(model, library, text)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from(" ▁ab\nöß日\U0001f600x."), max_size=30))
def test_any_text(model, library, text):
    check(model, library, text)


def test_spans_are_the_pieces_source(model, library):
    text = "Hello  wörld  日本"
    ids, spans = model.encode(text.encode())
    for i, (a, b) in zip(np.frombuffer(ids, "<u4").tolist()[1:-1], spans.tolist()):
        name = model.names[i].decode()
        if model.types[i] != pieces.BYTE:
            assert text.encode()[a:b].decode() in {name.replace("▁", " "), name.replace("▁", " ")[1:], name}


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nmt_nfkc_cf", "nfkc"])
@pytest.mark.parametrize("text", TEXTS)
def test_compiled_map_against_the_library(rule, text):
    normaliser = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    for field, value in pieces.wire(normaliser.serialized_model_proto()):
        if field == 3:
            spec = dict(pieces.wire(value))
    own = pieces.PieceModel.__new__(pieces.PieceModel)
    own.map, own.symbols = pieces.CharMap(spec[2]), []
    own.dummy_prefix, own.trim, own.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
    got, source = own.normalise(text.encode())
    assert got.decode() == normaliser.normalize(text)
    assert len(source) == len(got) + 1 and (np.diff(source) >= 0).all()


def test_table_cases(spark):
    rows = [(1, None, "x"), (2, "", "x"), (2, "", "x"), (None, "a b", None)]
    got = pieces.encode(spark.createDataFrame(rows, "doc_id long, text string, ids string"), PATH).collect()
    assert len(got) == 4
    assert sorted(len(r.ids) for r in got)[:3] == [8, 8, 8]
    assert pieces.encode(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
    assert hashlib.sha256(got[0].ids).hexdigest() == hashlib.sha256(got[1].ids).hexdigest()
