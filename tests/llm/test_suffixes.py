import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import suffixes


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60))
def test_suffix_array(symbols):
    assert suffixes.suffix_array(np.array(symbols, np.int64)).tolist() == sorted(range(len(symbols)), key=lambda i: symbols[i:])


def brute(texts, length):
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        covered = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                covered[i : i + length] = b"\1" * length
        out.append((len(t), sum(covered), sum(1 for i in range(len(t)) if covered[i] and (i == 0 or not covered[i - 1])), bytes(x for x, c in zip(t, covered) if not c)))
    return out


def corpus(rng, n):
    letters = list("abcdefgh ÄÖ日")
    word = lambda m: "".join(rng.choice(letters, m))
    shared = [word(rng.integers(20, 200)) for _ in range(4)]
    texts = []
    for _ in range(n):
        parts = [word(rng.integers(0, 60))]
        for _ in range(rng.integers(0, 4)):
            s = shared[rng.integers(4)]
            a, b = sorted(rng.integers(0, len(s) + 1, 2))
            parts += [s[a:b], word(rng.integers(0, 30))]
        texts.append("".join(parts))
    return [*texts, texts[0], texts[1], "z" * 300, "ab" * 200, "", "short"]


@pytest.mark.parametrize("crowd", [2000, 2])
def test_against_brute_force(spark, monkeypatch, crowd):
    """Short matches on small texts; ``crowd`` 2 sends most grams down the way for crowded ones."""
    monkeypatch.setattr(suffixes, "MOST_CONTEXTS", crowd)
    texts = corpus(np.random.default_rng(crowd), 40)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.remove_repeats(docs, length=40, gram=13).collect()}
    want = brute([t.encode() for t in texts], 40)
    assert [got[i] for i in range(len(texts))] == want


def test_shuffled_keys_and_small_batches(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "BROADCAST_KEYS", 0)
    monkeypatch.setattr(suffixes, "MOST_SYMBOLS", 500)
    texts = corpus(np.random.default_rng(7), 30)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.remove_repeats(docs, length=40, gram=13).collect()}
    assert [got[i] for i in range(len(texts))] == brute([t.encode() for t in texts], 40)


def test_defined_cases(spark):
    long = "words that go on and on " * 30
    rows = [(1, None, "x"), (2, "", "x"), (3, "tiny", None), (4, long, "x"), (4, long, "x"), (None, "y" * 399, "x")]
    got = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, kept string")).collect()
    assert len(got) == 6
    assert [(r.n_removed, r.n_spans) for r in got if r.doc_id == 4] == [(len(long), 1)] * 2
    assert {r.doc_id: bytes(r.kept) for r in got if r.doc_id != 4} == {1: b"", 2: b"", 3: b"tiny", None: b"y" * 399}
    assert suffixes.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
