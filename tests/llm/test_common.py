import random

import numpy as np
import pyarrow as pa
from conftest_llm import prose

from cladewise.llm import common


def test_hashes_do_not_depend_on_chunks(monkeypatch):
    rng = random.Random(1)
    texts = pa.array([prose(rng, rng.randrange(200)) for _ in range(40)] + ["x" * 500, "", None])
    whole = [x.copy() for x in common.shingles(texts, 5)]
    for chunk in (1, 7, 64, 1000):
        monkeypatch.setattr(common, "CHUNK", chunk)
        assert all((a == b).all() for a, b in zip(whole, common.shingles(texts, 5), strict=True))


def test_equal_words_have_equal_hashes_and_others_not():
    data, offsets = common.text_buffer(pa.array(["a bc a", "bc  a\tcb", None, "é e"]))
    starts, ends, first = common.words(data, offsets)
    h = common.span_hashes(data, starts, ends)
    text = [bytes(data[s:e]) for s, e in zip(starts, ends, strict=True)]
    assert first.tolist() == [0, 3, 6, 6, 8] and text == [b"a", b"bc", b"a", b"bc", b"a", b"cb", "é".encode(), b"e"]
    assert len(set(h.tolist())) == len(set(text)) and h[0] == h[2] == h[4]


def test_word_hashes_are_spread():
    words = [f"{a}{b}" for a in "abcdefghij" for b in range(3000)]
    data, offsets = common.text_buffer(pa.array([" ".join(words)]))
    h = common.span_hashes(data, *common.words(data, offsets)[:2])
    assert len(np.unique(h)) == len(words) and abs(np.mean(h >> np.uint64(63)) - 0.5) < 0.02
    assert abs(np.mean(h & np.uint64(1)) - 0.5) < 0.02


def test_slices_are_bounded_and_whole():
    rows = pa.record_batch([pa.array(["x" * 100] * 9000 + ["y" * (1 << 20)] + [None, ""]), pa.array(range(9003))], names=["text", "i"])
    parts = list(common.slices(rows))
    assert [i for p in parts for i in p.column("i").to_pylist()] == list(range(9003))
    assert max(p.num_rows for p in parts) <= common.SLICE_ROWS
