"""Word and n-gram hashing against plain Python."""

import random

import numpy as np
import pyarrow as pa

from judgelab.llm.common import inside_doc, ngram_hashes, span_hashes, text_chunks, words_of
from judgelab.llm.substring_dedup import FMIndex, WaveletMatrix, segments


def _docs(seed, n=200):
    r = random.Random(seed)
    return ["".join(r.choice("ab \n\tÄé.c") for _ in range(r.randint(0, 60))).encode() for _ in range(n)]


def test_words_equal_python_split_in_any_chunking():
    docs = [*_docs(1), None, b"x" * 5000]
    seen = {}
    for limit in (10, 300, 1 << 20):
        for lo, hi, buf, offsets in text_chunks(pa.array(docs, type=pa.binary()), limit):
            w = words_of(buf, offsets, lower=True)
            for d in range(hi - lo):
                words = (docs[lo + d] or b"").lower().split()
                a, b = w.first[d], w.first[d + 1]
                assert [bytes(w.buf[s:e]) for s, e in zip(w.start[a:b], w.end[a:b])] == words
                for x, h in zip(words, w.hash[a:b]):
                    assert seen.setdefault(x, h) == h
    assert len(set(seen.values())) == len(seen)


def test_ngram_hashes_agree_with_spans_and_stay_in_documents():
    col = pa.array(_docs(2), type=pa.binary())
    for _, _, buf, offsets in text_chunks(col, 500):
        w = words_of(buf, offsets, lower=True)
        for k in (1, 3, 7):
            g, ok = ngram_hashes(w.hash, k), inside_doc(w.first, k)
            assert len(g) == len(ok)
            assert ok.sum() == sum(max(0, c - k + 1) for c in w.counts())
            at = np.arange(len(g))
            assert len(set(span_hashes(w.hash, at, at + k))) == len({tuple(w.hash[i : i + k]) for i in at})


def test_wavelet_matrix_ranks():
    r = np.random.default_rng(0)
    s = r.integers(0, 37, 500)
    w = WaveletMatrix(s, 36)
    for c in (0, 5, 36):
        at = np.arange(0, 501, 7)
        assert list(w.rank(np.full(len(at), c), at)) == [int((s[:i] == c).sum()) for i in at]


def test_fm_index_matching_statistics():
    r = np.random.default_rng(1)
    text = r.integers(1, 3, 400)
    text[100:140] = text[300:340]
    text[-1] = 0
    index = FMIndex(text, 35)
    ends = np.arange(50, 399)
    got = index.matching(ends, 30)
    raw = [tuple(text[i : i + 60]) for i in range(400)]
    for e, m in zip(ends, got):
        best = 0
        for length in range(16, 31):
            word = tuple(text[e - length + 1 : e + 1])
            if sum(x[:length] == word for x in raw if len(x) >= length) >= 2:
                best = length
            else:
                break
        assert m == best


def test_segments_cover_every_window_once_and_equal_windows_share_an_anchor():
    r = np.random.default_rng(2)
    h = np.concatenate([r.integers(0, 1 << 60, 80), r.integers(0, 1 << 60, 30)]).astype(np.uint64)
    h[60:75] = h[10:25]
    first = np.array([0, 80, 110])
    doc, at, n, anchor, _ = segments(h, first, window=10, anchor=4)
    covered = sorted(i for a, k in zip(at, n) for i in range(a, a + k))
    assert covered == [*range(71), *range(80, 101)]
    of = {i: x for a, k, x in zip(at, n, anchor) for i in range(a, a + k)}
    assert all(of[10 + i] == of[60 + i] for i in range(6))
