import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from chronogrid.llm import text as T

PIECES = st.lists(st.one_of(st.none(), st.text(alphabet=" \t\n\x0b\x0c\r\x1c\u00a0aB,é\u4e2d", max_size=40)), max_size=8)


@settings(max_examples=60, deadline=None)
@given(PIECES, st.integers(1, 60))
def test_words_and_hashes(texts, size):
    seen, count = {}, 0
    for s in T.slices(pa.array(texts, pa.string()), size):
        h = s.hashes()
        for k in range(s.lo, s.hi):
            want = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", texts[k] or "")]
            assert s.words(k - s.lo) == want and s.counts[k - s.lo] == len(want)
            for w, x in zip(want, h[s.first[k - s.lo] : s.first[k - s.lo + 1]].tolist(), strict=True):
                assert seen.setdefault(w, x) == x
            count += 1
    assert count == len(texts) and len(set(seen.values())) == len(seen)


def test_windows_and_labels():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 3, 200).astype(np.uint64)
    for k in (1, 5, 35):
        w = T.window_hash(T.mix(h + np.uint64(1)), k)
        by = {}
        for i, x in enumerate(w.tolist()):
            by.setdefault(tuple(h[i : i + k]), set()).add(x)
        assert all(len(v) == 1 for v in by.values()) and len({x for v in by.values() for x in v}) == len(by)
    at, doc = T.window_docs(np.array([0, 3, 3, 10]), 3)
    assert at.tolist() == [0, 3, 4, 5, 6, 7] and doc.tolist() == [0, 2, 2, 2, 2, 2]
    label = T.occurrence_labels(np.array([0, 0, 0, 1, 1]), np.array([5, 6, 5, 5, 5], np.uint64))
    assert label.tolist() == [0, 0, 1, 0, 1]


def test_normalised_slices():
    texts = ["Idiot, the CAFÉ!", None, "--- ...", "a'b"]
    got = [w for s in T.normalised_slices(pa.array(texts)) for d in range(s.hi - s.lo) for w in [s.words(d)]]
    assert got == [[b"idiot", b"the", "cafÉ".encode()], [], [], [b"ab"]]


def test_long_slices_split():
    rng = random.Random(0)
    texts = ["x" * rng.randint(0, 300) for _ in range(50)]
    parts = list(T.slices(pa.array(texts), 100))
    assert [s.lo for s in parts[1:]] == [s.hi for s in parts[:-1]] and parts[-1].hi == 50
