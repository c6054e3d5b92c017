import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from chronogrid.llm import substring_dedup as S

from . import corpus


def brute(docs, window=35):
    starts = Counter()
    texts = [corpus.words(d[1]) for d in docs]
    for w in texts:
        for i in range(len(w) - window + 1):
            starts[tuple(w[i : i + window])] += 1
    out = []
    for d, w in zip(docs, texts, strict=True):
        gone = {j for i in range(len(w) - window + 1) if starts[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((d[0], len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    return sorted(out, key=str)


def docs(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(200)]
    shared = [corpus.prose(rng, vocabulary, n) for n in (34, 35, 36, 50, 120)]
    out = corpus.rows(30, seed)
    for i in range(60):
        text = corpus.prose(rng, vocabulary, rng.randint(5, 60))
        for _ in range(rng.randint(0, 2)):
            piece = rng.choice(shared).split()
            at = rng.randint(0, 10)
            text += rng.choice([" ", "\n", " \t"]) + " ".join(piece[at if rng.random() < 0.3 else 0 :]) + " " + corpus.prose(rng, vocabulary, rng.randint(0, 20))
        out.append((500 + i, text, "", "", 0, 0, "", ""))
    out += [(600, "ab " * 36, "", "", 0, 0, "", ""), (601, "cd " * 35, "", "", 0, 0, "", ""), (602, "x y z " * 40, "", "", 0, 0, "", "")]
    return [*out, out[40], out[41]]


@pytest.mark.parametrize("entries", [S.BROADCAST_ENTRIES, 0])
@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, entries, seed):
    data = docs(seed)
    got = S.remove_repeats(corpus.frame(spark, data), entries).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=str) == brute(data)


def test_one_passage_in_many_documents(spark):
    rng = random.Random(7)
    passage = corpus.prose(rng, corpus.EN, 80)
    data = [(i, f"own{i} a{i} b{i} {passage} tail{i}", "", "", 0, 0, "", "") for i in range(300)]
    got = S.remove_repeats(corpus.frame(spark, data)).collect()
    assert all(r.n_removed == 80 and r.kept == f"own{r.doc_id} a{r.doc_id} b{r.doc_id} tail{r.doc_id}" for r in got)


def test_empty(spark):
    assert S.remove_repeats(corpus.frame(spark, [])).count() == 0
    got = S.remove_repeats(corpus.frame(spark, [(None, None, None, None, None, None, None, None)])).collect()
    assert [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in got] == [(None, 0, 0, "")]


def test_small_shards_and_tasks(spark):
    data = docs(3)
    got = S.remove_repeats(corpus.frame(spark, data), shard_words=60, task_words=100).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=str) == brute(data)


def test_only_automata_locate(spark):
    """What is removed is what the automata cover: with other patterns other words go."""
    passage, other = [f"p{i}" for i in range(40)], [f"q{i}" for i in range(36)]
    phrases = S.Phrases(pa.array([" ".join(passage), " ".join(other)]))
    words = ["x", *passage, "y", *other, *passage[:39], *other]
    s = next(S.slices(pa.array([" ".join(words)])))
    want = [False, *[True] * 40, False, *[True] * 36, *[False] * 39, *[True] * 36]
    assert phrases.cover(s.hashes()).tolist() == want
    rows = [(0, 0, False, 0, 0, " ".join(passage)), (0, 0, True, 5, 6, " ".join(words)), (0, 1, False, 0, 0, " ".join(other)), (0, 1, True, 7, 8, " ".join(words))]
    batch = pa.RecordBatch.from_pylist([dict(zip(("shard", "salt", "is_doc", "k1", "k2", "text"), r, strict=True)) for r in rows])
    got = [tuple(r.values()) for b in S._locate(iter([batch.slice(0, 3), batch.slice(3)])) for r in b.to_pylist()]
    assert got == [(5, 6, 1, 41), (7, 8, 42, 78), (7, 8, 117, 153)]


def test_many_different_words():
    """More words than there are characters, in one long text with a passage that repeats."""
    n = 1_200_000
    passage = [f"p{i}" for i in range(50)]
    words = [f"x{i}" for i in range(n)]
    s = next(S.slices(pa.array([" ".join(words[: n // 2] + passage + words[n // 2 :] + passage)])))
    twice = [*range(n // 2, n // 2 + 50), *range(n + 50, n + 100)]
    assert np.flatnonzero(S.Phrases(pa.array([" ".join(passage)])).cover(s.hashes())).tolist() == twice
    both = S.Phrases(pa.array([" ".join(words[10:100_010]), " ".join(passage)]))
    assert both.width == 2 and np.flatnonzero(both.cover(s.hashes())).tolist() == [*range(10, 100_010), *twice]


class Counted:
    """An automaton that notes how much text it reads."""

    def __init__(self, automaton):
        self.automaton, self.read = automaton, 0

    def iter(self, text):
        self.read += len(text)
        return self.automaton.iter(text)


def test_automaton_reads_what_can_hold_a_passage():
    """Text without a passage's word sequences is not read, nor a stretch too short for any passage."""
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(60)]
    words = [rng.choice(passage) for _ in range(5000)]  # only words that the passage has
    phrases = S.Phrases(pa.array([" ".join(passage)]))
    phrases.automaton = Counted(phrases.automaton)
    s = next(S.slices(pa.array([" ".join(words + passage + words + passage[:59])])))
    assert np.flatnonzero(phrases.cover(s.hashes())).tolist() == [*range(5000, 5060)]
    assert 60 <= phrases.automaton.read < 200


@pytest.mark.parametrize("codes", [S._CODES, 2])
def test_cover_of_several_documents(monkeypatch, codes):
    """Overlapping, nested and adjoining occurrences, cut at documents, equal those of plain search."""
    monkeypatch.setattr(S, "_CODES", codes)
    rng = random.Random(6)
    for _ in range(60):
        patterns = [[rng.choice("ab") for _ in range(rng.randint(9, 14))] for _ in range(6)]
        patterns += [patterns[0][1:], patterns[1] + patterns[2], ["a"] * 9]
        texts = [[x for _ in range(rng.randint(0, 4)) for x in rng.choice([*patterns, ["c"], patterns[3][:8], ["a"] * 30])] for _ in range(12)]
        texts[3], texts[4] = patterns[0], patterns[1]
        s = next(S.slices(pa.array([" ".join(t) for t in texts])))
        want = []
        for t in texts:
            gone = {i + j for p in patterns for i in range(len(t) - len(p) + 1) if t[i : i + len(p)] == p for j in range(len(p))}
            want += [i in gone for i in range(len(t))]
        got = S.Phrases(pa.array([" ".join(p) for p in patterns])).cover(s.hashes(), s.first)
        assert got.tolist() == want
        begin, end = S._runs(got, s.first)
        assert sum((end - begin).tolist()) == sum(want) and not any(a < x < b for a, b in zip(begin, end, strict=True) for x in s.first.tolist())


def test_only_windows_of_mixed_anchors_are_looked_up(monkeypatch):
    asked = []
    flag = S.Known.flag
    monkeypatch.setattr(S.Known, "flag", lambda self, h: asked.append(len(h)) or flag(self, h))
    batch = pa.RecordBatch.from_pylist([{"text": " ".join(f"w{i}" for i in range(2000))}])
    w = S.Windows(next(S.slices(batch.column("text"))))
    mixed = w.anchor[7]

    class Sent:
        value = S.Known(np.array([mixed]), np.array([2], np.int8)), S.Known(w.hash[w.run == 7], np.ones((w.run == 7).sum(), np.int8))

    (_, own), = S._own_passages(batch, Sent)
    first = int(w.first[7])
    assert [(d, a, b) for d, a, b, _ in own] == [(0, first, first + int((w.run == 7).sum()) + 34)]
    assert asked == [len(w.anchor), (w.run == 7).sum()]
