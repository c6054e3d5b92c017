import random

import numpy as np
import pytest

from chronogrid.llm import decontamination as D

from . import corpus


def plain_smith_waterman(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return int(h.max())


def test_alignment_scores():
    rng = random.Random(1)
    for _ in range(150):
        a = np.array([rng.randint(0, 4) for _ in range(rng.randint(1, 12))], np.uint64)
        b = np.array([rng.randint(0, 4) for _ in range(rng.randint(1, 25))], np.uint64)
        score, first, last = D.smith_waterman(a, b)
        assert score == plain_smith_waterman(a, b)
        if score:
            assert plain_smith_waterman(a, b[first : last + 1]) == score


def planted(seed=2):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(12, 40)))) for i in range(25)]
    docs, truth = [], {}
    for i in range(200):
        text = corpus.prose(rng, vocabulary, rng.randint(20, 150)).split()
        if i % 4 == 0:
            k = rng.randrange(len(items))
            passage = items[k][1].split()
            if i % 8 == 0:  # an edited copy
                for _ in range(max(1, len(passage) // 8)):
                    at = rng.randrange(len(passage))
                    passage[at : at + 1] = rng.choice([["new"], [], [passage[at], "more"]])
            at = rng.randrange(len(text))
            text[at:at] = [w.upper() + "," for w in passage]
            truth[i] = k
        docs.append((i, " ".join(text), "en", "a", 0, 0, "", ""))
    return items, docs, truth


def bench(spark, items):
    return spark.createDataFrame([(*i, "c") for i in items], "item_id long, text string, doc_id string")


def test_planted_passages(spark):
    items, docs, truth = planted()
    out = D.contaminated(corpus.frame(spark, docs), bench(spark, items)).collect()
    assert {(r.doc_id, r.item_id) for r in out} == set(truth.items())
    for r in out:
        words = docs[r.doc_id][1].split()
        assert 0 <= r.first_word <= r.last_word < len(words) and 0.5 <= r.score <= 1
        if r.doc_id % 8:
            assert r.score == 1 and " ".join(words[r.first_word : r.last_word + 1]).replace(",", "").lower() == items[r.item_id][1]
    kept = D.decontaminate(corpus.frame(spark, docs), bench(spark, items))
    assert {r.doc_id for r in kept.collect()} == {d[0] for d in docs} - set(truth) and kept.columns == corpus.frame(spark, docs).columns


def test_a_frequent_item_still_has_seeds(spark):
    items, docs, _ = planted()
    hot = [(1000 + i, f"start {items[3][1]} end{i}", "en", "a", 0, 0, "", "") for i in range(300)]
    out = D.contaminated(corpus.frame(spark, docs + hot), bench(spark, items)).collect()
    assert {r.doc_id for r in out if r.item_id == 3} >= {1000 + i for i in range(300)}
    blocks = D.contaminated(corpus.frame(spark, docs), bench(spark, items), block_bytes=300).collect()
    assert {(r.doc_id, r.item_id) for r in blocks} == set(planted()[2].items())


def test_odd_rows(spark):
    odd = bench(spark, [(1, None), (2, ""), (3, "too short"), (None, "an item without any identifier of its own"), (4, "ÉTÉ comme HIVER nous irons tous au jardin")])
    docs = corpus.rows(5) + [(70, "x an item without any identifier of its own y", "", "", 0, 0, "", ""), (71, "été, comme hiver, nous irons TOUS au jardin", "", "", 0, 0, "", "")]
    out = D.contaminated(corpus.frame(spark, docs), odd).collect()
    assert {(r.doc_id, r.item_id) for r in out} == {(70, None), (71, 4)}
    assert D.contaminated(corpus.frame(spark, []), odd).count() == 0
    assert D.contaminated(corpus.frame(spark, docs), bench(spark, [])).count() == 0
    assert D.decontaminate(corpus.frame(spark, docs), bench(spark, [])).count() == len(docs)


def test_seeds_cover_every_stretch():
    items = D.Items.of([(1, " ".join(f"w{i}" for i in range(30)))])
    counts = {int(h): (0 if k % 9 else 50) for k, h in enumerate(D.window_hash(items.words[0], D.N))}
    at = sorted(items.seeds(counts, 5)[2].tolist())
    assert at[0] < 5 and at[-1] >= 28 - 5 and max(np.diff(at)) <= 5


@pytest.mark.parametrize("text", [None, "", "a", "a b"])
def test_short_items(text):
    assert D.Items.of([(1, text or "")]).words == []


def test_intact_grams_beside_broken_ones_are_seeds(spark):
    """The corpus holds only an edited copy: n-grams broken by its edits have count 0 and must not displace intact ones."""
    item = [f"w{i}" for i in range(20)]
    copy = list(item)
    for at in (3, 7, 11, 15):
        copy[at] = f"e{at}"
    docs = [(1, " ".join(["before"] * 9 + copy + ["after"] * 9), "en", "a", 0, 0, "", "")]
    out = D.contaminated(corpus.frame(spark, docs), bench(spark, [(1, " ".join(item))])).collect()
    assert [(r.doc_id, r.item_id, r.score) for r in out] == [(1, 1, 0.6)]
    assert D.decontaminate(corpus.frame(spark, docs), bench(spark, [(1, " ".join(item))])).count() == 0


def test_every_passage_and_short_items(spark):
    item = " ".join(f"w{i}" for i in range(6))
    long = " ".join(f"v{i}" for i in range(20))
    docs = [(1, f"x {item} {item} y", "", "", 0, 0, "", ""), (2, f"{long} {long} gap {long}", "", "", 0, 0, "", ""), (3, "a Lone, short item b", "", "", 0, 0, "", ""), (4, "a lone short thing w0 w1 w2 w3", "", "", 0, 0, "", "")]
    out = D.contaminated(corpus.frame(spark, docs), bench(spark, [(1, item), (2, long), (3, "lone short item"), (4, "also a lone short")])).collect()
    got = sorted((r.doc_id, r.item_id, r.score, r.first_word, r.last_word) for r in out)
    assert got == [(1, 1, 1.0, 1, 6), (1, 1, 1.0, 7, 12), (2, 2, 1.0, 0, 19), (2, 2, 1.0, 20, 39), (2, 2, 1.0, 41, 60), (3, 3, 1.0, 1, 3)]


def test_pairs_equal_brute_force(spark):
    """All documents against all items by the plain table; items of 8 words or more, edited in every way."""
    items, docs, _ = planted(7)
    docs = docs[:60]
    words = lambda t: t.lower().replace(",", "").split()
    numbers = {}
    coded = lambda t: [numbers.setdefault(w, len(numbers)) for w in words(t)]
    want = set()
    for d in docs:
        b = coded(d[1])
        grams = {tuple(b[i : i + D.N]) for i in range(len(b))}
        for k, text in items:
            a = coded(text)
            if any(tuple(a[i : i + D.N]) in grams for i in range(len(a) - D.N + 1)) and plain_smith_waterman(a, b) >= D.MIN_SCORE * len(a):
                want.add((d[0], k))
    got = {(r.doc_id, r.item_id) for r in D.contaminated(corpus.frame(spark, docs), bench(spark, items)).collect()}
    assert got == want and len(want) >= 15


def test_long_text_ties_and_repeated_rows(spark):
    item = " ".join(f"w{i}" for i in range(12))
    row = (1, "filler words " * 60_000 + item, "", "", 0, 0, "", "")
    out = D.contaminated(corpus.frame(spark, [row, row]), bench(spark, [(1, item), (1, item)])).collect()
    assert [(r.doc_id, r.item_id, r.first_word) for r in out] == [(1, 1, 120_000)] * 4
