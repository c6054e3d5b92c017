import random

import numpy as np

from chronogrid.llm import near_dedup as N
from chronogrid.llm.graph import connected_components

from . import corpus


def labelled(text):
    w = corpus.words(text)
    seen, out = {}, []
    for i in range(len(w) - 4):
        s = tuple(w[i : i + 5])
        seen[s] = seen.get(s, 0) + 1
        out.append((s, seen[s]))
    return out


def similarity(x, y):
    """Longest common subsequence of labelled shingles, by the plain table."""
    a, b = labelled(x), labelled(y)
    if not a or not b:
        return 0.0
    row = [0] * (len(b) + 1)
    for p in a:
        new = [0]
        for j, q in enumerate(b):
            new.append(row[j] + 1 if p == q else max(row[j + 1], new[j]))
        row = new
    return row[-1] / (len(a) + len(b) - row[-1])


def brute(docs):
    """Classes by comparing all pairs."""
    ids = [d[0] for d in docs if d[0] is not None and corpus.words(d[1])]
    text = {d[0]: d[1] for d in docs}
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if corpus.words(text[a]) == corpus.words(text[b]) or similarity(text[a], text[b]) >= 0.8:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids} | {d[0]: d[0] for d in docs if d[0] not in parent}


def family(seed, size, n=60, edits=2):
    rng = random.Random(seed)
    base = corpus.prose(rng, [f"w{i}" for i in range(900)], n).split()
    out = []
    for _ in range(size):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_classes_equal_brute_force(spark):
    docs = corpus.rows(80, 9)
    k = 200
    for seed in range(12):
        for text in family(seed, 4):
            docs.append((k, text, "", "", 0, 0, "", ""))
            k += 1
    got = {r.doc_id: r.class_id for r in N.near_duplicates(corpus.frame(spark, docs)).collect()}
    assert got == brute(docs)


def test_large_families_stay_whole(spark):
    docs = [(i, t, "", "", 0, 0, "", "") for i, t in enumerate(family(1, 120, 80, 2) + family(2, 60, 80, 1) + ["copy of a text that many have and share"] * 200)]
    want = brute([d for d in docs if d[0] < 180])
    got = {r.doc_id: r.class_id for r in N.near_duplicates(corpus.frame(spark, docs)).collect()}
    assert {i: got[i] for i in want} == want and {got[i] for i in range(180, 380)} == {180}


def test_a_chain_of_edits_is_one_class(spark):
    """Each text is an edit of the one before; ends of the chain are far apart."""
    rng = random.Random(8)
    w = [f"w{rng.randrange(10**6)}" for _ in range(80)]
    docs = []
    for i in range(60):
        docs.append((i, " ".join(w), "", "", 0, 0, "", ""))
        w[rng.randrange(80)] = f"w{rng.randrange(10**6)}"
    want = brute(docs)
    assert similarity(docs[0][1], docs[59][1]) < 0.5 and set(want.values()) == {0}
    assert {r.doc_id: r.class_id for r in N.near_duplicates(corpus.frame(spark, docs)).collect()} == want


def star(n, hub):
    """Copies of one text with 4 of 200 words replaced: similar to it and not to each other; `hub` is its id."""
    rng = random.Random(12)
    w = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    docs = []
    for i in range(n):
        own = list(w)
        for at in [] if i == hub else [20 + 45 * k + rng.randrange(30) for k in range(4)]:
            own[at] = f"e{rng.randrange(10**9)}"
        docs.append((i, " ".join(own), "", "", 0, 0, "", ""))
    return docs


def test_a_star_with_its_hub_in_the_middle_is_one_class(spark):
    for n in (60, 150):
        docs = star(n, n // 2)
        assert all(similarity(docs[n // 2][1], d[1]) >= 0.8 for d in docs[:5]) and similarity(docs[0][1], docs[1][1]) < 0.8
        got = {r.doc_id: r.class_id for r in N.near_duplicates(corpus.frame(spark, docs)).collect()}
        assert set(got.values()) == {0}


def test_no_similar_pair_remains(spark):
    """Pairs of an own text inside a family that shares most sketches: no leader is similar to both."""
    rng = random.Random(4)
    shared = [f"s{rng.randrange(10**6)}" for _ in range(70)]
    docs = []
    for i in range(80):
        own = shared + [f"u{i // 2}x{j}" for j in range(30)]
        own[rng.randrange(70)] = f"e{i}"
        docs.append((i // 2 + 40 * (i % 2), " ".join(own), "", "", 0, 0, "", ""))
    want = brute(docs)
    assert len(set(want.values())) > 5
    assert {r.doc_id: r.class_id for r in N.near_duplicates(corpus.frame(spark, docs)).collect()} == want


def test_prefixes_of_similar_texts_meet():
    rng = np.random.default_rng(6)
    for _ in range(200):
        a = rng.integers(0, 1 << 32, rng.integers(1, 60), dtype=np.uint64).astype("<u4")
        b = a[rng.random(len(a)) < 0.9]
        times = rng.integers(0, 3, 1 << N.ORDER_BITS)
        if len(b) and N.aligned_similarity(a, b):
            assert np.intersect1d(N.prefix(a, times), N.prefix(b, times)).size


def test_shared_passage_does_not_link(spark):
    rng = random.Random(3)
    shared = corpus.prose(rng, corpus.EN, 40)
    docs = [(i, shared + " " + " ".join(f"u{i}x{j}" for j in range(60)), "", "", 0, 0, "", "") for i in range(150)]
    got = N.near_duplicates(corpus.frame(spark, docs)).collect()
    assert all(r.doc_id == r.class_id for r in got)


def test_alignment():
    rng = random.Random(5)
    for _ in range(300):
        a = rng.sample(range(60), rng.randint(1, 40))
        b = [x for x in a if rng.random() < 0.95] + rng.sample(range(100, 140), rng.randint(0, 3))
        if rng.random() < 0.3:
            rng.shuffle(b)
        if not b:
            continue
        row = [0] * (len(b) + 1)
        for p in a:
            new = [0]
            for j, q in enumerate(b):
                new.append(row[j] + 1 if p == q else max(row[j + 1], new[j]))
            row = new
        exact = row[-1] / (len(a) + len(b) - row[-1])
        got = N.aligned_similarity(np.array(a, "<u4"), np.array(b, "<u4"))
        assert got == (exact if exact >= 0.8 else 0.0)


def test_deduplicate(spark):
    docs = [(1, "a b c d e f g", "", "", 0, 0, "", ""), (2, "a  b c d e f g", "", "", 0, 0, "", ""), (3, None, "", "", 0, 0, "", ""), (4, "", "", "", 0, 0, "", ""), (5, "", "", "", 0, 0, "", ""), (None, "a b c d e f g", "", "", 0, 0, "", ""), (6, "x y", "", "", 0, 0, "", ""), (7, "x y", "", "", 0, 0, "", ""), (1, "a b c d e f g", "", "", 0, 0, "", "")]
    out = N.deduplicate(corpus.frame(spark, docs))
    assert sorted((r.doc_id or -1) for r in out.collect()) == [-1, 1, 3, 4, 5, 6] and out.columns == corpus.frame(spark, docs).columns
    assert N.near_duplicates(corpus.frame(spark, [])).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 40)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(30)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}

    def find(i):
        return i if parent[i] == i else find(parent[i])

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert got == {i: find(i) for e in edges for i in e if e[0] != e[1]} | {i: find(i) for i in got}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
