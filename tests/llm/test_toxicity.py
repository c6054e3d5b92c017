import math
import random

import numpy as np
import pyarrow as pa

from chronogrid.llm import toxicity as T

from . import corpus

LB = "doc_id long, quality int, toxic int, text string"


def data(n=600):
    rng = random.Random(11)
    docs, labels = [], []
    for i in range(n):
        w = corpus.prose(rng, corpus.EN, rng.randint(20, 120)).split()
        toxic = i % 5 == 0
        if toxic:
            for _ in range(rng.randint(2, 5)):
                w[rng.randrange(len(w))] = rng.choice(["moron,", "SCUM", "idiot", "vile!"])
        docs.append((i, " ".join(w), "en", "s", 0, 0, "", ""))
        if rng.random() < 0.8:
            labels.append((i, 1, int(toxic), "c"))
    return docs, labels


def test_held_out(spark):
    docs, labels = data()
    odd = [(2000, None, None, None, 0, 0, "", ""), (2001, "", "", "", 0, 0, "", ""), (2002, "!!! ...", "", "", 0, 0, "", ""), (None, "an idiot and a moron", "", "", 0, 0, "", ""), docs[0]]
    labels += [(3, None, None, "c"), (5, 1, 0, "c"), (None, 1, 1, "c")]
    out = T.toxicity(corpus.frame(spark, docs + odd), spark.createDataFrame(labels, LB)).collect()
    assert len(out) == len(docs) + len(odd)
    by = {r.doc_id: r for r in out}
    unseen = [i for i in range(600) if corpus.held(i)]
    assert np.mean([by[i].predicted == (i % 5 == 0) for i in unseen]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert all(by[i].held_out == corpus.held(i) for i in range(600))
    assert by[2000].score == by[2001].score == by[2002].score and by[2000].predicted == 0
    assert len({r.score for r in out if r.doc_id == 0}) == 1


def test_held_out_labels_are_not_read(spark):
    docs, labels = data(200)
    flipped = [(i, q, 1 - t if corpus.held(i) else t, c) for i, q, t, c in labels]
    frame = corpus.frame(spark, docs)
    a, b = ({r.doc_id: r.score for r in T.toxicity(frame, spark.createDataFrame(x, LB)).collect()} for x in (labels, flipped))
    assert a == b


def test_one_class_or_none(spark):
    docs, _ = data(20)
    for labels in ([], [(i, 1, 0, "c") for i in range(20)]):
        out = T.toxicity(corpus.frame(spark, docs), spark.createDataFrame(labels, LB)).collect()
        assert len(out) == 20 and all(r.score == 0 and r.predicted == 0 for r in out)
    assert T.toxicity(corpus.frame(spark, []), spark.createDataFrame([], LB)).count() == 0


def plain_words(text):
    kept = "".join(c.lower() if c.isascii() else c for c in text or "" if not (c.isascii() and not c.isalnum() and not c.isspace()))
    return kept.split()


def plain_model(docs, labels, discount):
    """(log P_c(w), log P_c(w | v)) of both classes for each word of a text, in plain Python."""
    pairs = lambda words: list(zip(["<s>", *words][: len(words)], words, strict=True))
    vocabulary = {w for d in docs if d[0] in labels for w in plain_words(d[1])}
    close = lambda words: [w if w in vocabulary else "<other>" for w in words]
    shared = {}
    for v, w in {p for d in docs for p in pairs(close(plain_words(d[1])))}:
        shared[w] = shared.get(w, 0) + 1
    size = len(vocabulary) + 2

    def score(text, without=None):
        out = []
        for c in (0, 1):
            n = {}
            for d in docs:
                if labels.get(d[0]) == c and d[0] != without:
                    for p in pairs(plain_words(d[1])):
                        n[p] = n.get(p, 0) + 1
            preceding, history, taken = {}, {}, {}
            for (v, w), k in n.items():
                preceding[w] = preceding.get(w, 0) + 1
                history[v] = history.get(v, 0) + k
                taken[v] = taken.get(v, 0) + min(k, discount)
            left = sum(min(k, discount) for k in preceding.values())
            logs = []
            for v, w in pairs(close(plain_words(text))):
                base = (shared.get(w, 0) + 0.5) / (sum(shared.values()) + size / 2)
                p = (max(preceding.get(w, 0) - discount, 0) + left * base) / len(n) if n else base
                q = (max(n.get((v, w), 0) - discount, 0) + taken[v] * p) / history[v] if v in history else p
                logs.append((math.log(p), math.log(q)))
            out.append(logs)
        return out

    return score


def test_log_likelihoods_equal_plain_ones(spark):
    docs, labels = data(60)
    docs += [(700, None, "", "", 0, 0, "", ""), (701, "rare words only here", "", "", 0, 0, "", "")]
    known = {i: t for i, _, t, _ in labels}
    frame = corpus.frame(spark, docs)
    marked = frame.join(spark.createDataFrame(labels, LB).select("doc_id", "toxic"), "doc_id")
    for discount in (0.75, 3.0):
        model = T.class_counts(marked.select("text", "toxic"), discount)
        model.shared = T.shared_counts(frame, model.vocabulary)
        score = plain_model(docs, known, discount)
        for d in [*docs[:12], *docs[-2:]]:
            for s in T.normalised_slices(pa.array([d[1]], pa.string())):
                word, earlier = T.encode(model.vocabulary, s)
                cases = [(None, None)] + ([(d[0], T.Own(model, s, word, earlier, np.array([known[d[0]]])))] if d[0] in known else [])
                for without, own in cases:
                    got = model.log_probabilities(word, earlier, own)
                    want = score(d[1], without)
                    for c in (0, 1):
                        assert np.allclose(np.array(got[c]).T.reshape(-1, 2), np.array(want[c]).reshape(-1, 2))


def test_expressions_of_ordinary_words(spark):
    """Pairs tell the classes apart where the words alone do not."""
    rng = random.Random(5)
    docs, labels = [], []
    for i in range(400):
        w = corpus.prose(rng, corpus.EN, 40).split()
        for _ in range(4):
            at = rng.randrange(39)
            w[at : at + 2] = ["alpha", "beta"] if i % 2 else ["beta", "alpha"]
        docs.append((i, " ".join(w), "", "", 0, 0, "", ""))
        labels.append((i, 1, i % 2, "c"))
    out = T.toxicity(corpus.frame(spark, docs), spark.createDataFrame(labels, LB)).where("held_out").collect()
    assert np.mean([(r.score >= 0.5) == bool(r.doc_id % 2) for r in out]) > 0.9


def test_bounded_sample_and_long_text(spark):
    docs, labels = data(300)
    docs.append((800, "idiot " + "word and river " * 100_000, "", "", 0, 0, "", ""))
    out = T.toxicity(corpus.frame(spark, docs), spark.createDataFrame(labels, LB), class_chars=20_000, calibration_rows=50).collect()
    assert len(out) == 301 and all(0 <= r.score <= 1 for r in out)
