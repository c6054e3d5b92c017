import re

import numpy as np

from chronogrid.llm import quality_mcd as Q

from . import corpus


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    at = {}
    for i in range(len(words) - 7):
        at.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_base_statistics(spark):
    data = corpus.rows()
    out = {r.doc_id: r for r in Q.quality_outliers(corpus.frame(spark, data)).collect()}
    assert len(out) == len(data)
    for r in data:
        n, chars, symbols, dup, repeat = brute(r[1])
        o = out[r[0]]
        assert (o.n_words, o.word_chars, o.n_symbols, o.n_dup_lines, o.n_repeat_words) == (n, chars, symbols, dup, repeat)
        assert o.base_failed == (n < 20 or 100 * repeat > 30 * n) and not (o.base_failed and o.kept)


def test_outliers_by_group(spark):
    import random

    rng = random.Random(5)
    data = []
    for i in range(600):
        text = corpus.prose(rng, corpus.EN, rng.randint(40, 120))
        if i % 10 == 0:
            text = " ".join(w + "%%&&" for w in text.split())
        data.append((i, text, "en", "big" if i % 3 else "small", 0, 0, "", ""))
    out = {r.doc_id: r for r in Q.quality_outliers(corpus.frame(spark, data)).collect()}
    bad = [i for i in out if i % 10 == 0]
    assert not any(out[i].kept for i in bad) and np.mean([out[i].kept for i in out if i % 10]) > 0.99
    again = {r.doc_id: r for r in Q.quality_outliers(corpus.frame(spark, data + data[:3], 5)).collect()}
    assert all(out[i].kept == again[i].kept for i in out)


def test_small_and_empty(spark):
    few = corpus.rows(10)
    assert len(few) < Q.MIN_GROUP
    out = Q.quality_outliers(corpus.frame(spark, few)).collect()
    assert all(r.kept != r.base_failed and r.distance is None for r in out)
    assert Q.quality_outliers(corpus.frame(spark, [])).count() == 0


def test_concentration_finds_the_robust_centre():
    """The steps against a plain version that sorts all distances."""
    import pandas as pd

    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, Q.DIMENSIONS))
    x[:60] += 8
    mean, cov = np.median(x, 0), np.eye(Q.DIMENSIONS)
    mu, inv, _ = Q._estimate(mean, cov, 0.1)
    for _ in range(6):
        d = np.einsum("ij,jk,ik->i", x - mu, np.array(inv).reshape(6, 6), x - mu)
        bins = np.floor(8 * np.log2(np.maximum(d, 1e-6))).astype(int)
        rows = []
        for b in np.unique(bins):
            own = x[bins == b]
            rows.append({"key": "k", "start": 0, "bin": b, "n": len(own)} | {f"s{i}": own[:, i].sum() for i in range(6)} | {f"p{i}_{j}": (own[:, i] * own[:, j]).sum() for i in range(6) for j in range(i, 6)})
        r = Q._concentrate(0.1, 0.75, True)(("k",), pd.DataFrame(rows)).iloc[0]
        # what the step keeps: whole bins, up to the one that holds the nearest three quarters
        kept = bins <= np.sort(bins)[int(0.75 * 500) - 1]
        assert np.allclose(r.mu, x[kept].mean(0)) and np.allclose(np.linalg.inv(np.array(r.inv).reshape(6, 6)), np.cov(x[kept].T, bias=True) + 0.01 * np.eye(6))
        mu, inv = np.array(r.mu), r.inv
    assert np.abs(mu).max() < 0.25  # the far tenth does not pull the centre


def vectors(rows):
    n = np.maximum([r.n_words for r in rows], 1)
    rate = lambda name, by: np.log1p(by * np.array([getattr(r, name) for r in rows]) / n)
    return np.column_stack([np.log1p(np.array([r.word_chars for r in rows]) / n), rate("n_symbols", 20), rate("n_dup_lines", 50), rate("n_repeat_words", 10), rate("n_upper", 5), rate("n_punct", 5)])


def plain_kept(x):
    """Concentration steps over all distances of one group, from both starts; bins of an eighth of an octave."""
    found = []
    q = np.quantile(x, [0.25, 0.5, 0.75], axis=0, method="inverted_cdf")
    for mean, spread in ((q[1], ((q[2] - q[0]) / 1.349) ** 2), (x.mean(0), x.var(0))):
        cov = np.diag(spread) + 0.15**2 * np.eye(6)
        for _ in range(Q.STEPS):
            d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            bins = np.floor(8 * np.log2(np.maximum(d, 1e-6)))
            order = np.sort(bins)
            near = x[bins <= order[int(np.ceil(0.75 * len(x))) - 1]]
            mean, cov = near.mean(0), np.cov(near.T, bias=True) + 0.15**2 * np.eye(6)
            scale = max(1.0, 2 ** ((order[int(np.ceil(len(x) / 2)) - 1] + 0.5) / 8) / Q.CHI2_MEDIAN)
        found.append((np.linalg.slogdet(cov)[1], mean, cov, scale))
    _, mean, cov, scale = min(found, key=lambda f: f[0])
    return np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean) / scale


def test_verdicts_equal_plain_ones(spark):
    import random

    rng = random.Random(9)
    data = []
    for i in range(420):
        text = corpus.prose(rng, corpus.EN, rng.randint(30, 90))
        if i % 12 == 0:
            text = " ".join(w + rng.choice(["%%&&", "###", "<<>>"]) for w in text.split())
        data.append((i, text, "en" if i % 2 else None, "a" if i % 7 else "b", 0, 0, "", ""))
    rows = Q.quality_outliers(corpus.frame(spark, data)).collect()
    group = {d[0]: (d[2], d[3]) for d in data}
    sizes = {g: sum(group[r.doc_id] == g and not r.base_failed for r in rows) for g in set(group.values())}
    large = [g for g, n in sizes.items() if n >= Q.MIN_GROUP]
    assert len(large) == 2
    rejected = set()
    for g in large:
        own = [r for r in rows if group[r.doc_id] == g and not r.base_failed]
        want = plain_kept(vectors(own))
        assert np.allclose([r.distance for r in own], want, rtol=0.02) and [r.kept for r in own] == list(want <= Q.CUTOFF)
        rejected |= {r.doc_id for r in own if not r.kept}
    assert rejected and all(i % 12 == 0 for i in rejected)


def test_long_text_and_ties(spark):
    data = [(i, "word and river under stone " * 6 + f"x{i} y{i}" * 3, "en", "a", 0, 0, "", "") for i in range(60)]
    data += [(100, " ".join(f"w{k}" for k in range(200_000)), "en", "a", 0, 0, "", "")] + data[:5]
    out = Q.quality_outliers(corpus.frame(spark, data)).collect()
    assert len(out) == 66 and next(r for r in out if r.doc_id == 100).n_words == 200_000
    assert len({(r.doc_id, r.kept, r.distance) for r in out}) == 61
