import numpy as np
import pytest
from pyspark.sql import functions as F

from chronogrid.llm import mixing as M

from . import corpus


def test_targets():
    assert M.targets([100, 100, 100]) == pytest.approx([200, 250 / 3, 500 / 3])  # 225, 75, 150: the first stops at 200
    sizes = [10, 500, 40, 0, 90]
    t = M.targets(sizes)
    assert all(x <= 2 * n + 1e-9 for x, n in zip(t, sizes, strict=True)) and sum(t) == pytest.approx(1.5 * sum(sizes))
    free = [i for i in range(5) if t[i] < 2 * sizes[i]]
    w = [M.WEIGHTS[i % 3] for i in range(5)]
    assert len({round(t[i] / w[i], 9) for i in free}) <= 1
    assert M.targets([]) == [] and M.targets([0, 0]) == [0, 0]


@pytest.mark.parametrize("n", [1, 2, 3, 64, 65, 1000])
def test_permutation(n):
    a = M.permute(np.arange(n), n, 5)
    assert sorted(a.tolist()) == list(range(n))
    if n > 60:
        assert a.tolist() != list(range(n)) and (M.permute(np.arange(n), n, 6) != a).any()


def test_mixture(spark):
    data = corpus.rows(150)
    docs = corpus.frame(spark, data)
    out = M.mix_sources(docs, block_words=8).collect()
    assert len(out) == len(data)
    size = {r[0]: len(corpus.words(r[1])) for r in data}
    totals, target, taken = {}, {}, {}
    source = {r[0]: r[3] for r in data}
    for r in data:
        totals[r[3]] = totals.get(r[3], 0) + size[r[0]]
    order = sorted(totals, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, M.targets([totals[s] for s in order]), strict=True))
    for r in out:
        s = source[r.doc_id]
        assert r["size"] == size[r.doc_id] and r.source_size == totals[s] and r.target == pytest.approx(want[s])
        assert 0 <= r.taken <= 2 * r["size"]
        taken[s] = taken.get(s, 0) + r.taken
        target[s] = r.target
    for s in taken:
        assert abs(taken[s] - target[s]) <= 8 + 0.02 * target[s]
    again = M.mix_sources(docs.repartition(5), block_words=8).collect()
    assert sorted((r.doc_id or -1, r.taken) for r in out) == sorted((r.doc_id or -1, r.taken) for r in again)


def test_blocks_join_to_words(spark):
    docs = corpus.frame(spark, corpus.rows(80))
    plan = M.Mixture(docs, block_words=16, shard_blocks=60)
    pieces = plan.pieces().collect()
    seen = {}
    for p in pieces:
        seen.setdefault(p.row, []).append((p["first"], p.length))
    for r in plan.rows.where("size > 0").collect():
        spans = sorted(seen[r.row])
        assert spans[0][0] == 0 and sum(n for _, n in spans) == r["size"]
        assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False))
    full = {}
    for p in pieces:
        full[p.source_index, p.block] = full.get((p.source_index, p.block), 0) + p.length
    for i, b in enumerate(plan.blocks):
        own = [full[i, k] for k in range(b)]
        assert all(n == 16 for n in own[:-1])
    draws = plan.draws().groupBy("source_index", "block").count().agg(F.max("count")).first()[0]
    assert draws <= 2


def test_empty_and_repeated(spark):
    assert M.mix_sources(corpus.frame(spark, [])).count() == 0
    row = (1, "a b c d", "en", "s", 0, 0, "", "")
    out = M.mix_sources(corpus.frame(spark, [row, row, (2, None, None, None, 0, 0, "", "")]), block_words=2).collect()
    assert len(out) == 3 and sum(r.taken for r in out if r.doc_id == 1) == 12 and all(r.taken <= 8 for r in out)


def plain_draws(plan, shard_blocks, seed):
    """Shard after shard and slot after slot; struck beyond the most, made up to the fewest."""
    aims = [t * b / n if n else 0.0 for (_, n), t, b in zip(plan.sources, plan.targets, plan.blocks, strict=True)]
    total, out, have = round(sum(aims)), set(), [0] * len(aims)
    block = lambda i, slot: int(M.permute(np.array([slot % plan.blocks[i]]), plan.blocks[i], M.permutation_key(seed, i, slot // plan.blocks[i]))[0])
    shards = -(-total // shard_blocks)
    for shard in range(shards):
        slots = min(shard_blocks, total - shard * shard_blocks)
        for i, n in enumerate(np.random.default_rng([seed, shard]).multinomial(slots, np.array(aims) / sum(aims))):
            out |= {(i, block(i, j), shard, j) for j in range(have[i], have[i] + n) if j < plan.high[i]}
            have[i] += int(n)
    for i, low in enumerate(plan.low):
        out |= {(i, block(i, j), shards, j) for j in range(have[i], low)}
    return out


def test_draws_equal_plain_ones(spark):
    docs = corpus.frame(spark, corpus.rows(120))
    found = {}
    for per, seed, tolerance in ((50, 17, 0.005), (20, 17, 0.2), (20, 18, 0.2)):
        plan = M.Mixture(docs, block_words=4, shard_blocks=per, seed=seed, tolerance=tolerance)
        rows = plan.draws().select("source_index", "block", "shard", "draw").collect()
        found[per, seed] = {tuple(r) for r in rows}
        assert len(rows) == len(found[per, seed]) and found[per, seed] == plain_draws(plan, per, seed)
        got = [sum(1 for r in found[per, seed] if r[0] == i) for i in range(len(plan.sources))]
        assert all(lo <= n <= hi for lo, n, hi in zip(plan.low, got, plan.high, strict=True))
    kept = [sorted((i, b) for i, b, _, _ in x) for x in found.values()]
    assert kept[0] != kept[1] and kept[1] != kept[2]  # shard size, tolerance and seed reach the result


def test_many_sources_and_ids_that_are_null_or_equal(spark):
    rows = [(None if k % 2 else 7, f"w{k} " * (1 + k % 5), "en", f"s{k % 300:03d}", 0, 0, "", "") for k in range(1500)]
    docs = corpus.frame(spark, rows)
    plan = M.Mixture(docs, block_words=4)
    out = M.mix_sources(docs, block_words=4).collect()
    assert len(out) == 1500 and len(plan.sources) == 300 and all(0 <= r.taken <= 2 * r["size"] for r in out)
    assert sum(r["size"] for r in out) == sum(1 + k % 5 for k in range(1500))


def test_a_very_long_text(spark):
    docs = corpus.frame(spark, [(1, "word " * 300_000, "en", "a", 0, 0, "", ""), (2, "x y", "en", "b", 0, 0, "", "")])
    got = {r.doc_id: r for r in M.mix_sources(docs).collect()}
    assert got[1]["size"] == 300_000 and abs(got[1].taken - got[1].target) <= 0.006 * got[1].target and got[2].taken <= 4
