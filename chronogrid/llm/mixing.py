"""Mixing sources to target weights by fixed-length blocks.

A source's documents are laid end to end in pseudorandom order and packed into blocks of `block_words`
words.  The mixture is written as output shards of `shard_blocks` slots; each shard draws how many slots every
source gets from one multinomial over the targets.  A source's slots are numbered through the shards, and slot
j of a source with n blocks takes block P_e(j mod n), where e = j div n and P_e is a keyed Feistel permutation
of 0..n-1, so a block is taken once an epoch.  Free draws wander from the targets, so they are reconciled: a
source's slots beyond its target (by `tolerance`, or one block) or beyond twice its blocks are struck from the
last shards that drew them, and what a source lacks is appended as a last shard.

Shards draw in parallel, each seeded by its own number; slots are joined to blocks by (source, index), keys
without skew.  A source's running word count is a two-level sum over hashed buckets, as many as the rows need,
so a hot source is never one task's.  The driver holds a few numbers per source and nothing per document,
block or shard.

Defined results: null text has size 0; null source is a source of its own, sorted last; rows are counted
separately even if equal (equal rows are interchangeable); an empty corpus gives no rows; a source without
words has target 0; null doc_id is allowed; a text of any length is cut into blocks by arithmetic on its
size; other columns are dropped.  Reruns agree, as everything derives from `seed` and the rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, broadcast_if_small, materialize
from .text import mix, slices

WEIGHTS, SHARE, CAP = (3, 1, 2), Fraction(3, 2), 2
BLOCK_WORDS, SHARD_BLOCKS, BUCKET_ROWS, TOLERANCE, SEED = 64, 8192, 2_000, 0.005, 17


def targets(sizes: Sequence[int], weights: Sequence[int] = WEIGHTS, share: Fraction = SHARE, cap: int = CAP) -> list[float]:
    """Each source's target in words: shares by repeated weight, none above `cap` times its size."""
    left, found, free = share * sum(sizes), [Fraction(0)] * len(sizes), set(range(len(sizes)))
    while free and left > 0:
        total = sum(weights[i % len(weights)] for i in free)
        full = {i for i in free if left * weights[i % len(weights)] > cap * sizes[i] * total}
        if not full:
            for i in free:
                found[i] = left * weights[i % len(weights)] / total
            break
        for i in full:
            found[i] = Fraction(cap * sizes[i])
            left -= found[i]
        free -= full
    return [float(x) for x in found]


def permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed pseudorandom permutation of 0..n-1 at the places given: Feistel rounds with cycle walking."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    rounds = mix(np.arange(1, 5, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key & (1 << 64) - 1))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        for k in rounds:
            left, right = right, left ^ (mix(right + k) & mask)
        return left << shift | right

    x = once(index.astype(np.uint64))
    while len(out := np.flatnonzero(x >= n)):
        x[out] = once(x[out])
    return x.astype(np.int64)


def shard_counts(shard: int, slots: int, shares: np.ndarray, seed: int) -> np.ndarray:
    """How many of a shard's slots each source gets: one multinomial draw."""
    return np.random.default_rng([seed, shard]).multinomial(slots, shares)


def limits(targets: Sequence[float], sizes: Sequence[int], blocks: Sequence[int], cap: int = CAP, tolerance: float = TOLERANCE) -> tuple[list[int], list[int]]:
    """The fewest and the most slots of each source: its target in blocks, give or take `tolerance` or a block."""
    low, high = [], []
    for t, n, b in zip(targets, sizes, blocks, strict=True):
        aim = t * b / n if n else 0.0
        slack = max(0.5, tolerance * aim)
        low.append(min(cap * b, round(aim - slack + 0.5)) if n else 0)
        high.append(max(low[-1], min(cap * b, round(aim + slack - 0.5))) if n else 0)
    return low, high


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = [s.counts for s in slices(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "source", "th")), pa.array(np.concatenate(n or [np.empty(0)]).astype(np.int64))], names=["doc_id", "source", "th", "size"])


class Mixture:
    """The plan of a mixture: `rows` (row, doc_id, source, size, source_size, target), pieces() and draws()."""

    def __init__(self, docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: Fraction = SHARE, cap: int = CAP, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, tolerance: float = TOLERANCE, seed: int = SEED) -> None:
        self.spark, self.block_words, self.shard_blocks, self.seed = docs.sparkSession, block_words, shard_blocks, seed
        bounded_batches(self.spark)
        docs = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string")).withColumn("th", F.xxhash64("text"))
        sized = materialize(docs.mapInArrow(_sizes, "doc_id long, source string, th long, size long").withColumn("row", F.monotonically_increasing_id()), "sizes")
        per_source = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).collect()
        buckets = 1 + sum(r["rows"] for r in per_source) // BUCKET_ROWS
        # the text's hash spreads rows whose ids are null or equal
        sized = sized.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "th", F.lit(seed)), F.lit(buckets)))
        sums = sized.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
        self.sources = sorted(((r.source, int(r["size"])) for r in per_source), key=lambda x: (x[0] is None, x[0] or ""))
        sizes = [n for _, n in self.sources]
        self.targets = targets(sizes, weights, share, cap)
        self.blocks = [-(-n // block_words) for n in sizes]
        self.low, self.high = limits(self.targets, sizes, self.blocks, cap, tolerance)
        known = self.spark.createDataFrame([(i, s, n, t) for i, ((s, n), t) in enumerate(zip(self.sources, self.targets, strict=True))], "source_index int, source_name string, source_size long, target double")
        self.rows = sized.join(broadcast_if_small(known), sized.source.eqNullSafe(known.source_name)).drop("source_name")
        before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        self._bucket_start = sums.select(F.col("source").alias("bucket_source"), F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("bucket_start"))

    def pieces(self) -> DataFrame:
        """source_index, block, row, doc_id, first (word in the document) and length: what blocks are made of."""
        placed = self.rows.where("size > 0").join(self._bucket_start, F.col("source").eqNullSafe(F.col("bucket_source")) & (F.col("bucket") == F.col("b")))
        inside = Window.partitionBy("source_index", "bucket").orderBy(F.xxhash64("doc_id", "th", F.lit(self.seed)), "doc_id", "th", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
        start = F.col("bucket_start") + F.coalesce(F.sum("size").over(inside), F.lit(0))
        b = F.lit(self.block_words)
        each = placed.withColumn("start", start).withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / b), F.floor((F.col("start") + F.col("size") - 1) / b))))
        lo, hi = F.greatest("start", F.col("block") * b), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * b)
        return each.select("source_index", "block", "row", "doc_id", (lo - F.col("start")).alias("first"), (hi - lo).alias("length"))

    def shards(self) -> DataFrame:
        """shard, source_index, before (slots that the source has in earlier shards) and n, as reconciled."""
        aims = np.array([t * b / n if n else 0.0 for (_, n), t, b in zip(self.sources, self.targets, self.blocks, strict=True)])
        total, seed, per = max(0, round(float(aims.sum()))), self.seed, self.shard_blocks
        count = -(-total // per)
        shares = aims / aims.sum() if total else aims

        def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for shard in batch.column(0).to_pylist():
                    n = shard_counts(shard, min(per, total - shard * per), shares, seed)
                    at = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), shard)), pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64))], names=["shard", "source_index", "n"])

        drawn = materialize(self.spark.range(count).mapInArrow(draw, "shard long, source_index int, n long"), "shards")
        earlier = Window.partitionBy("source_index").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
        placed = drawn.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        have = {r.source_index: int(r.n) for r in drawn.groupBy("source_index").agg(F.sum("n").alias("n")).collect()}
        # the last shard makes up what is missing, in rows of a shard's size at most
        lacking = [(count, i, k, min(per, low - k)) for i, low in enumerate(self.low) for k in range(have.get(i, 0), low, per)]
        schema = "source_index int, high long"
        most = broadcast_if_small(self.spark.createDataFrame(list(enumerate(self.high)), schema))
        kept = placed.join(most, "source_index").select("shard", "source_index", "before", F.least("n", F.col("high") - F.col("before")).alias("n")).where("n > 0")
        return kept.union(self.spark.createDataFrame(lacking, "shard long, source_index int, before long, n long"))

    def draws(self) -> DataFrame:
        """source_index, block, shard and draw (the source's slot) for every block of the mixture."""
        blocks, seed = self.blocks, self.seed
        slots = self.shards().select("source_index", "shard", F.explode(F.expr("sequence(before, before + n - 1)")).alias("draw"))

        def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                source, slot = batch.column("source_index").to_numpy(), batch.column("draw").to_numpy()
                block = np.empty(len(slot), np.int64)
                for i in np.unique(source):
                    at = np.flatnonzero(source == i)
                    epochs = slot[at] // blocks[i]
                    for epoch in np.unique(epochs):
                        own = at[epochs == epoch]
                        block[own] = permute(slot[own] % blocks[i], blocks[i], permutation_key(seed, int(i), int(epoch)))
                yield batch.append_column("block", pa.array(block))

        return slots.mapInArrow(number, "source_index int, shard long, draw long, block long")

    def mixed(self) -> DataFrame:
        """The mixture: shard, draw, source_index, block, row, doc_id, first, length."""
        return self.draws().join(self.pieces(), ["source_index", "block"])


def permutation_key(seed: int, source_index: int, epoch: int) -> int:
    return int(mix(np.array([seed * 1_000_003 + source_index * 4099 + epoch], np.uint64))[0])


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken (words in the mixture, repeats counted) of every row."""
    plan = Mixture(docs, **options)
    taken = plan.mixed().groupBy("row").agg(F.sum("length").alias("taken"))
    return plan.rows.join(taken, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
