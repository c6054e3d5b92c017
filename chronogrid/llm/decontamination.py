"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are compared lower-cased (in every alphabet) and without ASCII punctuation, as 64-bit hashes.  Of an item's n-grams the
rarest in the corpus in each run of `window` consecutive ones are its seeds, so every part of every item
has a seed however frequent the item is.  Seeds join passages to items inside one pass over the documents;
around each seed's diagonal a local alignment (match 1, mismatch and gap -1) scores the passage, divided by
the item's length: 1 is an exact copy.  Passages of at least `min_score` are reported.

The benchmark is read in blocks of at most `block_bytes` of text, each sent to all tasks for two passes (the
first counts n-grams over the whole corpus), so its size is bounded whatever the benchmark's; documents are
never shuffled, and nothing depends on how many documents share a passage.

Every passage is reported: what lies before and after a passage is searched again, so that an item that stands
twice in a row gives two.  Items of fewer than SHORT words count only where they stand whole, as half of four
words is no evidence.

Defined results: null texts and texts shorter than a seed match nothing; items with fewer than N words have no
seed and are not searched for; null item text is skipped; repeated items and repeated documents each get their
own rows; of equally good alignments the one that ends first is reported; a text of any length is searched
whole in one task; without documents or items there are no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches
from .text import normalised_slices, window_docs, window_hash

N, WINDOW, MIN_SCORE, SHORT, BLOCK_BYTES = 3, 5, 0.5, 8, 4 << 20
_SCHEMA = "doc_id long, item_id long, score double, first_word long, last_word long"


@dataclass
class Items:
    ids: list[int | None]
    words: list[np.ndarray]

    @classmethod
    def of(cls, rows: list[tuple[int | None, str]]) -> Items:
        ids, words = [], []
        for s in normalised_slices(_lower(pa.array([t for _, t in rows], pa.string()))):
            h = s.hashes()
            for k in range(s.lo, s.hi):
                own = h[s.first[k - s.lo] : s.first[k - s.lo + 1]]
                if len(own) >= N:
                    ids.append(rows[k][0])
                    words.append(own)
        return cls(ids, words)

    def grams(self) -> np.ndarray:
        return np.unique(np.concatenate([window_hash(w, N) for w in self.words])) if self.words else np.empty(0, np.uint64)

    def seeds(self, count: dict[int, int], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted seed hashes with their items and positions: every n-gram that the corpus holds, and the rarest of each run of `window`."""
        found = []
        for k, w in enumerate(self.words):
            h = window_hash(w, N)
            times = np.array([count.get(int(x), 0) for x in h])
            picked = {min(range(i, min(i + window, len(h))), key=lambda j: (times[j], j)) for i in range(max(1, len(h) - window + 1))}
            picked.update(np.flatnonzero(times > 0).tolist())  # a count of 0 never hits, so it must not displace these
            found += [(int(h[j]), k, j) for j in sorted(picked)]
        found.sort()
        return np.array([x[0] for x in found], np.uint64), np.array([x[1] for x in found], np.int64), np.array([x[2] for x in found], np.int64)


def smith_waterman(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """The best local alignment: its score, and the first and last place in the passage.

    A row of the matrix at a time; gaps along the passage come from a running maximum.
    """
    m = len(passage)
    along = np.arange(m + 1)
    score, origin = np.zeros(m + 1, np.int64), along.copy()
    best, best_from, best_to = 0, 0, -1
    for word in item:
        same = passage == word
        diagonal = score[:-1] + np.where(same, 1, -1)
        up = score[1:] - 1
        new, begun = np.zeros(m + 1, np.int64), along.copy()
        new[1:] = np.maximum(np.maximum(diagonal, up), 0)
        begun[1:] = np.where(new[1:] == 0, along[1:], np.where(new[1:] == diagonal, origin[:-1], origin[1:]))
        lifted = new + along
        top = np.maximum.accumulate(lifted)
        moved = top > lifted
        if moved.any():
            source = np.maximum.accumulate(np.where(moved, 0, along))
            new, begun = np.where(moved, top - along, new), np.where(moved, begun[source], begun)
        score, origin = new, begun
        at = int(score.argmax())
        if score[at] > best:
            best, best_from, best_to = int(score[at]), int(origin[at]), at - 1
    return best, best_from, best_to


def regions(diagonals: np.ndarray, length: int, slack: int, lo: int, hi: int) -> list[tuple[int, int, np.ndarray]]:
    """Merged stretches of words around the diagonals, within lo..hi, and the diagonals of each."""
    d = np.unique(diagonals)
    split = np.flatnonzero(np.diff(d) > 2 * slack) + 1
    return [(max(lo, int(g[0]) - slack), min(hi, int(g[-1]) + length + slack), g) for g in np.split(d, split)]


def passages(item: np.ndarray, vocabulary: np.ndarray, h: np.ndarray, x: int, y: int, diagonals: np.ndarray, least: float) -> list[tuple[float, int, int]]:
    """(score, first word, last word) of the passages of h[x:y] that align with the item, none inside another."""
    n, found, todo = len(item), [], [(x, y)]
    while todo:
        x, y = todo.pop()
        if y - x < least * n or np.isin(h[x:y], vocabulary).sum() < least * n:
            continue
        exact = next((int(g) for g in diagonals if x <= g and g + n <= y and np.array_equal(h[g : g + n], item)), None)
        if exact is not None:  # an equal passage has the full score
            score, first, last = 1.0, exact, exact + n - 1
        else:
            best, first, last = smith_waterman(item, h[x:y])
            score, first, last = best / n, first + x, last + x
        if score >= least:
            found.append((score, first, last))
            todo += [(x, first), (last + 1, y)]
    return sorted(found, key=lambda f: f[1])


def _lower(col: pa.Array) -> pa.Array:
    return pc.utf8_lower(col.cast(pa.string()))


Seeds = tuple[np.ndarray, np.ndarray, np.ndarray]


def _finder(items: Items, seeds: Seeds, min_score: float):
    """A function of a text array: (row, item, score, first word, last word) of the passages that align."""
    keys, seed_item, seed_at = seeds
    vocabulary = [np.unique(w) for w in items.words]

    def find(texts: pa.Array) -> Iterator[tuple[int, int, float, int, int]]:
        for s in normalised_slices(_lower(texts)):
            h = s.hashes()
            at, doc = window_docs(s.first, N)
            grams = window_hash(h, N)[at]
            lo, hi = np.searchsorted(keys, grams, "left"), np.searchsorted(keys, grams, "right")
            hit = np.flatnonzero(hi > lo)
            times = (hi - lo)[hit]
            which = np.repeat(lo[hit], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            hit = np.repeat(hit, times)
            pair = doc[hit] * len(items.words) + seed_item[which]
            diagonal = at[hit] - seed_at[which]
            order = np.argsort(pair, kind="stable")
            for group in np.split(order, np.flatnonzero(np.diff(pair[order])) + 1):
                if not len(group):
                    continue
                d, k = divmod(int(pair[group[0]]), len(items.words))
                item, begin, end = items.words[k], int(s.first[d]), int(s.first[d + 1])
                n = len(item)
                for x, y, own in regions(diagonal[group], n, max(6, n // 4), begin, end):
                    for score, first, last in passages(item, vocabulary[k], h, x, y, own, min_score if n >= SHORT else 1.0):
                        yield s.lo + d, k, score, first - begin, last - begin

    return find


def search(docs: DataFrame, items: Items, seeds: Seeds, min_score: float = MIN_SCORE) -> DataFrame:
    """Passages of documents that align with items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _finder(items, seeds, min_score)
        for batch in batches:
            ids = batch.column("doc_id")
            out = [(ids[row].as_py(), items.ids[k], *rest) for row, k, *rest in find(batch.column("text"))]
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            types = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "item_id", "score", "first_word", "last_word"])

    return docs.mapInArrow(run, _SCHEMA)


def corpus_counts(docs: DataFrame, grams: np.ndarray) -> dict[int, int]:
    """How often each n-gram occurs in the whole corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(grams), np.int64)
        for batch in batches:
            for s in normalised_slices(_lower(batch.column("text"))):
                found = window_hash(s.hashes(), N)[window_docs(s.first, N)[0]]
                at = np.minimum(np.searchsorted(grams, found), len(grams) - 1)
                total += np.bincount(at[grams[at] == found], minlength=len(grams))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["gram", "n"])

    rows = docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    return {int(grams[r.gram]): r.n for r in rows}


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int | None, str]]]:
    own: list[tuple[int | None, str]] = []
    size = 0
    for r in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null").toLocalIterator():
        own.append((r.item_id, r.text))
        size += len(r.text)
        if size >= block_bytes:
            yield own
            own, size = [], 0
    if own:
        yield own


def contaminated(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, score, first_word, last_word of each passage of `docs` that aligns with an item."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    parts = []
    for block in _blocks(benchmark, block_bytes):
        items = Items.of(block)
        if items.words:
            parts.append(search(docs, items, items.seeds(corpus_counts(docs, items.grams()), window), min_score))
    return reduce(DataFrame.union, parts) if parts else docs.sparkSession.createDataFrame([], _SCHEMA)


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of `docs`, all columns, without a passage of the benchmark: decided row by row, no shuffle."""
    bounded_batches(docs.sparkSession)
    counted = docs.select(F.col("text").cast("string"))
    for block in _blocks(benchmark, block_bytes):
        items = Items.of(block)
        if items.words:
            docs = docs.mapInArrow(_keeper(items, items.seeds(corpus_counts(counted, items.grams()), window), min_score), docs.schema)
    return docs


def _keeper(items: Items, seeds: Seeds, min_score: float):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _finder(items, seeds, min_score)
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            clean[[row for row, *_ in find(batch.column("text"))]] = False
            yield batch.filter(pa.array(clean))

    return keep
