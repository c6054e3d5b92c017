"""Toxicity from class-conditional Kneser-Ney bigram models over shared backoff counts.

For a class c, a word w and the word v before it,

    P_c(w | v) = (max(n_c(v, w) - D, 0) + taken_c(v) * P_c(w)) / n_c(v)
    P_c(w)     = (max(p_c(w) - D, 0) + taken_c * P(w)) / b_c
    P(w)       = (p(w) + 1/2) / (sum of p + half the number of words)

n_c counts the class's labelled texts, p_c(w) its different words before w, b_c its different pairs, and taken
is what the discount D takes from the counts that follow v, or from all p_c.  p(w), shared by both classes, is
the Kneser-Ney continuation count over ALL documents: how many different words precede w.  A word or history
too rare in a class thus falls back to the same counts for both.  D is above the usual 0.75, so that an
expression needs more than D sightings in a class before it speaks: at 0.75 the words seen once drown the rest
(on the sf0.1 tables 27 of 120 held-out toxic documents were found with 56 false ones, at 3 it is 113 and 3).
Words (A-Z lower-cased, without ASCII punctuation) are known by 64-bit hashes; the vocabulary is that of the
labelled sample, and every other word is one word of its own.

Labels are learned from a sample bounded by `class_chars` characters a class (rows with the smallest hashes of
their ids), so the class counts, a few arrays, have a proven size; the shared counts come from the distinct
word pairs of all texts, deduplicated in tasks and again by the shuffle.  A document's log-likelihood ratio
by P_c(w) divided by its number of words and by the root of it, the sum of its STRONGEST words' ratios, the
ratio by P_c(w | v) divided by its number of words, and the sum of what the strongest pairs add to their words'
ratios go into a logistic curve (with the logarithm of the number of words, as a long text has strong words by
chance), fitted on at most `calibration_rows` of the sample, each scored without its own counts.

Defined results: null and wordless texts have ratio 0 and get the score of that; null toxic labels are
ignored; of several labels for a document the largest holds; without both classes every score is 0; repeated
rows get equal scores and count as often as they occur; equal scores are equal verdicts, and one equal to the
threshold is toxic; a text of any length is scored whole in one task, a slice at a time; an empty table gives
no rows; extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, broadcast_if_small, held_out, materialize
from .text import Slice, normalised_slices

DISCOUNT, CLASS_CHARS, CALIBRATION_ROWS, THRESHOLD, STRONGEST = 3.0, 4_000_000, 20_000, 0.3, 3
#: Word numbers: any word outside the vocabulary, the place before a text, and the first word of the vocabulary.
OTHER, START, FIRST = 0, 1, 2
_ID_BITS, _CLIP, _FEATURES, _PENDING = 24, 6.0, 6, 2_000_000
_LOW = np.int64((1 << _ID_BITS) - 1)


def before(s: Slice, values: np.ndarray, start: int) -> np.ndarray:
    """The value of the word before each word; `start` at the beginning of a document."""
    out = np.full(len(values), start, values.dtype)
    out[1:] = values[:-1]
    out[s.first[:-1][s.counts > 0]] = start
    return out


def encode(vocabulary: np.ndarray, s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Each word's number and that of the word before it."""
    h = s.hashes()
    if len(vocabulary):
        at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
        word = np.where(vocabulary[at] == h, at + FIRST, OTHER)
    else:
        word = np.full(len(h), OTHER)
    return word.astype(np.int64), before(s, word.astype(np.int64), START)


class Class:
    """Counts of one class: n of the model's pairs; the other arrays are by word number."""

    def __init__(self, n: np.ndarray, word: np.ndarray, earlier: np.ndarray, size: int, discount: float) -> None:
        by = lambda at, x: np.bincount(at, x, size).astype(np.float32)
        self.n, self.history, self.preceding = n.astype(np.int32), by(earlier, n), by(word, n > 0)
        self.taken = by(earlier, np.minimum(n, discount))
        self.pairs = float(self.preceding.sum(dtype=float))
        self.word_taken = float(np.minimum(self.preceding, discount).sum(dtype=float))


@dataclass
class Model:
    """Vocabulary hashes, the sorted pairs of the sample (word << 24 | word before), classes and shared counts."""

    vocabulary: np.ndarray
    keys: np.ndarray
    classes: tuple[Class, Class]
    shared: np.ndarray
    discount: float = DISCOUNT

    @classmethod
    def of(cls, word: np.ndarray, earlier: np.ndarray, ordinary: np.ndarray, toxic: np.ndarray, discount: float = DISCOUNT) -> Model:
        """From distinct (hash, hash before or 0, counts of both classes); the shared counts are still 1."""
        vocabulary = np.unique(np.concatenate([word, earlier[earlier != 0]]))
        if len(vocabulary) + FIRST > _LOW:
            raise ValueError("class_chars allows more words than numbers")
        number = lambda h: np.where(h == 0, START, np.searchsorted(vocabulary, h) + FIRST).astype(np.int64)
        w, v = number(word), number(earlier)
        key = w << _ID_BITS | v
        order = np.argsort(key)
        size = len(vocabulary) + FIRST
        classes = tuple(Class(n[order], w[order], v[order], size, discount) for n in (ordinary, toxic))
        return cls(vocabulary, key[order], classes, np.ones(size), discount)

    def places(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
        return at, (self.keys[at] == key) if len(self.keys) else np.zeros(len(key), bool)

    def log_probabilities(self, word: np.ndarray, earlier: np.ndarray, own: Own | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """log P_c(w) and log P_c(w | v) of both classes; own: the counts of the words' own documents, left out."""
        at, known = self.places(word << _ID_BITS | earlier)
        base = (self.shared[word] + 0.5) / (self.shared.sum() + len(self.shared) / 2)
        out = []
        for c, k in enumerate(self.classes):
            n = np.where(known, k.n[at] if len(k.n) else 0.0, 0.0)
            history, taken, preceding = (x.astype(float) for x in (k.history[earlier], k.taken[earlier], k.preceding[word]))
            pairs, word_taken = np.full(len(word), k.pairs), np.full(len(word), k.word_taken)
            if own is not None:
                n, history, taken, preceding, pairs, word_taken = (x - y * (own.label == c) for x, y in zip((n, history, taken, preceding, pairs, word_taken), own.counts, strict=True))
            with np.errstate(divide="ignore", invalid="ignore"):
                p = np.where(pairs > 0, (np.maximum(preceding - self.discount, 0) + word_taken * base) / pairs, base)
                q = np.where(history > 0, (np.maximum(n - self.discount, 0) + taken * p) / history, p)
            out.append((np.log(np.maximum(p, 1e-300)), np.log(np.maximum(q, 1e-300))))
        return out

    def ratios(self, word: np.ndarray, earlier: np.ndarray, own: Own | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Toxic minus ordinary log-probability of each word, alone and after its predecessor."""
        ordinary, toxic = self.log_probabilities(word, earlier, own)
        return toxic[0] - ordinary[0], toxic[1] - ordinary[1]


class Own:
    """What the labelled documents of a slice have added to their own class's counts, word by word."""

    def __init__(self, model: Model, s: Slice, word: np.ndarray, earlier: np.ndarray, label: np.ndarray) -> None:
        doc = s.doc_of_word().astype(np.int64)
        self.label = label[doc]
        order = np.lexsort((earlier, word, doc))
        columns = [x[order] for x in (doc, word, earlier)]
        fresh = np.r_[True, np.logical_or.reduce([x[1:] != x[:-1] for x in columns])] if len(order) else np.empty(0, bool)
        pair = np.empty(len(order), np.int64)
        pair[order] = np.cumsum(fresh) - 1
        d, w, v = (x[fresh] for x in columns)
        times = np.bincount(pair, minlength=len(d)).astype(float)
        at, known = model.places(w << _ID_BITS | v)
        own = label[d]
        pick = lambda f: np.where(own == 1, f(model.classes[1]), f(model.classes[0]))
        whole = np.where(known, pick(lambda k: k.n[at]), 0) if len(model.keys) else np.zeros(len(d))
        rest = np.maximum(whole - times, 0)
        gone = ((whole > 0) & (rest == 0)).astype(float)

        def over(by: np.ndarray, x: np.ndarray) -> np.ndarray:
            """Sums of x over the pairs of a document with an equal `by`."""
            _, inverse = np.unique(d << _ID_BITS | by, return_inverse=True)
            return np.bincount(inverse, x)[inverse] if len(x) else x

        less = lambda x, y: np.minimum(x, model.discount) - np.minimum(y, model.discount)
        zero = np.zeros(len(d), np.int64)
        fewer, had = over(w, gone), pick(lambda k: k.preceding[w]).astype(float)
        # a word counts once a document, whatever its number of pairs there
        once = np.r_[True, (d[1:] != d[:-1]) | (w[1:] != w[:-1])].astype(float) if len(d) else gone
        self.counts = [x[pair] for x in (times, over(v, times), over(v, less(whole, rest)), fewer, over(zero, gone), over(zero, once * less(had, had - fewer)))]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        label = batch.column("toxic").to_numpy(zero_copy_only=False)
        for s in normalised_slices(batch.column("text")):
            h = s.hashes()
            v = before(s, h, 0)
            toxic = label[s.lo : s.hi][s.doc_of_word()] == 1
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(v.view(np.int64)), pa.array((~toxic).astype(np.int64)), pa.array(toxic.astype(np.int64))], names=["w", "v", "ordinary", "toxic"])


def class_counts(sample: DataFrame, discount: float = DISCOUNT) -> Model:
    """A model, without its shared counts, of the rows given (text, toxic)."""
    rows = sample.select("text", F.col("toxic").cast("int")).mapInArrow(_pairs, "w long, v long, ordinary long, toxic long")
    found = rows.groupBy("w", "v").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic")).toArrow()
    w, v, ordinary, toxic = (found.column(c).to_numpy() for c in ("w", "v", "ordinary", "toxic"))
    return Model.of(w.view(np.uint64), v.view(np.uint64), ordinary, toxic, discount)


def shared_counts(docs: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """For each word number, how many different words precede it in all of `docs` (text)."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, pending = [], 0
        for batch in batches:
            for s in normalised_slices(batch.column("text")):
                word, earlier = encode(sent.value, s)
                kept.append(np.unique(word << _ID_BITS | earlier))
                pending += len(kept[-1])
                if pending > _PENDING:
                    kept = [np.unique(np.concatenate(kept))]
                    pending = len(kept[0])
                    if pending > _PENDING // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(kept[0])], names=["pair"])
                        kept, pending = [], 0
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(kept)))], names=["pair"])

    pairs = docs.select(F.col("text").cast("string")).mapInArrow(distinct, "pair long").distinct()
    found = pairs.groupBy(F.shiftright("pair", _ID_BITS).alias("w")).agg(F.count("*").alias("n")).toArrow()
    out = np.zeros(len(vocabulary) + FIRST)
    out[found.column("w").to_numpy()] = found.column("n").to_numpy()
    return out


def _features(s: Slice, ratios: tuple[np.ndarray, np.ndarray], strongest: int = STRONGEST) -> np.ndarray:
    alone, after = ratios
    n, doc = np.maximum(s.counts, 1), s.doc_of_word()

    def total(x: np.ndarray) -> np.ndarray:
        return np.bincount(doc, x, len(n))

    def top(x: np.ndarray) -> np.ndarray:
        order = np.lexsort((-x, doc))
        at = order[np.arange(len(x)) - s.first[:-1][doc] < strongest]
        return np.bincount(doc[at], np.clip(x[at], 0, _CLIP), len(n))

    return np.stack([total(alone) / n, total(alone) / np.sqrt(n), top(alone), np.log(n), total(after) / n, top(after - alone)], 1)


def own_left_out(sample: DataFrame, sent: Broadcast) -> DataFrame:
    """toxic and the features of rows of the sample, each scored by the model without its own counts."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
            parts = [np.empty((0, _FEATURES))]
            for s in normalised_slices(batch.column("text")):
                word, earlier = encode(sent.value.vocabulary, s)
                parts.append(_features(s, sent.value.ratios(word, earlier, Own(sent.value, s, word, earlier, toxic[s.lo : s.hi]))))
            x = np.concatenate(parts)
            yield pa.RecordBatch.from_arrays([pa.array(toxic.astype(np.int32)), *(pa.array(x[:, k]) for k in range(_FEATURES))], names=["toxic", *(f"f{k}" for k in range(_FEATURES))])

    return sample.select("text", F.col("toxic").cast("int")).mapInArrow(score, "toxic int, " + ", ".join(f"f{k} double" for k in range(_FEATURES)))


def _design(x: np.ndarray) -> np.ndarray:
    strong, size = x[:, 2] / 5, x[:, 3] / 5
    return np.column_stack([np.ones(len(x)), 10 * x[:, 0], x[:, 1], strong, size, strong * size, strong**2, 10 * x[:, 4], x[:, 5] / 5])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 30) -> np.ndarray:
    a = _design(x)
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w += np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge * np.eye(len(w)), a.T @ (y - p) - ridge * w)
    return w


def score_texts(docs: DataFrame, sent: Broadcast, weights: np.ndarray | None) -> DataFrame:
    """doc_id and score of every row by the model and the curve's weights; no shuffle."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.empty(0)]
            for s in normalised_slices(batch.column("text")):
                x = _features(s, sent.value.ratios(*encode(sent.value.vocabulary, s)))
                parts.append(np.zeros(len(x)) if weights is None else 1 / (1 + np.exp(-np.clip(_design(x) @ weights, -30, 30))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(parts))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(score, "doc_id long, score double")


def _sample(texts: DataFrame, labels: DataFrame, class_chars: int) -> DataFrame:
    """doc_id, toxic of the labelled rows to learn from: about `class_chars` characters of each class at most."""
    marked = labels.where("toxic is not null and doc_id is not null").where(~held_out("doc_id")).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    marked = materialize(marked, "labels")
    sizes = texts.select("doc_id", F.length("text").alias("size")).join(broadcast_if_small(marked), "doc_id").groupBy("toxic").agg(F.sum("size").alias("size")).collect()
    share = F.lit(1.0)
    for r in sizes:
        share = F.when(F.col("toxic") == r.toxic, F.lit(min(1.0, class_chars / max(1, r["size"] or 0)))).otherwise(share)
    return materialize(marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30)), "sample")


def toxicity(docs: DataFrame, labels: DataFrame, discount: float = DISCOUNT, class_chars: int = CLASS_CHARS, calibration_rows: int = CALIBRATION_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every row; labels of held-out rows are never read."""
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sampled = _sample(texts, labels, class_chars)
    rows = materialize(texts.join(broadcast_if_small(sampled), "doc_id"), "sample-texts")
    model = class_counts(rows, discount)
    model.shared = shared_counts(texts, model.vocabulary)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    # the calibration rows: at most so many, with the smallest hashes of their ids
    ids = materialize(sampled.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(calibration_rows), "calibration")
    found = own_left_out(rows.join(broadcast_if_small(ids), "doc_id"), sent).toArrow().to_pandas()
    both = found.toxic.nunique() == 2
    weights = fit_logistic(found[[f"f{k}" for k in range(_FEATURES)]].to_numpy(), found.toxic.to_numpy(float)) if both else None
    out = score_texts(docs, sent, weights)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
