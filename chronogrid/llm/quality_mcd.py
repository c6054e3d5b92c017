"""Quality rules with minimum-covariance-determinant outlier rejection per language and source.

The base statistics come from one pass over the texts (numpy on Arrow buffers).  Statistic vectors are
transformed by logarithms and each (language, source) gets a robust centre and covariance by concentration
steps on ALL its documents: a step joins the current estimate to the vectors, counts and sums them by
distance bin (partially aggregated before the shuffle), and takes the bins that hold the nearest `coverage`
share; a hot source is one row per bin by the time it meets in a task.  Two deterministic starts are followed
(median with quartile range, and mean with variance); that with the smaller determinant wins.  A ridge on the
diagonal keeps the determinant positive where a statistic is constant.

Squared distances are divided by their group's median over that of the chi-squared distribution where that is
above 1.  The cutoff is the 0.999 quantile for a heavy-tailed t distribution, as statistics of clean texts have
heavier tails than normal ones: the normal quantile, 22.5, would reject 33 of 3,302 documents labelled good on
the sf0.1 tables, 120 rejects none, and either keeps 7 of 301 labelled bad.  `ridge` is the least spread that
counts: statistics are logarithms of rates, so 0.15 is a factor of about 1.16.  A covariance of 6 statistics
needs some tens of rows: groups of fewer than `min_group` usable documents are pooled by language, then
together; below that nothing is rejected.

Defined results: null and wordless texts have zeros everywhere and fail the base rules; null lang and null
source are values of their own; repeated rows are judged alike; a distance equal to the cutoff is kept, and of
equal determinants the median start wins; a text of any length is measured whole in one task; an empty table
gives no rows; extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialize
from .text import _BASE, _BYTE, _INVERSE, Slice, mix, occurrence_labels, powers, slices, window_docs, window_hash

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_punct")
DIMENSIONS = 6
#: Median of the chi-squared distribution with DIMENSIONS degrees of freedom.
CHI2_MEDIAN = 5.348
#: 0.999 quantile of squared distances of a t distribution with as many degrees of freedom: DIMENSIONS * 20.03, of F(6, 6).
HEAVY_FAR = 120.2
COVERAGE, STEPS, MIN_GROUP, CUTOFF, RIDGE = 0.75, 5, 50, HEAVY_FAR, 0.15
_BINS_PER_OCTAVE = 8


def _lut(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL, _UPPER = _lut(SYMBOLS), _lut(bytes(range(65, 91)))
_PUNCT = _lut(bytes(x for x in range(33, 127) if not chr(x).isalnum()))


def _per_doc(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def repeated_lines(s: Slice) -> np.ndarray:
    """Per document, lines with a word that equal an earlier line."""
    n = len(s.data)
    docs = s.hi - s.lo
    if not n:
        return np.zeros(docs, np.int64)
    newline = np.flatnonzero(s.data == 10)
    # a line starts a text that is not empty, or follows a line end that is not the text's last byte
    inner = newline[newline + 1 < s.offsets[1:][np.searchsorted(s.offsets[1:], newline, "right")]]
    start = np.sort(np.concatenate([s.offsets[:-1][np.diff(s.offsets) > 0], inner + 1]))
    doc = np.searchsorted(s.offsets[1:], start, "right")
    end = np.minimum(np.append(newline, n)[np.searchsorted(newline, start)], s.offsets[1:][doc])
    worded = np.searchsorted(s.starts, end) > np.searchsorted(s.starts, start)
    start, end, doc = start[worded], end[worded], doc[worded]
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[s.data] * powers(_BASE, n), out=total[1:])
    h = mix((total[end] - total[start]) * powers(_INVERSE, n)[start] + (end - start).astype(np.uint64))
    return np.bincount(doc[occurrence_labels(doc, h) > 0], minlength=docs)


def repeated_words(s: Slice, window: int = WINDOW) -> np.ndarray:
    """Per document, words covered by a window of words that occurs twice or more in it."""
    h = window_hash(s.hashes(), window)
    at, doc = window_docs(s.first, window)
    docs = s.hi - s.lo
    if not len(at):
        return np.zeros(docs, np.int64)
    h = h[at]
    key = h ^ mix(doc.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key)
    same = (key[order][1:] == key[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(s.starts) + 1, np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + window, -1)
    return _per_doc(np.cumsum(edge[:-1]) > 0, s.first)


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts: list[list[np.ndarray]] = []
        for s in slices(batch.column("text")):
            code_points = (s.data & 0xC0) != 0x80
            spaces = np.ones(len(s.data), np.int64)
            if len(s.starts):
                edge = np.zeros(len(s.data) + 1, np.int64)
                edge[s.starts] += 1
                np.add.at(edge, s.ends, -1)
                spaces = np.cumsum(edge[:-1]) == 0
            inside = code_points & ~spaces.astype(bool)
            parts.append([s.counts, _per_doc(inside, s.offsets), _per_doc(_SYMBOL[s.data], s.offsets), repeated_lines(s), repeated_words(s), _per_doc(_UPPER[s.data], s.offsets), _per_doc(_PUNCT[s.data], s.offsets)])
        found = [pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*parts, strict=True)] if parts else [pa.array([], pa.int64())] * len(STATS)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), batch.column("source"), *found], names=["doc_id", "lang", "source", *STATS])


def base_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the base statistics of every whole text."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("text").cast("string"))
    return docs.mapInArrow(_statistics, "doc_id long, lang string, source string, " + ", ".join(f"{x} long" for x in STATS))


def _vector() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    rate = lambda name, by: F.log1p(by * F.col(name) / n)
    return [F.log1p(F.col("word_chars") / n), rate("n_symbols", 20), rate("n_dup_lines", 50), rate("n_repeat_words", 10), rate("n_upper", 5), rate("n_punct", 5)]


def _estimate(mean: np.ndarray, cov: np.ndarray, ridge: float) -> tuple[list[float], list[float], float]:
    cov = (cov + cov.T) / 2 + np.eye(len(mean)) * ridge**2
    inverse = np.linalg.inv(cov)
    return mean.tolist(), inverse.ravel().tolist(), float(np.linalg.slogdet(cov)[1])


def _first(ridge: float):
    def fit(key, rows: pd.DataFrame) -> pd.DataFrame:
        r = rows.iloc[0]
        quart = np.array([r[f"q{i}"] for i in range(DIMENSIONS)], float)
        starts = [(quart[:, 1], np.diag(((quart[:, 2] - quart[:, 0]) / 1.349) ** 2)), (np.array([r[f"m{i}"] for i in range(DIMENSIONS)], float), np.diag([r[f"v{i}"] for i in range(DIMENSIONS)]))]
        return pd.DataFrame([(*key, int(k), float(r.n), *_estimate(*x, ridge), 1.0) for k, x in enumerate(starts)], columns=["key", "start", "n", "mu", "inv", "logdet", "scale"])

    return fit


def _concentrate(ridge: float, coverage: float, last: bool):
    """One concentration step of a group from its distance bins; at the last, the better start."""
    upper = [(i, j) for i in range(DIMENSIONS) for j in range(i, DIMENSIONS)]

    def fit(key, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for start, bins in rows.sort_values("bin").groupby("start"):
            reached = bins.n.cumsum().to_numpy()
            total = reached[-1]
            inner = bins.iloc[: int(np.searchsorted(reached, coverage * total)) + 1]
            n = inner.n.sum()
            mean = np.array([inner[f"s{i}"].sum() for i in range(DIMENSIONS)]) / n
            cov = np.zeros((DIMENSIONS, DIMENSIONS))
            for i, j in upper:
                cov[i, j] = cov[j, i] = inner[f"p{i}_{j}"].sum() / n - mean[i] * mean[j]
            middle = bins.bin.iloc[int(np.searchsorted(reached, total / 2))]
            out.append((*key, int(start), float(total), *_estimate(mean, cov, ridge), max(1.0, 2.0 ** ((middle + 0.5) / _BINS_PER_OCTAVE) / CHI2_MEDIAN)))
        found = pd.DataFrame(out, columns=["key", "start", "n", "mu", "inv", "logdet", "scale"])
        return found.sort_values(["logdet", "start"]).head(1) if last else found

    return fit


_PARAMS = "key string, start int, n double, mu array<double>, inv array<double>, logdet double, scale double"


def _distance() -> Column:
    total = F.lit(0.0)
    for i in range(DIMENSIONS):
        for j in range(i, DIMENSIONS):
            total = total + (1 if i == j else 2) * F.col("inv")[i * DIMENSIONS + j] * (F.col(f"x{i}") - F.col("mu")[i]) * (F.col(f"x{j}") - F.col("mu")[j])
    return total


def quality_outliers(
    docs: DataFrame,
    coverage: float = COVERAGE,
    steps: int = STEPS,
    min_group: int = MIN_GROUP,
    cutoff: float = CUTOFF,
    ridge: float = RIDGE,
) -> DataFrame:
    """doc_id, the base statistics, base_failed, distance (squared, null without an estimate) and kept."""
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    stats = materialize(base_statistics(docs).withColumn("base_failed", failed).withColumns({f"x{i}": x for i, x in enumerate(_vector())}), "stats")
    tag = lambda name: F.coalesce(F.concat(F.lit("="), F.col(name)), F.lit("-"))
    stats = stats.withColumns({"lang_tag": tag("lang"), "source_tag": tag("source")})
    sizes = materialize(stats.groupBy("lang_tag", "source_tag").agg(F.sum((~F.col("base_failed")).cast("long")).alias("n")), "groups")
    small = sizes.where(F.col("n") < min_group)
    by_lang = small.groupBy("lang_tag").agg(F.sum("n").alias("lang_n"))
    own = F.concat_ws("\x01", F.lit("0"), "lang_tag", "source_tag")
    keys = sizes.join(by_lang, "lang_tag", "left").select("lang_tag", "source_tag", F.when(F.col("n") >= min_group, own).when(F.col("lang_n") >= min_group, F.concat_ws("\x01", F.lit("1"), "lang_tag")).otherwise("2").alias("key"))
    stats = stats.join(keys, ["lang_tag", "source_tag"]).drop("lang_tag", "source_tag")
    usable = stats.where(~F.col("base_failed"))
    xs = [F.col(f"x{i}") for i in range(DIMENSIONS)]
    begin = usable.groupBy("key").agg(
        F.count("*").alias("n"),
        *(F.percentile_approx(x, [0.25, 0.5, 0.75], 200).alias(f"q{i}") for i, x in enumerate(xs)),
        *(F.avg(x).alias(f"m{i}") for i, x in enumerate(xs)),
        *(F.var_pop(x).alias(f"v{i}") for i, x in enumerate(xs)),
    )
    params = materialize(begin.where(F.col("n") >= min_group).groupBy("key").applyInPandas(_first(ridge), _PARAMS), "mcd")
    bin_ = F.floor(_BINS_PER_OCTAVE * F.log2(F.greatest(_distance(), F.lit(1e-6)))).cast("int")
    for step in range(steps):
        placed = usable.join(params.select("key", "start", "mu", "inv"), "key").select("key", "start", bin_.alias("bin"), *xs)
        binned = placed.groupBy("key", "start", "bin").agg(
            F.count("*").alias("n"),
            *(F.sum(x).alias(f"s{i}") for i, x in enumerate(xs)),
            *(F.sum(xs[i] * xs[j]).alias(f"p{i}_{j}") for i in range(DIMENSIONS) for j in range(i, DIMENSIONS)),
        )
        params = materialize(binned.groupBy("key").applyInPandas(_concentrate(ridge, coverage, step == steps - 1), _PARAMS), "mcd")
    judged = stats.join(params.select("key", "mu", "inv", "scale"), "key", "left")
    distance = _distance() / F.col("scale")
    return judged.select("doc_id", *STATS, "base_failed", distance.alias("distance"), (~F.col("base_failed") & F.coalesce(distance <= cutoff, F.lit(True))).alias("kept"))
