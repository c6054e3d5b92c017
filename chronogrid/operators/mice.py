"""Chained-regression imputation with Bayesian ridge regressions."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..panel import Panel
from ..plans.lineage import cut_lineage

Estimator = Callable[[np.ndarray, np.ndarray, float, int], np.ndarray]


def evidence(xx: np.ndarray, xy: np.ndarray, yy: float, n: int, steps: int = 300, tol: float = 1e-3) -> tuple[np.ndarray, float, np.ndarray]:
    """Coefficients, noise variance and the coefficients' covariance, by evidence maximisation from centred sums of products."""
    values, vectors = np.linalg.eigh(xx)
    values = np.maximum(values, 0)
    eps = 1e-6
    alpha, lam = 1 / (yy / n + np.finfo(float).eps), 1.0
    old = np.zeros(len(xy))
    for k in range(steps):
        coef = vectors @ ((vectors.T @ xy) / (values + lam / alpha))
        gamma = float(np.sum(alpha * values / (lam + alpha * values)))
        error = max(0.0, float(yy - 2 * coef @ xy + coef @ xx @ coef))
        lam = (gamma + 2 * eps) / (float(coef @ coef) + 2 * eps)
        alpha = (n - gamma + 2 * eps) / (error + 2 * eps)
        if k and np.abs(old - coef).sum() < tol:
            break
        old = coef
    return vectors @ ((vectors.T @ xy) / (values + lam / alpha)), 1 / alpha, (vectors / (alpha * values + lam)) @ vectors.T


def bayesian_ridge(xx: np.ndarray, xy: np.ndarray, yy: float, n: int) -> np.ndarray:
    """Coefficients of a Bayesian ridge regression."""
    return evidence(xx, xy, yy, n)[0]


def normal(panel: Panel, *salt: int) -> Column:
    """A standard normal draw for each row, the same in every plan: from hashes of its key and the salt."""
    uniform = lambda k: (F.pmod(F.xxhash64(panel.time, panel.unit, *(F.lit(x) for x in (*salt, k))), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    return F.sqrt(-2 * F.log(uniform(1))) * F.cos(2 * math.pi * uniform(2))


def impute(panel: Panel, seed: int = 1, max_iter: int = 10, estimator: Estimator = bayesian_ridge, sample_posterior: bool = False) -> Panel:
    """Fill missing features by regressions on the others, in rounds, clipped to the observed range.

    Features start at their means and are visited by ascending number of missing values.  A regression needs
    one aggregate of sums of products over the rows where its target is observed; the driver solves a system
    of the number of features.  A feature without any value stays missing.

    With `sample_posterior` a value is drawn from the Bayesian ridge regression's predictive distribution, its
    noise and the uncertainty of its coefficients; draws follow from the row's key, `seed`, the round and the
    feature.  Without it the means are taken, nothing is random and `seed` changes nothing.
    """
    if sample_posterior and estimator is not bayesian_ridge:
        raise ValueError("draws need the posterior of bayesian_ridge")
    names = panel.features
    stats = panel.df.agg(F.count("*").alias("n"), *(x for i, f in enumerate(names) for x in (F.count(f).alias(f"c{i}"), F.avg(f).alias(f"a{i}"), F.min(f).alias(f"l{i}"), F.max(f).alias(f"h{i}")))).first()
    filled = [i for i in range(len(names)) if stats[f"c{i}"]]
    todo = sorted((i for i in filled if stats[f"c{i}"] < stats.n), key=lambda i: (stats.n - stats[f"c{i}"], i))
    df = panel.df.withColumns({f"_m{i}": F.col(names[i]).isNull() for i in todo} | {names[i]: F.coalesce(names[i], F.lit(stats[f"a{i}"])) for i in todo}) if todo else panel.df
    for turn in range(max_iter if todo and len(filled) > 1 else 0):
        for i in todo:
            others = [names[j] for j in filled if j != i]
            cols = [*others, names[i]]
            p = len(others)
            sums = df.where(~F.col(f"_m{i}")).agg(F.count("*").alias("n"), *(F.avg(c).alias(f"a{a}") for a, c in enumerate(cols)), *(F.covar_pop(cols[a], cols[b]).alias(f"s{a}_{b}") for a in range(p + 1) for b in range(a, p + 1))).first()
            s = np.array([[sums[f"s{min(a, b)}_{max(a, b)}"] for b in range(p + 1)] for a in range(p + 1)]) * sums.n
            coef = estimator(s[:p, :p], s[:p, p], float(s[p, p]), sums.n)
            base = sums[f"a{p}"] - sum(float(c) * sums[f"a{a}"] for a, c in enumerate(coef))
            guess = reduce(lambda x, y: x + y, [F.lit(float(c)) * F.col(o) for c, o in zip(coef, others, strict=True)], F.lit(float(base)))
            if sample_posterior:
                _, noise, spread = evidence(s[:p, :p], s[:p, p], float(s[p, p]), sums.n)
                off = [F.col(o) - float(sums[f"a{a}"]) for a, o in enumerate(others)]
                variance = reduce(lambda x, y: x + y, [off[a] * off[b] * float(spread[a, b]) for a in range(p) for b in range(p)], F.lit(float(noise)))
                drawn = guess + F.sqrt(F.greatest(variance, F.lit(0.0))) * normal(panel, seed, turn, i)
                guess = F.least(F.greatest(drawn, F.lit(stats[f"l{i}"])), F.lit(stats[f"h{i}"]))
            df = df.withColumn(names[i], F.when(F.col(f"_m{i}"), guess).otherwise(F.col(names[i])))
        df = cut_lineage(df)
    clip = {names[i]: F.least(F.greatest(names[i], F.lit(stats[f"l{i}"])), F.lit(stats[f"h{i}"])) for i in todo}
    return panel.with_df((df.withColumns(clip) if clip else df).drop(*(f"_m{i}" for i in todo)))


def impute_many(panel: Panel, n_imp: int, estimator: Estimator = bayesian_ridge, max_iter: int = 10, sample_posterior: bool = False) -> Iterator[Panel]:
    """n_imp imputations, the number of each its seed. They are equal as long as nothing is drawn."""
    for k in range(n_imp):
        yield impute(panel, k, max_iter, estimator, sample_posterior)


def impute_stacked(panel: Panel, n_imp: int, estimator: Estimator = bayesian_ridge, max_iter: int = 10, sample_posterior: bool = False) -> DataFrame:
    """All imputations in one DataFrame, numbered by `imp`."""
    return reduce(DataFrame.unionByName, [p.df.withColumn("imp", F.lit(k)) for k, p in enumerate(impute_many(panel, n_imp, estimator, max_iter, sample_posterior))])
