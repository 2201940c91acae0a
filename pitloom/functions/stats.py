"""Statistics of return series as aggregate expressions, and distribution functions without further libraries."""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def sharpe(r: Column, year: int, rate: float = 0.0, population: bool = False) -> Column:
    """Mean over deviation of the excess return, annualised; NULL where there are fewer than two or no deviation."""
    sd = F.stddev_pop(r) if population else F.stddev_samp(r)
    excess = (1.0 + rate) ** (1.0 / year) - 1.0
    return F.try_divide(F.avg(r) - excess, F.nullif(sd, F.lit(0.0))) * math.sqrt(year)


def total_return(r: Column) -> Column:
    return F.product(1 + r) - 1


def annualised(r: Column, year: int) -> Column:
    return F.pow(F.product(1 + r), F.lit(float(year)) / F.count(r)) - 1


def win_rate(r: Column) -> Column:
    return F.try_divide(F.count_if(r > 0), F.count_if(r != 0))


def profit_factor(r: Column) -> Column:
    """Gains over losses; infinite without losses, NULL without either."""
    gain, loss = F.sum(F.greatest(r, F.lit(0.0))), -F.sum(F.least(r, F.lit(0.0)))
    return F.when(loss > 0, gain / loss).when(gain > 0, F.lit(float("inf")))


def central_moment(x: Column, mean: Column, k: int) -> Column:
    return F.avg(F.pow(x - mean, F.lit(float(k))))


def sharpe_variance(sr: Column, skew: Column, kurt: Column, n: Column) -> Column:
    """Variance of an estimated Sharpe ratio under skewed, fat-tailed returns (kurt not in excess of 3)."""
    return F.try_divide(1 - skew * sr + (kurt - 1) / 4 * sr * sr, n - 1)


def expected_maximum(trials: int, variance: float) -> float:
    """Expected greatest of `trials` Sharpe ratios whose true value is 0."""
    if trials < 2 or variance <= 0:
        return 0.0
    euler, z = 0.5772156649015329, NormalDist().inv_cdf
    return math.sqrt(variance) * ((1 - euler) * z(1 - 1 / trials) + euler * z(1 - 1 / (trials * math.e)))


#: Coefficients of a published rational approximation (Hart 1968, algorithm 5666), highest power first.
_NORMAL_UP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_NORMAL_DOWN = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def normal_cdf(x: Column) -> Column:
    """Distribution function of the standard normal, as an expression; right to 14 digits or so."""
    z = F.abs(x)
    horner = lambda terms: reduce(lambda a, c: a * z + c, terms[1:], F.lit(terms[0]))
    tail = F.exp(-z * z / 2)
    fraction = reduce(lambda a, k: z + F.lit(float(k)) / a, (4, 3, 2, 1), z + 0.65)
    upper = F.when(z > 37, 0.0).when(z < 7.07106781186547, tail * horner(_NORMAL_UP) / horner(_NORMAL_DOWN)).otherwise(tail / fraction / math.sqrt(2 * math.pi))
    return F.when(F.isnan(x), F.lit(None)).when(x > 0, 1 - upper).otherwise(upper)


def normal_cdf_sql(x: str) -> str:
    """The same as SQL for a column name."""
    horner = lambda terms: reduce(lambda a, c: f"({a} * abs({x}) + {c})", map(repr, terms[1:]), repr(terms[0]))
    fraction = reduce(lambda a, k: f"(abs({x}) + {k}.0 / {a})", (4, 3, 2, 1), f"(abs({x}) + 0.65)")
    upper = f"CASE WHEN abs({x}) > 37 THEN 0.0 WHEN abs({x}) < 7.07106781186547 THEN exp(-{x} * {x} / 2) * {horner(_NORMAL_UP)} / {horner(_NORMAL_DOWN)} ELSE exp(-{x} * {x} / 2) / {fraction} / sqrt(2 * pi()) END"
    return f"CASE WHEN {x} > 0 THEN 1 - ({upper}) ELSE {upper} END"


def shortest_length(sr: Column, skew: Column, kurt: Column, confidence: float = 0.95) -> Column:
    """Rows from which a Sharpe ratio (of one row's period) is significantly above 0; infinite where it is not positive."""
    z = NormalDist().inv_cdf(confidence)
    spread = 1 - skew * sr + (kurt - 1) / 4 * sr * sr
    return F.when(sr > 0, 1 + spread * F.pow(F.lit(z) / sr, F.lit(2.0))).otherwise(F.lit(float("inf")))


def two_weights(mean_a: Column, mean_b: Column, var_a: Column, var_b: Column, cov: Column) -> tuple[Column, Column]:
    """First of two assets' weights in the tangency (no interest) and the least-variance portfolio, held within 0 to 1; 0.5 if undefined."""
    def share(a: Column, b: Column) -> Column:
        total = F.when(F.abs(a + b) > 1e-12, a + b)
        x = F.try_divide(a, total)  # greatest and least would skip a NULL
        return F.when(x.isNull(), 0.5).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)))
    det = F.nullif(var_a * var_b - cov * cov, F.lit(0.0))
    first = share((var_b * mean_a - cov * mean_b) / det, (var_a * mean_b - cov * mean_a) / det)
    return first, share((var_b - cov) / det, (var_a - cov) / det)


def split_groups(n: int, groups: int) -> list[tuple[int, int]]:
    """Contiguous groups of n rows; the last takes what is left over."""
    size = n // groups
    return [(i * size, n if i == groups - 1 else (i + 1) * size) for i in range(groups)]


def purged_splits(spark: SparkSession, n: int, groups: int, tests: int, embargo: int, min_train: int = 0) -> DataFrame:
    """Combinatorial purged cross-validation: split, row, role (train, test or embargo) for rows 0 to n - 1. Splits with fewer
    than min_train rows to train on are left out; the others keep their numbers."""
    bounds = split_groups(n, groups)
    combos = [(i, a, b) for i, combo in enumerate(combinations(range(groups), tests)) for a, b in (bounds[g] for g in combo)]
    held = spark.createDataFrame(combos, "split int, lo int, hi int")
    splits = held.select("split").distinct()
    near = held.select("split", F.explode(F.sequence(F.greatest(F.lit(0), F.col("lo") - embargo), F.least(F.lit(n - 1), F.col("hi") - 1 + embargo))).alias("row"), "lo", "hi")
    role = near.groupBy("split", "row").agg(F.max((F.col("row") >= F.col("lo")) & (F.col("row") < F.col("hi"))).alias("_test"))
    every = splits.select("split", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("row"))
    rows = every.join(role, ["split", "row"], "left").select("split", "row", F.when(F.col("_test"), "test").when(F.col("_test").isNotNull(), "embargo").otherwise("train").alias("role"))
    if not min_train:
        return rows
    enough = role.groupBy("split").agg((n - F.count(F.lit(1))).alias("_train")).filter(F.col("_train") >= min_train)
    return rows.join(F.broadcast(enough.select("split")), "split", "left_semi")  # as many rows as combinations


def block_bootstrap(returns: DataFrame, keys: list[str], order: str, value: str, draws: int, block: int, seed: int, year: int = 252) -> DataFrame:
    """Sharpe ratios of stationary bootstrap samples: blocks of geometric length, wrapped around. keys, draw, sharpe."""

    def sample(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(order)[value].to_numpy(dtype=float)
        n = len(x)
        out = []
        for d in range(draws):
            rng = np.random.default_rng([seed, d])
            fresh = rng.random(n) < 1.0 / block
            fresh[:1] = True
            begin = np.where(fresh, rng.integers(0, max(n, 1), n), 0)
            at = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
            s = x[(begin[at] + np.arange(n) - at) % n] if n else x
            sd = s.std(ddof=1) if n > 1 else 0.0
            out.append(s.mean() / sd * math.sqrt(year) if sd > 0 else None)
        head = {k: [pdf[k].iloc[0]] * draws for k in keys}
        return pd.DataFrame({**head, "draw": range(draws), "sharpe": out})

    kinds = dict(returns.dtypes)
    return returns.select(*keys, order, value).groupBy(*keys).applyInPandas(sample, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", draw int, sharpe double")


def permutation_null(rows: DataFrame, keys: list[str], order: str, signal: str, value: str, draws: int, seed: int) -> DataFrame:
    """Mean of signal * value for shuffled signals: keys, draw, mean; draw -1 is the observed one. Series are daily and small."""

    def shuffle(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        s, x = pdf[signal].to_numpy(dtype=float), pdf[value].to_numpy(dtype=float)
        means = [float((s * x).mean())] + [float((np.random.default_rng([seed, d]).permutation(s) * x).mean()) for d in range(draws)]
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] * (draws + 1) for k in keys}, "draw": range(-1, draws), "mean": means})

    kinds = dict(rows.dtypes)
    return rows.select(*keys, order, signal, value).groupBy(*keys).applyInPandas(shuffle, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", draw int, mean double")


def run_length_posterior(x: np.ndarray, hazard: float, spread: float = 1.0) -> np.ndarray:
    """Most probable number of values since the last change point, after each value: Bayesian, with a normal distribution of
    unknown mean and variance in each run (Student's t as predictive). Runs of all lengths are kept. The prior's scale `spread` is
    given, not taken from the series, so that no result knows later values."""
    mean, kappa, alpha, beta = (np.array([v]) for v in (0.0, 1.0, 1.0, spread))
    every = np.array([math.lgamma(1.5 + 0.5 * k) - math.lgamma(1.0 + 0.5 * k) for k in range(len(x) + 1)])
    prob, out = np.array([1.0]), np.zeros(len(x), dtype=int)
    for i, v in enumerate(x):
        scale = beta * (kappa + 1) / (alpha * kappa)
        density = np.exp(every[: len(alpha)] - 0.5 * np.log(2 * math.pi * alpha * scale) - (alpha + 0.5) * np.log1p((v - mean) ** 2 / (2 * alpha * scale)))
        joint = prob * density
        prob = np.concatenate([[joint.sum() * hazard], joint * (1 - hazard)])
        prob /= prob.sum() or 1.0
        beta = np.concatenate([[spread], beta + kappa * (v - mean) ** 2 / (2 * (kappa + 1))])
        mean = np.concatenate([[0.0], (kappa * mean + v) / (kappa + 1)])
        kappa, alpha = np.concatenate([[1.0], kappa + 1]), np.concatenate([[1.0], alpha + 0.5])
        out[i] = int(prob.argmax())
    return out


def change_points(rows: DataFrame, keys: list[str], order: str, value: str, hazard: float = 0.01) -> DataFrame:
    """keys, order, run: the most probable run length after each row of a daily series (NULL values are skipped)."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=[value]).sort_values(order)
        return pdf[[*keys, order]].assign(run=run_length_posterior(pdf[value].to_numpy(dtype=float), hazard))

    kinds = dict(rows.dtypes)
    return rows.select(*keys, order, value).groupBy(*keys).applyInPandas(fit, ", ".join(f"{c} {kinds[c]}" for c in (*keys, order)) + ", run int")
