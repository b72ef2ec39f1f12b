"""Paired comparisons of methods over folds."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to this many pairs all resamples, and all signs, are enumerated.
EXACT = 6


def format_p(p: Column) -> Column:
    return F.when(p.isNull() | F.isnan(p), "nan").when(p < 1e-4, "<1e-4").when(p < 1e-3, F.format_string("%.1e", p)).otherwise(F.format_string("%.3f", p))


def t_cdf(t: float, df: float) -> float:
    """Student's distribution by the regularised incomplete beta function (continued fraction)."""
    if math.isnan(t):
        return math.nan
    if math.isinf(t):
        return 1.0 if t > 0 else 0.0
    x, a, b = df / (df + t * t), df / 2, 0.5

    def fraction(a: float, b: float, x: float) -> float:
        c, d = 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d or 1e-300)
        h = d
        for m in range(1, 300):
            for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / ((1 + k * d) or 1e-300)
                c = (1 + k / c) or 1e-300
                h *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return h

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x or 1e-300) + b * math.log1p(-x)) if 0 < x < 1 else 0.0
    if x == 1:
        tail = 1.0
    elif x < (a + 1) / (a + b + 2):
        tail = front * fraction(a, b, x) / a
    else:
        tail = 1 - front * fraction(b, a, 1 - x) / b
    return 1 - tail / 2 if t > 0 else tail / 2


def wilcoxon_p(d: list[float]) -> tuple[float, float]:
    """(statistic, two-sided p) of the signed ranks: exact by all signs if no difference is zero or tied, else by the normal curve, zeros split in halves."""
    d = [x for x in d if not math.isnan(x)]
    if not d or all(abs(x) < 1e-12 for x in d):
        return 0.0, 1.0
    size = sorted(abs(x) for x in d)
    rank = {v: size.index(v) + (size.count(v) + 1) / 2 for v in size}
    zero = sum(rank[0.0] for x in d if x == 0) if 0.0 in rank else 0.0
    plus = sum(rank[abs(x)] for x in d if x > 0) + zero / 2
    minus = sum(rank[abs(x)] for x in d if x < 0) + zero / 2
    n, w = len(d), min(plus, minus)
    if n <= 50 and len(rank) == n and 0.0 not in rank:
        ways = [1]  # ways[s]: subsets of ranks 1 .. n that sum to s
        for r in range(1, n + 1):
            ways = [(ways[s] if s < len(ways) else 0) + (ways[s - r] if 0 <= s - r < len(ways) else 0) for s in range(len(ways) + r)]
        return w, min(1.0, 2 * sum(ways[: int(w) + 1]) / 2**n)
    var = sum(r * r for r in (rank[abs(x)] for x in d)) / 4
    z = (w - (plus + minus) / 2) / math.sqrt(var) if var else 0.0
    return w, min(1.0, math.erfc(abs(z) / math.sqrt(2)))


#: Modulus and constants of the resampling generator: all products fit in 64 bits.
PRIME, STEPS = 2_147_483_647, (1_013_904_223, 16_807, 69_621)


def resampled(r, i, n: int, seed: int, div):
    """The place, of n, that resample r takes at i: r, i and seed are mixed to a residue that is squared and shifted three times. r and i are integers, arrays or columns; div divides them."""
    x = (r * 48_271 + i * 69_621 + seed * 16_807 + 12_345) % PRIME
    for step in STEPS:
        x = (x * x + step) % PRIME
    return div(x * n, PRIME)


def bootstrap_bounds(d: list[float], resamples: int = 5000, seed: int = 42) -> tuple[float, float]:
    """The 2.5 and 97.5 percentiles of the mean of resamples: all n^n of them up to EXACT pairs, else so many at random."""
    import itertools

    import numpy as np

    if not d:
        return math.nan, math.nan
    if len(d) <= EXACT:
        means = np.array([sum(x) for x in itertools.product(d, repeat=len(d))]) / len(d)
    else:
        r, i = np.arange(resamples, dtype=np.int64)[:, None], np.arange(len(d), dtype=np.int64)[None, :]
        means = np.array(d)[resampled(r, i, len(d), seed, lambda x, m: x // m)].mean(axis=1)
    low, high = np.percentile(means, [2.5, 97.5])
    return float(low), float(high)


_PAIR = "method_a string, method_b string, n int, mean_a double, mean_b double, delta double, ci_low double, ci_high double, cohen_d double, t double, p_t double, w double, p_w double, sig_005 boolean, sig_bonferroni boolean"


def paired(a: list[float], b: list[float], alpha: float = 0.05, tests: int = 1) -> dict:
    """One comparison of equally long lists of fold scores; the verdicts are the t-test's, with Bonferroni's correction for ``tests``."""
    if len(a) != len(b):
        raise ValueError("both methods need a score for every fold")
    n = len(a)
    d = [x - y for x, y in zip(a, b)]
    mean = sum(d) / n if n else math.nan
    std = math.sqrt(sum((x - mean) ** 2 for x in d) / (n - 1)) if n > 1 else 0.0
    low, high = bootstrap_bounds(d)
    if all(abs(x) < 1e-12 for x in d):
        t, p = math.nan, 1.0
    elif std < 1e-300 or n < 2:
        t, p = math.inf if mean > 0 else -math.inf, 0.0
    else:
        t = mean / (std / math.sqrt(n))
        p = 2 * (1 - t_cdf(abs(t), n - 1))
    w, pw = wilcoxon_p(d)
    return {"n": n, "mean_a": sum(a) / n if n else math.nan, "mean_b": sum(b) / n if n else math.nan, "delta": mean, "ci_low": low, "ci_high": high, "cohen_d": mean / std if std >= 1e-12 else 0.0, "t": t, "p_t": p, "w": w, "p_w": pw, "sig_005": bool(p < alpha), "sig_bonferroni": bool(p < alpha / max(tests, 1))}


def _compare(pairs: DataFrame, tests: int, alpha: float) -> DataFrame:
    """pairs: (method_a, method_b, scores), scores an array of (fold, a, b): one comparison a row, folds of a method being few."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for a, b, scores in zip(batch.method_a, batch.method_b, batch.scores):
                of = sorted(scores, key=lambda s: s["fold"])
                rows.append({"method_a": a, "method_b": b} | paired([s["a"] for s in of], [s["b"] for s in of], alpha, tests))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _PAIR.split(", ")])

    return pairs.mapInPandas(run, _PAIR)


def all_pairs(scores: DataFrame, alpha: float = 0.05, order: str | None = None) -> DataFrame:
    """Every two methods of (method, fold, value), the earlier one first: by the least value of the column ``order``, ties and without it by name. delta is the first's less the second's."""
    of = scores.groupBy("method").agg(*([F.min(f"`{order}`").alias("_place")] if order else []), F.count("*").alias("_rows")).select("method", F.struct(*([F.col("_place")] if order else []), F.col("method").alias("_name")).alias("_place"))
    placed = scores.select("method", "fold", "value").join(F.broadcast(of), "method")  # methods are few
    a = placed.select(F.col("method").alias("method_a"), "fold", F.col("value").alias("a"), F.col("_place").alias("_a"))
    b = placed.select(F.col("method").alias("method_b"), "fold", F.col("value").alias("b"), F.col("_place").alias("_b"))
    joined = a.join(b, "fold").filter(F.col("_a") < F.col("_b")).groupBy("method_a", "method_b").agg(F.collect_list(F.struct("fold", "a", "b")).alias("scores"))  # one element a fold
    n = of.count()
    return _compare(joined, n * (n - 1) // 2, alpha)


def against(scores: DataFrame, reference: str, alpha: float = 0.05) -> DataFrame:
    """Every other method against the reference; an unknown reference is a KeyError."""
    base = scores.filter(F.col("method") == reference).select("fold", F.col("value").alias("b"))
    if base.isEmpty():
        raise KeyError(reference)
    others = scores.filter(F.col("method") != reference)
    joined = others.join(F.broadcast(base), "fold").groupBy(F.col("method").alias("method_a")).agg(F.collect_list(F.struct("fold", F.col("value").alias("a"), "b")).alias("scores"))
    return _compare(joined.select("method_a", F.lit(reference).alias("method_b"), "scores"), others.select("method").distinct().count(), alpha)


def summarize(scores: DataFrame, higher_is_better: bool = True) -> DataFrame:
    """(method, n, mean, std, min, max), best first, ties by name; the sample deviation, 0 of one fold."""
    table = scores.groupBy("method").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.round(F.coalesce(F.stddev_samp("value"), F.lit(0.0)), 4).alias("std"), F.round(F.min("value"), 4).alias("min"), F.round(F.max("value"), 4).alias("max"))
    return table.orderBy(F.desc("mean") if higher_is_better else F.asc("mean"), "method")


def exact_bootstrap(differences: DataFrame, resamples: int = 5000, seed: int = 42) -> DataFrame:
    """(key, ci_low, ci_high) of (key, ord, d): the 2.5 and 97.5 percentiles of the mean over resamples of a key's differences, in SQL.

    Up to EXACT differences all n^n resamples are enumerated, by the digits of a range; of more, ``resamples`` are drawn by resampled, the same as in bootstrap_bounds. ord gives
    the order of a key's differences. A key has as many differences as there are folds, few. Every key with a difference has a row; null differences are left out.
    """
    sized = differences.filter("d IS NOT NULL").groupBy("key").agg(F.count("*").cast("int").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("ord", "d"))), lambda x: x["d"]).alias("ds"))
    all_of_them = F.col("n") <= EXACT
    count = F.when(all_of_them, F.pow("n", F.least("n", F.lit(EXACT))).cast("long")).otherwise(F.lit(resamples).cast("long"))
    each = sized.select("key", "n", "ds", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("r"))
    digit = lambda i: F.floor(F.col("r") / F.pow(F.col("n"), i)) % F.col("n")
    drawn = lambda i: resampled(F.col("r"), i.cast("long"), F.col("n").cast("long"), seed, lambda x, m: F.floor(x / F.lit(m)))
    picked = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.element_at("ds", F.when(all_of_them, digit(i)).otherwise(drawn(i)).cast("int") + 1))
    means = each.select("key", (F.aggregate(picked, F.lit(0.0), lambda s, x: s + x) / F.col("n")).alias("m"))
    return means.groupBy("key").agg(F.percentile("m", F.lit(0.025)).alias("ci_low"), F.percentile("m", F.lit(0.975)).alias("ci_high"))
