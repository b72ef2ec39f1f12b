"""Feature selection: scores of features from one pass of grouped moments, and those that need a model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from featherloom.functions.numeric import cleaned
from featherloom.operators.order import cut_points

#: Aggregates of one pass; more would make generated code too long.
WIDTH = 200


def _q(name: str):
    return F.col(f"`{name}`")


def moments(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """(feature, label, n, mean, var): count, mean and population variance of each feature per label.

    The moments of up to WIDTH features are aggregates of one grouped pass over the narrow table: nothing is unpivoted
    before it is one row a label. Null labels are left out; null, NaN and infinite values count as 0.
    """
    rows = df.filter(_q(label).isNotNull())
    parts = []
    for at in range(0, len(features), WIDTH // 2):
        some = features[at : at + WIDTH // 2]
        # cleaned once, before both moments
        narrow = rows.select(_q(label).alias("label"), *[cleaned(_q(c)).alias(f"x{k}") for k, c in enumerate(some)])
        grouped = narrow.groupBy("label").agg(F.count("*").alias("n"), *[F.struct(F.avg(f"x{k}").alias("mean"), F.var_pop(f"x{k}").alias("var")).alias(f"f{k}") for k in range(len(some))])
        long = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"f{k}.mean").alias("mean"), F.col(f"f{k}.var").alias("var")) for k, c in enumerate(some)]))
        parts.append(grouped.select("label", "n", long.alias("f")).select("f.feature", "label", "n", "f.mean", "f.var"))
    return reduce(DataFrame.unionByName, parts)


def fisher_scores(of: DataFrame) -> DataFrame:
    """(feature, score): between-class over within-class scatter; labels with one row count in the overall mean alone."""
    n, mean, var = F.col("n"), F.col("mean"), F.col("var")
    sums = of.groupBy("feature").agg((F.sum(n * mean) / F.sum(n)).alias("all"))
    two = n >= 2
    joined = of.join(F.broadcast(sums), "feature")  # one row a feature
    between = F.sum(F.when(two, n * (mean - F.col("all")) * (mean - F.col("all"))).otherwise(0.0))
    return joined.groupBy("feature").agg((between / (F.sum(F.when(two, n * var).otherwise(0.0)) + 1e-9)).alias("score"))


def anova_scores(of: DataFrame) -> DataFrame:
    """(feature, score): F of the one-way analysis of variance, null where nothing varies within classes or there are fewer than two."""
    n, mean, var = F.col("n"), F.col("mean"), F.col("var")
    stats = of.groupBy("feature").agg(F.sum(n).alias("n"), F.count("*").alias("classes"), F.sum(n * mean).alias("s"), F.sum(n * mean * mean).alias("s2"), F.sum(n * var).alias("within"))
    between = F.col("s2") - F.col("s") * F.col("s") / F.col("n")
    score = F.try_divide(between / F.nullif(F.col("classes") - 1, F.lit(0)), F.try_divide(F.col("within"), (F.col("n") - F.col("classes")).cast("double")))
    return stats.select("feature", score.alias("score"))


def regression_scores(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """(feature, score): F of the univariate linear regression, r2 / (1 - r2) x (n - 2)."""
    rows = df.filter(_q(target).isNotNull())
    row = rows.agg(F.count("*").alias("n"), *[F.corr(cleaned(_q(c)), cleaned(_q(target))).alias(f"r{k}") for k, c in enumerate(features)])
    long = row.select("n", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"r{k}").alias("r")) for k, c in enumerate(features)])).alias("f"))
    r = F.nanvl(F.col("f.r"), F.lit(None).cast("double"))
    return long.select("f.feature", (F.try_divide(r * r, 1 - r * r) * (F.col("n") - 2)).alias("score"))


def variances(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, score): population variance."""
    row = df.agg(*[F.var_pop(cleaned(_q(c))).alias(f"v{k}") for k, c in enumerate(features)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"v{k}").alias("score")) for k, c in enumerate(features)])).alias("f")).select("f.*")


def mutual_information(df: DataFrame, features: list[str], label: str, bins: int = 16) -> DataFrame:
    """(feature, score): plug-in mutual information of the label and the feature cut into bins of equal numbers of rows, in nats.

    An estimate of its own kind: the usual nearest-neighbour estimate isn't a grouped aggregation. Bins begin at the values at the places k n / bins, so equal values share
    one and an outlier doesn't fill the others. Rows become bin numbers before they are counted, so that the shuffle holds at most bins x labels counts a feature and task.
    """
    rows = df.filter(_q(label).isNotNull())
    cuts = cut_points(rows, {c: cleaned(_q(c)) for c in features}, bins)
    wide = rows.select(_q(label).alias("label"), *[cleaned(_q(c)).alias(f"x{k}") for k, c in enumerate(features)])

    def binned(k: int):
        points = cuts[features[k]]
        return reduce(lambda a, b: a + b, [(F.col(f"x{k}") >= p).cast("int") for p in points], F.lit(0))

    long = wide.select("label", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), binned(k).alias("bin")) for k, c in enumerate(features)])).alias("f")).select("f.feature", "f.bin", "label")
    joint = long.groupBy("feature", "bin", "label").agg(F.count("*").alias("n"))
    of_bin = joint.groupBy("feature", "bin").agg(F.sum("n").alias("nb"))
    of_label = joint.groupBy("feature", "label").agg(F.sum("n").alias("nl"))
    of_all = joint.groupBy("feature").agg(F.sum("n").alias("na"))
    joined = joint.join(of_bin, ["feature", "bin"]).join(of_label, ["feature", "label"]).join(of_all, "feature")
    return joined.groupBy("feature").agg(F.sum(F.col("n") / F.col("na") * F.log(F.col("n") * F.col("na") / (F.col("nb") * F.col("nl")))).alias("score"))


def ordered(scores: DataFrame, features: list[str]) -> DataFrame:
    """scores with the feature's place among the columns."""
    return scores.withColumn("place", F.array_position(F.lit(list(features)), F.col("feature")).cast("int") - 1)


def ranking(scores: DataFrame, features: list[str], k: int) -> DataFrame:
    """(feature, score, rank) of the k best, ranked as by top_k, without a job on the driver. There is one row a feature."""
    best = Window.orderBy(F.desc_nulls_last(F.nanvl("score", F.lit(None).cast("double"))), "place")
    return ordered(scores, features).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("feature", "score", "rank")


def top_k(scores: DataFrame, features: list[str], k: int, by_score: bool = True) -> list[str]:
    """The k features of the highest scores, null and NaN last, ties in the order of the columns; in the order of the scores or of the columns."""
    best = ordered(scores, features).orderBy(F.desc_nulls_last(F.nanvl("score", F.lit(None).cast("double"))), "place").limit(k).collect()  # k rows
    return [r.feature for r in (best if by_score else sorted(best, key=lambda r: r.place))]


def fisher(df: DataFrame, features: list[str], label: str, k: int = 30) -> list[str]:
    return top_k(fisher_scores(moments(df, features, label)), features, k)


def anova_f(df: DataFrame, features: list[str], label: str, k: int = 30, task: str = "classification") -> list[str]:
    scores = anova_scores(moments(df, features, label)) if task == "classification" else regression_scores(df, features, label)
    return top_k(scores, features, k, by_score=False)


def mutual_info(df: DataFrame, features: list[str], label: str, k: int = 30) -> list[str]:
    return top_k(mutual_information(df, features, label), features, k, by_score=False)


def variance_threshold(df: DataFrame, features: list[str], label: str | None = None, threshold: float = 1e-3) -> list[str]:
    """Features of a variance above the threshold; all of them if none is."""
    kept = {r.feature for r in variances(df, features).filter(F.col("score") > threshold).collect()}  # one row a feature
    return [c for c in features if c in kept] or list(features)


def combined(df: DataFrame, features: list[str], label: str, k: int = 30) -> list[str]:
    return mutual_info(df, variance_threshold(df, features), label, k)


def polynomial_columns(features: list[str]) -> dict[str, tuple[str, ...]]:
    """Names and factors of the second-degree expansion: the features, then squares and products in their order."""
    found: dict[str, tuple[str, ...]] = {c: (c,) for c in features}
    for i, a in enumerate(features):
        for b in features[i:]:
            found[f"{a}^2" if a == b else f"{a}_x_{b}"] = (a, b)
    return found


def with_products(df: DataFrame, factors: dict[str, tuple[str, ...]]) -> DataFrame:
    return df.withColumns({name: reduce(lambda x, y: x * y, [cleaned(_q(c)) for c in of]) for name, of in factors.items()})


def polynomial(df: DataFrame, features: list[str], label: str, k: int = 30) -> tuple[list[str], DataFrame]:
    """(kept names, df with them): the k best of the expansion by F. Moments of the products are aggregated without a table of all
    products; only those kept become columns."""
    factors = polynomial_columns(features)
    names = list(factors)
    parts = []
    for at in range(0, len(names), WIDTH // 2):
        some = {n: factors[n] for n in names[at : at + WIDTH // 2]}
        parts.append(moments(with_products(df.select(_q(label), *map(_q, features)), some), list(some), label))
    kept = top_k(anova_scores(reduce(DataFrame.unionByName, parts)), names, k, by_score=False)
    return kept, with_products(df, {n: factors[n] for n in kept if len(factors[n]) > 1})


def _vector(df: DataFrame, features: list[str], label: str) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    safe = df.filter(_q(label).isNotNull()).select(_q(label).cast("double").alias("label"), *[cleaned(_q(c)).alias(f"x{k}") for k, c in enumerate(features)])
    return VectorAssembler(inputCols=[f"x{k}" for k in range(len(features))], outputCol="features").transform(safe)


def _scored(df: DataFrame, features: list[str], values) -> DataFrame:
    return df.sparkSession.createDataFrame([(c, float(v)) for c, v in zip(features, values)], "feature string, score double")


def lasso_scores(df: DataFrame, features: list[str], label: str, task: str = "classification", alpha: float = 0.05, max_iter: int = 50) -> DataFrame:
    """(feature, score): mean absolute coefficient over classes of an L1 model on standardised features; labels are 0 .. C - 1."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.regression import LinearRegression

    from featherloom.operators.encode import fit_scaler

    rows = _vector(fit_scaler(df, features).transform(df), features, label)
    if task == "regression":
        weights = abs(LinearRegression(elasticNetParam=1.0, regParam=alpha, standardization=False, maxIter=max_iter).fit(rows).coefficients.toArray())
    else:
        model = LogisticRegression(family="multinomial", elasticNetParam=1.0, regParam=alpha / max(1, rows.count()), standardization=False, maxIter=max_iter).fit(rows)
        weights = abs(model.coefficientMatrix.toArray()).mean(axis=0)
    return _scored(df, features, weights)


def importance_scores(df: DataFrame, features: list[str], label: str, task: str = "classification", trees: int = 80, depth: int = 6, seed: int = 42, model: str = "forest") -> DataFrame:
    """(feature, score): importances of one fit of a forest or a booster; nothing is eliminated step by step.

    Of a booster for more than two classes, the mean of those of each class against the rest.
    """
    from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

    rows, size = _vector(df, features, label), {"maxDepth": depth, "seed": seed, "maxMemoryInMB": 1024}
    if model == "forest":
        fitted = (RandomForestClassifier if task == "classification" else RandomForestRegressor)(numTrees=trees, **size).fit(rows)
        return _scored(df, features, fitted.featureImportances.toArray())
    if task == "regression":
        return _scored(df, features, GBTRegressor(maxIter=trees, stepSize=0.1, **size).fit(rows).featureImportances.toArray())
    booster = GBTClassifier(maxIter=trees, stepSize=0.1, **size)
    if (rows.agg(F.max("label")).first()[0] or 0) <= 1:
        return _scored(df, features, booster.fit(rows).featureImportances.toArray())
    each = [m.featureImportances.toArray() for m in OneVsRest(classifier=booster, parallelism=4).fit(rows).models]
    return _scored(df, features, sum(each) / len(each))


def lasso_l1(df: DataFrame, features: list[str], label: str, k: int = 30, **options) -> list[str]:
    return top_k(lasso_scores(df, features, label, **options), features, k)


def importance(df: DataFrame, features: list[str], label: str, k: int = 30, **options) -> list[str]:
    return top_k(importance_scores(df, features, label, **options), features, k)


def anova_regression(df: DataFrame, features: list[str], target: str, k: int = 30) -> list[str]:
    return anova_f(df, features, target, k, "regression")


def binned_target(df: DataFrame, target: str, bins: int = 10) -> DataFrame:
    """df with ``_target_bin``, the place of a numeric target among bins of equal numbers of rows: the class label of selectors that need one."""
    points = cut_points(df, {target: cleaned(_q(target))}, bins)[target]
    return df.withColumn("_target_bin", reduce(lambda a, b: a + b, [(cleaned(_q(target)) >= p).cast("int") for p in points], F.lit(0)))


#: Name -> function of (df, features, label, k) that gives the features kept.
SELECTORS = {
    "fisher": fisher,
    "anova_f": anova_f,
    "mutual_info": mutual_info,
    "lasso_l1": lasso_l1,
    "variance_thresh": lambda df, features, label, k=30: variance_threshold(df, features),
    "importance": importance,
    "polynomial": lambda df, features, label, k=30: polynomial(df, features, label, k)[0],
    "combined": combined,
}

#: The same for numeric targets.
REGRESSION_SELECTORS = {
    "fisher": lambda df, features, target, k=30: fisher(binned_target(df, target), features, "_target_bin", k),
    "anova_f": anova_regression,
    "mutual_info": lambda df, features, target, k=30: mutual_info(binned_target(df, target), features, "_target_bin", k),
    "lasso_l1": lambda df, features, target, k=30, **o: lasso_l1(df, features, target, k, task="regression", **o),
    "variance_thresh": SELECTORS["variance_thresh"],
    "importance": lambda df, features, target, k=30, **o: importance(df, features, target, k, task="regression", **o),
    "polynomial": lambda df, features, target, k=30: anova_regression(with_products(df, polynomial_columns(features)), list(polynomial_columns(features)), target, k),
    "combined": lambda df, features, target, k=30: mutual_info(binned_target(df, target), variance_threshold(df, features), "_target_bin", k),
}
