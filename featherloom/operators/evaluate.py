"""Cross-validation of feature sets with MLlib models and metrics in SQL."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featherloom.functions.numeric import cleaned
from featherloom.operators import forest, metrics
from featherloom.operators.encode import fit_scaler
from featherloom.operators.order import ordinal_codes
from featherloom.operators.split import kfold, stratified_folds
from featherloom.session import materialize


def classifiers(classes: int = 2, depth: int = 6, seed: int = 42) -> dict:
    """Name -> function of the number of training rows that makes a model. Each has its own size, a smaller one from 50 classes. Boosting is one-vs-rest; see probabilities."""
    many = classes >= 50
    return {
        "gbt": lambda rows=None: OneVsRest(classifier=GBTClassifier(maxIter=120 if many else 200, maxDepth=depth, stepSize=0.1, seed=seed), parallelism=4),
        "logreg": lambda rows=None: LogisticRegression(family="multinomial", maxIter=800 if many else 2000),
        "rf": lambda rows=None: RandomForestClassifier(numTrees=150 if many else 300, minInstancesPerNode=2, maxDepth=depth, seed=seed, maxMemoryInMB=1024),
    }


def regressors(trees: int = 300, depth: int = 6, seed: int = 42) -> dict:
    """The same for numbers. The ridge's penalty of 1 on the sum of squares is 1 / rows on their mean, which is what is minimised here."""
    return {
        "gbt": lambda rows=None: GBTRegressor(maxIter=trees, maxDepth=depth, stepSize=0.1, seed=seed),
        "ridge": lambda rows=None: LinearRegression(elasticNetParam=0.0, regParam=1.0 / max(rows or 1000, 1), standardization=False),
        "rf": lambda rows=None: RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=seed, maxMemoryInMB=1024),
    }


def probabilities(found: DataFrame) -> Column:
    """The probabilities of a fitted model's classes; of boosting by one-vs-rest, each class's 1 / (1 + exp(-2 margin)), which is what its loss makes of a margin, divided by their sum."""
    if "probability" in found.columns:
        return vector_to_array("probability")
    if "rawPrediction" not in found.columns:
        return F.lit(None).cast("array<double>")
    own = F.transform(vector_to_array("rawPrediction"), lambda m: 1 / (1 + F.exp(-2 * m)))
    return F.transform(own, lambda p: p / F.aggregate(own, F.lit(0.0), lambda s, x: s + x))


#: (train, features) -> (function on a frame, features it gives); fitted on the training rows alone.
Builder = Callable[[DataFrame, list[str], str], tuple[Callable[[DataFrame], DataFrame], list[str]]]


def identity(train: DataFrame, features: list[str], label: str):
    return (lambda df: df), features


def selecting(selector, k: int) -> Builder:
    return lambda train, features, label: ((lambda df: df), selector(train, features, label, k))


def cross_validate(df: DataFrame, features: list[str], label: str, row_id: str, models: dict, builders: dict[str, Builder] | None = None, task: str = "classification", folds: list[int] | None = None, parallel: int = 3, in_tasks: bool = True) -> DataFrame:
    """(method, model, fold, metric, value, n_in, n_out): every model on every fold of every feature builder.

    models: name -> function of the number of training rows (null but for the ridge) that makes a model. df has a fold column and, for classification, labels 0 .. C - 1. Linear models get standardised features, fitted on the fold's
    training rows. Forests of classes are grown in tasks (see forest) but where in_tasks is false. Fits run side by side from a few driver threads; predictions stay distributed and one aggregation gives the metrics of all.
    """
    builders = builders or {"base": identity}
    base = materialize(df.filter(F.col(label).isNotNull()).select(row_id, "fold", F.col(label).cast("double").alias(label), *[cleaned(F.col(f"`{c}`")).alias(c) for c in features]))
    folds = folds if folds is not None else sorted(r.fold for r in base.select("fold").distinct().collect())

    def one(method: str, name: str, fold: int) -> DataFrame:
        train, test = base.filter(F.col("fold") != fold), base.filter(F.col("fold") == fold)
        change, kept = builders[method](train, features, label)
        train, test = change(train), change(test)
        if name in ("logreg", "ridge"):
            scaler = fit_scaler(train, kept)
            train, test = scaler.transform(train), scaler.transform(test)
        renamed = {c: f"_x{k}" for k, c in enumerate(kept)}
        vector = VectorAssembler(inputCols=list(renamed.values()), outputCol="features")

        def ready(part: DataFrame) -> DataFrame:
            return vector.transform(part.select(row_id, F.col(label).alias("label"), *[cleaned(F.col(f"`{c}`")).alias(n) for c, n in renamed.items()]))

        fitted = ready(train)
        model = models[name](fitted.count() if name == "ridge" else None)
        found = forest.predicted(model, fitted, ready(test), list(renamed.values())) if in_tasks and isinstance(model, RandomForestClassifier) else None
        if found is None:
            found = model.fit(fitted).transform(ready(test))
            probability = probabilities(found)
        else:
            probability = F.col("probability")
        tags = (F.lit(method).alias("method"), F.lit(name).alias("model"), F.lit(fold).alias("fold"), F.lit(len(features)).alias("n_in"), F.lit(len(kept)).alias("n_out"))
        return found.select(*tags, "label", F.col("prediction").alias("predicted"), probability.alias("probability"))

    with ThreadPoolExecutor(parallel) as pool:
        parts = list(pool.map(lambda x: one(*x), [(m, n, k) for m in builders for n in models for k in folds]))
    predicted = materialize(reduce(DataFrame.unionByName, parts))
    by = ["method", "model", "fold", "n_in", "n_out"]
    if task == "classification":
        classes = list(range(int(base.agg(F.coalesce(F.max(label), F.lit(0))).first()[0]) + 1))
        known = predicted.filter("probability IS NOT NULL").withColumn("own", F.try_element_at("probability", F.col("label").cast("int") + 1))
        wide = [metrics.accuracy(predicted, by), metrics.macro_f1(predicted, by), metrics.auc_one_vs_rest(known, by, classes), metrics.log_loss(known, by, "own")]
    else:
        key = F.concat_ws("\x1f", *[F.col(c).cast("string") for c in by])
        medae = metrics.median_absolute_error(predicted.withColumn("key", key), "key")
        medae = medae.withColumn("p", F.split("key", "\x1f")).select(F.col("p")[0].alias("method"), F.col("p")[1].alias("model"), *[F.col("p")[k].cast("int").alias(by[k]) for k in (2, 3, 4)], "medae")
        wide = [metrics.regression(predicted, by), medae]
    long = [w.unpivot(by, [c for c in w.columns if c not in by], "metric", "value") for w in wide]
    return reduce(DataFrame.unionByName, long)


def proxy_score(df: DataFrame, features: list[str], label: str, row_id: str, task: str = "classification", folds: int = 2, trees: int = 60, depth: int = 6, seed: int = 42) -> float | None:
    """What a search goes by: the mean accuracy of a small forest over few folds, or minus its mean rmse; null of an empty table. Rows without a label are left out."""
    rows = df.filter(F.col(f"`{label}`").isNotNull())
    if task == "classification":
        codes = ordinal_codes(rows, label).select(F.col("value").alias("_value"), F.col("code").cast("double").alias("target"))
        rows = rows.join(codes, F.col(f"`{label}`") == F.col("_value")).drop("_value")
        dealt = stratified_folds(rows, "target", row_id, folds, seed)
        model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, maxMemoryInMB=1024)
    else:
        dealt = rows.withColumn("target", F.col(f"`{label}`").cast("double")).join(kfold(rows.select(row_id), row_id, folds, seed), row_id)
        model = RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=seed, maxMemoryInMB=1024)
    found = cross_validate(dealt, features, "target", row_id, {"rf": lambda rows=None: model}, task=task, folds=list(range(folds)), in_tasks=False)
    return metrics.primary_score(found, "rf", task).first()["score"] if dealt.limit(1).count() else None


def permutation_importance(predict: Callable[[DataFrame], DataFrame], df: DataFrame, features: list[str], label: str, row_id: str, seed: int = 42) -> DataFrame:
    """(feature, drop): how far accuracy falls when a feature's values are dealt to other rows.

    The rows are numbered twice, in two digest orders over range partitions, once for all features: the row at a place of the one gets the values of the row at
    that place of the other. predict gives df with ``predicted``.
    """
    from featherloom.operators.order import running_total

    def score(frame: DataFrame) -> float:
        return predict(frame).agg(F.avg((F.col(label) == F.col("predicted")).cast("double"))).first()[0] or 0.0

    digest = lambda salt: F.md5(F.concat_ws(":", F.lit(f"{seed}{salt}"), F.col(row_id).cast("string")))
    places = running_total(df.select(row_id, digest("a").alias("_a")), ["_a", row_id], name="_at").select(F.col(row_id).alias("_row"), "_at")
    values = running_total(df.select(row_id, digest("b").alias("_b"), *[F.col(f"`{c}`").alias(f"_dealt{k}") for k, c in enumerate(features)]), ["_b", row_id], name="_at").drop(row_id, "_b")
    dealt = materialize(df.join(places.join(values, "_at"), F.col(row_id) == F.col("_row")).drop("_row", "_at"))
    whole = score(df)
    found = [(name, whole - score(dealt.withColumn(name, F.col(f"_dealt{k}")).select(*[F.col(f"`{c}`") for c in df.columns]))) for k, name in enumerate(features)]
    return df.sparkSession.createDataFrame(found, "feature string, drop double")
