"""Metrics of predictions, as aggregations over a table of predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featherloom.operators.order import running_total

#: Probabilities are kept this far from 0.
EPS = 1e-15


def accuracy(df: DataFrame, by: list[str], label: str = "label", predicted: str = "predicted") -> DataFrame:
    return df.groupBy(*by).agg(F.avg((F.col(label) == F.col(predicted)).cast("double")).alias("accuracy"))


def macro_f1(df: DataFrame, by: list[str], label: str = "label", predicted: str = "predicted") -> DataFrame:
    """The mean F1 of all classes that are true or predicted anywhere in the group; 0 where a class is never hit."""
    cells = df.groupBy(*by, F.col(label).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    pair = F.explode(F.array(F.struct(F.col("t").alias("class"), F.lit(1).alias("true"), F.lit(0).alias("pred")), F.struct(F.col("p").alias("class"), F.lit(0).alias("true"), F.lit(1).alias("pred"))))
    each = cells.select(*by, "n", (F.col("t") == F.col("p")).alias("hit"), pair.alias("c"))
    classes = each.groupBy(*by, "c.class").agg(F.sum(F.col("n") * F.col("c.true")).alias("t"), F.sum(F.col("n") * F.col("c.pred")).alias("p"), F.sum(F.when(F.col("hit"), F.col("n") * F.col("c.true")).otherwise(0)).alias("tp"))
    return classes.groupBy(*by).agg(F.avg(F.coalesce(F.try_divide(2.0 * F.col("tp"), (F.col("t") + F.col("p")).cast("double")), F.lit(0.0))).alias("macro_f1"))


def auc(df: DataFrame, by: list[str], positive: str, score: str) -> DataFrame:
    """Area under the ROC curve by rank sums, ties at their average rank; null without both classes. Ranks come from counts per score, ordered over range partitions."""
    counts = df.groupBy(*by, F.col(score).alias("s")).agg(F.count("*").alias("n"), F.sum(F.col(positive).cast("long")).alias("pos"))
    placed = running_total(counts, [*by, "s"], "n")
    first = placed.groupBy(*by).agg(F.min("before").alias("first"), F.sum("n").alias("size"), F.sum("pos").alias("np"))
    joined = placed.join(F.broadcast(first), by) if by else placed.crossJoin(F.broadcast(first))  # one row a group of by
    rank = F.col("before") - F.col("first") + (F.col("n") + 1) / 2
    nn = F.col("size") - F.col("np")
    summed = joined.groupBy(*by, "size", "np").agg(F.sum(rank * F.col("pos")).alias("r"))
    return summed.select(*by, F.try_divide(F.col("r") - F.col("np") * (F.col("np") + 1) / 2, (F.col("np") * nn).cast("double")).alias("auc"))


def auc_one_vs_rest(df: DataFrame, by: list[str], classes: list[int], label: str = "label", probability: str = "probability") -> DataFrame:
    """The mean area of each class against the rest; probability is an array in the order of classes."""
    long = df.select(*by, label, F.posexplode(probability).alias("k", "s")).withColumn("positive", F.col(label) == F.element_at(F.lit(classes), F.col("k") + 1)).select(*by, "k", "positive", "s")
    return auc(long, [*by, "k"], "positive", "s").groupBy(*by).agg(F.avg("auc").alias("auc"))


def log_loss(df: DataFrame, by: list[str], true_probability: str) -> DataFrame:
    """-mean ln of the probability given to the true class."""
    return df.groupBy(*by).agg(F.avg(-F.log(F.greatest(F.lit(EPS), F.least(F.col(true_probability), F.lit(1 - EPS))))).alias("log_loss"))


def regression(df: DataFrame, by: list[str], label: str = "label", predicted: str = "predicted") -> DataFrame:
    """rmse, mae and r2; r2 is null for a constant label."""
    e = F.col(label) - F.col(predicted)
    stats = df.groupBy(*by).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.sum(e * e).alias("sse"), F.count("*").alias("n"), F.var_pop(label).alias("v"))
    return stats.select(*by, "rmse", "mae", (1 - F.try_divide(F.col("sse"), F.col("n") * F.col("v"))).alias("r2"))


def median_absolute_error(df: DataFrame, by: str, label: str = "label", predicted: str = "predicted") -> DataFrame:
    from featherloom.operators.order import grouped_quantile

    return grouped_quantile(df, F.col(by), F.abs(F.col(label) - F.col(predicted)), 0.5, "medae").withColumnRenamed("key", by)


def aggregate_folds(folds: DataFrame) -> DataFrame:
    """(method, model, metric, mean, std): over folds, with the population deviation."""
    return folds.groupBy("method", "model", "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def primary_score(folds: DataFrame, model: str, task: str = "classification") -> DataFrame:
    """(method, score): the mean accuracy of a model over folds, or minus its mean rmse; methods without it have null."""
    metric, sign = ("accuracy", 1) if task == "classification" else ("rmse", -1)
    return folds.groupBy("method").agg((sign * F.avg(F.when((F.col("model") == model) & (F.col("metric") == metric), F.col("value")))).alias("score"))
