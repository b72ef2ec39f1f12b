"""Folds and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from featherloom.operators.order import running_total


def _shuffled(seed: int, row_id: str):
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(f"`{row_id}`").cast("string")))


def stratified_folds(df: DataFrame, label: str, row_id: str, k: int = 5, seed: int = 42) -> DataFrame:
    """df with fold 0 .. k - 1: rows of a label are dealt in the order of a digest of seed and row_id.

    Ordered over range partitions by label and digest, so that a label with a third of all rows isn't one task's. Null labels are
    a label of their own. Folds of a label differ by one row at most.
    """
    dealt = running_total(df.withColumn("_null", F.col(f"`{label}`").isNull()).withColumn("_digest", _shuffled(seed, row_id)), ["_null", label, "_digest", row_id])
    first = dealt.groupBy(F.col(f"`{label}`").alias("_label")).agg(F.min("before").alias("_first"))
    joined = dealt.join(F.broadcast(first) if first.limit(100_001).count() <= 100_000 else first, F.col(f"`{label}`").eqNullSafe(F.col("_label")))
    return joined.withColumn("fold", ((F.col("before") - F.col("_first")) % k).cast("int")).drop("_null", "_digest", "before", "_label", "_first")


def kfold(df: DataFrame, row_id: str, k: int = 5, seed: int = 42) -> DataFrame:
    """df with fold 0 .. k - 1, sizes within one of each other."""
    dealt = running_total(df.withColumn("_digest", _shuffled(seed, row_id)), ["_digest", row_id])
    return dealt.withColumn("fold", (F.col("before") % k).cast("int")).drop("_digest", "before")


def sample_rows(df: DataFrame, row_id: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement: those of the smallest digests."""
    return df.withColumn("_digest", _shuffled(seed, row_id)).orderBy("_digest", f"`{row_id}`").limit(n).drop("_digest")


def top_per_group(df: DataFrame, group: str, order: list, n: int) -> DataFrame:
    """The first n rows of each group; Spark keeps n a group in each task before the shuffle."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("_rank") <= n).drop("_rank")
