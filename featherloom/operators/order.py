"""Order over a whole table without a single task: running totals, ranks, codes and quantiles by range partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from featherloom.session import materialize


def running_total(df: DataFrame, order: list[str], amount: str | None = None, name: str = "before") -> DataFrame:
    """df with the sum of ``amount`` (or the number of rows) before each row in the order of columns that are unique together.

    Rows are range-partitioned and written once, so that the partition of a row is fixed; each partition is summed
    by itself and gets the sum of those before it: one number a partition is all that is broadcast.
    """
    amount_of = F.col(f"`{amount}`") if amount else F.lit(1)
    parts = materialize(df.repartitionByRange(*[F.col(f"`{c}`") for c in order]).withColumn("_part", F.spark_partition_id()).withColumn("_amount", amount_of.cast("long")))
    sums = parts.groupBy("_part").agg(F.sum("_amount").alias("_sum"))
    sums = sums.withColumn("_offset", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_offset")
    inside = Window.partitionBy("_part").orderBy(*[F.col(f"`{c}`") for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("_inside", F.coalesce(F.sum("_amount").over(inside), F.lit(0))).join(F.broadcast(sums), "_part").withColumn(name, F.col("_offset") + F.col("_inside")).drop("_part", "_amount", "_offset", "_inside")


def ordinal_codes(df: DataFrame, value: str, first_seen_by: str | None = None) -> DataFrame:
    """(value, code): codes 0, 1, ... of the distinct non-null values, in their order or, with ``first_seen_by``, in that of their first row."""
    col = F.col(f"`{value}`")
    if first_seen_by:
        seen = df.filter(col.isNotNull()).groupBy(col.alias("value")).agg(F.min(f"`{first_seen_by}`").alias("_first"))
        return running_total(seen, ["_first", "value"], name="code").select("value", F.col("code").cast("int").alias("code"))
    return running_total(df.filter(col.isNotNull()).select(col.alias("value")).distinct(), ["value"], name="code").select("value", F.col("code").cast("int").alias("code"))


def value_ranks(df: DataFrame, value: Column) -> DataFrame:
    """(value, n, rank): of each distinct non-null value its rows and their average rank, from 1."""
    counts = df.select(value.alias("value")).filter("value IS NOT NULL").groupBy("value").agg(F.count("*").alias("n"))
    return running_total(counts, ["value"], "n").select("value", "n", (F.col("before") + (F.col("n") + 1) / 2).alias("rank"))


def grouped_quantiles(df: DataFrame, key: Column, value: Column, quantiles: dict[str, float]) -> DataFrame:
    """(key, one column a quantile): linearly interpolated quantiles of the non-null values of each key.

    Values are counted per key and ordered by key and value over range partitions, so that a key with a third of all rows is
    spread over many tasks; no buffer holds the values of a key.
    """
    counts = df.select(key.alias("key"), value.cast("double").alias("value")).filter("key IS NOT NULL AND value IS NOT NULL").groupBy("key", "value").agg(F.count("*").alias("n"))
    placed = running_total(counts, ["key", "value"], "n")
    of_key = placed.groupBy("key").agg(F.min("before").alias("first"), F.sum("n").alias("size"))
    picked = placed.join(of_key, "key").withColumn("from", F.col("before") - F.col("first"))
    inside = lambda k: (F.col("from") <= k) & (k < F.col("from") + F.col("n"))
    ends = []
    for name, q in quantiles.items():
        at = (F.col("size") - 1) * F.lit(float(q))
        ends += [F.min(F.when(inside(F.floor(at)), F.col("value"))).alias(f"{name}_low"), F.max(F.when(inside(F.ceil(at)), F.col("value"))).alias(f"{name}_high")]
    found = picked.groupBy("key").agg(F.first("size").alias("size"), *ends)

    def between(name: str, q: float) -> Column:
        at = (F.col("size") - 1) * F.lit(float(q))
        return (F.col(f"{name}_low") + (F.col(f"{name}_high") - F.col(f"{name}_low")) * (at - F.floor(at))).alias(name)

    return found.select("key", *[between(n, q) for n, q in quantiles.items()])


def grouped_quantile(df: DataFrame, key: Column, value: Column, q: float = 0.5, name: str = "quantile") -> DataFrame:
    """(key, quantile): one quantile of each key, see grouped_quantiles."""
    return grouped_quantiles(df, key, value, {name: q})


def long_values(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """(key, value): the columns under each other, by name."""
    return df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("key"), c.cast("double").alias("value")) for n, c in columns.items()])).alias("x")).select("x.key", "x.value")


def cut_points(df: DataFrame, columns: dict[str, Column], parts: int) -> dict[str, list[float]]:
    """Of each column the distinct values at the places k n / parts of its sorted non-null values, k = 1 .. parts - 1: at most parts - 1 numbers a column reach the driver."""
    counts = long_values(df, columns).filter("value IS NOT NULL").groupBy("key", "value").agg(F.count("*").alias("n"))
    placed = running_total(counts, ["key", "value"], "n")
    of_key = placed.groupBy("key").agg(F.min("before").alias("first"), F.sum("n").alias("size"))
    start = F.col("before") - F.col("first")
    # the number of places at or before the end of a value's rows that aren't before their start
    upto = lambda c: F.floor((c * parts - 1) / F.col("size"))
    picked = placed.join(F.broadcast(of_key), "key").withColumn("_from", F.greatest(upto(start), F.lit(0))).withColumn("_to", F.least(upto(start + F.col("n")), F.lit(parts - 1)))
    out: dict[str, list[float]] = {c: [] for c in columns}
    for key, value in picked.filter("_to > _from").select("key", "value").orderBy("key", "value").collect():
        out[key].append(value)
    return out


def running(df: DataFrame, group: str, order: str, aggregates: dict[str, tuple[str, Column]]) -> DataFrame:
    """df with a column for each of aggregates, name -> ("sum" or "max", value): the aggregate of the group's rows up to this one, by order.

    Rows are range-partitioned by group and order; each part of a group is aggregated by itself and gets what came before it, so that a group with a third of all rows
    isn't one task's. Rows of equal order are taken in any order.
    """
    how = {"sum": F.sum, "max": F.max}
    values = {f"_v{k}": c for k, (_, c) in enumerate(aggregates.values())}
    parts = materialize(df.withColumns(values).repartitionByRange(F.col(f"`{group}`"), F.col(f"`{order}`")).withColumn("_part", F.spark_partition_id()))
    kinds = [(f"_v{k}", name, how[kind], kind) for k, (name, (kind, _)) in enumerate(aggregates.items())]
    of_part = parts.groupBy("_part", F.col(f"`{group}`").alias("_group")).agg(*[f(v).alias(v) for v, _, f, _ in kinds])
    earlier = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    before = of_part.select("_part", "_group", *[f(v).over(earlier).alias(f"_b{v}") for v, _, f, _ in kinds])
    inside = Window.partitionBy("_part", F.col(f"`{group}`")).orderBy(F.col(f"`{order}`")).rowsBetween(Window.unboundedPreceding, 0)
    joined = parts.withColumns({f"_i{v}": f(v).over(inside) for v, _, f, _ in kinds}).join(before.withColumnRenamed("_part", "_p"), (F.col("_part") == F.col("_p")) & F.col(f"`{group}`").eqNullSafe(F.col("_group")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = {name: F.greatest(f"_i{v}", f"_b{v}") if kind == "max" else zero(f"_i{v}") + zero(f"_b{v}") for v, name, _, kind in kinds}
    return joined.withColumns(out).select(*[F.col(f"`{c}`") for c in df.columns], *[F.col(n) for n in out])
