"""Costs, trade-offs, rationales, descriptions of data, and tables for papers."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from featherloom.operators.encode import categorical_columns
from featherloom.functions.numeric import finite
from featherloom.functions.text import description
from featherloom.operators.split import sample_rows, top_per_group


def token_cost(usage: DataFrame, prices: DataFrame, key: str = "model_id") -> DataFrame:
    """usage with usd and notes: tokens by the prices per million (key, usd_in, usd_out); an unknown model costs 0 and is noted. The price list is a stated table."""
    joined = usage.join(prices.withColumnRenamed(key, "_key"), F.col(key) == F.col("_key"), "left")
    usd = F.coalesce(F.col("prompt_tokens") / 1e6 * F.col("usd_in") + F.col("completion_tokens") / 1e6 * F.col("usd_out"), F.lit(0.0))
    return joined.withColumn("usd", F.round(usd, 4)).withColumn("notes", F.when(F.col("_key").isNull(), "unknown price").otherwise("")).drop("_key", "usd_in", "usd_out")


def machine_cost(usage: DataFrame, hourly_usd: float, name: str) -> DataFrame:
    """usage with usd and notes: the hours of latency at a rate."""
    return usage.withColumn("usd", F.round(F.lit(float(hourly_usd)) * F.coalesce("latency_s", F.lit(0.0)) / 3600, 4)).withColumn("notes", F.lit(f"{name} @ ${hourly_usd:.2f}/hr"))


def tradeoff(costs: DataFrame, accuracy: DataFrame, key: str = "backbone") -> DataFrame:
    """costs with accuracy and acc_per_usd (infinite for no cost or no accuracy), the most accurate first."""
    joined = costs.join(accuracy.select(F.col(key).alias("_key"), F.col("accuracy")), F.col(key) == F.col("_key"), "left").drop("_key")
    per = F.when(F.col("accuracy").isNotNull() & (F.col("usd") > 0), F.round(F.col("accuracy") / F.col("usd"), 4)).otherwise(F.lit(float("inf")))
    return joined.withColumn("acc_per_usd", per).withColumn("accuracy", F.round("accuracy", 4)).orderBy(F.desc_nulls_last("accuracy"), key)


def frontier(df: DataFrame, cost: str, gain: str) -> DataFrame:
    """Rows that no other beats in both: the best gain of all strictly cheaper or equally cheap rows is below theirs, or equal and no cheaper.

    Costs are first aggregated to their best gain and ordered over range partitions, so no task holds all rows.
    """
    from featherloom.session import materialize

    best = df.filter(F.col(cost).isNotNull() & F.col(gain).isNotNull()).groupBy(F.col(cost).alias("_cost")).agg(F.max(gain).alias("_gain"))
    parts = materialize(best.repartitionByRange("_cost").withColumn("_part", F.spark_partition_id()))
    of_part = parts.groupBy("_part").agg(F.max("_gain").alias("_max")).withColumn("_before", F.max("_max").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).select("_part", "_before")
    inside = F.max("_gain").over(Window.partitionBy("_part").orderBy("_cost").rowsBetween(Window.unboundedPreceding, -1))
    open_ = parts.withColumn("_inside", inside).join(F.broadcast(of_part), "_part").filter(F.col("_gain") > F.coalesce(F.greatest("_inside", "_before"), F.lit(float("-inf"))))
    return df.join(open_.select("_cost", "_gain"), (F.col(cost) == F.col("_cost")) & (F.col(gain) == F.col("_gain"))).drop("_cost", "_gain")


def rationale_kind(feature: Column) -> Column:
    """What a feature's name says of it; the first rule that fits holds."""
    # fixed values: the parts of names, and their order
    s = F.lower(feature)
    has = lambda *parts: s.rlike("|".join(parts))
    return (
        F.when(s.startswith("tfidf_"), "term weight")
        .when(has("ratio"), "ratio")
        .when(has("log"), "log scale")
        .when(has("times", "_x_", "_mul_"), "interaction")
        .when(has("diff"), "difference")
        .when(has("ner", "entity"), "entities")
        .when(has("question", "qword"), "question")
        .when(has("length", "n_tokens", "n_chars"), "length")
        .otherwise("other")
    )


def backend(model_id: Column, hosted_prefixes: list[str], hosted: str = "hosted", own: str = "own") -> Column:
    """Where a model runs, by the beginning of its id."""
    test = F.lit(False)
    for p in hosted_prefixes:
        test = test | model_id.startswith(p)
    return F.when(F.coalesce(test, F.lit(False)), hosted).otherwise(own)


def feature_block(df: DataFrame, row_id: str, descriptions: dict[str, str] | None = None, values: int = 8) -> DataFrame:
    """(place, feature, line): a line on each column: the first distinct values, in the order of row_id, of a categorical one, the least and greatest of a number.

    One aggregation over all categorical columns finds the first row of each value, of which the first few a column are kept; another gives the ends of all numbers.
    """
    columns = [c for c in df.columns if c != row_id]
    kinds = categorical_columns(df.select(*[F.col(f"`{c}`") for c in columns]))
    named = lambda c: f"{c} ({description(c, descriptions)})"
    parts = []
    if texts := [(k, c) for k, c in enumerate(columns) if kinds[c]]:
        each = F.explode(F.array(*[F.struct(F.lit(k).alias("place"), F.lit(c).alias("feature"), F.lit(named(c)).alias("name"), F.col(f"`{c}`").cast("string").alias("value")) for k, c in texts]))
        seen = df.select(F.col(f"`{row_id}`").alias("_row"), each.alias("x")).select("_row", "x.*").filter("value IS NOT NULL").groupBy("place", "feature", "name", "value").agg(F.min("_row").alias("first"))
        some = top_per_group(seen, "place", ["first", "value"], values).groupBy("place", "feature", "name").agg(F.sort_array(F.collect_list(F.struct("first", "value"))).alias("found"))  # a few values
        known = df.sparkSession.createDataFrame([(k, c, named(c)) for k, c in texts], "place int, feature string, name string")
        listed = F.concat_ws(" / ", F.transform(F.coalesce("found", F.array()), lambda x: x["value"]))
        parts.append(known.join(some.select("place", "found"), "place", "left").select("place", "feature", F.concat("name", F.lit(": one of "), listed).alias("line")))
    if numbers := [(k, c) for k, c in enumerate(columns) if not kinds[c]]:
        # neither NaN nor infinities are ends, and there is one zero
        number = lambda c: finite(F.col(f"`{c}`")) + F.lit(0.0) if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{c}`")
        ends = df.agg(*[x for k, c in numbers for x in (F.min(number(c)).alias(f"a{k}"), F.max(number(c)).alias(f"b{k}"))])
        shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
        rows = [F.struct(F.lit(k).alias("place"), F.lit(c).alias("feature"), F.concat(F.lit(f"{named(c)}: from "), shown(f"a{k}"), F.lit(" to "), shown(f"b{k}")).alias("line")) for k, c in numbers]
        parts.append(ends.select(F.explode(F.array(*rows)).alias("x")).select("x.*"))
    return reduce(DataFrame.unionByName, parts)


def telling_columns(df: DataFrame, without: list[str], most: int = 20) -> list[str]:
    """The columns shown of a wide table: all if ``most`` suffice, else those that aren't term weights, numbers of the greatest sample variance first and then the rest as they stand."""
    left = [c for c in df.columns if c not in without]
    if len(left) > most:
        left = [c for c in left if not c.startswith("tfidf_")]
    if len(left) <= most:
        return left
    kinds = {f.name: isinstance(f.dataType, T.NumericType) for f in df.schema}
    spread = df.agg(*[(F.var_samp(finite(F.col(f"`{c}`"))) if kinds[c] else F.lit(None).cast("double")).alias(f"v{k}") for k, c in enumerate(left)]).first()
    order = sorted(range(len(left)), key=lambda k: (not kinds[left[k]], -(spread[f"v{k}"] or 0.0), k))
    return [left[k] for k in order[:most]]


def example_rows(df: DataFrame, row_id: str, label: str, n: int = 4, most: int = 20, seed: int = 42) -> DataFrame:
    """(row_id, text): n rows in words, each as its values by name and the label they lead to. Missing values are left out."""
    columns = telling_columns(df, [row_id, label], most)
    value = lambda c: F.trim(F.col(f"`{c}`").cast("string"))
    said = F.concat_ws("; ", *[F.concat(F.lit(f"{c} = "), value(c)) for c in columns])
    return sample_rows(df, row_id, n, seed).select(F.col(f"`{row_id}`"), F.concat(said, F.lit(" -> "), F.coalesce(value(label), F.lit("unknown"))).alias("text"))


def quartiles(folds: DataFrame, by: str, value: str) -> DataFrame:
    """What a box plot shows: minimum, quartiles and maximum of each group of fold scores."""
    return folds.groupBy(by).agg(F.min(value).alias("low"), F.percentile(value, F.lit(0.25)).alias("q1"), F.percentile(value, F.lit(0.5)).alias("q2"), F.percentile(value, F.lit(0.75)).alias("q3"), F.max(value).alias("high"))


def _cells(rows: list, digits: int) -> list[list[str]]:
    return [[f"{v:.{digits}f}" if isinstance(v, float) else "" if v is None else str(v) for v in r] for r in rows]


def to_markdown(df: DataFrame, most: int = 10_000, digits: int = 4) -> str:
    """A report table as Markdown; more than ``most`` rows are an error, as reports are small."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join(c) + " |" for c in _cells(rows, digits))]) + "\n"


def to_latex(df: DataFrame, most: int = 10_000, digits: int = 4) -> str:
    """The same as a LaTeX tabular, cells as they are."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    end = " \\\\"
    return "\n".join([f"\\begin{{tabular}}{{{'l' * len(df.columns)}}}", "\\toprule", " & ".join(df.columns) + end, "\\midrule", *(" & ".join(c) + end for c in _cells(rows, digits)), "\\bottomrule", "\\end{tabular}"]) + "\n"


def run_index(entries: dict) -> str:
    return json.dumps(entries, indent=2, sort_keys=True)


def merged_scores(*scores: DataFrame) -> DataFrame:
    """(method, fold, value) of several tables under each other; a method's scores are those of the last table that has it, as a whole."""
    placed = reduce(DataFrame.unionByName, [df.select("method", "fold", "value", F.lit(k).alias("_table")) for k, df in enumerate(scores)])
    last = placed.groupBy("method").agg(F.max("_table").alias("_last"))
    return placed.join(F.broadcast(last), "method").filter("_table = _last").select("method", "fold", "value")  # methods are few


def call_stats(calls: DataFrame, by: list[str]) -> DataFrame:
    """Requests, failures, tokens and seconds of calls of a model, from rows (prompt_tokens, completion_tokens, latency_s, ok); missing numbers count as 0, and only calls that are ok as requests."""
    zero = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0)))
    both = F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0))
    done = F.coalesce("ok", F.lit(False))
    return calls.groupBy(*by).agg(zero("prompt_tokens").alias("prompt_tokens"), zero("completion_tokens").alias("completion_tokens"), F.sum(both).alias("total_tokens"), F.count_if(done).alias("requests"), F.count_if(~done).alias("failures"), zero("latency_s").alias("latency_s"))


def attribution(scores: DataFrame, k: int = 20) -> DataFrame:
    """(rank, feature, score, share, kind) of the k features of the highest importance, from (feature, score): what each adds to the whole, and what its name says of it. Ties by name; there is one row a feature."""
    total = scores.agg(F.sum("score").alias("_total"))
    best = scores.crossJoin(F.broadcast(total)).withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("score"), "feature"))).filter(F.col("rank") <= k)
    return best.select("rank", "feature", "score", F.try_divide("score", "_total").alias("share"), rationale_kind(F.col("feature")).alias("kind"))
