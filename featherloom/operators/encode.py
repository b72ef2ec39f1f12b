"""Type inference, categorical codes, numeric cleaning and scaling."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featherloom.functions.numeric import cleaned, finite
from featherloom.operators.order import grouped_quantiles, long_values, ordinal_codes

#: A table of codes of up to this many values is broadcast; a larger one is joined by value.
BROADCAST_VALUES = 100_000


def categorical_columns(df: DataFrame) -> dict[str, bool]:
    """Whether each column is categorical: texts are, numbers only if they hold nothing but 0, 1 and null. One pass over all numbers."""
    numeric = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    other = {}
    if numeric:
        row = df.agg(*[F.count_if(F.col(f"`{c}`").isNotNull() & ~F.col(f"`{c}`").isin(0, 1)).alias(str(k)) for k, c in enumerate(numeric)]).first()
        other = {c: row[str(k)] for k, c in enumerate(numeric)}
    return {f.name: (not other[f.name] if f.name in other else True) for f in df.schema}


@dataclass(frozen=True)
class CodeModel:
    """Codes of the values of each column, as fitted."""

    tables: dict[str, DataFrame]
    small: dict[str, bool] = field(default_factory=dict)

    def _is_small(self, column: str) -> bool:
        """Whether a column has so few values that their codes are broadcast; counted once, up to that bound."""
        if column not in self.small:
            self.small[column] = self.tables[column].limit(BROADCAST_VALUES + 1).count() <= BROADCAST_VALUES
        return self.small[column]

    def transform(self, df: DataFrame) -> DataFrame:
        """Each column as double codes; unseen values and null are -1."""
        for k, (column, table) in enumerate(self.tables.items()):
            codes = table.select(F.col("value").alias(f"_value{k}"), F.col("code").alias(f"_code{k}"))
            df = df.join(F.broadcast(codes) if self._is_small(column) else codes, F.col(f"`{column}`") == F.col(f"_value{k}"), "left")
            df = df.withColumn(column, F.coalesce(F.col(f"_code{k}"), F.lit(-1)).cast("double")).drop(f"_value{k}", f"_code{k}")
        return df


def fit_codes(train: DataFrame, columns: list[str] | None = None) -> CodeModel:
    """Codes 0, 1, ... in the order of the values, from the training rows alone."""
    columns = columns if columns is not None else [f.name for f in train.schema if isinstance(f.dataType, T.StringType)]
    return CodeModel({c: ordinal_codes(train, c) for c in columns})


def encode_categoricals(train: DataFrame, *others: DataFrame) -> list[DataFrame]:
    """train and others with text columns as codes fitted on train and numbers as finite doubles, null instead of NaN and infinities."""
    model = fit_codes(train)
    return [model.transform(df.withColumns({f.name: finite(F.col(f"`{f.name}`")) for f in df.schema if isinstance(f.dataType, T.NumericType)})) for df in (train, *others)]


def safe_numeric(df: DataFrame, row_id: str) -> DataFrame:
    """All columns but row_id as doubles: texts as codes in the order of first appearance (null -1), NaN, infinities and null as 0."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name != row_id]
    model = CodeModel({c: ordinal_codes(df, c, row_id) for c in texts})
    out = model.transform(df)
    return out.withColumns({f.name: cleaned(F.col(f"`{f.name}`")) for f in df.schema if f.name != row_id and f.name not in texts})


def label_codes(df: DataFrame, label: str) -> DataFrame:
    """df with label_code: the place of a text label among the sorted ones; numeric labels stay as they are."""
    if not isinstance(df.schema[label].dataType, T.StringType):
        return df.withColumn("label_code", F.col(f"`{label}`"))
    codes = ordinal_codes(df, label)
    return df.join(codes.select(F.col("value").alias("_value"), F.col("code").alias("label_code")), F.col(f"`{label}`") == F.col("_value"), "left").drop("_value")


@dataclass(frozen=True)
class Scaler:
    """(x - center) / width of each column; a width of 0 counts as 1."""

    values: dict[str, tuple[float | None, float | None]]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (finite(F.col(f"`{c}`")) - F.lit(center)) / F.lit(width or 1.0) for c, (center, width) in self.values.items()})


def fit_scaler(train: DataFrame, columns: list[str], kind: str = "standard") -> Scaler:
    """standard: mean and population deviation; minmax: minimum and range; robust: median and the range of the middle half, from counts ordered over range partitions."""
    if kind == "robust":
        long = long_values(train, {c: finite(F.col(f"`{c}`")) for c in columns})
        found = {r["key"]: (r["q2"], r["q3"] - r["q1"]) for r in grouped_quantiles(long, F.col("key"), F.col("value"), {"q1": 0.25, "q2": 0.5, "q3": 0.75}).collect()}  # a row a column
        return Scaler({c: found.get(c, (None, None)) for c in columns})
    aggregates = []
    for k, c in enumerate(columns):
        x = finite(F.col(f"`{c}`"))
        pair = {"standard": (F.avg(x), F.stddev_pop(x)), "minmax": (F.min(x), F.max(x) - F.min(x))}[kind]
        aggregates += [pair[0].alias(f"a{k}"), pair[1].alias(f"b{k}")]
    row = train.agg(*aggregates).first()
    return Scaler({c: (row[f"a{k}"], row[f"b{k}"]) for k, c in enumerate(columns)})


def aligned_columns(train: DataFrame, test: DataFrame) -> list[str]:
    """The columns of both, in the order of train."""
    return [c for c in train.columns if c in set(test.columns)]

