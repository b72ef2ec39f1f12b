"""Reading and writing data sets, logs and results."""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass, field
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from featherloom.operators.order import running_total
from featherloom.session import materialize

#: Data sets by these names are regressions; all others are classifications.
REGRESSIONS = frozenset({"bike", "crab", "forest-fires", "housing", "insurance", "wine"})

#: The fields of the log and of the curve.
LOG_SCHEMA = "step BIGINT, island BIGINT, score DOUBLE, ok BOOLEAN, eval_s DOUBLE, __summary__ BOOLEAN, backbone STRING, model_id STRING, family STRING, dataset STRING, elapsed_s DOUBLE, best_score DOUBLE, llm_stats STRUCT<prompt_tokens: BIGINT, completion_tokens: BIGINT, total_tokens: BIGINT, requests: BIGINT, failures: BIGINT, latency_s: DOUBLE>"
CURVE_SCHEMA = "i BIGINT, score DOUBLE, best DOUBLE, ok BIGINT, fail BIGINT, t_sample DOUBLE, t_eval DOUBLE"


@dataclass(frozen=True)
class Dataset:
    """A lazy frame with features, a label, a row id, and folds as a column if there are any."""

    name: str
    df: DataFrame
    features: list[str]
    label: str
    row_id: str
    task: str
    meta: dict = field(default_factory=dict)


def sidecar(path: str) -> dict:
    """A JSON file of descriptions; missing or malformed it is empty."""
    try:
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
        return found if isinstance(found, dict) else {}
    except (OSError, ValueError):
        return {}


def read_csv(spark: SparkSession, path: str, name: str, meta_path: str | None = None) -> Dataset:
    """A CSV file with a header and inferred types; its last column is the target. row_id is the place of a row among those of all files, by path: however the scan is split, it is the same."""
    df = spark.read.csv(path, header=True, inferSchema=True)
    *features, label = df.columns
    read = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")).withColumn("_scan", F.monotonically_increasing_id())
    placed = running_total(read, ["_file", "_block", "_scan"], name="row_id")
    return Dataset(name, placed.select(*[F.col(f"`{c}`") for c in df.columns], "row_id"), features, label, "row_id", "regression" if name in REGRESSIONS else "classification", sidecar(meta_path) if meta_path else {})


def read_parquet(spark: SparkSession, path: str, meta: dict, name: str, row_id: str = "row_id") -> Dataset:
    """A Parquet table of which the metadata names features and label; other columns aren't read."""
    features, label = list(meta["feature_columns"]), meta.get("label_column") or meta["target_column"]
    df = spark.read.parquet(path)
    kept = [row_id, *features, label, *(["fold"] if "fold" in df.columns else [])]
    return Dataset(name, df.select(*[F.col(f"`{c}`") for c in kept]), features, label, row_id, "regression" if name in REGRESSIONS else "classification", meta)


def union_splits(splits: dict[str, DataFrame], names: list[str], label: str = "label", text: str = "text") -> DataFrame:
    """The splits of a labelled text collection under each other, with source_split, query, intent_id and intent_name."""
    parts = None
    for split, df in splits.items():
        one = df.withColumnsRenamed({label: "intent_id", text: "query"}).withColumn("source_split", F.lit(split))
        parts = one if parts is None else parts.unionByName(one)
    return parts.withColumn("intent_name", F.when(F.col("intent_id") >= 0, F.get(F.lit(names), F.col("intent_id").cast("int"))))


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_sidecar(meta: dict, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(meta, f, indent=2)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str, schema: str = LOG_SCHEMA) -> DataFrame:
    """JSON lines; blank and malformed ones are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_runs(spark: SparkSession, pattern: str, dataset: str | None = None) -> DataFrame:
    """The summaries of run folders: those of a data set with a program.

    Spark's JSON source takes a task to list each folder and one for every few files, and reads all twice, as it infers fields. Here files are packed into few tasks and their texts kept; fields are inferred from those.
    """
    pairs = spark.sparkContext.wholeTextFiles(pattern, 4 * spark.sparkContext.defaultParallelism)
    texts = materialize(spark.createDataFrame(pairs, "path string, value string", verifySchema=False).withColumn("value", F.ltrim("value", F.lit("\ufeff"))))
    found = spark.read.json(texts.select("value").rdd.map(lambda r: r.value)).schema
    kind = ArrayType(StructType([f for f in found if f.name != "_corrupt_record"]))  # a file holds one summary or an array of them
    df = texts.select(F.element_at(F.split("path", "/"), -2).alias("folder"), F.explode(F.from_json("value", kind)).alias("r")).select("r.*", "folder")
    df = df.filter(F.length(F.trim(F.coalesce("best_program", F.lit("")))) > 0)
    return (df.filter(F.col("dataset") == dataset) if dataset else df).orderBy("folder")


def write_runs(df: DataFrame, run_id: str, path: str) -> None:
    """A folder a run with its summary, a file a row. On a mounted file system tasks write with plain Python: Hadoop without its native library starts several processes a file for the permissions."""
    if not path.startswith("file:"):
        df.withColumn("run", F.col(f"`{run_id}`")).write.partitionBy("run").json(path)
        return
    root = "/" + path.removeprefix("file:").lstrip("/")

    def write(place: int, rows):
        for n, (run, text) in enumerate(rows):
            folder = f"{root}/run={quote(run, safe=' ') if run else '__HIVE_DEFAULT_PARTITION__'}"
            os.makedirs(folder, exist_ok=True)
            whole, part = f"{folder}/part-{place:05d}-{n}.json", f"{folder}/.{uuid.uuid4().hex}"
            with open(part, "w", encoding="utf-8") as f:
                f.write(text)
            os.replace(part, whole)  # an attempt that was cut off leaves no half a file
        return ()

    df.select(F.col(f"`{run_id}`").cast("string"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))).rdd.mapPartitionsWithIndex(write).count()


def folds_from_results(spark: SparkSession, path: str) -> DataFrame:
    """(method, model, metric, fold, value) from a JSON of method -> {per_fold: {model: [{metric: value}]}}."""
    kind = "MAP<STRING, STRUCT<per_fold: MAP<STRING, ARRAY<MAP<STRING, DOUBLE>>>>>"
    df = spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("m")).select(F.explode("m").alias("method", "r"))
    folds = df.select("method", F.explode("r.per_fold").alias("model", "folds")).select("method", "model", F.posexplode("folds").alias("fold", "metrics"))
    return folds.select("method", "model", "fold", F.explode("metrics").alias("metric", "value"))


def append_summary(spark: SparkSession, summary: dict, path: str) -> None:
    """A last line of a log that marks its end."""
    spark.createDataFrame([(json.dumps({"__summary__": True} | summary),)], "value string").write.mode("append").text(path)


def write_results(folds: DataFrame, path: str) -> None:
    """The JSON that folds_from_results reads, from (method, model, fold, metric, value): one text, as methods, models and folds are few."""
    by_fold = folds.groupBy("method", "model", "fold").agg(F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("metrics"))
    by_model = by_fold.groupBy("method", "model").agg(F.transform(F.sort_array(F.collect_list(F.struct("fold", F.to_json("metrics").alias("m")))), lambda x: F.from_json(x["m"], "map<string,double>")).alias("folds"))
    by_method = by_model.groupBy("method").agg(F.struct(F.map_from_entries(F.collect_list(F.struct("model", "folds"))).alias("per_fold")).alias("r"))
    by_method.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("method", "r")))).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_candidates(candidates: DataFrame, path: str) -> None:
    """(sample_order, function, score) as a JSON line each."""
    candidates.select("sample_order", "function", "score").write.mode("append").json(path)


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    return read_log(spark, path, "sample_order BIGINT, function STRING, score DOUBLE")


def write_split_indexes(folds: DataFrame, row_id: str, path: str) -> None:
    """The held-out rows of each fold, as a table (fold, row) partitioned by fold; the training rows of a fold are all others."""
    folds.select("fold", F.col(f"`{row_id}`").alias("row")).write.mode("overwrite").partitionBy("fold").parquet(path)


def read_split_indexes(spark: SparkSession, path: str) -> DataFrame:
    """(row, fold) of a table of split indexes, or of a file of arrays named fold_<k>_test (.npz), which is read on the driver."""
    if not path.endswith(".npz"):
        return spark.read.parquet(path).select("row", F.col("fold").cast("int").alias("fold"))
    import numpy as np
    import pandas as pd

    with np.load(path) as arrays:
        parts = [pd.DataFrame({"row": arrays[n].astype(np.int64), "fold": np.int32(n.split("_")[1])}) for n in arrays.files if n.startswith("fold_") and n.endswith("_test")]
    return spark.createDataFrame(pd.concat(parts) if parts else pd.DataFrame({"row": pd.Series(dtype="int64"), "fold": pd.Series(dtype="int32")}), "row long, fold int")


def with_split_indexes(df: DataFrame, row_id: str, indexes: DataFrame) -> DataFrame:
    """df with the fold of each row; null of rows that no index names."""
    return df.join(indexes.withColumnRenamed("row", "_row"), F.col(f"`{row_id}`") == F.col("_row"), "left").drop("_row")


def read_config(path: str) -> dict:
    """The settings of a run from a YAML file, or from JSON where no YAML reader is installed. Something else than names and values is a ValueError."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        import yaml
    except ImportError:
        found = json.loads(text or "{}")
    else:
        found = yaml.safe_load(text)
    if not isinstance(found or {}, dict):
        raise ValueError(f"{path} doesn't hold names and values")
    return found or {}
