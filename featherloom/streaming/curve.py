"""The log of a search as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def log_stream(spark: SparkSession, path: str, schema: str, form: str = "parquet") -> DataFrame:
    return spark.readStream.format(form).schema(schema).load(path)


def once(events: DataFrame, ids: list[str], at: str, late: str = "1 day") -> DataFrame:
    """Events without those delivered again within the watermark of the column ``at``."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(ids)


def windowed(events: DataFrame, at: str, by: list[str], size: str = "1 hour", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Candidates, successes and the best score per window and group; windows close when the watermark has passed them."""
    window = F.window(at, size, slide) if slide else F.window(at, size)
    return events.withWatermark(at, late).groupBy(window.alias("w"), *by).agg(F.count("*").alias("n"), F.count_if("ok").alias("n_ok"), F.max("score").alias("best")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "n_ok", "best")


def running_best(events: DataFrame, run: str = "run_id") -> DataFrame:
    """(run, n, best) so far, updated as candidates of a run arrive; the state of a run is two numbers."""
    import pandas as pd

    def update(key, batches, state):
        n, best = state.get if state.exists else (0, None)
        for batch in batches:
            n += len(batch)
            scores = batch["score"].dropna()
            if len(scores):
                best = float(scores.max()) if best is None or best != best else max(best, float(scores.max()))
        state.update((n, best if best is not None else float("nan")))
        yield pd.DataFrame({run: [key[0]], "n": [n], "best": [best]})

    return events.groupBy(run).applyInPandasWithState(update, f"{run} long, n long, best double", "n long, best double", "update", "NoTimeout")
