"""Work that may take so long and no longer."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as TimedOut
from typing import TypeVar

from pyspark.sql import SparkSession

X = TypeVar("X")


def within_budget(spark: SparkSession, seconds: float, work: Callable[[], X]) -> tuple[X | None, str | None]:
    """(result, null), or (null, reason) if work raises or isn't done in time; its jobs are then cancelled by their tag, and nothing else of the session."""
    tag = f"budget-{uuid.uuid4().hex}"

    def tagged() -> X:
        spark.addTag(tag)
        try:
            return work()
        finally:
            spark.removeTag(tag)

    pool = ThreadPoolExecutor(1)
    found = pool.submit(tagged)
    try:
        return found.result(timeout=seconds), None
    except TimedOut:
        spark.interruptTag(tag)
        return None, f"not done within {seconds:g} s"
    except Exception as e:
        return None, f"{type(e).__name__}: {str(e)[:200]}"
    finally:
        pool.shutdown(wait=False, cancel_futures=True)
