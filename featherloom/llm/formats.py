"""Records that differ only in formatting (problem 4)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featherloom.llm.texts import content, fields, ident
from featherloom.session import materialize

_OUT = pa.schema([("id", pa.int64()), ("key", pa.binary())])


def _encode(form_source: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, sources, groups = (batch.column(k).to_pylist() for k in range(4))
            # the raw values of all fields of the batch as one dictionary column
            raw: list[str] = []
            ends: list[int] = []
            for text, source in zip(texts, sources):
                if text:
                    raw.extend(fields(text) if source == form_source else (text,))
                ends.append(len(raw))
            column = pa.array(raw, pa.string()).dictionary_encode()
            values = []
            for value in column.dictionary.to_pylist():  # each distinct value is canonicalised once
                plain = content(value)
                values.append(ident(plain) if plain else None)
            codes = column.indices.to_numpy(zero_copy_only=False)
            kept, keys, begin = [], [], 0
            for k, end in enumerate(ends):
                of = sorted(v for c in codes[begin:end] if (v := values[c]) is not None)
                begin = end
                if of:
                    group = b"" if groups[k] is None else str(groups[k]).encode()
                    kept.append(ids[k])
                    keys.append((b"f" if sources[k] == form_source else b"t") + b"".join(of) + group)
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int64()), pa.array(keys, pa.binary())], schema=_OUT)

    return run


def encoded(df: DataFrame, id_col: str, text: str, source: str, within: str, form_source: str = "web_form") -> DataFrame:
    """(id, key): the record as the sorted tuple of the identifiers of its canonical field values, with the value of within.

    Raw values are dictionary-encoded by column batch, each distinct one is canonicalised once (lower case, letters and
    digits only), and gets a 128-bit integer that depends on its content alone: every task numbers alike
    without exchanging a dictionary, and two of 10^12 distinct values get the same number with odds of 10^-15. Rows of
    form_source have a value for each field, all others have one. Records without a letter or digit have no row.
    """
    columns = [F.col(f"`{id_col}`").cast("long"), F.col(f"`{text}`").cast("string"), F.col(f"`{source}`").cast("string"), F.col(f"`{within}`").cast("long")]
    return df.select(*(c.alias(f"c{k}") for k, c in enumerate(columns))).mapInArrow(_encode(form_source), "id long, key binary")


def _groups(records: DataFrame) -> DataFrame:
    return records.groupBy("key").agg(F.min("id").alias("first_id"), F.count("*").alias("copies"))


def collapse(df: DataFrame, id_col: str, text: str, source: str, within: str, form_source: str = "web_form") -> DataFrame:
    """(first_id, copies): one row per distinct record, with its smallest id and the number of its rows.

    Partial aggregation makes a group that holds a third of all rows one row a task. Records whose text is null,
    empty or without letters and digits are left out; null values of within are equal to each other.
    """
    return _groups(encoded(df, id_col, text, source, within, form_source)).select("first_id", "copies")


def copies(df: DataFrame, id_col: str, text: str, source: str, within: str, form_source: str = "web_form", hot_groups: int = 10_000) -> DataFrame:
    """(first_id, id): every row that is a copy, with the smallest id of its group; that row itself isn't given.

    Groups of at least a hot_groups-th of all records number at most hot_groups, whatever the data: they are broadcast, so
    that no task gets a hot group. The other groups are joined by key. Rows that repeat the smallest id are no copies of it.
    """
    records = materialize(encoded(df, id_col, text, source, within, form_source))
    hot = max(2, records.count() // hot_groups, 1000)
    groups = _groups(records).filter("copies > 1")
    large = F.broadcast(groups.filter(F.col("copies") >= hot).select("key", "first_id"))
    small = groups.filter(F.col("copies") < hot).select("key", "first_id")
    of_large = records.join(large, "key")
    of_small = records.join(large.select("key"), "key", "left_anti").join(small.hint("shuffle_hash"), "key")
    return of_large.unionByName(of_small).filter("id <> first_id").select("first_id", "id")
