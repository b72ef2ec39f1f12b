"""Term frequencies over a collection (problem 1) and how distinctive a term is of a record (problem 6)."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featherloom.llm.texts import TERM
from featherloom.session import materialize

_COUNTS = pa.schema([("term", pa.string()), ("occurrences", pa.int64()), ("records", pa.int64())])


def _counters(flush_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = TERM.findall
        seen: dict[str, list[int]] = {}
        record = 0

        def out(terms: dict[str, list[int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(terms.keys(), pa.string()), pa.array([c[0] for c in terms.values()], pa.int64()), pa.array([c[1] for c in terms.values()], pa.int64())], schema=_COUNTS)

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text is None:
                    continue
                record += 1
                for term in find(text.lower()):
                    counter = seen.get(term)
                    if counter is None:
                        seen[term] = [1, 1, record]
                    else:
                        counter[0] += 1
                        if counter[2] != record:
                            counter[1] += 1
                            counter[2] = record
            if len(seen) >= flush_at:  # between records only, so that no record is counted twice
                yield out(seen)
                seen = {}
        yield out(seen)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([0], pa.int64()), pa.array([record], pa.int64())], schema=_COUNTS)

    return run


def term_counts(df: DataFrame, text: str, flush_at: int = 200_000) -> DataFrame:
    """(term, occurrences, records) of every distinct term, and a row of null term whose records are the texts counted.

    Each task reads its records one after the other and keeps, for every term, its occurrences, its records and
    the last record it was seen in: a record is counted once without a set of the terms of each record. A record
    lies in one task, so the counters of the tasks add up; they are the pre-aggregation of a shuffle by term, in which
    a term found in every record is one row a task. ``flush_at`` bounds the terms a task holds, not the result.

    Null texts aren't counted; empty ones are, without terms. Repeated rows count each. An empty table gives one
    row, of null term and 0 records.
    """
    parts = df.select(F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(_counters(flush_at), "term string, occurrences long, records long")
    counted = parts.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    return materialize(counted)


def marked_terms(df: DataFrame, text: str, min_records: int = 3, common_of: int = 10) -> DataFrame:
    """term_counts with ``mark``: rare in fewer than min_records records, common in more than 1 / common_of of them, otherwise null."""
    counts = term_counts(df, text)
    n = counts.filter("term IS NULL").agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]
    mark = F.when(F.col("records") < min_records, "rare").when(F.col("records") * common_of > n, "common")
    return counts.filter("term IS NOT NULL").withColumn("mark", mark)


_PAIRS = pa.schema([("id", pa.int64()), ("record", pa.int64()), ("term", pa.string()), ("in_record", pa.int64()), ("record_terms", pa.int64()), ("record_tokens", pa.int64()), ("occurrences", pa.int64()), ("records", pa.int64())])


def _score_batches(frequent, n: int, best: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, known = TERM.findall, frequent.value
        weigh = {t: math.log((1 + n) / (1 + c[1])) for t, c in known.items()} if best else {}
        record = TaskContext.get().partitionId() << 40
        for batch in batches:
            out: list[list] = [[] for _ in _PAIRS]
            ids, records, terms, in_record, distinct, tokens, occurrences, holders = out
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                record += 1
                if not text:
                    continue
                counted = Counter(find(text.lower()))
                if not counted:
                    continue
                size, total = len(counted), counted.total()
                kept = counted.items()
                if best and size > best:
                    tail = [x for x in kept if x[0] not in weigh]
                    kept = sorted((x for x in kept if x[0] in weigh), key=lambda x: (-x[1] * weigh[x[0]], x[0]))[:best] + tail
                for term, times in kept:
                    both = known.get(term)
                    ids.append(row)
                    records.append(record)
                    terms.append(term)
                    in_record.append(times)
                    distinct.append(size)
                    tokens.append(total)
                    occurrences.append(both and both[0])
                    holders.append(both and both[1])
                if len(ids) > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, _PAIRS)], schema=_PAIRS)
                    for x in out:
                        x.clear()
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, _PAIRS)], schema=_PAIRS)

    return run


def term_scores(df: DataFrame, id_col: str, text: str, prior: float = 100.0, best: int | None = None, table_terms: int = 50_000) -> DataFrame:
    """Scores every term of every record by its log-odds ratio in the record against the rest of the collection.

    Gives (id, record, term, in_record, record_terms, record_tokens, occurrences, records, n, z): the term's occurrences
    in the record, the record's distinct terms and tokens, the term's occurrences and records in the collection, the
    records of the collection, and the z-score: the log-odds ratio with an informative Dirichlet prior, whose ``prior``
    pseudo-occurrences are shared out as the collection's counts, divided by its standard error.

    The collection's counts are those of term_counts. Terms in at least P / table_terms records (P: all pairs of a
    record and a term) number at most table_terms, whatever the data; their counts go to every task and most pairs are
    scored where their text is read. Only the pairs of rarer terms are joined with the table of counts, by
    term, and none of those terms is in more than P / table_terms records, so no key of that join is hot.

    best keeps, of each record, the best terms by in_record x ln((1 + n) / (1 + records)) among those frequent terms,
    and all of its rarer terms: enough to know the leading ``best`` terms of each record.

    Null and empty texts have no rows. Rows of the same id are records of their own, told apart by ``record``.
    """
    counts = term_counts(df, text)
    n, pairs, tokens = counts.agg(
        F.coalesce(F.sum(F.when(F.col("term").isNull(), F.col("records"))), F.lit(0)),
        F.coalesce(F.sum(F.when(F.col("term").isNotNull(), F.col("records"))), F.lit(0)),
        F.coalesce(F.sum("occurrences"), F.lit(0)),
    ).first()
    counts = counts.filter("term IS NOT NULL")
    least = max(1, -(-pairs // table_terms))
    spark = df.sparkSession
    # at most table_terms rows: the records of all terms sum to pairs
    frequent = spark.sparkContext.broadcast({t: (o, r) for t, o, r in counts.filter(F.col("records") >= least).collect()})
    schema = "id long, record long, term string, in_record long, record_terms long, record_tokens long, occurrences long, records long"
    scored = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(_score_batches(frequent, n, best), schema)
    # a batch with every term in the table must not be read again for the join: both halves come from one written table
    if least > 1:
        scored = materialize(scored)
        rarer = scored.filter("records IS NULL").drop("occurrences", "records").join(counts.filter(F.col("records") < least).hint("shuffle_hash"), "term")
        scored = scored.filter("records IS NOT NULL").unionByName(rarer)
    y, c, size = F.col("in_record"), F.col("occurrences"), F.col("record_tokens")
    alpha = F.lit(float(prior)) * c / F.lit(max(tokens, 1))
    own, rest = y + alpha, c - y + alpha
    total = float(prior)
    z = (F.log(own / (size + total - own)) - F.log(rest / F.greatest(F.lit(tokens) - size + total - rest, F.lit(1e-12)))) / F.sqrt(1 / own + 1 / rest)
    return scored.withColumn("n", F.lit(n).cast("long")).withColumn("z", z)


def leading_terms(scores: DataFrame, lead: float = 2.0) -> DataFrame:
    """(id, term): of each record of term_scores with two or more distinct terms, the term whose weight in_record x ln((1 + n) / (1 + records)) is the highest and at least lead times the second highest. Two highest terms of equal weight give none."""
    weight = F.col("in_record") * F.log((1 + F.col("n")) / (1 + F.col("records")))
    top = (
        scores.filter("record_terms >= 2")
        .withColumn("weight", weight)
        .groupBy("id", "record")
        # at most the kept terms of one record
        .agg(F.max_by("term", "weight").alias("term"), F.sort_array(F.collect_list("weight"), asc=False).alias("weights"))
    )
    first, second = F.col("weights")[0], F.col("weights")[1]
    return top.filter((first >= lead * second) & (first > second)).select("id", "term")
