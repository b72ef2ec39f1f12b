"""TF-IDF over uni- and bigrams with a vocabulary of the most frequent terms."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Up to so many terms a row is weighed where it is read; more are joined.
LOCAL_TERMS = 200


def grams(df: DataFrame, text: str, stop_words: list[str], *kept: str) -> DataFrame:
    """(kept columns, terms): the lower-cased tokens of two or more letters, digits or underscores that aren't stop words, and the pairs of neighbours among those left.

    The tokens are a column of their own, so that they are found once.
    """
    keep = [F.col(f"`{c}`") for c in kept]
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))), F.lit(r"[\p{L}\p{N}_]{2,}"), 0)
    found = df.select(*keep, (F.filter(words, lambda x: ~x.isin(*stop_words)) if stop_words else words).alias("_words"))
    count = F.size("_words")
    pairs = F.zip_with(F.slice("_words", 1, F.greatest(count - 1, F.lit(0))), F.slice("_words", 2, F.greatest(count - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return found.select(*keep, F.concat("_words", pairs).alias("terms"))


@dataclass(frozen=True)
class TfidfModel:
    """``terms``: (term, occurrences, records) of the kept terms, at most max_features; ``n``: the rows it was fitted on."""

    terms: list[tuple[str, int, int]]
    n: int
    stop_words: tuple[str, ...]

    def vocabulary(self, spark) -> DataFrame:
        return spark.createDataFrame(self.terms, "term string, occurrences long, records long")

    def idf(self) -> dict[str, float]:
        return {t: math.log((1 + self.n) / (1 + r)) + 1 for t, _, r in self.terms}

    def weights(self, df: DataFrame, id_col: str, text: str) -> DataFrame:
        """(id, term, weight): tf x (ln((1 + n) / (1 + records)) + 1), of length 1 per row. Rows without a kept term have none.

        A row is weighed by itself, without a shuffle; of a vocabulary beyond LOCAL_TERMS the kept terms are counted by row and term, and a row's terms, one struct each,
        gathered once. Rows with the same id are rows of their own in the first case and one in the second.
        """
        idf = self.idf()
        if not idf:
            return df.select(F.col(f"`{id_col}`").alias("id"), F.lit("").alias("term"), F.lit(0.0).alias("weight")).limit(0)
        if len(idf) <= LOCAL_TERMS:
            found = grams(df, text, list(self.stop_words), id_col).select(F.col(f"`{id_col}`").alias("id"), F.sort_array(F.filter("terms", lambda x: x.isin(*idf))).alias("_kept"))
            # sorted, a term's occurrences lie side by side: each first one knows how many there are up to the next
            firsts = found.select("id", "_kept", F.filter(F.sequence(F.lit(0), F.size("_kept")), lambda i: (i == F.size("_kept")) | (i == 0) | (F.get("_kept", i) != F.get("_kept", i - 1))).alias("_at"))
            table = F.create_map(*[F.lit(x) for pair in idf.items() for x in pair])
            spans = F.zip_with(F.slice("_at", 1, F.size("_at") - 1), F.slice("_at", 2, F.size("_at")), lambda i, j: F.struct(F.get("_kept", i).alias("term"), ((j - i) * F.element_at(table, F.get("_kept", i))).alias("raw")))
            rows = firsts.select("id", F.when(F.size("_kept") > 0, spans).alias("terms"))
        else:
            listed = F.broadcast(df.sparkSession.createDataFrame(list(idf.items()), "term string, idf double"))
            terms = grams(df, text, list(self.stop_words), id_col).select(F.col(f"`{id_col}`").alias("id"), F.explode("terms").alias("term"))
            counted = terms.join(listed, "term").groupBy("id", "term").agg((F.count("*") * F.max("idf")).alias("raw"))
            rows = counted.groupBy("id").agg(F.collect_list(F.struct("term", "raw")).alias("terms"))  # at most one struct a kept term
        norm = F.sqrt(F.aggregate("terms", F.lit(0.0), lambda s, x: s + x["raw"] * x["raw"]))
        # outer, as explode alone adds a filter on the array that is pushed down and makes it a second time
        return rows.select("id", norm.alias("norm"), F.explode_outer("terms").alias("t")).filter("t IS NOT NULL").select("id", F.col("t.term").alias("term"), (F.col("t.raw") / F.col("norm")).alias("weight"))

    def wide(self, df: DataFrame, id_col: str, text: str) -> DataFrame:
        """(id, tfidf_<term> ...): a column for each kept term in alphabetical order, 0 where the row lacks it; every row of df is kept."""
        names = sorted(t for t, _, _ in self.terms)
        weights = self.weights(df, id_col, text)
        pivoted = weights.groupBy("id").agg(*[F.sum(F.when(F.col("term") == t, F.col("weight"))).alias(f"tfidf_{t}") for t in names]) if names else weights.select("id").distinct()
        every = df.select(F.col(f"`{id_col}`").alias("id")).distinct()
        return every.join(pivoted, "id", "left").select("id", *[F.coalesce(F.col(f"`tfidf_{t}`"), F.lit(0.0)).alias(f"tfidf_{t}") for t in names])


def fit_tfidf(df: DataFrame, id_col: str, text: str, max_features: int = 50, stop_words: list[str] | None = None) -> TfidfModel:
    """The max_features terms of most occurrences in df, ties in alphabetical order. Fit on the training rows alone to keep held-out rows out.

    One pass: the terms of a row are sorted, so that each knows whether it is the row's first of its kind, and counted with partial sums a task.
    """
    stop = list(stop_words or [])
    ordered = grams(df, text, stop).select(F.sort_array("terms").alias("terms"))
    marked = F.transform("terms", lambda x, i: F.struct(x.alias("term"), ((i == 0) | (x != F.get("terms", i - 1))).cast("int").alias("first")))
    # a row of no term counts the rows
    each = ordered.select(F.explode_outer(F.concat(marked, F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(1).alias("first"))))).alias("t")).select("t.*")
    counts = each.groupBy("term").agg(F.count("*").alias("occurrences"), F.sum("first").alias("records"))
    best = counts.orderBy(F.col("term").isNotNull(), F.desc("occurrences"), "term").limit(max_features + 1).collect()
    n = next((r.occurrences for r in best if r.term is None), 0)
    return TfidfModel([tuple(r) for r in best if r.term is not None], n, tuple(stop))
