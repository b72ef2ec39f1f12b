"""The queries on the problem tables, and SQL for those that SQL can express."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featherloom.llm import formats, garbled, leaks, overlap, programs, sampling, terms, tokens
from featherloom.session import table

#: The folder of the public vocabularies.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")


def p1_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.marked_terms(table(spark, sf_dir, "features"), "query").select("term", "occurrences", "records", "mark")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_terms(spark, sf_dir).filter("mark IS NOT NULL").select("term", "mark")


def _overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.split_overlaps(table(spark, sf_dir, "features"), "row_id", "query", "source_split", "source", short=True)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _overlaps(spark, sf_dir)
    return found.select(F.least("train_id", "held_id").alias("row_id_a"), F.greatest("train_id", "held_id").alias("row_id_b"))


def p2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs, and held-out rows in them, per held-out split and source."""
    held = table(spark, sf_dir, "features").select(F.col("row_id").alias("held_id"), F.lower(F.trim("source_split")).alias("split"), "source")
    per_row = _overlaps(spark, sf_dir).groupBy("held_id").agg(F.count("*").alias("pairs"))
    return per_row.join(held, "held_id").groupBy("split", "source").agg(F.sum("pairs").alias("pairs"), F.count("*").alias("held_rows"))


def p2_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per held-out row its words, those in spans of eight or more that the training split has too, and the longest span."""
    found = overlap.split_coverage(table(spark, sf_dir, "features"), "row_id", "query", "source_split", "source")
    return found.withColumnRenamed("id", "row_id")


def _sample(spark: SparkSession, sf_dir: str) -> sampling.Sample:
    return sampling.sample_by_targets(table(spark, sf_dir, "features"), table(spark, sf_dir, "intent_targets"), "row_id", "intent_id", "intent_name", "target_bp", "min_rows")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sample(spark, sf_dir).report.filter("short").select(F.col("category").cast("int").alias("intent_id"))


def p3_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sample(spark, sf_dir).rows.select(F.col("id").alias("row_id"), F.col("category").cast("int").alias("intent_id"))


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = _sample(spark, sf_dir).report.withColumn("intent_id", F.col("category").cast("int"))
    return report.select("intent_id", "available", "wanted", "least", "quota", "short", F.round("missing", 6).alias("missing"), F.round("extra", 6).alias("extra"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.copies(table(spark, sf_dir, "features"), "row_id", "query", "source", "intent_id").select(F.col("first_id").alias("first_row_id"), F.col("id").alias("row_id"))


def p4_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.collapse(table(spark, sf_dir, "features"), "row_id", "query", "source", "intent_id").select(F.col("first_id").alias("row_id"), "copies")


def _programs(spark: SparkSession, sf_dir: str) -> programs.NearPrograms:
    rows = table(spark, sf_dir, "sample").selectExpr("program_id", "function AS text").unionByName(table(spark, sf_dir, "best").selectExpr("program_id", "best_program AS text"))
    return programs.NearPrograms(rows, "program_id", "text")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _programs(spark, sf_dir).row_pairs().select(F.col("a").alias("program_id_a"), F.col("b").alias("program_id_b"))


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _programs(spark, sf_dir).groups().select(F.col("id").alias("program_id"), F.col("group").alias("group_id"), "links")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = terms.term_scores(table(spark, sf_dir, "features"), "row_id", "query", best=2)
    return terms.leading_terms(scores).select(F.col("id").alias("row_id"), "term")


def p6_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = terms.term_scores(table(spark, sf_dir, "features"), "row_id", "query")
    return scores.select(F.col("id").alias("row_id"), "term", F.round("z", 6).alias("score"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = tokens.encode_texts(table(spark, sf_dir, "documents"), "doc_id", "text", f"{TOKENIZERS}/byte_bpe_50k.tiktoken")
    return ids.select(F.col("id").alias("doc_id"), "ids")


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked_items(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))


def p8_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of an item a document holds; ``most`` marks half of its words or more, in whatever order its passages stand."""
    found = _leaks(spark, sf_dir)
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "longest", "covered", "item_words", "tiles", (F.col("covered") * 2 >= F.col("item_words")).alias("most"))


def _garbled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled.garbled(table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _garbled(spark, sf_dir).select(F.col("id").alias("doc_id"))


def p9_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _garbled(spark, sf_dir).select(F.col("id").alias("doc_id"), "restored", "stretches", "lost")


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_terms, p2_found, p2_counts, p2_coverage, p3_found, p3_sample, p3_report, p4_found, p4_collapsed, p5_found, p5_groups, p6_found, p6_scores, p7_ids, p8_found, p8_coverage, p9_found, p9_restored)}


_TERMS = r"""
  tokens AS (SELECT row_id, unnest(regexp_extract_all(lower(query), '[\p{L}\p{N}]{2,}')) AS term FROM features WHERE query IS NOT NULL),
  pairs AS (SELECT row_id, term, count(*) AS c FROM tokens GROUP BY row_id, term),
  counts AS (SELECT term, sum(c)::BIGINT AS occurrences, count(*)::BIGINT AS records FROM pairs GROUP BY term),
  size AS (SELECT count(query)::BIGINT AS n FROM features)"""

_MARK = "CASE WHEN records < 3 THEN 'rare' WHEN records * 10 > n THEN 'common' END"

_CONTENT = r"""
  contents AS (
    SELECT row_id, intent_id,
      CASE WHEN source = 'web_form'
        THEN 'f' || array_to_string(list_sort(list_filter(list_transform(regexp_split_to_array(lower(query), '[;|\n\r]'), lambda f: regexp_replace(f, '[^\p{L}\p{N}]+', '', 'g')), lambda f: f <> '')), ';')
        ELSE 't' || regexp_replace(lower(query), '[^\p{L}\p{N}]+', '', 'g') END AS content
    FROM features WHERE regexp_matches(query, '[\p{L}\p{N}]')),
  firsts AS (SELECT intent_id, content, min(row_id) AS first_row_id, count(*)::BIGINT AS copies FROM contents GROUP BY intent_id, content)"""

_INTENTS = r"""
  named AS (SELECT intent_id, regexp_replace(lower(intent_name), '[\s\p{Z}_-]+', '', 'g') AS plain FROM intent_targets),
  rows_of AS (SELECT f.row_id, coalesce(t.intent_id, n.intent_id) AS intent_id FROM features f
    LEFT JOIN intent_targets t ON f.intent_id = t.intent_id
    LEFT JOIN named n ON n.plain = regexp_replace(lower(f.intent_name), '[\s\p{Z}_-]+', '', 'g')
    WHERE coalesce(t.intent_id, n.intent_id) IS NOT NULL),
  counted AS (SELECT intent_id, count(*) AS available FROM rows_of GROUP BY intent_id),
  total AS (SELECT count(*) AS r FROM rows_of)"""


_SHARED = r"""texts AS (SELECT program_id, function AS text FROM sample UNION ALL SELECT program_id, best_program FROM best),
  split AS (SELECT program_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS w FROM texts WHERE text IS NOT NULL),
  content AS (SELECT DISTINCT program_id, unnest(list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2])) AS run FROM split WHERE len(w) >= 3),
  sizes AS (SELECT program_id, count(*) AS n FROM content GROUP BY program_id),
  common AS (SELECT a.program_id AS a, b.program_id AS b, count(*) AS n FROM content a JOIN content b ON a.run = b.run AND a.program_id < b.program_id GROUP BY 1, 2),
  near AS (SELECT a, b, c.n = x.n AND c.n = y.n AS same FROM common c JOIN sizes x ON x.program_id = a JOIN sizes y ON y.program_id = b WHERE c.n * 10 >= 6 * (x.n + y.n - c.n))"""


# the scale at which the quotas sum to the sample by bisection, then the largest remainders
_QUOTAS = f"""{_INTENTS},
  t AS (SELECT t.intent_id AS k, coalesce(target_bp, 0) AS w, coalesce(min_rows, 0)::BIGINT AS least_rows, coalesce(available, 0)::BIGINT AS high, least(coalesce(min_rows, 0), coalesce(available, 0)) AS low FROM intent_targets t LEFT JOIN counted c USING (intent_id)),
  size AS (SELECT least((2 * r + 10) // 20, (SELECT sum(high) FROM t)) AS want, r FROM total),
  scale AS (SELECT 0 AS step, 0.0::DOUBLE AS lo, (SELECT max(high) + 1 FROM t)::DOUBLE AS hi UNION ALL
    SELECT step + 1, CASE WHEN (SELECT sum(least(greatest((lo + hi) / 2 * w, low), high)) FROM t) < (SELECT want FROM size) THEN (lo + hi) / 2 ELSE lo END, CASE WHEN (SELECT sum(least(greatest((lo + hi) / 2 * w, low), high)) FROM t) < (SELECT want FROM size) THEN hi ELSE (lo + hi) / 2 END
    FROM scale WHERE step < 100),
  exact AS (SELECT t.*, least(greatest((SELECT hi FROM scale WHERE step = 100) * w, low), high) AS x FROM t),
  whole AS (SELECT *, floor(x + 1e-9)::BIGINT AS q FROM exact),
  quotas AS (SELECT k, w, least_rows, high, q + CASE WHEN q < high AND row_number() OVER (PARTITION BY q < high ORDER BY q - x, k) <= (SELECT want FROM size) - sum(q) OVER () THEN 1 ELSE 0 END AS quota FROM whole)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_sample": f"""WITH RECURSIVE {_QUOTAS}, placed AS (SELECT row_id, intent_id, row_number() OVER (PARTITION BY intent_id ORDER BY md5('42:' || row_id), row_id) AS place FROM rows_of)
SELECT row_id, intent_id FROM placed JOIN quotas ON k = intent_id WHERE place <= quota""",
        "p3_report": f"""WITH RECURSIVE {_QUOTAS}, wanted AS (SELECT *, w * (SELECT r FROM size) / ((SELECT sum(w) FROM t) * 10)::DOUBLE AS wanted FROM quotas)
SELECT k AS intent_id, high AS available, wanted, least_rows AS least, quota::BIGINT AS quota, high * 100000 < w * (SELECT r FROM size) OR high < least_rows AS short, round(greatest(wanted - quota, 0), 6) AS missing, round(greatest(quota - wanted, 0), 6) AS extra FROM wanted""",
        "p1_terms": f"WITH {_TERMS} SELECT term, occurrences, records, {_MARK} AS mark FROM counts, size",
        "p1_found": f"WITH {_TERMS} SELECT term, {_MARK} AS mark FROM counts, size WHERE {_MARK} IS NOT NULL",
        "p2_coverage": r"""WITH texts AS (SELECT row_id, trim(lower(source_split)) = 'train' AS train, CASE WHEN source = 'web_form' THEN regexp_split_to_array(lower(query), '[;|\n\r]') ELSE [lower(query)] END AS units
    FROM features WHERE trim(lower(source_split)) IN ('train', 'test', 'validation') AND regexp_matches(query, '[\p{L}\p{N}]')),
  units AS (SELECT row_id, train, unnest(range(1, len(units) + 1)) AS k, unnest(units) AS unit FROM texts),
  sorted AS (SELECT row_id, train, row_number() OVER (PARTITION BY row_id ORDER BY array_to_string(w, ' '), k) AS k, w FROM (SELECT *, regexp_extract_all(unit, '[\p{L}\p{N}]+') AS w FROM units) WHERE len(w) > 0),
  placed AS (SELECT *, (sum(len(w)) OVER (PARTITION BY row_id ORDER BY k) - len(w))::BIGINT AS before FROM sorted),
  runs AS (SELECT row_id, train, before, unnest(range(1, len(w) - 6)) AS j, unnest(list_transform(range(1, len(w) - 6), lambda j: array_to_string(w[j:j + 7], ' '))) AS run FROM placed WHERE len(w) >= 8),
  hit AS (SELECT DISTINCT row_id, unnest(range(before + j, before + j + 8)) AS spot FROM runs WHERE NOT train AND run IN (SELECT run FROM runs WHERE train)),
  spans AS (SELECT row_id, count(*) AS n FROM (SELECT row_id, spot - row_number() OVER (PARTITION BY row_id ORDER BY spot) AS island FROM hit) GROUP BY row_id, island)
SELECT row_id, words::INTEGER AS words, coalesce(covered, 0)::INTEGER AS covered, coalesce(longest, 0)::INTEGER AS longest
FROM (SELECT row_id, sum(len(w)) AS words FROM placed WHERE NOT train GROUP BY row_id) LEFT JOIN (SELECT row_id, sum(n) AS covered, max(n) AS longest FROM spans GROUP BY row_id) USING (row_id)""",
        "p3_found": f"WITH {_INTENTS} SELECT t.intent_id FROM intent_targets t LEFT JOIN counted c USING (intent_id), total WHERE coalesce(c.available, 0) * 100000 < t.target_bp * r OR coalesce(c.available, 0) < t.min_rows",
        "p4_found": f"WITH {_CONTENT} SELECT first_row_id, row_id FROM contents c JOIN firsts f ON c.content = f.content AND c.intent_id IS NOT DISTINCT FROM f.intent_id WHERE row_id <> first_row_id",
        "p4_collapsed": f"WITH {_CONTENT} SELECT first_row_id AS row_id, copies FROM firsts",
        "p5_found": f"WITH {_SHARED} SELECT a AS program_id_a, b AS program_id_b FROM near",
        "p5_groups": f"""WITH RECURSIVE {_SHARED},
  firsts AS (SELECT program_id, coalesce(min(a), program_id) AS class FROM sizes LEFT JOIN near ON b = program_id AND same GROUP BY program_id),
  links AS (SELECT DISTINCT x.class AS a, y.class AS b FROM near JOIN firsts x ON x.program_id = near.a JOIN firsts y ON y.program_id = near.b WHERE x.class <> y.class),
  ends AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
  reach AS (SELECT class AS a, class AS b FROM firsts UNION SELECT reach.a, ends.b FROM reach JOIN ends ON ends.a = reach.b)
SELECT program_id, (SELECT min(b) FROM reach WHERE reach.a = class) AS group_id, (SELECT count(*) FROM ends WHERE ends.a = class)::BIGINT AS links FROM firsts""",
        "p6_found": f"""WITH {_TERMS},
  weights AS (SELECT row_id, term, c * ln((1 + n) / (1 + records)::DOUBLE) AS w FROM pairs JOIN counts USING (term), size),
  top AS (SELECT row_id, arg_max(term, w) AS term, list_sort(list(w), 'DESC') AS ws FROM weights GROUP BY row_id HAVING count(*) >= 2)
SELECT row_id, term FROM top WHERE ws[1] >= 2 * ws[2] AND ws[1] > ws[2]""",
        "p6_scores": f"""WITH {_TERMS},
  sizes AS (SELECT row_id, sum(c)::DOUBLE AS m FROM pairs GROUP BY row_id),
  whole AS (SELECT sum(occurrences)::DOUBLE AS t FROM counts),
  prior AS (SELECT row_id, term, m, t, c + 100.0 * occurrences / t AS own, occurrences - c + 100.0 * occurrences / t AS rest FROM pairs JOIN counts USING (term) JOIN sizes USING (row_id), whole)
SELECT row_id, term, round((ln(own / (m + 100.0 - own)) - ln(rest / (t - m + 100.0 - rest))) / sqrt(1 / own + 1 / rest), 6) AS score FROM prior""",
        "p8_found": r"""WITH item AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items),
  doc AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
  item_runs AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) AS run FROM item WHERE len(w) >= 12),
  doc_runs AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) AS run FROM doc WHERE len(w) >= 12)
SELECT DISTINCT doc_id, item_id FROM doc_runs JOIN item_runs USING (run)""",
    }
