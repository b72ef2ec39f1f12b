"""All queries of the core, by name, and SQL that gives the same rows over the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featherloom.functions.numeric import cleaned
from featherloom.functions.text import QUESTION_WORDS, entity_columns, with_lexical
from featherloom.operators import buffer, encode, evaluate, metrics, report, select, split, stats, tfidf
from featherloom.operators.order import value_ranks
from featherloom.operators.program import FeatureProgram
from featherloom.session import scratch, table
from featherloom.sources import io

LEX = ["n_chars", "n_tokens", "avg_word_len", "n_digits", "n_punct", "n_uppercase", "has_question_mark", "has_money_symbol", "has_number", "starts_with_qword", "qword_count", "type_token_ratio"]
STOP = ["the", "and", "to", "my", "it", "is", "in", "of", "on", "for", "from", "with", "was", "an", "at", "by", "not"]
FOLDS = 5

_Q: dict = {}
_S: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _Q[f.__name__] = f
        if sql:
            _S[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_S)


def r6(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(f"`{c}`").cast("double"), 6) for c in columns})


def features(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "features")


def clean_sql(c: str) -> str:
    return f"coalesce(CASE WHEN isnan({c}::DOUBLE) OR isinf({c}::DOUBLE) THEN NULL ELSE {c}::DOUBLE END, 0)"


def long_sql(columns: list[str], where: str = "intent_id IS NOT NULL") -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS feature, {k} AS place, intent_id AS label, {clean_sql(c)} AS x FROM features WHERE {where}" for k, c in enumerate(columns))


# -- text -------------------------------------------------------------------------------
_WORDS = ", ".join(f"'{w}'" for w in QUESTION_WORDS)


def lexical_sql(table_name: str, row: str, text: str, extra: str = "") -> str:
    return rf"""WITH s AS (SELECT {row}, {extra} coalesce({text}, '') AS s FROM {table_name}),
  t AS (SELECT *, list_filter(regexp_split_to_array(s, '[\s\p{{Z}}\x{{85}}\x0b\x1c-\x1f]+'), lambda x: x <> '') AS parts FROM s),
  b AS (SELECT *, list_transform(parts, lambda x: lower(regexp_replace(x, '^[[:punct:]]+|[[:punct:]]+$', '', 'g'))) AS plain, greatest(len(parts), 1) AS n FROM t)
SELECT {row}, {extra} greatest(length(s), 1)::BIGINT AS n_chars, n::BIGINT AS n_tokens, round(coalesce(list_sum(list_transform(parts, lambda x: length(x))), 0) / n::DOUBLE, 6) AS avg_word_len,
  len(regexp_extract_all(s, '\p{{Nd}}'))::BIGINT AS n_digits, len(regexp_extract_all(s, '[[:punct:]]'))::BIGINT AS n_punct, len(regexp_extract_all(s, '\p{{Lu}}'))::BIGINT AS n_uppercase,
  contains(s, '?')::BIGINT AS has_question_mark, regexp_matches(lower(s), '[$£€¥]|\bdollar|\beuro|\bpound|\bgbp|\busd|\beur')::BIGINT AS has_money_symbol, regexp_matches(s, '\p{{Nd}}')::BIGINT AS has_number,
  coalesce(plain[1] IN ({_WORDS}), false)::BIGINT AS starts_with_qword, len(list_filter(plain, lambda x: x IN ({_WORDS})))::BIGINT AS qword_count, round(len(list_distinct(plain)) / n::DOUBLE, 6) AS type_token_ratio FROM b"""


@query(lexical_sql("features", "row_id", "query"))
def lexical_features(spark, d):
    return r6(with_lexical(features(spark, d), "query", "row_id"), "avg_word_len", "type_token_ratio")


@query(lexical_sql("documents", "doc_id", "text"))
def lexical_documents(spark, d):
    return r6(with_lexical(table(spark, d, "documents"), "text", "doc_id"), "avg_word_len", "type_token_ratio")


def fisher_sql(long: str, k: int) -> str:
    return f"""WITH x AS ({long}), m AS (SELECT feature, place, label, count(*) AS n, avg(x) AS mean, var_pop(x) AS var FROM x GROUP BY ALL),
  a AS (SELECT feature, sum(n * mean) / sum(n) AS mu FROM m GROUP BY feature),
  s AS (SELECT feature, place, sum(CASE WHEN n >= 2 THEN n * (mean - mu) ** 2 ELSE 0 END) / (sum(CASE WHEN n >= 2 THEN n * var ELSE 0 END) + 1e-9) AS score FROM m JOIN a USING (feature) GROUP BY ALL)
SELECT feature, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, place)::INTEGER AS rank FROM s ORDER BY rank LIMIT {k}"""


def ranked(spark, scores: DataFrame, columns: list[str], k: int) -> DataFrame:
    return r6(select.ranking(scores, columns, k), "score")


@query(f"WITH lexical AS ({lexical_sql('features', 'row_id', 'query', 'intent_id,')}), " + fisher_sql(long_sql(LEX), 5).replace("FROM features", "FROM lexical").removeprefix("WITH "))
def lexical_fisher_topk(spark, d):
    rows = r6(with_lexical(features(spark, d), "query", "intent_id"), "avg_word_len", "type_token_ratio")
    return ranked(spark, select.fisher_scores(select.moments(rows, LEX, "intent_id")), LEX, 5)


_STOP = ", ".join(f"'{w}'" for w in STOP)
_TFIDF = rf"""
  w AS (SELECT row_id, list_filter(regexp_extract_all(lower(coalesce(query, '')), '[\p{{L}}\p{{N}}_][\p{{L}}\p{{N}}_]+'), lambda x: x NOT IN ({_STOP})) AS w FROM features),
  g AS (SELECT row_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]))) AS term FROM w),
  v AS (SELECT term, count(*) AS occurrences, count(DISTINCT row_id) AS records FROM g GROUP BY term ORDER BY occurrences DESC, term LIMIT 50)"""


@query(f"WITH {_TFIDF} SELECT term, occurrences, records FROM v")
def tfidf_vocabulary(spark, d):
    return tfidf.fit_tfidf(features(spark, d), "row_id", "query", 50, STOP).vocabulary(spark)


@query(f"""WITH {_TFIDF}, n AS (SELECT count(*) AS n FROM features),
  r AS (SELECT row_id, term, count(*) * (ln((1 + max(n)) / (1 + max(records))::DOUBLE) + 1) AS raw FROM g JOIN v USING (term), n GROUP BY row_id, term)
SELECT row_id, term, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY row_id)), 6) AS weight FROM r""")
def tfidf_weights(spark, d):
    rows = features(spark, d)
    return r6(tfidf.fit_tfidf(rows, "row_id", "query", 50, STOP).weights(rows, "row_id", "query").withColumnRenamed("id", "row_id"), "weight")


# -- encoding ------------------------------------------------------------------------------
@query("""WITH codes AS (SELECT source, dense_rank() OVER (ORDER BY source) - 1 AS code FROM (SELECT DISTINCT source FROM features WHERE trim(lower(source_split)) = 'train' AND source IS NOT NULL)),
  names AS (SELECT intent_name, dense_rank() OVER (ORDER BY intent_name) - 1 AS code FROM (SELECT DISTINCT intent_name FROM features WHERE trim(lower(source_split)) = 'train' AND intent_name IS NOT NULL))
SELECT row_id, coalesce(c.code, -1)::DOUBLE AS source, coalesce(n.code, -1)::DOUBLE AS intent_name FROM features f LEFT JOIN codes c USING (source) LEFT JOIN names n USING (intent_name)""")
def encode_train_test(spark, d):
    rows = features(spark, d)
    model = encode.fit_codes(rows.filter("trim(lower(source_split)) = 'train'"), ["source", "intent_name"])
    return model.transform(rows.select("row_id", "source", "intent_name"))


@query(f"""WITH firsts AS (SELECT intent_name, min(row_id) AS r FROM features WHERE intent_name IS NOT NULL GROUP BY intent_name), codes AS (SELECT intent_name, row_number() OVER (ORDER BY r) - 1 AS code FROM firsts)
SELECT row_id, coalesce(code, -1)::DOUBLE AS intent_name, {clean_sql('n_chars')} AS n_chars, {clean_sql('avg_word_len')} AS avg_word_len FROM features LEFT JOIN codes USING (intent_name)""")
def safe_numeric(spark, d):
    return encode.safe_numeric(features(spark, d).select("row_id", "intent_name", "n_chars", "avg_word_len"), "row_id")


@query("SELECT row_id, dense_rank() OVER (ORDER BY intent_name)::INTEGER - 1 AS label_code FROM features WHERE intent_name IS NOT NULL")
def label_codes(spark, d):
    return encode.label_codes(features(spark, d).filter("intent_name IS NOT NULL").select("row_id", "intent_name"), "intent_name").select("row_id", "label_code")


def _scaled(kind: str):
    def run(spark, d):
        rows = table(spark, d, "orders")
        return r6(encode.fit_scaler(rows, ["o_totalprice"], kind).transform(rows.select("o_orderkey", "o_totalprice")), "o_totalprice")

    return run


for _kind, _center, _width in (("standard", "avg(o_totalprice)", "stddev_pop(o_totalprice)"), ("minmax", "min(o_totalprice)", "max(o_totalprice) - min(o_totalprice)"), ("robust", "quantile_cont(o_totalprice, 0.5)", "quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25)")):
    _Q[f"scale_{_kind}"] = _scaled(_kind)
    _S[f"scale_{_kind}"] = f"SELECT o_orderkey, round((o_totalprice - (SELECT {_center} FROM orders)) / (SELECT coalesce(nullif({_width}, 0), 1) FROM orders), 6) AS o_totalprice FROM orders"

_PROFILE = ["query", "source", *LEX]


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, " + ("true" if c in ("query", "source") else f"(SELECT count(*) = 0 FROM features WHERE {c} IS NOT NULL AND {c} NOT IN (0, 1))") + " AS categorical" for c in _PROFILE))
def categorical_profile(spark, d):
    return spark.createDataFrame(list(encode.categorical_columns(features(spark, d).select(*_PROFILE)).items()), "feature string, categorical boolean")


# -- splits ------------------------------------------------------------------------------------
@query("SELECT row_id, ((row_number() OVER (PARTITION BY intent_id ORDER BY md5('42:' || row_id), row_id) - 1) % 5)::INTEGER AS fold FROM features")
def stratified_folds(spark, d):
    return split.stratified_folds(features(spark, d).select("row_id", "intent_id"), "intent_id", "row_id", FOLDS).select("row_id", "fold")


@query("SELECT o_orderkey, ((row_number() OVER (ORDER BY md5('42:' || o_orderkey), o_orderkey) - 1) % 5)::INTEGER AS fold FROM orders")
def plain_folds(spark, d):
    return split.kfold(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", FOLDS)


@query("SELECT row_id, query FROM features ORDER BY md5('42:' || row_id), row_id LIMIT 4")
def row_sample(spark, d):
    return split.sample_rows(features(spark, d).select("row_id", "query"), "row_id", 4)


# -- selection -------------------------------------------------------------------------------------
@query(fisher_sql(long_sql(LEX), 6))
def fisher_topk(spark, d):
    return ranked(spark, select.fisher_scores(select.moments(features(spark, d), LEX, "intent_id")), LEX, 6)


@query(f"""WITH x AS ({long_sql(LEX)}), m AS (SELECT feature, label, count(*) AS n, avg(x) AS mean, var_pop(x) AS var FROM x GROUP BY ALL),
  s AS (SELECT feature, sum(n) AS n, count(*) AS c, sum(n * mean) AS s, sum(n * mean * mean) AS s2, sum(n * var) AS w FROM m GROUP BY feature)
SELECT feature, round(((s2 - s * s / n) / (c - 1)) / (w / (n - c)), 6) AS score FROM s""")
def anova_scores(spark, d):
    return r6(select.anova_scores(select.moments(features(spark, d), LEX, "intent_id")), "score")


_ORDERS_X = ["l_quantity", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, round(corr({c}, l_extendedprice) ** 2 / (1 - corr({c}, l_extendedprice) ** 2) * (count(*) - 2), 4) AS score FROM lineitem" for c in _ORDERS_X))
def anova_regression(spark, d):
    return select.regression_scores(table(spark, d, "lineitem"), _ORDERS_X, "l_extendedprice").withColumn("score", F.round("score", 4))


@query(f"WITH x AS ({long_sql(LEX, 'true')}) SELECT feature FROM x GROUP BY feature HAVING var_pop(x) > 0.05")
def variance_keep(spark, d):
    return spark.createDataFrame([(c,) for c in select.variance_threshold(features(spark, d), LEX, threshold=0.05)], "feature string")


_MI = f"""x AS ({long_sql(LEX)}), o AS (SELECT feature, x, row_number() OVER (PARTITION BY feature ORDER BY x) - 1 AS spot, count(*) OVER (PARTITION BY feature) AS size FROM x),
  cut AS (SELECT DISTINCT feature, x AS c FROM o, range(1, 16) k(k) WHERE spot = k * size // 16),
  cuts AS (SELECT feature, list(c) AS cs FROM cut GROUP BY feature),
  b AS (SELECT feature, label, len(list_filter(cs, lambda c: x >= c)) AS bin FROM x JOIN cuts USING (feature)),
  j AS (SELECT feature, bin, label, count(*) AS n FROM b GROUP BY ALL),
  jb AS (SELECT feature, bin, sum(n) AS nb FROM j GROUP BY ALL), jl AS (SELECT feature, label, sum(n) AS nl FROM j GROUP BY ALL), ja AS (SELECT feature, sum(n) AS na FROM j GROUP BY ALL),
  mi AS (SELECT feature, sum(n / na * ln(n * na / (nb * nl))) AS score FROM j JOIN jb USING (feature, bin) JOIN jl USING (feature, label) JOIN ja USING (feature) GROUP BY feature)"""


@query(f"WITH {_MI} SELECT feature, round(score, 6) AS score FROM mi")
def mutual_information(spark, d):
    return r6(select.mutual_information(features(spark, d), LEX, "intent_id"), "score")


@query(f"WITH {_MI}, k AS (SELECT feature FROM x GROUP BY feature HAVING var_pop(x) > 0.001) SELECT feature FROM mi JOIN k USING (feature) ORDER BY score DESC, feature LIMIT 4")
def combined_select(spark, d):
    return spark.createDataFrame([(c,) for c in select.combined(features(spark, d).filter("intent_id IS NOT NULL"), LEX, "intent_id", 4)], "feature string")


_POLY = ["n_tokens", "n_digits", "n_punct"]
_POLY_NAMES = select.polynomial_columns(_POLY)


@query(f"""WITH x AS ({" UNION ALL ".join(f"SELECT '{n}' AS feature, intent_id AS label, {' * '.join(clean_sql(c) for c in of)} AS x FROM features WHERE intent_id IS NOT NULL" for n, of in _POLY_NAMES.items())}),
  m AS (SELECT feature, label, count(*) AS n, avg(x) AS mean, var_pop(x) AS var FROM x GROUP BY ALL),
  s AS (SELECT feature, sum(n) AS n, count(*) AS c, sum(n * mean) AS s, sum(n * mean * mean) AS s2, sum(n * var) AS w FROM m GROUP BY feature)
SELECT feature FROM s ORDER BY ((s2 - s * s / n) / (c - 1)) / (w / (n - c)) DESC LIMIT 4""")
def polynomial_topk(spark, d):
    return spark.createDataFrame([(c,) for c in select.polynomial(features(spark, d), _POLY, "intent_id", 4)[0]], "feature string")


@query()
def lasso_topk(spark, d):
    rows = label_of_flag(spark, d)
    return r6(select.lasso_scores(rows, LEX, "label"), "score")


@query()
def importance_topk(spark, d):
    return r6(select.importance_scores(label_of_flag(spark, d), LEX, "label"), "score")


def label_of_flag(spark, d) -> DataFrame:
    """Rows labelled 0 .. 7 by the place of their source among the sorted ones."""
    rows = features(spark, d)
    codes = encode.fit_codes(rows, ["source"]).transform(rows.select("row_id", "source")).withColumnRenamed("source", "label")
    return rows.join(codes, "row_id")


# -- programs ----------------------------------------------------------------------------------------
def _program(name: str, line: str, sql: str, extra: str = "") -> None:
    """A program of one new column ``y``, and its SQL over features with cleaned numbers."""

    def run(spark, d):
        source = f"def modify_features(df_input):\n    df = df_input.copy()\n{extra}    df['y'] = {line}\n    return df\n"
        rows = features(spark, d).select("row_id", "n_chars", "n_tokens", "n_digits", "n_punct", "avg_word_len", "type_token_ratio", "intent_id", "source")
        return FeatureProgram(source).apply(rows).select("row_id", F.round(cleaned(F.col("y")), 6).alias("y"))

    _Q[f"program_{name}"] = run
    finite = ", ".join(f"CASE WHEN isnan({c}::DOUBLE) OR isinf({c}::DOUBLE) THEN NULL ELSE {c}::DOUBLE END AS {c}" for c in ("n_chars", "n_tokens", "n_digits", "n_punct", "avg_word_len", "type_token_ratio"))
    _S[f"program_{name}"] = f"WITH f AS (SELECT row_id, intent_id::DOUBLE AS intent_id, source, {finite} FROM features) SELECT f.row_id, round(coalesce({sql}, 0), 6) AS y FROM f" if not sql.startswith("FROM") else f"WITH f AS (SELECT row_id, intent_id::DOUBLE AS intent_id, source, {finite} FROM features) SELECT f.row_id, round(coalesce(g.y, 0), 6) AS y {sql}"


_program("ratio", "df['n_digits'] / (df['n_tokens'] - 20)", "n_digits / nullif(n_tokens - 20, 0)")
_program("row_sum", "df[['n_chars', 'n_tokens', 'avg_word_len']].sum(axis=1) / 3", "(coalesce(n_chars, 0) + coalesce(n_tokens, 0) + coalesce(avg_word_len, 0)) / 3")
_program("row_std", "df[['n_tokens', 'n_digits', 'n_punct']].std(axis=1)", "(SELECT stddev_samp(x) FROM (SELECT unnest([n_tokens, n_digits, n_punct]) AS x))")
_program("row_max", "df[['n_chars', 'avg_word_len']].max(axis=1)", "CASE WHEN n_chars IS NULL THEN avg_word_len WHEN avg_word_len IS NULL THEN n_chars ELSE greatest(n_chars, avg_word_len) END")
_program("clip_where", "np.where(df['n_tokens'] >= 30, df['n_chars'].clip(50, 150), df['n_digits'] * 6.5)", "CASE WHEN n_tokens >= 30 THEN CASE WHEN n_chars IS NULL THEN NULL ELSE least(greatest(n_chars, 50), 150) END ELSE n_digits * 6.5 END")
_program("log_sqrt", "np.log1p(df['n_chars'].abs() * 2) - np.sqrt(df['n_digits'].fillna(20) ** 2 + df['n_punct'] ** 2)", "ln(1 + abs(n_chars) * 2) - sqrt(coalesce(n_digits, 20) ** 2 + n_punct ** 2)")
_program("sigmoid", "1 / (1 + np.exp(-(df['n_tokens'] - 30) / 5))", "1 / (1 + exp(-(n_tokens - 30) / 5))")
_program("flag", "(df['n_chars'] > 180).astype(int) * df['n_punct']", "CASE WHEN n_chars > 180 THEN 1 ELSE 0 END * n_punct")
_program("frequency", "df['n_tokens'].map(df['n_tokens'].value_counts()).fillna(7) - df['n_punct']", "coalesce((SELECT count(*) FROM f AS h WHERE h.n_tokens = f.n_tokens), 7) - n_punct")
_program("rank", "df['n_chars'].rank(method='average')", "FROM f LEFT JOIN (SELECT row_id, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS y FROM f WHERE n_chars IS NOT NULL) g ON f.row_id = g.row_id")
_program("standard_scaled", "(df['n_tokens'] - df['n_tokens'].mean()) / df['n_tokens'].std()", "(n_tokens - (SELECT avg(n_tokens) FROM f)) / (SELECT stddev_samp(n_tokens) FROM f)")
_program("entropy_like", "-(df['type_token_ratio'] * np.log(df['type_token_ratio']))", "CASE WHEN type_token_ratio > 0 THEN -(type_token_ratio * ln(type_token_ratio)) END")
_program("combine_frequency", "df['both'].map(df['both'].value_counts(normalize=True))", "FROM f LEFT JOIN (SELECT source, n_tokens, count(*) / (SELECT count(*) FROM f WHERE source IS NOT NULL AND n_tokens IS NOT NULL)::DOUBLE AS y FROM f WHERE source IS NOT NULL AND n_tokens IS NOT NULL GROUP BY ALL) g ON f.source = g.source AND f.n_tokens = g.n_tokens", "    df['both'] = df['source'].astype(str) + '_' + df['n_tokens'].astype(str)\n")
_program("minmax", "MinMaxScaler().fit_transform(df[['n_tokens']])", "(n_tokens - (SELECT min(n_tokens) FROM f)) / (SELECT max(n_tokens) - min(n_tokens) FROM f)")
_program("zscore", "StandardScaler().fit_transform(df[['n_digits', 'n_punct']])[:, 1]", "(n_punct - (SELECT avg(n_punct) FROM f)) / (SELECT stddev_pop(n_punct) FROM f)")
_program("robust", "RobustScaler().fit_transform(df[['n_tokens']])", "(n_tokens - (SELECT quantile_cont(n_tokens, 0.5) FROM f)) / (SELECT quantile_cont(n_tokens, 0.75) - quantile_cont(n_tokens, 0.25) FROM f)")
_program("entropy", "entropy(df[['n_tokens', 'n_digits', 'n_punct']], axis=1)", "(SELECT sum(CASE WHEN x > 0 THEN -(x / t) * ln(x / t) ELSE 0 END) FROM (SELECT unnest([n_tokens, n_digits, n_punct]) AS x, coalesce(n_tokens, 0) + coalesce(n_digits, 0) + coalesce(n_punct, 0) AS t))")
_program("row_skew", "skew(df[['n_tokens', 'n_digits', 'n_punct', 'type_token_ratio']], axis=1)", "(SELECT CASE WHEN var_pop(x) > 0 THEN sum((x - m) ** 3) / count(x) / var_pop(x) ** 1.5 END FROM (SELECT x, avg(x) OVER () AS m FROM (SELECT unnest([n_tokens, n_digits, n_punct, type_token_ratio]) AS x)))")
_program("row_mean", "df[['n_chars', 'n_tokens', 'avg_word_len']].mean(axis=1)", "(SELECT avg(x) FROM (SELECT unnest([n_chars, n_tokens, avg_word_len]) AS x))")
_program("lambda", "df['n_tokens'].apply(lambda t: t * 2 if t > 30 else t - 1)", "CASE WHEN n_tokens > 30 THEN n_tokens * 2 ELSE n_tokens - 1 END")
_program("group_map", "df['source'].map(df.groupby('source')['n_digits'].mean()) - df['n_digits']", "(SELECT avg(n_digits) FROM f AS h WHERE h.source = f.source) - n_digits")
_program("dict_map", "df['source'].map({'email': 2, 'web_form': 3.5, 'kiosk': -1})", "CASE source WHEN 'email' THEN 2 WHEN 'web_form' THEN 3.5 WHEN 'kiosk' THEN -1 END")
_program("isin", "df['source'].isin(['email', 'social']) * df['n_tokens']", "CASE WHEN source IN ('email', 'social') THEN 1 ELSE 0 END * n_tokens")
_program("quantile", "(df['n_tokens'] > df['n_tokens'].quantile(0.75)) | (df['n_digits'] < np.percentile(df['n_digits'], 25))", "CASE WHEN coalesce(n_tokens > (SELECT quantile_cont(n_tokens, 0.75) FROM f), false) OR coalesce(n_digits < (SELECT quantile_cont(n_digits, 0.25) FROM f), false) THEN 1 ELSE 0 END")
_program("loop", "df['total'] * 1", "coalesce(n_tokens, 0) ** 2 + coalesce(n_digits, 0) ** 2 + coalesce(n_punct, 0) ** 2", "    df['total'] = 0\n    for c in ['n_tokens', 'n_digits', 'n_punct']:\n        df['total'] += df[c].fillna(0) ** 2\n")
_program("minimum", "np.minimum(df['n_tokens'], df['n_digits'] * 4) - np.maximum(df['n_punct'], 3)", "least(n_tokens, n_digits * 4) - greatest(n_punct, 3)")
_program("residual", "df['avg_word_len'] - np.floor(df['avg_word_len'])", "avg_word_len - floor(avg_word_len)")
_program("modulo", "(df['n_chars'] % 7).round()", "n_chars - 7 * floor(n_chars / 7)")
_program("remap", "df['kept']", "CASE WHEN n_tokens > 30 THEN -1 ELSE n_digits END", "    df['kept'] = df['n_digits']\n    df.loc[df['n_tokens'] > 30, 'kept'] = -1\n")
_program("column_skew", "df['n_tokens'].skew() + df['n_punct'].kurt() + df['n_tokens'] * 0", "(SELECT skewness(n_tokens) FROM f) + (SELECT kurtosis(n_punct) FROM f) + n_tokens * 0")
_program("dense_rank", "df['n_chars'].rank(method='dense')", "FROM f LEFT JOIN (SELECT row_id, dense_rank() OVER (ORDER BY n_chars) AS y FROM f WHERE n_chars IS NOT NULL) g ON f.row_id = g.row_id")
_program("group_zscore", "df.groupby('source')['n_tokens'].transform(lambda x: (x - x.mean()) / x.std())", "FROM f LEFT JOIN (SELECT row_id, (n_tokens - avg(n_tokens) OVER w) / stddev_samp(n_tokens) OVER w AS y FROM f WHERE source IS NOT NULL WINDOW w AS (PARTITION BY source)) g ON f.row_id = g.row_id")
for _how, _sql in (("mean", "avg(n_chars)"), ("std", "stddev_samp(n_chars)"), ("median", "quantile_cont(n_chars, 0.5)"), ("min", "min(n_chars)"), ("max", "max(n_chars)"), ("nunique", "count(DISTINCT n_chars)")):
    _program(f"group_{_how}", f"df.groupby('source')['n_chars'].transform('{_how}')", f"FROM f LEFT JOIN (SELECT source, {_sql} AS y FROM f GROUP BY source) g ON f.source = g.source")
_program("group_rank", "df.groupby('source')['n_chars'].rank()", "FROM f LEFT JOIN (SELECT row_id, rank() OVER (PARTITION BY source ORDER BY n_chars) + (count(*) OVER (PARTITION BY source, n_chars) - 1) / 2.0 AS y FROM f WHERE n_chars IS NOT NULL AND source IS NOT NULL) g ON f.row_id = g.row_id")


# -- metrics -----------------------------------------------------------------------------------------------
def predictions(spark, d) -> DataFrame:
    """Orders judged by price: label is the status, predicted a cut of the price, p a score."""
    rows = table(spark, d, "orders")
    return rows.select(F.col("o_orderpriority").alias("method"), F.col("o_orderstatus").alias("label"), F.when(F.col("o_totalprice") > 200000, "F").when(F.col("o_totalprice") > 100000, "O").otherwise("P").alias("predicted"), F.col("o_totalprice").alias("s"), (F.col("o_orderstatus") == "F").alias("positive"), (1 / (1 + F.exp(-(F.col("o_totalprice") - 200000) / 50000))).alias("p"))


_PRED = "p AS (SELECT o_orderpriority AS method, o_orderstatus AS label, CASE WHEN o_totalprice > 200000 THEN 'F' WHEN o_totalprice > 100000 THEN 'O' ELSE 'P' END AS predicted, o_totalprice AS s, o_orderstatus = 'F' AS positive, 1 / (1 + exp(-(o_totalprice - 200000) / 50000)) AS p FROM orders)"


@query(f"WITH {_PRED} SELECT method, round(avg((label = predicted)::INTEGER), 6) AS accuracy FROM p GROUP BY method")
def metric_accuracy(spark, d):
    return r6(metrics.accuracy(predictions(spark, d), ["method"]), "accuracy")


@query(f"""WITH {_PRED}, c AS (SELECT method, label AS class FROM p UNION SELECT method, predicted FROM p),
  f AS (SELECT c.method, class, count_if(label = class AND predicted = class) AS tp, count_if(label = class) AS t, count_if(predicted = class) AS q FROM c JOIN p USING (method) GROUP BY ALL)
SELECT method, round(avg(CASE WHEN t + q > 0 THEN 2.0 * tp / (t + q) ELSE 0 END), 6) AS macro_f1 FROM f GROUP BY method""")
def metric_macro_f1(spark, d):
    return r6(metrics.macro_f1(predictions(spark, d), ["method"]), "macro_f1")


@query(f"""WITH {_PRED}, r AS (SELECT method, positive, rank() OVER (PARTITION BY method ORDER BY s) + (count(*) OVER (PARTITION BY method, s) - 1) / 2.0 AS rk FROM p),
  a AS (SELECT method, sum(rk) FILTER (positive) AS r, count_if(positive) AS np, count_if(NOT positive) AS nn FROM r GROUP BY method)
SELECT method, round((r - np * (np + 1) / 2.0) / (np * nn), 6) AS auc FROM a""")
def metric_auc(spark, d):
    return r6(metrics.auc(predictions(spark, d), ["method"], "positive", "s"), "auc")


_CLASSES = ["F", "O", "P"]


@query(f"""WITH {_PRED}, c AS (SELECT method, k, label = ['F', 'O', 'P'][k] AS positive, [p, s % 1000, 1 - p][k] AS s FROM p, range(1, 4) t(k)),
  r AS (SELECT method, k, positive, rank() OVER (PARTITION BY method, k ORDER BY s) + (count(*) OVER (PARTITION BY method, k, s) - 1) / 2.0 AS rk FROM c),
  a AS (SELECT method, k, sum(rk) FILTER (positive) AS r, count_if(positive) AS np, count_if(NOT positive) AS nn FROM r GROUP BY method, k)
SELECT method, round(avg((r - np * (np + 1) / 2.0) / (np * nn)), 6) AS auc FROM a GROUP BY method""")
def metric_auc_ovr(spark, d):
    rows = predictions(spark, d)
    rows = rows.select("method", F.array_position(F.lit(_CLASSES), F.col("label")).cast("int").alias("label"), F.array("p", F.col("s") % 1000, 1 - F.col("p")).alias("probability"))
    return r6(metrics.auc_one_vs_rest(rows, ["method"], [1, 2, 3]), "auc")


@query(f"WITH {_PRED} SELECT method, round(avg(-ln(greatest(1e-15, least(1 - 1e-15, CASE WHEN positive THEN p ELSE 1 - p END)))), 6) AS log_loss FROM p GROUP BY method")
def metric_log_loss(spark, d):
    return r6(metrics.log_loss(predictions(spark, d).withColumn("own", F.when(F.col("positive"), F.col("p")).otherwise(1 - F.col("p"))), ["method"], "own"), "log_loss")


_REG = "e AS (SELECT l_returnflag AS method, l_extendedprice AS y, l_quantity * 1500 AS p FROM lineitem)"


def regressions(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_returnflag").alias("method"), F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * 1500).alias("predicted"))


@query(f"WITH {_REG} SELECT method, round(sqrt(avg((y - p) ** 2)), 4) AS rmse, round(avg(abs(y - p)), 4) AS mae, round(1 - sum((y - p) ** 2) / (count(*) * var_pop(y)), 6) AS r2 FROM e GROUP BY method")
def metric_regression(spark, d):
    return metrics.regression(regressions(spark, d), ["method"]).withColumns({"rmse": F.round("rmse", 4), "mae": F.round("mae", 4), "r2": F.round("r2", 6)})


@query(f"WITH {_REG} SELECT method, round(quantile_cont(abs(y - p), 0.5), 4) AS medae FROM e GROUP BY method")
def metric_median_error(spark, d):
    return metrics.median_absolute_error(regressions(spark, d), "method").withColumn("medae", F.round("medae", 4))


def fold_scores(spark, d, folds: int = 5) -> DataFrame:
    """Events as scores of methods on folds; first is the place of a method's first event."""
    return table(spark, d, "events").groupBy(F.col("event_type").alias("method"), (F.col("user_id") % folds).cast("int").alias("fold")).agg(F.avg("value").alias("value"), F.min("event_id").alias("first"))


_FOLDS = "s AS (SELECT event_type AS method, (user_id % 5)::INTEGER AS fold, avg(value) AS value FROM events GROUP BY ALL)"


@query(f"WITH {_FOLDS} SELECT method, 'm' AS model, 'value' AS metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM s GROUP BY method")
def fold_aggregate(spark, d):
    return r6(metrics.aggregate_folds(fold_scores(spark, d).withColumns({"model": F.lit("m"), "metric": F.lit("value")})), "mean", "std")


# -- statistics -----------------------------------------------------------------------------------------------
_SUMMARY = "SELECT method, count(*) AS n, round(avg(value), 4) AS mean, round(coalesce(stddev_samp(value), 0), 4) AS std, round(min(value), 4) AS min, round(max(value), 4) AS max FROM s GROUP BY method"


@query(f"WITH {_FOLDS} {_SUMMARY}")
def summary_scores(spark, d):
    return stats.summarize(fold_scores(spark, d))


_DIFFS = """d AS (SELECT a.method AS method_a, b.method AS method_b, a.fold, a.value AS a, b.value AS b, a.value - b.value AS d FROM s a JOIN s b ON a.fold = b.fold WHERE {where}),
  t AS (SELECT method_a, method_b, count(*)::INTEGER AS n, avg(a) AS mean_a, avg(b) AS mean_b, avg(d) AS delta, avg(d) / stddev_samp(d) AS cohen_d, avg(d) / (stddev_samp(d) / sqrt(count(*))) AS t FROM d GROUP BY ALL),
  u AS (SELECT *, abs(t) / sqrt(1 + t * t / 4) AS u FROM t)"""
_TEST = "round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, round(delta, 6) AS delta, round(cohen_d, 6) AS cohen_d, round(t, 6) AS t, round(2 * (1 - (0.5 + 0.375 * u * (1 - u * u / 12))), 6) AS p_t"
_TEST_COLUMNS = ["mean_a", "mean_b", "delta", "cohen_d", "t", "p_t"]


@query(f"WITH {_FOLDS}, {_DIFFS.format(where='a.method < b.method')} SELECT method_a, method_b, n, {_TEST} FROM u")
def all_pairs(spark, d):
    return r6(stats.all_pairs(fold_scores(spark, d)).select("method_a", "method_b", "n", *_TEST_COLUMNS), *_TEST_COLUMNS)


@query(f"WITH {_FOLDS}, o AS (SELECT event_type AS m, min(event_id) AS first FROM events GROUP BY event_type), {_DIFFS.format(where='(SELECT first FROM o WHERE m = a.method) < (SELECT first FROM o WHERE m = b.method)')} SELECT method_a, method_b, n, {_TEST} FROM u")
def all_pairs_in_order(spark, d):
    return r6(stats.all_pairs(fold_scores(spark, d), order="first").select("method_a", "method_b", "n", *_TEST_COLUMNS), *_TEST_COLUMNS)


@query(f"WITH {_FOLDS}, m AS (SELECT min(method) AS m FROM s), {_DIFFS.format(where='b.method = (SELECT m FROM m) AND a.method <> b.method')} SELECT method_a, method_b, n, {_TEST} FROM u")
def vs_reference(spark, d):
    scores = fold_scores(spark, d)
    reference = scores.agg(F.min("method")).first()[0]
    return r6(stats.against(scores, reference).select("method_a", "method_b", "n", *_TEST_COLUMNS), *_TEST_COLUMNS)


@query(f"""WITH {_FOLDS}, m AS (SELECT min(method) AS m FROM s), d AS (SELECT a.method AS key, a.fold AS ord, a.value - b.value AS d FROM s a JOIN s b ON a.fold = b.fold WHERE b.method = (SELECT m FROM m) AND a.method <> b.method),
  l AS (SELECT key, list(d ORDER BY ord) AS ds FROM d GROUP BY key), x AS (SELECT key, (ds[r % 5 + 1] + ds[r // 5 % 5 + 1] + ds[r // 25 % 5 + 1] + ds[r // 125 % 5 + 1] + ds[r // 625 % 5 + 1]) / 5 AS m FROM l, range(3125) t(r))
SELECT key, round(quantile_cont(m, 0.025), 6) AS ci_low, round(quantile_cont(m, 0.975), 6) AS ci_high FROM x GROUP BY key""")
def bootstrap_exact(spark, d):
    scores = fold_scores(spark, d)
    reference = scores.agg(F.min("method")).first()[0]
    base = scores.filter(F.col("method") == reference).select("fold", F.col("value").alias("b"))
    diffs = scores.filter(F.col("method") != reference).join(base, "fold").select(F.col("method").alias("key"), F.col("fold").alias("ord"), (F.col("value") - F.col("b")).alias("d"))
    return r6(stats.exact_bootstrap(diffs), "ci_low", "ci_high")


@query("""WITH s AS (SELECT event_type AS key, (user_id % 10)::INTEGER AS ord, avg(value) AS d FROM events GROUP BY ALL),
  l AS (SELECT key, count(*) AS n, list(d ORDER BY ord) AS ds FROM s GROUP BY key),
  x0 AS (SELECT key, n, ds, r, i, (r * 48271 + i * 69621 + 42 * 16807 + 12345) % 2147483647 AS x FROM l, range(5000) r(r), range(10) i(i) WHERE i < n),
  x1 AS (SELECT * REPLACE ((x * x + 1013904223) % 2147483647 AS x) FROM x0), x2 AS (SELECT * REPLACE ((x * x + 16807) % 2147483647 AS x) FROM x1), x3 AS (SELECT * REPLACE ((x * x + 69621) % 2147483647 AS x) FROM x2),
  means AS (SELECT key, r, avg(ds[x * n // 2147483647 + 1]) AS m FROM x3 GROUP BY key, r)
SELECT key, round(quantile_cont(m, 0.025), 6) AS ci_low, round(quantile_cont(m, 0.975), 6) AS ci_high FROM means GROUP BY key""")
def bootstrap_resampled(spark, d):
    return r6(stats.exact_bootstrap(fold_scores(spark, d, 10).select(F.col("method").alias("key"), F.col("fold").alias("ord"), F.col("value").alias("d"))), "ci_low", "ci_high")


@query("SELECT event_id, CASE WHEN p < 1e-4 THEN '<1e-4' WHEN p < 1e-3 THEN printf('%.1e', p) ELSE printf('%.3f', p) END AS p FROM (SELECT event_id, value / 99991.0 / (1 + event_id % 7 * 40) AS p FROM events)")
def format_p(spark, d):
    return table(spark, d, "events").select("event_id", stats.format_p(F.col("value") / 99991.0 / (1 + F.col("event_id") % 7 * 40)).alias("p"))


@query(f"WITH {_FOLDS}, t AS (SELECT method, fold, value, 0 AS k FROM s UNION ALL SELECT 'click', fold, value + 1, 1 FROM s WHERE method = 'error' UNION ALL SELECT 'new', fold, value, 1 FROM s WHERE method = 'error') SELECT method, fold, round(value, 6) AS value FROM t WHERE k = (SELECT max(k) FROM t u WHERE u.method = t.method)")
def merged_scores(spark, d):
    first = fold_scores(spark, d)
    other = first.filter("method = 'error'")
    second = other.select(F.lit("click").alias("method"), "fold", (F.col("value") + 1).alias("value")).unionByName(other.select(F.lit("new").alias("method"), "fold", "value"))
    return r6(report.merged_scores(first, second), "value")


@query(f"WITH {_FOLDS} SELECT method, round(-avg(CASE WHEN fold < 3 THEN value END), 6) AS score FROM s GROUP BY method")
def primary_score(spark, d):
    folds = fold_scores(spark, d).withColumns({"model": F.when(F.col("fold") < 3, "gbt").otherwise("rf"), "metric": F.lit("rmse")})
    return r6(metrics.primary_score(folds, "gbt", "regression"), "score")


@query(f"""WITH {_FOLDS}, d AS (SELECT a.method AS method_a, b.method AS method_b, a.fold, a.value - b.value AS d FROM s a JOIN s b ON a.fold = b.fold WHERE a.method < b.method),
  r AS (SELECT *, rank() OVER (PARTITION BY method_a, method_b ORDER BY abs(d)) AS rk FROM d),
  w AS (SELECT method_a, method_b, least(sum(CASE WHEN d > 0 THEN rk ELSE 0 END), sum(CASE WHEN d < 0 THEN rk ELSE 0 END)) AS w FROM r GROUP BY ALL),
  z AS (SELECT (m & 1) * 1 + (m // 2 & 1) * 2 + (m // 4 & 1) * 3 + (m // 8 & 1) * 4 + (m // 16 & 1) * 5 AS s FROM range(32) t(m))
SELECT method_a, method_b, w::DOUBLE AS w, least(1.0, 2 * (SELECT count(*) FROM z WHERE s <= w) / 32.0) AS p_w FROM w""")
def wilcoxon_exact(spark, d):
    return stats.all_pairs(fold_scores(spark, d)).select("method_a", "method_b", "w", "p_w")


# -- search ---------------------------------------------------------------------------------------------------------
@query("""SELECT run_id, i, max(CASE WHEN NOT isnan(score) THEN score END) OVER w AS best_so_far, count(CASE WHEN NOT isnan(score) THEN 1 END) OVER w AS n_ok, count(*) OVER w - count(CASE WHEN NOT isnan(score) THEN 1 END) OVER w AS n_fail
FROM curve WINDOW w AS (PARTITION BY run_id ORDER BY i ROWS UNBOUNDED PRECEDING)""")
def best_so_far(spark, d):
    return buffer.progress(table(spark, d, "curve"), "run_id", "i").select("run_id", "i", "best_so_far", "n_ok", "n_fail")


_ONCE = "once AS (SELECT run_id, step, unnest(arg_min({'island': island, 'score': score, 'ok': ok}, received_at)) FROM run_log GROUP BY run_id, step)"


@query("SELECT run_id, step, min(received_at) AS received_at FROM run_log GROUP BY run_id, step")
def log_once(spark, d):
    return once(spark, d).select("run_id", "step", "received_at")


def once(spark, d) -> DataFrame:
    return buffer.first_per_id(table(spark, d, "run_log"), ["run_id", "step"], ["received_at"])


@query(f"WITH {_ONCE} SELECT run_id AS run, island, arg_min(step, (-score, step)) AS best, max(score) AS score FROM once WHERE island IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY ALL")
def island_best(spark, d):
    rows = once(spark, d).filter("score IS NOT NULL AND island IS NOT NULL AND NOT isnan(score)")
    best = rows.groupBy(F.col("run_id").alias("run"), "island").agg(F.max(F.struct("score", (-F.col("step")).alias("s"))).alias("b"))
    return best.select("run", "island", (-F.col("b.s")).alias("best"), F.col("b.score").alias("score"))


@query(f"""WITH {_ONCE}, c AS (SELECT island, score, count(*) AS members FROM once WHERE island IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY ALL),
  n AS (SELECT island, sum(members) AS programs, max(score) AS top FROM c GROUP BY island),
  e AS (SELECT island, score, members, exp((score - top) / greatest(0.001, 0.1 * (1 - (programs % 30000) / 30000.0))) AS e FROM c JOIN n USING (island))
SELECT island, score, members, round(e / sum(e) OVER (PARTITION BY island), 6) AS p FROM e""")
def cluster_softmax(spark, d):
    rows = once(spark, d).filter("score IS NOT NULL AND island IS NOT NULL AND NOT isnan(score)").select("island", F.array("score").alias("signature"))
    return r6(buffer.cluster_shares(rows).select("island", "score", "members", "p"), "p")


_UNIFORM = "('0x' || substr(md5({}), 1, 12))::BIGINT / 281474976710656.0"


@query(f"""WITH {_ONCE}, c AS (SELECT island, score, count(*) AS members FROM once WHERE island IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY ALL),
  n AS (SELECT island, sum(members) AS programs, max(score) AS top FROM c GROUP BY island),
  e AS (SELECT island, score, exp((score - top) / greatest(0.001, 0.1 * (1 - (programs % 30000) / 30000.0))) AS e FROM c JOIN n USING (island)),
  p AS (SELECT island, score, e / sum(e) OVER (PARTITION BY island) AS p FROM e),
  t AS (SELECT island, score, sum(p) OVER (PARTITION BY island ORDER BY score) - p AS a, CASE WHEN score = max(score) OVER (PARTITION BY island) THEN 2.0 ELSE sum(p) OVER (PARTITION BY island ORDER BY score) END AS b FROM p),
  u AS (SELECT island, draw, {_UNIFORM.format("'42:' || draw || ':' || island")} AS u FROM (SELECT DISTINCT island FROM p), range(1, 21) d(draw))
SELECT t.island, draw::INTEGER AS draw, score FROM t JOIN u ON t.island = u.island AND u >= a AND u < b""")
def buffer_draw(spark, d):
    rows = once(spark, d).filter("score IS NOT NULL AND island IS NOT NULL AND NOT isnan(score)").select("island", F.array("score").alias("signature"))
    return buffer.draw(buffer.cluster_shares(rows), ["island"], ["score"], 20)


@query("""WITH m AS (SELECT program_id, run_id, score, length(function) AS n FROM sample WHERE function IS NOT NULL AND score IS NOT NULL),
  e AS (SELECT *, exp(-(n - min(n) OVER w) / (max(n) OVER w + 1e-6)) AS e FROM m WINDOW w AS (PARTITION BY run_id, round(score, 1)))
SELECT program_id, round(e / sum(e) OVER (PARTITION BY run_id, round(score, 1)), 6) AS p FROM e""")
def member_shares(spark, d):
    rows = table(spark, d, "sample").filter("function IS NOT NULL AND score IS NOT NULL").select("program_id", "run_id", F.round("score", 1).alias("cluster"), F.length("function").alias("length"))
    return r6(buffer.member_shares(rows, ["run_id", "cluster"]).select("program_id", "p"), "p")


@query(f"""WITH {_ONCE}, c AS (SELECT run_id * 100000000 + step AS candidate, island, score FROM once),
  b AS (SELECT island, max(score) AS score, arg_min(candidate, (-score, candidate)) AS best FROM c WHERE island IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY island),
  o AS (SELECT *, row_number() OVER (ORDER BY score + {_UNIFORM.format("'42:' || island")} * 1e-6, island) <= (SELECT count(*) FROM b) // 2 AS reset FROM b),
  k AS (SELECT best, row_number() OVER (ORDER BY island) - 1 AS k FROM o WHERE NOT reset),
  f AS (SELECT island, floor({_UNIFORM.format("'42:founder:' || island")} * (SELECT count(*) FROM k)) AS k FROM o WHERE reset)
SELECT island, candidate FROM c WHERE island IS NULL OR island NOT IN (SELECT island FROM f) UNION ALL SELECT island, best FROM f JOIN k USING (k)""")
def buffer_reset(spark, d):
    rows = once(spark, d).withColumn("candidate", F.col("run_id") * 100_000_000 + F.col("step"))
    return buffer.reset(rows.select("island", "candidate", "score")).select("island", "candidate")


@query(f"""WITH {_ONCE}, b AS (SELECT island, max(score) AS score FROM once WHERE island IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY island) SELECT island, row_number() OVER (ORDER BY score, island) <= (SELECT count(*) FROM b) // 2 AS reset FROM b""")
def weakest_islands(spark, d):
    rows = once(spark, d).withColumn("candidate", F.col("run_id") * 100_000_000 + F.col("step"))
    return buffer.weakest(buffer.best_per_island(rows)).select("island", "reset")


# -- reports -----------------------------------------------------------------------------------------------------------
_PRICES = [("lab/kestrel-8b", 0.05, 0.08), ("lab/kestrel-8b-chat", 0.1, 0.3)]


def costs(spark, d) -> DataFrame:
    usage = table(spark, d, "best").select("run_id", "backbone", "model_id", "best_score", F.col("llm_stats.prompt_tokens").alias("prompt_tokens"), F.col("llm_stats.completion_tokens").alias("completion_tokens"), F.col("llm_stats.latency_s").alias("latency_s"))
    return report.token_cost(usage, spark.createDataFrame(_PRICES, "model_id string, usd_in double, usd_out double"))


_COST = "c AS (SELECT run_id, best_score, round(coalesce(llm_stats.prompt_tokens / 1e6 * i + llm_stats.completion_tokens / 1e6 * o, 0), 4) AS usd, CASE WHEN v.m IS NULL THEN 'unknown price' ELSE '' END AS notes FROM best LEFT JOIN (VALUES ('lab/kestrel-8b', 0.05, 0.08), ('lab/kestrel-8b-chat', 0.1, 0.3)) v(m, i, o) ON model_id = v.m)"


@query(f"WITH {_COST} SELECT run_id, usd, notes FROM c")
def cost_table(spark, d):
    return costs(spark, d).select("run_id", "usd", "notes")


@query("SELECT run_id, round(0.8 * coalesce(llm_stats.latency_s, 0) / 3600, 4) AS usd FROM best")
def machine_cost(spark, d):
    usage = table(spark, d, "best").select("run_id", F.col("llm_stats.latency_s").alias("latency_s"))
    return report.machine_cost(usage, 0.8, "rented").select("run_id", "usd")


@query(f"WITH {_COST} SELECT run_id, usd, round(best_score, 4) AS accuracy, CASE WHEN best_score IS NOT NULL AND usd > 0 THEN round(best_score / usd, 4) ELSE 'inf'::DOUBLE END AS acc_per_usd FROM c")
def pareto_rank(spark, d):
    paid = costs(spark, d)
    return report.tradeoff(paid.select("run_id", "usd"), paid.select("run_id", F.col("best_score").alias("accuracy")), "run_id")


@query("SELECT o_orderkey FROM orders a WHERE NOT EXISTS (SELECT 1 FROM (SELECT o_orderdate, max(o_totalprice) AS top FROM orders GROUP BY o_orderdate) b WHERE b.o_orderdate <= a.o_orderdate AND (b.top > a.o_totalprice OR b.top = a.o_totalprice AND b.o_orderdate < a.o_orderdate))")
def pareto_frontier(spark, d):
    return report.frontier(table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice"), "o_orderdate", "o_totalprice").select("o_orderkey")


@query(r"""SELECT p_partkey, CASE WHEN starts_with(lower(p_name), 'tfidf_') THEN 'term weight' WHEN lower(p_name) LIKE '%ratio%' THEN 'ratio' WHEN lower(p_name) LIKE '%log%' THEN 'log scale' WHEN regexp_matches(lower(p_name), 'times|_x_|_mul_') THEN 'interaction' WHEN lower(p_name) LIKE '%diff%' THEN 'difference' WHEN regexp_matches(lower(p_name), 'ner|entity') THEN 'entities' WHEN regexp_matches(lower(p_name), 'question|qword') THEN 'question' WHEN regexp_matches(lower(p_name), 'length|n_tokens|n_chars') THEN 'length' ELSE 'other' END AS kind FROM part""")
def rationale_rules(spark, d):
    return table(spark, d, "part").select("p_partkey", report.rationale_kind(F.col("p_name")).alias("kind"))


@query("SELECT event_type AS method, round(min(value), 6) AS low, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS q2, round(quantile_cont(value, 0.75), 6) AS q3, round(max(value), 6) AS high FROM (SELECT event_type, (user_id % 5)::INTEGER AS fold, avg(value) AS value FROM events GROUP BY ALL) GROUP BY event_type")
def box_quartiles(spark, d):
    return r6(report.quartiles(fold_scores(spark, d), "method", "value"), "low", "q1", "q2", "q3", "high")


@query("SELECT family, dataset, round(avg(best_score), 6) AS score, count(*) AS runs FROM best GROUP BY ROLLUP (family, dataset)")
def rollup_report(spark, d):
    return r6(table(spark, d, "best").rollup("family", "dataset").agg(F.avg("best_score").alias("score"), F.count("*").alias("runs")), "score")


@query("SELECT n_chars AS value, count(*) AS n, (sum(count(*)) OVER (ORDER BY n_chars) - count(*) + (count(*) + 1) / 2.0)::DOUBLE AS rank FROM features WHERE n_chars IS NOT NULL GROUP BY n_chars")
def average_ranks(spark, d):
    return value_ranks(features(spark, d), F.col("n_chars")).withColumn("rank", F.col("rank").cast("double"))


@query("SELECT run_id, CASE WHEN starts_with(model_id, 'lab/') THEN 'hosted' ELSE 'own' END AS backend FROM best")
def backend(spark, d):
    return table(spark, d, "best").select("run_id", report.backend(F.col("model_id"), ["lab/"]).alias("backend"))


@query("""SELECT family, sum(coalesce(llm_stats.prompt_tokens, 0))::BIGINT AS prompt_tokens, sum(coalesce(llm_stats.completion_tokens, 0))::BIGINT AS completion_tokens,
  sum(coalesce(llm_stats.prompt_tokens, 0) + coalesce(llm_stats.completion_tokens, 0))::BIGINT AS total_tokens, count_if(llm_stats.requests > 0)::BIGINT AS requests, count_if(NOT coalesce(llm_stats.requests > 0, false))::BIGINT AS failures, round(sum(coalesce(llm_stats.latency_s, 0)), 4) AS latency_s FROM best GROUP BY family""")
def call_stats(spark, d):
    calls = table(spark, d, "best").select("family", "llm_stats.prompt_tokens", "llm_stats.completion_tokens", "llm_stats.latency_s", (F.col("llm_stats.requests") > 0).alias("ok"))
    return report.call_stats(calls, ["family"]).withColumn("latency_s", F.round("latency_s", 4))


@query("""WITH s AS (SELECT p_name AS feature, avg(p_retailprice) AS score FROM part GROUP BY p_name)
SELECT rank, feature, round(score, 6) AS score, round(score / (SELECT sum(score) FROM s), 6) AS share, CASE WHEN starts_with(lower(feature), 'tfidf_') THEN 'term weight' WHEN lower(feature) LIKE '%ratio%' THEN 'ratio' WHEN lower(feature) LIKE '%log%' THEN 'log scale' WHEN regexp_matches(lower(feature), 'times|_x_|_mul_') THEN 'interaction' WHEN lower(feature) LIKE '%diff%' THEN 'difference' WHEN regexp_matches(lower(feature), 'ner|entity') THEN 'entities' WHEN regexp_matches(lower(feature), 'question|qword') THEN 'question' WHEN regexp_matches(lower(feature), 'length|n_tokens|n_chars') THEN 'length' ELSE 'other' END AS kind
FROM (SELECT feature, score, row_number() OVER (ORDER BY score DESC, feature)::INTEGER AS rank FROM s) WHERE rank <= 20""")
def attribution(spark, d):
    scores = table(spark, d, "part").groupBy(F.col("p_name").alias("feature")).agg(F.avg("p_retailprice").alias("score"))
    return r6(report.attribution(scores), "score", "share")


# -- sources and sinks: what is written is read again -----------------------------------------------------------------
@query("SELECT n_nationkey, n_name, n_regionkey, (row_number() OVER (ORDER BY n_nationkey) - 1)::BIGINT AS row_id FROM nation")
def source_csv(spark, d):
    path = scratch(spark)
    io.write_csv(table(spark, d, "nation").repartitionByRange(3, "n_nationkey").sortWithinPartitions("n_nationkey"), path)
    return io.read_csv(spark, path, "nation").df


@query("SELECT row_id, n_chars, \"tfidf_virtual card\", intent_id FROM features")
def source_parquet(spark, d):
    path = scratch(spark)
    io.write_table(features(spark, d), path)
    return io.read_parquet(spark, path, {"feature_columns": ["n_chars", "tfidf_virtual card"], "label_column": "intent_id"}, "features").df


@query("SELECT step, island, score, ok, eval_s, false AS last FROM run_log UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, true")
def source_log(spark, d):
    path = scratch(spark)
    io.append_log(table(spark, d, "run_log").select("step", "island", "score", "ok", "eval_s"), path)
    spark.createDataFrame([("",), ("  ",), ('{"step": 1, "score"',), ("broken",)], "value string").write.mode("append").text(path)
    io.append_summary(spark, {"best_score": 0.5}, path)
    return io.read_log(spark, path).select("step", "island", "score", "ok", "eval_s", F.coalesce("__summary__", F.lit(False)).alias("last"))


@query("SELECT run_id, backbone, best_score FROM best WHERE dataset = (SELECT min(dataset) FROM best) AND length(trim(best_program)) > 0")
def source_runs(spark, d):
    path = scratch(spark)
    rows = table(spark, d, "best")
    io.write_runs(rows, "run_id", path)
    return io.read_runs(spark, f"{path}/*/*.json", rows.agg(F.min("dataset")).first()[0]).select("run_id", "backbone", "best_score")


@query(f"WITH {_FOLDS} SELECT method, 'm' AS model, fold, 'mean' AS metric, round(value, 6) AS value FROM s")
def source_results(spark, d):
    path = scratch(spark)
    io.write_results(fold_scores(spark, d).select("method", F.lit("m").alias("model"), "fold", F.lit("mean").alias("metric"), "value"), path)
    return r6(io.folds_from_results(spark, path), "value")


@query("SELECT sample_order, function, score FROM sample")
def source_candidates(spark, d):
    path = scratch(spark)
    io.write_candidates(table(spark, d, "sample"), path)
    return io.read_candidates(spark, path)


@query("SELECT row_id, lower(trim(source_split)) AS source_split, query, intent_id, CASE WHEN intent_id BETWEEN 0 AND 9 THEN 'name ' || intent_id END AS intent_name FROM features WHERE lower(trim(source_split)) IN ('train', 'test')")
def source_splits(spark, d):
    rows = features(spark, d).select("row_id", F.lower(F.trim("source_split")).alias("split"), F.col("query").alias("text"), F.col("intent_id").alias("label"))
    return io.union_splits({n: rows.filter(F.col("split") == n).drop("split") for n in ("train", "test")}, [f"name {k}" for k in range(10)]).select("row_id", "source_split", "query", "intent_id", "intent_name")


@query("SELECT s_suppkey, ((row_number() OVER (ORDER BY md5('42:' || s_suppkey), s_suppkey) - 1) % 5)::INTEGER AS fold FROM supplier")
def source_split_indexes(spark, d):
    path = scratch(spark)
    rows = table(spark, d, "supplier").select("s_suppkey")
    io.write_split_indexes(split.kfold(rows, "s_suppkey", FOLDS), "s_suppkey", path)
    return io.with_split_indexes(rows, "s_suppkey", io.read_split_indexes(spark, path))


_ENTITY = {"ner_money": r"(?i)[$£€¥]\s?\d[\d.,]*|\d[\d.,]*\s?(?:eur|usd|gbp|dollars|euros|pounds)\b", "ner_date": r"(?i)\b\d{1,2} (?:january|february|march|april|may|june|july|august|september|october|november|december)\b|\b\d{4}-\d{2}-\d{2}\b"}


@query("SELECT row_id, " + ", ".join(f"len(regexp_extract_all(coalesce(query, ''), '{p}'))::BIGINT AS {n}" for n, p in _ENTITY.items()) + " FROM features")
def entity_rules(spark, d):
    made = entity_columns(F.col("query"), rules=True)
    return features(spark, d).select("row_id", *[made[n].alias(n) for n in _ENTITY])


@query(f"""WITH train AS (SELECT * FROM features WHERE trim(lower(source_split)) = 'train'), codes AS (SELECT source, dense_rank() OVER (ORDER BY source) - 1 AS code FROM (SELECT DISTINCT source FROM train WHERE source IS NOT NULL))
SELECT row_id::DOUBLE AS row_id, coalesce(code, -1)::DOUBLE AS source, CASE WHEN isnan(avg_word_len) OR isinf(avg_word_len) THEN NULL ELSE avg_word_len END AS avg_word_len FROM features LEFT JOIN codes USING (source) WHERE trim(lower(source_split)) = 'test'""")
def encode_frames(spark, d):
    rows = features(spark, d).withColumn("split", F.trim(F.lower("source_split")))
    train, test = (rows.filter(F.col("split") == n).select("row_id", "source", "avg_word_len") for n in ("train", "test"))
    return encode.encode_categoricals(train, test)[1]


_FLAGS = ("source", "has_question_mark", "has_money_symbol", "has_number", "starts_with_qword")


def _line_sql(place: int, c: str) -> str:
    if c in _FLAGS:
        values = f"(SELECT string_agg(v, ' / ' ORDER BY r, v) FROM (SELECT {c}::VARCHAR AS v, min(row_id) AS r FROM features WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY r, v LIMIT 8))"
        return f"SELECT {place}::INTEGER AS place, '{c}' AS feature, '{c} ({c}): one of ' || coalesce({values}, '') AS line"
    number = f"CASE WHEN NOT isnan({c}) AND NOT isinf({c}) THEN {c} + 0.0::DOUBLE END" if c in ("avg_word_len", "type_token_ratio") else c
    low, high = (f"coalesce({f}({number})::VARCHAR, 'none')" for f in ("min", "max"))
    return f"SELECT {place}::INTEGER, '{c}', '{c} ({c}): from ' || {low} || ' to ' || {high} FROM features"


@query(" UNION ALL ".join(_line_sql(k, c) for k, c in enumerate(["source", *LEX])))
def feature_block(spark, d):
    return report.feature_block(features(spark, d).select("row_id", "source", *LEX), "row_id")


@query()
def example_rows(spark, d):
    return report.example_rows(features(spark, d).drop("asked_at", "loaded_at"), "row_id", "intent_id")


# -- models ----------------------------------------------------------------------------------------------------------------
def _cross_validated(model: str):
    def run(spark, d):
        rows = split.stratified_folds(label_of_flag(spark, d), "label", "row_id", FOLDS)
        classes = rows.agg(F.count_distinct("label")).first()[0]
        return evaluate.cross_validate(rows, LEX, "label", "row_id", {model: evaluate.classifiers(classes)[model]})

    return run


_Q |= {"cv_logreg": _cross_validated("logreg"), "cv_forest": _cross_validated("rf")}


@query()
def candidate_score(spark, d):
    """What a search does with one candidate: its program is compiled and judged by the proxy score, two folds and 60 trees, of the intents."""
    source = "def modify_features(df_input):\n    df = df_input.copy()\n    df['per_token'] = df['n_chars'] / (df['n_tokens'] + 1)\n    df['scaled'] = StandardScaler().fit_transform(df[['avg_word_len']])\n    df['by_source'] = df.groupby('source')['n_tokens'].transform('mean')\n    return df\n"
    made = FeatureProgram(source).apply(features(spark, d).select("row_id", "source", "intent_id", *LEX))
    score = evaluate.proxy_score(made, [*LEX, "per_token", "scaled", "by_source"], "intent_id", "row_id")
    return spark.createDataFrame([(score,)], "score double")


@query()
def cv_ridge(spark, d):
    rows = split.kfold(table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.datediff("o_orderdate", F.lit("1992-01-01")).alias("day"), F.col("o_custkey").alias("customer")), "o_orderkey", FOLDS)
    return evaluate.cross_validate(rows, ["day", "customer"], "o_totalprice", "o_orderkey", {"ridge": evaluate.regressors()["ridge"]}, task="regression")
