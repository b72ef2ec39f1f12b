import json
import math
import random

import pytest
from pyspark.sql import functions as F

from featherloom.functions.text import lexical_columns
from featherloom.operators import budget, buffer, encode, prompt, report, select, split, stats
from featherloom.operators.order import cut_points, grouped_quantile, running, running_total, value_ranks
from featherloom.operators.program import FeatureProgram, Spec, UnsupportedProgram, called_names, calls_ancestor, canonical, rename_calls, spec_of, strip_to_body, trim_body
from featherloom.operators.search import Mutation, Replay, Search, make_source
from featherloom.sources import io

HEAD = "def modify_features(df_input):\n    df = df_input.copy()\n"


def made(spark, lines, rows, schema="x double, y double"):
    return FeatureProgram(HEAD + "".join(f"    {x}\n" for x in lines) + "    return df\n").apply(spark.createDataFrame(rows, schema))


def test_program_adds_columns(spark):
    out = made(spark, ["df['x_sq'] = df['x'] ** 2", "df['x_plus_y'] = df['x'] + df['y']"], [(1.0, 0.5), (4.0, 0.3)]).orderBy("x").collect()
    assert out[0].x_sq == 1.0 and out[1].x_plus_y == pytest.approx(4.3)


SHAPES = {
    "df['z'] = StandardScaler().fit_transform(df[['x']])": lambda f: (f.x - f.x.mean()) / f.x.std(ddof=0),
    "scaler = MinMaxScaler()\n    df['z'] = scaler.fit_transform(df[['x']]).flatten()": lambda f: (f.x - f.x.min()) / (f.x.max() - f.x.min()),
    "df['z'] = RobustScaler().fit_transform(df[['x', 'y']])[:, 1]": lambda f: (f.y - f.y.median()) / (f.y.quantile(0.75) - f.y.quantile(0.25)),
    "df['z'] = minmax_scale(df['y'])": lambda f: (f.y - f.y.min()) / (f.y.max() - f.y.min()),
    "df['z'] = entropy(df[['x', 'y']], axis=1)": lambda f: f[["x", "y"]].apply(lambda r: -sum(v / r.sum() * math.log(v / r.sum()) for v in r if v > 0), axis=1),
    "df['z'] = df[['x', 'y', 'w']].skew(axis=1)": lambda f: f[["x", "y", "w"]].skew(axis=1),
    "df['z'] = df[['x', 'y', 'w', 'v']].kurtosis(axis=1)": lambda f: f[["x", "y", "w", "v"]].kurt(axis=1),
    "df['z'] = df[['x', 'y', 'w']].median(axis=1)": lambda f: f[["x", "y", "w"]].median(axis=1),
    "df['z'] = df['x'].skew() + df['y'].kurt()": lambda f: f.x * 0 + f.x.skew() + f.y.kurt(),
    "df['z'] = df['x'].apply(lambda v: v * 2 if v > 3 else -v)": lambda f: f.x.map(lambda v: v * 2 if v > 3 else -v),
    "df['z'] = df.apply(lambda r: r['x'] - r['y'] / 2, axis=1)": lambda f: f.x - f.y / 2,
    "df['z'] = df[['x', 'y']].apply(lambda r: r.max() - r['x'], axis=1)": lambda f: f[["x", "y"]].max(axis=1) - f.x,
    "df['z'] = df['g'].map(df.groupby('g')['x'].mean())": lambda f: f.groupby("g").x.transform("mean"),
    "df['z'] = df['g'].map({'a': 1.5, 'b': 2})": lambda f: f.g.map({"a": 1.5, "b": 2}),
    "df['z'] = df['g'].isin(['a', 'c']).astype(int)": lambda f: f.g.isin(["a", "c"]).astype(float),
    "df['z'] = (df['x'] > df['x'].quantile(0.7)) & (0 < df['y'])": lambda f: ((f.x > f.x.quantile(0.7)) & (f.y > 0)).astype(float),
    "df['z'] = df['x'] - np.percentile(df['x'], 30)": lambda f: f.x - f.x.quantile(0.3),
    "df['z'] = 0\n    for c in ['x', 'y']:\n        df['z'] += df[c] ** 2": lambda f: f.x**2 + f.y**2,
    "for a, b in [('x', 'y')]:\n        df[f'{a}_over_{b}'] = df[a] / df[b]\n    df['z'] = df['x_over_y']": lambda f: f.x / f.y,
    "num = df.select_dtypes(include=[np.number]).columns.tolist()\n    df['z'] = df[num[:2]].sum(axis=1)": lambda f: f.x + f.y,
    "df['z'] = df['x']\n    df.loc[df['y'] > 2, 'z'] = -1": lambda f: f.x.where(f.y <= 2, -1),
    "df['z'] = df.groupby('g')['x'].transform(lambda s: (s - s.mean()) / s.max())": lambda f: f.groupby("g").x.transform(lambda s: (s - s.mean()) / s.max()),
    "df['z'] = df['x'].rank(method='dense') + df['y'].rank(method='min') - df['y'].rank(method='max')": lambda f: f.x.rank(method="dense") + f.y.rank(method="min") - f.y.rank(method="max"),
    "df['z'] = np.polyval([2, 0, 1], df['x'])": lambda f: 2 * f.x**2 + 1,
    "df['z'] = df['g'].str.len() + df['g'].str.contains('a')": lambda f: f.g.str.len() + f.g.str.contains("a"),
    "df[['x', 'y']] = StandardScaler().fit_transform(df[['y', 'x']])\n    df['z'] = df['x']": lambda f: (f.y - f.y.mean()) / f.y.std(ddof=0),
    "counts = df['g'].value_counts()\n    df['z'] = df['g'].map(counts) / len(df)": lambda f: f.g.map(f.g.value_counts()) / len(f),
    "df['z'] = np.select([df['x'] > 4, df['y'] > 2], [1, 2], default=3)": lambda f: f.x.gt(4).map({True: 1, False: 0}).where(f.x > 4, f.y.gt(2).map({True: 2, False: 3})),
    "df = df.assign(z=lambda d: d['x'] + 1)": lambda f: f.x + 1,
    "if 'x' in df.columns and 'q' not in df.columns:\n        df['z'] = df['x'].replace({1.0: 7.0})\n    else:\n        df['z'] = 0": lambda f: f.x.replace({1.0: 7.0}),
}


@pytest.mark.parametrize("lines", SHAPES)
def test_shapes_of_programs(spark, lines):
    import pandas as pd

    rng = random.Random(5)
    frame = pd.DataFrame([(float(rng.randrange(1, 8)), float(rng.randrange(1, 6)), rng.random(), rng.random() * 3, rng.choice("abcd")) for _ in range(40)], columns=["x", "y", "w", "v", "g"])
    frame["i"] = range(40)
    df = spark.createDataFrame(frame)
    out = FeatureProgram(HEAD + f"    {lines}\n    return df\n").apply(df).orderBy("i").toPandas()["z"].astype(float)
    want = SHAPES[lines](frame).astype(float)
    assert all((math.isnan(a) and math.isnan(b)) or a == pytest.approx(b, abs=1e-9) for a, b in zip(out, want))
    assert FeatureProgram(HEAD + f"    {lines}\n    return df\n").refusal(df) is None


def test_program_on_missing_values(spark):
    out = made(spark, ["df['a'] = df['x'] / df['y']", "df['b'] = (df['x'] > 1).astype(int)", "df['c'] = df[['x', 'y']].mean(axis=1)", "df = df.fillna(0)"], [(1.0, 0.0), (None, 2.0), (float("nan"), None)])
    assert sorted((r.a, r.b, r.c) for r in out.collect()) == [(0.0, 0.0, 0.0), (0.0, 0.0, 0.5), (0.0, 0.0, 2.0)]


@pytest.mark.parametrize("line", ["df['z'] = df['missing'] + 1", "df['z'] = open('f')", "df['z'] = df['x'].apply(eval)", "import os\n    os.remove('f')", "df['X'] = df['x']", "for v in df['x']:\n        df['z'] = v", "for i in range(10**9):\n        df['z'] = i", "df['z'] = f\"{df['x']}\"", "df['z'] = df['x'].rank(method='ordinal')", "while True: pass"])
def test_programs_outside_the_language_are_refused(spark, line):
    df = spark.createDataFrame([(1.0, 2.0)], "x double, y double")
    program = FeatureProgram(HEAD + f"    {line}\n    return df\n")
    with pytest.raises(UnsupportedProgram):
        program.apply(df)
    kept, why = program.apply_or_keep(df)
    assert kept.columns == ["x", "y"] and why and program.refusal(df)


def test_ancestors_are_seen():
    assert calls_ancestor("def modify_features(df):\n    return modify_features_v0(df)\n")
    assert not calls_ancestor(HEAD + "    return df\n")


def test_answers_are_cut_to_a_body():
    body = strip_to_body("Sure:\n```python\ndef f(df):\n    df['a'] = 1\nreturn df\ndef g(x):\n    y\n    return x\n```\nmore")
    assert body == "    y\n    return x"
    assert strip_to_body("no code") == "" and trim_body("    a = 1\n    b = (\n") == "    a = 1\n\n"
    assert canonical("def modify_features(d):\n    'doc'\n    x=1 # c\n    return d") == canonical("def modify_features(d):\n    x = 1\n    return d\n")


def test_answers_of_many_kinds():
    assert strip_to_body("```\ndef f(df):\ndf['a'] = 1\nreturn df") == "    df['a'] = 1\n    return df"
    assert strip_to_body("def f(df):\n  # note\n  return df\nprint(1)") == "    # note\n    return df"
    assert strip_to_body("def f(df): return df") == "    return df"
    assert strip_to_body("text\n```\nno function\n```\n```python\ndef f(df):\n    x = (1,\n```") == "    x = (1,"
    assert called_names("def f(d):\n    return g(d.h(1))") == {"g", "h"}
    assert "new(1)" in rename_calls("def old(x):\n    return old(1)\n", "old", "new")
    text = "@evaluate.run\ndef judge(x):\n    return 1\n\n@equation.evolve\ndef f(df):\n    return df\n"
    assert spec_of(text) == Spec("f", "judge", "def f(df):\n    return df\n")
    for bad in ("def f(: pass", text + text, "def f(x): return x"):
        with pytest.raises(ValueError):
            spec_of(bad)


def test_lexical_features_of_odd_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "  "), (4, "What's  É?  12€"), (5, "europe"), (6, "x" * 100_000)], "i int, s string")
    out = {r.i: r for r in df.select("i", *[c.alias(n) for n, c in lexical_columns(F.col("s")).items()]).collect()}
    assert out[1].n_chars == out[1].n_tokens == 1 and out[1].avg_word_len == 0 and out[1].type_token_ratio == 0
    assert (out[3].n_chars, out[3].n_tokens) == (2, 1)
    assert (out[4].n_tokens, out[4].n_uppercase, out[4].n_digits, out[4].n_punct, out[4].has_money_symbol) == (3, 2, 2, 2, 1)
    assert out[5].has_money_symbol == 1 and out[6].n_chars == 100_000


def test_order_over_partitions(spark):
    values = [random.Random(1).randrange(50) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(values)), "i long, v long")
    placed = running_total(df, ["v", "i"]).orderBy("v", "i").collect()
    assert [r.before for r in placed] == list(range(500))
    rank = {r.value: r["rank"] for r in value_ranks(df, F.col("v")).collect()}
    ordered = sorted(values)
    assert all(rank[v] == ordered.index(v) + (ordered.count(v) + 1) / 2 for v in rank)
    found = grouped_quantile(df.withColumn("k", F.col("i") % 3), F.col("k"), F.col("v"), 0.5).collect()
    for key, q in found:
        own = sorted(v for i, v in enumerate(values) if i % 3 == key)
        m = (len(own) - 1) / 2
        assert q == own[math.floor(m)] + (own[math.ceil(m)] - own[math.floor(m)]) * (m % 1)


def test_running_over_parts_of_a_group(spark):
    rng = random.Random(2)
    rows = [("hot" if i % 3 else f"g{i % 5}", i, rng.random() if rng.random() < 0.8 else None) for i in range(400)] + [(None, 1, 0.5)]
    df = spark.createDataFrame(rows, "g string, i long, x double")
    out = running(df, "g", "i", {"m": ("max", F.col("x")), "n": ("sum", F.col("x").isNotNull().cast("long"))})
    assert out.columns == ["g", "i", "x", "m", "n"]
    got = {(r.g, r.i): (r.m, r.n) for r in out.collect()}
    for g in {r[0] for r in rows}:
        best, n = None, 0
        for _, i, x in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]):
            if x is not None:
                best, n = max(x, best or 0.0), n + 1
            assert got[g, i] == (best, n)
    assert running(df.limit(0), "g", "i", {"n": ("sum", F.lit(1))}).count() == 0


def test_cut_points(spark):
    rng = random.Random(3)
    values = [rng.randrange(30) for _ in range(200)] + [10**9]
    df = spark.createDataFrame([(float(v), 1.0) for v in values], "a double, b double")
    cuts = cut_points(df, {"a": F.col("a"), "b": F.col("b")}, 8)
    values.sort()
    assert cuts == {"a": sorted({float(values[k * len(values) // 8]) for k in range(1, 8)}), "b": [1.0]}


def test_order_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "k string, v double")
    assert running_total(empty, ["k"]).count() == 0 and grouped_quantile(empty, F.col("k"), F.col("v")).count() == 0


def toy(spark):
    rng = random.Random(0)
    rows = []
    for i in range(80):
        x = [rng.gauss(0, 1) for _ in range(12)]
        rows.append((i, int(sum(x[:4]) + rng.gauss(0, 0.5) > 0), *x))
    return spark.createDataFrame(rows, "row_id long, y int, " + ", ".join(f"f{k} double" for k in range(12))), [f"f{k}" for k in range(12)]


@pytest.mark.parametrize("name", sorted(select.REGRESSION_SELECTORS))
def test_selectors_of_numeric_targets(spark, name):
    df, names = toy(spark)
    df = df.withColumn("t", F.col("f0") * 3 - F.col("f1"))
    options = {"trees": 5, "depth": 3} if name == "importance" else {"max_iter": 5} if name == "lasso_l1" else {}
    kept = select.REGRESSION_SELECTORS[name](df, names, "t", 3, **options)
    assert kept and (len(kept) == 3 or name == "variance_thresh") and "f0" in kept


@pytest.mark.parametrize("name", sorted(select.SELECTORS))
def test_selectors_keep_columns(spark, name):
    df, names = toy(spark)
    options = {"trees": 5, "depth": 3} if name == "importance" else {"max_iter": 5} if name == "lasso_l1" else {}
    kept = select.SELECTORS[name](df, names, "y", 6, **options)
    assert kept and len(kept) == len(set(kept)) and (len(kept) <= 6 or name == "variance_thresh")
    if name == "fisher":
        assert len(set(kept) & {"f0", "f1", "f2", "f3"}) == 4


def test_importance_of_boosters(spark):
    df, names = toy(spark)
    df = df.withColumn("three", (F.col("f0") > 0).cast("int") + (F.col("f1") > 0).cast("int"))
    for label, task in (("y", "classification"), ("three", "classification"), ("f0", "regression")):
        scores = select.importance_scores(df, names, label, task, trees=3, depth=2, model="booster")
        assert scores.count() == 12 and scores.agg(F.sum("score")).first()[0] == pytest.approx(1)
    assert report.attribution(scores, 3).orderBy("rank").first().feature == "f0" and report.attribution(scores.limit(0)).count() == 0


def test_columns_of_both(spark):
    a, b = spark.createDataFrame([(1, 2, 3)], "x int, y int, z int"), spark.createDataFrame([(1, 2)], "z int, x int")
    assert encode.aligned_columns(a, b) == ["x", "z"]


def test_variance_falls_back_to_all(spark):
    df = spark.createDataFrame([(1.0, 2.0)] * 3, "a double, b double")
    assert select.variance_threshold(df, ["a", "b"]) == ["a", "b"]


def test_folds_are_even(spark):
    df = spark.createDataFrame([(i, None if i % 7 == 0 else i % 3) for i in range(300)], "row_id long, y int")
    counts = {}
    for r in split.stratified_folds(df, "y", "row_id", 5).groupBy("y", "fold").count().collect():
        counts.setdefault(r.y, []).append(r["count"])
    assert all(len(c) == 5 and max(c) - min(c) <= 1 for c in counts.values())


def test_codes(spark):
    train = spark.createDataFrame([("b",), ("a",), (None,)], "c string")
    test = spark.createDataFrame([("a",), ("z",), (None,)], "c string")
    a, b = encode.encode_categoricals(train, test)
    assert sorted(r.c for r in a.collect()) == [-1.0, 0.0, 1.0] and sorted(r.c for r in b.collect()) == [-1.0, -1.0, 0.0]
    first = encode.safe_numeric(spark.createDataFrame([(1, "z", float("inf")), (2, "a", None), (3, "z", 2.0)], "i long, c string, x double"), "i").orderBy("i").collect()
    assert [(r.c, r.x) for r in first] == [(0.0, 0.0), (1.0, 0.0), (0.0, 2.0)]


# t and p of published tables with four degrees of freedom, and exact values of the signed-rank test for five pairs
@pytest.mark.parametrize("t, p", [(2.7764451051977987, 0.05), (4.604094871415897, 0.01), (0.0, 1.0)])
def test_t_distribution(t, p):
    assert 2 * (1 - stats.t_cdf(t, 4)) == pytest.approx(p, abs=1e-9)
    u = t / math.sqrt(1 + t * t / 4)
    assert stats.t_cdf(t, 4) == pytest.approx(0.5 + 0.375 * u * (1 - u * u / 12), abs=1e-12)


def test_paired_comparisons():
    assert stats.wilcoxon_p([1, 2, 3, 4, 5])[1] == 0.0625 and stats.wilcoxon_p([0.0] * 5)[1] == 1.0
    same = stats.paired([0.5] * 5, [0.5] * 5)
    assert same["delta"] == 0 and same["cohen_d"] == 0 and not same["sig_005"] and (same["ci_low"], same["ci_high"]) == (0, 0)
    better = stats.paired([0.85, 0.86, 0.84, 0.85, 0.87], [0.80, 0.80, 0.79, 0.81, 0.80])
    assert better["delta"] > 0 and better["sig_005"]
    with pytest.raises(ValueError):
        stats.paired([1.0], [1.0, 2.0])


@pytest.mark.parametrize("n", [1, 5, 6, 7, 10])
def test_bootstrap_keeps_every_key(spark, n):
    rng = random.Random(n)
    ds = {k: [rng.gauss(0, 1) for _ in range(n)] for k in "ab"} | {"c": [0.5, 1.5, 1.0]}
    df = spark.createDataFrame([(k, i, x) for k, xs in ds.items() for i, x in enumerate(xs)] + [("a", 99, None)], "key string, ord int, d double")
    got = {r.key: (r.ci_low, r.ci_high) for r in stats.exact_bootstrap(df).collect()}
    assert got.keys() == ds.keys()
    for k, xs in ds.items():
        assert got[k] == pytest.approx(stats.bootstrap_bounds(xs), abs=1e-9)
    if n == 10:  # the spread of resampled means is that of independent draws
        mean, dev = sum(ds["a"]) / n, (sum((x - sum(ds["a"]) / n) ** 2 for x in ds["a"]) / n / n) ** 0.5
        assert got["a"] == pytest.approx((mean - 1.96 * dev, mean + 1.96 * dev), abs=0.25 * dev)


def test_pairs_in_a_given_order(spark):
    df = spark.createDataFrame([(m, k, v + k, p) for m, v, p in (("z", 1.0, 0), ("a", 2.0, 1), ("m", 4.0, 1)) for k in range(3)], "method string, fold int, value double, p int")
    assert {(r.method_a, r.method_b, r.delta) for r in stats.all_pairs(df, order="p").collect()} == {("z", "a", -1.0), ("z", "m", -3.0), ("a", "m", -2.0)}


def test_methods_are_compared(spark):
    scores = {"base": [0.80, 0.81, 0.79, 0.82, 0.80], "mi": [0.83, 0.82, 0.83, 0.84, 0.82], "llm": [0.88, 0.87, 0.89, 0.88, 0.87]}
    df = spark.createDataFrame([(m, k, v) for m, vs in scores.items() for k, v in enumerate(vs)], "method string, fold int, value double")
    assert [r.method for r in stats.summarize(df).collect()] == ["llm", "mi", "base"]
    assert stats.all_pairs(df).count() == 3
    against = {r.method_a: r for r in stats.against(df, "base").collect()}
    assert set(against) == {"mi", "llm"} and against["mi"].sig_005
    with pytest.raises(KeyError):
        stats.against(df, "none")


def test_draws_follow_shares(spark):
    df = spark.createDataFrame([(i, "a", 1.0) for i in range(200)] + [(i, "b", 0.8) for i in range(200)], "island long, c string, s double")
    shares = buffer.softmax(df, ["island"], "s", F.lit(0.1))
    drawn = buffer.draw(shares, ["island"], ["c"], 2)
    assert drawn.count() == 400
    part = drawn.filter("c = 'a'").count() / 400
    assert abs(part - 1 / (1 + math.exp(-2))) < 0.08


def test_reset_moves_founders(spark):
    df = spark.createDataFrame([(0, 1, 0.1), (1, 2, 0.5), (2, 3, 0.9), (3, 4, 0.2)], "island long, candidate long, score double")
    after = {(r.island, r.candidate) for r in buffer.reset(df).collect()}
    assert {(1, 2), (2, 3)} <= after and {i for i, _ in after} == {0, 1, 2, 3} and len(after) == 4


def test_search_finds_a_better_program(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "x double, y double")
    better = HEAD + "    df['a'] = df['x'] * 2\n    return df\n"
    broken = HEAD + "    df['a'] = df['nope']\n    return df\n"
    search = Search(df, lambda frame: float(len(frame.columns)), Replay(iter([broken, better, better])), HEAD + "    return df\n", max_samples=3)
    best = search.run()
    assert best.order == 3 and best.score == 3.0
    assert [c.score for c in search.log] == [2.0, None, 3.0, 3.0]
    mutated = Search(df, lambda frame: float(len(frame.columns)), Mutation(["x", "y"]), HEAD + "    return df\n", max_samples=6)
    assert mutated.run().score > 2 and mutated.table().count() == len(mutated.log)


def test_search_over_several_inputs_resets_and_draws(spark):
    a, b = spark.createDataFrame([(1.0, 2.0)], "x double, y double"), spark.createDataFrame([(1.0,)], "x double")
    ticks = iter(range(0, 10_000, 10))
    search = Search({"a": a, "b": b}, lambda frame: float(len(frame.columns)), Mutation(["x", "y"]), HEAD + "    return df\n", islands=4, max_samples=9, config=buffer.BufferConfig(islands=4, reset_period_s=15), frames=[prompt.Frame("Columns: {columns}", "Rows: {rows}")], columns="x, y", rows="1", clock=lambda: next(ticks))
    seen = []
    given = search.source.sample
    search.source.sample = lambda text, parents, n: seen.append((text, len(parents))) or given(text, parents, n)
    best = search.run()
    assert best.score >= 2 and len(best.signature) in (1, 2) and {i for i, _ in search.members} == {0, 1, 2, 3}
    assert seen[0][0].startswith("Columns: x, y\n\ndef modify_features_v0(df_input)") and seen[0][0].rstrip().endswith("Rows: 1")
    assert search.population().count() == len(search.members)
    alone = Search({"b": b}, lambda frame: 1.0, Replay(iter([HEAD + "    df['z'] = df['y']\n    return df\n"])), HEAD + "    return df\n", max_samples=2)
    assert alone.run().order == 0 and alone.log[1].score is None


def test_parents_are_drawn_by_cluster_and_length(spark):
    rows = [(i, 10 * i + k, [float(k // 2)], 10 if k % 2 else 500, float(k // 2)) for i in range(60) for k in range(4)]
    df = spark.createDataFrame(rows, "island long, candidate long, signature array<double>, length long, score double")
    drawn = buffer.draw_parents(df, buffer.BufferConfig(functions_per_prompt=3, t_init=1.0)).collect()
    assert len(drawn) == 120 and {r.turn for r in drawn} == {1, 2}  # no more draws than clusters
    assert sum(r.score == 1.0 for r in drawn) > 70 and sum(r.candidate % 2 for r in drawn) > 70


def test_prompts(tmp_path):
    (tmp_path / "head").write_text("Do {columns}")
    assert prompt.read_part(str(tmp_path / "head")) == "Do {columns}" and prompt.read_part(str(tmp_path / "none")) == ""
    text = prompt.versions([HEAD + "    return df\n", "broken(", "def modify_features(d):\n    'old text'\n    return d\n"])
    assert "old text" not in text and text.count("def ") == 3 and text.rstrip().endswith('"""Version 2, which is to score higher than modify_features_v1."""')
    assert prompt.versions([]) == 'def modify_features_v0(df_input):\n    """The first version."""'
    rng = random.Random(1)
    both = {prompt.render([], "c", "r", [prompt.Frame("plain"), prompt.Frame("guided {rows}")], rng).split("\n")[0] for _ in range(20)}
    assert both == {"plain", "guided r"} and prompt.render([], "", "", [], rng).startswith("def ")
    with pytest.raises(ValueError):
        make_source("none")
    assert make_source("mutation", columns=["a"], key="dropped").columns == ["a"]


def test_chat_tries_again(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    turns, seen, waits = iter([429, 503, 200, 400, 200, 500, 500, 500]), [], []

    class Server(BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            code = next(turns)
            self.send_response(code)
            if code == 429:
                self.send_header("Retry-After", "7")
            self.end_headers()
            self.wfile.write(json.dumps({"choices": [{"message": {"content": "def f(df): return df"}}], "usage": {"prompt_tokens": 5, "completion_tokens": 2}}).encode() if code == 200 else b"no")

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    chat = make_source("chat", url=f"http://127.0.0.1:{server.server_port}/", model_id="m", system="s", attempts=3, sleep=waits.append, other=1)
    assert chat.sample("p", [], 4) == ["def f(df): return df"] * 2 and waits == [7.0, 2.0, 1.0, 2.0]
    assert seen[0]["messages"] == [{"role": "system", "content": "s"}, {"role": "user", "content": "p"}]
    row = report.call_stats(chat.table(spark), ["model_id"]).first()
    assert (row.prompt_tokens, row.completion_tokens, row.total_tokens, row.requests, row.failures) == (10, 4, 14, 2, 2)
    server.shutdown()
    gone = make_source("chat", url=f"http://127.0.0.1:{server.server_port}/", model_id="m", attempts=2, sleep=waits.append, timeout_s=1)
    server.server_close()
    assert gone.sample("p", [], 1) == [] and not gone.calls[0]["ok"]


def test_work_has_a_budget(spark):
    import time

    began = time.time()
    slow = spark.range(0, 8, 1, 8).select(F.udf(lambda i: __import__("time").sleep(60) or i, "long")("id").alias("x"))
    assert budget.within_budget(spark, 2, slow.count if False else lambda: slow.agg(F.sum("x")).first())[0] is None and time.time() - began < 30
    assert budget.within_budget(spark, 60, lambda: spark.range(5).count()) == (5, None)
    assert budget.within_budget(spark, 60, lambda: 1 / 0)[1].startswith("ZeroDivisionError")


def test_tables_are_released(spark):
    import os

    from featherloom import session

    with session.release(spark):
        path = session.materialize(spark.range(3)).inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path)
    assert not os.path.exists(path)


def test_configs_and_indexes(spark, tmp_path):
    import numpy as np

    (tmp_path / "run.yaml").write_text("islands: 3\nname: a\n")
    (tmp_path / "list.yaml").write_text("- 1\n")
    assert io.read_config(str(tmp_path / "run.yaml")) == {"islands": 3, "name": "a"}
    with pytest.raises(ValueError):
        io.read_config(str(tmp_path / "list.yaml"))
    np.savez(tmp_path / "s.npz", fold_0_train=[1, 2], fold_0_test=[0], fold_1_train=[0], fold_1_test=[1, 2])
    found = io.with_split_indexes(spark.range(4), "id", io.read_split_indexes(spark, str(tmp_path / "s.npz")))
    assert {tuple(r) for r in found.collect()} == {(0, 0), (1, 1), (2, 1), (3, None)}


def test_install_check(capsys):
    from featherloom import installed

    assert installed.main() == 0 and "ok       pyspark" in capsys.readouterr().out


def test_reports(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 0.4), (2, 0.9), (3, 0.9)], "c int, g double")
    assert {tuple(r) for r in report.frontier(df, "c", "g").collect()} == {(1, 0.5), (2, 0.9)}
    assert report.to_markdown(df.limit(1)) == "| c | g |\n|---|---|\n| 1 | 0.5000 |\n"
    assert report.to_latex(df.limit(1)).count("\\\\") == 2
    kinds = spark.createDataFrame([("tfidf_log",), ("technology",), ("a_x_b",), ("corner",)], "f string").select(report.rationale_kind(F.col("f")).alias("k"))
    assert [r.k for r in kinds.collect()] == ["term weight", "log scale", "interaction", "entities"]


def test_sources(spark, tmp_path):
    (tmp_path / "housing.csv").write_text("a,b,price\n1,x,2.5\n2,y,3.5\n")
    data = io.read_csv(spark, str(tmp_path / "housing.csv"), "housing", str(tmp_path / "none.json"))
    assert (data.features, data.label, data.task, data.meta) == (["a", "b"], "price", "regression", {})
    (tmp_path / "log.jsonl").write_text('{"step": 1, "score": 0.5, "ok": true}\n\nbroken{\n{"__summary__": true, "best_score": 0.5}\n')
    assert io.read_log(spark, str(tmp_path / "log.jsonl")).count() == 2
    (tmp_path / "r.json").write_text(json.dumps({"base": {"per_fold": {"rf": [{"accuracy": 0.5}, {"accuracy": 0.7}]}}}))
    assert {tuple(r) for r in io.folds_from_results(spark, str(tmp_path / "r.json")).collect()} == {("base", "rf", 0, "accuracy", 0.5), ("base", "rf", 1, "accuracy", 0.7)}
    for name, program in (("a", "p"), ("b", "")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "best.json").write_text(json.dumps({"dataset": "d", "best_program": program}))
    assert [r.folder for r in io.read_runs(spark, str(tmp_path / "*/best.json"), "d").collect()] == ["a"]
    io.write_table(data.df, str(tmp_path / "t"))
    kept = io.read_parquet(spark, str(tmp_path / "t"), {"feature_columns": ["a"], "target_column": "price"}, "t")
    assert kept.df.columns == ["row_id", "a", "price"]


def test_run_folders(spark, tmp_path):
    rows = spark.createDataFrame([(k // 2 if k < 4 else k, "d", f"p{k}\n", k / 4) for k in range(120)] + [(None, "d", "null", 0.5), (900, "other", "q", 0.5), (901, "d", " ", 0.5)], "run long, dataset string, best_program string, best_score double").coalesce(2)
    io.write_runs(rows.withColumnRenamed("run", "run_id"), "run_id", f"file://{tmp_path}/runs")
    for name, text in (("array of two", '[{"dataset": "d",\n "best_program": "x"},\n {"dataset": "d", "best_program": "y"}]'), ("broken", '{"dataset": "d", "best_pro')):
        (tmp_path / "runs" / name).mkdir()
        (tmp_path / "runs" / name / "best.json").write_text(text)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("run folders", "")
    found = io.read_runs(spark, f"{tmp_path}/runs/*/*.json", "d").collect()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted((r.best_program, r.best_score) for r in found if r.best_score is not None) == sorted([(f"p{k}\n", k / 4) for k in range(120)] + [("null", 0.5)])
    assert sorted((r.best_program, r.folder) for r in found if r.best_score is None) == [("x", "array of two"), ("y", "array of two")]
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("run folders") for s in tracker.getJobInfo(j).stageIds]
    assert sum(s.numTasks for s in stages if s) < 120  # a folder to list isn't a task


def test_streams(spark, sf_dir, tmp_path):
    from featherloom.streaming import curve

    path = f"{sf_dir}/run_log.parquet"
    schema = spark.read.parquet(path).schema
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "part.parquet").write_bytes(open(path, "rb").read())
    stream = curve.log_stream(spark, str(tmp_path / "in"), schema)
    for name, df, mode in (("best_stream", curve.running_best(stream), "update"), ("window_stream", curve.windowed(stream.withColumn("at", F.col("logged_at").cast("timestamp")), "at", ["run_id"]), "complete"), ("once_stream", curve.once(stream.withColumn("at", F.col("logged_at").cast("timestamp")), ["run_id", "step"], "at"), "append")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    rows = spark.read.parquet(path)
    want = {r.run_id: (r.n, r.best) for r in rows.groupBy("run_id").agg(F.count("*").alias("n"), F.max("score").alias("best")).collect()}
    got = {r.run_id: (r.n, r.best) for r in spark.table("best_stream").collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and (got[k][1] == want[k][1] or want[k][1] is None) for k in want)
    assert spark.table("window_stream").agg(F.sum("n")).first()[0] == rows.count()
    assert spark.table("once_stream").count() == rows.select("run_id", "step").distinct().count()


def test_booster_gives_probabilities(spark):
    from pyspark.ml.classification import GBTClassifier, OneVsRest

    from featherloom.operators import evaluate

    rng = random.Random(1)
    rows = [(i, k := i % 3, k + rng.gauss(0, 0.3), rng.gauss(0, 1), (i // 3) % 2) for i in range(120)]
    df = spark.createDataFrame(rows, "row_id long, y int, a double, b double, fold int")
    small = {"gbt": lambda rows=None: OneVsRest(classifier=GBTClassifier(maxIter=3, maxDepth=2, seed=1))}
    found = {(r.metric, r.fold): r.value for r in evaluate.cross_validate(df, ["a", "b"], "y", "row_id", small).collect()}
    assert set(found) == {(m, f) for m in ("accuracy", "macro_f1", "auc", "log_loss") for f in (0, 1)}
    assert all(found["auc", f] > 0.9 and 0 < found["log_loss", f] < 1 for f in (0, 1))
    assert evaluate.proxy_score(df.drop("fold"), ["a", "b"], "y", "row_id", trees=5, depth=3) > 0.8
    assert evaluate.proxy_score(df.drop("fold"), ["b"], "a", "row_id", task="regression", trees=5, depth=3) < 0


def test_values_are_dealt(spark):
    from featherloom.operators import evaluate

    df = spark.createDataFrame([(i, float(i % 2), float(i % 5)) for i in range(400)], "row_id long, y double, other double").withColumn("x", F.col("y"))
    found = {r.feature: r["drop"] for r in evaluate.permutation_importance(lambda f: f.withColumn("predicted", F.col("x")), df, ["x", "other"], "y", "row_id").collect()}
    assert found["other"] == 0 and 0.3 < found["x"] < 0.7


def test_blocks_and_examples(spark):
    df = spark.createDataFrame([(1, "b", 2.0, None), (2, "a", 5.0, None), (3, "b", None, None)], "i long, kind string, x double, gone string")
    assert [r.line for r in report.feature_block(df, "i", {"x": "a size"}).orderBy("place").collect()] == ["kind (kind): one of b / a", "x (a size): from 2.0 to 5.0", "gone (gone): one of "]
    assert {r.text for r in report.example_rows(df, "i", "kind").collect()} == {"x = 2.0 -> b", "x = 5.0 -> a", " -> b"}
    wide = spark.createDataFrame([(1, *range(30)), (2, *[k * k for k in range(30)])], "i long, " + ", ".join(f"{'tfidf_' if k < 5 else ''}c{k} int" for k in range(30)))
    assert report.telling_columns(wide, ["i"]) == [f"c{k}" for k in range(29, 9, -1)]
    merged = report.merged_scores(*[spark.createDataFrame(x, "method string, fold int, value double") for x in ([("a", 0, 1.0), ("b", 0, 1.0)], [("a", 0, 2.0), ("a", 1, 3.0)])])
    assert {tuple(r) for r in merged.collect()} == {("a", 0, 2.0), ("a", 1, 3.0), ("b", 0, 1.0)}


def test_tfidf_by_row_and_by_join(spark, monkeypatch):
    from featherloom.operators import tfidf

    df = spark.createDataFrame([(1, "red card red"), (2, "blue card"), (3, None), (4, "the the")], "i long, t string")
    model = tfidf.fit_tfidf(df, "i", "t", 3, ["the"])
    assert model.n == 4 and model.terms == [("card", 2, 2), ("red", 2, 1), ("blue", 1, 1)]
    here = {(r.id, r.term): r.weight for r in model.weights(df, "i", "t").collect()}
    assert sum(w * w for (i, _), w in here.items() if i == 1) == pytest.approx(1) and set(here) == {(1, "red"), (1, "card"), (2, "blue"), (2, "card")}
    monkeypatch.setattr(tfidf, "LOCAL_TERMS", 0)
    assert {(r.id, r.term): r.weight for r in model.weights(df, "i", "t").collect()} == pytest.approx(here)
    assert model.wide(df, "i", "t").columns == ["id", "tfidf_blue", "tfidf_card", "tfidf_red"] and model.wide(df, "i", "t").count() == 4
    assert tfidf.fit_tfidf(df.limit(0), "i", "t").weights(df, "i", "t").count() == 0


def test_each_classifier_has_its_own_size(spark):
    from featherloom.operators import evaluate

    for classes, sizes in ((49, (200, 2000, 300)), (50, (120, 800, 150))):
        made = {name: make() for name, make in evaluate.classifiers(classes).items()}
        assert (made["gbt"].getClassifier().getMaxIter(), made["logreg"].getMaxIter(), made["rf"].getNumTrees()) == sizes


def test_forest_in_tasks(spark, monkeypatch):
    from pyspark.ml.classification import RandomForestClassifier

    from featherloom.operators import evaluate, forest

    df = spark.range(3000).selectExpr("id", "(id * 7919 % 1000) / 10.0 AS a", "cast(id * 31 % 17 AS double) AS b", "cast(id % 2 AS double) AS c", "cast(id % 5 AS int) AS fold").withColumn("y", F.expr("cast(CASE WHEN id % 19 = 0 THEN id % 3 WHEN a > 60 THEN 2 WHEN b > 8 THEN 1 ELSE 0 END AS double)"))
    model = {"rf": lambda rows=None: RandomForestClassifier(numTrees=30, maxDepth=5, minInstancesPerNode=2, seed=1)}
    score = lambda **given: {r.metric: r.value for r in evaluate.cross_validate(df, ["a", "b", "c"], "y", "id", model, **given).groupBy("metric").agg(F.avg("value").alias("value")).collect()}
    own = score(in_tasks=False, folds=[0])
    with monkeypatch.context() as m:
        m.setattr(RandomForestClassifier, "fit", None)
        found = score(folds=[0])
    assert abs(found["accuracy"] - own["accuracy"]) < 0.03 and abs(found["log_loss"] - own["log_loss"]) < 0.05
    monkeypatch.setattr(forest, "MOST_BYTES", 100)  # a larger table is MLlib's
    assert score(folds=[0])["accuracy"] == own["accuracy"]


def test_forest_trees():
    import numpy as np

    from featherloom.operators import forest

    assert forest.cut_points(np.array([0.0, 0, 0, 1, 3]), 32).tolist() == [0.5, 2.0]
    assert len(forest.cut_points(np.arange(1000.0), 32)) == 31
    bins = np.array([[0, 0, 0, 0, 1, 1, 1, 1] * 50])
    trees = [forest.grow((bins * 2 + bins).astype(np.uint8), [2], 2, 1, 3, 2, [42, k]) for k in range(3)]
    assert forest.votes(np.array([[0, 1]]), trees).tolist() == [[1.0, 0.0], [0.0, 1.0]]
