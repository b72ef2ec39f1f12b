import pytest

import __spark_entry__
from featherloom.plans import catalog

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_gives_what_sql_gives(name, same_as_sql):
    same_as_sql(catalog.queries()[name], SQL[name])


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() == 5


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["example_rows", "cv_ridge", "importance_topk"])
def test_queries_without_sql_run(name, spark, sf_dir):
    assert catalog.queries()[name](spark, sf_dir).count() > 0


@pytest.mark.parametrize("name, size, features", [("cv_logreg", 2000, 12), ("cv_forest", 300, 12), ("cv_ridge", None, 2)])
def test_cross_validation_is_whole(name, size, features, spark, sf_dir, monkeypatch):
    seen = []
    monkeypatch.setattr(catalog.evaluate, "cross_validate", lambda *given, **_: seen.append(given))
    catalog.queries()[name](spark, sf_dir)
    rows, columns, _, _, models = seen[0]
    assert {r.fold for r in rows.select("fold").distinct().collect()} == set(range(5)) and len(columns) == features
    (model,) = (make() for make in models.values())
    assert size in (None, model.getNumTrees() if name == "cv_forest" else model.getMaxIter())


@pytest.mark.parametrize("name, scores", [("lasso_topk", "lasso_scores"), ("importance_topk", "importance_scores")])
def test_selection_has_default_sizes(name, scores, spark, sf_dir, monkeypatch):
    given, whole = [], spark.createDataFrame([("a", 1.0)], "feature string, score double")
    monkeypatch.setattr(catalog.select, scores, lambda df, features, label, **options: given.append((features, options)) or whole)
    catalog.queries()[name](spark, sf_dir)
    assert given == [(catalog.LEX, {})]
