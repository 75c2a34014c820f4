"""Models that are searched, compared, weighed and saved."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from prepforge.operators import search, train
from prepforge.operators.encode import fit_model_inputs


@pytest.fixture(scope="module")
def classes(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(-1, 1, (90, 2)), rng.normal(1, 0.7, (60, 2))])
    return spark.createDataFrame(pd.DataFrame({"id": range(150), "a": x[:, 0], "b": x[:, 1], "y": ["no"] * 90 + ["yes"] * 60}))


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (120, 3)) * [1, 5, 0.2]
    return spark.createDataFrame(pd.DataFrame({"id": range(120), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": 3 * x[:, 0] - 0.4 * x[:, 1] + rng.normal(0, 0.5, 120)}))


def refitted(name, rows, inputs, task, labels, choices, folds):
    """Scores by fitting and judging every fold anew."""
    out = []
    for p in choices:
        total = count = 0
        for f in range(folds):
            model = train.fit_model(name, rows.where(F.col("fold") != f).drop("fold"), inputs, "id", task, labels, p)
            s, n = search.mean_score(model.transform(rows.where(F.col("fold") == f).drop("fold")), task)
            total, count = total + s, count + n
        out.append(total / count)
    return out


def folded(df, features, target, task, folds, scaling):
    rows, features, labels = train.training_rows(df, features, target, task)
    inputs = fit_model_inputs(rows, features, scaling)
    rows = search.settle(search.with_folds(rows, "id", folds, "label" if labels else None))
    shaped = inputs.transform(rows).select("id", F.array(*[F.col(f"`{n}`") for n in inputs.add]).alias("v"), "label", "fold")
    return rows, inputs, labels, search.settle(shaped)


def test_folds_are_stratified(classes):
    rows = search.with_folds(classes, "id", 5, "y").groupBy("y", "fold").count().collect()
    assert {(r["y"], r["fold"]): r["count"] for r in rows} == {(y, f): n for y, n in (("no", 18), ("yes", 12)) for f in range(5)}


@pytest.mark.parametrize("name", ["ridge", "lasso"])
def test_gram_scores_equal_refitting(numbers, name):
    rows, inputs, _, shaped = folded(numbers, ["a", "b", "c"], "y", "regression", 4, "standard")
    alphas = [0.05, 1.0, 20.0]
    got = search.linear_scores(shaped, 4, alphas, name == "lasso")
    assert got == pytest.approx(refitted(name, rows, inputs, "regression", [], [{"alpha": a} for a in alphas], 4), rel=1e-4)


def test_class_sums_equal_refitting(classes):
    rows, inputs, labels, shaped = folded(classes, ["a", "b"], "y", "classification", 5, "none")
    smoothings, priors = [1e-9, 0.5, 20.0], [True, False]
    got = search.gaussian_scores(shaped, 5, 2, smoothings, priors)
    choices = [{"var_smoothing": s, "fit_prior": p} for s in smoothings for p in priors]
    assert got == pytest.approx(refitted("naive_bayes", rows, inputs, "classification", labels, choices, 5))


@pytest.mark.parametrize("task", ["classification", "regression"])
def test_one_neighbour_list_equals_refitting(classes, numbers, task):
    df, features, name = (classes, ["a", "b"], "knn_classifier") if task == "classification" else (numbers, ["a", "b", "c"], "knn_regressor")
    rows, inputs, labels, shaped = folded(df, features, "y", task, 3, "robust")
    choices = list(itertools.product([1, 4], ["uniform", "distance"]))
    got = search.neighbor_scores(shaped, 3, task, choices, "euclidean")
    assert got == pytest.approx(refitted(name, rows, inputs, task, labels, [{"k": k, "weights": w} for k, w in choices], 3))


def test_every_model_takes_a_grid(classes, numbers):
    small = {"logistic_regression": {"C": [0.1, 1.0]}, "decision_tree": {"max_depth": [1, 3], "criterion": ["gini", "entropy"]}, "random_forest_classifier": {"n_estimators": [3], "max_features": ["all", "sqrt"]},
             "gradient_boosting_classifier": {"n_estimators": [2, 3]}, "naive_bayes": {"kind": ["gaussian", "bernoulli"]}, "svm_classifier": {"kernel": ["linear", "rbf"], "max_iter": [5], "width": [16]},
             "knn_classifier": {"k": [1, 5]}, "svr": {"C": [0.1, 1], "kernel": ["linear"], "steps": [5]}, "lasso": {"alpha": [0.01, 1.0]}, "knn_regressor": {"k": [3], "weights": ["uniform", "distance"]},
             "random_forest_regressor": {"n_estimators": [3], "max_features": ["third"]}}
    for name, grid in small.items():
        df = classes if name in train.CLASSIFIERS else numbers
        model = train.train(name, df, [c for c in df.columns if c not in ("id", "y")], "y", "id", grid=grid, folds=2)
        row = model.metrics().head()
        assert row["rows"] > 0 and (name not in train.CLASSIFIERS or row["accuracy"] > 0.7), name
        if name in train.CLASSIFIERS:
            assert 0.7 < row["auc"] <= 1 and model.confusion().agg(F.sum("count")).head()[0] == row["rows"], name
    with pytest.raises(ValueError, match="no parameters"):
        train.train("ridge", numbers, ["a"], "y", "id", grid={"beta": [1]})
    with pytest.raises(ValueError, match="no parameters"):
        train.train("decision_tree", classes, ["a"], "y", "id", {"depth": 3})


def test_neighbour_models_are_saved_compared_and_ask_without_a_key(spark, classes, tmp_path):
    model = train.train("knn_classifier", classes, ["a", "b"], "y", "id", {"k": 3, "weights": "distance"})
    model.save(str(tmp_path / "m"))
    new = spark.createDataFrame([(-1.0, -1.0, "u"), (1.0, 1.0, "v"), (1.0, 1.0, "w"), (None, float("nan"), "x")], "a double, b double, tag string")
    got = {r["tag"]: (r["predicted_label"], r["score"]) for r in model.predict(new).collect()}
    again = {r["tag"]: (r["predicted_label"], r["score"]) for r in train.load_model(str(tmp_path / "m")).transform(new).collect()}
    assert got == again and got["u"][0] == "no" and got["v"] == got["w"] and got["v"][0] == "yes" and set(got) == {"u", "v", "w", "x"}
    table = train.train_selected(["knn_classifier", "logistic_regression"], classes, ["a", "b"], "y", "id", {"knn_classifier": {"k": 3}})
    assert {r["model"] for r in table.where("metric = 'auc'").collect()} == {"knn_classifier", "logistic_regression"}


def test_class_weights_move_the_boundary(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 1, 380), rng.normal(1.5, 1, 20)])
    df = spark.createDataFrame(pd.DataFrame({"id": range(400), "x": x, "y": [0] * 380 + [1] * 20}))
    plain, balanced = (train.train("logistic_regression", df, ["x"], "y", "id", p).predict(df).where("predicted_label = '1'").count() for p in ({}, {"class_weight": "balanced"}))
    assert plain < 20 < balanced


def test_tree_of_depth_one_and_importances(spark):
    df = spark.createDataFrame([(i, float(i) + 9.0 * (i >= 60), float(i * 7 % 11), "hi" if i >= 60 else "lo") for i in range(200)], "id bigint, x double, z double, y string")
    tree = train.train("decision_tree", df, ["x", "z"], "y", "id", {"max_depth": 1, "max_bins": 200})
    assert tree.predict(df).where("(x >= 60) <> (predicted_label = 'hi')").count() == 0
    shares = {r["feature"]: r["importance"] for r in train.feature_importance(tree, spark).collect()}
    assert sum(shares.values()) == pytest.approx(1.0) and shares["x"] == pytest.approx(1.0)
