"""Splits, supervised models and prediction.

Preprocessing is fitted on the training rows as a column projection and travels inside the Spark ML
model, so ``predict`` and a saved model take raw tables.
"""

from __future__ import annotations

import json
import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier,
)
from pyspark.ml.feature import PolynomialExpansion, SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.frame import (
    col, dtype_of, facts_frame, finite, is_numeric, literal_sql, lookup, need_columns, need_numeric, number_sql, quote, settle,
)
from . import evaluate, search
from .encode import fit_model_inputs
from .knn_model import KnnModel, vote
from .neighbors import nearest_neighbors

MAX_CLASSES = 1000
MAX_TREE_DEPTH = 30


# -- split -------------------------------------------------------------------------------------

def mark_test(df: DataFrame, key: str, test: float = 0.2, seed: int = 42, stratify: str | None = None) -> DataFrame:
    """Add ``is_test``: the ceil(test * n) rows with the smallest md5 of seed and key, per class if stratified.

    Counts per class and 4-digit hash prefix locate the cut; only the rows of the cut prefix are
    ranked.  The table itself is compared with the cut, not shuffled.
    """
    h = F.md5(F.concat(F.lit(f"{seed}|"), col(key).cast("string")))
    group = F.coalesce(col(stratify).cast("string"), F.lit("NULL")) if stratify else F.lit("all")
    hashed = df.withColumns({"__g": group, "__h": h})
    rows = hashed.select("__g", "__h", F.substring("__h", 1, 4).alias("p"))
    per = rows.groupBy("__g", "p").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("__g").orderBy("p")  # at most 65,536 prefixes per class
    cum = per.withColumn("upto", F.sum("n").over(w)).withColumn("size", F.sum("n").over(Window.partitionBy("__g")))
    target = F.ceil(F.lit(float(test)) * F.col("size"))
    cut = cum.where((F.col("upto") >= target) & (F.col("upto") - F.col("n") < target)).select("__g", "p", (target - F.col("upto") + F.col("n")).alias("need"))
    inside = rows.join(F.broadcast(cut), ["__g", "p"])  # one prefix per class
    rank = F.row_number().over(Window.partitionBy("__g").orderBy("__h"))
    edge = inside.withColumn("r", rank).where("r = need").select("__g", F.col("__h").alias("__edge"))
    marked = lookup(hashed, edge, "__g")
    return marked.withColumn("is_test", F.coalesce(F.col("__h") <= F.col("__edge"), F.lit(False))).drop("__g", "__h", "__edge")


def split(df: DataFrame, key: str, test: float = 0.2, seed: int = 42, stratify: str | None = None) -> tuple[DataFrame, DataFrame]:
    marked = mark_test(df, key, test, seed, stratify)
    return marked.where(~F.col("is_test")).drop("is_test"), marked.where("is_test").drop("is_test")


def class_weights(df: DataFrame, target: str) -> DataFrame:
    """(class, count, weight) with weight = rows / (classes * count)."""
    counts = df.where(col(target).isNotNull()).groupBy(col(target).alias("class")).agg(F.count(F.lit(1)).alias("count"))
    total = counts.agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("k"))
    return counts.crossJoin(F.broadcast(total)).select("class", "count", (F.col("n") / (F.col("k") * F.col("count"))).alias("weight"))


def with_class_weights(df: DataFrame, target: str) -> DataFrame:
    return lookup(df, class_weights(df, target).select(F.col("class").alias(target), "weight"), target)


# -- checks ------------------------------------------------------------------------------------

def check_training_input(df: DataFrame, features: list[str], target: str | None, model: str = "") -> DataFrame:
    """(check, detail) for every rule that is broken."""
    bad = [("unknown feature", f) for f in features if f not in df.columns]
    if not features:
        bad.append(("no features", ""))
    if target is not None:
        if target not in df.columns:
            bad.append(("unknown target", target))
        elif target in features:
            bad.append(("target among the features", target))
    if target in df.columns:
        if model.endswith("regressor") or model in ("linear", "ridge", "lasso", "svr"):
            if not is_numeric(dtype_of(df, target)):
                bad.append(("target is not numeric", target))
        elif df.select(col(target)).where(col(target).isNotNull()).distinct().limit(2).count() < 2:
            bad.append(("fewer than two classes", target))
    least = 10 if model in ("naive_bayes", "dbscan") else 5
    if df.limit(least).count() < least:
        bad.append((f"fewer than {least} rows", ""))
    return facts_frame(df.sparkSession, bad, "check string, detail string")


# -- the trained model -------------------------------------------------------------------------

@dataclass
class Trained:
    name: str
    task: str
    features: list[str]
    target: str
    model: PipelineModel | DecodedModel
    labels: list = field(default_factory=list)
    inputs: list[str] = field(default_factory=list)
    test: DataFrame | None = None

    def predict(self, df: DataFrame) -> DataFrame:
        """Score raw rows: ``prediction``, with ``predicted_label`` and ``score`` for classes."""
        out = self.model.transform(df)
        if self.task == "classification" and "score" not in out.columns and len(self.labels) == 2:
            margin = next((c for c in ("probability", "rawPrediction") if c in out.columns), None)
            if margin:  # a probability, or the decision value of a support vector machine
                out = out.withColumn("score", F.get(vector_to_array(margin), F.lit(1)))
        gone = [c for c in out.columns if c not in df.columns and c not in ("prediction", "predicted_label", "score")]
        return out.drop(*gone)

    def metrics(self, df: DataFrame | None = None) -> DataFrame:
        scored = self.predict(df if df is not None else self.test)
        if self.task == "regression":
            return evaluate.regression_metrics(scored, self.target, "prediction", len(self.features))
        scored = settle(scored.select(col(self.target).cast("string").alias("y"), F.col("predicted_label").alias("p"), *[c for c in ("score",) if c in scored.columns]))
        positive = str(self.labels[1]) if len(self.labels) == 2 else ""
        out = evaluate.classification_scores(scored, "y", "p", positive)
        if "score" in scored.columns:
            out = out.crossJoin(F.broadcast(evaluate.auc(scored, "y", "score", positive).select("auc")))  # one row each
        return out

    def confusion(self, df: DataFrame | None = None) -> DataFrame:
        """(actual, predicted, count) of the test rows or of given ones."""
        scored = self.predict(df if df is not None else self.test)
        return evaluate.confusion_matrix(scored.select(col(self.target).cast("string").alias("y"), F.col("predicted_label").alias("p")), "y", "p")

    def save(self, path: str) -> None:
        """The model below a path that all machines share; ``load_model`` reads it."""
        self.model.save(path)


def load_model(path: str):
    """A saved model: ``transform`` takes raw tables."""
    spark = SparkSession.active()
    try:
        return DecodedModel.load(spark, path)
    except AnalysisException:  # no facts file there: a Spark ML pipeline
        return PipelineModel.load(path)


@dataclass
class DecodedModel:
    """A nearest-neighbour model with the names of its classes."""

    model: KnnModel
    labels: list

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.model.transform(df)
        return decode_stage(self.labels).transform(out) if self.labels else out

    def save(self, path: str) -> None:
        self.model.save(path)
        spark = SparkSession.active()
        spark.createDataFrame([(json.dumps([str(v) for v in self.labels]),)], "value string").coalesce(1).write.text(f"{path}/labels")

    @staticmethod
    def load(spark: SparkSession, path: str) -> DecodedModel:
        return DecodedModel(KnnModel.load(spark, path), json.loads(spark.read.text(f"{path}/labels").head()[0]))


def training_rows(df: DataFrame, features: list[str], target: str, task: str) -> tuple[DataFrame, list[str], list]:
    """Rows with a usable target and a ``label`` column; unknown features dropped; classes sorted."""
    features = [f for f in features if f in df.columns and f != target]
    if not features:
        raise ValueError("no usable features")
    need_columns(df, [target])
    if task == "regression":
        need_numeric(df, [target])
        rows = df.withColumn("label", finite(df, target)).where("label IS NOT NULL")
        labels: list = []
    else:
        words = df.select(col(target)).where(col(target).isNotNull()).distinct().limit(MAX_CLASSES + 1).collect()
        labels = sorted(r[0] for r in words)
        if not 2 <= len(labels) <= MAX_CLASSES:
            raise ValueError(f"{target} must have between 2 and {MAX_CLASSES} classes")
        whens = " ".join(f"WHEN {quote(target)} = {literal_sql(v)} THEN {number_sql(i)}" for i, v in enumerate(labels))
        rows = df.withColumn("label", F.expr(f"CASE {whens} END")).where("label IS NOT NULL")
    if rows.limit(5).count() < 5:
        raise ValueError("fewer than 5 usable rows")
    return rows, features, labels


def decode_stage(labels: list) -> SQLTransformer:
    words = ", ".join(literal_sql(str(v)) for v in labels)
    return SQLTransformer(statement=f"SELECT *, element_at(array({words}), CAST(prediction AS INT) + 1) AS predicted_label FROM __THIS__")


def scalar_stage(name: str, text: str) -> SQLTransformer:
    return SQLTransformer(statement=f"SELECT *, {text} AS {quote(name)} FROM __THIS__")


def depth_of(value) -> int:
    if value is not None and int(value) > MAX_TREE_DEPTH:
        raise ValueError(f"trees have at most {MAX_TREE_DEPTH} levels, not {value}")
    return MAX_TREE_DEPTH if value is None else int(value)


def subset_of(value) -> str:
    """Share or number of the inputs a split looks at; None means all."""
    return "all" if value is None else "onethird" if value == "third" else str(value)


def fourier_stage(inputs: list[str], gamma: float, width: int, seed: int = 42) -> tuple[SQLTransformer, list[str]]:
    """Random cosine features whose inner products approximate the radial kernel (Rahimi and Recht, 2007)."""
    rng = np.random.default_rng(seed)
    w = rng.normal(0.0, math.sqrt(2 * gamma), (width, len(inputs)))
    b = rng.uniform(0.0, 2 * math.pi, width)
    names = [f"rff_{i}" for i in range(width)]
    scale = math.sqrt(2.0 / width)
    items = [f"{number_sql(scale)} * cos({' + '.join(f'{number_sql(a)} * {quote(x)}' for a, x in zip(w[i], inputs))} + {number_sql(b[i])}) AS {names[i]}" for i in range(width)]
    return SQLTransformer(statement=f"SELECT *, {', '.join(items)} FROM __THIS__"), names


def kernel_gamma(train: DataFrame, inputs: list[str], gamma) -> float:
    """``scale`` = 1 / (columns * variance of all inputs), ``auto`` = 1 / columns."""
    if gamma == "auto":
        return 1.0 / len(inputs)
    if gamma != "scale":
        return float(gamma)
    row = train.agg(*[F.avg(col(c)).alias(f"m{i}") for i, c in enumerate(inputs)], *[F.avg(col(c) * col(c)).alias(f"q{i}") for i, c in enumerate(inputs)]).head()
    d = len(inputs)
    mean = sum(row[f"m{i}"] for i in range(d)) / d
    var = sum(row[f"q{i}"] for i in range(d)) / d - mean * mean
    return 1.0 / (d * var) if var > 0 else 1.0


# Default search grids.
GRIDS = {
    "logistic_regression": {"C": [0.1, 1, 10], "max_iter": [100, 200]},
    "decision_tree": {"max_depth": [None, 5, 10], "min_samples_leaf": [1, 5, 10], "criterion": ["gini", "entropy"]},
    "random_forest_classifier": {"n_estimators": [50, 100, 200], "max_depth": [5, 10, 15, None], "min_samples_leaf": [1, 2, 4]},
    "random_forest_regressor": {"n_estimators": [50, 100, 200], "max_depth": [5, 10, 15, None], "min_samples_leaf": [1, 2, 4]},
    "gradient_boosting_classifier": {"n_estimators": [100, 200, 300], "learning_rate": [0.01, 0.1, 0.2], "max_depth": [3, 5, 7]},
    "xgb_style_classifier": {"n_estimators": [100, 200, 300], "learning_rate": [0.01, 0.1, 0.2], "max_depth": [3, 5, 7], "min_child_weight": [1, 3, 5], "gamma": [0, 0.1, 0.2]},
    "xgb_style_regressor": {"n_estimators": [100, 200, 300], "learning_rate": [0.01, 0.1, 0.2], "max_depth": [3, 5, 7], "min_child_weight": [1, 3, 5], "gamma": [0, 0.1, 0.2]},
    "gradient_boosting_regressor": {"n_estimators": [100, 200, 300, 500], "learning_rate": [0.01, 0.05, 0.1, 0.2], "max_depth": [3, 4, 5, 6], "min_samples_leaf": [10, 20, 40]},
    "knn_classifier": {"k": [1, 3, 5, 7, 9, 11], "weights": ["uniform", "distance"]},
    "knn_regressor": {"k": [1, 3, 5, 7, 9, 11], "weights": ["uniform", "distance"]},
    "svr": {"C": [0.1, 1, 10], "kernel": ["rbf", "linear"], "epsilon": [0.1, 0.2]},
    "dbscan": {"eps": [0.3, 0.5, 0.7, 1.0], "min_samples": [3, 5, 7, 10]},
}

_TREE = {"max_depth", "min_samples_leaf", "max_bins", "seed", "class_weight"}
_BOOST = {"n_estimators", "learning_rate", "max_depth", "subsample", "max_bins", "seed", "class_weight"}
# Parameters of each model; any other name is an error.
PARAMETERS = {
    "logistic_regression": {"C", "max_iter", "class_weight"},
    "decision_tree": _TREE | {"criterion"},
    "random_forest_classifier": _TREE | {"n_estimators", "max_features"},
    "random_forest_regressor": _TREE - {"class_weight"} | {"n_estimators", "max_features"},
    "gradient_boosting_classifier": _BOOST, "xgb_style_classifier": _BOOST | {"gamma", "min_child_weight"},
    "gradient_boosting_regressor": _BOOST - {"class_weight"} | {"min_samples_leaf", "l2_regularization"}, "xgb_style_regressor": _BOOST - {"class_weight"} | {"gamma", "min_child_weight"},
    "naive_bayes": {"kind", "var_smoothing", "alpha", "fit_prior", "binarize"},
    "svm_classifier": {"C", "kernel", "gamma", "degree", "width", "max_iter", "class_weight"},
    "svr": {"C", "kernel", "gamma", "epsilon", "steps", "width"},
    "linear": set(), "ridge": {"alpha"}, "lasso": {"alpha"},
    "knn_classifier": {"k", "weights", "metric"}, "knn_regressor": {"k", "weights", "metric"},
}
SCALING = {"knn_classifier": "robust", "knn_regressor": "robust", "logistic_regression": "robust", "svm_classifier": "robust", "svr": "robust", "ridge": "standard", "lasso": "standard", "gradient_boosting_regressor": "standard"}
REGRESSORS = ("linear", "ridge", "lasso", "random_forest_regressor", "gradient_boosting_regressor", "xgb_style_regressor", "svr", "knn_regressor")
CLASSIFIERS = ("logistic_regression", "decision_tree", "random_forest_classifier", "gradient_boosting_classifier", "xgb_style_classifier", "naive_bayes", "svm_classifier", "knn_classifier")


def estimator_for(name: str, p: dict, n: int, classes: int, y_std: float, seed: int = 42):
    """The Spark ML estimator of a model with the caller's parameter names."""
    trees = dict(seed=p.get("seed", seed), maxBins=p.get("max_bins", 32))
    boost = dict(maxIter=p.get("n_estimators", 100), stepSize=p.get("learning_rate", 0.1), maxDepth=depth_of(p.get("max_depth", 3)), subsamplingRate=p.get("subsample", 1.0), **trees)
    if name == "logistic_regression":
        return LogisticRegression(regParam=1.0 / (p.get("C", 1.0) * n), standardization=False, maxIter=p.get("max_iter", 100))
    if name == "decision_tree":
        return DecisionTreeClassifier(maxDepth=depth_of(p.get("max_depth")), minInstancesPerNode=p.get("min_samples_leaf", 1), impurity=p.get("criterion", "gini"), **trees)
    if name in ("random_forest_classifier", "random_forest_regressor"):
        kind = RandomForestClassifier if name.endswith("classifier") else RandomForestRegressor
        return kind(numTrees=p.get("n_estimators", 100), maxDepth=depth_of(p.get("max_depth", 10)), minInstancesPerNode=p.get("min_samples_leaf", 1),
                    featureSubsetStrategy=subset_of(p.get("max_features", "sqrt" if name.endswith("classifier") else None)), **trees)
    if name in ("gradient_boosting_classifier", "xgb_style_classifier"):
        extra = dict(minInfoGain=p.get("gamma", 0.0), minInstancesPerNode=int(p.get("min_child_weight", 1))) if name.startswith("xgb") else {}
        gbt = GBTClassifier(**boost, **extra)
        return gbt if classes == 2 else OneVsRest(classifier=gbt, parallelism=2)
    if name == "xgb_style_regressor":
        return GBTRegressor(minInfoGain=p.get("gamma", 0.0), minInstancesPerNode=int(p.get("min_child_weight", 1)), **boost)
    if name == "gradient_boosting_regressor":
        if p.get("l2_regularization", 0):
            raise ValueError("l2_regularization has no counterpart here")
        boost.update(maxIter=p.get("n_estimators", 200), stepSize=p.get("learning_rate", 0.05))
        return GBTRegressor(minInstancesPerNode=p.get("min_samples_leaf", 20), **boost)
    if name == "linear":
        return LinearRegression(solver="normal", standardization=False)
    if name == "ridge":
        return LinearRegression(regParam=p.get("alpha", 1.0) * y_std / n, elasticNetParam=0.0, standardization=False, solver="normal")
    if name == "lasso":
        return LinearRegression(regParam=p.get("alpha", 1.0), elasticNetParam=1.0, standardization=False, maxIter=1000, tol=1e-9)
    if name == "svm_classifier":
        svc = LinearSVC(regParam=1.0 / (p.get("C", 1.0) * n), standardization=False, maxIter=p.get("max_iter", 100))
        return svc if classes == 2 else OneVsRest(classifier=svc, parallelism=2)
    raise ValueError(f"unknown model {name!r}; known: {CLASSIFIERS + REGRESSORS}")


def train(name: str, df: DataFrame, features: list[str], target: str, key: str, params: dict | None = None, test: float = 0.2,
          seed: int = 42, scale_on: str = "train", grid: dict | None = None, folds: int = 3) -> Trained:
    """Clean, split, fit on the training rows; the test rows stay a DataFrame on the result.

    ``scale_on='all'`` fits the preprocessing on all rows.  ``grid`` searches lists of parameter values over folds of
    the training rows, stratified for classes (``GRIDS`` holds usual ones).  Unknown parameters are an error.
    ``class_weight='balanced'`` weighs classes by their rareness.
    """
    p = dict(params or {})
    if name not in PARAMETERS:
        raise ValueError(f"unknown model {name!r}; known: {CLASSIFIERS + REGRESSORS}")
    if wrong := sorted({*p, *(grid or {})} - PARAMETERS[name]):
        raise ValueError(f"{name} has no parameters {wrong}; known: {sorted(PARAMETERS[name])}")
    task = "regression" if name in REGRESSORS else "classification"
    rows, features, labels = training_rows(df, features, target, task)
    part = mark_test(rows, key, test, seed, stratify=target if task == "classification" else None)
    part = settle(part.select(*dict.fromkeys([key, *features, target, "label", "is_test"])))
    train_rows, test_rows = part.where(~F.col("is_test")).drop("is_test"), part.where("is_test")
    fit_rows = part if scale_on == "all" else train_rows
    fill = "mean" if name == "gradient_boosting_classifier" else "median"
    inputs = fit_model_inputs(fit_rows, features, SCALING.get(name, "none"), drop_first=name != "gradient_boosting_regressor", numeric_fill=fill)
    if name.startswith("xgb"):
        inputs.add.update({f"x_{c}_missing": f"IF({quote(c)} IS NULL, 1.0D, 0.0D)" for c in inputs.facts["numeric"]})
    if grid:
        p.update(best_parameters(name, train_rows, inputs, key, task, labels, p, grid, folds, seed))
    model = fit_model(name, train_rows, inputs, key, task, labels, p, seed)
    return Trained(name, task, features, target, model, labels, list(inputs.add), test_rows.drop("is_test", "label"))


def fit_model(name: str, rows: DataFrame, inputs, key: str, task: str, labels: list, p: dict, seed: int = 42) -> PipelineModel | DecodedModel:
    """The model of given parameters on rows with ``label``."""
    names, stages = list(inputs.add), [inputs.stage()]
    if name.startswith("knn"):
        first = Pipeline(stages=stages).fit(rows)
        return DecodedModel(KnnModel.fit(first, names, rows, key, task, len(labels), **p), labels)
    if name == "naive_bayes":
        stages += naive_bayes_stages(inputs.transform(rows).select(*[col(x) for x in names], "label"), names, len(labels), **p)
    elif name == "svr":
        stages += svr_stages(inputs.transform(rows), names, p, seed)
    else:
        size = rows.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("label").alias("s")).head()
        columns, vector = names, "features"
        if name == "svm_classifier" and p.get("kernel", "rbf") == "rbf":
            g = kernel_gamma(inputs.transform(rows), names, p.get("gamma", "scale"))
            stage, columns = fourier_stage(names, g, p.get("width", 64), seed)
            stages.append(stage)
        stages.append(VectorAssembler(inputCols=columns, outputCol="features"))
        if name == "svm_classifier" and p.get("kernel") == "poly":
            stages.append(PolynomialExpansion(degree=p.get("degree", 3), inputCol="features", outputCol="expanded"))
            vector = "expanded"
        est = estimator_for(name, p, size["n"], len(labels), size["s"] or 1.0 if task == "regression" else 1.0, seed)
        est.setFeaturesCol(vector)
        if p.get("class_weight"):
            if p["class_weight"] != "balanced":
                raise ValueError("class_weight must be 'balanced'")
            rows = with_class_weights(rows, "label")
            est.setWeightCol("weight")
        stages.append(est)
    if task == "classification":
        stages.append(decode_stage(labels))
    return Pipeline(stages=stages).fit(rows)


def best_parameters(name: str, rows: DataFrame, inputs, key: str, task: str, labels: list, base: dict, grid: dict, folds: int, seed: int = 42) -> dict:
    """The combination of a grid with the best accuracy or squared error over the folds; ties go to the first."""
    names, choices = list(inputs.add), search.combinations(grid)
    folded = settle(search.with_folds(rows, key, folds, "label" if task == "classification" else None, seed))
    merged = [{**base, **c} for c in choices]
    shaped = inputs.transform(folded).select(col(key).alias("id"), F.array(*[col(x) for x in names]).alias("v"), "label", "fold")
    if name in ("ridge", "lasso"):
        scores = search.linear_scores(shaped, folds, [m.get("alpha", 1.0) for m in merged], name == "lasso")
    elif name.startswith("knn"):
        scores = search.neighbor_scores(settle(shaped), folds, task, [(m.get("k", 5), m.get("weights", "uniform")) for m in merged], base.get("metric", "euclidean"))
    elif name == "naive_bayes" and all(m.get("kind", "gaussian") == "gaussian" for m in merged):
        smoothings, priors = list(dict.fromkeys(m.get("var_smoothing", 1e-9) for m in merged)), list(dict.fromkeys(m.get("fit_prior", True) for m in merged))
        found = dict(zip(((s, f) for s in smoothings for f in priors), search.gaussian_scores(settle(shaped), folds, len(labels), smoothings, priors)))
        scores = [found[m.get("var_smoothing", 1e-9), m.get("fit_prior", True)] for m in merged]
    else:
        def held_out(job):
            m, f = job
            model = fit_model(name, folded.where(F.col("fold") != f).drop("fold"), inputs, key, task, labels, m, seed)
            return search.mean_score(model.transform(folded.where(F.col("fold") == f).drop("fold")), task)

        jobs = [(m, f) for m in merged for f in range(folds)]
        with ThreadPoolExecutor(4) as pool:  # small fits side by side; every fit is a Spark job
            found = list(pool.map(inheritable_thread_target(rows.sparkSession)(held_out), jobs))
        scores = [sum(h for h, _ in found[i:i + folds]) / max(1, sum(n for _, n in found[i:i + folds])) for i in range(0, len(found), folds)]
    best = int(np.argmax(scores) if task == "classification" else np.argmin(scores))
    return choices[best]


# -- naive Bayes -------------------------------------------------------------------------------

def naive_bayes_stages(data: DataFrame, names: list[str], classes: int, kind: str = "gaussian", var_smoothing: float = 1e-9,
                       alpha: float = 1.0, fit_prior: bool = True, binarize: float = 0.0) -> list:
    """Per-class counts, sums and variances from one aggregate; scoring is one column expression.

    Gaussian works on z-scores, multinomial on values shifted to be non-negative, Bernoulli on
    values above ``binarize``.
    """
    xs = [f"n{i}" for i in range(len(names))]
    if kind == "gaussian":
        r = data.agg(*[e for i, x in enumerate(names) for e in (F.avg(col(x)).alias(f"m{i}"), F.stddev_pop(col(x)).alias(f"s{i}"))]).head()
        shaped = [f"({quote(x)} - {number_sql(r[f'm{i}'])}) / {number_sql(r[f's{i}'] or 1.0)}" for i, x in enumerate(names)]
    elif kind == "multinomial":
        r = data.agg(*[F.min(col(x)).alias(f"m{i}") for i, x in enumerate(names)]).head()
        shaped = [f"greatest({quote(x)} - {number_sql(min(r[f'm{i}'], 0.0))}, 0.0D)" for i, x in enumerate(names)]
    elif kind == "bernoulli":
        shaped = [f"IF({quote(x)} > {number_sql(binarize)}, 1.0D, 0.0D)" for x in names]
    else:
        raise ValueError(f"unknown kind {kind!r}")
    stage = SQLTransformer(statement=f"SELECT *, {', '.join(f'{e} AS {x}' for e, x in zip(shaped, xs))} FROM __THIS__")
    flat = stage.transform(data)
    rows = flat.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *[e for x in xs for e in (F.avg(x).alias(f"a_{x}"), F.var_pop(x).alias(f"v_{x}"), F.sum(x).alias(f"s_{x}"))]).orderBy("label").collect()
    total = sum(r["n"] for r in rows)
    largest = 0.0
    if kind == "gaussian":
        spread = flat.agg(*[F.var_pop(x).alias(x) for x in xs]).head()
        largest = max(spread[x] for x in xs)
    scores = []
    for r in rows:
        prior = math.log(r["n"] / total) if fit_prior else -math.log(len(rows))
        if kind == "gaussian":
            var = {x: r[f"v_{x}"] + var_smoothing * largest for x in xs}
            terms = [f"0.5D * ({x} - {number_sql(r[f'a_{x}'])}) * ({x} - {number_sql(r[f'a_{x}'])}) / {number_sql(var[x])}" for x in xs]
            const = prior - 0.5 * sum(math.log(2 * math.pi * v) for v in var.values())
            scores.append(f"{number_sql(const)} - ({' + '.join(terms)})")
        elif kind == "multinomial":
            whole = sum(r[f"s_{x}"] + alpha for x in xs)
            scores.append(" + ".join([number_sql(prior), *[f"{x} * {number_sql(math.log((r[f's_{x}'] + alpha) / whole))}" for x in xs]]))
        else:
            p = {x: (r[f"s_{x}"] + alpha) / (r["n"] + 2 * alpha) for x in xs}
            scores.append(" + ".join([number_sql(prior), *[f"IF({x} > 0, {number_sql(math.log(p[x]))}, {number_sql(math.log(1 - p[x]))})" for x in xs]]))
    joint = scalar_stage("joint", f"array({', '.join(scores)})")
    weight = scalar_stage("odds", "transform(joint, s -> exp(s - array_max(joint)))")
    out = SQLTransformer(statement="SELECT *, CAST(array_position(joint, array_max(joint)) - 1 AS DOUBLE) AS prediction, "
                                   "element_at(odds, 2) / aggregate(odds, 0.0D, (a, x) -> a + x) AS score FROM __THIS__")
    return [stage, joint, weight, out]


# -- support vector regression -------------------------------------------------------------------

def svr_stages(data: DataFrame, names: list[str], p: dict, seed: int) -> list:
    """Linear epsilon-insensitive regression by sub-gradient steps, the radial kernel by cosine features.

    An approximation of the kernel solver.  Each step is one pass that returns one gradient vector
    per partition.
    """
    c, epsilon, steps = p.get("C", 1.0), p.get("epsilon", 0.1), p.get("steps", 60)
    stages, columns = [], names
    if p.get("kernel", "rbf") == "rbf":
        stage, columns = fourier_stage(names, kernel_gamma(data, names, p.get("gamma", "scale")), p.get("width", 64), seed)
        stages.append(stage)
        data = stage.transform(data)
    y = data.agg(F.avg("label").alias("m"), F.stddev_pop("label").alias("s"), F.count(F.lit(1)).alias("n")).head()
    y_mean, y_std, n = y["m"], y["s"] or 1.0, y["n"]
    flat = settle(data.select(F.array(*[col(x) for x in columns]).alias("x"), ((F.col("label") - F.lit(y_mean)) / F.lit(y_std)).alias("y")))
    margin = epsilon / y_std
    d = len(columns)
    w, b, mean_w, mean_b = np.zeros(d), 0.0, np.zeros(d), 0.0
    for t in range(steps):
        here_w, here_b = w, b

        def gradient(batches):
            total = np.zeros(d + 1)
            for pdf in batches:
                if len(pdf):
                    x = np.stack(pdf["x"].to_numpy())
                    r = pdf["y"].to_numpy() - x @ here_w - here_b
                    s = np.where(np.abs(r) > margin, -np.sign(r), 0.0)
                    total[:d] += s @ x
                    total[d] += s.sum()
            yield pd.DataFrame({"g": [total.tolist()]})

        parts = flat.mapInPandas(gradient, "g array<double>")
        g = np.array(parts.agg(*[F.sum(F.get("g", F.lit(i))).alias(f"g{i}") for i in range(d + 1)]).head()) / n
        rate = 1.0 / math.sqrt(t + 1.0)
        w = w - rate * (g[:d] + w / (c * n))
        b = b - rate * g[d]
        if t >= steps // 2:
            mean_w, mean_b = mean_w + w, mean_b + b
    share = steps - steps // 2
    w, b = mean_w / share * y_std, mean_b / share * y_std + y_mean
    text = " + ".join([number_sql(b), *[f"{number_sql(a)} * {quote(x)}" for a, x in zip(w, columns)]])
    return [*stages, scalar_stage("prediction", text)]


# -- nearest-neighbour models --------------------------------------------------------------------

def knn_predict(train_rows: DataFrame, query: DataFrame, key: str, features: list[str], target: str, k: int = 5, weights: str = "uniform",
                task: str = "classification", metric: str = "euclidean", scaling: str = "robust") -> DataFrame:
    """(query_id, prediction) by vote (ties to the smaller class) or (weighted) mean of the k nearest rows."""
    train_rows = train_rows.where(col(target).isNotNull())
    inputs = fit_model_inputs(train_rows, features, scaling)
    vector = F.array(*[F.expr(e) for e in inputs.add.values()]).alias("x")
    near = nearest_neighbors(query.select(col(key), vector), train_rows.select(col(key), vector), k, key, "x", metric)
    values = train_rows.select(col(key).alias("neighbor_id"), col(target).alias("value"))
    return vote(near.join(values, "neighbor_id"), weights, task)


# -- inspection and comparison -------------------------------------------------------------------

def _fitted(trained: Trained):
    return next(s for s in reversed(trained.model.stages) if not isinstance(s, (SQLTransformer, VectorAssembler)))


def feature_importance(trained: Trained, spark) -> DataFrame:
    """(feature, importance), descending, with the expanded input names."""
    values = _fitted(trained).featureImportances.toArray()
    rows = sorted(((n[2:], float(v)) for n, v in zip(trained.inputs, values)), key=lambda r: (-r[1], r[0]))
    return facts_frame(spark, rows, "feature string, importance double")


def coefficients_table(trained: Trained, spark) -> DataFrame:
    """(feature, coefficient, direction), by size; the intercept first."""
    m = _fitted(trained)
    rows = sorted(((n[2:], float(v)) for n, v in zip(trained.inputs, m.coefficients)), key=lambda r: (-abs(r[1]), r[0]))
    rows = [("(intercept)", float(m.intercept)), *rows]
    return facts_frame(spark, [(f, v, "Positive" if v > 0 else "Negative") for f, v in rows], "feature string, coefficient double, direction string")


def train_selected(models: list[str], df: DataFrame, features: list[str], target: str, key: str, params: dict | None = None) -> DataFrame:
    """(model, metric, value) for several models on one prepared, checkpointed table."""
    frame = settle(df.select(*dict.fromkeys([key, *features, target])))
    rows = []
    for name in models:
        use = [f for f in features if is_numeric(dtype_of(df, f))] if name in REGRESSORS else features
        result = train(name, frame, use, target, key, (params or {}).get(name)).metrics().head().asDict()
        rows += [(name, m, float(v)) for m, v in result.items() if isinstance(v, (int, float))]
    return facts_frame(df.sparkSession, rows, "model string, metric string, value double")


def predict(trained: Trained, df: DataFrame) -> DataFrame:
    return trained.predict(df)
