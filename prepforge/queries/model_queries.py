"""Splits, neighbours, models, clustering."""

from pyspark.sql import functions as F

from ..fixtures import FIXTURES
from ..functions.frame import rounded, settled_path
from ..operators import cluster, evaluate, neighbors, train
from .registry import fx, query, r

# -- split and weights -------------------------------------------------------------------------


def _split(source: str, key: str, strata: str = "") -> str:
    part = f"PARTITION BY {strata} " if strata else ""
    return (f"(SELECT *, row_number() OVER ({part}ORDER BY md5('42|' || CAST({key} AS VARCHAR))) <= ceil(CAST(0.2 AS DOUBLE) * count(*) OVER ({part.strip()})) AS is_test FROM {source} s0)")


@query("ml_split", f"SELECT o_orderkey, is_test FROM {_split('orders', 'o_orderkey')} s")
def _(t):
    return train.mark_test(t("orders").select("o_orderkey"), "o_orderkey")


@query("ml_split_stratified", f"SELECT o_orderkey, y, is_test FROM {_split(fx('imbalanced'), 'o_orderkey', 'y')} s")
def _(t):
    return train.mark_test(t("imbalanced").select("o_orderkey", "y"), "o_orderkey", stratify="y")


@query("ml_class_weights", f"SELECT y AS \"class\", CAST(count(*) AS BIGINT) AS count, {r('(SELECT count(*) FROM orders) / (2.0e0 * count(*))')} AS weight FROM {fx('imbalanced')} GROUP BY 1")
def _(t):
    return rounded(train.class_weights(t("imbalanced"), "y"))


@query("ml_with_class_weights", f"WITH f AS {fx('imbalanced')}, w AS (SELECT y, (SELECT count(*) FROM f) / (2.0e0 * count(*)) AS w FROM f GROUP BY 1) SELECT o_orderkey, y, {r('w')} AS weight FROM f JOIN w USING (y)")
def _(t):
    return rounded(train.with_class_weights(t("imbalanced").select("o_orderkey", "y"), "y"))


@query("ml_check_training_input", "SELECT * FROM (VALUES ('unknown feature', 'absent'), ('target among the features', 'o_totalprice')) v(\"check\", detail) WHERE (SELECT count(DISTINCT o_totalprice) FROM orders) > 1")
def _(t):
    return train.check_training_input(t("orders"), ["o_custkey", "absent", "o_totalprice"], "o_totalprice", "linear")


# -- neighbours --------------------------------------------------------------------------------

_E = "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
_DIST = {"euclidean": "list_distance(a.v, b.v)", "cosine": "1 - list_cosine_similarity(a.v, b.v)", "manhattan": "list_sum(list_transform(list_zip(a.v, b.v), lambda p: abs(p[1] - p[2])))"}


def _near(metric: str, k: int, where: str) -> str:
    return (f"{_E}, n AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbor_id, b.label, {_DIST[metric]} AS distance FROM e a, e b WHERE {where}), "
            f"top AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS INTEGER) AS rank FROM n QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) <= {k})")


def _self_neighbors(df, metric, **options):
    return neighbors.nearest_neighbors(df, df, 5, "vec_id", "embedding", metric, include_self=False, **options)


for _metric in ("euclidean", "manhattan", "cosine"):
    query(f"knn_{_metric}", f"WITH {_near(_metric, 5, 'a.vec_id <> b.vec_id')} SELECT query_id, neighbor_id, {r('distance')} AS distance, rank FROM top")(
        lambda t, m=_metric: rounded(_self_neighbors(t("embeddings"), m)))


@query("knn_probe_cells")
def _(t):
    return _self_neighbors(t("embeddings"), "euclidean", probe_cells=3)


@query("dr_knn_graph", f"WITH {_near('euclidean', 15, 'a.vec_id <> b.vec_id')} SELECT query_id AS src, neighbor_id AS dst, {r('distance')} AS distance, rank FROM top")
def _(t):
    return rounded(neighbors.knn_graph(t("embeddings"), "vec_id", "embedding", 15))


def _flat(t):
    return evaluate.spread_columns(t("embeddings"), "embedding", ["vec_id", "label"])


@query("ml_knn_classifier", f"WITH {_near('euclidean', 5, 'a.vec_id % 5 = 0 AND b.vec_id % 5 <> 0')}, v AS (SELECT query_id, label, count(*) AS w FROM top GROUP BY 1, 2) "
       "SELECT query_id, label AS prediction FROM v QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY w DESC, label) = 1")
def _(t):
    df, xs = _flat(t)
    return train.knn_predict(df.where("vec_id % 5 <> 0"), df.where("vec_id % 5 = 0"), "vec_id", xs, "label", 5, scaling="none")


@query("ml_knn_regressor", f"WITH {_near('euclidean', 7, 'a.vec_id % 5 = 0 AND b.vec_id % 5 <> 0')} SELECT query_id, {r('sum(label / distance) / sum(1 / distance)')} AS prediction FROM top GROUP BY 1")
def _(t):
    df, xs = _flat(t)
    return rounded(train.knn_predict(df.where("vec_id % 5 <> 0"), df.where("vec_id % 5 = 0"), "vec_id", xs, "label", 7, "distance", "regression", scaling="none"))


# -- linear models and naive Bayes: closed forms in SQL --------------------------------------------

_PART = _split("part", "p_partkey")


def _scored(t, name, params=None):
    model = train.train(name, t("part"), ["p_size"], "p_retailprice", "p_partkey", params)
    return rounded(model.predict(t("part")).select("p_partkey", "prediction"), 4)


@query("ml_linear_regression", f"WITH s AS {_PART}, m AS (SELECT regr_slope(p_retailprice, p_size) AS b, regr_intercept(p_retailprice, p_size) AS a FROM s WHERE NOT is_test) SELECT p_partkey, {r('a + b * p_size', 4)} AS prediction FROM part, m")
def _(t):
    return _scored(t, "linear")


_PEN = (f"WITH s AS {_PART}, m AS (SELECT avg(p_size) AS xm, stddev_pop(p_size) AS xs, avg(p_retailprice) AS ym, covar_pop(p_size, p_retailprice) / stddev_pop(p_size) AS c, count(*) AS n FROM s WHERE NOT is_test) "
        "SELECT p_partkey, {w} AS prediction FROM part, m")


@query("ml_ridge", _PEN.replace("{w}", r("ym + (n * c / (n + 50.0e0)) * (p_size - xm) / xs", 4)))
def _(t):
    return _scored(t, "ridge", {"alpha": 50.0})


@query("ml_lasso", _PEN.replace("{w}", r("ym + sign(c) * greatest(abs(c) - 0.1e0, 0) * (p_size - xm) / xs", 2)))
def _(t):
    m = train.train("lasso", t("part"), ["p_size"], "p_retailprice", "p_partkey", {"alpha": 0.1})
    return rounded(m.predict(t("part")).select("p_partkey", "prediction"), 2)


@query("ml_coefficients", f"WITH s AS {_PART}, m AS (SELECT regr_slope(p_retailprice, p_size) AS b, regr_intercept(p_retailprice, p_size) AS a FROM s WHERE NOT is_test) "
       f"SELECT '(intercept)' AS feature, {r('a', 4)} AS coefficient, CASE WHEN a > 0 THEN 'Positive' ELSE 'Negative' END AS direction FROM m UNION ALL SELECT 'p_size', {r('b', 4)}, CASE WHEN b > 0 THEN 'Positive' ELSE 'Negative' END FROM m")
def _(t):
    df = t("part")
    return rounded(train.coefficients_table(train.train("linear", df, ["p_size"], "p_retailprice", "p_partkey"), df.sparkSession), 4)


_NB_X = ["o_totalprice", "o_custkey"]
_NB = (f"WITH s AS {_split('orders', 'o_orderkey', 'o_orderstatus')}, b AS (SELECT {', '.join(f'avg({x}) AS m_{x}, stddev_pop({x}) AS s_{x}' for x in _NB_X)} FROM s WHERE NOT is_test), "
       f"z AS (SELECT o_orderkey, o_orderstatus, is_test, {', '.join(f'({x} - m_{x}) / s_{x} AS z_{x}' for x in _NB_X)} FROM s, b), "
       f"g AS (SELECT greatest({', '.join(f'var_pop(z_{x})' for x in _NB_X)}) * 1e-9 AS e FROM z WHERE NOT is_test), "
       f"c AS (SELECT o_orderstatus AS k, ln(count(*) / CAST((SELECT count(*) FROM z WHERE NOT is_test) AS DOUBLE)) AS p, {', '.join(f'avg(z_{x}) AS a_{x}, var_pop(z_{x}) + (SELECT e FROM g) AS v_{x}' for x in _NB_X)} FROM z WHERE NOT is_test GROUP BY 1), "
       f"j AS (SELECT o_orderkey, k, p - 0.5e0 * ({' + '.join(f'ln(2 * pi() * v_{x}) + (z_{x} - a_{x}) * (z_{x} - a_{x}) / v_{x}' for x in _NB_X)}) AS l FROM z, c) "
       "SELECT o_orderkey, arg_max(k, l) AS predicted_label FROM j GROUP BY 1")


@query("ml_naive_bayes_gaussian", _NB)
def _(t):
    m = train.train("naive_bayes", t("orders"), _NB_X, "o_orderstatus", "o_orderkey", {"kind": "gaussian"})
    return m.predict(t("orders")).select("o_orderkey", "predicted_label")


_MN = (f"WITH s AS {_split(fx('imbalanced'), 'o_orderkey', 'y')}, t AS (SELECT * FROM s WHERE NOT is_test), lo AS (SELECT least(min(o_totalprice), 0) AS p, least(min(o_custkey), 0) AS c FROM t), "
       "k AS (SELECT y, ln(count(*) / CAST((SELECT count(*) FROM t) AS DOUBLE)) AS prior, sum(o_totalprice) AS sp, sum(CAST(o_custkey AS DOUBLE)) AS sc FROM t GROUP BY 1), "
       "j AS (SELECT o_orderkey, y2, prior + greatest(o_totalprice - lo.p, 0) * ln((sp + 1) / (sp + sc + 2)) + greatest(o_custkey - lo.c, 0) * ln((sc + 1) / (sp + sc + 2)) AS l FROM s, lo, (SELECT y AS y2, prior, sp, sc FROM k)) "
       "SELECT o_orderkey, CAST(arg_max(y2, l) AS VARCHAR) AS predicted_label FROM j GROUP BY 1")


@query("ml_naive_bayes_multinomial", _MN)
def _(t):
    m = train.train("naive_bayes", t("imbalanced"), ["o_totalprice", "o_custkey"], "y", "o_orderkey", {"kind": "multinomial"})
    return m.predict(t("imbalanced")).select("o_orderkey", "predicted_label")


_BN = (f"WITH s AS {_split('orders', 'o_orderkey', 'o_orderstatus')}, t AS (SELECT o_orderstatus AS k, CASE WHEN o_totalprice > 250000 THEN 1 ELSE 0 END AS a, CASE WHEN o_custkey > 250000 THEN 1 ELSE 0 END AS b FROM s WHERE NOT is_test), "
       "c AS (SELECT k, ln(count(*) / CAST((SELECT count(*) FROM t) AS DOUBLE)) AS prior, (sum(a) + 1.0e0) / (count(*) + 2) AS pa, (sum(b) + 1.0e0) / (count(*) + 2) AS pb FROM t GROUP BY 1), "
       "j AS (SELECT o_orderkey, k, prior + ln(CASE WHEN o_totalprice > 250000 THEN pa ELSE 1 - pa END) + ln(CASE WHEN o_custkey > 250000 THEN pb ELSE 1 - pb END) AS l FROM orders, c) "
       "SELECT o_orderkey, arg_max(k, l) AS predicted_label FROM j GROUP BY 1")


@query("ml_naive_bayes_bernoulli", _BN)
def _(t):
    m = train.train("naive_bayes", t("orders"), _NB_X, "o_orderstatus", "o_orderkey", {"kind": "bernoulli", "binarize": 250000.0})
    return m.predict(t("orders")).select("o_orderkey", "predicted_label")


# -- Spark ML models: metrics of the hash-split test rows -------------------------------------------

_FEATURES = ["o_totalprice", "o_custkey", "o_orderpriority"]


def _metrics(name, params=None, target="o_orderstatus", features=None, source="orders", key="o_orderkey"):
    return lambda t: train.train(name, t(source), features or _FEATURES, target, key, params).metrics()


query("ml_logistic_regression")(_metrics("logistic_regression"))
query("ml_decision_tree")(_metrics("decision_tree", {"max_depth": 5}))
query("ml_random_forest_classifier")(_metrics("random_forest_classifier", {"n_estimators": 20, "max_depth": 5}))
query("ml_gradient_boosting_classifier")(_metrics("gradient_boosting_classifier", {"n_estimators": 8}, "y", ["o_totalprice", "o_custkey"], "imbalanced"))
query("ml_gradient_boosting_multiclass")(_metrics("gradient_boosting_classifier", {"n_estimators": 4}))
query("ml_xgb_style_classifier")(_metrics("xgb_style_classifier", {"n_estimators": 8, "gamma": 0.0, "min_child_weight": 3}, "y", ["o_totalprice", "o_custkey"], "imbalanced"))
query("ml_svm_linear")(_metrics("svm_classifier", {"kernel": "linear", "max_iter": 20}, "y", ["o_totalprice", "o_custkey"], "imbalanced"))
query("ml_svm_rbf")(_metrics("svm_classifier", {"kernel": "rbf", "width": 32, "max_iter": 20}, "y", ["o_totalprice", "o_custkey"], "imbalanced"))
query("ml_svm_poly")(_metrics("svm_classifier", {"kernel": "poly", "degree": 2, "max_iter": 20}, "y", ["o_totalprice", "o_custkey"], "imbalanced"))

_P = dict(target="p_retailprice", features=["p_size", "p_partkey", "p_type"], source="part", key="p_partkey")
query("ml_random_forest_regressor")(_metrics("random_forest_regressor", {"n_estimators": 20, "max_depth": 5}, **_P))
query("ml_gradient_boosting_regressor")(_metrics("gradient_boosting_regressor", {"n_estimators": 10}, **_P))
query("ml_xgb_style_regressor")(_metrics("xgb_style_regressor", {"n_estimators": 10}, **_P))
query("ml_svr")(_metrics("svr", {"kernel": "linear", "steps": 15}, **_P))
query("ml_svr_rbf")(_metrics("svr", {"kernel": "rbf", "steps": 10, "width": 32}, **_P))


@query("ml_predict")
def _(t):
    m = train.train("decision_tree", t("orders"), _FEATURES, "o_orderstatus", "o_orderkey", {"max_depth": 3})
    return train.predict(m, t("orders")).select("o_orderkey", "predicted_label")


@query("ml_feature_importance")
def _(t):
    df = t("part")
    m = train.train("random_forest_regressor", df, ["p_size", "p_partkey", "p_type"], "p_retailprice", "p_partkey", {"n_estimators": 10, "max_depth": 4})
    return train.feature_importance(m, df.sparkSession)


@query("ml_grid_search")
def _(t):
    m = train.train("decision_tree", t("orders"), ["o_totalprice", "o_custkey"], "o_orderstatus", "o_orderkey", grid={"max_depth": [2, 4], "min_samples_leaf": [1, 10]}, folds=2)
    return m.metrics()


@query("ml_grid_search_ridge")
def _(t):
    return train.train("ridge", t("part"), ["p_size", "p_partkey", "p_type"], "p_retailprice", "p_partkey", grid={"alpha": [0.1, 1.0, 10.0]}, folds=5).metrics()


@query("ml_grid_search_naive_bayes")
def _(t):
    return train.train("naive_bayes", t("orders"), _NB_X, "o_orderstatus", "o_orderkey", grid={"var_smoothing": [1e-9, 1e-3, 0.1], "fit_prior": [True, False]}, folds=5).metrics()


@query("ml_grid_search_knn")
def _(t):
    return train.train("knn_regressor", t("part"), ["p_size", "p_partkey"], "p_retailprice", "p_partkey", grid={"k": [1, 3, 5], "weights": ["uniform", "distance"]}).metrics()


_PART_ROBUST = (f"WITH s AS {_PART}, b AS (SELECT median(p_size) AS m, quantile_cont(p_size, 0.75) - quantile_cont(p_size, 0.25) AS w, median(p_partkey) AS mk, quantile_cont(p_partkey, 0.75) - quantile_cont(p_partkey, 0.25) AS wk FROM s WHERE NOT is_test), "
                "z AS (SELECT p_partkey, p_retailprice, is_test, (p_size - m) / w AS a, (p_partkey - mk) / wk AS c FROM s, b), "
                "n AS (SELECT q.p_partkey, x.p_retailprice, row_number() OVER (PARTITION BY q.p_partkey ORDER BY sqrt((q.a - x.a) * (q.a - x.a) + (q.c - x.c) * (q.c - x.c)), x.p_partkey) AS k FROM z q, z x WHERE NOT x.is_test) ")


@query("ml_knn_trained_regressor", _PART_ROBUST + f"SELECT p_partkey, {r('avg(p_retailprice)', 4)} AS prediction FROM n WHERE k <= 4 GROUP BY 1")
def _(t):
    df = t("part")
    m = train.train("knn_regressor", df, ["p_size", "p_partkey"], "p_retailprice", "p_partkey", {"k": 4})
    path = settled_path(df.sparkSession)
    m.save(path)
    return rounded(train.load_model(path).transform(df).select("p_partkey", "prediction"), 4)


@query("ml_train_selected")
def _(t):
    return train.train_selected(["linear", "ridge", "random_forest_regressor", "knn_regressor"], t("part"), ["p_size", "p_partkey", "p_type"], "p_retailprice", "p_partkey", {"random_forest_regressor": {"n_estimators": 5, "max_depth": 4}})


@query("ml_save_and_load", f"WITH s AS {_PART}, m AS (SELECT regr_slope(p_retailprice, p_size) AS b, regr_intercept(p_retailprice, p_size) AS a FROM s WHERE NOT is_test) SELECT p_partkey, {r('a + b * p_size', 4)} AS prediction FROM part, m")
def _(t):
    df = t("part")
    path = settled_path(df.sparkSession)
    train.train("linear", df, ["p_size"], "p_retailprice", "p_partkey").save(path)
    return rounded(train.load_model(path).transform(df).select("p_partkey", "prediction"), 4)


# -- clustering --------------------------------------------------------------------------------

_XY = "SELECT c_custkey, c_nationkey * 1.0e0 AS x, c_acctbal / 200.0e0 AS y FROM customer"
FIXTURES["customer_points"] = _XY


@query("cu_kmeans")
def _(t):
    return cluster.kmeans(t("customer_points"), "c_custkey", ["x", "y"], 4, restarts=2)


@query("cu_kmeans_auto")
def _(t):
    return cluster.kmeans_auto(t("customer_points"), "c_custkey", ["x", "y"], max_k=5, restarts=1)[1]


def _dbscan(eps: str, least: int, extra: str = "", points: str = _XY, apart: str = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))") -> str:
    return (f"WITH RECURSIVE p AS ({points}), {extra}d AS (SELECT a.c_custkey AS a, b.c_custkey AS b FROM p a, p b WHERE {apart} <= {eps}), "
            f"core AS (SELECT a FROM d GROUP BY 1 HAVING count(*) >= {least}), e AS (SELECT d.a, d.b FROM d JOIN core c1 ON d.a = c1.a JOIN core c2 ON d.b = c2.a), "
            "reach AS (SELECT a, a AS r FROM core UNION SELECT e.b, reach.r FROM reach JOIN e ON e.a = reach.a), root AS (SELECT a, min(r) AS root FROM reach GROUP BY 1), "
            "num AS (SELECT root, dense_rank() OVER (ORDER BY root) - 1 AS k FROM (SELECT DISTINCT root FROM root)), "
            "lab AS (SELECT d.a, min(root.root) AS root FROM d JOIN root ON d.b = root.a GROUP BY 1) "
            "SELECT p.c_custkey, CAST(coalesce(k, -1) AS BIGINT) AS cluster FROM p LEFT JOIN root ON p.c_custkey = root.a LEFT JOIN lab ON p.c_custkey = lab.a LEFT JOIN num ON num.root = coalesce(root.root, lab.root)")


_DB = _dbscan("0.9e0", 3)
_EPS = ("q AS (SELECT a.c_custkey AS k, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM p a, p b), "
        "w AS (SELECT k, avg(d) AS m FROM (SELECT k, d FROM q QUALIFY row_number() OVER (PARTITION BY k ORDER BY d) <= 4) GROUP BY 1), eps AS (SELECT median(m) AS v FROM w), ")


@query("cu_dbscan", _DB)
def _(t):
    return cluster.dbscan(t("customer_points"), "c_custkey", ["x", "y"], 0.9, 3)


# z-scored balance and one-hot segment: customers of two segments are sqrt(2) and more apart
_SEGMENTS = "SELECT c_custkey, (c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER () AS x, c_mktsegment AS s FROM customer"
_SEGMENTS_APART = "sqrt((a.x - b.x) * (a.x - b.x) + CASE WHEN a.s = b.s THEN 0.0e0 ELSE 2.0e0 END)"


@query("cu_dbscan_prepared", _dbscan("0.011e0", 4, "", _SEGMENTS, _SEGMENTS_APART))
def _(t):
    return cluster.dbscan(t("customer"), "c_custkey", ["c_acctbal", "c_mktsegment"], 0.011, 4, prepare=True)


@query("cu_dbscan_grid")
def _(t):
    return cluster.dbscan_grid(t("customer_points"), "c_custkey", ["x", "y"], [0.9], [3])


_GRID = [(e, m) for e in (0.6, 0.9, 1.2) for m in (3, 5)]


@query("cu_dbscan_grid_clusters", " UNION ALL ".join(f"SELECT {e}::DOUBLE AS eps, {m} AS min_samples, 'euclidean' AS metric, CAST(max(cluster) + 1 AS INTEGER) AS clusters FROM ({_dbscan(f'{e}e0', m)})" for e, m in _GRID))
def _(t):
    return cluster.dbscan_grid(t("customer_points"), "c_custkey", ["x", "y"], [0.6, 0.9, 1.2], [3, 5]).drop("silhouette", "chosen")


@query("cu_hierarchical")
def _(t):
    return cluster.hierarchical(t("customer_points"), "c_custkey", ["x", "y"], 4)[0]


@query("cu_hierarchical_merges")
def _(t):
    return cluster.hierarchical(t("embeddings"), "vec_id", "embedding", 4, "cosine")[1]


@query("cu_bisecting")
def _(t):
    return cluster.bisecting(t("customer_points"), "c_custkey", ["x", "y"], 4)


@query("cu_knn_graph_clusters")
def _(t):
    return cluster.knn_graph_clusters(t("embeddings"), "vec_id", "embedding", 3, 10)


@query("cu_knn_density_eps", f"WITH {_near('euclidean', 5, 'true')}, m AS (SELECT query_id, avg(distance) AS d FROM top GROUP BY 1) SELECT {r('median(d)')} AS eps FROM m")
def _(t):
    df = t("embeddings")
    return rounded(df.sparkSession.createDataFrame([(cluster.neighbor_eps(df, "vec_id", "embedding", 5),)], "eps double"))


@query("cu_knn_density_clusters", _dbscan("(SELECT v FROM eps)", 4, _EPS))
def _(t):
    return cluster.knn_density_clusters(t("customer_points"), "c_custkey", ["x", "y"], 4)


@query("cu_knn_cluster_grid")
def _(t):
    return cluster.knn_cluster_grid(t("embeddings"), "vec_id", "embedding", [3], [5])


@query("cu_cluster_sizes", f"SELECT label AS cluster, CAST(count(*) AS BIGINT) AS count, {r('100.0e0 * count(*) / (SELECT count(*) FROM embeddings)')} AS pct FROM embeddings GROUP BY 1")
def _(t):
    return rounded(cluster.cluster_sizes(t("embeddings").withColumnRenamed("label", "cluster")))


@query("cu_cluster_profile", f"SELECT event_type, {r('avg(value)', 5)} AS value, {r('avg(user_id)', 5)} AS user_id FROM events GROUP BY 1")
def _(t):
    return rounded(cluster.cluster_profile(t("events"), ["value", "user_id"], "event_type"), 5)


@query("cu_cluster_histogram", "WITH b AS (SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 20 AS w FROM orders), x AS (SELECT o_orderstatus, CAST(least(floor((o_totalprice - lo) / w), 19) AS INTEGER) AS bin, lo, w FROM orders, b) "
       f"SELECT o_orderstatus, bin, {r('any_value(lo) + bin * any_value(w)', 4)} AS lower, {r('any_value(lo) + (bin + 1) * any_value(w)', 4)} AS upper, CAST(count(*) AS BIGINT) AS count FROM x GROUP BY 1, 2")
def _(t):
    return rounded(cluster.cluster_histogram(t("orders"), "o_totalprice", "o_orderstatus"), 4)


@query("cu_cluster_pca_view")
def _(t):
    flat, xs = _flat(t)
    return cluster.cluster_pca_view(flat, xs, "label")[0]
