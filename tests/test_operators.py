"""Operators on small tables: edge cases and numpy twins."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from prepforge.functions import blocks
from prepforge.functions.blocks import block_join
from prepforge.functions.quantiles import exact_quantiles
from prepforge.operators import clean, cluster, encode, evaluate, neighbors, reduce, scale, select, shape, stats, train
from prepforge.operators.profile import TableProfile, feature_families, infer_task_type
from prepforge.plans import prepare
from prepforge.plans.steps import apply_steps

ORDERS = "/root/testdata/sf0.001/orders.parquet"


@pytest.fixture(scope="module")
def orders(spark):
    return spark.read.parquet(ORDERS)


def brute_neighbors(x, k, skip_self):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    if skip_self:
        np.fill_diagonal(d, np.inf)
    order = np.argsort(d, axis=1, kind="stable")[:, :k]
    return order, np.take_along_axis(d, order, 1)


@pytest.mark.parametrize("skip_self,leaf", [(True, 9), (False, 10**6), (False, 30)])
def test_neighbors_with_a_third_of_copies_and_tiny_blocks(spark, monkeypatch, skip_self, leaf):
    rng = np.random.default_rng(3)
    x = np.concatenate([np.zeros((60, 2)), rng.normal(0, 1, (120, 2))])
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(x)), "a": x[:, 0], "b": x[:, 1]}))
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", 16)
    monkeypatch.setattr(neighbors, "LEAF_ROWS", leaf)
    monkeypatch.setattr(neighbors, "FANOUT", 4)  # several levels
    got = neighbors.nearest_neighbors(df, df, 4, "id", ["a", "b"], include_self=not skip_self).toPandas().sort_values(["query_id", "rank"])
    ids, dist = brute_neighbors(x, 4, skip_self)
    assert (got.neighbor_id.to_numpy().reshape(-1, 4) == ids).all()
    assert np.allclose(got.distance.to_numpy().reshape(-1, 4), dist)


def scan(x, eps, least):
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) <= eps * (1 + 1e-12)
    core, label, found = near.sum(1) >= least, -np.ones(len(x), int), 0
    for i in range(len(x)):
        if label[i] != -1 or not core[i]:
            continue
        stack, label[i] = [i], found
        while stack:
            u = stack.pop()
            if core[u]:
                for v in np.nonzero(near[u])[0]:
                    if label[v] == -1:
                        label[v] = found
                        stack.append(v)
        found += 1
    return label


def test_dbscan_equals_a_sequential_scan(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal([0, 0], 0.3, (80, 2)), np.full((40, 2), 5.0), np.array([[9 + i * 0.5, 0] for i in range(12)]), rng.uniform(-3, 8, (30, 2))])
    x = x[rng.permutation(len(x))]
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(x)), "x": x[:, 0], "y": x[:, 1]}))
    monkeypatch.setattr(blocks.block_join, "__defaults__", (16,))
    got = cluster.dbscan(df, "id", ["x", "y"], 0.5, 3).toPandas().sort_values("id").cluster.to_numpy()
    assert (got == scan(x, 0.5, 3)).all()


def test_dbscan_all_noise(spark):
    df = spark.createDataFrame([(i, float(i * 10)) for i in range(6)], "id bigint, x double")
    assert {r["cluster"] for r in cluster.dbscan(df, "id", ["x"], 1.0, 2).collect()} == {-1}


def test_dbscan_keeps_rows_with_missing_coordinates(spark):
    points = [(i, float(i % 6), 0.0) for i in range(12)] + [(12, None, 0.0), (13, 1.0, None)]
    df = spark.createDataFrame(points, "id bigint, x double, y double")
    rows = {r["id"]: r["cluster"] for r in cluster.dbscan(df, "id", ["x", "y"], 1.0, 3).collect()}
    assert rows == {**dict.fromkeys(range(12), 0), 12: -1, 13: -1}
    arrays = df.where("id >= 10").select("id", F.when(F.col("id") < 13, F.array("x", "y")).alias("v"))
    assert {r["id"]: r["cluster"] for r in cluster.dbscan(arrays, "id", "v", 1.0, 1).collect()} == {10: 0, 11: 0, 12: -1, 13: -1}
    assert {r["cluster"] for r in cluster.dbscan(df.where("id >= 12"), "id", ["x", "y"], 1.0, 1).collect()} == {-1}


@pytest.mark.parametrize("keys", [[0, 1, None], [0, 1, 1]])
def test_impute_knn_wants_a_key_for_each_row(spark, keys):
    df = spark.createDataFrame([(k, v, 1.0) for k, v in zip(keys, [1.0, None, 3.0])], "id bigint, a double, b double")
    with pytest.raises(ValueError, match="key"):
        clean.impute_knn(df, "id", ["a", "b"])


def test_hierarchical_splits_from_the_top(spark):
    df = spark.createDataFrame([(0, 0.0), (1, 1.0), (2, 10.0), (3, 11.5), (4, 30.0), (5, 30.0), (6, 30.5)], "id bigint, x double")
    labels, tree = cluster.hierarchical(df, "id", ["x"], 3)
    got = [r["cluster"] for r in labels.orderBy("id").collect()]
    assert got == [1, 1, 2, 2, 0, 0, 0]
    rows = tree.orderBy("step").collect()
    scale_ = np.std([0, 1, 10, 11.5, 30, 30, 30.5])
    assert [(r["size_a"], r["size_b"]) for r in rows] in ([(2, 2), (4, 3)], [(2, 2), (3, 4)])
    assert rows[0]["height"] == pytest.approx(np.sqrt(2 * (4 / 4) * (10.75 - 0.5) ** 2) / scale_)
    few, steps = cluster.hierarchical(df.where("id >= 4"), "id", ["x"], 5)
    assert few.select("cluster").distinct().count() == 2 and steps.count() == 1  # two distinct rows


def test_silhouette_blocks_equal_numpy(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 1, (30, 3)), rng.normal(4, 1, (30, 3)), [[50.0, 50, 50]]])
    y = np.array([0] * 30 + [1] * 30 + [2])
    df = spark.createDataFrame(pd.DataFrame({"id": range(61), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "k": y}))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    s = []
    for i in range(61):
        same = (y == y[i]) & (np.arange(61) != i)
        a = d[i, same].mean() if same.any() else None
        b = min(d[i, y == k].mean() for k in set(y) - {y[i]})
        s.append(0.0 if a is None else (b - a) / max(a, b))
    assert evaluate.silhouette(df, "id", ["a", "b", "c"], "k").head()["silhouette"] == pytest.approx(np.mean(s))


def test_neighbors_on_a_lattice_break_ties_by_key(spark, monkeypatch):
    x = np.array([[i % 6, i // 6] for i in range(36)], dtype=float)
    df = spark.createDataFrame(pd.DataFrame({"id": range(36), "a": x[:, 0], "b": x[:, 1]}))
    monkeypatch.setattr(neighbors, "LEAF_ROWS", 5)
    monkeypatch.setattr(neighbors, "FANOUT", 3)
    got = neighbors.nearest_neighbors(df, df, 3, "id", ["a", "b"], "manhattan", include_self=False).toPandas().sort_values(["query_id", "rank"])
    d = np.abs(x[:, None] - x[None]).sum(2)
    np.fill_diagonal(d, np.inf)
    assert (got.neighbor_id.to_numpy().reshape(-1, 3) == np.argsort(d, axis=1, kind="stable")[:, :3]).all()


def test_elbow():
    assert cluster.elbow([(2, 100.0), (3, 20.0), (4, 15.0), (5, 12.0), (6, 10.0)]) == 3


def test_kmeans_finds_blobs(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.2, (40, 2)) for c in ((0, 0), (6, 0), (0, 6))])
    df = spark.createDataFrame(pd.DataFrame({"id": range(120), "a": x[:, 0], "b": x[:, 1]}))
    labels, table = cluster.kmeans_auto(df, "id", ["a", "b"], max_k=5, restarts=2)
    assert table.where("chosen").head()["k"] == 3
    assert labels.join(df, "id").groupBy((F.col("id") / 40).cast("int")).agg(F.count_distinct("cluster").alias("n")).where("n > 1").count() == 0


def test_discriminant_separates_classes_and_pca_matches_numpy(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal([0, 0, 0], 1, (60, 3)), rng.normal([3, 1, 0], 1, (60, 3))])
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": ["u"] * 60 + ["v"] * 60}))
    fitted = reduce.fit_discriminant(df, ["a", "b", "c"], "y")
    m0, m1 = x[:60].mean(0), x[60:].mean(0)
    w = ((x[:60] - m0).T @ (x[:60] - m0) + (x[60:] - m1).T @ (x[60:] - m1)) / 118
    axis = np.linalg.solve(w, m1 - m0)
    got = fitted.facts["scalings"][:, 0]
    assert abs(np.dot(axis / np.linalg.norm(axis), got / np.linalg.norm(got))) == pytest.approx(1.0, abs=1e-9)
    assert np.allclose(fitted.facts["importance"], np.abs(axis), rtol=1e-8)
    p = reduce.fit_pca(df, ["a", "b", "c"], 3)
    assert np.allclose(p.facts["eigenvalues"], np.linalg.eigvalsh(np.cov(x.T))[::-1])


def test_impute_knn_two_gaps_against_brute_force(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (40, 3))
    x[::5, 0] = np.nan
    x[::7, 1] = np.nan
    got = clean.impute_knn(spark.createDataFrame([(i, *[None if np.isnan(v) else float(v) for v in row]) for i, row in enumerate(x)], "id bigint, a double, b double, c double"), "id", k=3)
    got = got.toPandas().sort_values("id")[["a", "b", "c"]].to_numpy()
    want = x.copy()
    for i, j in zip(*np.nonzero(np.isnan(x))):
        options = []
        for o in range(40):
            shared = ~np.isnan(x[i]) & ~np.isnan(x[o])
            if not np.isnan(x[o, j]) and shared.any():
                options.append((np.sqrt(3 / shared.sum() * ((x[i] - x[o])[shared] ** 2).sum()), o))
        want[i, j] = np.mean([x[o, j] for _, o in sorted(options)[:3]]) if options else np.nanmean(x[:, j])
    assert np.allclose(got.astype(float), want)


def test_inverse_scaling_and_degenerate_columns(spark):
    df = spark.createDataFrame([(1.0, 5.0, None), (2.0, 5.0, None), (float("inf"), 5.0, None)], "a double, c double, e double")
    assert [r["c"] for r in scale.minmax(df, ["c"]).collect()] == [0.0] * 3
    assert scale.zscore(df, ["e"]).where("e IS NOT NULL").count() == 0
    assert [r["c"] for r in scale.mean_normalize(df, "c").collect()] == [5.0] * 3
    assert [r["a"] for r in clean.clean_numeric(df, ["a", "e"]).collect()] == [1.0, 2.0, 1.5]
    assert {r["e"] for r in clean.clean_numeric(df, ["e"]).collect()} == {0.0}
    fitted = scale.fit_robust(df.limit(2), ["a"])
    assert [r["a"] for r in scale.inverse(fitted).transform(fitted.transform(df.limit(2))).collect()] == [1.0, 2.0]


def test_partition_count_does_not_change_results(orders):
    a = encode.label_encode(orders.repartition(1), ["o_orderpriority"]).select("o_orderkey", "o_orderpriority")
    b = encode.label_encode(orders.repartition(17), ["o_orderpriority"]).select("o_orderkey", "o_orderpriority")
    assert a.exceptAll(b).count() == 0
    sa, sb = (train.mark_test(orders.repartition(n), "o_orderkey", stratify="o_orderstatus").where("is_test").select("o_orderkey") for n in (1, 17))
    assert sa.exceptAll(sb).count() == 0 and sa.count() > 0


def test_unknown_values_and_bad_arguments(spark, orders):
    fitted = encode.fit_label_encode(orders.where("o_orderstatus <> 'P'"), ["o_orderstatus"])
    with pytest.raises(Exception, match="unknown value"):
        fitted.transform(orders).select("o_orderstatus").collect()
    with pytest.raises(ValueError):
        shape.compute(orders, "[nothing] + 1", "x")
    with pytest.raises(ValueError):
        clean.drop_duplicates(orders, subset=["o_custkey"])
    with pytest.raises(ValueError):
        apply_steps(orders, [{"name": "x", "type": "standardization", "category": "absent"}])
    with pytest.warns(UserWarning):
        assert apply_steps(orders, [{"name": "x", "type": "t", "category": "absent"}], on_error="skip").columns == orders.columns


def test_modes_break_ties_by_the_smallest_value(spark):
    df = spark.createDataFrame([("b", 2), ("b", 1), ("a", 2), ("a", 1), (None, 3)], "s string, n int")
    assert clean.value_modes(df, ["s", "n"]) == {"s": "a", "n": 1}
    out = clean.impute(spark.createDataFrame([(None,), (None,)], "s string"), {"s": "mode"})
    assert {r["s"] for r in out.collect()} == {"Unknown"}


def test_auc_by_ranges_and_constant_scores(spark, monkeypatch):
    df = spark.createDataFrame([(i % 2, float(i % 7)) for i in range(70)], "y int, s double")
    assert evaluate.auc(df, "y", "s").head()["auc"] == pytest.approx(0.5)
    df = spark.createDataFrame([(int(i > 30), float(i)) for i in range(60)], "y int, s double")
    assert evaluate.auc(df, "y", "s").head()["auc"] == 1.0


def test_rfe_keeps_the_informative_feature(spark):
    rng = np.random.default_rng(0)
    a, b, c = rng.normal(size=(3, 200))
    df = spark.createDataFrame(pd.DataFrame({"a": a, "b": b, "c": c, "y": 5 * b + 0.5 * a}))
    ranks = {r["feature"]: r["rank"] for r in select.rfe_ranking(df, ["a", "b", "c"], "y", 1).collect()}
    assert ranks == {"b": 1, "a": 2, "c": 3}


def test_models_learn_separable_data_and_survive_saving(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(-2, 0.5, (60, 2)), rng.normal(2, 0.5, (60, 2))])
    df = spark.createDataFrame(pd.DataFrame({"id": range(120), "a": x[:, 0], "b": x[:, 1], "y": ["no"] * 60 + ["yes"] * 60}))
    for name, params in (("logistic_regression", {}), ("naive_bayes", {}), ("svm_classifier", {"width": 32}), ("random_forest_classifier", {"n_estimators": 5})):
        model = train.train(name, df, ["a", "b"], "y", "id", params)
        assert model.metrics().head()["accuracy"] >= 0.95, name
    model.save(str(tmp_path / "m"))
    again = train.load_model(str(tmp_path / "m")).transform(df).select("id", "predicted_label")
    assert again.exceptAll(model.predict(df).select("id", "predicted_label")).count() == 0


def test_svr_follows_a_line(spark):
    df = spark.createDataFrame([(i, float(i), 3.0 * i + 1) for i in range(80)], "id bigint, x double, y double")
    assert train.train("svr", df, ["x"], "y", "id", {"kernel": "linear", "C": 10.0, "steps": 80}).metrics().head()["r2"] > 0.95


def test_profile_decisions_are_the_golden_ones(orders):
    got = {r["column"]: (r["stage"], r["action"]) for r in prepare.prep_decisions(TableProfile(orders, "o_orderstatus", ["o_orderkey"])).collect()}
    assert got == {"o_orderkey": ("drop", "identifier"), "o_custkey": ("transform", "z-score"), "o_totalprice": ("transform", "z-score"),
                   "o_orderdate": ("parse", "date parts with tenure"), "o_orderpriority": ("encode", "one-hot")}
    assert infer_task_type(orders, None) == "Unsupervised"
    assert feature_families(["r_mean", "r_max", "s_mean"]) == {"r": ["r_mean", "r_max"]}


def test_profile_of_tiny_tables(spark):
    one = spark.createDataFrame([(1, "x", None)], "a int, b string, c double")
    p = TableProfile(one)
    assert p.fully_missing == ["c"] and p.constant == ["a", "b"]
    assert prepare.quality_report(p).count() > 5
    assert TableProfile(one.limit(0)).rows == 0


def test_statistics_p_value(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4, 5)] + [("b", float(v)) for v in (2, 4, 6, 8, 10)], "g string, v double")
    row = stats.t_test_two_sample(df, "g", "v").head()
    assert row["t"] == pytest.approx(-1.8974, abs=1e-4) and row["dof"] == pytest.approx(5.882, abs=1e-3) and row["p_value"] == pytest.approx(0.1075, abs=1e-3)
    ci = stats.confidence_interval(df.where("g = 'a'"), "v", 95).head()
    assert ci["lower"] == pytest.approx(3 - 2.776445 * (2.5 / 5) ** 0.5, abs=1e-5)


# -- plans -------------------------------------------------------------------------------------

def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    df = shape.filter_equals(spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet"), "l_linenumber", "3").select("l_quantity")
    plan = plan_of(df)
    assert "EqualTo(l_linenumber,3)" in plan and "ReadSchema: struct<l_linenumber:int,l_quantity:double>" in plan


def test_fitted_transforms_are_narrow_and_free_of_python(orders):
    out = encode.fit_onehot(orders, ["o_orderstatus"]).transform(scale.zscore(clean.impute(orders, {"o_totalprice": "median"}), ["o_totalprice"]))
    plan = plan_of(out)
    assert "Exchange" not in plan and "Python" not in plan and "Window" not in plan


def test_fitted_transform_runs_on_a_stream(spark, orders, tmp_path):
    orders.select("o_orderkey", "o_totalprice").write.parquet(str(tmp_path / "in"))
    fitted = scale.fit_zscore(orders, ["o_totalprice"])
    stream = spark.readStream.schema("o_orderkey bigint, o_totalprice double").parquet(str(tmp_path / "in"))
    q = fitted.transform(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
    assert q.awaitTermination(60)
    want = fitted.transform(orders.select("o_orderkey", "o_totalprice"))
    assert spark.read.parquet(str(tmp_path / "out")).exceptAll(want).count() == 0


def test_column_roles_come_from_whole_columns(spark):
    from prepforge.operators.clean import date_like_columns
    from prepforge.operators.profile import TableProfile
    rows = [(i, f"2024-01-{1 + i % 28:02d}" + (" 10:30:00" if i > 90 else ""), f"plain {i}" if i < 60 else f"{i:08x}-0000-4000-8000-000000000000",
             "short" if i < 60 else f"{i} " + "words " * 80, None) for i in range(100)]
    df = spark.createDataFrame(rows, "n bigint, order_date string, code string, story string, nothing string")
    profile = TableProfile(df, order_by=["n"])
    assert profile.special["dates"] == [("order_date", "timestamp")]
    assert "code" in profile.id_like
    assert "story" in profile.special["texts"]
    assert "nothing" not in profile.contents
    assert {r[0] for r in date_like_columns(df).collect()} == {"order_date", "code"}
    empty = TableProfile(df.limit(0), order_by=["n"])
    assert empty.contents == {} and empty.special["dates"] == []


def test_cluster_grids_score_all_rows(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(0, 0.2, (40, 2)), rng.normal(6, 0.2, (40, 2)), [[30.0, 30.0]]])
    df = spark.createDataFrame(pd.DataFrame({"id": range(81), "x": x[:, 0], "y": x[:, 1]}))
    rows = cluster.dbscan_grid(df, "id", ["x", "y"], [1.0, 20.0], [3]).collect()
    assert [(r["eps"], r["clusters"], r["chosen"]) for r in rows] == [(1.0, 2, True), (20.0, 1, False)]
    labels = cluster.dbscan(df, "id", ["x", "y"], 1.0, 3)
    exact = evaluate.silhouette(df.join(labels, "id").where("cluster >= 0"), "id", ["x", "y"], "cluster").head()["silhouette"]
    assert rows[0]["silhouette"] == pytest.approx(exact) and exact > 0.9
    by_metric = cluster.dbscan_grid(df.where("id < 80"), "id", ["x", "y"], [0.05], [3], ("cosine", "manhattan")).collect()
    assert [r["metric"] for r in by_metric] == ["cosine", "manhattan"] and not any(r["eps"] == 0.5 for r in by_metric if r["silhouette"] is not None)


def brute_imputed(x, k):
    want, d = x.copy(), x.shape[1]
    for i, j in zip(*np.nonzero(np.isnan(x))):
        options = []
        for o in range(len(x)):
            shared = ~np.isnan(x[i]) & ~np.isnan(x[o])
            if not np.isnan(x[o, j]) and shared.any():
                options.append((np.sqrt(d / shared.sum() * ((x[i] - x[o])[shared] ** 2).sum()), o))
        want[i, j] = np.mean([x[o, j] for _, o in sorted(options)[:k]]) if options else np.nanmean(x[:, j])
    return want


def test_impute_knn_many_patterns_in_few_jobs(spark, monkeypatch):
    rng = np.random.default_rng(10)
    x = rng.normal(0, 1, (500, 12)) * np.linspace(1, 3, 12)
    x[rng.random(x.shape) < 0.2] = np.nan
    x[3] = np.nan
    assert len({tuple(r) for r in np.isnan(x)}) >= 200
    jobs = []
    for data, rows in ((x, 60), (np.where(np.isnan(x) & (np.arange(12) != 2), 0.5, x), 60), (x, 10_000)):
        monkeypatch.setattr(clean, "DONOR_ROWS", rows)
        frame_ = spark.createDataFrame([(i, *[None if np.isnan(v) else float(v) for v in row]) for i, row in enumerate(data)], "id bigint, " + ", ".join(f"c{i} double" for i in range(12)))
        spark.sparkContext.setJobGroup(f"impute-{len(jobs)}", "")
        got = clean.impute_knn(frame_, "id", k=4).toPandas().sort_values("id").drop(columns="id").to_numpy()
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"impute-{len(jobs)}")))
        assert np.allclose(got.astype(float), brute_imputed(data, 4))
    assert abs(jobs[0] - jobs[1]) <= 8 and max(jobs) < 60  # 200 patterns or two


def test_impute_knn_meets_as_many_pairs_as_the_table_has_rows(spark, monkeypatch):
    pairs = []

    def counted(left, right, key, *rest):
        sizes = left.groupBy(key).count().join(right.groupBy(key).agg(F.count(F.lit(1)).alias("c")), key)
        pairs[-1] += sizes.agg(F.coalesce(F.sum(F.col("count") * F.col("c")), F.lit(0))).head()[0]
        return block_join(left, right, key, *rest)

    monkeypatch.setattr(clean, "block_join", counted)
    monkeypatch.setattr(clean, "DONOR_ROWS", 50)
    for n in (500, 2000):
        rng = np.random.default_rng(n)
        x = np.column_stack([rng.integers(0, 10, n), rng.normal(0, 1, n).round(6)]).astype(float)
        x[::7, 0] = np.nan
        x[::11, 1] = np.nan
        pairs.append(0)
        df = spark.createDataFrame([(i, *[None if np.isnan(v) else float(v) for v in row]) for i, row in enumerate(x)], "id bigint, a double, b double")
        got = clean.impute_knn(df, "id", k=3).toPandas().sort_values("id")[["a", "b"]].to_numpy()
        assert np.allclose(got.astype(float), brute_imputed(x, 3))
    assert pairs[1] < 6 * pairs[0]  # four times the rows; all ranges for rows without b made it 16 times


def test_nan_is_missing_in_cleaning(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(i, v, w) for i, (v, w) in enumerate([(1.0, 1.0), (2.0, nan), (nan, 3.0), (None, 2.0), (3.0, 2.0), (2.0, 1.0), (100.0, 2.0), (inf, 2.0)])], "id int, a double, b double")
    assert {r["column"]: r["null_count"] for r in clean.null_summary(df).collect()} == {"id": 0, "a": 2, "b": 1}
    by = lambda d: {r["id"]: r["a"] for r in d.collect()}
    assert by(clean.impute(df, {"a": "median"}))[2] == 2.0 == by(clean.impute(df, {"a": "median"}))[7]
    assert by(clean.impute(df, {"a": "mean"}))[2] == pytest.approx(108 / 5)
    assert by(clean.impute(df, {"a": "mode"}))[2] == 2.0 and by(clean.impute(df, {"a": "unknown"}))[2] == "Unknown"
    assert set(by(clean.impute(df, {"a": "drop"}))) == {0, 1, 4, 5, 6, 7}
    capped = by(clean.handle_outliers(df, ["a"], "iqr", "capping"))
    assert capped[2] is None and capped[3] is None and capped[6] == capped[7] < 100
    assert set(by(clean.handle_outliers(df, ["a"], "iqr", "deletion"))) == {0, 1, 4, 5}
    assert {2, 3} <= set(by(clean.handle_outliers(df, ["a"], "zscore", "deletion")))
    assert clean.outlier_summary(df, ["a"], "iqr").head()["outlier_count"] == 2


def test_dictionaries_stay_when_the_source_changes(spark, tmp_path):
    from pyspark.sql import functions as F
    source = str(tmp_path / "source")
    spark.createDataFrame([("b", 1.0), ("c", 3.0), (None, 5.0)], "k string, y double").coalesce(1).write.parquet(source)
    df = spark.read.parquet(source)
    fits = {"label": encode.fit_label_encode(df, ["k"], handle_unknown="null"), "target": encode.fit_target_encode(df, ["k"], "y"),
            "frequency": encode.fit_frequency_encode(df, ["k"]), "binary": encode.fit_binary_encode(df, "k", ["y"])}
    want = {n: sorted(map(str, f.transform(df).collect())) for n, f in fits.items()}
    for n, f in fits.items():
        f.save(str(tmp_path / n))
    new = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 9.0)], "k string, y double")
    before = {n: sorted(map(str, f.transform(new).collect())) for n, f in fits.items()}
    spark.createDataFrame([("a", 0.0)] * 50, "k string, y double").write.mode("overwrite").parquet(source)
    spark.catalog.refreshByPath(source)
    for n, f in fits.items():
        loaded = encode.load_dictionary(spark, str(tmp_path / n))
        assert sorted(map(str, f.transform(new).collect())) == before[n] == sorted(map(str, loaded.transform(new).collect()))
    assert want["label"] == ["Row(k=0, y=1.0)", "Row(k=1, y=3.0)", "Row(k=2, y=5.0)"]
    codes = {r["k"] for r in fits["label"].inverse(fits["label"].transform(new.where("k <> 'a'"))).collect()}
    assert codes == {"b", "c"}
    assert new.where(F.lit(True)).count() == 3


def test_onehot_does_not_replace_columns(spark):
    df = spark.createDataFrame([("x", 1)], "a string, A_x int")
    with pytest.raises(ValueError, match="replace"):
        encode.onehot(df, ["a"])
    with pytest.raises(ValueError, match="arr"):
        encode.preprocess(df.selectExpr("a", "array(1) AS arr"), ["a", "arr"])


def test_csv_types_and_infinities(spark, tmp_path):
    from prepforge.sources.tables import read_table
    (tmp_path / "t.csv").write_text("id,x,s\n1,2.5,a\n2,Infinity,\"b,c\"\n3,NaN,\n")
    rows = read_table(spark, str(tmp_path / "t.csv"))
    assert dict(rows.dtypes) == {"id": "int", "x": "double", "s": "string"}
    assert [tuple(r) for r in rows.orderBy("id").collect()] == [(1, 2.5, "a"), (2, None, "b,c"), (3, None, None)]
    with pytest.raises(ValueError, match="format"):
        read_table(spark, "table.xlsx")


def test_plans_derive_columns_from_dates_families_and_texts(spark):
    from pyspark.sql import functions as F
    df = spark.range(300).select(F.col("id").alias("n"), F.expr("CAST(DATE'2024-01-01' + CAST(id % 50 AS INT) AS STRING)").alias("start_date"), F.expr("DATE'2024-02-01' + CAST(id % 70 AS INT)").alias("end_date"),
                               (F.col("id") * 37 % 101).cast("double").alias("temp_min"), (F.col("id") * 53 % 97).cast("double").alias("temp_max"), F.concat(F.lit("note "), F.col("id").cast("string"), F.lit(" words" * 20)).alias("review_text"))
    plan = prepare.preparation_plan(TableProfile(df, order_by=["n"]))
    kinds = [s["category"] for s in plan["steps"] if s["type"] == "feature" or s["category"] == "Date Validation"]
    assert kinds == ["Date Validation", "Family Deltas", "Date Differences", "Date Parts", "Date Parts", "Text TF-IDF"]
    out, log = prepare.run_plan(df, plan)
    assert {"end_date_to_start_date_days", "start_date_year", "end_date_tenure", "review_text_tfidf"} <= set(out.columns) and all(x == "done" for _, x in log)
    assert any(c.startswith("temp_") and "_minus_" in c for c in out.columns) and out.count() == 300


def test_fills_of_a_plan_are_fitted_together(spark):
    jobs = []
    for width in (3, 12):
        df = spark.createDataFrame([(i, *[None if (i + c) % 9 == 0 else float(i * (c + 3) % 17) for c in range(width)]) for i in range(60)], "id bigint, " + ", ".join(f"c{c} double" for c in range(width)))
        steps = [{"name": f"fill {c}", "type": "cleaning", "category": "Null handling", "strategies": {f"c{c}": ("mean", "median", "mode")[c % 3]}} for c in range(width)]
        spark.sparkContext.setJobGroup(f"fills-{width}", "")
        out, log = prepare.run_plan(df, {"steps": steps})
        assert [n for n, _ in log] == [s["name"] for s in steps] and {x for _, x in log} == {"done"}
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"fills-{width}")))
        assert sorted(map(str, out.collect())) == sorted(map(str, apply_steps(df, steps).collect()))
    assert jobs[0] == jobs[1]


def test_profile_counts_only_the_values_that_settle_a_column(spark):
    df = spark.createDataFrame([(i, float(i % 7), 2.0 * (i % 7), None if i % 5 else float(i), 3.0, i % 3) for i in range(60)], "key_of_row bigint, a double, b double, c double, d double, e int")
    asked = []

    class Watched(TableProfile):
        def _count_values(self, names):
            asked.append(sorted(set(names) - set(getattr(self, "_distinct", {}))))
            return super()._count_values(names)

    p = Watched(df.drop("key_of_row"))
    assert p.pairs_above(0.999) == [("a", "b", pytest.approx(1.0))] and p.constant == ["d"] and asked == []
    q = Watched(df.withColumn("word", F.lit("x")))
    assert q.id_like == ["key_of_row"] and q.constant == ["d", "word"] and asked == [["key_of_row", "word"]]
    assert {c: f["distinct"] for c, f in q.base.items()} == {"key_of_row": 60, "a": 7, "b": 7, "c": 12, "d": 1, "e": 3, "word": 1}
    assert asked[1:] == [["a", "b", "c", "d", "e"]]  # the rest, once


def test_text_tfidf_query_sums_sparse_weights(spark, tmp_path):
    from prepforge.queries import all_queries
    rows = [(0, "red red blue"), (1, "blue green"), (2, None), (3, "Red")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = all_queries()["pr_text_tfidf"](spark, str(tmp_path))
    assert "vector_to_array" not in out._jdf.queryExecution().toString() and "unwrap_udt" in out._jdf.queryExecution().toString()
    got = {r["doc_id"]: r["total_weight"] for r in out.collect()}
    two, one = np.log(5 / 3), np.log(5 / 2)
    assert got == pytest.approx({0: 3 * two, 1: two + one, 2: one, 3: two})


def test_tfidf_terms_shuffles_only_rare_words(spark, monkeypatch):
    from prepforge.operators import profile
    texts = [f"the cat{i % 40} and the dog{i}" for i in range(200)] + [None, ""]
    df = spark.createDataFrame([(i // 2 if i < 4 else i, t) for i, t in enumerate(texts)], "id bigint, text string")  # two keys twice
    whole = {(r["id"], r["term"]): (r["tf"], r["weight"]) for r in profile.tfidf_terms(df, "id", "text").collect()}
    assert whole[5, "the"] == (2, pytest.approx(2 * np.log(203 / 199))) and whole[0, "the"][0] == 4 and whole[0, "dog1"][0] == 1
    for rows in (50, 1):
        monkeypatch.setattr(profile, "BROADCAST_ROWS", rows, raising=False)
        out = profile.tfidf_terms(df, "id", "text")
        assert {(r["id"], r["term"]): (r["tf"], r["weight"]) for r in out.collect()} == whole
        assert out.count() == len(whole)
        assert "LeftAnti" in out._jdf.queryExecution().toString()  # words of the broadcast stay out of the shuffle


def test_robust_inputs_take_their_quantiles_in_one_pass(spark, monkeypatch):
    asked = []

    def counted(df, columns, probs, *rest):
        asked.append(list(columns))
        return exact_quantiles(df, columns, probs, *rest)

    monkeypatch.setattr(encode, "exact_quantiles", counted)
    rng = np.random.default_rng(3)
    a, b = rng.normal(0, 1, 41), rng.normal(5, 2, 41)
    df = spark.createDataFrame([(float(x), None if i % 4 == 0 else float(y)) for i, (x, y) in enumerate(zip(a, b))], "a double, b double")
    for names, calls in ((["a"], [["a"]]), (["a", "b"], [["a", "b"], ["b"]])):  # only the filled column is asked again
        asked.clear()
        got = encode.fit_model_inputs(df, names, "robust").transform(df).toPandas()
        assert asked == calls
        for c in names:
            x = np.where(np.arange(41) % 4 == 0, np.median(b[np.arange(41) % 4 != 0]), b) if c == "b" else a
            low, mid, high = np.quantile(x, [0.25, 0.5, 0.75])
            assert np.allclose(got[f"x_{c}"], (x - mid) / (high - low))


def test_correlations_without_gaps_need_no_function_per_pair(spark, monkeypatch):
    rng = np.random.default_rng(11)
    a = rng.normal(0, 1, 300)
    x = np.column_stack([a, 2 * a + 1, a + rng.normal(0, 1, 300), 1e9 - a, rng.integers(0, 2, 300)]).astype(float)
    names = list("abcde")
    df = spark.createDataFrame(pd.DataFrame(x, columns=names))
    gaps = df.withColumn("a", F.expr("IF(a > 1, NULL, a)"))
    slow = stats.pair_correlations(gaps, names)
    kept = x[~(x[:, 0] > 1)]
    assert slow["a", "c"] == pytest.approx(np.corrcoef(kept[:, 0], kept[:, 2])[0, 1]) and slow["b", "c"] == pytest.approx(np.corrcoef(x[:, 1], x[:, 2])[0, 1])

    def refused(*_):
        raise AssertionError("one aggregate function for each pair")

    monkeypatch.setattr(stats.F, "corr", refused)
    got = stats.pair_correlations(df, names)
    want = np.corrcoef(x.T)
    assert all(r == pytest.approx(want[names.index(i), names.index(j)], abs=1e-7) for (i, j), r in got.items()) and len(got) == 10
