"""Shared functions against numpy, closed forms and known tables."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from prepforge.functions import distributions as dist
from prepforge.functions import frame
from prepforge.functions.graph import connected_components
from prepforge.functions.projection import Projection
from prepforge.functions.quantiles import exact_quantiles, exact_quantiles_by


def test_t_table():
    for p, dof, value in [(0.975, 10, 2.228139), (0.95, 5, 2.015048), (0.995, 30, 2.749996), (0.975, 1, 12.706205)]:
        assert dist.t_quantile(p, dof) == pytest.approx(value, abs=1e-5)
        assert dist.t_cdf(value, dof) == pytest.approx(p, abs=1e-6)


def test_f_and_chi2_table():
    assert dist.f_tail(3.098391, 3, 20) == pytest.approx(0.05, abs=1e-6)
    assert dist.chi2_tail(9.487729, 4) == pytest.approx(0.05, abs=1e-6)
    assert dist.chi2_tail(0.710723, 4) == pytest.approx(0.95, abs=1e-6)


def test_quantiles_bracketed_equal_numpy(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.lognormal(0, 2, 3000), np.full(1500, 7.0), rng.integers(0, 5, 1500)])
    df = spark.createDataFrame(pd.DataFrame({"x": values, "g": np.arange(len(values)) % 3}))
    probs = [0.0, 0.01, 0.25, 0.5, 0.77, 1.0]
    for limit in (10, 500, 10**6):
        got = exact_quantiles(df, ["x"], probs, direct_rows=limit)["x"]
        assert got == pytest.approx(list(np.quantile(values, probs)), rel=1e-12)
    rows = {r["g"]: list(r["q"]) for r in exact_quantiles_by(df, "g", "x", [0.3, 0.9], direct_rows=50).collect()}
    for g in range(3):
        assert rows[g] == pytest.approx(list(np.quantile(values[np.arange(len(values)) % 3 == g], [0.3, 0.9])), rel=1e-12)


def test_quantiles_ignore_missing_and_empty(spark):
    df = spark.createDataFrame([(1.0, None), (float("nan"), None), (3.0, None), (None, None)], "a double, b double")
    assert exact_quantiles(df, ["a", "b"], [0.5]) == {"a": [2.0], "b": [None]}
    assert exact_quantiles(df.limit(0), ["a"], [0.5]) == {"a": [None]}


def test_numbered_and_cumulative_by_ranges(spark):
    df = spark.range(500).select(((F.col("id") * 37) % 500).alias("k"), F.lit(2).cast("bigint").alias("v"))
    got = frame.numbered(df, ["k"], "n", single_task_rows=10)
    assert got.where("n <> k").count() == 0 and got.count() == 500
    run = frame.cumulative(df, "k", ["v"], descending=True, single_task_rows=10)
    assert run.where("run_v <> 2 * (500 - k)").count() == 0


def test_lookup_beyond_the_broadcast_limit_keeps_hot_and_null_keys(spark, monkeypatch):
    rows = [("hot",)] * 300 + [(f"k{i}",) for i in range(200)] + [(None,), ("absent",)]
    df = spark.createDataFrame(rows, "k string")
    words = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i + 2) for i in range(200)], "k string, code int")
    small = sorted(map(str, frame.lookup(df, words, "k").select("k", "code").collect()))
    monkeypatch.setattr(frame, "small_or_none", lambda *a, **b: False)
    assert sorted(map(str, frame.lookup(df, words, "k").select("k", "code").collect())) == small and len(small) == 502


def test_components_on_a_long_chain(spark):
    chain = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 102), (102, 100)]
    got = {r["id"]: r["root"] for r in connected_components(spark.createDataFrame(chain, "src bigint, dst bigint")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 100, 101: 100, 102: 100}


def test_names_and_literals(spark):
    text = "it's \\ `odd`"
    df = spark.createDataFrame([(text, 1)], ["we`ird", "n"])
    out = Projection(add={"hit": f"{frame.quote('we`ird')} = {frame.literal_sql(text)}"}).transform(df)
    assert out.head()["hit"] is True
    assert frame.nan_to_null(spark.createDataFrame([(math.nan,), (1.0,)], "a double")).where("a IS NULL").count() == 1


def test_quantiles_of_many_groups_on_both_sides_of_the_limit(spark):
    rows = spark.range(240_000).select((F.col("id") % 100_000).alias("g"), ((F.col("id") * 7919) % 1009).cast("double").alias("x"))
    hot = spark.range(60_000).select(F.lit(7).cast("bigint").alias("g"), F.sqrt(F.col("id").cast("double")).alias("x"))
    df = rows.unionByName(hot)
    want = df.groupBy("g").agg(F.expr("percentile(x, array(0.25, 0.5, 0.9))").alias("w"))
    for limit in (1000, 10**6):  # one group is bracketed, then none
        got = exact_quantiles_by(df, "g", "x", [0.25, 0.5, 0.9], direct_rows=limit)
        off = got.join(want, "g").where("exists(zip_with(q, w, (a, b) -> abs(a - b) > 1e-9), x -> x)").count()
        assert got.count() == 100_000 and off == 0


def test_components_by_rounds_equal_one_task(spark, monkeypatch):
    from prepforge.functions import graph
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000, i) for i in range(1001, 1200)]  # a hub
    df = spark.createDataFrame(edges, "src bigint, dst bigint").repartition(6)
    one = {r["id"]: r["root"] for r in connected_components(df).collect()}
    monkeypatch.setattr(graph, "ONE_TASK_EDGES", 0)
    monkeypatch.setattr(graph, "small_or_none", lambda *a: False)
    assert one == {r["id"]: r["root"] for r in connected_components(df).collect()} and set(one[i] for i in range(1000, 1200)) == {1000}
