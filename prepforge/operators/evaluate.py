"""Evaluation: aggregates over a table of labels, predictions and scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.blocks import PIECE, block_join, distances, matrix
from ..functions.fields import NODES, distance_sums
from ..functions.frame import col, cumulative, finite, is_numeric, lookup, quote, settle
from .charts import histogram, keyed_sample
from .neighbors import vectors

FIELD_ROWS = 4096   # a cluster with more rows on a line or in a plane is summed by cells instead of pairs
PARTS = 2048        # cells of clusters whose centres go to every task
BLOCK_BYTES = 1 << 23  # vectors of a block


def pair_counts(df: DataFrame, label: str, prediction: str, by: list[str] | None = None) -> DataFrame:
    keys = [col(b) for b in by or []]
    return df.groupBy(*keys, col(label).alias("actual"), col(prediction).alias("predicted")).agg(F.count(F.lit(1)).alias("count"))


def confusion_matrix(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """(actual, predicted, count) for every pair of classes, zeros included (classes², not rows)."""
    pairs = pair_counts(df, label, prediction)
    classes = pairs.select(F.explode(F.array("actual", "predicted")).alias("k")).agg(F.collect_set("k").alias("ks"))
    grid = classes.select("ks", F.explode("ks").alias("actual")).select("actual", F.explode("ks").alias("predicted"))
    return grid.join(pairs, ["actual", "predicted"], "left").select("actual", "predicted", F.coalesce("count", F.lit(0)).alias("count"))


def class_table(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """True positives, predicted and actual counts per class from the pair counts."""
    keys = list(by or [])
    tags = F.array(F.struct(F.col("actual").alias("class"), F.when(F.col("actual") == F.col("predicted"), F.col("count")).otherwise(0).alias("tp"), F.col("count").alias("support"), F.lit(0).cast("bigint").alias("chosen")),
                   F.struct(F.col("predicted").alias("class"), F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("support"), F.col("count").alias("chosen")))
    return pairs.select(*keys, F.inline(tags)).groupBy(*keys, "class").agg(*[F.sum(c).alias(c) for c in ("tp", "support", "chosen")])


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b > 0, a / b).otherwise(0.0)


def class_scores(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    t = class_table(pairs, by)
    p, r = ratio(F.col("tp"), F.col("chosen")), ratio(F.col("tp"), F.col("support"))
    t = t.withColumns({"precision": p, "recall": r})
    both = F.col("precision") + F.col("recall")
    return t.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), both))


def classification_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """(class, precision, recall, f1, support) per class, then accuracy, macro and weighted averages."""
    scores = class_scores(pair_counts(df, label, prediction))
    names = ("precision", "recall", "f1")
    per = scores.select(F.col("class").cast("string").alias("class"), *names, "support")
    w = F.col("support")
    macro = scores.agg(*[F.avg(n).alias(n) for n in names], F.sum("support").alias("support")).select(F.lit("macro avg").alias("class"), *names, "support")
    weighted = scores.agg(*[(F.sum(F.col(n) * w) / F.sum(w)).alias(n) for n in names], F.sum("support").alias("support")).select(F.lit("weighted avg").alias("class"), *names, "support")
    acc = scores.agg((F.sum("tp") / F.sum("support")).alias("a"), F.sum("support").alias("support"))
    accuracy = acc.select(F.lit("accuracy").alias("class"), *[F.col("a").alias(n) for n in names], "support")
    return per.unionByName(accuracy).unionByName(macro).unionByName(weighted)


def band(value: Column, limits: list[tuple[float, str]], rest: str) -> Column:
    out = None
    for limit, name in limits:
        out = F.when(value >= limit, name) if out is None else out.when(value >= limit, name)
    return out.otherwise(rest)


# Limits of the quality bands.
SCORE_BANDS = [(0.9, "excellent"), (0.8, "good"), (0.7, "fair")]
SILHOUETTE_BANDS = [(0.7, "strong"), (0.5, "reasonable"), (0.25, "weak")]


def classification_scores(df: DataFrame, label: str, prediction: str, positive=1, average: str = "auto", by: list[str] | None = None) -> DataFrame:
    """([by,] accuracy, precision, recall, f1, rows, performance_band).

    At most two classes: the scores of the positive class; more: support-weighted averages.
    """
    keys = list(by or [])
    scores = class_scores(pair_counts(df, label, prediction, by), by)
    mean = {n: F.sum(F.col(n) * F.col("support")) / F.sum("support") for n in ("precision", "recall", "f1")}
    hit = F.col("class") == F.lit(positive) if is_numeric(scores.schema["class"].dataType) else F.col("class") == F.lit(str(positive))
    one = {n: F.coalesce(F.max(F.when(hit, F.col(n))), F.lit(0.0)) for n in mean}
    binary = {"auto": F.count(F.lit(1)) <= 2, "binary": F.lit(True), "weighted": F.lit(False)}[average]
    picked = [F.when(binary, one[n]).otherwise(mean[n]).alias(n) for n in mean]
    out = scores.groupBy(*[col(k) for k in keys]).agg((F.sum("tp") / F.sum("support")).alias("accuracy"), *picked, F.sum("support").alias("rows"))
    return out.withColumn("performance_band", band(F.col("accuracy"), SCORE_BANDS, "poor"))


def roc_points(df: DataFrame, label: str, score: str, positive=1, thresholds: int | None = None) -> DataFrame:
    """(threshold, tp, fp, positives, negatives, at, neg): counts at or above each distinct score.

    Rows are first summed per score; only those sums are accumulated, by ranges when they are many.
    ``thresholds`` rounds scores down to a grid first.
    """
    s = finite(df, score)
    if thresholds:
        s = F.floor(s * thresholds) / thresholds
    hit = (col(label) == F.lit(positive)).cast("bigint")
    sums = df.where(s.isNotNull() & col(label).isNotNull()).groupBy(s.alias("threshold")).agg(F.sum(hit).alias("pos"), F.sum(1 - hit).alias("neg"))
    totals = sums.agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))
    run = cumulative(sums, "threshold", ["pos", "neg"], descending=True)
    return run.crossJoin(F.broadcast(totals)).select("threshold", F.col("run_pos").alias("tp"), F.col("run_neg").alias("fp"), "pos", "neg", "positives", "negatives")


def roc_curve(df: DataFrame, label: str, score: str, positive=1, thresholds: int | None = None) -> DataFrame:
    """(threshold, fpr, tpr); the starting point (0, 0) has no threshold.  A rate over no rows is NULL."""
    p = roc_points(df, label, score, positive, thresholds)
    rates = p.select("threshold", F.try_divide("fp", "negatives").alias("fpr"), F.try_divide("tp", "positives").alias("tpr"))
    start = df.sparkSession.range(1).select(F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return rates.unionByName(start)


def auc(df: DataFrame, label: str, score: str, positive=1, thresholds: int | None = None) -> DataFrame:
    """(auc, positives, negatives, performance_band) by the trapezoid rule, exact for tied scores; NULL with one class only."""
    p = roc_points(df, label, score, positive, thresholds)
    area = F.sum(F.col("neg") * (2 * F.col("tp") - F.col("pos"))) / 2.0
    out = p.agg(area.alias("a"), F.max("positives").alias("positives"), F.max("negatives").alias("negatives"))
    value = F.try_divide(F.col("a"), F.col("positives") * F.col("negatives")).alias("auc")
    return out.select(value, "positives", "negatives").withColumn("performance_band", band(F.col("auc"), SCORE_BANDS, "poor"))


def class_distribution(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """(class, actual, predicted, accuracy) per class."""
    t = class_table(pair_counts(df, label, prediction))
    return t.select("class", F.col("support").alias("actual"), F.col("chosen").alias("predicted"), ratio(F.col("tp"), F.col("support")).alias("accuracy"))


def regression_metrics(df: DataFrame, label: str, prediction: str, features: int | None = None, by: list[str] | None = None) -> DataFrame:
    """([by,] r2, adjusted_r2, mae, mse, rmse, mape, rows, regression_band, advice_band) in one pass.

    Zero actuals count 0 in the percentage error.
    """
    y, p = finite(df, label), finite(df, prediction)
    rows = df.where(y.isNotNull() & p.isNotNull())
    err = y - p
    out = rows.groupBy(*[col(k) for k in by or []]).agg(
        F.sum(err * err).alias("sse"), F.var_pop(y).alias("v"), F.count(F.lit(1)).alias("rows"), F.avg(F.abs(err)).alias("mae"), F.avg(err * err).alias("mse"),
        (100 * F.avg(F.when(y != 0, F.abs(err / y)).otherwise(0.0))).alias("mape"))
    r2 = F.when(F.col("v") > 0, 1 - F.col("mse") / F.col("v"))
    out = out.withColumn("r2", r2).withColumn("rmse", F.sqrt("mse"))
    p_count = F.lit(features if features is not None else 1)
    spare = F.col("rows") - p_count - 1
    adjusted = F.when(spare > 0, 1 - (1 - F.col("r2")) * (F.col("rows") - 1) / spare)
    good = F.when(F.col("r2") > 0.7, "good").when(F.col("r2") > 0.5, "moderate").otherwise("poor")
    advice = F.when(F.col("r2") < 0.5, "low").when(F.col("r2") < 0.8, "medium").otherwise("high")
    out = out.withColumns({"adjusted_r2": adjusted, "regression_band": good, "advice_band": advice})
    return out.select(*[col(k) for k in by or []], "r2", "adjusted_r2", "mae", "mse", "rmse", "mape", "rows", "regression_band", "advice_band")


def residuals(df: DataFrame, label: str, prediction: str) -> DataFrame:
    y, p = finite(df, label), finite(df, prediction)
    return df.withColumns({"residual": y - p, "abs_residual": F.abs(y - p)})


def residual_histogram(df: DataFrame, label: str, prediction: str, bins: int = 20) -> DataFrame:
    return histogram(residuals(df, label, prediction), "residual", bins)


def actual_predicted_histogram(df: DataFrame, label: str, prediction: str, bins: int = 20) -> DataFrame:
    """(series, bin, lower, upper, count) of both columns on shared edges."""
    pair = F.array(F.struct(F.lit("actual").alias("series"), finite(df, label).alias("value")), F.struct(F.lit("predicted").alias("series"), finite(df, prediction).alias("value")))
    return histogram(df.select(F.inline(pair)), "value", bins, "series")


def subgroup_metrics(df: DataFrame, by: str, label: str, prediction: str, task: str = "classification") -> DataFrame:
    if task == "classification":
        return classification_scores(df, label, prediction, by=[by])
    return regression_metrics(df, label, prediction, by=[by])


# -- clusters ----------------------------------------------------------------------------------

def spread_columns(df: DataFrame, columns: list[str] | str, keep: list[str]) -> tuple[DataFrame, list[str]]:
    """Plain double columns x0.. from numeric columns or one array column whose vectors must have one length."""
    if isinstance(columns, str):
        sizes = df.where(col(columns).isNotNull()).agg(F.min(F.size(col(columns))), F.max(F.size(col(columns)))).head()
        if sizes[0] != sizes[1]:
            raise ValueError(f"vectors of {columns} have {sizes[0]} to {sizes[1]} components")
        width = sizes[0] or 0
        xs = [F.get(col(columns), F.lit(i)).cast("double") for i in range(width)]
    else:
        xs = [col(c).cast("double") for c in columns]
    return df.select(*[col(k) for k in keep], *[x.alias(f"x{i}") for i, x in enumerate(xs)]), [f"x{i}" for i in range(len(xs))]


def _cluster_centres(flat: DataFrame, xs: list[str], extra: list[Column], max_clusters: int) -> tuple[DataFrame, list]:
    """((cluster, slot), statistics by slot) of a table with ``cluster``; the clusters must be few enough for every task."""
    stats = flat.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *extra, *[F.avg(x).alias(x) for x in xs]).limit(max_clusters + 1).collect()
    if len(stats) > max_clusters:
        raise ValueError(f"more than {max_clusters} clusters")
    slots = flat.sparkSession.createDataFrame([(r["cluster"], i) for i, r in enumerate(stats)], f"cluster {flat.schema['cluster'].dataType.simpleString()}, slot int")
    return F.broadcast(slots), stats


def _linear_silhouettes(slotted: DataFrame, key: str, means: np.ndarray, q: np.ndarray, n: np.ndarray, cosine: bool) -> DataFrame:
    """(id, silhouette) from (id, v, slot) when the mean distance to a cluster follows from its mean vector."""
    def scores(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x, own = matrix(pdf["v"]), pdf["slot"].to_numpy()
            norm = (x * x).sum(1)
            d = 1.0 - x @ means.T if cosine else norm[:, None] - 2 * x @ means.T + q
            at, size = np.arange(len(x)), n[own]
            itself = 1.0 - norm if cosine else 0.0
            a = (d[at, own] * size - itself) / np.maximum(size - 1, 1)
            d[at, own] = np.inf
            b = d.min(1)
            top = np.maximum(a, b)
            s = np.where((size > 1) & np.isfinite(b) & (top > 0), (b - a) / np.where(top > 0, top, 1), 0.0)
            yield pd.DataFrame({"id": pdf["id"].to_numpy(), "silhouette": s})

    return slotted.mapInPandas(scores, f"id {key}, silhouette double")


def silhouette_rows(df: DataFrame, key: str, columns: list[str] | str, cluster: str, sample: int | None = None, metric: str = "euclidean", max_clusters: int = 10_000) -> DataFrame:
    """(id, cluster, silhouette) with plain distances, exact; rows without a cluster are left out.

    Cosine: the sum of the distances to a cluster follows from its vector sum, so the work is linear.  Other metrics:
    the mean distance to a cluster lies between the distance to its centre and that plus its mean radius, so a row is
    measured against its own cluster and the few that can be the nearest other one, block by block; no
    pairs are returned.  Plain Euclidean distances on a line or in a plane are summed by cells (``distance_sums``) once a
    cluster is large.  ``sample`` takes the rows with the smallest key hashes; ``silhouette_sq`` serves any size.
    """
    chosen = keyed_sample(df, [key], sample)
    rows = settle(chosen.where(col(cluster).isNotNull()).select(col(key).alias("id"), col(cluster).alias("cluster"), vectors(chosen, columns, metric).alias("v")))
    flat, xs = spread_columns(rows, "v", ["cluster"])
    if not xs:
        return rows.select("id", "cluster", F.lit(0.0).alias("silhouette"))
    itype = rows.schema["id"].dataType.simpleString()
    slots, stats = _cluster_centres(flat, xs, [], max_clusters)
    slotted = rows.join(slots, "cluster").select("id", "v", "slot")
    centres, n = np.array([[r[x] for x in xs] for r in stats]), np.array([r["n"] for r in stats], dtype="float64")
    if metric == "cosine":
        return rows.select("id", "cluster").join(_linear_silhouettes(slotted, itype, centres, np.zeros(len(n)), n, True), "id")

    def radii(batches):
        for pdf in batches:
            own = pdf["slot"].to_numpy()
            if len(pdf):
                gap = matrix(pdf["v"]) - centres[own]
                yield pd.DataFrame({"slot": own, "r": np.abs(gap).sum(1) if metric == "manhattan" else np.sqrt((gap * gap).sum(1))})

    radius = np.zeros(len(n))
    for r in slotted.select("v", "slot").mapInPandas(radii, "slot int, r double").groupBy("slot").agg(F.avg("r").alias("r")).collect():
        radius[r["slot"]] = r["r"]

    def bounds(x):
        """The mean distance of each row to each cluster lies between these."""
        d = distances(x, centres, metric)
        return d, d + radius

    def asks(table, bounds):
        kind = table.schema["id"].dataType.simpleString()

        def candidates(batches):
            for pdf in batches:
                if not len(pdf):
                    continue
                own = pdf["slot"].to_numpy()
                least, most = bounds(matrix(pdf["v"]))
                other = np.arange(len(n))[None, :] != own[:, None]
                open_ = ~other | (least <= (np.where(other, most, np.inf).min(1, initial=np.inf) * (1 + 1e-9))[:, None])
                row, slot = np.nonzero(open_)
                picked = pdf.iloc[row]
                yield pd.DataFrame({"id": picked["id"].to_numpy(), "v": picked["v"].to_numpy(), "own": own[row], "slot": slot.astype("int32")})

        return table.mapInPandas(candidates, f"id {kind}, v array<double>, own int, slot int")

    def sums(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        x, y = matrix(a["v"]), matrix(b["v"])
        step = max(16, PIECE // len(y))
        total = np.concatenate([distances(x[s:s + step], y, metric, product=True).sum(1) for s in range(0, len(x), step)])
        return pd.DataFrame({"id": a["id"].to_numpy(), "own": a["own"].to_numpy(), "slot": b["slot"].iloc[0], "total": total})

    unfit = "exists(v, x -> x IS NULL OR isnan(x) OR abs(x) = double('Infinity'))"
    in_cells = metric == "euclidean" and len(xs) in NODES and n.max() > FIELD_ROWS and not slotted.where(unfit).limit(1).count()
    if in_cells:  # equal rows of a cluster ask once and count by their number
        points = settle(slotted.groupBy("v", "slot").agg(F.count(F.lit(1)).alias("weight")).withColumn("id", F.monotonically_increasing_id()))
        at = [F.get("v", F.lit(i)).alias(x) for i, x in enumerate(xs)]
        totals = distance_sums(settle(asks(points, _part_bounds(points, n, len(xs)) or bounds).select("id", "slot", *at)), points.select("slot", "weight", *at), len(xs))
        totals = totals.groupBy("id", "slot").agg(F.sum("total").alias("total")).join(points.select("id", F.col("slot").alias("own")), "id")
    else:
        totals = block_join(asks(slotted, bounds), slotted, "slot", sums, f"id {itype}, own int, slot int, total double", rows=_sum_rows(n.sum(), len(xs)))
        totals = totals.groupBy("id", "own", "slot").agg(F.sum("total").alias("total"))
    sizes = F.broadcast(df.sparkSession.createDataFrame([(i, int(c)) for i, c in enumerate(n)], "slot int, n bigint"))
    totals = totals.join(sizes, "slot")
    mine = F.col("slot") == F.col("own")
    per = totals.groupBy("id").agg(
        F.max(F.when(mine & (F.col("n") > 1), F.col("total") / (F.col("n") - 1))).alias("a"),
        F.min(F.when(~mine, F.col("total") / F.col("n"))).alias("b"))
    s = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise(ratio(F.col("b") - F.col("a"), F.greatest("a", "b")))
    scored = per.select("id", s.alias("silhouette"))
    if not in_cells:
        return rows.select("id", "cluster").join(scored, "id")
    scored = settle(points.join(scored, "id").select(F.struct("v", "slot").alias("place"), "silhouette"))
    placed = rows.join(slots, "cluster").select("id", "cluster", F.struct("v", "slot").alias("place"))
    return lookup(placed, scored, "place").select("id", "cluster", "silhouette")


def _part_bounds(points: DataFrame, n: np.ndarray, width: int):
    """Bounds of the mean plain distance to each cluster from the centres and deviations of its parts, at most PARTS in all; None if there are more clusters."""
    at = [F.get("v", F.lit(i)) for i in range(width)]
    ends = points.agg(*[f(x) for x in at for f in (F.min, F.max)]).head()
    size = max(ends[2 * i + 1] - ends[2 * i] for i in range(width)) or 1.0
    for level in range(8, -1, -1):
        cells = [F.floor((x - F.lit(ends[2 * i])) / F.lit(size / (1 << level))) for i, x in enumerate(at)]
        w = F.sum("weight")
        parts = points.groupBy("slot", *cells).agg(w.alias("w"), *[(F.sum(F.col("weight") * x) / w).alias(f"x{i}") for i, x in enumerate(at)], *[(F.sum(F.col("weight") * (x - F.lit(ends[2 * i])) * (x - F.lit(ends[2 * i]))) / w).alias(f"q{i}") for i, x in enumerate(at)])
        found = parts.limit(PARTS + 1).collect()
        if len(found) <= PARTS:
            break
    else:
        return None
    found.sort(key=lambda r: r["slot"])
    slot, mass = np.array([r["slot"] for r in found]), np.array([r["w"] for r in found], dtype="float64")
    middle = np.array([[r[f"x{i}"] for i in range(width)] for r in found])
    low = np.array([ends[2 * i] for i in range(width)])
    spread = sum(np.maximum(np.array([r[f"q{i}"] for r in found]) - (middle[:, i] - low[i]) ** 2, 0.0) for i in range(width)) + 1e-12 * size * size
    starts, share = np.searchsorted(slot, np.arange(len(n))), mass / n[slot]

    def bounds(x):
        least, most = np.empty((len(x), len(n))), np.empty((len(x), len(n)))
        for s in range(0, len(x), 500):
            square = sum((x[s:s + 500, None, i] - middle[None, :, i]) ** 2 for i in range(width))
            least[s:s + 500] = np.add.reduceat(np.sqrt(square) * share, starts, axis=1)
            most[s:s + 500] = np.add.reduceat(np.sqrt(square + spread) * share, starts, axis=1)
        return least, most

    return bounds


def _sum_rows(n: float, width: int) -> int:
    """Rows of a block: about 32 blocks of the table, so that rows are sent a fixed number of times, up to BLOCK_BYTES of vectors."""
    return int(max(2048, min(n // 32, BLOCK_BYTES // (8 * width))))


def silhouette(df: DataFrame, key: str, columns: list[str] | str, cluster: str, sample: int | None = None, metric: str = "euclidean", max_clusters: int = 10_000) -> DataFrame:
    """(silhouette, rows, silhouette_band)."""
    rows = silhouette_rows(df, key, columns, cluster, sample, metric, max_clusters)
    return rows.agg(F.avg("silhouette").alias("silhouette"), F.count(F.lit(1)).alias("rows")).withColumn("silhouette_band", band(F.col("silhouette"), SILHOUETTE_BANDS, "none"))


def silhouettes(df: DataFrame, which: list[int], metric: str = "euclidean", sample: int | None = None, max_clusters: int = 10_000) -> dict[int, float | None]:
    """The silhouette of each labelling in ``which`` of (row_id, v, clusters), where ``clusters`` holds a number from 0 for each labelling, -1 for none.

    Clusters of the same rows count as one in all labellings that have them: labellings of the same clusters share a score, and
    on a line or in a plane the distances to a shared cluster are summed once.
    """
    rows = settle(df.withColumn("place", F.monotonically_increasing_id()))
    held = rows.select("place", F.posexplode("clusters").alias("k", "cluster")).where((F.col("cluster") >= 0) & F.col("k").isin(which))
    marks = [F.bit_xor(F.xxhash64("place", F.lit(i))).alias(f"m{i}") for i in range(2)]
    seen = held.groupBy("k", "cluster").agg(F.count(F.lit(1)).alias("n"), *marks).limit(len(which) * max_clusters + 1).collect()
    slots: dict[tuple, int] = {}
    parts: dict[int, dict[int, int]] = {k: {} for k in which}
    for r in seen:
        parts[r["k"]][r["cluster"]] = slots.setdefault((r["n"], r["m0"], r["m1"]), len(slots))
    if any(len(p) > max_clusters for p in parts.values()):
        raise ValueError(f"more than {max_clusters} clusters")
    same: dict[frozenset, list[int]] = {}
    for k in which:
        same.setdefault(frozenset(parts[k].values()), []).append(k)
    first = [ks[0] for ks in same.values()]
    n = np.array([float(key[0]) for key in slots])
    scores: dict[int, float | None] = {}
    large = [k for k in first if n[list(parts[k].values())].max(initial=0) > FIELD_ROWS] if metric == "euclidean" and sample is None else []
    if large:
        unfit = "v IS NULL OR exists(v, x -> x IS NULL OR isnan(x) OR abs(x) = double('Infinity'))"
        width = rows.agg(F.min(F.size("v")).alias("a"), F.max(F.size("v")).alias("b")).head()
        labelled = rows.where(F.exists("clusters", lambda c: c >= 0))
        if width["a"] == width["b"] and width["b"] in NODES and not labelled.where(unfit).limit(1).count():
            scores = _silhouettes_by_cells(labelled, width["b"], {k: parts[k] for k in large}, n)
    for k in first:
        if k not in scores:
            one = rows.select("row_id", "v", F.get("clusters", F.lit(k)).alias("cluster")).where("cluster >= 0")
            scores[k] = silhouette(one, "row_id", "v", "cluster", sample, metric, max_clusters).head()["silhouette"]
    return {k: scores[ks[0]] for ks in same.values() for k in ks}


def _silhouettes_by_cells(rows: DataFrame, width: int, parts: dict[int, dict[int, int]], n: np.ndarray) -> dict[int, float]:
    """Mean silhouettes of the labellings ``parts`` ({cluster: slot}) of (v, clusters); a slot is a set of ``n`` rows, whatever it is called."""
    spark, which = rows.sparkSession, list(parts)
    names = [[parts[k].get(c, -1) for c in range(max(parts[k], default=-1) + 1)] for k in which]
    named = F.broadcast(spark.createDataFrame([(names,)], "named array<array<int>>"))
    slots = F.array(*[F.when(F.get("clusters", F.lit(k)) >= 0, F.get(F.get("named", F.lit(i)), F.get("clusters", F.lit(k)).cast("int"))).otherwise(-1) for i, k in enumerate(which)])
    points = rows.groupBy("v", "clusters").agg(F.count(F.lit(1)).alias("weight")).crossJoin(named)
    points = settle(points.select("v", slots.alias("slots"), "weight", F.monotonically_increasing_id().alias("id")))
    at = [F.get("v", F.lit(i)).alias(f"x{i}") for i in range(width)]
    measured = settle(points.select(F.explode(F.array_distinct(F.filter("slots", lambda s: s >= 0))).alias("slot"), "weight", "v"))
    members = np.zeros((len(which), len(n)), dtype=bool)
    for i, k in enumerate(which):
        members[i, list(parts[k].values())] = True
    bounds = _part_bounds(measured, n, width)
    if bounds is None:
        w, centres, radius = F.sum("weight"), np.zeros((len(n), width)), np.zeros(len(n))
        for r in measured.groupBy("slot").agg(*[(F.sum(F.col("weight") * x) / w).alias(f"x{i}") for i, x in enumerate(at)]).collect():
            centres[r["slot"]] = [r[f"x{i}"] for i in range(width)]

        def gaps(batches):
            for pdf in batches:
                if len(pdf):
                    gap = matrix(pdf["v"]) - centres[pdf["slot"].to_numpy()]
                    yield pd.DataFrame({"slot": pdf["slot"], "w": pdf["weight"].astype("float64"), "r": np.sqrt((gap * gap).sum(1))})

        apart = measured.mapInPandas(gaps, "slot int, w double, r double").groupBy("slot").agg((F.sum(F.col("w") * F.col("r")) / F.sum("w")).alias("r"))
        for r in apart.collect():
            radius[r["slot"]] = r["r"]

        def bounds(x):
            d = distances(x, centres, "euclidean")
            return d, d + radius

    def candidates(batches):
        """A point asks for its own clusters and, in each labelling, for the others that can be the nearest."""
        for pdf in batches:
            if not len(pdf):
                continue
            x, own = matrix(pdf["v"]), np.stack(pdf["slots"].to_numpy())
            least, most = bounds(x)
            open_ = np.zeros(least.shape, dtype=bool)
            for i in range(len(which)):
                mine = np.flatnonzero(own[:, i] >= 0)
                other = np.broadcast_to(members[i], (len(mine), len(n))).copy()
                other[np.arange(len(mine)), own[mine, i]] = False
                nearest = np.where(other, most[mine], np.inf).min(1, initial=np.inf) * (1 + 1e-9)
                open_[mine] |= other & (least[mine] <= nearest[:, None])
                open_[mine, own[mine, i]] = True
            row, slot = np.nonzero(open_)
            yield pd.DataFrame({"id": pdf["id"].to_numpy()[row], "slot": slot.astype("int32"), **{f"x{i}": x[row, i] for i in range(width)}})

    asked = settle(points.select("id", "v", "slots").mapInPandas(candidates, "id bigint, slot int, " + ", ".join(f"x{i} double" for i in range(width))))
    totals = distance_sums(asked, measured.select("slot", "weight", *at), width).groupBy("id", "slot").agg(F.sum("total").alias("total"))
    facts = F.broadcast(spark.createDataFrame([(i, int(c), np.flatnonzero(members[:, i]).tolist()) for i, c in enumerate(n)], "slot int, n bigint, having array<int>"))
    totals = totals.join(facts, "slot").groupBy("id").agg(F.collect_list(F.struct("slot", "total", "n", "having")).alias("sums"))
    found = points.select("id", "slots", "weight").join(totals, "id")
    means = []
    for i in range(len(which)):
        own = F.get("slots", F.lit(i))
        a = F.array_max(F.transform(F.filter("sums", lambda s: (s["slot"] == own) & (s["n"] > 1)), lambda s: s["total"] / (s["n"] - 1)))
        b = F.array_min(F.transform(F.filter("sums", lambda s: (s["slot"] != own) & F.array_contains(s["having"], F.lit(i))), lambda s: s["total"] / s["n"]))
        found = found.withColumns({f"a{i}": a, f"b{i}": b})
        a, b = F.col(f"a{i}"), F.col(f"b{i}")
        score = F.when(a.isNull() | b.isNull(), 0.0).otherwise(ratio(b - a, F.greatest(a, b)))
        means.append((F.sum(F.when(own >= 0, score * F.col("weight"))) / F.sum(F.when(own >= 0, F.col("weight")))).alias(f"s{i}"))
    out = found.agg(*means).head()
    return {k: out[f"s{i}"] for i, k in enumerate(which)}


def silhouette_sq(df: DataFrame, columns: list[str] | str, cluster: str, max_clusters: int = 10_000) -> DataFrame:
    """Mean silhouette with squared distances: linear in the rows through cluster sums.

    The mean squared distance of x to a cluster is |x|² - 2 x·mean + mean|y|², so tasks need only the
    cluster means.
    """
    flat, xs = spread_columns(df.withColumn("cluster", col(cluster)).where("cluster IS NOT NULL"), columns, ["cluster"])
    v = F.array(*[F.col(x) for x in xs])
    norm = F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)
    slots, stats = _cluster_centres(flat, xs, [F.avg(norm).alias("q")], max_clusters)
    means, q, n = np.array([[r[x] for x in xs] for r in stats]), np.array([r["q"] for r in stats]), np.array([r["n"] for r in stats], dtype="float64")
    slotted = flat.select("cluster", v.alias("v")).join(slots, "cluster").select(F.lit(0).alias("id"), "v", "slot")
    rows = _linear_silhouettes(slotted, "int", means, q, n, False)
    return rows.agg(F.avg("silhouette").alias("silhouette_sq"), F.count(F.lit(1)).alias("rows"))


def centroid_table(flat: DataFrame, xs: list[str], cluster: str) -> DataFrame:
    return flat.groupBy(col(cluster)).agg(F.count(F.lit(1)).alias("n"), *[F.avg(x).alias(f"m_{x}") for x in xs])


def scatter_to_centroid(flat: DataFrame, xs: list[str], cluster: str) -> tuple[DataFrame, DataFrame]:
    """Per cluster: rows, centroid, sum of squared and mean plain distance to it."""
    cents = centroid_table(flat, xs, cluster)
    joined = lookup(flat, cents.drop("n"), cluster)
    sq = sum(((F.col(x) - F.col(f"m_{x}")) * (F.col(x) - F.col(f"m_{x}")) for x in xs), F.lit(0.0))
    spread = joined.groupBy(col(cluster)).agg(F.sum(sq).alias("within"), F.avg(F.sqrt(sq)).alias("radius"))
    return cents, spread


def inertia(df: DataFrame, columns: list[str] | str, cluster: str) -> DataFrame:
    flat, xs = spread_columns(df, columns, [cluster])
    _, spread = scatter_to_centroid(flat, xs, cluster)
    return spread.agg(F.sum("within").alias("inertia"), F.count(F.lit(1)).alias("clusters"))


def cluster_separation(df: DataFrame, columns: list[str] | str, cluster: str) -> DataFrame:
    """(calinski_harabasz, davies_bouldin, clusters): two passes over the rows, then one row per cluster."""
    flat, xs = spread_columns(df, columns, [cluster])
    cents, spread = scatter_to_centroid(flat, xs, cluster)
    rows = cents.join(spread, cluster).orderBy(col(cluster)).collect()
    k = len(rows)
    if k < 2:
        raise ValueError("two clusters are needed")
    n = np.array([r["n"] for r in rows], dtype="float64")
    m = np.array([[r[f"m_{x}"] for x in xs] for r in rows])
    centre = (n[:, None] * m).sum(0) / n.sum()
    within = sum(r["within"] for r in rows)
    ch = float((n * ((m - centre) ** 2).sum(1)).sum() / (k - 1) / (within / (n.sum() - k))) if within > 0 else 1.0
    s = np.array([r["radius"] for r in rows])
    gap = np.sqrt(((m[:, None, :] - m[None, :, :]) ** 2).sum(2))
    worst = [max((s[i] + s[j]) / gap[i, j] if gap[i, j] > 0 else 0.0 for j in range(k) if j != i) for i in range(k)]
    return df.sparkSession.createDataFrame([(ch, float(np.mean(worst)), k)], "calinski_harabasz double, davies_bouldin double, clusters int")


def scaled_cluster_scores(scores: DataFrame) -> DataFrame:
    """Silhouette, min(CH/1000, 1) and 1 - min(DB/10, 1) side by side."""
    return scores.withColumns({
        "silhouette_band": band(F.col("silhouette"), SILHOUETTE_BANDS, "none"),
        "ch_scaled": F.least(F.col("calinski_harabasz") / 1000, F.lit(1.0)),
        "db_scaled": 1 - F.least(F.col("davies_bouldin") / 10, F.lit(1.0))})
