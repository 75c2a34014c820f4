"""Cleaning: duplicates, missing values, outliers, dates, binary columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.blocks import block_join, matrix
from ..functions.frame import (
    col, columns_by_kind, dtype_of, facts_frame, finite, finite_sql, is_integral, is_numeric, literal_sql, lookup,
    need_columns, need_numeric, number_sql, numeric_columns, present_sql, quote, settle, string_sql,
)
from ..functions.projection import Projection
from ..functions.quantiles import exact_quantiles

DONOR_ROWS = 4096      # donors of a range of a column
MAX_RANGES = 10_000    # ranges of a column; beyond that they grow
FREQUENT_SHARE = 0.01  # share of the rows from which a pattern of missing values has donors of its own
SLAB = 2_000_000       # distances that a kernel holds at once

# The dates accepted besides ISO text, and the placeholder for a missing date.
DATE_FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "dd-MM-yyyy"]
DATE_PLACEHOLDER = "1970-01-01"
UNKNOWN = "Unknown"


# -- duplicates -------------------------------------------------------------------------------

def drop_duplicates(df: DataFrame, keep: str = "first", subset: list[str] | None = None, order_by: list[str] | None = None) -> DataFrame:
    """Whole-row duplicates, or the first/last row of each ``subset`` group in ``order_by`` order.

    The kept row is found with ``min_by``/``max_by``, which pre-aggregate before the shuffle, so a
    group that holds a third of the table does not end up in one task.
    """
    if keep not in ("first", "last"):
        raise ValueError("keep must be 'first' or 'last'")
    if not subset:
        return df.dropDuplicates()
    if not order_by:
        raise ValueError("order_by is needed: rows have no order of their own")
    need_columns(df, [*subset, *order_by])
    pick = F.min_by if keep == "first" else F.max_by
    row = F.struct(*[col(c) for c in df.columns])
    order = F.struct(*[col(c) for c in order_by])
    best = df.groupBy(*[col(c) for c in subset]).agg(pick(row, order).alias("__row"))
    return best.select("__row.*")


def duplicate_count(df: DataFrame) -> DataFrame:
    groups = df.groupBy(*[col(c) for c in df.columns]).count()
    return groups.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicates"))


# -- missing values ---------------------------------------------------------------------------

def null_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, null_count, null_pct): one aggregate over the table, then one row per column.  NaN counts as missing."""
    columns = columns or df.columns
    need_columns(df, columns)
    counts = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(F.expr(f"{present_sql(df, c)} IS NULL")).alias(c) for c in columns])
    items = [F.struct(F.lit(c).alias("column"), col(c).alias("null_count"),
                      (100.0 * col(c) / F.greatest(F.col("__n"), F.lit(1))).alias("null_pct")) for c in columns]
    return counts.select(F.inline(F.array(*items)))


def value_modes(df: DataFrame, columns: list[str]) -> dict:
    """Most frequent non-null value per column, the smallest on ties.

    Grouping sets count every column in one job with map-side combine; a plain ``mode`` would hold
    all distinct values of the column in a single task.
    """
    if all(is_numeric(dtype_of(df, c)) and not isinstance(dtype_of(df, c), T.DecimalType) for c in columns):
        # numbers of all columns are counted by (column, value): narrower keys than grouping sets have
        exact = [F.expr(present_sql(df, c)).cast("double") for c in columns]
        items = F.array(*[F.struct(F.lit(i).alias("i"), x.alias("v"), (col(c).cast("bigint") if is_integral(dtype_of(df, c)) else F.lit(None).cast("bigint")).alias("w")) for i, (c, x) in enumerate(zip(columns, exact))])
        counted = df.select(F.inline(items)).where("v IS NOT NULL").groupBy("i", "v", "w").agg(F.count(F.lit(1)).alias("n"))
        best = {r["i"]: r["b"] for r in counted.groupBy("i").agg(F.min(F.struct((-F.col("n")).alias("n"), "w", "v")).alias("b")).collect()}
        return {c: None if i not in best else best[i]["w"] if best[i]["w"] is not None else best[i]["v"] for i, c in enumerate(columns)}
    plain = df.select(*[F.expr(present_sql(df, c)).alias(f"c{i}") for i, c in enumerate(columns)])
    names = plain.columns
    counted = plain.groupingSets([[plain[n]] for n in names], *[plain[n] for n in names]).agg(
        F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("n"))
    full = 2 ** len(names) - 1
    best = counted.agg(*[
        F.min(F.when((F.col("gid") == full - 2 ** (len(names) - 1 - i)) & F.col(n).isNotNull(), F.struct((-F.col("n")).alias("n"), F.col(n).alias("v")))).alias(n)
        for i, n in enumerate(names)]).head()
    return {c: (best[n]["v"] if best[n] is not None else None) for c, n in zip(columns, names)}


def fit_impute(df: DataFrame, strategies: dict[str, str]) -> Projection:
    """Fill values per column: ``mean``, ``median``, ``mode``, ``unknown`` or ``drop``.

    NaN is missing like NULL; means and medians treat infinities so too.  All means come from one aggregate, all medians from one and all modes from one.
    """
    need_columns(df, strategies)
    by = {s: [c for c, x in strategies.items() if x == s] for s in ("mean", "median", "mode", "unknown", "drop")}
    unknown = [s for s in strategies.values() if s not in by]
    if unknown:
        raise ValueError(f"unknown strategies: {unknown}")
    need_numeric(df, by["mean"] + by["median"])
    fills: dict = {}
    if by["mean"]:
        row = df.agg(*[F.avg(finite(df, c)).alias(c) for c in by["mean"]]).head()
        fills.update({c: row[c] for c in by["mean"]})
    if by["median"]:
        fills.update({c: q[0] for c, q in exact_quantiles(df, by["median"], [0.5]).items()})
    if by["mode"]:
        fills.update({c: UNKNOWN if v is None else v for c, v in value_modes(df, by["mode"]).items()})
    fills.update({c: UNKNOWN for c in by["unknown"]})
    replace = {}
    for c, v in fills.items():
        if v is None:
            continue
        kind = dtype_of(df, c)
        if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)) and v != UNKNOWN:
            fill = f"CAST({string_sql(str(v))} AS {kind.simpleString()})"
        elif v == UNKNOWN and not isinstance(kind, T.StringType):
            replace[c] = f"coalesce(CAST({present_sql(df, c)} AS STRING), {string_sql(UNKNOWN)})"
            continue
        else:
            fill = literal_sql(v)
        base = finite_sql(df, c) if strategies[c] in ("mean", "median") else present_sql(df, c)
        replace[c] = f"coalesce({base}, {fill})"
    keep = " AND ".join(f"{present_sql(df, c)} IS NOT NULL" for c in by["drop"]) or None
    return Projection(replace=replace, keep_when=keep, facts=fills)


def impute(df: DataFrame, strategies: dict[str, str]) -> DataFrame:
    return fit_impute(df, strategies).transform(df)


def fit_clean_numeric(df: DataFrame, columns: list[str]) -> Projection:
    """Infinities and NaN to NULL, NULL to the median, 0 when a column is all NULL."""
    need_numeric(df, columns)
    medians = exact_quantiles(df, columns, [0.5])
    fill = {c: 0.0 if q[0] is None else q[0] for c, q in medians.items()}
    return Projection(replace={c: f"coalesce({finite_sql(df, c)}, {number_sql(v)})" for c, v in fill.items()}, facts=fill)


def clean_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    return fit_clean_numeric(df, columns).transform(df)


def impute_knn(df: DataFrame, key: str, columns: list[str] | None = None, k: int = 5) -> DataFrame:
    """Fill numeric NULLs with the mean of the k nearest donors (missing-aware Euclidean distance).

    The squared distance over the shared columns is scaled by all/shared columns.  Donors are ranked per missing
    cell, ties by key; a cell without donors gets the column mean.  The key must name each row: a NULL or
    repeated one is an error.

    Equal rows ask once.  A donor is placed by the fullest column that it shares with the asking pattern, in ranges of
    that column; a row first meets its own ranges, and the k-th distances found there bound the gap to those it still
    has to meet.  For frequent patterns donors are cut to the columns that such rows have, and of donors that are then
    equal the k smallest keys stay.  One kernel serves all patterns, so the number of jobs does not depend on them.
    """
    columns = columns or [c for c in numeric_columns(df) if c != key]
    need_numeric(df, columns)
    d = len(columns)
    work = settle(df.select(col(key).alias("id"), F.array(*[finite(df, c) for c in columns]).alias("v")))
    if wrong := work.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("id IS NULL OR n > 1").head(1):
        raise ValueError(f"impute_knn needs a key for each row; {key} has {wrong[0]['id']!r} in {wrong[0]['n']} rows")
    at = [F.get("v", F.lit(i)) for i in range(d)]
    facts = work.agg(F.count(F.lit(1)).alias("rows"), *[e for i in range(d) for e in (F.avg(at[i]).alias(f"m{i}"), F.count(at[i]).alias(f"n{i}"))]).head()
    axes = sorted((i for i in range(d) if facts[f"n{i}"]), key=lambda i: (-facts[f"n{i}"], i))
    kind = work.schema["id"].dataType.simpleString()
    seen = F.transform("v", lambda x: x.isNotNull())
    gaps = work.where("exists(v, x -> x IS NULL) AND exists(v, x -> x IS NOT NULL)")
    asked = settle(gaps.groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).withColumn("seen", seen))

    # a group is a frequent pattern with one of its missing columns; group 0 takes the rows of all other patterns
    patterns = asked.groupBy("seen").agg(F.sum("n").alias("n")).withColumn("often", F.col("n") >= FREQUENT_SHARE * facts["rows"])
    known = patterns.agg(F.collect_list(F.when(F.col("often"), F.col("seen"))).alias("often"), F.count_if(~F.col("often")).alias("rare")).head()
    frequent = sorted(list(s) for s in known["often"])
    cells = [(s, [i for i in axes if not s[i]]) for s in frequent]
    groups = [(g, s, c) for g, (s, c) in enumerate(((s, c) for s, missing in cells for c in missing), 1)]
    flags = lambda s: F.array(*[F.lit(x) for x in s])
    route = F.array(F.lit(0))
    for s in frequent:
        route = F.when(F.col("seen") == flags(s), F.array(*[F.lit(g) for g, t, _ in groups if t == s]).cast("array<int>")).otherwise(route)
    queries = asked.select("id", "v", F.explode(route).alias("g"))
    each = F.array(*[F.struct(F.lit(g).alias("g"), flags(s).alias("seen"), F.lit(c).alias("cell")) for g, s, c in groups])
    cut = (work.select("id", "v", F.inline(each)) if groups else work.selectExpr("id", "v", "0 AS g", "array(true) AS seen", "0 AS cell").limit(0)).where("v[cell] IS NOT NULL")
    cut = cut.select("id", "g", F.expr("transform(v, (x, i) -> IF(i = cell OR seen[i], x, NULL))").alias("v"), F.expr("zip_with(v, seen, (x, s) -> IF(s, x, NULL))").alias("u"))
    points = cut.unionByName(work.select("id", F.lit(0).alias("g"), "v", F.col("v").alias("u"))) if known["rare"] else cut
    copy = F.row_number().over(Window.partitionBy("g", "u").orderBy("id"))
    points = points.where("exists(u, x -> x IS NOT NULL)").withColumn("copy", copy).where(F.col("copy") <= k)
    shared = F.filter(F.array(*[F.lit(i) for i in axes]).cast("array<int>"), lambda i: F.get("u", i).isNotNull())
    axis = F.explode(F.when(F.col("g") == 0, shared).otherwise(F.slice(shared, 1, 1))).alias("axis")
    points = settle(points.select("id", "g", "v", "u", axis).select("id", "g", "v", "axis", F.get("u", F.col("axis")).alias("x")))

    # ranges of about DONOR_ROWS points for each group and column, numbered through
    ranges = min(MAX_RANGES, max(1, -(-facts["rows"] // DONOR_ROWS)))
    steps = [i / ranges for i in range(1, ranges)] or [0.5]
    cuts = {}
    for r in points.groupBy("g", "axis").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("x", steps, max(10_000, 20 * ranges)).alias("cuts")).collect():
        step = max(1, ranges * DONOR_ROWS // r["n"])  # a small group takes fewer
        cuts[r["g"], r["axis"]] = np.unique(np.array(r["cuts"][step - 1:ranges - 1:step], dtype="float64"))
    first, axis_of = {}, []
    for place in sorted(cuts):
        first[place] = len(axis_of)
        axis_of += [place[1]] * (len(cuts[place]) + 1)

    def place_points(batches):
        for pdf in batches:
            part = np.zeros(len(pdf), dtype="int32")
            for (g, a), rows in pdf.groupby(["g", "axis"]).indices.items():
                part[rows] = first[g, a] + np.searchsorted(cuts[g, a], pdf["x"].to_numpy()[rows], "right")
            yield pdf[["id", "v"]].assign(part=part)

    def ask(near):
        """Own ranges of the rows, or those others that their bounds leave open."""
        def run(batches):
            for pdf in batches:
                for g, rows in pdf.groupby("g").indices.items():
                    some = pdf.iloc[rows]
                    v = matrix(some["v"])
                    for a in (a for a in axes if (g, a) in first):
                        mine = np.flatnonzero(~np.isnan(v[:, a]))
                        x, edges = v[mine, a], cuts[g, a]
                        own = np.searchsorted(edges, x, "right")
                        low, high = own, own
                        if not near:  # a shared column weighs d / shared, at least d / present
                            reach = some["bound"].to_numpy()[mine] * np.sqrt((~np.isnan(v[mine])).sum(1) / d) * (1 + 1e-9) + 1e-12 * np.abs(x)
                            low, high = np.searchsorted(edges, x - reach, "right"), np.searchsorted(edges, x + reach, "right")
                        for s in range(0, len(mine), 256):
                            n = (high - low + 1)[s:s + 256]
                            row = np.repeat(np.arange(s, s + len(n)), n)
                            part = low[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                            if not near:
                                row, part = row[part != own[row]], part[part != own[row]]
                            picked = some.iloc[mine[row]]
                            yield pd.DataFrame({"id": picked["id"].to_numpy(), "g": picked["g"].to_numpy(), "v": picked["v"].to_numpy(), "part": (first[g, a] + part).astype("int32")})
        return run

    donors = settle(points.select("id", "g", "v", "axis", "x").mapInPandas(place_points, f"id {kind}, v array<double>, part int"))
    shape = f"id {kind}, g int, cell int, nid {kind}, distance double, value double"
    wanted = f"id {kind}, g int, v array<double>, part int"
    best = Window.partitionBy("id", "cell").orderBy("distance", "nid")
    kernel = _nearest_donors(k, d, axes, axis_of)

    def top(found):
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank")

    found = top(block_join(settle(queries.mapInPandas(ask(True), wanted)), donors, "part", kernel, shape))
    if any(len(c) for c in cuts.values()):
        found = settle(found)
        kth = found.groupBy("id", "g", "cell").agg(F.max("distance").alias("distance"), F.count(F.lit(1)).alias("c"))
        kth = kth.groupBy("id", "g").agg(F.max(F.when(F.col("c") >= k, F.col("distance")).otherwise(float("inf"))).alias("bound"), F.count(F.lit(1)).alias("cells"))
        missing = F.when(F.col("g") > 0, 1).otherwise(F.size(F.filter(F.array(*[F.lit(i) for i in axes]), lambda i: F.get("v", i).isNull())))
        bounded = queries.join(kth, ["id", "g"], "left").withColumn("bound", F.when(F.col("cells") >= missing, F.col("bound")).otherwise(float("inf")))
        rest = settle(bounded.select("id", "g", "v", "bound").mapInPandas(ask(False), wanted))
        found = top(found.unionByName(block_join(rest, donors, "part", kernel, shape)))
    fills = found.groupBy("id").agg(*[F.avg(F.when(F.col("cell") == i, F.col("value"))).alias(f"f{i}") for i in range(d)])
    answers = settle(asked.select("id", "v").join(fills, "id").drop("id"))
    filled = lookup(gaps, answers, "v").select(F.col("id").alias("__id"), *[F.col(f"f{i}").alias(f"__f{i}") for i in range(d)])
    out = df.join(filled, col(key).eqNullSafe(F.col("__id")), "left")
    whole = {c: F.coalesce(finite(df, c), F.col(f"__f{i}"), F.lit(facts[f"m{i}"])).alias(c) for i, c in enumerate(columns)}
    return out.select(*[whole.get(c, df[quote(c)]) for c in df.columns])


def _nearest_donors(k: int, d: int, axes: list[int], axis_of: list[int]):
    """Kernel with the k nearest donors for each missing cell of one block pair, a slab of rows at a time.

    Matrix products over values and masks give all distances up to rounding; every pair that could belong
    to the best k within that rounding is then measured exactly.  Pairs that share a fuller column than that of
    the ranges meet there.
    """
    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("id", kind="stable")
        ids, nids, x, y = a["id"].to_numpy(), b["id"].to_numpy(), matrix(a["v"]), matrix(b["v"])
        fuller = axes[:axes.index(axis_of[a["part"].iloc[0]])]
        step, out = max(1, SLAB // max(1, len(y))), []
        for s in range(0, len(x), step):
            for i, c, j, dist in slab(x[s:s + step], y, fuller):
                out.append(pd.DataFrame({"id": ids[s + i], "g": a["g"].to_numpy()[s + i], "cell": np.full(len(i), c, dtype="int32"), "nid": nids[j], "distance": dist, "value": y[j, c]}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"id": ids[:0], "g": np.zeros(0, "int32"), "cell": np.zeros(0, "int32"), "nid": nids[:0], "distance": [], "value": []})

    def slab(x, y, fuller):
        mx, my = ~np.isnan(x), ~np.isnan(y)
        x0, y0 = np.where(mx, x, 0.0), np.where(my, y, 0.0)
        shared = mx.astype("float64") @ my.T
        g = (x0 * x0) @ my.T + mx @ (y0 * y0).T - 2 * x0 @ y0.T
        with np.errstate(divide="ignore", invalid="ignore"):
            g = np.where(shared > 0, np.maximum(g, 0.0) * (d / shared), np.inf)
        if fuller:
            g[mx[:, fuller].astype("float64") @ my[:, fuller].T > 0] = np.inf
        slack = 1e-10 * d * ((x0 * x0).sum(1) + (y0 * y0).sum(1).max(initial=0.0))
        for c in range(d):
            row, donor = np.flatnonzero(~mx[:, c]), np.flatnonzero(my[:, c])
            if not len(row) or not len(donor):
                continue
            part = g[np.ix_(row, donor)]
            kth = np.partition(part, k - 1, axis=1)[:, k - 1] if len(donor) > k else np.full(len(row), np.inf)
            i, j = np.nonzero((part <= (kth + slack[row])[:, None]) & np.isfinite(part))
            i, j = row[i], donor[j]
            diff = np.nan_to_num(x[i] - y[j])  # missing on either side adds nothing
            dist = np.sqrt((diff * diff).sum(1)) * (d / shared[i, j]) ** 0.5
            order = np.lexsort((j, dist, i))
            i, j, dist = i[order], j[order], dist[order]
            keep = np.arange(len(i)) - np.searchsorted(i, i) < k
            yield i[keep], c, j[keep], dist[keep]
    return run


# -- outliers ---------------------------------------------------------------------------------

def iqr_bounds(df: DataFrame, columns: list[str]) -> dict[str, tuple]:
    out = {}
    for c, (q1, q3) in exact_quantiles(df, columns, [0.25, 0.75]).items():
        out[c] = (None, None) if q1 is None else (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    return out


def moments(df: DataFrame, columns: list[str], spread=F.stddev_samp) -> dict[str, tuple]:
    row = df.agg(*[e for c in columns for e in (F.avg(finite(df, c)).alias(f"{c}__m"), spread(finite(df, c)).alias(f"{c}__s"))]).head()
    return {c: (row[f"{c}__m"], row[f"{c}__s"]) for c in columns}


def _cap(df: DataFrame, bounds: dict[str, tuple]) -> Projection:
    """Values beyond the bounds become the bounds, infinities too; NaN is no value and becomes NULL."""
    replace = {}
    for c, (lo, hi) in bounds.items():
        if lo is not None and hi is not None:
            x = f"CAST({present_sql(df, c)} AS DOUBLE)"
            replace[c] = f"CASE WHEN {x} < {number_sql(lo)} THEN {number_sql(lo)} WHEN {x} > {number_sql(hi)} THEN {number_sql(hi)} ELSE {x} END"
    return Projection(replace=replace, facts=bounds)


def fit_cap_outliers(df: DataFrame, columns: list[str], method: str = "iqr") -> Projection:
    """Limits per column from one aggregate: quartile fences, or mean +- 3 sample deviations."""
    need_numeric(df, columns)
    if method == "iqr":
        return _cap(df, iqr_bounds(df, columns))
    stats = moments(df, columns)
    return _cap(df, {c: (None, None) if s is None else (m - 3 * s, m + 3 * s) for c, (m, s) in stats.items()})


def delete_outliers(df: DataFrame, columns: list[str], method: str = "iqr") -> DataFrame:
    """Remove outlier rows column after column: each column is measured on the rows still there.

    Quartile fences also remove missing values; the deviation rule keeps them and uses the population
    deviation.  NaN is missing.
    """
    need_numeric(df, columns)
    for c in columns:
        x = F.expr(present_sql(df, c))
        if method == "iqr":
            lo, hi = iqr_bounds(df, [c])[c]
            df = df.where(F.lit(False)) if lo is None else df.where(x.between(F.lit(lo), F.lit(hi)))
        else:
            m, s = moments(df, [c], F.stddev_pop)[c]
            if s:
                df = df.where(x.isNull() | (F.abs((x - F.lit(m)) / F.lit(s)) < 3))
    return df


def handle_outliers(df: DataFrame, columns: list[str], method: str = "iqr", action: str = "capping") -> DataFrame:
    if action == "capping":
        return fit_cap_outliers(df, columns, method).transform(df)
    if action == "deletion":
        return delete_outliers(df, columns, method)
    raise ValueError(f"unknown action: {action}")


def outlier_summary(df: DataFrame, columns: list[str], method: str = "iqr") -> DataFrame:
    """(column, outlier_count, outlier_pct): one pass for the bounds, one for all counts.  NaN is missing, not an outlier."""
    need_numeric(df, columns)
    value = {c: F.expr(present_sql(df, c)) for c in columns}
    if method == "iqr":
        tests = {c: (F.lit(False) if lo is None else (value[c] < lo) | (value[c] > hi)) for c, (lo, hi) in iqr_bounds(df, columns).items()}
    else:
        tests = {c: (F.abs((value[c] - F.lit(m)) / F.lit(s)) > 3 if s else F.lit(False)) for c, (m, s) in moments(df, columns, F.stddev_pop).items()}
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(t).alias(c) for c, t in tests.items()]).head()
    rows = [(c, row[c], 100.0 * row[c] / max(row["n"], 1)) for c in columns]
    return facts_frame(df.sparkSession, rows, "column string, outlier_count bigint, outlier_pct double")


# -- dates ------------------------------------------------------------------------------------

def parsed_date(name: str) -> str:
    tries = ", ".join(f"try_to_timestamp(CAST({quote(name)} AS STRING), '{f}')" for f in DATE_FORMATS)
    return f"CAST(coalesce({tries}) AS TIMESTAMP_NTZ)"


def validate_dates(df: DataFrame, columns: list[str], action: str = "validate") -> DataFrame:
    """Text to timestamp; invalid text is NULL (``validate``), removed, or set to the placeholder."""
    need_columns(df, columns)
    if action not in ("validate", "drop_invalid", "impute"):
        raise ValueError(f"unknown action: {action}")
    dated = Projection(replace={c: parsed_date(c) for c in columns}).transform(df)
    if action == "drop_invalid":
        return dated.dropna(subset=columns)
    if action == "impute":
        return dated.withColumns({c: F.coalesce(col(c), F.expr(f"TIMESTAMP_NTZ'{DATE_PLACEHOLDER}'")) for c in columns})
    return dated


def date_like_columns(df: DataFrame) -> DataFrame:
    """Text columns with ``/`` or ``-`` in any of their values; one aggregate over all columns."""
    texts = columns_by_kind(df)["text"]
    if not texts:
        return df.sparkSession.createDataFrame([], "column string")
    hits = df.agg(*[F.max(col(c).rlike("[/-]")).alias(f"c{i}") for i, c in enumerate(texts)])
    return hits.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("hit")) for i, c in enumerate(texts)]))).where("hit").select("column")


# -- binary or dummy columns ------------------------------------------------------------------

def fit_binary_or_dummies(df: DataFrame, columns: list[str], order_by: list[str], max_categories: int = 1000) -> Projection:
    """Two distinct values (NULL included): 0/1 by first appearance, NULL as -1; else one 0/1 column per value."""
    need_columns(df, [*columns, *order_by])
    out = Projection()
    order = F.struct(*[col(c) for c in order_by])
    for c in columns:
        seen = df.groupBy(col(c).alias("v")).agg(F.min(order).alias("o"))
        words = seen.orderBy("o").limit(max_categories + 1).select("v").collect()
        if len(words) > max_categories:
            raise ValueError(f"{c}: more than {max_categories} distinct values")
        values = [r[0] for r in words]
        if len(values) == 2:
            known = [v for v in values if v is not None]
            whens = " ".join(f"WHEN {quote(c)} = {literal_sql(v)} THEN {i}" for i, v in enumerate(known))
            out.replace[c] = f"CAST(CASE {whens} ELSE -1 END AS BIGINT)"
        else:
            out.drop.append(c)
            for v in sorted(v for v in values if v is not None):
                out.add[f"{c}_{v}"] = f"coalesce({quote(c)} = {literal_sql(v)}, false)"
    return out


def binary_or_dummies(df: DataFrame, columns: list[str], order_by: list[str]) -> DataFrame:
    return fit_binary_or_dummies(df, columns, order_by).transform(df)
