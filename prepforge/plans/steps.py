"""Ordered transformation steps: a list of plain dicts ``{name, type, category, ...}`` folded over a table."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators import clean, encode, profile, reduce, scale, select, shape

Step = dict


def _impute(df: DataFrame, s: Step) -> DataFrame:
    plain = {c: x for c, x in s["strategies"].items() if x != "knn" and c in df.columns}
    out = clean.impute(df, plain) if plain else df
    if "knn" in s["strategies"].values():
        out = clean.impute_knn(out, s["key"], k=s.get("k", 5))
    return out


def _duplicates(df: DataFrame, s: Step) -> DataFrame:
    keep = {"remove": "first", "keep_first": "first", "keep_last": "last"}[s["action"]]
    return clean.drop_duplicates(df, keep, s.get("subset"), s.get("order_by"))


# (type, category) -> table function.  Category names are fixed values shared with saved step lists.
STEPS: dict[tuple[str, str], Callable[[DataFrame, Step], DataFrame]] = {
    ("transformation", "delete"): lambda df, s: shape.drop_column(df, s["column"]),
    ("transformation", "computation"): lambda df, s: shape.compute(df, s["expr"], s["new_column"]),
    ("transformation", "log"): lambda df, s: shape.log_transform(df, s["columns"]),
    ("transformation", "filter"): lambda df, s: shape.filter_equals(df, s["column"], s["value"]),
    ("transformation", "group"): lambda df, s: shape.group_aggregate(df, s["group_col"], s["target_col"], s["agg"]),
    ("cleaning", "Rename Columns"): lambda df, s: shape.rename_columns(df, s["rename_mapping"]),
    ("cleaning", "Duplicate Handling"): _duplicates,
    ("cleaning", "Null handling"): _impute,
    ("cleaning", "Outlier Handling"): lambda df, s: clean.handle_outliers(df, s["columns"], {"IQR": "iqr", "Z-score": "zscore"}.get(s["method"], s["method"]), s["action"]),
    ("cleaning", "Binary Encoding"): lambda df, s: clean.binary_or_dummies(df, s["columns"], s["order_by"]),
    ("cleaning", "Date Validation"): lambda df, s: clean.validate_dates(df, s["date_columns"], s["action"]),
    ("standardization", "MinMax Standardization"): lambda df, s: scale.minmax(df, s["columns"], tuple(s.get("feature_range", (0.0, 1.0)))),
    ("standardization", "Z-score Standardization"): lambda df, s: scale.zscore(df, s["columns"], s.get("with_mean", True), s.get("with_std", True)),
    ("standardization", "Robust Scaler"): lambda df, s: scale.robust(df, s["columns"], tuple(s.get("quantile_range", (25.0, 75.0))), s.get("with_centering", True), s.get("with_scaling", True)),
    ("standardization", "Mean Normalization"): lambda df, s: scale.mean_normalize(df, s.get("columns") or s["column"]),
    ("encoding", "Label Encoding"): lambda df, s: encode.label_encode(df, s["columns"]),
    ("encoding", "Ordinal Encoding"): lambda df, s: encode.ordinal(df, s["columns"], s["mappings"], s.get("handle_unknown", "error"), s.get("unknown_value", -1.0)),
    ("encoding", "one-hot encoding"): lambda df, s: encode.onehot(df, s["columns"], s.get("drop_first", False)),
    ("encoding", "Target Encoding"): lambda df, s: encode.target_encode(df, s["columns"], s["target"]),
    ("encoding", "Binary Encoding"): lambda df, s: _each_binary(df, s),
    ("encoding", "Frequency Encoding"): lambda df, s: encode.frequency_encode(df, s["columns"]),
    ("encoding", "Hash Encoding"): lambda df, s: encode.hash_encode(df, s["columns"], s.get("buckets", 256)),
    ("encoding", "Group Rare"): lambda df, s: encode.group_rare(df, s["columns"], s.get("min_share", 0.01)),
    ("feature", "Date Parts"): lambda df, s: profile.date_parts(df, s["column"], s.get("with_time", False)),
    ("feature", "Date Differences"): lambda df, s: _date_differences(df, s["columns"]),
    ("feature", "Family Deltas"): lambda df, s: profile.family_deltas(df, s["columns"]),
    ("feature", "Text TF-IDF"): lambda df, s: profile.text_tfidf(df, s["column"], s.get("features", 1 << 16)),
    ("feature_selection", "Chi-Squared Feature Selection"): lambda df, s: select.select_chi2(df, s["features"], s["target"], s["k"]),
    ("feature_selection", "REF Feature Selection"): lambda df, s: select.select_rfe(df, s["features"], s.get("target"), s["n_features"], s.get("estimator", "linear")),
    ("feature_selection", "Correlation Feature Selection"): lambda df, s: select.select_correlation(df, s.get("threshold", 0.9)),
    ("feature_selection", "Variance Feature Selection"): lambda df, s: select.select_variance(df, s.get("threshold", 0.01)),
    ("feature_selection", "ANOVA"): lambda df, s: select.select_anova(df, s["target_column"], s.get("k", 5)),
    ("dimensionality_reduction", "PCA"): lambda df, s: reduce.pca(df, s["columns"], s.get("n_components", 2), s.get("whiten", False)),
    ("dimensionality_reduction", "LDA"): lambda df, s: reduce.discriminant_projection(df, s["features"], s["target"], s.get("n_components")),
}


def _each_binary(df: DataFrame, s: Step) -> DataFrame:
    for c in s.get("columns") or [s["column"]]:
        df = encode.binary_encode(df, c, s["order_by"])
    return df


def _date_differences(df: DataFrame, columns: list[str]) -> DataFrame:
    """Days from each date column to the next one."""
    for a, b in zip(columns, columns[1:]):
        df = profile.date_diffs(df, a, b)
    return df


def apply_step(df: DataFrame, step: Step) -> DataFrame:
    key = (step.get("type"), step.get("category"))
    if key not in STEPS:
        raise ValueError(f"unknown step {key}; known: {sorted(STEPS)}")
    return STEPS[key](df, step)


def apply_steps(df: DataFrame, steps: list[Step], selected: list[str] | None = None, order: str = "stored", on_error: str = "raise") -> DataFrame:
    """Fold the chosen steps over the table into one plan.

    ``selected`` names the steps (all by default; ``original`` is a no-op).  ``order='stored'`` keeps
    the order of the list, ``order='selected'`` the order of the names.  ``on_error='skip'`` warns and
    goes on with the unchanged table.
    """
    names = [s["name"] for s in steps]
    wanted = names if selected is None else [n for n in selected if n != "original"]
    unknown = [n for n in wanted if n not in names]
    if unknown:
        raise ValueError(f"unknown step names: {unknown}")
    by_name = {s["name"]: s for s in steps}
    chosen = [s for s in steps if s["name"] in wanted] if order == "stored" else [by_name[n] for n in wanted]
    for s in chosen:
        try:
            df = apply_step(df, s)
        except Exception as error:
            if on_error != "skip":
                raise
            warnings.warn(f"step {s['name']!r} skipped: {error}", stacklevel=2)
    return df
