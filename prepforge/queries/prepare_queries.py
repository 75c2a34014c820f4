"""Sources, shape, cleaning, scaling and encoding."""

from ..functions.frame import rounded, settled_path
from ..operators import clean, encode, scale, shape
from ..plans.steps import apply_steps
from ..sources.tables import preview, read_table, write_table
from .registry import ORACLES, QUERIES, each, fx, q, query, r

# -- sources -----------------------------------------------------------------------------------

QUERIES["io_read_table"] = lambda spark, sf: read_table(spark, f"{sf}/customer.parquet")
ORACLES["io_read_table"] = "SELECT * FROM customer"


def _written(spark, sf):
    doubled = shape.compute(read_table(spark, f"{sf}/supplier.parquet"), "[s_acctbal] * 2", "doubled")
    return write_table(doubled, settled_path(spark))


QUERIES["io_write_table"] = _written
ORACLES["io_write_table"] = "SELECT *, s_acctbal * 2 AS doubled FROM supplier"


def _from_csv(spark, sf):
    path, customers = settled_path(spark), read_table(spark, f"{sf}/customer.parquet")
    customers.write.option("header", True).csv(path)
    return read_table(spark, path, "csv", customers.schema)


QUERIES["io_read_csv"] = _from_csv
ORACLES["io_read_csv"] = "SELECT * FROM customer"


@query("io_preview", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10")
def _(t):
    return preview(t("orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), 10, ["o_orderkey"])


# -- shape -------------------------------------------------------------------------------------

@query("tr_drop_column", "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer")
def _(t):
    return shape.drop_column(t("customer"), "c_acctbal")


@query("tr_compute", f"SELECT l_orderkey, l_linenumber, l_partkey, {r('l_extendedprice * (1 - l_discount)', 4)} AS revenue FROM lineitem")
def _(t):
    return rounded(shape.compute(t("lineitem"), "[l_extendedprice] * (1 - [l_discount])", "revenue").select("l_orderkey", "l_linenumber", "l_partkey", "revenue"), 4)


@query("tr_log_transform", f"SELECT event_id, CASE WHEN value + 1e-9 > 0 THEN {r('ln(value + 1e-9)')} END AS value FROM events")
def _(t):
    return rounded(shape.log_transform(t("events").select("event_id", "value"), ["value"]))


@query("tr_filter_equals", "SELECT * FROM part WHERE p_size = 15")
def _(t):
    return shape.filter_equals(t("part"), "p_size", "15")


@query("tr_filter_equals_text", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_returnflag = 'R'")
def _(t):
    return shape.filter_equals(t("lineitem"), "l_returnflag", "R").select("l_orderkey", "l_quantity")


for _agg, _sql in {"sum": "coalesce(sum(o_totalprice), 0)", "mean": "avg(o_totalprice)", "max": "max(o_totalprice)", "min": "min(o_totalprice)", "count": "count(o_totalprice)"}.items():
    _value = "CAST(count(o_totalprice) AS BIGINT)" if _agg == "count" else r(_sql, 2)
    query(f"tr_group_{_agg}", f"SELECT o_orderpriority, {_value} AS {_agg}_o_totalprice FROM {fx('orders_nulls')} WHERE o_orderpriority IS NOT NULL GROUP BY 1")(
        lambda t, a=_agg: rounded(shape.group_aggregate(t("orders_nulls"), "o_orderpriority", "o_totalprice", a), 2))


@query("tr_rename_columns", "SELECT n_nationkey AS nation_id, n_name AS nation, n_regionkey FROM nation")
def _(t):
    return shape.rename_columns(t("nation"), {"n_nationkey": "nation_id", "n_name": "nation", "absent": "x"})


STEPS = [
    {"name": "returned", "type": "transformation", "category": "filter", "column": "l_returnflag", "value": "R"},
    {"name": "revenue", "type": "transformation", "category": "computation", "expr": "[l_extendedprice] * (1 - [l_discount])", "new_column": "revenue"},
    {"name": "by status", "type": "transformation", "category": "group", "group_col": "l_linestatus", "target_col": "revenue", "agg": "sum"},
]


@query("tr_apply_steps", f"SELECT l_linestatus, {r('sum(l_extendedprice * (1 - l_discount))', 2)} AS sum_revenue FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1")
def _(t):
    return rounded(apply_steps(t("lineitem"), STEPS), 2)


@query("tr_apply_steps_selected", f"SELECT l_linestatus, {r('sum(l_extendedprice * (1 - l_discount))', 2)} AS sum_revenue FROM lineitem GROUP BY 1")
def _(t):
    return rounded(apply_steps(t("lineitem"), STEPS, ["original", "revenue", "by status"], order="selected"), 2)


# -- cleaning ----------------------------------------------------------------------------------

@query("cl_drop_duplicates", "SELECT * FROM orders")
def _(t):
    return clean.drop_duplicates(t("orders_dups"))


@query("cl_drop_duplicates_keep_last", "SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY 1")
def _(t):
    return clean.drop_duplicates(t("orders").select("o_custkey", "o_orderkey", "o_orderstatus"), "last", ["o_custkey"], ["o_orderkey"])


@query("cl_drop_duplicates_keep_first", "SELECT user_id, min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type FROM events GROUP BY 1")
def _(t):
    return clean.drop_duplicates(t("events").select("user_id", "event_id", "event_type"), "first", ["user_id"], ["event_id"])


@query("cl_duplicate_count", "SELECT CAST((SELECT count(*) FROM orders WHERE o_orderkey % 5 = 0) AS BIGINT) AS duplicates")
def _(t):
    return clean.duplicate_count(t("orders_dups"))


_NULLS = ["o_totalprice", "o_orderpriority", "o_orderstatus"]


@query("cl_null_summary", each(_NULLS, f"CAST(count(*) - count({{c}}) AS BIGINT) AS null_count, {r('100.0e0 * (count(*) - count({c})) / count(*)')} AS null_pct", fx("orders_nulls")))
def _(t):
    return rounded(clean.null_summary(t("orders_nulls"), _NULLS))


for _how, _sql in {"mean": "avg(o_totalprice)", "median": "median(o_totalprice)"}.items():
    query(f"cl_impute_{_how}", f"WITH f AS {fx('orders_nulls')} SELECT o_orderkey, {r(f'coalesce(o_totalprice, (SELECT {_sql} FROM f))', 4)} AS o_totalprice FROM f")(
        lambda t, h=_how: rounded(clean.impute(t("orders_nulls"), {"o_totalprice": h}).select("o_orderkey", "o_totalprice"), 4))


@query("cl_impute_mode", f"WITH f AS {fx('orders_nulls')}, m AS (SELECT o_orderpriority AS v FROM f WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) "
       "SELECT o_orderkey, coalesce(o_orderpriority, (SELECT v FROM m)) AS o_orderpriority FROM f")
def _(t):
    return clean.impute(t("orders_nulls"), {"o_orderpriority": "mode"}).select("o_orderkey", "o_orderpriority")


@query("cl_impute_unknown", f"SELECT o_orderkey, coalesce(o_orderpriority, 'Unknown') AS o_orderpriority FROM {fx('orders_nulls')}")
def _(t):
    return clean.impute(t("orders_nulls"), {"o_orderpriority": "unknown"}).select("o_orderkey", "o_orderpriority")


@query("cl_impute_drop", f"SELECT o_orderkey, o_totalprice FROM {fx('orders_nulls')} WHERE o_totalprice IS NOT NULL")
def _(t):
    return clean.impute(t("orders_nulls"), {"o_totalprice": "drop"}).select("o_orderkey", "o_totalprice")


_KNN = f"""WITH f AS {fx('part_nulls')}, full_rows AS (SELECT p_partkey AS k, CAST(p_size AS DOUBLE) AS s, p_retailprice AS p FROM f WHERE p_size IS NOT NULL AND p_retailprice IS NOT NULL),
a AS (SELECT f.p_partkey, d.s AS v, row_number() OVER (PARTITION BY f.p_partkey ORDER BY sqrt((f.p_retailprice - d.p) * (f.p_retailprice - d.p)) * sqrt(2.0e0), d.k) AS n
      FROM f, full_rows d WHERE f.p_size IS NULL AND f.p_retailprice IS NOT NULL),
b AS (SELECT f.p_partkey, d.p AS v, row_number() OVER (PARTITION BY f.p_partkey ORDER BY sqrt((CAST(f.p_size AS DOUBLE) - d.s) * (CAST(f.p_size AS DOUBLE) - d.s)) * sqrt(2.0e0), d.k) AS n
      FROM f, full_rows d WHERE f.p_retailprice IS NULL AND f.p_size IS NOT NULL),
sa AS (SELECT p_partkey, avg(v) AS v FROM a WHERE n <= 5 GROUP BY 1), sb AS (SELECT p_partkey, avg(v) AS v FROM b WHERE n <= 5 GROUP BY 1)
SELECT f.p_partkey, {r('coalesce(CAST(f.p_size AS DOUBLE), sa.v, (SELECT avg(p_size) FROM f))', 4)} AS p_size,
{r('coalesce(f.p_retailprice, sb.v, (SELECT avg(p_retailprice) FROM f))', 4)} AS p_retailprice
FROM f LEFT JOIN sa ON f.p_partkey = sa.p_partkey LEFT JOIN sb ON f.p_partkey = sb.p_partkey"""


@query("cl_impute_knn", _KNN)
def _(t):
    return rounded(clean.impute_knn(t("part_nulls"), "p_partkey", ["p_size", "p_retailprice"], 5).select("p_partkey", "p_size", "p_retailprice"), 4)


_OUT = ["l_extendedprice", "l_quantity"]
_BOUNDS = ", ".join(f"{q(c, 0.25)} - 1.5e0 * ({q(c, 0.75)} - {q(c, 0.25)}) AS lo_{c}, {q(c, 0.75)} + 1.5e0 * ({q(c, 0.75)} - {q(c, 0.25)}) AS hi_{c}" for c in _OUT)


@query("cl_outliers_iqr_cap", f"WITH f AS {fx('line_outliers')}, b AS (SELECT {_BOUNDS} FROM f) SELECT l_orderkey, l_linenumber, "
       + ", ".join(f"{r(f'CASE WHEN {c} < lo_{c} THEN lo_{c} WHEN {c} > hi_{c} THEN hi_{c} ELSE {c} END', 4)} AS {c}" for c in _OUT) + " FROM f, b")
def _(t):
    return rounded(clean.handle_outliers(t("line_outliers"), _OUT, "iqr", "capping").select("l_orderkey", "l_linenumber", *_OUT), 4)


@query("cl_outliers_iqr_delete", f"""WITH f AS {fx('line_outliers')},
b1 AS (SELECT {q('l_extendedprice', 0.25)} AS a, {q('l_extendedprice', 0.75)} AS c FROM f),
g AS (SELECT f.* FROM f, b1 WHERE l_extendedprice BETWEEN a - 1.5e0 * (c - a) AND c + 1.5e0 * (c - a)),
b2 AS (SELECT {q('l_quantity', 0.25)} AS a, {q('l_quantity', 0.75)} AS c FROM g)
SELECT l_orderkey, l_linenumber, l_extendedprice, l_quantity FROM g, b2 WHERE l_quantity BETWEEN a - 1.5e0 * (c - a) AND c + 1.5e0 * (c - a)""")
def _(t):
    return clean.handle_outliers(t("line_outliers"), _OUT, "iqr", "deletion").select("l_orderkey", "l_linenumber", *_OUT)


@query("cl_outliers_zscore_cap", f"WITH f AS {fx('line_outliers')}, b AS (SELECT " + ", ".join(f"avg({c}) - 3 * stddev_samp({c}) AS lo_{c}, avg({c}) + 3 * stddev_samp({c}) AS hi_{c}" for c in _OUT)
       + " FROM f) SELECT l_orderkey, l_linenumber, " + ", ".join(f"{r(f'CASE WHEN {c} < lo_{c} THEN lo_{c} WHEN {c} > hi_{c} THEN hi_{c} ELSE {c} END', 3)} AS {c}" for c in _OUT) + " FROM f, b")
def _(t):
    return rounded(clean.handle_outliers(t("line_outliers"), _OUT, "zscore", "capping").select("l_orderkey", "l_linenumber", *_OUT), 3)


@query("cl_outliers_zscore_delete", f"WITH f AS {fx('line_outliers')}, b AS (SELECT avg(l_extendedprice) AS m, stddev_pop(l_extendedprice) AS s FROM f) "
       "SELECT l_orderkey, l_linenumber, l_extendedprice FROM f, b WHERE l_extendedprice IS NULL OR abs((l_extendedprice - m) / s) < 3")
def _(t):
    return clean.handle_outliers(t("line_outliers"), ["l_extendedprice"], "zscore", "deletion").select("l_orderkey", "l_linenumber", "l_extendedprice")


_COUNT = "CAST(sum(CASE WHEN {test} THEN 1 ELSE 0 END) AS BIGINT) AS outlier_count, " + r("100.0e0 * sum(CASE WHEN {test} THEN 1 ELSE 0 END) / count(*)") + " AS outlier_pct"


def _counted(test):
    return _COUNT.replace("{test}", test)


@query("cl_outlier_summary_iqr", f"WITH f AS {fx('line_outliers')}, b AS (SELECT {_BOUNDS} FROM f) " + each(_OUT, _counted("{c} < lo_{c} OR {c} > hi_{c}"), "f, b"))
def _(t):
    return rounded(clean.outlier_summary(t("line_outliers"), _OUT, "iqr"))


@query("cl_outlier_summary_zscore", f"WITH f AS {fx('line_outliers')}, b AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in _OUT) + " FROM f) "
       + each(_OUT, _counted("abs(({c} - m_{c}) / s_{c}) > 3"), "f, b"))
def _(t):
    return rounded(clean.outlier_summary(t("line_outliers"), _OUT, "zscore"))


# NaN is missing like NULL; infinities are values beyond every fence that no statistic takes in
_NAN = f"f AS (SELECT o_orderkey, CASE WHEN isnan(price) THEN NULL ELSE price END AS p, CASE WHEN isfinite(price) THEN price END AS x FROM {fx('orders_nan')})"
_NAN_IQR = f"{_NAN}, b AS (SELECT {q('x', 0.25)} - 1.5e0 * ({q('x', 0.75)} - {q('x', 0.25)}) AS lo, {q('x', 0.75)} + 1.5e0 * ({q('x', 0.75)} - {q('x', 0.25)}) AS hi FROM f)"


@query("cl_null_summary_nan", f"WITH {_NAN} SELECT 'price' AS \"column\", CAST(count(*) - count(p) AS BIGINT) AS null_count, {r('100.0e0 * (count(*) - count(p)) / count(*)')} AS null_pct FROM f")
def _(t):
    return rounded(clean.null_summary(t("orders_nan"), ["price"]))


for _how, _sql in {"mean": "avg(x)", "median": "median(x)"}.items():
    query(f"cl_impute_{_how}_nan", f"WITH {_NAN} SELECT o_orderkey, {r(f'coalesce(x, (SELECT {_sql} FROM f))', 4)} AS price FROM f")(
        lambda t, h=_how: rounded(clean.impute(t("orders_nan"), {"price": h}), 4))


@query("cl_impute_drop_nan", f"WITH {_NAN} SELECT o_orderkey, p AS price FROM f WHERE p IS NOT NULL")
def _(t):
    return clean.impute(t("orders_nan"), {"price": "drop"})


@query("cl_outliers_iqr_cap_nan", f"WITH {_NAN_IQR} SELECT o_orderkey, {r('CASE WHEN p < lo THEN lo WHEN p > hi THEN hi ELSE p END', 4)} AS price FROM f, b")
def _(t):
    return rounded(clean.handle_outliers(t("orders_nan"), ["price"], "iqr", "capping"), 4)


@query("cl_outliers_zscore_cap_nan", f"WITH {_NAN}, b AS (SELECT avg(x) - 3 * stddev_samp(x) AS lo, avg(x) + 3 * stddev_samp(x) AS hi FROM f) "
       f"SELECT o_orderkey, {r('CASE WHEN p < lo THEN lo WHEN p > hi THEN hi ELSE p END', 3)} AS price FROM f, b")
def _(t):
    return rounded(clean.handle_outliers(t("orders_nan"), ["price"], "zscore", "capping"), 3)


@query("cl_outliers_iqr_delete_nan", f"WITH {_NAN_IQR} SELECT o_orderkey, p AS price FROM f, b WHERE p BETWEEN lo AND hi")
def _(t):
    return clean.handle_outliers(t("orders_nan"), ["price"], "iqr", "deletion")


@query("cl_outlier_summary_nan", f"WITH {_NAN_IQR} SELECT 'price' AS \"column\", CAST(count(*) FILTER (WHERE p < lo OR p > hi) AS BIGINT) AS outlier_count, "
       f"{r('100.0e0 * count(*) FILTER (WHERE p < lo OR p > hi) / count(*)')} AS outlier_pct FROM f, b")
def _(t):
    return rounded(clean.outlier_summary(t("orders_nan"), ["price"], "iqr"))


@query("cl_validate_dates", f"SELECT o_orderkey, TRY_CAST(day_text AS TIMESTAMP) AS day_text FROM {fx('dates_text')}")
def _(t):
    return clean.validate_dates(t("dates_text"), ["day_text"])


@query("cl_validate_dates_drop", f"SELECT o_orderkey, TRY_CAST(day_text AS TIMESTAMP) AS day_text FROM {fx('dates_text')} WHERE TRY_CAST(day_text AS TIMESTAMP) IS NOT NULL")
def _(t):
    return clean.validate_dates(t("dates_text"), ["day_text"], "drop_invalid")


@query("cl_validate_dates_impute", f"SELECT o_orderkey, coalesce(TRY_CAST(day_text AS TIMESTAMP), TIMESTAMP '1970-01-01') AS day_text FROM {fx('dates_text')}")
def _(t):
    return clean.validate_dates(t("dates_text"), ["day_text"], "impute")


@query("cl_date_like_columns", "SELECT 'o_orderpriority' AS \"column\" FROM orders HAVING max(CASE WHEN regexp_matches(o_orderpriority, '[/-]') THEN 1 ELSE 0 END) = 1 "
       "UNION ALL SELECT 'o_orderstatus' FROM orders HAVING max(CASE WHEN regexp_matches(o_orderstatus, '[/-]') THEN 1 ELSE 0 END) = 1")
def _(t):
    return clean.date_like_columns(t("orders"))


@query("cl_binary_or_dummies", "WITH s AS (SELECT l_linestatus AS v, min(l_orderkey * 8 + l_linenumber) AS o FROM lineitem GROUP BY 1), c AS (SELECT v, row_number() OVER (ORDER BY o) - 1 AS code FROM s) "
       "SELECT l_orderkey, l_linenumber, l_partkey, CAST(code AS BIGINT) AS l_linestatus, l_returnflag = 'A' AS \"l_returnflag_A\", l_returnflag = 'N' AS \"l_returnflag_N\", l_returnflag = 'R' AS \"l_returnflag_R\" "
       "FROM lineitem JOIN c ON l_linestatus = v")
def _(t):
    df = t("lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_orderkey * 8 + l_linenumber AS o", "l_linestatus", "l_returnflag")
    return clean.binary_or_dummies(df, ["l_linestatus", "l_returnflag"], ["o"]).drop("o")


@query("cl_clean_numeric", f"WITH f AS {fx('orders_nulls')} SELECT o_orderkey, {r('coalesce(o_totalprice, (SELECT median(o_totalprice) FROM f))', 4)} AS o_totalprice FROM f")
def _(t):
    return rounded(clean.clean_numeric(t("orders_nulls"), ["o_totalprice"]).select("o_orderkey", "o_totalprice"), 4)


# -- scaling -----------------------------------------------------------------------------------

_SC = ["l_quantity", "l_extendedprice", "l_discount"]
_KEY = "l_orderkey, l_linenumber, l_partkey"


def _line(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *_SC)


def _scaled(stats: str, formula: str, digits: int = 6) -> str:
    return (f"WITH b AS (SELECT {', '.join(stats.format(c=c) for c in _SC)} FROM lineitem) SELECT {_KEY}, "
            + ", ".join(f"{r(formula.format(c=c), digits)} AS {c}" for c in _SC) + " FROM lineitem, b")


@query("sc_minmax", _scaled("min({c}) AS a_{c}, max({c}) - min({c}) AS w_{c}", "({c} - a_{c}) / w_{c}"))
def _(t):
    return rounded(scale.minmax(_line(t), _SC))


@query("sc_minmax_range", _scaled("min({c}) AS a_{c}, max({c}) - min({c}) AS w_{c}", "({c} - a_{c}) / (w_{c} / 2.0e0) - 1.0e0"))
def _(t):
    return rounded(scale.minmax(_line(t), _SC, (-1.0, 1.0)))


@query("sc_minmax_inverse", f"SELECT {_KEY}, " + ", ".join(f"{r(c, 4)} AS {c}" for c in _SC) + " FROM lineitem")
def _(t):
    fitted = scale.fit_minmax(_line(t), _SC)
    return rounded(scale.inverse(fitted).transform(fitted.transform(_line(t))), 4)


@query("sc_zscore", _scaled("avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}", "({c} - m_{c}) / s_{c}", 5))
def _(t):
    return rounded(scale.zscore(_line(t), _SC), 5)


@query("sc_robust", _scaled("median({c}) AS m_{c}, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS s_{c}", "({c} - m_{c}) / s_{c}"))
def _(t):
    return rounded(scale.robust(_line(t), _SC))


@query("sc_mean_normalize", _scaled("avg({c}) AS m_{c}, max({c}) - min({c}) AS s_{c}", "({c} - m_{c}) / s_{c}", 5))
def _(t):
    return rounded(scale.mean_normalize(_line(t), _SC), 5)


@query("sc_scale_for_model", _scaled("median({c}) AS m_{c}, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS s_{c}", "({c} - m_{c}) / s_{c}"))
def _(t):
    return rounded(scale.fit_scale_for_model(_line(t), _SC, "robust").transform(_line(t)))


@query("sc_column_stats", each(_SC, f"{r('min({c})', 2)} AS min, {r('max({c})', 2)} AS max, {r('avg({c})', 2)} AS mean, {r('stddev_samp({c})', 2)} AS std", "lineitem"))
def _(t):
    return rounded(scale.column_stats(t("lineitem"), _SC), 2)


@query("sc_describe", each(_SC, "CAST(count({c}) AS BIGINT) AS count, " + ", ".join(f"{r(e, 4)} AS {n}" for n, e in {
    "mean": "avg({c})", "std": "stddev_samp({c})", "min": "min({c})", "q25": "quantile_cont({c}, 0.25)", "q50": "median({c})", "q75": "quantile_cont({c}, 0.75)", "max": "max({c})"}.items()), "lineitem"))
def _(t):
    return rounded(scale.describe_numeric(t("lineitem"), _SC), 4)


# -- encoding ----------------------------------------------------------------------------------

@query("en_label_encode", f"WITH f AS (SELECT o_orderkey, coalesce(o_orderpriority, 'nan') AS v FROM {fx('orders_nulls')}) SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY v) - 1 AS BIGINT) AS o_orderpriority FROM f")
def _(t):
    return encode.label_encode(t("orders_nulls"), ["o_orderpriority"]).select("o_orderkey", "o_orderpriority")


@query("en_label_decode", f"SELECT o_orderkey, coalesce(o_orderpriority, 'nan') AS o_orderpriority FROM {fx('orders_nulls')}")
def _(t):
    df = t("orders_nulls").select("o_orderkey", "o_orderpriority")
    fitted = encode.fit_label_encode(df, ["o_orderpriority"])
    return fitted.inverse(fitted.transform(df))


@query("en_label_unknown", "WITH w AS (SELECT DISTINCT p_type AS v FROM part WHERE p_partkey % 2 = 0 AND p_type <> 'PROMO'), c AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM w) "
       "SELECT p_partkey, CAST(coalesce(code, -1) AS BIGINT) AS p_type FROM part LEFT JOIN c ON p_type = v")
def _(t):
    df = t("part").select("p_partkey", "p_type")
    return encode.fit_label_encode(df.where("p_partkey % 2 = 0 AND p_type <> 'PROMO'"), ["p_type"], handle_unknown="use_encoded_value").transform(df)


@query("en_onehot", "SELECT p_partkey, " + ", ".join(f"p_type = '{v}' AS \"p_type_{v}\"" for v in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")) + " FROM part")
def _(t):
    return encode.onehot(t("part").select("p_partkey", "p_type"), ["p_type"])


@query("en_onehot_drop_first", "SELECT o_orderkey, coalesce(o_orderstatus = 'O', false) AS \"o_orderstatus_O\", coalesce(o_orderstatus = 'P', false) AS \"o_orderstatus_P\" FROM orders")
def _(t):
    return encode.onehot(t("orders").select("o_orderkey", "o_orderstatus"), ["o_orderstatus"], drop_first=True)


@query("en_ordinal", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0.0e0 WHEN 'O' THEN 1.0e0 ELSE -1.0e0 END AS o_orderstatus FROM orders")
def _(t):
    return encode.ordinal(t("orders").select("o_orderkey", "o_orderstatus"), ["o_orderstatus"], {"o_orderstatus": ["F", "O"]}, "use_encoded_value", -1.0)


@query("en_target_encode", f"WITH m AS (SELECT c_mktsegment AS v, avg(c_acctbal) AS a FROM customer GROUP BY 1) SELECT c_custkey, {r('a', 4)} AS c_mktsegment, c_acctbal FROM customer JOIN m ON c_mktsegment = v")
def _(t):
    return rounded(encode.target_encode(t("customer").select("c_custkey", "c_mktsegment", "c_acctbal"), ["c_mktsegment"], "c_acctbal"), 4)


@query("en_binary_encode", "WITH s AS (SELECT o_orderpriority AS v, min(o_orderkey) AS o FROM orders GROUP BY 1), c AS (SELECT v, row_number() OVER (ORDER BY o) AS code FROM s) "
       "SELECT o_orderkey, CAST((code >> 2) & 1 AS INTEGER) AS o_orderpriority_0, CAST((code >> 1) & 1 AS INTEGER) AS o_orderpriority_1, CAST(code & 1 AS INTEGER) AS o_orderpriority_2 FROM orders JOIN c ON o_orderpriority = v")
def _(t):
    return encode.binary_encode(t("orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", ["o_orderkey"])


@query("en_frequency_encode", f"WITH m AS (SELECT event_type AS v, count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM events) AS a FROM events GROUP BY 1) SELECT event_id, {r('a')} AS event_type FROM events JOIN m ON event_type = v")
def _(t):
    return rounded(encode.frequency_encode(t("events").select("event_id", "event_type"), ["event_type"]))


@query("en_hash_encode", "SELECT p_partkey, CAST('0x' || substr(md5(p_name), 1, 8) AS BIGINT) % 64 AS p_name FROM part")
def _(t):
    return encode.hash_encode(t("part").select("p_partkey", "p_name"), ["p_name"], 64)


@query("en_group_rare", f"WITH f AS {fx('shares_rare')}, c AS (SELECT kind AS v, count(*) AS n FROM f GROUP BY 1) SELECT p_partkey, CASE WHEN n >= 0.01e0 * (SELECT count(*) FROM f) THEN kind ELSE 'Other' END AS kind FROM f JOIN c ON kind = v")
def _(t):
    return encode.group_rare(t("shares_rare").select("p_partkey", "kind"), ["kind"])


@query("en_one_hot_for_model", "SELECT o_orderkey, o_totalprice, o_orderstatus, CAST(o_totalprice AS DOUBLE) AS x_o_totalprice, CASE WHEN o_orderstatus = 'O' THEN 1.0e0 ELSE 0.0e0 END AS \"x_o_orderstatus_O\", "
       "CASE WHEN o_orderstatus = 'P' THEN 1.0e0 ELSE 0.0e0 END AS \"x_o_orderstatus_P\" FROM orders")
def _(t):
    return encode.one_hot_for_model(t("orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), ["o_totalprice", "o_orderstatus"])


@query("en_preprocess", f"WITH f AS {fx('orders_nulls')}, g AS (SELECT *, coalesce(o_totalprice, (SELECT median(o_totalprice) FROM f)) AS x FROM f), b AS (SELECT avg(x) AS m, stddev_pop(x) AS s FROM g) "
       f"SELECT o_orderkey, {r('(x - m) / s', 5)} AS x_o_totalprice, " + ", ".join(f"CASE WHEN coalesce(o_orderpriority, 'missing') = '{v}' THEN 1.0e0 ELSE 0.0e0 END AS \"x_o_orderpriority_{v}\"" for v in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "missing")) + " FROM g, b")
def _(t):
    return rounded(encode.preprocess(t("orders_nulls").select("o_orderkey", "o_totalprice", "o_orderpriority"), ["o_totalprice", "o_orderpriority"]).drop("o_totalprice", "o_orderpriority"), 5)


@query("en_preprocess_dates", "WITH p AS (SELECT o_orderkey, " + ", ".join(f"CAST({fn}(o_orderdate) AS DOUBLE) AS {part}" for part, fn in (("year", "year"), ("month", "month"), ("day", "day"), ("weekday", "isodow"))) + " FROM orders) "
       "SELECT o_orderkey, " + ", ".join(f"{r(f'({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()', 5)} AS x_o_orderdate_{c}" for c in ("year", "month", "day", "weekday")) + " FROM p")
def _(t):
    return rounded(encode.preprocess(t("orders").select("o_orderkey", "o_orderdate"), ["o_orderdate"]).drop("o_orderdate"), 5)


@query("en_label_saved", "SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS BIGINT) AS p_type FROM part")
def _(t):
    df = t("part").select("p_partkey", "p_type")
    path = settled_path(df.sparkSession)
    encode.fit_label_encode(df, ["p_type"]).save(path)
    return encode.load_dictionary(df.sparkSession, path).transform(df)
