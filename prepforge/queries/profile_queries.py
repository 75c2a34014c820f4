"""Profile facts, decisions, plans."""

from pyspark.sql import functions as F

from ..fixtures import FIXTURES
from ..functions.frame import rounded
from ..operators import profile as pr
from ..operators.profile import TableProfile
from ..plans import prepare
from .registry import each, fx, query, r

_CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
_ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
_EVENTS = ["event_id", "ts", "user_id", "event_type", "value", "props"]
_PART = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
_DOCS = ["doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"]
_EMPTY = ["o_orderkey", "o_totalprice", "o_orderstatus", "c_const", "c_empty"]


def _letters(name: str) -> str:
    return f"regexp_replace(lower('{name}'), '[^a-z]', '', 'g')"


def _token(name: str, tokens: list[str]) -> str:
    return f"regexp_matches({_letters(name)}, '{'|'.join(tokens)}')"


def _docs(t):
    return t("docs_labels")


@query("pr_infer_task_type", "SELECT 'o_orderstatus' AS \"column\", 'Classification' AS task UNION ALL SELECT 'o_custkey', CASE WHEN (SELECT count(DISTINCT o_custkey) FROM orders) <= 20 THEN 'Classification' ELSE 'Regression' END "
       "UNION ALL SELECT 'o_totalprice', 'Regression' UNION ALL SELECT 'absent', 'Unsupervised'")
def _(t):
    df = t("orders")
    return df.sparkSession.createDataFrame([(c, pr.infer_task_type(df, c)) for c in ("o_orderstatus", "o_custkey", "o_totalprice", "absent")], "column string, task string")


@query("pr_missing_totals", f"WITH f AS {fx('docs_labels')}, s AS (SELECT {' + '.join(f'(count(*) - count({c}))' for c in _DOCS)} AS m, count(*) * {len(_DOCS)} AS n FROM f) SELECT CAST(m AS BIGINT) AS missing_total, {r('100.0e0 * m / n', 2)} AS missing_pct FROM s")
def _(t):
    return pr.missing_totals(TableProfile(_docs(t)))


@query("pr_degenerate_columns", f"WITH f AS {fx('constant_and_empty')}, s AS ({each(_EMPTY, 'count({c}) AS c, count(DISTINCT {c}) AS d, count(*) AS n', 'f')}) "
       "SELECT \"column\", CASE WHEN c = 0 THEN 'fully_missing' ELSE 'constant' END AS fact FROM s WHERE c = 0 OR d + CASE WHEN c < n THEN 1 ELSE 0 END <= 1")
def _(t):
    return pr.degenerate_columns(TableProfile(t("constant_and_empty")))


@query("pr_dataset_scale", "SELECT CAST(count(*) AS BIGINT) AS \"rows\", CASE WHEN count(*) < 1000 THEN 'small' WHEN count(*) < 10000 THEN 'medium' ELSE 'large' END AS scale, 5 AS features, 'low' AS dimensionality FROM part")
def _(t):
    return pr.dataset_scale(TableProfile(t("part"), order_by=["p_partkey"]))


# identifiers: a counter, or an id token and nearly unique values
def _identifiers(table: str, cols: list[str], numbers: list[str]) -> str:
    parts = []
    for c in cols:
        counter = f"max({c}) - min({c}) = count(*) - 1 AND count(DISTINCT {c}) = count(*)" if c in numbers else "false"
        parts.append(f"SELECT '{c}' AS \"column\" FROM {table} HAVING ({counter}) OR ({_token(c, pr.ID_TOKENS)} AND count(DISTINCT {c}) / CAST(count(*) AS DOUBLE) > 0.95)")
    return " UNION ALL ".join(parts)


@query("pr_id_like_columns", f"SELECT \"column\", 'identifier' AS fact FROM ({_identifiers('events', _EVENTS, ['event_id', 'user_id'])})")
def _(t):
    return pr.special_columns(TableProfile(t("events"), order_by=["event_id"])).where("fact = 'identifier'").drop("detail")


@query("pr_name_like_columns", "SELECT 'c_name' AS \"column\", 'name' AS fact FROM customer HAVING count(DISTINCT c_name) / CAST(count(*) AS DOUBLE) > 0.5")
def _(t):
    return pr.special_columns(TableProfile(t("customer"), order_by=["c_custkey"])).where("fact = 'name'").drop("detail")


@query("pr_date_like_columns", "SELECT 'o_orderdate' AS \"column\", CASE WHEN max(hour(o_orderdate) * 60 + minute(o_orderdate)) > 0 THEN 'timestamp' ELSE 'date-only' END AS detail FROM orders")
def _(t):
    return pr.special_columns(TableProfile(t("orders"), order_by=["o_orderkey"])).where("fact = 'date'").drop("fact")


@query("pr_text_like_columns", f"WITH s AS (SELECT text FROM {fx('docs_labels')}), u AS (SELECT count(DISTINCT text) / CAST(count(*) AS DOUBLE) AS u FROM documents) SELECT 'text' AS \"column\" FROM s, u GROUP BY u HAVING (avg(length(text)) > 40 AND u > 0.8) OR avg(length(text)) > 100")
def _(t):
    return pr.special_columns(TableProfile(_docs(t), order_by=["doc_id"])).where("fact = 'text'").select("column")


@query("pr_feature_roles", each(["p_brand", "p_type", "p_size", "p_name"], "CASE WHEN '{c}' = 'p_size' AND count(DISTINCT {c}) > 10 THEN 'numeric' WHEN count(DISTINCT {c}) = 2 THEN 'binary' ELSE 'categorical' END AS role", "part")
       + " UNION ALL SELECT 'p_retailprice', 'numeric'")
def _(t):
    return pr.feature_roles(TableProfile(t("part"), order_by=["p_partkey"]))


_RED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "price_copy", "qty_mean", "qty_max"]
_NUM = ["l_quantity", "l_extendedprice", "l_discount", "price_copy", "qty_mean", "qty_max"]


def _pairs(limit: float) -> str:
    rows = " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, corr({a}, {b}) AS r FROM f" for i, a in enumerate(_RED) for b in _RED[i + 1:])
    return f"WITH f AS {fx('redundant')}, p AS ({rows}) SELECT x, y, {r('r')} AS r FROM p WHERE abs(r) > {limit}"


@query("pr_redundant_pairs", _pairs(0.999))
def _(t):
    return rounded(pr.redundant_pairs(TableProfile(t("redundant"))))


@query("pr_correlation_clusters", "SELECT * FROM (VALUES (0, 'l_extendedprice'), (0, 'price_copy'), (1, 'l_quantity'), (1, 'qty_max'), (1, 'qty_mean')) v(cluster, \"column\")"
       f" WHERE (SELECT count(*) FROM ({_pairs(0.85)})) = 4")
def _(t):
    return pr.correlation_clusters(TableProfile(t("redundant")))


@query("pr_cardinality_buckets", each(["p_brand", "p_type", "p_name"], "CAST(count(DISTINCT {c}) AS BIGINT) AS distinct_values, CASE WHEN count(DISTINCT {c}) <= 5 THEN 'low' WHEN count(DISTINCT {c}) <= 20 THEN 'medium' ELSE 'high' END AS bucket", "part"))
def _(t):
    return pr.cardinality_buckets(TableProfile(t("part"), order_by=["p_partkey"]))


@query("pr_rare_categories", f"WITH f AS {fx('shares_rare')}, c AS (SELECT kind, count(*) AS n FROM f GROUP BY 1) SELECT 'kind' AS \"column\", CAST(count(*) AS BIGINT) AS \"values\", {r('100.0e0 * sum(n) / (SELECT count(*) FROM f)', 1)} AS pct FROM c WHERE n < 0.01e0 * (SELECT count(*) FROM f)")
def _(t):
    return rounded(pr.rare_categories(t("shares_rare"), ["kind", "p_brand"]), 1)


@query("pr_skewed_columns", f"SELECT 'value' AS \"column\", {r('skewness(value)')} AS skew FROM events HAVING abs(skewness(value)) > 1 UNION ALL SELECT 'user_id', {r('skewness(user_id)')} FROM events HAVING abs(skewness(user_id)) > 1")
def _(t):
    return rounded(pr.skewed_columns(TableProfile(t("events"), order_by=["event_id"])))


@query("pr_outlier_columns", f"WITH e AS {fx('events_spiky')}, b AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS c FROM e) "
       f"SELECT 'value' AS \"column\", {r('avg(CASE WHEN value < a - 1.5e0 * (c - a) OR value > c + 1.5e0 * (c - a) THEN 1.0e0 ELSE 0.0e0 END)')} AS outlier_share FROM e, b HAVING avg(CASE WHEN value < a - 1.5e0 * (c - a) OR value > c + 1.5e0 * (c - a) THEN 1.0e0 ELSE 0.0e0 END) > 0.05")
def _(t):
    return rounded(pr.outlier_columns(TableProfile(t("events_spiky"), order_by=["event_id"])))


# name rule only: the family columns exist whatever the rows are
@query("pr_feature_families", "SELECT 'qty' AS family, 'qty_mean' AS \"column\" UNION ALL SELECT 'qty', 'qty_max'")
def _(t):
    return pr.family_table(TableProfile(t("redundant")))


@query("pr_target_distribution", f"SELECT CAST(quality AS VARCHAR) AS label, CAST(count(*) AS BIGINT) AS \"rows\", {r('100.0e0 * count(*) / (SELECT count(*) FROM documents)', 1)} AS pct FROM {fx('docs_labels')} GROUP BY 1")
def _(t):
    return rounded(pr.target_distribution(_docs(t), "quality"), 1)


@query("pr_imbalance_level", f"WITH c AS (SELECT CAST(y AS VARCHAR) AS y, count(*) / CAST((SELECT count(*) FROM orders) AS DOUBLE) AS s FROM {fx('imbalanced')} GROUP BY 1) "
       f"SELECT arg_max(y, s) AS majority, {r('100 * max(s)', 1)} AS majority_pct, arg_min(y, s) AS minority, {r('100 * min(s)', 1)} AS minority_pct, CASE WHEN max(s) >= 0.8 THEN 'severe' WHEN max(s) >= 0.6 THEN 'moderate' ELSE 'none' END AS level FROM c")
def _(t):
    return pr.imbalance_level(TableProfile(t("imbalanced"), "y", ["o_orderkey"]))


@query("pr_leakage_columns", f"WITH f AS {fx('redundant')} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\" FROM f HAVING abs(corr({c}, l_extendedprice)) > 0.99" for c in _RED if c != "l_extendedprice"))
def _(t):
    return pr.leakage_columns(TableProfile(t("redundant"), "l_extendedprice"))


_TYPES = {"p_partkey": "bigint", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "int", "p_retailprice": "double"}


@query("pr_column_facts", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{k}' AS dtype, CAST(count(*) - count({c}) AS BIGINT) AS missing_count, CAST(count(DISTINCT {c}) AS BIGINT) AS distinct_count, "
    + (f"(SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT {c} AS v FROM part ORDER BY 1 LIMIT 5))" if k == "string" else "CAST(NULL AS VARCHAR)") + " AS examples FROM part" for c, k in _TYPES.items()))
def _(t):
    return pr.column_facts(TableProfile(t("part"), order_by=["p_partkey"])).selectExpr("column", "dtype", "missing_count", "distinct_count", "IF(examples IS NULL, NULL, array_join(examples, '|')) AS examples")


@query("pr_dataset_overview", f"WITH f AS {fx('docs_labels')} SELECT CAST(count(*) AS BIGINT) AS \"rows\", 7 AS columns, 4 AS numeric, 3 AS categorical, {r('100.0e0 * (' + ' + '.join(f'(count(*) - count({c}))' for c in _DOCS) + ') / (7 * count(*))', 1)} AS missing_pct FROM f")
def _(t):
    return rounded(pr.dataset_overview(TableProfile(_docs(t))), 1)


def _transform(c: str, table: str) -> str:
    """The scaling rule of one numeric column: skewness and the share outside the fences."""
    return (f"SELECT '{c}' AS \"column\", 'transform' AS stage, CASE WHEN s AND o THEN 'log + robust' WHEN s THEN 'log' WHEN o THEN 'robust' ELSE 'z-score' END AS action FROM "
            f"(SELECT abs(skewness({c})) > 1 AS s, avg(CASE WHEN {c} < any_a - 1.5e0 * (any_c - any_a) OR {c} > any_c + 1.5e0 * (any_c - any_a) THEN 1.0e0 ELSE 0.0e0 END) > 0.05 AS o "
            f"FROM {table}, (SELECT quantile_cont({c}, 0.25) AS any_a, quantile_cont({c}, 0.75) AS any_c FROM {table}))")


def _encode(c: str, table: str) -> str:
    return (f"SELECT '{c}' AS \"column\", 'encode' AS stage, CASE WHEN count(DISTINCT {c}) = 2 THEN 'binary' WHEN count(DISTINCT {c}) <= 10 THEN 'one-hot' WHEN count(DISTINCT {c}) <= 50 THEN 'target' ELSE 'hash' END "
            f"|| CASE WHEN (SELECT min(n) FROM (SELECT count(*) AS n FROM {table} GROUP BY {c})) < 0.01e0 * count(*) THEN ' after grouping rare' ELSE '' END AS action FROM {table}")


def _counter(c: str, table: str) -> str:
    return f"SELECT '{c}' AS \"column\", 'drop' AS stage, 'identifier' AS action FROM {table} HAVING count(DISTINCT {c}) = count(*) AND max({c}) - min({c}) = count(*) - 1"


@query("pr_prep_decisions", " UNION ALL ".join([_counter("o_orderkey", "orders"), _transform("o_custkey", "orders"), _transform("o_totalprice", "orders"), _encode("o_orderpriority", "orders"),
       "SELECT 'o_orderdate', 'parse', CASE WHEN max(hour(o_orderdate) * 60 + minute(o_orderdate)) > 0 THEN 'date parts with hour' ELSE 'date parts with tenure' END FROM orders"]))
def _(t):
    return prepare.prep_decisions(TableProfile(t("orders"), "o_orderstatus", ["o_orderkey"]))


@query("pr_prep_decisions_part", " UNION ALL ".join([_counter("p_partkey", "part"), _encode("p_name", "part"), _encode("p_brand", "part"), _encode("p_type", "part"), _transform("p_size", "part"), _transform("p_retailprice", "part")]))
def _(t):
    return prepare.prep_decisions(TableProfile(t("part"), order_by=["p_partkey"]))


@query("pr_prep_decisions_events")
def _(t):
    return prepare.prep_decisions(TableProfile(t("events"), order_by=["event_id"]))


@query("pr_date_parts", "SELECT o_orderkey, o_orderdate, CAST(year(o_orderdate) AS INTEGER) AS o_orderdate_year, CAST(month(o_orderdate) AS INTEGER) AS o_orderdate_month, CAST(day(o_orderdate) AS INTEGER) AS o_orderdate_day, "
       "CAST(isodow(o_orderdate) - 1 AS INTEGER) AS o_orderdate_weekday, CAST(datediff('day', DATE '2000-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS o_orderdate_tenure FROM orders")
def _(t):
    return pr.date_parts(t("orders").select("o_orderkey", "o_orderdate"), "o_orderdate")


@query("pr_date_parts_time", "SELECT event_id, CAST(year(ts) AS INTEGER) AS ts_year, CAST(month(ts) AS INTEGER) AS ts_month, CAST(day(ts) AS INTEGER) AS ts_day, CAST(isodow(ts) - 1 AS INTEGER) AS ts_weekday, CAST(hour(ts) AS INTEGER) AS ts_hour FROM events")
def _(t):
    return pr.date_parts(t("events").select("event_id", "ts"), "ts", with_time=True).drop("ts")


@query("pr_family_deltas", f"SELECT l_quantity, qty_mean, qty_max, {r('qty_max - qty_mean')} AS qty_max_minus_qty_mean, {r('qty_max / qty_mean')} AS qty_max_over_qty_mean FROM {fx('redundant')}")
def _(t):
    return rounded(pr.family_deltas(t("redundant").select("l_quantity", "qty_mean", "qty_max"), ["qty_mean", "qty_max"]))


@query("pr_date_diffs", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(datediff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS INTEGER) AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def _(t):
    lines = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    both = lines.join(t("orders").selectExpr("o_orderkey AS l_orderkey", "o_orderdate"), "l_orderkey")
    return pr.date_diffs(both, "o_orderdate", "l_shipdate").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "o_orderdate_to_l_shipdate_days AS days")


@query("pr_tfidf_terms", "WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f\\x0B]+')) AS term FROM documents), tf AS (SELECT doc_id, term, CAST(count(*) AS BIGINT) AS tf FROM w GROUP BY 1, 2), "
       f"d AS (SELECT term, ln(((SELECT count(*) FROM documents) + 1.0e0) / (count(*) + 1)) AS idf FROM tf GROUP BY 1) SELECT doc_id, term, tf, {r('tf * idf', 5)} AS weight FROM tf JOIN d USING (term)")
def _(t):
    return rounded(pr.tfidf_terms(t("documents"), "doc_id", "text"), 5)


@query("pr_text_tfidf")
def _(t):
    weights = pr.text_tfidf(t("documents").select("doc_id", "text"), "text", 1 << 14)
    return weights.select("doc_id", F.aggregate(F.unwrap_udt("text_tfidf")["values"], F.lit(0.0), lambda a, x: a + x).alias("total_weight"))


_DATED = "SELECT o_orderkey, o_totalprice, o_orderdate, o_orderdate + INTERVAL 3 DAY AS ship_date FROM orders"
FIXTURES["orders_dated"] = _DATED


def _parts(c: str) -> str:
    return (f"CAST(year({c}) AS INTEGER) AS {c}_year, CAST(month({c}) AS INTEGER) AS {c}_month, CAST(day({c}) AS INTEGER) AS {c}_day, CAST(isodow({c}) - 1 AS INTEGER) AS {c}_weekday, "
            f"CAST(datediff('day', DATE '2000-01-01', CAST({c} AS DATE)) AS INTEGER) AS {c}_tenure")


@query("pr_run_plan_dates", f"WITH d AS ({_DATED}), b AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM d) SELECT {r('(o_totalprice - m) / s', 5)} AS o_totalprice, o_orderdate, ship_date, "
       f"CAST(3 AS INTEGER) AS o_orderdate_to_ship_date_days, {_parts('o_orderdate')}, {_parts('ship_date')} FROM d, b")
def _(t):
    df = t("orders_dated")
    return rounded(prepare.run_plan(df, prepare.preparation_plan(TableProfile(df, order_by=["o_orderkey"])))[0], 5)


@query("pr_preparation_plan")
def _(t):
    return prepare.plan_table(TableProfile(t("orders_nulls"), "o_orderstatus", ["o_orderkey"]))


@query("pr_run_plan", f"WITH f AS {fx('orders_nulls')}, g AS (SELECT o_custkey, o_orderstatus, coalesce(o_totalprice, (SELECT median(o_totalprice) FROM f)) AS p, "
       "coalesce(o_orderpriority, (SELECT o_orderpriority FROM f WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS k FROM f), b AS (SELECT avg(p) AS pm, stddev_pop(p) AS ps, avg(o_custkey) AS cm, stddev_pop(o_custkey) AS cs FROM g) "
       f"SELECT {r('(o_custkey - cm) / cs', 5)} AS o_custkey, {r('(p - pm) / ps', 5)} AS o_totalprice, o_orderstatus, " + ", ".join(f"k = '{v}' AS \"o_orderpriority_{v}\"" for v in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")) + " FROM g, b")
def _(t):
    df = t("orders_nulls")
    plan = prepare.preparation_plan(TableProfile(df, "o_orderstatus", ["o_orderkey"]))
    return rounded(prepare.run_plan(df, plan)[0], 5)


@query("pr_quality_report", "SELECT 'scale' AS fact, CAST(NULL AS VARCHAR) AS subject, CASE WHEN count(*) < 1000 THEN 'small' WHEN count(*) < 10000 THEN 'medium' ELSE 'large' END AS value FROM orders "
       "UNION ALL SELECT 'rows', NULL, CAST(count(*) AS VARCHAR) FROM orders UNION ALL SELECT 'numeric features', NULL, '2' UNION ALL SELECT 'categorical features', NULL, '1' UNION ALL SELECT 'dimensionality', NULL, 'low' "
       "UNION ALL SELECT 'duplicates', NULL, CAST((SELECT count(*) FROM orders) - (SELECT count(*) FROM (SELECT DISTINCT * FROM orders)) AS VARCHAR) "
       "UNION ALL SELECT 'identifier', 'o_orderkey', 'yes' FROM orders HAVING count(DISTINCT o_orderkey) = count(*) AND max(o_orderkey) - min(o_orderkey) = count(*) - 1 "
       "UNION ALL SELECT 'date', 'o_orderdate', 'yes' UNION ALL SELECT 'imbalance', 'o_orderstatus', CASE WHEN max(n) >= 0.8 THEN 'severe' WHEN max(n) >= 0.6 THEN 'moderate' ELSE 'none' END FROM (SELECT count(*) / CAST((SELECT count(*) FROM orders) AS DOUBLE) AS n FROM orders GROUP BY o_orderstatus)")
def _(t):
    return prepare.quality_report(TableProfile(t("orders"), "o_orderstatus", ["o_orderkey"]))
