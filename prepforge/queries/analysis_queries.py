"""Statistics, chart tables, feature selection, evaluation."""

from pyspark.sql import functions as F

from ..functions.frame import rounded
from ..operators import charts, evaluate, reduce, select, stats
from .registry import each, fx, query, r

# -- statistics --------------------------------------------------------------------------------

_ST = ["l_quantity", "l_extendedprice", "l_discount"]


@query("st_describe", each(_ST, ", ".join(f"{r(e, d)} AS {n}" for n, e, d in [
    ("mean", "avg({c})", 4), ("median", "median({c})", 4), ("std", "stddev_samp({c})", 4), ("var", "var_samp({c})", 4), ("skew", "skewness({c})", 4), ("kurt", "kurtosis({c})", 4)])
    + ", (SELECT {c} FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS mode", "lineitem"))
def _(t):
    return rounded(stats.describe(t("lineitem"), _ST), 4)


_PAIRS = [(a, b) for a in _ST for b in _ST]


@query("st_correlation_matrix", " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, {r(f'corr({a}, {b})')} AS r FROM lineitem" for a, b in _PAIRS))
def _(t):
    return rounded(stats.correlation_matrix(t("lineitem"), _ST))


_WELCH = """WITH f AS (SELECT CASE WHEN c_nationkey % 2 = 0 THEN 'even' ELSE 'odd' END AS g, c_acctbal AS v FROM customer),
s AS (SELECT g, count(*) AS n, avg(v) AS m, var_samp(v) AS s2 FROM f GROUP BY 1), a AS (SELECT * FROM s WHERE g = 'even'), b AS (SELECT * FROM s WHERE g = 'odd')
SELECT a.g AS group_1, b.g AS group_2, CAST(a.n AS BIGINT) AS n_1, CAST(b.n AS BIGINT) AS n_2, """ + r("a.m") + " AS mean_1, " + r("b.m") + " AS mean_2, " + r("(a.m - b.m) / sqrt(a.s2 / a.n + b.s2 / b.n)") + " AS t, " \
    + r("power(a.s2 / a.n + b.s2 / b.n, 2) / (power(a.s2 / a.n, 2) / (a.n - 1) + power(b.s2 / b.n, 2) / (b.n - 1))") + " AS dof FROM a, b"


@query("st_t_test", _WELCH)
def _(t):
    df = t("customer").selectExpr("CASE WHEN c_nationkey % 2 = 0 THEN 'even' ELSE 'odd' END AS g", "c_acctbal")
    return rounded(stats.t_test_two_sample(df, "g", "c_acctbal").drop("p_value", "significant"))


@query("st_confidence_interval", f"SELECT 'c_acctbal' AS \"column\", CAST(count(*) AS BIGINT) AS n, {r('avg(c_acctbal)')} AS mean, {r('stddev_samp(c_acctbal) / sqrt(count(*))')} AS std_error FROM customer")
def _(t):
    return rounded(stats.confidence_interval(t("customer"), "c_acctbal", 95).drop("margin", "lower", "upper"))


@query("st_t_test_p_value")
def _(t):
    df = t("customer").selectExpr("CASE WHEN c_nationkey % 2 = 0 THEN 'even' ELSE 'odd' END AS g", "c_acctbal")
    return stats.t_test_two_sample(df, "g", "c_acctbal")


@query("st_confidence_bounds")
def _(t):
    return stats.confidence_interval(t("orders"), "o_totalprice", 99)


@query("st_correlation_summary", f"WITH s AS (SELECT count(*) AS n, corr(l_quantity, l_extendedprice) AS c FROM lineitem) SELECT 'l_quantity' AS x, 'l_extendedprice' AS y, CAST(n AS BIGINT) AS n, {r('c')} AS r, "
       "CASE WHEN abs(c) >= 0.8 THEN 'very strong' WHEN abs(c) >= 0.6 THEN 'strong' WHEN abs(c) >= 0.3 THEN 'moderate' ELSE 'weak' END AS strength, CASE WHEN abs(c) < 0.05 THEN 'none' WHEN c > 0 THEN 'positive' ELSE 'negative' END AS direction FROM s")
def _(t):
    return rounded(stats.correlation_summary(t("lineitem"), "l_quantity", "l_extendedprice"))


@query("st_regression_line", f"SELECT {r('regr_slope(l_extendedprice, l_quantity)', 4)} AS slope, {r('regr_intercept(l_extendedprice, l_quantity)', 4)} AS intercept, {r('regr_r2(l_extendedprice, l_quantity)')} AS r2 FROM lineitem")
def _(t):
    one = stats.regression_line(t("lineitem"), "l_quantity", "l_extendedprice")
    return one.select((F.round("slope", 4) + 0.0).alias("slope"), (F.round("intercept", 4) + 0.0).alias("intercept"), (F.round("r2", 6) + 0.0).alias("r2"))


@query("st_feature_target_correlations", each(["l_quantity", "l_discount", "l_tax"], f"{r('corr({c}, l_extendedprice)')} AS r", "lineitem", "feature"))
def _(t):
    return rounded(stats.feature_target_correlations(t("lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice"))


# -- charts ------------------------------------------------------------------------------------

@query("ch_scatter", "SELECT l_quantity, l_extendedprice, l_returnflag, l_discount FROM lineitem")
def _(t):
    return charts.scatter_data(t("lineitem"), "l_quantity", "l_extendedprice", "l_returnflag", "l_discount")


@query("ch_scatter_sample", "SELECT o_totalprice, o_custkey FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR)) LIMIT 500")
def _(t):
    return charts.scatter_data(t("orders"), "o_totalprice", "o_custkey", key=["o_orderkey"], points=500)


@query("ch_line", "SELECT o_orderstatus, o_orderdate, o_totalprice FROM orders")
def _(t):
    return charts.line_data(t("orders"), "o_orderdate", "o_totalprice", "o_orderstatus")


@query("ch_bar", f"SELECT o_orderpriority, o_orderstatus, {r('sum(o_totalprice)', 2)} AS height FROM orders GROUP BY 1, 2")
def _(t):
    return rounded(charts.bar_data(t("orders"), "o_orderpriority", "o_totalprice", "o_orderstatus"), 2)


def _histogram(source: str, column: str, bins: int, by: str = "") -> str:
    keys = f"{by}, " if by else ""
    group = "1, 2" if by else "1"
    inner = f"SELECT {keys}CAST(least(floor(({column} - lo) / w), {bins - 1}) AS INTEGER) AS bin, lo, w FROM {source}, b WHERE {column} IS NOT NULL"
    return (f"WITH b0 AS (SELECT min({column}) AS lo, max({column}) AS hi FROM {source}), b AS (SELECT lo, (hi - lo) / {bins} AS w FROM b0) "
            f"SELECT {keys}bin, {r('any_value(lo) + bin * any_value(w)')} AS lower, {r('any_value(lo) + (bin + 1) * any_value(w)')} AS upper, CAST(count(*) AS BIGINT) AS count FROM ({inner}) GROUP BY {group}")


@query("ch_histogram", _histogram("events", "value", 30))
def _(t):
    return rounded(charts.histogram(t("events"), "value", 30))


@query("ch_histogram_by", _histogram("events", "value", 20, "event_type"))
def _(t):
    return rounded(charts.histogram(t("events"), "value", 20, "event_type"))


@query("ch_box", "WITH b AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS q1, median(l_extendedprice) AS m, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY 1) "
       f"SELECT l_returnflag, {r('q1', 4)} AS q1, {r('m', 4)} AS median, {r('q3', 4)} AS q3, min(l_extendedprice) FILTER (l_extendedprice >= q1 - 1.5e0 * (q3 - q1)) AS low, max(l_extendedprice) FILTER (l_extendedprice <= q3 + 1.5e0 * (q3 - q1)) AS high, "
       "CAST(count(*) AS BIGINT) AS n FROM lineitem JOIN b USING (l_returnflag) GROUP BY l_returnflag, q1, m, q3")
def _(t):
    return rounded(charts.box_data(t("lineitem"), "l_extendedprice", "l_returnflag"), 4)


@query("ch_pie_count", f"SELECT event_type, CAST(count(*) AS DOUBLE) AS value, {r('count(*) / CAST((SELECT count(*) FROM events) AS DOUBLE)')} AS share FROM events GROUP BY 1")
def _(t):
    return rounded(charts.pie_data(t("events"), "event_type"))


@query("ch_pie_sum", f"SELECT event_type, {r('sum(value)', 4)} AS value, {r('sum(value) / (SELECT sum(value) FROM events)', 4)} AS share FROM events GROUP BY 1")
def _(t):
    return rounded(charts.pie_data(t("events"), "event_type", "value"), 4)


@query("ch_heatmap", f"SELECT l_linestatus, l_returnflag, {r('avg(l_extendedprice)', 4)} AS mean FROM lineitem GROUP BY 1, 2")
def _(t):
    return rounded(charts.heatmap_pivot(t("lineitem"), "l_returnflag", "l_linestatus", "l_extendedprice"), 4)


@query("ch_heatmap_wide", "SELECT l_linestatus, " + ", ".join(f"{r(f'avg(l_extendedprice) FILTER (l_returnflag = {chr(39)}{v}{chr(39)})', 4)} AS \"{v}\"" for v in "ANR") + " FROM lineitem GROUP BY 1")
def _(t):
    return rounded(charts.heatmap_pivot(t("lineitem"), "l_returnflag", "l_linestatus", "l_extendedprice", wide=True), 4)


@query("ch_parallel_coordinates", "SELECT p_size, p_retailprice, p_partkey, p_type FROM part")
def _(t):
    return charts.parallel_coordinates_data(t("part"), ["p_size", "p_retailprice", "p_partkey"], "p_type")


@query("ch_missing", f"WITH f AS {fx('docs_labels')} SELECT * FROM ({each(['doc_id', 'text', 'lang', 'source', 'n_chars', 'quality', 'toxic'], r('100.0e0 * (count(*) - count({c})) / count(*)') + ' AS null_pct', 'f')}) WHERE null_pct > 0")
def _(t):
    return rounded(charts.missing_chart(t("docs_labels")))


@query("ch_target_distribution", "SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS count FROM orders GROUP BY 1")
def _(t):
    return charts.target_distribution_chart(t("orders"), "o_orderstatus", "classification")


@query("ch_target_histogram", _histogram("orders", "o_totalprice", 30))
def _(t):
    return rounded(charts.target_distribution_chart(t("orders"), "o_totalprice", "regression"))


_RED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "price_copy", "qty_mean", "qty_max"]
_RED_PAIRS = [(a, b) for i, a in enumerate(_RED) for b in _RED[i + 1:]]


def _all_pairs(limit: str) -> str:
    return f"WITH f AS {fx('redundant')}, p AS (" + " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, {r(f'corr({a}, {b})', 8)} AS r FROM f" for a, b in _RED_PAIRS) + f") {limit}"


@query("ch_top_correlations", _all_pairs("SELECT x, y, r FROM p ORDER BY abs(r) DESC, x, y LIMIT 6"))
def _(t):
    pairs = rounded(charts.top_correlations(t("redundant"), _RED, n=len(_RED_PAIRS)), 8)
    return pairs.orderBy(F.abs("r").desc(), "x", "y").limit(6)


@query("ch_top_correlations_target", " UNION ALL ".join(f"SELECT '{c}' AS x, 'l_extendedprice' AS y, {r(f'corr({c}, l_extendedprice)')} AS r FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax")))
def _(t):
    return rounded(charts.top_correlations(t("lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", 10))


@query("ch_feature_spread", each(["l_quantity", "l_extendedprice", "l_discount", "l_tax"], f"{r('CASE WHEN abs(avg({c})) > 1e-9 THEN stddev_samp({c}) / abs(avg({c})) ELSE stddev_samp({c}) END')} AS spread", "lineitem"))
def _(t):
    return rounded(charts.feature_spread(t("lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))


@query("ch_pair_plot", f"SELECT o_totalprice, o_orderkey FROM {fx('orders_nulls')} WHERE o_totalprice IS NOT NULL")
def _(t):
    return charts.pair_plot_data(t("orders_nulls"), max_features=2)


@query("ch_categorical_frequencies", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", value, CAST(n AS BIGINT) AS count FROM (SELECT {c} AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, 1 LIMIT 15)" for c in ("p_brand", "p_type")))
def _(t):
    return charts.categorical_frequencies(t("part"))


@query("ch_density_by_group", "WITH b0 AS (SELECT min(value) AS lo, max(value) AS hi FROM events), x AS (SELECT event_type AS g, value AS v, CAST(least(floor((value - lo) / ((hi - lo) / 200.0e0)), 199) AS INTEGER) AS b FROM events, b0), "
       "bins AS (SELECT g, b, count(*) AS c, avg(v) AS m FROM x GROUP BY 1, 2), s AS (SELECT g, count(*) AS n, stddev_samp(v) * power(count(*), -0.2e0) AS h FROM x GROUP BY 1), "
       "grid AS (SELECT i, lo + i * ((hi - lo) / 49.0e0) AS p FROM range(50) t(i), b0) "
       f"SELECT g AS event_type, {r('p')} AS x, {r('sum(c * exp(-0.5e0 * power((p - m) / h, 2)) / (n * h * sqrt(2 * pi())))', 8)} AS density FROM bins JOIN s USING (g), grid GROUP BY g, p")
def _(t):
    d = charts.density_by_group(t("events"), "value", "event_type", points=50, fine_bins=200)
    return d.select("event_type", (F.round("x", 6) + 0.0).alias("x"), (F.round("density", 8) + 0.0).alias("density"))


# -- feature selection ---------------------------------------------------------------------------

_FS = ["p_size", "p_retailprice"]


def _chi2(source: str, cols: list[str], target: str) -> str:
    one = ("SELECT '{c}' AS feature, sum((o - e) * (o - e) / e) AS chi2 FROM (SELECT o, n / CAST(sum(n) OVER () AS DOUBLE) * sum(o) OVER () AS e FROM "
           "(SELECT count(*) AS n, sum({c}) AS o FROM " + source + f" GROUP BY {target}))")
    return " UNION ALL ".join(one.replace("{c}", c) for c in cols)


@query("fs_chi2_scores", f"SELECT feature, {r('chi2')} AS chi2 FROM ({_chi2('part', _FS, 'p_type')})")
def _(t):
    return rounded(select.chi2_scores(t("part"), _FS, "p_type"))


@query("fs_select_chi2", "SELECT p_size, p_type FROM part")
def _(t):
    return select.select_chi2(t("part"), _FS, "p_type", 1)


def _anova(source: str, cols: list[str], target: str) -> str:
    one = ("SELECT '{c}' AS feature, (sum(n * (m - g) * (m - g)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))) AS f_value FROM (SELECT n, m, v, sum(n * m) OVER () / sum(n) OVER () AS g FROM "
           "(SELECT count(*) AS n, avg({c}) AS m, var_pop({c}) AS v FROM " + source + f" GROUP BY {target}))")
    return " UNION ALL ".join(one.replace("{c}", c) for c in cols)


@query("fs_anova_scores", f"SELECT feature, {r('f_value', 5)} AS f_value FROM ({_anova('part', ['p_partkey', 'p_size', 'p_retailprice'], 'p_type')})")
def _(t):
    return rounded(select.anova_scores(t("part"), "p_type"), 5)


# grp is cut from l_quantity, so that column is the best one on any table size
@query("fs_select_anova", "SELECT l_quantity, grp FROM " + fx("line_groups"))
def _(t):
    return select.select_anova(t("line_groups").drop("l_orderkey", "l_linenumber"), "grp", 1)


@query("fs_select_correlation", f"SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM {fx('redundant')}")
def _(t):
    return select.select_correlation(t("redundant"), 0.95)


@query("fs_select_variance", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag, l_linestatus, l_shipdate FROM lineitem")
def _(t):
    return select.select_variance(t("lineitem"), 0.01)


@query("fs_select_rfe_unsupervised", "SELECT l_quantity, l_extendedprice FROM lineitem")
def _(t):
    return select.select_rfe(t("lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], None, 2)


@query("fs_rfe_linear")
def _(t):
    return select.rfe_ranking(t("lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", 1)


@query("fs_rfe_tree")
def _(t):
    return select.rfe_ranking(t("part"), ["p_size", "p_retailprice", "p_partkey"], "p_type", 1, "tree", trees=20)


@query("fs_infer_task", "SELECT 'p_type' AS \"column\", 'classification' AS task UNION ALL SELECT 'p_retailprice', CASE WHEN (SELECT count(DISTINCT p_retailprice) FROM part) <= 20 THEN 'classification' ELSE 'regression' END "
       "UNION ALL SELECT 'p_size', CASE WHEN (SELECT count(DISTINCT p_size) FROM part) <= 20 THEN 'classification' ELSE 'regression' END UNION ALL SELECT 'none', 'unsupervised'")
def _(t):
    df = t("part")
    return df.sparkSession.createDataFrame([(c, select.infer_task(df, c)) for c in ("p_type", "p_retailprice", "p_size", "none")], "column string, task string")


# -- dimensionality reduction --------------------------------------------------------------------

_PC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("dr_pca")
def _(t):
    return reduce.pca(t("lineitem").select("l_orderkey", *_PC), _PC, 2)


@query("dr_pca_whiten_moments", "SELECT 0.0e0 AS mean_1, 0.0e0 AS mean_2, 1.0e0 AS var_1, 1.0e0 AS var_2, 0.0e0 AS r")
def _(t):
    w = reduce.pca(t("lineitem"), _PC, 2, whiten=True)
    return rounded(w.agg(F.avg("PC1").alias("mean_1"), F.avg("PC2").alias("mean_2"), F.var_samp("PC1").alias("var_1"), F.var_samp("PC2").alias("var_2"), F.corr("PC1", "PC2").alias("r")), 5)


# two columns: the eigenvalues of a symmetric 2 x 2 matrix have a closed form
@query("dr_pca_explained_variance", "WITH s AS (SELECT var_samp(l_quantity) AS a, var_samp(l_tax * 100) AS b, covar_samp(l_quantity, l_tax * 100) AS c FROM lineitem), e AS (SELECT (a + b) / 2 + sqrt((a - b) * (a - b) / 4 + c * c) AS l1, a + b AS total FROM s) "
       f"SELECT 'PC1' AS component, {r('l1 / total')} AS ratio, {r('l1 / total')} AS cumulative FROM e UNION ALL SELECT 'PC2', {r('1 - l1 / total')}, 1.0e0 FROM e")
def _(t):
    df = t("lineitem").selectExpr("l_quantity", "l_tax * 100 AS tax")
    return rounded(reduce.pca_explained_variance(df, reduce.fit_pca(df, ["l_quantity", "tax"], 2)))


@query("dr_pca_loadings")
def _(t):
    df = t("lineitem")
    return reduce.pca_loadings(df, reduce.fit_pca(df, _PC, 2))


@query("dr_discriminant_projection")
def _(t):
    df = t("line_groups")
    return reduce.discriminant_projection(df, ["l_quantity", "l_extendedprice", "l_discount"], "grp", 2)


# within-class variance of every axis is 1 by construction
@query("dr_discriminant_within", "SELECT 1.0e0 AS within_1, 1.0e0 AS within_2")
def _(t):
    df = reduce.discriminant_projection(t("line_groups"), ["l_quantity", "l_extendedprice", "l_discount"], "grp", 2)
    per = df.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.var_pop("LDA_1").alias("a"), F.var_pop("LDA_2").alias("b"))
    return rounded(per.agg((F.sum(F.col("n") * F.col("a")) / (F.sum("n") - F.count(F.lit(1)))).alias("within_1"), (F.sum(F.col("n") * F.col("b")) / (F.sum("n") - F.count(F.lit(1)))).alias("within_2")), 5)


@query("dr_discriminant_importance")
def _(t):
    df = t("line_groups")
    return reduce.discriminant_importance(df, reduce.fit_discriminant(df, ["l_quantity", "l_extendedprice", "l_discount"], "grp"))


@query("dr_discriminant_classes", f"SELECT CAST(grp AS VARCHAR) AS \"class\", CAST(count(*) AS BIGINT) AS \"rows\", {r('count(*) / CAST((SELECT count(*) FROM lineitem) AS DOUBLE)')} AS share FROM {fx('line_groups')} GROUP BY 1")
def _(t):
    return rounded(reduce.discriminant_classes(t("line_groups"), "grp"))


# -- evaluation ----------------------------------------------------------------------------------

_SP = fx("status_predictions")


@query("ev_confusion_matrix", f"WITH f AS {_SP}, k AS (SELECT label AS c FROM f UNION SELECT prediction FROM f) SELECT a.c AS actual, p.c AS predicted, CAST((SELECT count(*) FROM f WHERE label = a.c AND prediction = p.c) AS BIGINT) AS count FROM k a, k p")
def _(t):
    return evaluate.confusion_matrix(t("status_predictions"), "label", "prediction")


_CLASS = (f"f AS {_SP}, k AS (SELECT label AS c FROM f UNION SELECT prediction FROM f), "
          "n AS (SELECT c, (SELECT count(*) FROM f WHERE label = c AND prediction = c) AS tp, (SELECT count(*) FROM f WHERE label = c) AS s, (SELECT count(*) FROM f WHERE prediction = c) AS ch FROM k), "
          "m AS (SELECT c, tp, s, ch, CASE WHEN ch > 0 THEN tp / CAST(ch AS DOUBLE) ELSE 0 END AS p, CASE WHEN s > 0 THEN tp / CAST(s AS DOUBLE) ELSE 0 END AS r FROM n), "
          "z AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM m)")


@query("ev_classification_report", f"WITH {_CLASS}, u AS (SELECT c AS \"class\", p AS precision, r AS recall, f1, s AS support FROM z "
       "UNION ALL SELECT 'accuracy', sum(tp) / CAST(sum(s) AS DOUBLE), sum(tp) / CAST(sum(s) AS DOUBLE), sum(tp) / CAST(sum(s) AS DOUBLE), sum(s) FROM z "
       "UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f1), sum(s) FROM z UNION ALL SELECT 'weighted avg', sum(p * s) / sum(s), sum(r * s) / sum(s), sum(f1 * s) / sum(s), sum(s) FROM z) "
       f"SELECT \"class\", {r('precision')} AS precision, {r('recall')} AS recall, {r('f1')} AS f1, CAST(support AS BIGINT) AS support FROM u")
def _(t):
    return rounded(evaluate.classification_report(t("status_predictions"), "label", "prediction"))


_BAND = "CASE WHEN {x} >= 0.9 THEN 'excellent' WHEN {x} >= 0.8 THEN 'good' WHEN {x} >= 0.7 THEN 'fair' ELSE 'poor' END AS performance_band"


@query("ev_scores_weighted", f"WITH {_CLASS} SELECT {r('sum(tp) / CAST(sum(s) AS DOUBLE)')} AS accuracy, {r('sum(p * s) / sum(s)')} AS precision, {r('sum(r * s) / sum(s)')} AS recall, {r('sum(f1 * s) / sum(s)')} AS f1, CAST(sum(s) AS BIGINT) AS \"rows\", "
       + _BAND.replace("{x}", "sum(tp) / CAST(sum(s) AS DOUBLE)") + " FROM z")
def _(t):
    return rounded(evaluate.classification_scores(t("status_predictions"), "label", "prediction"))


def _binary(keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    g = f" GROUP BY {keys}" if keys else ""
    return (f"WITH f AS {fx('predictions')}, s AS (SELECT {k}count(*) AS n, sum(CASE WHEN label = prediction THEN 1.0e0 ELSE 0 END) / count(*) AS a, sum(CASE WHEN label = 1 AND prediction = 1 THEN 1.0e0 ELSE 0 END) AS tp, "
            f"CAST(sum(prediction) AS DOUBLE) AS ch, CAST(sum(label) AS DOUBLE) AS su FROM f{g}) SELECT {k}{r('a')} AS accuracy, {r('tp / ch')} AS precision, {r('tp / su')} AS recall, {r('2 * tp / (ch + su)')} AS f1, CAST(n AS BIGINT) AS \"rows\", "
            + _BAND.replace("{x}", "a") + " FROM s")


@query("ev_scores_binary", _binary())
def _(t):
    return rounded(evaluate.classification_scores(t("predictions"), "label", "prediction"))


@query("ev_subgroup_metrics", _binary("o_orderpriority"))
def _(t):
    return rounded(evaluate.subgroup_metrics(t("predictions"), "o_orderpriority", "label", "prediction"))


_ROC = (f"WITH f AS {fx('predictions')}, g AS (SELECT score, CAST(sum(label) AS DOUBLE) AS pos, CAST(sum(1 - label) AS DOUBLE) AS neg FROM f GROUP BY 1), "
        "w AS (SELECT score, pos, neg, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM g) ")


@query("ev_roc_curve", _ROC + f"SELECT {r('score')} AS threshold, {r('fp / n')} AS fpr, {r('tp / p')} AS tpr FROM w UNION ALL SELECT NULL, 0.0e0, 0.0e0")
def _(t):
    return rounded(evaluate.roc_curve(t("predictions"), "label", "score"))


@query("ev_auc", _ROC + f", a AS (SELECT sum(neg * (2 * tp - pos)) / 2 / (any_value(p) * any_value(n)) AS a, any_value(p) AS p, any_value(n) AS n FROM w) SELECT {r('a')} AS auc, CAST(p AS BIGINT) AS positives, CAST(n AS BIGINT) AS negatives, " + _BAND.replace("{x}", "a") + " FROM a")
def _(t):
    return rounded(evaluate.auc(t("predictions"), "label", "score"))


@query("ev_class_distribution", f"WITH {_CLASS} SELECT c AS \"class\", CAST(s AS BIGINT) AS actual, CAST(ch AS BIGINT) AS predicted, {r('r')} AS accuracy FROM z")
def _(t):
    return rounded(evaluate.class_distribution(t("status_predictions"), "label", "prediction"))


def _regression(keys: str = "", features: int = 1) -> str:
    k = f"{keys}, " if keys else ""
    g = f" GROUP BY {keys}" if keys else ""
    return (f"WITH f AS {fx('value_predictions')}, s AS (SELECT {k}count(*) AS n, avg(abs(actual - predicted)) AS mae, avg((actual - predicted) * (actual - predicted)) AS mse, var_pop(actual) AS v, 100 * avg(CASE WHEN actual <> 0 THEN abs((actual - predicted) / actual) ELSE 0 END) AS mape FROM f{g}), "
            f"z AS (SELECT *, 1 - mse / v AS r2 FROM s) SELECT {k}{r('r2', 4)} AS r2, {r(f'1 - (1 - r2) * (n - 1) / (n - {features} - 1)', 4)} AS adjusted_r2, {r('mae', 4)} AS mae, {r('mse', 0)} AS mse, {r('sqrt(mse)', 4)} AS rmse, {r('mape', 4)} AS mape, CAST(n AS BIGINT) AS \"rows\", "
            "CASE WHEN r2 > 0.7 THEN 'good' WHEN r2 > 0.5 THEN 'moderate' ELSE 'poor' END AS regression_band, CASE WHEN r2 < 0.5 THEN 'low' WHEN r2 < 0.8 THEN 'medium' ELSE 'high' END AS advice_band FROM z")


def _reg_round(df):
    return rounded(df.withColumn("mse", F.round("mse", 0)), 4)


@query("ev_regression_metrics", _regression(features=3))
def _(t):
    return _reg_round(evaluate.regression_metrics(t("value_predictions"), "actual", "predicted", 3))


@query("ev_subgroup_regression", _regression("o_orderstatus"))
def _(t):
    return _reg_round(evaluate.subgroup_metrics(t("value_predictions"), "o_orderstatus", "actual", "predicted", "regression"))


@query("ev_residuals", f"SELECT o_orderkey, {r('actual - predicted', 5)} AS residual, {r('abs(actual - predicted)', 5)} AS abs_residual FROM {fx('value_predictions')}")
def _(t):
    return rounded(evaluate.residuals(t("value_predictions"), "actual", "predicted").select("o_orderkey", "residual", "abs_residual"), 5)


@query("ev_residual_histogram", _histogram(f"(SELECT actual - predicted AS residual FROM {fx('value_predictions')})", "residual", 20))
def _(t):
    return rounded(evaluate.residual_histogram(t("value_predictions"), "actual", "predicted"))


_BOTH = f"(SELECT 'actual' AS series, actual AS value FROM {fx('value_predictions')} UNION ALL SELECT 'predicted', predicted FROM {fx('value_predictions')})"


@query("ev_actual_predicted_histogram", _histogram(_BOTH, "value", 20, "series"))
def _(t):
    return rounded(evaluate.actual_predicted_histogram(t("value_predictions"), "actual", "predicted"))


_PAIRWISE = ("e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), d AS (SELECT a.vec_id, a.label AS own, b.label AS other, sum(list_distance(a.v, b.v)) AS t, count(*) AS n FROM e a, e b GROUP BY 1, 2, 3), "
             "s AS (SELECT vec_id, own, max(CASE WHEN own = other THEN n END) AS size, max(CASE WHEN own = other AND n > 1 THEN t / (n - 1) END) AS a, min(CASE WHEN own <> other THEN t / n END) AS b FROM d GROUP BY 1, 2), "
             "z AS (SELECT vec_id, own, CASE WHEN size = 1 THEN 0 ELSE (b - a) / greatest(a, b) END AS s FROM s)")


@query("ev_silhouette_rows", f"WITH {_PAIRWISE} SELECT vec_id AS id, own AS cluster, {r('s')} AS silhouette FROM z")
def _(t):
    return rounded(evaluate.silhouette_rows(t("embeddings"), "vec_id", "embedding", "label"))


_SIL_BAND = "CASE WHEN {x} >= 0.7 THEN 'strong' WHEN {x} >= 0.5 THEN 'reasonable' WHEN {x} >= 0.25 THEN 'weak' ELSE 'none' END AS silhouette_band"


@query("ev_silhouette", f"WITH {_PAIRWISE} SELECT {r('avg(s)')} AS silhouette, CAST(count(*) AS BIGINT) AS \"rows\", " + _SIL_BAND.replace("{x}", "avg(s)") + " FROM z")
def _(t):
    return rounded(evaluate.silhouette(t("embeddings"), "vec_id", "embedding", "label"))


@query("ev_silhouette_sq", "WITH " + _PAIRWISE.replace("sum(list_distance(a.v, b.v))", "sum(power(list_distance(a.v, b.v), 2))") + f" SELECT {r('avg(s)')} AS silhouette_sq, CAST(count(*) AS BIGINT) AS \"rows\" FROM z")
def _(t):
    return rounded(evaluate.silhouette_sq(t("embeddings"), "embedding", "label"))


_CENT = ("x AS (SELECT vec_id, label, unnest(CAST(embedding AS DOUBLE[])) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(v) AS m FROM x GROUP BY 1, 2), g AS (SELECT i, avg(v) AS m FROM x GROUP BY 1), "
         "w AS (SELECT vec_id, label, sum((v - m) * (v - m)) AS d2 FROM x JOIN c USING (label, i) GROUP BY 1, 2), k AS (SELECT label, count(*) AS n, sum(d2) AS ss, avg(sqrt(d2)) AS s FROM w GROUP BY 1)")


@query("ev_cluster_separation", f"WITH {_CENT}, b AS (SELECT sum(n * q) AS b FROM (SELECT label, sum((c.m - g.m) * (c.m - g.m)) AS q FROM c JOIN g USING (i) GROUP BY 1) JOIN k USING (label)), "
       "t AS (SELECT a.label AS la, o.label AS lo, sqrt(sum((a.m - o.m) * (a.m - o.m))) AS gap FROM c a JOIN c o USING (i) WHERE a.label <> o.label GROUP BY 1, 2), "
       "db AS (SELECT la, max((ka.s + ko.s) / gap) AS worst FROM t JOIN k ka ON ka.label = la JOIN k ko ON ko.label = lo GROUP BY 1) "
       f"SELECT {r('(SELECT b FROM b) / (count(*) - 1) / (sum(ss) / (sum(n) - count(*)))')} AS calinski_harabasz, {r('(SELECT avg(worst) FROM db)')} AS davies_bouldin, CAST(count(*) AS INTEGER) AS clusters FROM k")
def _(t):
    return rounded(evaluate.cluster_separation(t("embeddings"), "embedding", "label"))


@query("ev_inertia", f"WITH {_CENT} SELECT {r('sum(ss)')} AS inertia, CAST(count(*) AS BIGINT) AS clusters FROM k")
def _(t):
    return rounded(evaluate.inertia(t("embeddings"), "embedding", "label"))


@query("ev_scaled_cluster_scores", f"WITH {_PAIRWISE}, {_CENT}, b AS (SELECT sum(n * q) AS b FROM (SELECT label, sum((c.m - g.m) * (c.m - g.m)) AS q FROM c JOIN g USING (i) GROUP BY 1) JOIN k USING (label)), "
       "t2 AS (SELECT a.label AS la, o.label AS lo, sqrt(sum((a.m - o.m) * (a.m - o.m))) AS gap FROM c a JOIN c o USING (i) WHERE a.label <> o.label GROUP BY 1, 2), "
       "db AS (SELECT la, max((ka.s + ko.s) / gap) AS worst FROM t2 JOIN k ka ON ka.label = la JOIN k ko ON ko.label = lo GROUP BY 1), "
       "f AS (SELECT (SELECT avg(s) FROM z) AS s, (SELECT b FROM b) / (count(*) - 1) / (sum(ss) / (sum(n) - count(*))) AS ch, (SELECT avg(worst) FROM db) AS d FROM k) "
       f"SELECT {r('s')} AS silhouette, " + _SIL_BAND.replace("{x}", "s") + f", {r('least(ch / 1000, 1)')} AS ch_scaled, {r('1 - least(d / 10, 1)')} AS db_scaled FROM f")
def _(t):
    df = t("embeddings")
    both = evaluate.cluster_separation(df, "embedding", "label").crossJoin(evaluate.silhouette(df, "vec_id", "embedding", "label").select("silhouette"))  # one row each
    return rounded(evaluate.scaled_cluster_scores(both).select("silhouette", "silhouette_band", "ch_scaled", "db_scaled"))
