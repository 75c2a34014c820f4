"""Derived tables: one expression that both Spark SQL and the checking SQL engine understand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "labels"]

FIXTURES = {
    "orders_nulls": "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice, "
                    "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority, o_orderstatus FROM orders",
    "orders_nan": "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN CAST('NaN' AS DOUBLE) WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 101 = 0 THEN CAST('Infinity' AS DOUBLE) "
                  "WHEN o_orderkey % 13 = 0 THEN o_totalprice * 20.0e0 ELSE o_totalprice END AS price FROM orders",
    "events_spiky": "SELECT event_id, CASE WHEN event_id % 12 = 0 THEN value * 1000.0e0 + 100000.0e0 ELSE value END AS value FROM events",
    "orders_dups": "SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderkey % 5 = 0",
    "line_outliers": "SELECT l_orderkey, l_linenumber, l_quantity, l_discount, "
                     "l_extendedprice * CASE WHEN (l_orderkey * 7 + l_linenumber) % 97 = 0 THEN 50 ELSE 1 END AS l_extendedprice FROM lineitem",
    "dates_text": "SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'not a date' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)) END AS day_text FROM orders",
    "constant_and_empty": "SELECT o_orderkey, o_totalprice, o_orderstatus, 1 AS c_const, CAST(NULL AS DOUBLE) AS c_empty FROM orders",
    "redundant": "SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_extendedprice * 2 + 1 AS price_copy, l_quantity * 1.0e0 AS qty_mean, l_quantity + 1.0e0 AS qty_max FROM lineitem",
    "shares_rare": "SELECT p_partkey, CASE WHEN p_partkey % 250 = 0 THEN 'rare' ELSE p_type END AS kind, p_brand, p_size, p_retailprice FROM part",
    "imbalanced": "SELECT o_orderkey, o_totalprice, o_custkey, o_orderpriority, CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END AS y FROM orders",
    "predictions": "SELECT o_orderkey, o_orderpriority, label, score, CASE WHEN score > 0.5e0 THEN 1 ELSE 0 END AS prediction FROM "
                   "(SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label, CAST(o_orderkey * 37 % 101 AS DOUBLE) / CAST(101 AS DOUBLE) AS score FROM orders) s",
    "status_predictions": "SELECT o_orderkey, o_orderstatus AS label, CASE WHEN o_orderkey % 3 = 0 THEN 'F' WHEN o_orderkey % 3 = 1 THEN 'O' ELSE o_orderstatus END AS prediction FROM orders",
    "value_predictions": "SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 50 = 0 THEN 0.0e0 ELSE o_totalprice END AS actual, o_totalprice * (0.9e0 + CAST(o_orderkey % 7 AS DOUBLE) / 40.0e0) AS predicted FROM orders",
    "part_nulls": "SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size END AS p_size, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_retailprice END AS p_retailprice, p_type FROM part",
    "docs_labels": "SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "line_groups": "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, CAST(floor(l_quantity / 13.0e0) AS INT) AS grp FROM lineitem",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table or a derived one."""
    if name not in FIXTURES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(_bound(FIXTURES[name]), **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if _uses(FIXTURES[name], t)})


def _uses(text: str, name: str) -> bool:
    return any(f"{word} {name}" in text for word in ("FROM", "JOIN"))


def _bound(text: str) -> str:
    for t in TABLES:
        for word in ("FROM", "JOIN"):
            text = text.replace(f"{word} {t} ", f"{word} {{{t}}} ").replace(f"{word} {t})", f"{word} {{{t}}})")
            if text.endswith(f"{word} {t}"):
                text = text[: -len(t)] + f"{{{t}}}"
    return text
