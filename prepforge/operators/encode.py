"""Category encoders."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frame import (
    col, columns_by_kind, finite, finite_sql, literal_sql, lookup, need_columns, need_numeric, number_sql, numbered, quote, settle, string_sql,
)
from ..functions.projection import Projection
from ..functions.quantiles import exact_quantiles

MAX_CATEGORIES = 1000
FORMAT = 1  # of saved dictionaries


@dataclass
class Dictionary:
    """A fitted value -> code table per column; transform is a size-checked left join.

    The tables are written in the fit, so codes stay what they were when the source table changes, and
    ``save`` keeps them with a model.
    """

    tables: dict[str, DataFrame]
    code: str
    replace: bool = True
    handle_unknown: str = "null"
    unknown_value: float = -1

    def save(self, path: str) -> None:
        """The tables as Parquet and the settings as text below a path that all machines share."""
        facts = {f.name: getattr(self, f.name) for f in fields(self) if f.name != "tables"}
        for i, words in enumerate(self.tables.values()):
            words.write.parquet(f"{path}/values-{i}")
        spark = next(iter(self.tables.values())).sparkSession
        text = json.dumps({"version": FORMAT, "kind": type(self).__name__, "columns": list(self.tables), "facts": facts})
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{path}/facts")

    def transform(self, df: DataFrame) -> DataFrame:
        order = df.columns
        for c, words in self.tables.items():
            df = lookup(df, words.withColumnRenamed("value", c), c)
            code = F.col(self.code)
            if self.handle_unknown == "use_encoded_value":
                code = F.when(code.isNull() & col(c).isNotNull(), F.lit(self.unknown_value)).otherwise(code)
            elif self.handle_unknown == "error":
                code = F.when(code.isNull() & col(c).isNotNull(), F.raise_error(F.concat(F.lit(f"unknown value in {c}: "), col(c).cast("string")))).otherwise(code)
            df = df.withColumn(c, code).drop(self.code)
        return df.select(*[col(c) for c in order])

    def inverse(self, df: DataFrame) -> DataFrame:
        order = df.columns
        for c, words in self.tables.items():
            back = words.select(F.col(self.code).alias(c), F.col("value").alias("__word"))
            df = lookup(df, back, c).withColumn(c, F.col("__word")).drop("__word")
        return df.select(*[col(c) for c in order])


def load_dictionary(spark: SparkSession, path: str) -> Dictionary:
    saved = json.loads(spark.read.text(f"{path}/facts").head()[0])
    if saved["version"] != FORMAT:
        raise ValueError(f"dictionary of version {saved['version']}, this code reads version {FORMAT}")
    kind = {c.__name__: c for c in (Dictionary, LabelDictionary, BinaryDigits)}[saved["kind"]]
    return kind(tables={c: spark.read.parquet(f"{path}/values-{i}") for i, c in enumerate(saved["columns"])}, **saved["facts"])


def value_tables(df: DataFrame, values: dict[str, Column], **aggregates: Column) -> dict[str, DataFrame]:
    """(value, aggregates) of every named value, NULL included, from one scan of the table with map-side combine."""
    names = [f"__v{i}" for i in range(len(values))]
    plain = df.withColumns(dict(zip(names, values.values())))
    counted = plain.groupingSets([[plain[n]] for n in names], *[plain[n] for n in names]).agg(F.grouping_id().alias("__set"), *[e.alias(n) for n, e in aggregates.items()])
    counted, whole = settle(counted), 2 ** len(names) - 1
    return {c: counted.where(F.col("__set") == whole - 2 ** (len(names) - 1 - i)).select(F.col(n).alias("value"), *aggregates) for i, (c, n) in enumerate(zip(values, names))}


# -- label, ordinal, frequency, target ---------------------------------------------------------

def fit_label_encode(df: DataFrame, columns: list[str], null_label: str | None = "nan", handle_unknown: str = "error", unknown_value: int = -1) -> Dictionary:
    """Codes 0..k-1 in the order of the text values; NULL is the class ``null_label`` (None keeps NULL)."""
    need_columns(df, columns)
    tables = {}
    for c, words in value_tables(df, {c: _label_text(c, null_label) for c in columns}, rows=F.count(F.lit(1))).items():
        words = numbered(words.where("value IS NOT NULL").select("value"), ["value"], "code")
        tables[c] = settle(words.select("value", F.col("code").cast("bigint").alias("code")))
    return LabelDictionary(tables, "code", handle_unknown=handle_unknown, unknown_value=unknown_value, null_label=null_label)


def _label_text(c: str, null_label: str | None) -> Column:
    text = col(c).cast("string")
    return text if null_label is None else F.coalesce(text, F.lit(null_label))


@dataclass
class LabelDictionary(Dictionary):
    null_label: str | None = "nan"

    def transform(self, df: DataFrame) -> DataFrame:
        return super().transform(df.withColumns({c: _label_text(c, self.null_label) for c in self.tables}))


def label_encode(df: DataFrame, columns: list[str], **options) -> DataFrame:
    return fit_label_encode(df, columns, **options).transform(df)


def fit_ordinal(df: DataFrame, columns: list[str], mappings: dict[str, list], handle_unknown: str = "error", unknown_value: float = -1.0) -> Projection:
    """Position in a given list as double.  ``handle_unknown``: ``error`` or ``use_encoded_value``."""
    need_columns(df, columns)
    replace = {}
    for c in columns:
        if c not in mappings:
            raise ValueError(f"no mapping for column {c!r}")
        whens = " ".join(f"WHEN {quote(c)} = {literal_sql(v)} THEN {number_sql(i)}" for i, v in enumerate(mappings[c]))
        if handle_unknown == "error":
            rest = f"WHEN {quote(c)} IS NOT NULL THEN CAST(raise_error(concat('unknown value in {c}: ', {quote(c)})) AS DOUBLE)"
        else:
            rest = f"WHEN {quote(c)} IS NOT NULL THEN {number_sql(unknown_value)}"
        replace[c] = f"CASE {whens} {rest} END"
    return Projection(replace=replace)


def ordinal(df, columns, mappings, handle_unknown="error", unknown_value=-1.0):
    return fit_ordinal(df, columns, mappings, handle_unknown, unknown_value).transform(df)


def fit_target_encode(df: DataFrame, columns: list[str], target: str) -> Dictionary:
    """Category -> mean of a numeric target (partial aggregates); NULL stays NULL."""
    need_numeric(df, [target])
    need_columns(df, columns)
    tables = value_tables(df, {c: col(c) for c in columns}, code=F.avg(finite(df, target)))
    return Dictionary({c: words.where("value IS NOT NULL") for c, words in tables.items()}, "code")


def target_encode(df, columns, target):
    return fit_target_encode(df, columns, target).transform(df)


def fit_frequency_encode(df: DataFrame, columns: list[str]) -> Dictionary:
    """Category -> share of all rows."""
    need_columns(df, columns)
    tables = value_tables(df, {c: col(c) for c in columns}, rows=F.count(F.lit(1)))
    total = next(iter(tables.values())).agg(F.sum("rows")).head()[0] or 1
    return Dictionary({c: words.where("value IS NOT NULL").select("value", (F.col("rows") / F.lit(float(total))).alias("code")) for c, words in tables.items()}, "code")


def frequency_encode(df, columns):
    return fit_frequency_encode(df, columns).transform(df)


def hash_encode(df: DataFrame, columns: list[str], buckets: int = 256) -> DataFrame:
    """Bucket number from the first 32 bits of the md5 of the value, stable across engines; NULL stays NULL."""
    need_columns(df, columns)
    return df.withColumns({c: F.expr(f"CAST(conv(substring(md5(CAST({quote(c)} AS STRING)), 1, 8), 16, 10) AS BIGINT) % {buckets}") for c in columns})


def fit_group_rare(df: DataFrame, columns: list[str], min_share: float = 0.01, other: str = "Other") -> Dictionary:
    """Values below ``min_share`` of the non-null rows become ``other``.

    At most 1/min_share values are kept, so the fitted table is small whatever the cardinality.
    """
    need_columns(df, columns)
    sizes = df.agg(*[F.count(col(c)).alias(c) for c in columns]).head()
    kept = {c: [r[0] for r in df.where(col(c).isNotNull()).groupBy(col(c)).count().where(F.col("count") >= min_share * sizes[c]).select(col(c)).collect()] for c in columns}
    replace = {}
    for c, words in kept.items():
        test = f"{quote(c)} IN ({', '.join(literal_sql(w) for w in sorted(words))})" if words else "false"
        replace[c] = f"CASE WHEN {quote(c)} IS NULL OR {test} THEN {quote(c)} ELSE {string_sql(other)} END"
    return Projection(replace=replace, facts=kept)


def group_rare(df, columns, min_share=0.01, other="Other"):
    return fit_group_rare(df, columns, min_share, other).transform(df)


# -- one-hot and binary digits -----------------------------------------------------------------

def categories_of(df: DataFrame, columns: list[str], limit: int = MAX_CATEGORIES) -> dict[str, list]:
    """Sorted distinct non-null values per column; raises beyond the limit (one bounded job per column)."""
    out = {}
    for c in columns:
        words = df.select(col(c).alias("v")).where("v IS NOT NULL").distinct().limit(limit + 1).collect()
        if len(words) > limit:
            raise ValueError(f"{c}: more than {limit} categories; use target, frequency or hash encoding")
        out[c] = sorted(r[0] for r in words)
    return out


def fit_onehot(df: DataFrame, columns: list[str], drop_first: bool = False, max_categories: int = MAX_CATEGORIES) -> Projection:
    """One boolean column ``column_value`` per value in sorted order; NULL is false everywhere."""
    need_columns(df, columns)
    words = categories_of(df, columns, max_categories)
    pairs = [(f"{c}_{v}", f"coalesce({quote(c)} = {literal_sql(v)}, false)") for c in columns for v in words[c][1 if drop_first else 0:]]
    add = dict(pairs)
    taken = {x.lower() for x in df.columns if x not in columns}
    clash = sorted({n for n, _ in pairs if n.lower() in taken}) or len(add) < len(pairs) and "two values give one column name"
    if clash:
        raise ValueError(f"one-hot columns would replace others: {clash}")
    return Projection(add=add, drop=list(columns), facts=words)


def onehot(df, columns, drop_first=False):
    return fit_onehot(df, columns, drop_first).transform(df)


def fit_binary_encode(df: DataFrame, column: str, order_by: list[str]) -> Dictionary:
    """Number from 1 by first appearance; digits are taken at transform time."""
    need_columns(df, [column, *order_by])
    order = F.struct(*[col(c) for c in order_by])
    seen = df.where(col(column).isNotNull()).groupBy(col(column).alias("value")).agg(F.min(order).alias("o"))
    words = settle(numbered(seen, ["o"], "code").select("value", (F.col("code") + 1).cast("bigint").alias("code")))
    return BinaryDigits({column: words}, "code", width=max(words.count().bit_length(), 1))


@dataclass
class BinaryDigits(Dictionary):
    width: int = 1

    def transform(self, df: DataFrame) -> DataFrame:
        (c, words), = self.tables.items()
        coded = lookup(df, words.withColumnRenamed("value", c), c)
        code = F.coalesce(F.col("code"), F.lit(0))
        digits = [F.shiftright(code, self.width - 1 - i).bitwiseAND(F.lit(1)).cast("int").alias(f"{c}_{i}") for i in range(self.width)]
        return coded.select(*[col(x) for x in df.columns if x != c], *digits)


def binary_encode(df, column, order_by):
    return fit_binary_encode(df, column, order_by).transform(df)


# -- model inputs ------------------------------------------------------------------------------

DATE_PARTS = {"year": "year", "month": "month", "day": "day", "weekday": "weekday"}  # name -> SQL function


def fit_model_inputs(df: DataFrame, features: list[str], scaling: str = "standard", drop_first: bool = True,
                     missing: str = "missing", numeric_fill: str = "median") -> Projection:
    """Numeric, boolean, date and text features to plain double columns, as one projection.

    Numbers: NaN/infinite/NULL to the median (or mean), then standard, robust or no scaling.  Dates and
    timestamps become the numbers year, month, day and weekday.  Text: NULL to ``missing``, one 0/1 column
    per value; unknown values give zeros.  Features of other types are an error.
    """
    kinds = columns_by_kind(df.select(*[col(f) for f in features]))
    if kinds["other"]:
        raise ValueError(f"features must be numbers, text, booleans, dates or timestamps: {kinds['other']}")
    texts, sources = kinds["text"], {}
    for c in features:
        if c in kinds["numeric"]:
            sources[c] = finite_sql(df, c)
        elif c in kinds["boolean"]:
            sources[c] = f"CAST(CAST({quote(c)} AS INT) AS DOUBLE)"
        elif c in kinds["datetime"]:
            sources.update({f"{c}_{part}": f"CAST({fn}({quote(c)}) AS DOUBLE)" for part, fn in DATE_PARTS.items()})
    numeric = list(sources)
    work = df.select(*[F.expr(e).alias(c) for c, e in sources.items()])
    fill, centre, spread = {}, {}, {}
    if numeric:
        q = exact_quantiles(work, numeric, [0.25, 0.5, 0.75] if scaling == "robust" else [0.5])
        fill = {c: v[len(v) // 2] or 0.0 for c, v in q.items()}
        if numeric_fill == "mean":
            row = work.agg(*[F.avg(col(c)).alias(f"m{i}") for i, c in enumerate(numeric)]).head()
            fill = {c: row[f"m{i}"] or 0.0 for i, c in enumerate(numeric)}
        filled = work.select(*[F.coalesce(col(c), F.lit(fill[c])).alias(c) for c in numeric])
        if scaling == "standard":
            row = filled.agg(*[e for i, c in enumerate(numeric) for e in (F.avg(col(c)).alias(f"m{i}"), F.stddev_pop(col(c)).alias(f"s{i}"))]).head()
            centre = {c: row[f"m{i}"] or 0.0 for i, c in enumerate(numeric)}
            spread = {c: row[f"s{i}"] or 1.0 for i, c in enumerate(numeric)}
        elif scaling == "robust":
            present = work.agg(F.count(F.lit(1)).alias("n"), *[F.count(col(c)).alias(f"p{i}") for i, c in enumerate(numeric)]).head()
            if gaps := [c for i, c in enumerate(numeric) if present[f"p{i}"] < present["n"]]:  # only filled columns have new quantiles
                q |= exact_quantiles(filled, gaps, [0.25, 0.5, 0.75])
            centre = {c: v[1] or 0.0 for c, v in q.items()}
            spread = {c: ((v[2] or 0.0) - (v[0] or 0.0)) or 1.0 for c, v in q.items()}
    add, order = {}, {}
    for c in numeric:
        clean = f"coalesce({sources[c]}, {number_sql(fill[c])})"
        order[f"x_{c}"] = f"({clean} - {number_sql(centre[c])}) / {number_sql(spread[c])}" if c in centre else clean
    text_words = categories_of(df.select(*[F.coalesce(col(c), F.lit(missing)).alias(c) for c in texts]), texts) if texts else {}
    for c in features:
        if c in texts:
            for v in text_words[c][1 if drop_first else 0:]:
                add[f"x_{c}_{v}"] = f"IF(coalesce({quote(c)}, {string_sql(missing)}) = {string_sql(v)}, 1.0D, 0.0D)"
    return Projection(add=order | add, facts={"numeric": [c for c in numeric if c in features], "text": text_words, "fill": fill})


def one_hot_for_model(df: DataFrame, features: list[str], drop_first: bool = True) -> DataFrame:
    """Numeric features unscaled and cleaned, text features as 0/1 columns; other columns unchanged."""
    return fit_model_inputs(df, features, "none", drop_first).transform(df)


def preprocess(df: DataFrame, features: list[str]) -> DataFrame:
    """Median and z-score for numbers, ``missing`` and one-hot for text."""
    return fit_model_inputs(df, features, "standard", drop_first=False).transform(df)
