"""Exact quantiles of any number of rows.

The built-in exact ``percentile`` keeps every distinct value of a group in one task, which is fine
up to a row limit.  Beyond it the wanted order statistics are bracketed: a bounded sketch proposes
an interval, an exact count confirms it, and the interval shrinks until it holds few rows.  Every
pass is a partial aggregate, and the result is exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .frame import col, finite, lookup, quote, settle

DIRECT_ROWS = 2_000_000
GRID = 200


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float], direct_rows: int | None = None) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles per column, NULL and NaN ignored."""
    limit = DIRECT_ROWS if direct_rows is None else direct_rows
    values = df.select(*[finite(df, c).alias(c) for c in columns])
    if df.count() <= limit:
        row = values.agg(*[F.expr(f"percentile({quote(c)}, array({', '.join(map(str, probs))}))").alias(c) for c in columns]).head()
        return {c: list(row[c]) if row[c] is not None else [None] * len(probs) for c in columns}
    items = F.array(*[F.struct(F.lit(i).alias("g"), col(c).alias("v")) for i, c in enumerate(columns)])
    pairs = values.select(F.inline(items)).where("v IS NOT NULL")
    found = {r["g"]: list(r["q"]) for r in selected(pairs, settle(sizes_of(pairs)), probs, limit).collect()}  # one row for each column
    return {c: found.get(i, [None] * len(probs)) for i, c in enumerate(columns)}


def exact_quantiles_by(df: DataFrame, by: str, column: str, probs: list[float], direct_rows: int | None = None) -> DataFrame:
    """One row per value of ``by``: (by, q: array<double>), for any number of groups of any size.

    Groups of at most the row limit are one aggregate; larger ones, at most rows / limit of them, are bracketed.
    """
    limit = DIRECT_ROWS if direct_rows is None else direct_rows
    pairs = df.select(col(by).alias("g"), finite(df, column).alias("v")).where("g IS NOT NULL AND v IS NOT NULL")
    direct = F.expr(f"percentile(v, array({', '.join(map(str, probs))}))").alias("q")
    large = settle(sizes_of(pairs).where(F.col("n") > limit))
    if not large.limit(1).count():
        return pairs.groupBy("g").agg(direct).withColumnRenamed("g", by)
    marked = lookup(pairs, large, "g")
    small = marked.where("n IS NULL").groupBy("g").agg(direct)
    return small.unionByName(selected(marked.where("n IS NOT NULL").drop("n"), large, probs, limit)).withColumnRenamed("g", by)


def sizes_of(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("g").agg(F.count(F.lit(1)).alias("n"))


def selected(pairs: DataFrame, sizes: DataFrame, probs: list[float], limit: int) -> DataFrame:
    """(g, q) of ``v`` per ``g`` for the groups of ``sizes`` (g, n); see the module text.

    Brackets are a table with at most two rows for each group and probability; pairs meet the brackets of their group
    through ``lookup``, so large groups are split.
    """
    x = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(float(p)) * (F.col("n") - 1)).alias("x")) for i, p in enumerate(probs)]))
    wanted = settle(sizes.select("g", "n", x.alias("w")).select("g", "n", "w.i", "w.x"))
    places = wanted.select("g", "n", F.explode(F.array(F.floor("x"), F.ceil("x"))).alias("r")).distinct()
    inf = F.lit(float("inf"))
    state = settle(places.select("g", "r", (-inf).alias("lo"), inf.alias("hi"), F.lit(0).cast("bigint").alias("below"), F.col("n").alias("inside"), F.lit(False).alias("stuck")))

    def bracketed(brackets):
        by_group = settle(brackets.groupBy("g").agg(F.collect_list(F.struct(*[c for c in brackets.columns if c != "g"])).alias("b")))
        return lookup(pairs, by_group, "g").where("b IS NOT NULL").select("g", "v", F.inline("b")).where("v >= lo AND v <= hi")

    grid = ", ".join(str(i / GRID) for i in range(GRID + 1))
    open_ = (F.col("inside") > limit) & (F.col("lo") < F.col("hi")) & ~F.col("stuck")
    while state.where(open_).limit(1).count():
        todo = state.where(open_).drop("stuck")
        # places that share a bracket, or the same trial of it, are served by one sketch and one count
        sketch = bracketed(todo.select("g", "lo", "hi").distinct()).groupBy("g", "lo", "hi").agg(F.expr(f"percentile_approx(v, array({grid}), 10000)").alias("s"))
        at = (F.col("r") - F.col("below")) / F.greatest(F.col("inside") - 1, F.lit(1)) * GRID
        a, b = F.get("s", F.greatest(F.lit(0), F.floor(at) - 1).cast("int")), F.get("s", F.least(F.lit(GRID), F.ceil(at) + 1).cast("int"))
        trial = settle(todo.join(sketch, ["g", "lo", "hi"]).select("g", "r", "lo", "hi", "below", "inside", a.alias("a"), b.alias("b")))
        left, mid = F.count_if(F.col("v") < F.col("a")).alias("left"), F.count_if((F.col("v") >= F.col("a")) & (F.col("v") <= F.col("b"))).alias("mid")
        split = ["g", "lo", "hi", "a", "b"]
        counted = trial.join(bracketed(trial.select(*split).distinct()).groupBy(*split).agg(left, mid), split)
        begin = F.col("below") + F.col("left")
        moves = (begin <= F.col("r")) & (F.col("r") < begin + F.col("mid")) & (F.col("mid") < F.col("inside"))  # else the last step counts the distinct values of the bracket
        step = [F.when(moves, new).otherwise(F.col(old)).alias(old) for old, new in (("lo", F.col("a")), ("hi", F.col("b")), ("below", begin), ("inside", F.col("mid")))]
        state = settle(state.where(~open_).unionByName(counted.select("g", "r", *step, (~moves).alias("stuck"))))
    counts = bracketed(state.select("g", "lo", "hi", "below").distinct()).groupBy("g", "lo", "hi", "below", "v").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("g", "lo", "hi").orderBy("v")) + F.col("below")  # at most the limit, or the distinct values of a bracket
    held = counts.withColumn("upto", upto).select("g", "lo", "hi", "v", "n", "upto")
    found = held.join(F.broadcast(state.select("g", "r", "lo", "hi")), ["g", "lo", "hi"]).where("upto > r AND upto - n <= r").select("g", "r", "v")
    ends = wanted.join(found.select("g", F.col("r").alias("lr"), F.col("v").alias("a")), (wanted.g == found.g) & (F.floor("x") == F.col("lr"))).select(wanted.g, "i", "x", "a")
    ends = ends.join(found.select(F.col("g").alias("hg"), F.col("r").alias("hr"), F.col("v").alias("b")), (F.col("g") == F.col("hg")) & (F.ceil("x") == F.col("hr")))
    value = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((F.ceil("x") - F.col("x")) * F.col("a") + (F.col("x") - F.floor("x")) * F.col("b"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("i", value.alias("q")))), lambda s: s["q"])
    return ends.groupBy("g").agg(listed.alias("q"))
