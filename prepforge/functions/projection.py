"""Fitted column transforms: plain projections that Catalyst can fuse, push down and stream."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frame import quote


@dataclass
class Projection:
    """``replace`` and ``add`` map column names to SQL text; ``drop`` names columns to remove."""

    replace: dict[str, str] = field(default_factory=dict)
    add: dict[str, str] = field(default_factory=dict)
    drop: list[str] = field(default_factory=list)
    keep_when: str | None = None
    facts: dict = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        if self.keep_when:
            df = df.where(F.expr(self.keep_when))
        kept = [
            F.expr(self.replace[c]).alias(c) if c in self.replace else F.col(quote(c))
            for c in df.columns if c not in self.drop and c not in self.add
        ]
        return df.select(*kept, *[F.expr(e).alias(n) for n, e in self.add.items()])

    def stage(self) -> SQLTransformer:
        """The same projection as a Spark ML stage, so that it is saved with a model."""
        gone = [*self.drop, *self.replace]
        star = f"* EXCEPT ({', '.join(quote(c) for c in gone)})" if gone else "*"
        new = {**self.replace, **self.add}
        items = "".join(f", {e} AS {quote(n)}" for n, e in new.items())
        where = f" WHERE {self.keep_when}" if self.keep_when else ""
        return SQLTransformer(statement=f"SELECT {star}{items} FROM __THIS__{where}")
