"""Columns that an operator passes through, whatever their names and types.

Inside an operator the columns of its input have names of their own, so blanks, dots, quotes or
names that differ by case can't disturb it.  A result column replaces an input column of its
name; as in Spark, case doesn't count.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BOX = "_box"


class Columns:
    """The columns of `df` beside those that the results replace.

    `moved` names columns that travel on their own (long texts), not in the box with the rest."""

    def __init__(self, df: DataFrame, results: Sequence[str] = (), moved: Sequence[str] = ()):
        names = df.columns
        self.inside = {f"in_{k}": n for k, n in enumerate(names)}
        self.df = df.toDF(*self.inside)
        self.moved = {self.find(n): n for n in moved}
        gone = {r.lower() for r in results}
        self.kept = [i for i, n in self.inside.items() if n.lower() not in gone or i in self.moved]

    def find(self, name: str) -> str:
        """The name inside of the input column of this name: spelled so, else whatever its case."""
        for same in (lambda n: n == name, lambda n: n.lower() == name.lower()):
            for i, n in self.inside.items():
                if same(n):
                    return i
        raise ValueError(f"no column {name} among {list(self.inside.values())}")

    def __getitem__(self, name: str) -> Column:
        return F.col(self.find(name))

    def rows(self, **columns: Column) -> DataFrame:
        """The box and these columns."""
        boxed = [F.col(i) for i in self.kept if i not in self.moved] or [F.lit(None).cast("boolean").alias("none")]
        return self.df.select(F.struct(*boxed).alias(BOX), *(c.alias(n) for n, c in columns.items()))

    def back(self, df: DataFrame, results: Sequence[str | Column] = (), **moved: str | Column) -> DataFrame:
        """What passes through, under its own names and in its own order, then the results; `moved`
        gives the columns that travelled on their own."""
        at = {self.find(n): F.col(c) if isinstance(c, str) else c for n, c in moved.items()}
        return df.select(*(at.get(i, F.col(f"{BOX}.{i}") if i not in self.moved else None).alias(self.inside[i]) for i in self.kept), *results)


def boxed_schema(rows: DataFrame, ddl: str) -> StructType:
    """The columns of `rows`, then those of the DDL."""
    return StructType([*rows.schema.fields, *StructType.fromDDL(ddl).fields])


def arrow_schema(spark: SparkSession, schema: str | StructType) -> pa.Schema:
    """The Arrow schema that Spark uses for rows of this schema."""
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)


def batch_of(columns: Sequence[pa.Array], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x.cast(f.type) if x.type != f.type else x for x, f in zip(columns, schema, strict=True)], schema=schema)
