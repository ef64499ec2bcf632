"""Feature steps as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Right-closed age bands.
AGE_EDGES, AGE_NAMES = (0, 25, 35, 50, 65, 100), ("18-25", "26-35", "36-50", "51-65", "66+")


def impute(df: DataFrame, column: str, value) -> DataFrame:
    return df.withColumn(column, F.coalesce(F.col(column), F.lit(value)))


def clip(value: Column, lower=None, upper=None) -> Column:
    """Null stays null, unlike with least and greatest, which skip it."""
    out = value
    if upper is not None:
        out = F.when(out > upper, F.lit(upper)).otherwise(out)
    if lower is not None:
        out = F.when(out < lower, F.lit(lower)).otherwise(out)
    return out


def log1p(value: Column) -> Column:
    return F.log1p(value)


def bucket(value: Column, edges: tuple = AGE_EDGES, names: tuple = AGE_NAMES) -> Column:
    """The name of the right-closed interval that holds the value; null outside all."""
    out = F.lit(None).cast("string")
    for low, high, name in reversed(list(zip(edges[:-1], edges[1:], names, strict=True))):
        out = F.when((value > low) & (value <= high), name).otherwise(out)
    return out


def either(condition: Column, yes, no) -> Column:
    """A null condition is false."""
    return F.when(F.coalesce(condition, F.lit(False)), F.lit(yes)).otherwise(F.lit(no))
