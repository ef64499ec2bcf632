"""Rules compiled to columns: every row-local rule of a suite becomes one sum in one aggregate over one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import as_number, is_time, kind, missing, quoted, starts_with_match
from ..types import RuleType, ValidationRule

#: Longest literal list that stays in the plan; a longer one becomes a table and an anti join.
LITERALS = 10_000


class Unsupported(ValueError):
    """The rule says nothing about a column of this type."""


def failing(df: DataFrame, rule: ValidationRule) -> Column:
    """True where a row breaks a row-local rule; never null."""
    name, p = rule.column, rule.parameters
    if rule.rule_type is RuleType.NOT_NULL:
        return missing(df, name)
    if rule.rule_type is RuleType.RANGE_CHECK:
        value = as_number(df, name)
        if value is None:
            raise Unsupported(f"a range needs numbers; '{name}' is {kind(df, name).simpleString()}")
        broken = F.lit(False)
        if p.get("min_value") is not None:
            broken = broken | (value < F.lit(p["min_value"]))
        if p.get("max_value") is not None:
            broken = broken | (value > F.lit(p["max_value"]))
        return value.isNull() | F.coalesce(broken, F.lit(True))
    if rule.rule_type is RuleType.REGEX_MATCH:
        text = quoted(name).cast("string")
        if isinstance(kind(df, name), (T.FloatType, T.DoubleType)):
            text = F.when(missing(df, name), F.lit("nan")).otherwise(text)
        elif isinstance(kind(df, name), T.BooleanType):
            text = F.initcap(text)
        none = "NaT" if is_time(kind(df, name)) else "nan" if isinstance(kind(df, name), T.NumericType) else "None"
        return ~starts_with_match(F.coalesce(text, F.lit(none)), p["pattern"])
    if rule.rule_type is RuleType.REFERENTIAL_INTEGRITY:
        return ~missing(df, name) & ~quoted(name).isin(list(p["reference_values"]))
    raise Unsupported(f"{rule.rule_type} is not row-local")


def duplicated(df: DataFrame, name: str) -> DataFrame:
    """(value, n) of values that occur more than once; nulls equal each other, as NaN do. Partial aggregates first."""
    return df.groupBy(quoted(name).alias("value")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def orphans(df: DataFrame, name: str, reference: DataFrame) -> DataFrame:
    """Present values that the first column of ``reference`` lacks. Spark broadcasts the reference if it is small."""
    known = reference.select(quoted(reference.columns[0]).alias("__known")).where("__known is not null").distinct()
    return df.where(~missing(df, name)).select(quoted(name).alias("value")).join(known, F.col("value") == F.col("__known"), "left_anti")
