"""Column expressions that the operators share. All stay inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What counts as a number in text: no type suffixes, no infinities, no digit separators.
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def kind(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def missing(df: DataFrame, name: str) -> Column:
    """Null, and NaN in float columns; infinities are values."""
    c = quoted(name)
    return (c.isNull() | F.isnan(c)) if isinstance(kind(df, name), (T.DoubleType, T.FloatType)) else c.isNull()


def present(df: DataFrame, name: str) -> Column:
    """The value, or null where it is missing."""
    c = quoted(name)
    return F.when(~F.isnan(c), c) if isinstance(kind(df, name), (T.DoubleType, T.FloatType)) else c


def is_number(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_time(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def as_number(df: DataFrame, name: str) -> Column | None:
    """A comparable number: integers and decimals as they are, text if it looks like a finite number, else null.

    None for types that have no order as numbers (dates, arrays and so on).
    """
    dtype = kind(df, name)
    if isinstance(dtype, T.BooleanType):
        return quoted(name).cast("int")
    if is_number(dtype):
        return present(df, name)
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        value = F.when(quoted(name).rlike(NUMBER), quoted(name).try_cast("double"))
        return F.when(F.abs(value) < F.lit(float("inf")), value)
    return None


def java_pattern(pattern: str) -> str:
    """A Python pattern in Java's dialect: Unicode classes, \\n as the only line end, named groups."""
    re.compile(pattern)  # a wrong pattern fails when the rule is made, not when it runs
    return "(?Ud)" + re.sub(r"\(\?P<", "(?<", re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", pattern))


def starts_with_match(text: Column, pattern: str) -> Column:
    """True where the pattern matches at the very start; it need not reach the end."""
    return text.rlike(r"\A(?:" + java_pattern(pattern) + ")")


def round_binary(value: Column, digits: int) -> Column:
    """The double times a power of ten, its nearest whole number (halves away from zero), and back: as DuckDB rounds.

    Spark's own round takes the shortest decimal text instead: 3 / 20000 is 0.00015 there, while the double times 10^4 is
    below 1.5.
    """
    scale = F.lit(10.0**digits)
    return F.round(value * scale) / scale


def bigrams(text: Column) -> Column:
    """The set of lower-case character pairs; a text of one character or none is its own only member."""
    low = F.lower(text)
    pairs = F.transform(F.sequence(F.lit(1), F.length(low) - 1), lambda i: F.substring(low, i, F.lit(2)))
    return F.when(F.length(low) > 1, F.array_distinct(pairs)).otherwise(F.array(low))


def bigram_similarity(a: Column, b: Column) -> Column:
    x, y = bigrams(a), bigrams(b)
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def masked(text: Column) -> Column:
    """First and last three characters with stars between; three stars for texts of up to six."""
    n = F.length(text)
    return F.when(n > 6, F.concat(F.substring(text, 1, 3), F.repeat(F.lit("*"), n - 6), F.right(text, F.lit(3)))).otherwise(F.lit("***"))


def age_days(moment: Column, as_of: Column) -> Column:
    """Whole days, rounded down, so that the future is negative."""
    micros = lambda x: F.unix_micros(x.cast("timestamp"))
    return F.floor((micros(as_of) - micros(moment)) / F.lit(86_400_000_000)).cast("long")


def dtype_name(dtype: T.DataType) -> str:
    """The short names that schema comparisons use."""
    # These names and their promotions are part of the public interface.
    names = {"byte": "int8", "short": "int16", "integer": "int32", "long": "int64", "float": "float32", "double": "float64", "boolean": "bool", "string": "object", "date": "datetime64[ns]", "timestamp": "datetime64[ns]", "timestamp_ntz": "datetime64[ns]"}
    return names.get(dtype.typeName(), dtype.simpleString())
