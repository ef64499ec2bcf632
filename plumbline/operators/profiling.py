"""Column profiles. A few jobs over a table whatever its width: statistics, percentiles, value frequencies, whole-row duplicates."""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import dtype_name, is_number, is_time, kind, missing, present, quoted
from ..types import now, rounded

# The points and their names.
PERCENTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}
COMMON = 5
#: Intervals that a pass cuts each open range of percentiles into; least number of parts that a column's values are dealt into.
BINS, PARTS = 1 << 12, 256
TIME = "yyyy-MM-dd HH:mm:ss"


def _text(df: DataFrame, name: str) -> Column:
    return F.date_format(quoted(name), TIME) if is_time(kind(df, name)) else present(df, name).cast("string")


def _exact(df: DataFrame, name: str) -> Column:
    """The text that values are told apart by: with fractions of a second, and one zero for both signs."""
    dtype, value = kind(df, name), present(df, name)
    if is_time(dtype) and not isinstance(dtype, T.DateType):
        return value.cast("string")
    return (value + F.lit(0).cast(dtype)).cast("string") if isinstance(dtype, (T.DoubleType, T.FloatType)) else _text(df, name)


def _profiled(df: DataFrame) -> list[str]:
    """Columns with values that can be compared; maps, arrays and structs are reported by their nulls alone."""
    return [c for c in df.columns if not isinstance(kind(df, c), (T.MapType, T.ArrayType, T.StructType, T.VariantType))]


def basic_stats(df: DataFrame) -> DataFrame:
    """One row: counts of rows and of missing values; extremes, mean and deviation of each column."""
    out = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(df.columns):
        out.append(F.coalesce(F.sum(missing(df, c).cast("long")), F.lit(0)).alias(f"null_{i}"))
        dtype, value = kind(df, c), present(df, c)
        if is_number(dtype):
            number = value.cast("double")
            out += [F.min(number).alias(f"min_{i}"), F.max(number).alias(f"max_{i}"), F.avg(number).alias(f"mean_{i}"), F.stddev_samp(number).alias(f"std_{i}")]
        elif is_time(dtype):
            out += [F.date_format(F.min(value), TIME).alias(f"min_{i}"), F.date_format(F.max(value), TIME).alias(f"max_{i}")]
        elif not isinstance(dtype, T.BooleanType) and c in _profiled(df):
            length = F.length(value.cast("string"))
            out += [F.min(length).alias(f"min_{i}"), F.max(length).alias(f"max_{i}"), F.avg(length).alias(f"mean_{i}")]
    return df.agg(*out)


def percentiles(df: DataFrame) -> DataFrame:
    """(column, percentiles): exact and interpolated, of each numeric column; null for a column without values.

    Each pass counts values in BINS intervals of the ranges that still hold a wanted rank and goes on in the intervals
    where the ranks lie, until these hold one value. A pass is one scan with partial counts: no value is shuffled, and no
    task holds more than BINS rows of a range. Infinities have intervals of their own.
    """
    names = [c for c in df.columns if is_number(kind(df, c))]
    spark, schema = df.sparkSession, "column string, percentiles array<double>"
    value = {c: present(df, c).cast("double") for c in names}
    finite = {c: F.when(F.abs(v) < float("inf"), v) for c, v in value.items()}
    if not names:
        return spark.createDataFrame([], schema)
    ends = df.agg(*(x for i, c in enumerate(names) for x in (F.count(value[c]).alias(f"n{i}"), F.coalesce(F.min(finite[c]), F.lit(0.0)).alias(f"lo{i}"), F.coalesce(F.max(finite[c]), F.lit(0.0)).alias(f"hi{i}")))).first()
    places = {i: [p * (ends[f"n{i}"] - 1) for p in PERCENTILES.values()] for i in range(len(names)) if ends[f"n{i}"]}
    # Open ranks: column, rank, the range they lie in, its scale, and how many values are below it.
    far = float("inf")
    todo = [(i, r, -far, far, ends[f"lo{i}"], ends[f"hi{i}"], 0) for i, own in places.items() for r in sorted({f(x) for x in own for f in (math.floor, math.ceil)})]
    found: dict[tuple[int, int], float] = {}
    while todo:
        ranks = F.broadcast(spark.createDataFrame(todo, "i int, rank long, first double, last double, lo double, hi double, below long"))
        ranges = F.broadcast(spark.createDataFrame(sorted({(i, *ends_) for i, _, *ends_, _ in todo}), "i int, first double, last double, lo double, hi double"))
        open_ = sorted({i for i, *_ in todo})
        cells = df.select(F.explode(F.array(*(F.struct(F.lit(i).alias("i"), value[names[i]].alias("v")) for i in open_))).alias("x")).select("x.*").where("v is not null")
        cells = cells.join(ranges, "i").where("v between first and last")
        share = F.try_divide(F.col("v") / 2 - F.col("lo") / 2, F.col("hi") / 2 - F.col("lo") / 2)
        # The ends of a range are always apart, so that it gets smaller.
        bin_ = F.when(F.col("v") < F.col("lo"), -1).when(F.col("v") > F.col("hi"), BINS).when(F.col("v") == F.col("lo"), 0).when(F.col("v") == F.col("hi"), BINS - 1).otherwise(F.least(F.floor(F.coalesce(share, F.lit(0.0)) * BINS), F.lit(BINS - 1)))
        bins = cells.groupBy("i", "first", bin_.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
        bins = bins.withColumn("to", F.sum("n").over(Window.partitionBy("i", "first").orderBy("bin")))
        hit = bins.join(ranks, ["i", "first"]).where("rank >= below + to - n and rank < below + to")
        todo = []
        for r in hit.select("i", "rank", "least", "most", (F.col("below") + F.col("to") - F.col("n")).alias("below")).collect():
            if r.least == r.most:
                found[r.i, r["rank"]] = r.least
            else:
                todo.append((r.i, r["rank"], r.least, r.most, r.least, r.most, r.below))

    def at(i: int, place: float) -> float:
        low, high = found[i, math.floor(place)], found[i, math.ceil(place)]
        return low if low == high else low + (high - low) * (place - math.floor(place))

    return spark.createDataFrame([(c, [at(i, x) for x in places[i]] if i in places else None) for i, c in enumerate(names)], schema)


def frequencies(df: DataFrame) -> DataFrame:
    """(column, value, n): how often each present value occurs, of all columns in one shuffle with partial counts."""
    cells = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), _exact(df, c).alias("value")) for c in _profiled(df)))).alias("x")).select("x.*")
    return cells.where("value is not null").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def value_stats(df: DataFrame) -> DataFrame:
    """(column, unique_count, non_null, most_common): a row for each column, with or without values; ties of the most common go to the smaller value."""
    parts = max(PARTS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    ranked = frequencies(df).withColumn("salt", F.pmod(F.xxhash64("value"), F.lit(parts)))
    # First the best of each part of a column's values, then the best of those: no column meets in one task.
    rank = F.row_number().over(Window.partitionBy("column", "salt").orderBy(F.desc("n"), "value"))
    few = F.collect_list(F.when(F.col("rank") <= COMMON, F.struct((-F.col("n")).alias("m"), "value"))).alias("few")
    parts = ranked.withColumn("rank", rank).groupBy("column", "salt").agg(F.count(F.lit(1)).alias("u"), F.sum("n").alias("s"), few)
    empty = F.array().cast("array<struct<m:bigint,value:string>>").alias("few")
    none = df.sparkSession.range(0, 1, 1, 1).select(F.explode(F.array(*map(F.lit, _profiled(df)))).alias("column"), F.lit(0).alias("salt"), F.lit(0).alias("u"), F.lit(0).alias("s"), empty)
    merged = parts.unionByName(none).groupBy("column").agg(F.sum("u").alias("unique_count"), F.sum("s").alias("non_null"), F.flatten(F.collect_list("few")).alias("few"))
    return merged.select("column", "unique_count", "non_null", F.transform(F.slice(F.array_sort("few"), 1, COMMON), lambda x: F.struct(x["value"].alias("value"), (-x["m"]).alias("count"))).alias("most_common"))


def anomalies(df: DataFrame, column: str, zscore: float = 3.0) -> DataFrame:
    """(n, beyond, anomaly_score): rows further than zscore deviations from the mean; 0 below three values or spread."""
    value = present(df, column).cast("double")
    stats = df.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    far = (F.abs(value - F.col("mean")) > F.col("std") * zscore) & (F.col("n") >= 3) & (F.col("std") > 0)
    return df.crossJoin(F.broadcast(stats)).agg(F.max("n").alias("n"), F.coalesce(F.sum(F.when(far, 1).otherwise(0)), F.lit(0)).alias("beyond")).select("n", "beyond", F.coalesce(F.try_divide("beyond", "n"), F.lit(0.0)).alias("anomaly_score"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """(duplicate_rows): rows less distinct rows, nulls being equal. Values without an order are compared as JSON."""
    plain = [F.to_json(F.struct(quoted(c))).alias(c) if isinstance(kind(df, c), (T.MapType, T.VariantType)) else quoted(c) for c in df.columns]
    groups = df.select(*plain).groupBy(*map(quoted, df.columns)).agg(F.count(F.lit(1)).alias("__n"))
    return groups.agg(F.coalesce(F.sum("__n") - F.count(F.lit(1)), F.lit(0)).alias("duplicate_rows"))


class DataProfiler:
    def __init__(self, sample_size: int = 5, anomaly_zscore: float = 3.0) -> None:
        self.sample_size, self.anomaly_zscore = sample_size, anomaly_zscore

    def __repr__(self) -> str:
        return f"DataProfiler(sample_size={self.sample_size})"

    def profile(self, df: DataFrame, dataset_name: str = "unnamed", order_by: str | None = None) -> dict[str, Any]:
        """The report as a dict. Samples follow ``order_by`` if it is given, else whatever order the scan has."""
        stats = basic_stats(df).first()
        rows = stats["rows"]
        values = {r["column"]: r for r in value_stats(df).collect()} if _profiled(df) else {}
        numeric = [(i, c) for i, c in enumerate(df.columns) if is_number(kind(df, c)) and (stats[f"std_{i}"] or 0) > 0 and rows - stats[f"null_{i}"] >= 3]
        points = {r["column"]: r["percentiles"] for r in percentiles(df).collect()}
        far = df.agg(*(F.sum((F.abs(present(df, c).cast("double") - F.lit(stats[f"mean_{i}"])) / F.lit(stats[f"std_{i}"]) > self.anomaly_zscore).cast("int")).alias(f"far_{i}") for i, c in numeric)).first() if numeric else None
        samples = self._samples(df, order_by) if rows else {}
        columns = []
        for i, c in enumerate(df.columns):
            got = lambda what: stats[f"{what}_{i}"] if f"{what}_{i}" in stats else None  # noqa: B023, E731
            nulls, own = stats[f"null_{i}"], values.get(c)
            unique = own["unique_count"] if own else 0
            pct = dict(zip(PERCENTILES, points[c], strict=True)) if points.get(c) else {}
            columns.append(
                {
                    "name": c,
                    "dtype": dtype_name(kind(df, c)),
                    "total_count": rows,
                    "null_count": nulls,
                    "completeness": rounded(1 - nulls / rows if rows else 0.0),
                    "unique_count": unique,
                    "uniqueness": rounded(unique / (rows - nulls) if rows > nulls else 0.0),
                    "most_common": [{"value": x["value"], "count": x["count"]} for x in own["most_common"]] if own else [],
                    "min_value": got("min"),
                    "max_value": got("max"),
                    "mean": rounded(got("mean")),
                    "median": rounded(pct.get("p50")),
                    "std_dev": rounded(got("std")),
                    "percentiles": rounded(pct),
                    "anomaly_score": rounded((far[f"far_{i}"] or 0) / (rows - nulls) if far and f"far_{i}" in far else 0.0),
                    "sample_values": samples.get(c, []),
                }
            )
        plan_bytes = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) if hasattr(df, "_jdf") else None
        return {"dataset_name": dataset_name, "timestamp": now(), "row_count": rows, "column_count": len(df.columns), "columns": columns, "plan_size_bytes": plan_bytes, "duplicate_row_count": duplicate_rows(df).first()[0]}

    def _samples(self, df: DataFrame, order_by: str | None) -> dict[str, list[str]]:
        """The first present values of each column, over all rows: each takes the few that its own top-k wants."""
        place = quoted(order_by) if order_by else F.monotonically_increasing_id()
        numbered = df.select(place.alias("0place"), *(_text(df, c).alias(f"c{i}") for i, c in enumerate(_profiled(df))))
        found = {}
        for i, c in enumerate(_profiled(df)):
            own = numbered.where(F.col(f"c{i}").isNotNull())
            found[c] = [r[0] for r in (own.orderBy("0place") if order_by else own).limit(self.sample_size).select(f"c{i}").collect()]
        return found

    def detect_schema(self, df: DataFrame) -> dict[str, str]:
        return {f.name: dtype_name(f.dataType) for f in df.schema}

    def compare_schemas(self, old_schema: dict[str, str], new_schema: dict[str, str]) -> dict[str, Any]:
        """Stricter than schema evolution: any removal or change of type is incompatible."""
        both = sorted(old_schema.keys() & new_schema.keys())
        changed = [{"column": c, "old_type": old_schema[c], "new_type": new_schema[c]} for c in both if old_schema[c] != new_schema[c]]
        removed = sorted(old_schema.keys() - new_schema.keys())
        return {"added": sorted(new_schema.keys() - old_schema.keys()), "removed": removed, "type_changed": changed, "unchanged": [c for c in both if old_schema[c] == new_schema[c]], "is_compatible": not removed and not changed}
