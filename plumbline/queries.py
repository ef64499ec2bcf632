"""One query for each operator, with the same in DuckDB's SQL."""

from __future__ import annotations

import math
from collections.abc import Callable
from datetime import UTC, datetime
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.columns import bigram_similarity, masked, round_binary
from .operators import catalog, compliance, evolution, profiling, transforms
from .operators.lineage import STYLE, LineageGraph, LineageTracker, TransformationRecord
from .operators.quality import DataQualityValidator
from .plans import graphs
from .sources.tables import read
from .types import AssetStatus, AssetType, ComplianceFramework, NodeType, RuleResult, RuleSeverity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
AS_OF = datetime(2024, 1, 25, tzinfo=UTC)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rated_documents(spark: SparkSession, d: str) -> DataFrame:
    """documents with the labels that some have: the one source of nulls among the tables."""
    return read(spark, d, "documents").select("doc_id", "text", "lang").join(read(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")


RATED = "(SELECT doc_id, text, lang, quality FROM documents LEFT JOIN labels USING (doc_id))"


def rule_sql(name: str, kind: str, column: str, failing: str, table: str, severity: str = "error") -> str:
    return f"""SELECT '{name}' AS rule, '{kind}' AS rule_type, '{column}' AS "column", '{severity}' AS severity, CAST(count(*) AS BIGINT) AS total_rows,
CAST({failing} AS BIGINT) AS failing_rows, {failing} = 0 AS passed FROM {table} t"""


# Data quality


@query(rule_sql("not_null_quality", "not_null", "quality", "count(*) FILTER (quality IS NULL)", RATED))
def dq_01_not_null(spark, d):
    v = DataQualityValidator("rated")
    v.add_not_null_rule("quality")
    return v.counts(rated_documents(spark, d))


@query(rule_sql("unique_l_orderkey", "unique", "l_orderkey", "(SELECT coalesce(sum(n), 0) FROM (SELECT count(*) n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1))", "lineitem"))
def dq_02_unique(spark, d):
    v = DataQualityValidator("lineitem")
    v.add_unique_rule("l_orderkey")
    return v.counts(read(spark, d, "lineitem"))


@query(rule_sql("unique_quality", "unique", "quality", f"(SELECT coalesce(sum(n), 0) FROM (SELECT count(*) n FROM {RATED} GROUP BY quality HAVING count(*) > 1))", RATED))
def dq_02_unique_nulls(spark, d):
    v = DataQualityValidator("rated")
    v.add_unique_rule("quality")
    return v.counts(rated_documents(spark, d))


@query(rule_sql("range_c_acctbal", "range_check", "c_acctbal", "count(*) FILTER (c_acctbal < 0 OR c_acctbal > 9000)", "customer"))
def dq_03_range(spark, d):
    v = DataQualityValidator("customer")
    v.add_range_check("c_acctbal", 0, 9000)
    return v.counts(read(spark, d, "customer"))


@query(rule_sql("range_size", "range_check", "size", r"count(*) FILTER (size IS NULL OR NOT regexp_matches(size, '^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$') OR TRY_CAST(size AS DOUBLE) > 40)", "(SELECT CASE WHEN p_size % 7 = 0 THEN p_brand ELSE CAST(p_size AS VARCHAR) END AS size FROM part)"))
def dq_03_range_text(spark, d):
    v = DataQualityValidator("part")
    v.add_range_check("size", None, 40)
    return v.counts(read(spark, d, "part").select(F.when(F.col("p_size") % 7 == 0, F.col("p_brand")).otherwise(F.col("p_size").cast("string")).alias("size")))


@query(rule_sql("regex_c_name", "regex_match", "c_name", r"count(*) FILTER (NOT regexp_matches(coalesce(c_name, 'None'), '\A(?:Customer#\d{9}$)'))", "customer"))
def dq_04_regex(spark, d):
    v = DataQualityValidator("customer")
    v.add_regex_rule("c_name", r"Customer#\d{9}$")
    return v.counts(read(spark, d, "customer"))


@query(rule_sql("regex_quality", "regex_match", "quality", r"count(*) FILTER (NOT regexp_matches(coalesce(CAST(quality AS VARCHAR), 'nan'), '\A(?:[01])'))", RATED))
def dq_04_regex_nulls(spark, d):
    v = DataQualityValidator("rated")
    v.add_regex_rule("quality", "[01]")
    return v.counts(rated_documents(spark, d))


@query(rule_sql("ref_integrity_o_orderpriority", "referential_integrity", "o_orderpriority", "count(*) FILTER (o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW'))", "orders"))
def dq_05_referential(spark, d):
    v = DataQualityValidator("orders")
    v.add_referential_integrity_rule("o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"])
    return v.counts(read(spark, d, "orders"))


@query(rule_sql("ref_integrity_l_partkey", "referential_integrity", "l_partkey", "count(*) FILTER (l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5))", "lineitem"))
def dq_05_referential_table(spark, d):
    v = DataQualityValidator("lineitem")
    v.add_referential_integrity_rule("l_partkey", read(spark, d, "part").where("p_size > 5").select("p_partkey"))
    return v.counts(read(spark, d, "lineitem"))


def results(spark: SparkSession, report) -> DataFrame:
    rows = [(r["rule_name"], r["rule_type"], r["column"], r["severity"], r["total_rows"], r["failing_rows"], r["failure_rate"], r["passed"], r["details"]) for r in report.results]
    return spark.createDataFrame(rows, "rule string, rule_type string, column string, severity string, total_rows long, failing_rows long, failure_rate double, passed boolean, details string")


@query("""SELECT 'discounted' AS rule, 'custom' AS rule_type, 'l_discount' AS "column", 'warning' AS severity, count(*) AS total_rows, count(*) FILTER (l_discount > 0.05) AS failing_rows,
round(count(*) FILTER (l_discount > 0.05) / count(*), 4) AS failure_rate, count(*) FILTER (l_discount > 0.05) = 0 AS passed, '' AS details FROM lineitem""")
def dq_06_custom(spark, d):
    def discounted(df: DataFrame) -> RuleResult:
        total, bad = df.agg(F.count(F.lit(1)), F.count(F.when(F.col("l_discount") > 0.05, 1))).first()
        return RuleResult("discounted", "custom", "l_discount", bad == 0, "warning", total, bad, bad / total if total else 0.0)

    v = DataQualityValidator("lineitem")
    v.add_custom_rule("discounted", "l_discount", discounted, RuleSeverity.WARNING)
    return results(spark, v.validate(read(spark, d, "lineitem")))


@query("""SELECT 'not_null_absent' AS rule, 'not_null' AS rule_type, 'absent' AS "column", 'error' AS severity, count(*) AS total_rows, CAST(0 AS BIGINT) AS failing_rows, CAST(0 AS DOUBLE) AS failure_rate, false AS passed,
'Column ''absent'' not found in DataFrame' AS details FROM nation""")
def dq_07_missing_column(spark, d):
    v = DataQualityValidator("nation")
    v.add_not_null_rule("absent")
    return results(spark, v.validate(read(spark, d, "nation")))


def suite() -> DataQualityValidator:
    v = DataQualityValidator("orders")
    v.add_not_null_rule("o_custkey")
    v.add_unique_rule("o_orderkey")
    v.add_unique_rule("o_custkey", RuleSeverity.INFO)
    v.add_range_check("o_totalprice", 0, 300000, RuleSeverity.WARNING)
    v.add_regex_rule("o_orderpriority", r"\d-[A-Z ]+$")
    v.add_referential_integrity_rule("o_orderstatus", ["F", "O"])
    return v


SUITE_SQL = " UNION ALL ".join(
    (
        rule_sql("not_null_o_custkey", "not_null", "o_custkey", "count(*) FILTER (o_custkey IS NULL)", "orders"),
        rule_sql("unique_o_orderkey", "unique", "o_orderkey", "(SELECT coalesce(sum(n), 0) FROM (SELECT count(*) n FROM orders GROUP BY o_orderkey HAVING count(*) > 1))", "orders"),
        rule_sql("unique_o_custkey", "unique", "o_custkey", "(SELECT coalesce(sum(n), 0) FROM (SELECT count(*) n FROM orders GROUP BY o_custkey HAVING count(*) > 1))", "orders", "info"),
        rule_sql("range_o_totalprice", "range_check", "o_totalprice", "count(*) FILTER (NOT o_totalprice BETWEEN 0 AND 300000)", "orders", "warning"),
        rule_sql("regex_o_orderpriority", "regex_match", "o_orderpriority", r"count(*) FILTER (NOT regexp_matches(o_orderpriority, '\A(?:\d-[A-Z ]+$)'))", "orders"),
        rule_sql("ref_integrity_o_orderstatus", "referential_integrity", "o_orderstatus", "count(*) FILTER (o_orderstatus NOT IN ('F', 'O'))", "orders"),
    )
)


@query(SUITE_SQL)
def dq_08_suite(spark, d):
    return suite().counts(read(spark, d, "orders"))


@query(f"""SELECT count(*) AS total_rules, count(*) FILTER (passed) AS passed_rules, count(*) FILTER (NOT passed AND severity = 'error') AS failed_rules,
count(*) FILTER (NOT passed AND severity = 'warning') AS warning_rules, count(*) FILTER (NOT passed AND severity = 'error') = 0 AS overall_pass, round(100.0 * count(*) FILTER (passed) / count(*), 2) AS quality_score FROM ({SUITE_SQL})""")
def dq_09_report(spark, d):
    broken = lambda s: F.count(F.when(~F.col("passed") & (F.col("severity") == s), 1))
    good = F.count(F.when(F.col("passed"), 1))
    return suite().counts(read(spark, d, "orders")).agg(F.count(F.lit(1)).alias("total_rules"), good.alias("passed_rules"), broken("error").alias("failed_rules"), broken("warning").alias("warning_rules"), (broken("error") == 0).alias("overall_pass"), F.round(100 * good / F.count(F.lit(1)), 2).alias("quality_score"))


@query(f"SELECT rule, round(failing_rows / total_rows, 4) AS failure_rate FROM ({SUITE_SQL})")
def dq_10_serialise(spark, d):
    return results(spark, suite().validate(read(spark, d, "orders"))).select("rule", "failure_rate")


@query(f'SELECT rule, rule_type, "column", severity FROM ({SUITE_SQL})')
def dq_11_rules(spark, d):
    v = suite()
    rows = [(r["name"], r["rule_type"], r["column"], r["severity"]) for r in v.rules]
    v.clear_rules()
    return spark.createDataFrame(rows if not v.rules else [], "rule string, rule_type string, column string, severity string")


# Profiles


@query("SELECT count(*) AS row_count, CAST(6 AS BIGINT) AS column_count FROM events")
def pf_01_dataset(spark, d):
    p = profiling.DataProfiler().profile(read(spark, d, "events"), "events")
    return spark.createDataFrame([(p["row_count"], p["column_count"])], "row_count long, column_count long")


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS null_count, round(count({c}) / count(*), 4) AS completeness FROM {RATED}" for c in ("doc_id", "text", "lang", "quality")))
def pf_02_completeness(spark, d):
    df = rated_documents(spark, d)
    one = profiling.basic_stats(df)
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"null_{i}").alias("null_count"), F.round(1 - F.try_divide(f"null_{i}", "rows"), 4).alias("completeness")) for i, c in enumerate(df.columns)))
    return one.select(F.explode(cells).alias("x")).select("x.*")


LINEITEM = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS unique_count, round(count(DISTINCT {c}) / count({c}), 4) AS uniqueness FROM lineitem" for c in LINEITEM))
def pf_03_distinct(spark, d):
    share = F.when(F.col("non_null") > 0, F.col("unique_count") / F.col("non_null")).otherwise(F.lit(math.nan))
    return profiling.value_stats(read(spark, d, "lineitem")).select("column", "unique_count", round_binary(share, 4).alias("uniqueness"))


@query("SELECT p_brand AS value, count(*) AS \"count\" FROM part GROUP BY p_brand ORDER BY count(*) DESC, p_brand LIMIT 5")
def pf_04_most_common(spark, d):
    return profiling.value_stats(read(spark, d, "part").select("p_brand")).select(F.explode("most_common").alias("x")).select("x.*")


@query("SELECT c_name AS value FROM customer ORDER BY c_custkey LIMIT 5")
def pf_05_sample_values(spark, d):
    p = profiling.DataProfiler().profile(read(spark, d, "customer"), "customer", order_by="c_custkey")
    return spark.createDataFrame([(v,) for c in p["columns"] if c["name"] == "c_name" for v in c["sample_values"]], "value string")


NUMERIC = LINEITEM[:8]


def numeric_stats(spark, d, *fields) -> DataFrame:
    df = read(spark, d, "lineitem").select(*NUMERIC)
    return profiling.basic_stats(df).select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), *(f(i) for f in fields)) for i, c in enumerate(NUMERIC)))).alias("x")).select("x.*")


def numeric_sql(what: str) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {what.replace('$', c)} FROM lineitem" for c in NUMERIC)


@query(numeric_sql("min($) AS min_value, max($) AS max_value, round(avg($), 4) AS mean"))
def pf_06_min_max_mean(spark, d):
    return numeric_stats(spark, d, lambda i: F.col(f"min_{i}").alias("min_value"), lambda i: F.col(f"max_{i}").alias("max_value"), lambda i: F.round(f"mean_{i}", 4).alias("mean"))


@query(numeric_sql("round(quantile_cont($, 0.5), 4) AS median"))
def pf_07_median(spark, d):
    return profiling.percentiles(read(spark, d, "lineitem").select(*NUMERIC)).select("column", F.round(F.col("percentiles")[1], 4).alias("median"))


@query(numeric_sql("round(stddev_samp($), 4) AS std_dev"))
def pf_08_std_dev(spark, d):
    return numeric_stats(spark, d, lambda i: F.round(f"std_{i}", 4).alias("std_dev"))


@query(numeric_sql(", ".join(f"round(quantile_cont($, {p}), 4) AS {n}" for n, p in profiling.PERCENTILES.items())))
def pf_09_percentiles(spark, d):
    points = (F.round(F.col("percentiles")[k], 4).alias(n) for k, n in enumerate(profiling.PERCENTILES))
    return profiling.percentiles(read(spark, d, "lineitem").select(*NUMERIC)).select("column", *points)


@query("""SELECT count(value) AS n, count(*) FILTER (abs(value - m) > 3 * s) AS beyond, round(count(*) FILTER (abs(value - m) > 3 * s) / count(value), 4) AS anomaly_score
FROM events, (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events)""")
def pf_10_anomaly(spark, d):
    return profiling.anomalies(read(spark, d, "events"), "value").select("n", F.col("beyond").cast("long").alias("beyond"), F.round("anomaly_score", 4).alias("anomaly_score"))


@query("SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS min_value, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS max_value FROM events")
def pf_11_datetime(spark, d):
    return profiling.basic_stats(read(spark, d, "events").select("ts")).select(F.col("min_0").alias("min_value"), F.col("max_0").alias("max_value"))


@query("SELECT CAST(min(length(text)) AS BIGINT) AS min_value, CAST(max(length(text)) AS BIGINT) AS max_value, round(avg(length(text)), 4) AS mean FROM documents")
def pf_12_text_length(spark, d):
    return profiling.basic_stats(read(spark, d, "documents").select("text")).select(F.col("min_0").cast("long").alias("min_value"), F.col("max_0").cast("long").alias("max_value"), F.round("mean_0", 4).alias("mean"))


@query(f"SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_rows FROM (SELECT count(*) AS n FROM (SELECT {', '.join(LINEITEM)} FROM lineitem UNION ALL SELECT {', '.join(LINEITEM)} FROM lineitem WHERE l_linenumber = 1) GROUP BY {', '.join(LINEITEM)})")
def pf_13_duplicate_rows(spark, d):
    df = read(spark, d, "lineitem")
    return profiling.duplicate_rows(df.unionByName(df.where("l_linenumber = 1")))


@query()
def pf_14_plan_size(spark, d):
    size = profiling.DataProfiler().profile(read(spark, d, "nation"))["plan_size_bytes"]
    return spark.createDataFrame([("nation", size)], "table string, plan_size_bytes long")


@query("""SELECT column_name AS "column", CASE column_type WHEN 'BIGINT' THEN 'int64' WHEN 'INTEGER' THEN 'int32' WHEN 'DOUBLE' THEN 'float64' WHEN 'VARCHAR' THEN 'object' ELSE 'datetime64[ns]' END AS dtype FROM (DESCRIBE orders)""")
def pf_15_schema(spark, d):
    return spark.createDataFrame(list(profiling.DataProfiler().detect_schema(read(spark, d, "orders")).items()), "column string, dtype string")


OLD, NEW = {"a": "int64", "b": "object", "c": "float64", "e": "int32"}, {"a": "int64", "b": "object", "d": "bool", "e": "int64"}


def values_sql(schema: dict[str, str]) -> str:
    return "(VALUES " + ", ".join(f"('{c}', '{t}')" for c, t in schema.items()) + ') v("column", type)'


@query(f"""SELECT "column", CASE WHEN o.type IS NULL THEN 'added' WHEN n.type IS NULL THEN 'removed' WHEN o.type <> n.type THEN 'type_changed' ELSE 'unchanged' END AS state
FROM (SELECT * FROM {values_sql(OLD)}) o FULL JOIN (SELECT * FROM {values_sql(NEW)}) n USING ("column")""")
def pf_16_compare_schemas(spark, d):
    got = profiling.DataProfiler().compare_schemas(OLD, NEW)
    rows = [(c, s) for s in ("added", "removed", "unchanged") for c in got[s]] + [(c["column"], "type_changed") for c in got["type_changed"]]
    return spark.createDataFrame(rows, "column string, state string")


CUSTOMER = {"c_custkey": "int64", "c_name": "object", "c_nationkey": "int32", "c_acctbal": "float64", "c_mktsegment": "object", "none": "float64"}


def profile_sql(column: str, dtype: str) -> str:
    """All fields of a column's profile as JSON text; "none" holds nothing but NaN and nulls."""
    table = "(SELECT *, CAST(NULL AS DOUBLE) AS none FROM customer)"
    number = dtype != "object"
    value = f"CAST({column} AS DOUBLE)" if number else f"length({column})"
    text = f"CAST({column} AS VARCHAR)"
    common = f"(SELECT list(struct_pack(value := v, \"count\" := n) ORDER BY n DESC, v) FROM (SELECT {text} AS v, count(*) AS n FROM {table} WHERE {column} IS NOT NULL GROUP BY 1 ORDER BY n DESC, v LIMIT 5))"
    far = f"(SELECT count(*) FROM {table}, (SELECT avg({value}) AS m, stddev_samp({value}) AS s FROM {table}) WHERE s > 0 AND abs({value} - m) / s > 3)" if number else "0"
    point = lambda q: f"round(quantile_cont({value}, {q}), 4)" if number else "NULL"
    return f"""SELECT '{column}' AS name, '{dtype}' AS dtype, count(*) AS total_count, count(*) - count({column}) AS null_count, round(count({column}) / count(*), 4) AS completeness,
count(DISTINCT {column}) AS unique_count, coalesce(round(count(DISTINCT {column}) / nullif(count({column}), 0), 4), 0) AS uniqueness, coalesce(array_to_string(list_transform({common}, lambda x: x."value" || '=' || x."count"), '|'), '') AS most_common,
round(CAST(min({value}) AS DOUBLE), 4) AS min_value, round(CAST(max({value}) AS DOUBLE), 4) AS max_value, round(avg({value}), 4) AS mean, {point(0.5)} AS median, {f"round(stddev_samp({value}), 4)" if number else "CAST(NULL AS DOUBLE)"} AS std_dev,
{point(0.25)} AS p25, {point(0.99)} AS p99, coalesce(round({far} / nullif(count({column}), 0), 4), 0) AS anomaly_score, coalesce((SELECT string_agg({text}, '|' ORDER BY c_custkey) FROM (SELECT * FROM {table} WHERE {column} IS NOT NULL ORDER BY c_custkey LIMIT 5)), '') AS sample_values FROM {table}"""


PROFILE_SQL = " UNION ALL ".join(profile_sql(c, t) for c, t in CUSTOMER.items())


@query(PROFILE_SQL)
def pf_17_profile(spark, d):
    df = read(spark, d, "customer").withColumn("none", F.when(F.col("c_custkey") % 2 == 0, F.lit(float("nan"))))
    number = lambda x: None if x is None else round(float(x), 4)
    rows = []
    for p in profiling.DataProfiler().profile(df, "customer", order_by="c_custkey")["columns"]:
        common = "|".join(f"{x['value']}={x['count']}" for x in p["most_common"])
        plain = [p[f] for f in ("name", "dtype", "total_count", "null_count", "completeness", "unique_count", "uniqueness")]
        rows.append((*plain, common, *map(number, (p["min_value"], p["max_value"], p["mean"], p["median"], p["std_dev"], p["percentiles"].get("p25"), p["percentiles"].get("p99"), p["anomaly_score"])), "|".join(p["sample_values"])))
    return spark.createDataFrame(rows, "name string, dtype string, total_count long, null_count long, completeness double, unique_count long, uniqueness double, most_common string, min_value double, max_value double, mean double, median double, std_dev double, p25 double, p99 double, anomaly_score double, sample_values string")


# Compliance


def findings(df: DataFrame) -> DataFrame:
    return compliance.pii_findings(df).drop("place")


@query("""SELECT 'c_name' AS "column", 'name' AS pii_type, count(c_name) AS sample_count, 'column_name_heuristic' AS detection_method, 'medium' AS risk_level FROM customer""")
def cp_01_name_hints(spark, d):
    return findings(read(spark, d, "customer")).where("detection_method = 'column_name_heuristic'")


def scan_sql(column: str, table: str) -> str:
    one = " UNION ALL ".join(f"SELECT '{t}' AS pii_type, count(*) FILTER (regexp_matches({column}, '{p}')) AS sample_count, count({column}) AS present FROM {table}" for t, p in compliance.PATTERNS.items())
    return f"""SELECT pii_type, sample_count, CASE WHEN pii_type IN ('cpf', 'credit_card', 'ssn', 'cnpj') THEN 'critical' WHEN sample_count / present > 0.5 THEN 'high' WHEN sample_count > 10 THEN 'medium' ELSE 'low' END AS risk_level FROM ({one}) WHERE sample_count > 0"""


@query(f"""SELECT 'text' AS "column", pii_type, sample_count FROM ({scan_sql("text", "documents")})""")
def cp_02_regex_scan(spark, d):
    return findings(read(spark, d, "documents").select("text")).select("column", "pii_type", "sample_count")


@query(f"""SELECT 'mail_text' AS "column", pii_type, sample_count, CASE pii_type WHEN 'email' THEN 'column_name_heuristic+regex' ELSE 'regex_pattern' END AS detection_method, risk_level FROM ({scan_sql("text", "documents")})""")
def cp_03_merge_evidence(spark, d):
    return findings(read(spark, d, "documents").select(F.col("text").alias("mail_text")))


@query(scan_sql("text", "documents"))
def cp_04_risk(spark, d):
    return findings(read(spark, d, "documents").select("text")).select("pii_type", "sample_count", "risk_level")


@query("""SELECT CASE WHEN length(o_orderpriority) > 6 THEN left(o_orderpriority, 3) || repeat('*', length(o_orderpriority) - 6) || right(o_orderpriority, 3) ELSE '***' END AS masked, count(*) AS n FROM orders GROUP BY 1""")
def cp_05_redact(spark, d):
    return read(spark, d, "orders").groupBy(masked(F.col("o_orderpriority")).alias("masked")).agg(F.count(F.lit(1)).alias("n"))


@query(rf"""SELECT left(m, 3) || repeat('*', length(m) - 6) || right(m, 3) AS sample FROM (SELECT regexp_extract(text, '{compliance.PATTERNS["ip_address"]}') AS m FROM documents) WHERE m <> '' ORDER BY m LIMIT 3""")
def cp_06_samples(spark, d):
    found = [f for f in compliance.ComplianceEngine().detect_pii(read(spark, d, "documents").select("text")) if f.pii_type == "ip_address"]
    return spark.createDataFrame([(s,) for f in found for s in f.sample_matches], "sample string")


@query("""SELECT 'ts' AS "column", CAST(20 AS BIGINT) AS max_age_days, CAST(max(age) AS BIGINT) AS oldest_record_days, count(*) FILTER (age > 20) AS records_exceeding, count(age) AS valid
FROM (SELECT floor((epoch_us(TIMESTAMP '2024-01-25') - epoch_us(ts)) / 86400000000.0) AS age FROM events)""")
def cp_07_retention(spark, d):
    return compliance.retention(read(spark, d, "events"), {"ts": 20}, AS_OF)


def report(spark, d):
    engine = compliance.ComplianceEngine(ComplianceFramework.GDPR, {"ts": 20}, AS_OF)
    return engine.run_compliance_check(read(spark, d, "events"), "events"), engine.run_compliance_check(read(spark, d, "documents").select("text"), "documents")


@query("""SELECT 'events' AS dataset, CASE WHEN count(*) FILTER (floor((epoch_us(TIMESTAMP '2024-01-25') - epoch_us(ts)) / 86400000000.0) > 20) > 0 THEN 'high' ELSE 'low' END AS risk_level FROM events
UNION ALL SELECT 'documents', CASE WHEN count(*) FILTER (risk_level = 'critical') > 0 THEN 'critical' WHEN count(*) FILTER (risk_level = 'high') > 0 THEN 'high' WHEN count(*) > 0 THEN 'medium' ELSE 'low' END FROM (""" + scan_sql("text", "documents") + ")")
def cp_08_report_risk(spark, d):
    return spark.createDataFrame([(r.dataset_name, r.risk_level) for r in report(spark, d)], "dataset string, risk_level string")


@query("SELECT 'documents' AS dataset, count(*) FILTER (risk_level = 'critical') = 0 AS overall_compliant FROM (" + scan_sql("text", "documents") + ")")
def cp_09_compliant(spark, d):
    return spark.createDataFrame([("documents", report(spark, d)[1].overall_compliant)], "dataset string, overall_compliant boolean")


@query("SELECT CAST(1 AS BIGINT) AS columns_scanned, CAST(least(count(*), 1) AS BIGINT) AS pii_columns, array_to_string(list_sort(list(pii_type)), ',') AS pii_types, CAST(0 AS BIGINT) AS violations FROM (" + scan_sql("text", "documents") + ")")
def cp_10_summary(spark, d):
    s = report(spark, d)[1].summary
    return spark.createDataFrame([(s["total_columns_scanned"], s["pii_columns_found"], ",".join(s["pii_types_found"]), s["retention_violations_count"])], "columns_scanned long, pii_columns long, pii_types string, violations long")


@query()
def cp_11_recommendations(spark, d):
    return spark.createDataFrame([(r.dataset_name, i, t) for r in report(spark, d) for i, t in enumerate(r.recommendations)], "dataset string, place int, text string")


@query("SELECT 'lineitem' AS dataset, 'l_shipdate' AS \"column\", 'ip_address' AS pii_type, count(*) AS sample_count FROM lineitem UNION ALL SELECT 'documents', 'text', pii_type, sample_count FROM (" + scan_sql("text", "documents") + ")")
def cp_12_full_check(spark, d):
    engine = compliance.ComplianceEngine(as_of=AS_OF)
    reports = [engine.run_compliance_check(read(spark, d, t), t) for t in ("lineitem", "documents")]
    return spark.createDataFrame([(r.dataset_name, f["column"], f["pii_type"], f["sample_count"]) for r in reports for f in r.pii_findings], "dataset string, column string, pii_type string, sample_count long")


# Lineage, on the hierarchy of regions, nations, customers and orders


def hierarchy(spark, d) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): every region, nation, customer and order is a node below what it belongs to."""
    level = lambda table, mark, key, kind: read(spark, d, table).select(F.concat(F.lit(mark), F.col(key)).alias("node_id"), F.lit(kind).alias("node_type"))
    below = lambda table, a, b, key, up: read(spark, d, table).select(F.concat(F.lit(a), F.col(up)).alias("source_id"), F.concat(F.lit(b), F.col(key)).alias("target_id"), F.col(key).cast("long").alias("seq"))
    nodes = level("region", "r", "r_regionkey", "external").union(level("nation", "n", "n_nationkey", "dataset")).union(level("customer", "c", "c_custkey", "feature")).union(level("orders", "o", "o_orderkey", "model")).distinct()
    edges = below("nation", "r", "n", "n_nationkey", "n_regionkey").union(below("customer", "n", "c", "c_custkey", "c_nationkey")).union(below("orders", "c", "o", "o_orderkey", "o_custkey")).distinct()
    return nodes, edges


EDGES_SQL = "edges AS (SELECT DISTINCT * FROM (SELECT 'r' || n_regionkey AS source_id, 'n' || n_nationkey AS target_id FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders))"
NODES_SQL = "nodes AS (SELECT DISTINCT * FROM (SELECT 'r' || r_regionkey AS node_id, 'external' AS node_type FROM region UNION ALL SELECT 'n' || n_nationkey, 'dataset' FROM nation UNION ALL SELECT 'c' || c_custkey, 'feature' FROM customer UNION ALL SELECT 'o' || o_orderkey, 'model' FROM orders))"


def reach_sql(start: str, most: int | None = None, reverse: bool = False) -> str:
    a, b = ("target_id", "source_id") if reverse else ("source_id", "target_id")
    return f"""WITH RECURSIVE {EDGES_SQL}, walk AS (SELECT '{start}' AS node_id, 0 AS depth UNION SELECT e.{b}, w.depth + 1 FROM walk w JOIN edges e ON e.{a} = w.node_id{f" WHERE w.depth < {most}" if most is not None else ""})
SELECT node_id, CAST(min(depth) AS INTEGER) AS depth FROM walk WHERE node_id <> '{start}' GROUP BY node_id"""


def sample_graph() -> LineageGraph:
    """A diamond with a tail, and a node on its own."""
    g = LineageGraph()
    kinds = dict(a=NodeType.DATASET, b=NodeType.TRANSFORMATION, c=NodeType.FEATURE, d=NodeType.MODEL, e=NodeType.PREDICTION, z=NodeType.EXTERNAL)
    for n, t in kinds.items():
        g.add_node(n, n.upper(), t)
    for s, t in ("ab", "ac", "bd", "cd", "de"):
        g.add_edge(s, t, f"{s}to{t}" if t != "e" else "")
    return g


GRAPH_SQL = "nodes(node_id, name, node_type, seq) AS (VALUES ('a', 'A', 'dataset', 0), ('b', 'B', 'transformation', 1), ('c', 'C', 'feature', 2), ('d', 'D', 'model', 3), ('e', 'E', 'prediction', 4), ('z', 'Z', 'external', 5)), edges(source_id, target_id, transformation) AS (VALUES ('a', 'b', 'atob'), ('a', 'c', 'atoc'), ('b', 'd', 'btod'), ('c', 'd', 'ctod'), ('d', 'e', ''))"


def ids(spark, values, name="node_id") -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


@query(f"WITH {GRAPH_SQL} SELECT node_id, CASE node_id WHEN 'a' THEN 'A2' ELSE name END AS name, (SELECT count(*) FROM edges WHERE source_id = node_id) AS n_out FROM nodes")
def lg_01_add_node(spark, d):
    g = sample_graph()
    g.add_node("a", "A2", NodeType.DATASET)
    nodes, edges = g.to_df(spark)
    return nodes.join(edges.groupBy(F.col("source_id").alias("node_id")).agg(F.count(F.lit(1)).alias("n")), "node_id", "left").select("node_id", "name", F.coalesce("n", F.lit(0)).alias("n_out"))


@query(f"WITH {GRAPH_SQL} SELECT node_id, name, node_type FROM nodes")
def lg_02_nodes(spark, d):
    return sample_graph().to_df(spark)[0].orderBy("seq").select("node_id", "name", "node_type")


@query(f"WITH {GRAPH_SQL} SELECT source_id, target_id FROM edges WHERE 'd' NOT IN (source_id, target_id)")
def lg_03_remove_node(spark, d):
    g = sample_graph()
    g.remove_node("d")
    return g.to_df(spark)[1].select("source_id", "target_id")


@query("SELECT * FROM (VALUES ('a', 'e', 'added'), ('e', 'a', 'Edge e -> a would create a cycle'), ('q', 'a', 'Source node ''q'' not found in graph'), ('a', 'q', 'Target node ''q'' not found in graph')) v(source_id, target_id, outcome)")
def lg_04_add_edge(spark, d):
    g, rows = sample_graph(), []
    for s, t in ("ae", "ea", "qa", "aq"):
        try:
            g.add_edge(s, t)
            rows.append((s, t, "added"))
        except ValueError as why:
            rows.append((s, t, str(why)))
    return spark.createDataFrame(rows, "source_id string, target_id string, outcome string")


@query(f"WITH {GRAPH_SQL} SELECT * FROM edges")
def lg_05_edges(spark, d):
    return sample_graph().to_df(spark)[1].select("source_id", "target_id", "transformation")


@query(reach_sql("r0"))
def lg_06_downstream(spark, d):
    return graphs.reach(hierarchy(spark, d)[1], "r0").select("node_id", "depth")


@query(reach_sql("r0", 2))
def lg_06_downstream_two_steps(spark, d):
    return graphs.reach(hierarchy(spark, d)[1], "r0", 2).select("node_id", "depth")


@query(reach_sql("o100", reverse=True))
def lg_07_upstream(spark, d):
    return graphs.reach(hierarchy(spark, d)[1], "o100", reverse=True).select("node_id", "depth")


@query(f"WITH {EDGES_SQL} SELECT target_id AS node_id, 'successor' AS side FROM edges WHERE source_id = 'n3' UNION ALL SELECT source_id, 'predecessor' FROM edges WHERE target_id = 'n3'")
def lg_08_direct(spark, d):
    return graphs.neighbours(hierarchy(spark, d)[1], "n3")


@query(f"WITH {EDGES_SQL}, {NODES_SQL} SELECT node_id, 'root' AS side FROM nodes WHERE node_id NOT IN (SELECT target_id FROM edges) UNION ALL SELECT node_id, 'leaf' FROM nodes WHERE node_id NOT IN (SELECT source_id FROM edges)")
def lg_09_roots_leaves(spark, d):
    return graphs.ends(*hierarchy(spark, d))


@query(f"WITH {NODES_SQL} SELECT node_id, node_type, depth FROM ({reach_sql('r1')}) JOIN nodes USING (node_id)")
def lg_10_impact(spark, d):
    nodes, edges = hierarchy(spark, d)
    return graphs.reach(edges, "r1").join(nodes, "node_id").select("node_id", "node_type", "depth")


@query(f"WITH RECURSIVE {GRAPH_SQL}, walk AS (SELECT 'a' AS node_id, 'a' AS path UNION ALL SELECT e.target_id, w.path || '>' || e.target_id FROM walk w JOIN edges e ON e.source_id = w.node_id) SELECT path FROM walk WHERE node_id NOT IN (SELECT source_id FROM edges)")
def lg_11_paths(spark, d):
    return graphs.paths(spark, sample_graph().to_df(spark)[1], "a", 100).select(F.array_join("path", ">").alias("path"))


@query(f"WITH RECURSIVE {EDGES_SQL}, {NODES_SQL}, walk AS (SELECT node_id, 0 AS depth FROM nodes WHERE node_id NOT IN (SELECT target_id FROM edges) UNION SELECT e.target_id, w.depth + 1 FROM walk w JOIN edges e ON e.source_id = w.node_id) SELECT node_id, CAST(max(depth) AS INTEGER) AS level FROM walk GROUP BY node_id")
def lg_12_topological_layers(spark, d):
    return graphs.layers(*hierarchy(spark, d))


# Shape and colour by type of node.
DOT_SQL = "styles(node_type, shape, colour) AS (VALUES " + ", ".join(f"('{t}', '{shape}', '{colour}')" for t, (shape, colour) in STYLE.items()) + ")"


@query(f"""WITH {GRAPH_SQL}, {DOT_SQL} SELECT line FROM (VALUES ('digraph DataLineage {{'), ('  rankdir=LR;'), ('  node [style=filled, fontname="Helvetica"];'), ('}}')) v(line)
UNION ALL SELECT '  "' || node_id || '" [label="' || name || '\\n[' || node_type || ']", shape=' || shape || ', fillcolor="' || colour || '", fontcolor="white"];' FROM nodes JOIN styles USING (node_type)
UNION ALL SELECT '  "' || source_id || '" -> "' || target_id || '"' || CASE WHEN transformation <> '' THEN ' [label="' || transformation || '"]' ELSE '' END || ';' FROM edges""")
def lg_13_dot(spark, d):
    return ids(spark, sample_graph().to_dot().split("\n"), "line")


@query(f"WITH {EDGES_SQL} SELECT n_name, 'r' || n_regionkey = 'r0' AS makes_cycle FROM nation")
def lg_14_cycle(spark, d):
    below = graphs.reach(hierarchy(spark, d)[1], "r0").select("node_id", F.lit(True).alias("hit"))
    return read(spark, d, "nation").select("n_name", F.concat(F.lit("n"), F.col("n_nationkey")).alias("node_id")).join(below, "node_id", "left").select("n_name", F.coalesce("hit", F.lit(False)).alias("makes_cycle"))


@query(f"WITH {EDGES_SQL}, {NODES_SQL}, types(node_type) AS (VALUES ('dataset'), ('transformation'), ('model'), ('feature'), ('prediction'), ('external')) SELECT node_type, count(node_id) AS n FROM types LEFT JOIN nodes USING (node_type) GROUP BY node_type")
def lg_15_summary(spark, d):
    return graphs.type_counts(hierarchy(spark, d)[0], [t.value for t in NodeType])


@cache
def sample_tracker() -> LineageTracker:
    t = LineageTracker()
    t.track_input("raw", "Raw")
    t.track_transformation(["raw"], "clean", "Clean", "cleaning", user="ann")
    t.track_transformation(["clean", "raw"], "feat", "Features", "engineering", NodeType.FEATURE)
    t.track_model("model", "Model", ["feat"])
    t.track_output("out", "Scores")
    t.track_transformation(["model"], "out", "Scores", "inference")
    return t


@query("SELECT * FROM (VALUES ('raw', 'dataset'), ('clean', 'transformation'), ('feat', 'feature'), ('model', 'model'), ('out', 'prediction')) v(node_id, node_type)")
def lt_01_inputs_outputs(spark, d):
    return sample_tracker().graph.to_df(spark)[0].select("node_id", "node_type")


@query("SELECT * FROM (VALUES ('raw', 'clean', 'cleaning'), ('clean', 'feat', 'engineering'), ('raw', 'feat', 'engineering'), ('feat', 'model', 'model_training'), ('model', 'out', 'inference')) v(source_id, target_id, transformation)")
def lt_02_transformations(spark, d):
    return sample_tracker().graph.to_df(spark)[1].select("source_id", "target_id", "transformation")


@query("SELECT 'model' AS target_id, 'model_training' AS transformation_name, 'Model ''Model'' trained on 1 features' AS description")
def lt_03_model(spark, d):
    return sample_tracker().log_df(spark).where("target_id = 'model'").select("target_id", "transformation_name", "description")


@query("SELECT left(sha256('[''a'', ''b'']-c-2024-01-01T00:00:00+00:00'), 16) AS record_id")
def lt_04_record_id(spark, d):
    return ids(spark, [TransformationRecord(["a", "b"], "c", timestamp="2024-01-01T00:00:00+00:00").record_id], "record_id")


@query("SELECT * FROM (VALUES ('clean', 'cleaning', 'ann'), ('feat', 'engineering', 'system'), ('model', 'model_training', 'system'), ('out', 'inference', 'system')) v(target_id, transformation_name, user_name)")
def lt_05_history(spark, d):
    return sample_tracker().log_df(spark).orderBy("seq").select("target_id", "transformation_name", F.col("user").alias("user_name"))


@query("SELECT * FROM (VALUES ('upstream', 'clean'), ('upstream', 'raw'), ('downstream', 'model'), ('downstream', 'out')) v(side, node_id)")
def lt_06_full_lineage(spark, d):
    full = sample_tracker().get_full_lineage("feat")
    return spark.createDataFrame([(s, n["node_id"]) for s in ("upstream", "downstream") for n in full[s]], "side string, node_id string")


@query("SELECT CAST(5 AS BIGINT) AS total_nodes, CAST(5 AS BIGINT) AS total_edges, CAST(4 AS BIGINT) AS total_transformations_recorded, CAST(4 AS BIGINT) AS exported")
def lt_07_exports(spark, d):
    s = sample_tracker().summary()
    exported = spark.createDataFrame([(sample_tracker().export_json(),)], "j string").select(F.size(F.from_json("j", "audit_log array<string>")["audit_log"]).cast("long").alias("exported"))
    return exported.select(*(F.lit(s[k]).cast("long").alias(k) for k in ("total_nodes", "total_edges", "total_transformations_recorded")), "exported")


@query("SELECT CAST(4 AS BIGINT) AS total_affected, 'clean,feat,model,out' AS affected")
def lt_08_impact(spark, d):
    i = sample_tracker().impact_analysis("raw")
    return spark.createDataFrame([(i["total_affected"], ",".join(sorted(i["affected_nodes"])))], "total_affected long, affected string")


# Catalog


def sample_catalog() -> catalog.MetadataCatalog:
    c = catalog.MetadataCatalog()
    c.register_dataset("ds1", "Dataset 1", "Raw sales", "team-a", ["Raw", "sales"], {"id": "int64"}, rows=10)
    c.register_model("mdl1", "Model 1", "Scores credit", "team-b", ["credit", "ml"], auc=0.9)
    c.register_feature("ft1", "Feature 1", "Income", "team-b", ["credit"])
    c.register("rep1", "Report", AssetType.REPORT, owner="")
    c.update("mdl1", tags=["credit", "ML", "v2"], metadata={"f1": 0.5})
    c.deprecate("ds1", "old")
    c.archive("rep1")
    return c


ASSETS_SQL = "assets(asset_id, name, asset_type, description, owner, tags, status, version) AS (VALUES ('ds1', 'Dataset 1', 'dataset', 'Raw sales', 'team-a', ['Raw', 'sales'], 'deprecated', 2), ('mdl1', 'Model 1', 'model', 'Scores credit', 'team-b', ['credit', 'ML', 'v2'], 'active', 2), ('ft1', 'Feature 1', 'feature', 'Income', 'team-b', ['credit'], 'active', 1), ('rep1', 'Report', 'report', '', '', [], 'archived', 2))"


def assets(spark) -> DataFrame:
    return sample_catalog().to_df(spark)[0]


@query(f"WITH {ASSETS_SQL} SELECT asset_id, name, asset_type FROM assets")
def ct_01_register(spark, d):
    return assets(spark).select("asset_id", "name", "asset_type")


@query("""SELECT * FROM (VALUES ('ds1', '{"rows": 10}'), ('mdl1', '{"auc": 0.9, "f1": 0.5}'), ('ft1', '{}'), ('rep1', '{}')) v(asset_id, metadata)""")
def ct_02_extra_metadata(spark, d):
    return assets(spark).select("asset_id", "metadata")


@query(f"WITH {ASSETS_SQL} SELECT asset_id, owner FROM assets WHERE asset_id = 'ft1'")
def ct_03_get(spark, d):
    return assets(spark).where("asset_id = 'ft1'").select("asset_id", "owner")


@query(f"WITH {ASSETS_SQL} SELECT asset_id, CAST(version AS INTEGER) AS version, status FROM assets")
def ct_04_latest_version(spark, d):
    return catalog.latest(sample_catalog().to_df(spark)[1]).select("asset_id", "version", "status")


@query(f"WITH {ASSETS_SQL} SELECT asset_id, status FROM assets WHERE status <> 'active'")
def ct_05_status(spark, d):
    return assets(spark).where(F.col("status") != AssetStatus.ACTIVE.value).select("asset_id", "status")


@query("""SELECT * FROM (VALUES ('mdl1', 1, 'Initial registration', left(md5('{"auc": 0.9}'), 12)), ('mdl1', 2, 'Updated', left(md5('{"auc": 0.9, "f1": 0.5}'), 12))) v(asset_id, version, note, metadata_hash)""")
def ct_06_history(spark, d):
    return sample_catalog().to_df(spark)[1].where("asset_id = 'mdl1'").select("asset_id", "version", "note", "metadata_hash")


@query(f"WITH {ASSETS_SQL} SELECT asset_id FROM assets WHERE lower(owner) LIKE '%team%' AND list_has_all(list_transform(tags, lambda x: lower(x)), ['credit', 'ml']) AND (lower(name) LIKE '%model%' OR lower(description) LIKE '%model%')")
def ct_07_search(spark, d):
    return assets(spark).where(catalog.matches("MODEL", ["Credit", "ml"], "TEAM")).select("asset_id")


@query(f"WITH {ASSETS_SQL} SELECT asset_id FROM assets WHERE asset_type = 'feature'")
def ct_08_by_type(spark, d):
    return assets(spark).where(catalog.matches(asset_type="feature")).select("asset_id")


@query(f"WITH {ASSETS_SQL} SELECT 'type' AS what, asset_type AS value, count(*) AS n FROM assets GROUP BY 2 UNION ALL SELECT 'status', status, count(*) FROM assets GROUP BY 2 UNION ALL SELECT DISTINCT 'owner', owner, CAST(1 AS BIGINT) FROM assets WHERE owner <> '' UNION ALL SELECT 'all', 'assets', count(*) FROM assets")
def ct_09_summary(spark, d):
    got = sample_catalog().summary()
    counted = [(what, value, n) for what, key in (("type", "by_type"), ("status", "by_status")) for value, n in got[key].items()]
    rows = [*counted, *(("owner", o, 1) for o in got["owners"]), ("all", "assets", got["total_assets"])]
    return spark.createDataFrame(rows, "what string, value string, n long")


# Schema evolution

V1 = {"id": "int64", "name": "object", "value": "float64", "customer_idx": "int32", "gone": "bool"}
V2 = {"id": "object", "name": "object", "value": "int64", "customer_id": "int32", "extra": "bool"}


@cache
def sample_evolution() -> evolution.SchemaEvolutionTracker:
    t = evolution.SchemaEvolutionTracker("sample")
    t.register_schema(V1, "first")
    t.register_schema(V2, "second")
    return t


def schema_frame(spark, schema: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(list(schema.items()), "column string, type string")


@query("SELECT * FROM (VALUES (1, 5, 0), (2, 5, 5)) v(version, column_count, n_changes)")
def ev_01_register(spark, d):
    return spark.createDataFrame([(v["version"], v["column_count"], len(v["changes"])) for v in sample_evolution().get_evolution_timeline()], "version int, column_count int, n_changes int")


SAFE_SQL = "(" + ", ".join(f"'{a}>{b}'" for a, many in evolution.PROMOTIONS.items() for b in many) + ")"
DIFF_SQL = f"""SELECT "column", change_type, old_value, new_value, CASE change_type WHEN 'column_added' THEN false WHEN 'column_removed' THEN true ELSE old_value || '>' || new_value NOT IN {SAFE_SQL} END AS breaking
FROM (SELECT "column", o.type AS old_value, n.type AS new_value, CASE WHEN o.type IS NULL THEN 'column_added' WHEN n.type IS NULL THEN 'column_removed' WHEN o.type <> n.type THEN 'type_changed' END AS change_type
FROM (SELECT * FROM {values_sql(V1)}) o FULL JOIN (SELECT * FROM {values_sql(V2)}) n USING ("column")) WHERE change_type IS NOT NULL"""


#: One old name is like one new name at least at 0.8, so the greedy choice of the operator is the join itself.
RENAMED_SQL = f"""renamed AS (SELECT o."column" AS old_name, n."column" AS new_name, o.type AS old_value, n.type AS new_value FROM (SELECT * FROM {values_sql(V1)}) o, (SELECT * FROM {values_sql(V2)}) n
WHERE o."column" NOT IN (SELECT "column" FROM {values_sql(V2)}) AND n."column" NOT IN (SELECT "column" FROM {values_sql(V1)}) AND SIMILARITY >= 0.8),
plain AS ({DIFF_SQL}), changes AS (SELECT old_name || ' -> ' || new_name AS "column", 'column_renamed' AS change_type, old_value, new_value, true AS breaking, old_name, new_name FROM renamed
UNION ALL SELECT "column", change_type, old_value, new_value, breaking, "column", "column" FROM plain WHERE NOT (change_type = 'column_removed' AND "column" IN (SELECT old_name FROM renamed)) AND NOT (change_type = 'column_added' AND "column" IN (SELECT new_name FROM renamed)))"""


def renamed_sql() -> str:
    return RENAMED_SQL.replace("SIMILARITY", SIMILARITY_SQL.replace("lower(a)", 'lower(o."column")').replace("lower(b)", 'lower(n."column")'))


def ev_02_changes(spark, d):
    return evolution.detect(schema_frame(spark, V1), schema_frame(spark, V2)).select("column", "change_type", "old_value", "new_value", "breaking")


BIGRAM = "(CASE WHEN length({0}) > 1 THEN list_distinct(list_transform(range(1, length({0})), lambda i: substring({0}, i, 2))) ELSE [{0}] END)"
SIMILARITY_SQL = "round(len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))), 4)".format(a=BIGRAM.format("lower(a)"), b=BIGRAM.format("lower(b)"))


@query(f"SELECT n1.n_name AS a, n2.n_name AS b, {SIMILARITY_SQL.replace('lower(a)', 'lower(n1.n_name)').replace('lower(b)', 'lower(n2.n_name)')} AS similarity FROM nation n1 JOIN nation n2 ON n1.n_regionkey = n2.n_regionkey")
def ev_03_similarity(spark, d):
    n = read(spark, d, "nation")
    return n.select(F.col("n_name").alias("a"), "n_regionkey").join(n.select(F.col("n_name").alias("b"), "n_regionkey"), "n_regionkey").select("a", "b", F.round(bigram_similarity(F.col("a"), F.col("b")), 4).alias("similarity"))


query(f'WITH {renamed_sql()} SELECT "column", change_type, old_value, new_value, breaking FROM changes')(ev_02_changes)


@query("SELECT 'customer_idx' AS old, 'customer_id' AS new, 0.9091 AS similarity".replace("0.9091", "CAST(0.9091 AS DOUBLE)"))
def ev_04_renames(spark, d):
    gone, come = ({c: "" for c in x.keys() - y.keys()} for x, y in ((V1, V2), (V2, V1)))
    return evolution.rename_candidates(schema_frame(spark, gone), schema_frame(spark, come)).select("old", "new", F.round("similarity", 4).alias("similarity"))


TYPES = ("int8", "int16", "int32", "int64", "float32", "float64", "bool", "object")
TYPES_SQL = "(VALUES " + ", ".join(f"('{t}')" for t in TYPES) + ")"


@query(f"SELECT a.t AS old, b.t AS new, a.t || '>' || b.t IN {SAFE_SQL} AS safe FROM {TYPES_SQL} a(t), {TYPES_SQL} b(t)")
def ev_05_promotions(spark, d):
    types = ids(spark, TYPES, "old")
    return types.select("old", F.explode(F.array(*map(F.lit, TYPES))).alias("new")).withColumn("safe", evolution.is_safe(F.col("old"), F.col("new")))


@query(f"""SELECT mode, change_type, unsafe, CASE change_type WHEN 'type_changed' THEN unsafe AND mode <> 'none' WHEN 'column_added' THEN mode IN ('forward', 'full') ELSE mode IN ('backward', 'full') END AS breaks
FROM (VALUES ('none'), ('backward'), ('forward'), ('full')) m(mode), (VALUES ('column_added'), ('column_removed'), ('column_renamed'), ('type_changed')) c(change_type), (VALUES (true), (false)) u(unsafe)""")
def ev_06_compatibility(spark, d):
    modes = ids(spark, evolution.BREAKS, "mode").select("mode", F.explode(F.array(*map(F.lit, ("column_added", "column_removed", "column_renamed", "type_changed")))).alias("change_type"), F.lit(True).alias("x"))
    both = modes.select("mode", "change_type", F.explode(F.array(F.lit(True), F.lit(False))).alias("unsafe"))
    return both.withColumn("breaks", evolution.breaks(F.col("mode"), F.col("change_type"), F.col("unsafe")))


@query(f"""WITH {renamed_sql()} SELECT CASE change_type WHEN 'column_renamed' THEN 'ALTER TABLE RENAME COLUMN "' || old_name || '" TO "' || new_name || '";' WHEN 'column_added' THEN 'ALTER TABLE ADD COLUMN "' || "column" || '" ' || new_value || ' DEFAULT NULL;' WHEN 'column_removed' THEN '-- WARNING: dropping column "' || "column" || '" is destructive.' || chr(10) || 'ALTER TABLE DROP COLUMN "' || "column" || '";'
ELSE 'ALTER TABLE ALTER COLUMN "' || "column" || '" TYPE ' || new_value || ';  -- was ' || old_value END AS statement FROM changes""")
def ev_07_migrations(spark, d):
    renamed = F.col("change_type") == "column_renamed"
    found = evolution.detect(schema_frame(spark, V1), schema_frame(spark, V2))
    statement = evolution.migration(F.col("change_type"), F.col("column"), F.when(renamed, F.col("old_name")).otherwise(F.col("old_value")), F.when(renamed, F.col("new_name")).otherwise(F.col("new_value")))
    return found.select(statement.alias("statement"))


@query("SELECT CAST(version AS INTEGER) AS version, \"column\", type FROM (SELECT 1 AS version, * FROM " + values_sql(V1) + " UNION ALL SELECT 2, * FROM " + values_sql(V2) + ")")
def ev_08_timeline(spark, d):
    return sample_evolution().to_df(spark)


# Steps


@query(f"SELECT coalesce(quality, -1) AS quality, count(*) AS n FROM {RATED} GROUP BY 1")
def tr_02_impute(spark, d):
    return transforms.impute(rated_documents(spark, d), "quality", -1).groupBy("quality").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT sum(CASE WHEN c_acctbal < 0 THEN 0 WHEN c_acctbal > 5000 THEN 5000 ELSE c_acctbal END)::DECIMAL(38, 2)::DOUBLE AS total, count(*) AS n, (SELECT count(CASE WHEN quality > 0 THEN 0 ELSE quality END) FROM {RATED}) AS kept FROM customer")
def tr_03_clip(spark, d):
    kept = rated_documents(spark, d).agg(F.count(transforms.clip(F.col("quality"), None, 0)).alias("kept"))
    return read(spark, d, "customer").agg(F.round(F.sum(transforms.clip(F.col("c_acctbal"), 0.0, 5000.0)), 2).alias("total"), F.count(F.lit(1)).alias("n")).crossJoin(kept)  # one row each


@query("SELECT c_custkey, c_acctbal FROM customer")
def tr_04_project(spark, d):
    return read(spark, d, "customer").select("c_custkey", "c_acctbal")


@query("SELECT round(sum(ln(1 + abs(c_acctbal))), 4) AS total FROM customer")
def tr_05_log1p(spark, d):
    return read(spark, d, "customer").agg(F.round(F.sum(transforms.log1p(F.abs("c_acctbal"))), 4).alias("total"))


@query("SELECT CASE WHEN v > 0 AND v <= 25 THEN '18-25' WHEN v > 25 AND v <= 35 THEN '26-35' WHEN v > 35 AND v <= 50 THEN '36-50' WHEN v > 50 AND v <= 65 THEN '51-65' WHEN v > 65 AND v <= 100 THEN '66+' END AS band, count(*) AS n FROM (SELECT p_size * 2 - 2 AS v FROM part UNION ALL SELECT p_size * 3 FROM part) GROUP BY 1")
def tr_06_bucket(spark, d):
    part = read(spark, d, "part")
    return part.select((F.col("p_size") * 2 - 2).alias("v")).union(part.select(F.col("p_size") * 3)).groupBy(transforms.bucket(F.col("v")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT CASE WHEN quality < 1 THEN 'high' ELSE 'low' END AS risk, count(*) AS n FROM {RATED} GROUP BY 1")
def tr_07_conditional(spark, d):
    return rated_documents(spark, d).groupBy(transforms.either(F.col("quality") < 1, "high", "low").alias("risk")).agg(F.count(F.lit(1)).alias("n"))
