"""Exact results on small frames, and every query against its SQL on the smallest tables."""

import glob
import math
import os
import random
from datetime import UTC, datetime

import pytest

from plumbline import queries
from plumbline.operators.catalog import MetadataCatalog
from plumbline.operators.compliance import ComplianceEngine
from plumbline.operators.evolution import SchemaEvolutionTracker
from plumbline.operators.lineage import LineageTracker
from plumbline.operators.profiling import PERCENTILES, DataProfiler, percentiles
from plumbline.operators.quality import DataQualityValidator
from plumbline.types import CompatibilityMode, NodeType, RuleSeverity

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def people(spark):
    rows = [(1, "Alice", 25, "alice@example.com", "active"), (2, "Bob", 30, "bob@example.com", "active"), (3, None, -5, "bad-email", "inactive"), (4, "Diana", 45, "diana@example.com", "active"), (5, "Eve", 200, "eve@example.com", "unknown")]
    return spark.createDataFrame(rows, "id long, name string, age long, email string, status string")


def test_suite(people):
    v = DataQualityValidator("people", row_id="id")
    v.add_not_null_rule("name", RuleSeverity.WARNING)
    v.add_unique_rule("id")
    v.add_range_check("age", 0, 120)
    v.add_regex_rule("email", r"[^@]+@[^@]+\.[a-z]+$")
    v.add_referential_integrity_rule("status", ["active", "inactive"])
    v.add_not_null_rule("absent", RuleSeverity.INFO)
    r = v.validate(people)
    assert [x["failing_rows"] for x in r.results] == [1, 0, 2, 1, 1, 0]
    assert [x["sample_failures"] for x in r.results[:5]] == [[3], [], [-5.0, 200.0], ["bad-email"], ["unknown"]]
    assert (r.failed_rules, r.warning_rules, r.overall_pass, r.to_dict()["quality_score"]) == (3, 1, False, 16.67)


def test_edges(spark):
    empty = spark.createDataFrame([], "a double, m map<string,int>")
    v = DataQualityValidator()
    assert v.validate(empty).quality_score == 100
    v.add_not_null_rule("a")
    v.add_range_check("a", 0)
    v.add_unique_rule("a")
    assert v.validate(empty).overall_pass
    odd = spark.createDataFrame([(math.nan,), (None,), (math.inf,)], "a double")
    assert [x["failing_rows"] for x in v.validate(odd).results] == [2, 2, 0]
    assert DataProfiler().profile(empty)["row_count"] == 0


def test_profile(spark):
    df = spark.createDataFrame([(1, 10.0, "a"), (2, 20.0, "b"), (3, 30.0, "a"), (4, math.nan, "c"), (5, 50.0, "b")], "id long, value double, category string")
    p = DataProfiler().profile(df, order_by="id")
    value, category = p["columns"][1], p["columns"][2]
    assert (value["completeness"], value["unique_count"], value["mean"], value["median"], value["std_dev"]) == (0.8, 4, 27.5, 25.0, 17.0783)
    assert value["percentiles"] == {"p25": 17.5, "p50": 25.0, "p75": 35.0, "p95": 47.0, "p99": 49.4}
    assert category["most_common"][:2] == [{"value": "a", "count": 2}, {"value": "b", "count": 2}] and category["uniqueness"] == 0.6
    assert p["duplicate_row_count"] == 0 and DataProfiler().detect_schema(df)["category"] == "object"


def test_percentiles_by_sorting(spark):
    inf = math.inf
    rnd = random.Random(5)
    columns = {
        "cents": [round(rnd.uniform(0, 1e5), 2) for _ in range(3000)],
        "hot": [7.0] * 2900 + [rnd.gauss(0, 1e-9) for _ in range(100)],
        "wide": [rnd.choice((-1, 1)) * 10.0 ** rnd.uniform(-20, 20) for _ in range(3000)],
        "ends": [rnd.choice((-inf, -1.5, 0.0, 5e-324, 1e-323, 2.0, inf)) for _ in range(3000)],
        "gaps": [rnd.choice((None, math.nan, 1.0, 2.0)) for _ in range(3000)],
        "none": [None] * 3000,
    }
    df = spark.createDataFrame(list(zip(*columns.values(), strict=True)), ", ".join(f"{c} double" for c in columns)).repartition(5)
    got = {r["column"]: r["percentiles"] for r in percentiles(df).collect()}
    for c, values in columns.items():
        own = sorted(v for v in values if v is not None and not math.isnan(v))
        want = []
        for p in PERCENTILES.values() if own else ():
            low, part = divmod(p * (len(own) - 1), 1)
            a, b = own[int(low)], own[math.ceil(p * (len(own) - 1))]
            want.append(a if a == b else a + (b - a) * part)
        assert got[c] == (want or None), c
    assert percentiles(df.limit(0)).where("percentiles is not null").isEmpty() and percentiles(df.select()).isEmpty()


def distinct_both(spark, folder, rows):
    """pf_03 and its SQL over a lineitem of these rows, given as a DuckDB query."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"COPY ({rows}) TO '{folder}/lineitem.parquet'")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/lineitem.parquet'")
    frame = queries.QUERIES["pf_03_distinct"](spark, str(folder)).select("column", "unique_count", "uniqueness")
    got, want = (sorted((c, n, str(share)) for c, n, share in x) for x in (frame.collect(), con.execute(queries.ORACLES["pf_03_distinct"]).fetchall()))
    assert len(want) == len(queries.LINEITEM)
    return got, want


LINES = """CAST(i AS BIGINT) AS l_orderkey, CAST(i % 11 AS BIGINT) AS l_partkey, CAST(i % 13 AS BIGINT) AS l_suppkey, CAST(i % 5 AS INTEGER) AS l_linenumber, CAST(i % 29 AS DOUBLE) AS l_quantity,
CAST(i % 31 AS DOUBLE) AS l_extendedprice, CAST(i % 7 AS DOUBLE) AS l_discount, CAST(i % 3 AS DOUBLE) AS l_tax, CAST(i % 2 AS VARCHAR) AS l_returnflag, 'x' AS l_linestatus, TIMESTAMP '2020-01-01' + to_days(CAST(i % 19 AS INTEGER)) AS l_shipdate"""


def test_shares_round_as_in_sql(spark, tmp_path):
    # Odd numbers of values over 20,000 rows: their shares lie halfway between fourth digits, as doubles just below or above.
    got, want = distinct_both(spark, tmp_path, f"SELECT {LINES} FROM range(20000) r(i)")
    assert got == want and ("l_tax", 3, "0.0001") in got and ("l_linenumber", 5, "0.0003") in got


@pytest.mark.parametrize("rows", (60, 0))
def test_distinct_of_odd_columns(spark, tmp_path, rows):
    # Both zeros, moments within a second, a column without values; then no row at all.
    odd = "* EXCLUDE (i) REPLACE (CASE WHEN i % 3 = 0 THEN 0.0 WHEN i % 3 = 1 THEN '-0.0'::DOUBLE ELSE 0.5 END AS l_tax, l_shipdate + to_microseconds(i) AS l_shipdate, CAST(NULL AS VARCHAR) AS l_linestatus)"
    got, want = distinct_both(spark, tmp_path, f"SELECT {odd} FROM (SELECT i, {LINES} FROM range({rows}) r(i))")
    assert got == want and ("l_linestatus", 0, "nan") in got
    assert [n for c, n, _ in got if c in ("l_tax", "l_shipdate")] == ([60, 2] if rows else [0, 0])


def test_compliance(spark):
    rows = [("Alice Silva", "alice@example.com", "123.456.789-01", "(11) 91234-5678", "Regular", "2020-01-01"), ("Bob Santos", "bob@test.org", "987.654.321-00", "(21) 98765-4321", "VIP", "bad")]
    df = spark.createDataFrame(rows, "customer_name string, email string, cpf string, phone string, notes string, since string")
    r = ComplianceEngine(retention_policies={"since": 30}, as_of=datetime(2020, 3, 1, tzinfo=UTC)).run_compliance_check(df)
    got = [(f["column"], f["pii_type"], f["detection_method"], f["risk_level"], f["sample_count"]) for f in r.pii_findings]
    both = "column_name_heuristic+regex"
    assert got == [("customer_name", "name", "column_name_heuristic", "medium", 2), ("email", "email", both, "high", 2), ("cpf", "cpf", both, "critical", 2), ("phone", "phone_br", both, "high", 2), ("phone", "phone_intl", "column_name_heuristic", "medium", 2)]
    assert r.risk_level == "critical" and not r.overall_compliant and r.retention_violations[0]["oldest_record_days"] == 60


def test_lineage_is_atomic():
    t = LineageTracker()
    t.track_input("a", "A")
    t.track_transformation(["a"], "b", "B", "step")
    with pytest.raises(ValueError):
        t.track_transformation(["a", "nobody"], "c", "C", "step")
    with pytest.raises(ValueError):
        t.track_transformation(["b"], "a", "A", "back")
    assert "c" not in t.graph and len(t.get_transformation_history()) == 1
    g = queries.sample_graph()
    assert g.get_downstream("a") == ["b", "c", "d", "e"] and g.get_downstream("a", 1) == ["b", "c"] and g.get_upstream("nobody") == []
    assert g.topological_sort() == ["a", "z", "b", "c", "d", "e"] and g.get_leaves() == ["e", "z"] and len(g.paths_to_leaves("a")) == 2
    assert g.remove_node("d") and not g.remove_node("d") and g.get_leaves() == ["b", "c", "e", "z"]
    g.add_node("q", "Q", NodeType.MODEL)
    assert g.summary()["node_types"]["model"] == 1


def test_catalog():
    c = MetadataCatalog()
    c.register_dataset("d", "Data", owner="Team", tags=["Raw"], rows=1)
    with pytest.raises(ValueError):
        c.register_dataset("d", "Data")
    c.update("d")
    assert c.deprecate("d").version == 3 and len(c.get_version_history("d")) == 3
    assert c.search("dat", ["raw"], "tea") and not c.search(tags=["other"])


def test_evolution():
    t = SchemaEvolutionTracker("x")
    t.register_schema({"id": "int64", "name": "object", "value": "float64"})
    assert t.check_compatibility({"id": "int64", "name": "object", "value": "float64", "extra": "bool"}).compatible
    assert not t.check_compatibility({"id": "int64", "value": "float64"}).compatible
    assert not t.check_compatibility({"id": "int64", "name": "object", "extra": "bool"}, CompatibilityMode.FULL).compatible
    assert t.suggest_migrations({"id": "int64", "name": "object", "value": "float64"}) == ["No migrations needed; schemas are identical."]


def plain(value):
    return round(value, 6) if isinstance(value, float) else value if isinstance(value, (int, bool, type(None))) else str(value)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_queries_agree_with_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    for name, sql in queries.ORACLES.items():
        df = queries.QUERIES[name](spark, DATA)
        columns = sorted(df.columns)
        mine = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
        cursor = con.execute(sql)
        names = [d[0] for d in cursor.description]
        assert sorted(names) == columns, name
        assert mine == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr), name
