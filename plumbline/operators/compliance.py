"""Personal data and retention."""

from __future__ import annotations

from datetime import UTC, datetime
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import age_days, is_time, kind, masked, missing, quoted
from ..types import ComplianceFramework, ComplianceReport, PIIFinding, RetentionViolation, RiskLevel, now

# Shapes of personal data, in the order of findings.
PATTERNS = {
    "email": r"(?i)[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}",
    "cpf": r"\b\d{3}\.?\d{3}\.?\d{3}-?\d{2}\b",
    "cnpj": r"\b\d{2}\.?\d{3}\.?\d{3}/?\d{4}-?\d{2}\b",
    "phone_br": r"\(?\d{2}\)?\s?\d{4,5}-?\d{4}",
    "phone_intl": r"\+\d{1,3}[\s\-]?\d{6,14}",
    "credit_card": r"\b(?:\d[ \-]*?){13,19}\b",
    "ip_address": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
}
# Parts of column names that hint at personal data.
HINTS = {
    "email": ("email", "e_mail", "e-mail", "correo", "mail"),
    "cpf": ("cpf", "documento", "tax_id"),
    "phone_br": ("telefone", "phone", "celular", "tel"),
    "phone_intl": ("phone", "mobile", "tel"),
    "credit_card": ("card", "cartao", "credit", "cc_number"),
    "name": ("nome", "name", "full_name", "first_name", "last_name", "sobrenome"),
    "date_of_birth": ("nascimento", "birth", "dob", "data_nascimento", "birthdate"),
    "ip_address": ("ip", "ip_address", "ip_addr"),
    "ssn": ("ssn", "social_security"),
}
CRITICAL = ("cpf", "credit_card", "ssn", "cnpj")
# Advice by type, in order; phones share one line.
ADVICE = (
    (("email",), "Encrypt or hash email addresses at rest. Implement access controls for columns containing emails."),
    (("cpf",), "CPF data requires encryption and strict access logging per LGPD Art. 46. Consider tokenization for analytics workloads."),
    (("credit_card",), "Credit card numbers must comply with PCI-DSS. Remove or tokenize card data immediately."),
    (("ssn",), "Social Security Numbers are high-risk PII. Implement encryption, masking, and audit logging."),
    (("phone_br", "phone_intl"), "Phone numbers should be masked in non-production environments."),
    (("name",), "Personal names may constitute PII under GDPR/LGPD. Ensure lawful basis for processing."),
    (("ip_address",), "IP addresses are considered personal data under GDPR. Anonymize where possible."),
)
FRAMEWORK_ADVICE = {
    "lgpd": "Under LGPD, maintain a Record of Processing Activities (ROPA) documenting the legal basis for each PII category.",
    "gdpr": "Under GDPR Art. 30, maintain records of processing activities. Conduct a Data Protection Impact Assessment (DPIA) if needed.",
}
NOTHING = "No compliance issues detected. Continue monitoring."
BY_NAME, BY_BOTH, BY_REGEX = "column_name_heuristic", "column_name_heuristic+regex", "regex_pattern"


def hinted(column: str) -> list[str]:
    return [kind for kind, parts in HINTS.items() if any(part in column.lower() for part in parts)]


def java(pattern: str) -> str:
    return "(?U)" + pattern


def risk(pii_type: Column, count: Column, present: Column) -> Column:
    """By type, then by the share of rows, then by their number."""
    return F.when(pii_type.isin(*CRITICAL), "critical").when(F.coalesce(F.try_divide(count, present), F.lit(0.0)) > 0.5, "high").when(count > 10, "medium").otherwise("low")


def pii_findings(df: DataFrame) -> DataFrame:
    """(place, column, pii_type, sample_count, detection_method, risk_level): one scan, one aggregate, for all columns.

    place numbers findings in the order of columns, names before patterns. A driver-side table of candidates is exploded
    from the single row of counts.
    """
    strings = [c for c in df.columns if isinstance(kind(df, c), T.StringType)]
    counts, rows = [], []
    for i, c in enumerate(df.columns):
        by_name = hinted(c)
        counts.append(F.sum((~missing(df, c)).cast("long")).alias(f"n{i}"))
        for t in by_name + [t for t in PATTERNS if t not in by_name and c in strings]:
            if c in strings and t in PATTERNS:
                counts.append(F.sum(quoted(c).rlike(java(PATTERNS[t])).cast("long")).alias(f"r{i}_{t}"))
            rows.append((i, c, t, t in by_name, c in strings and t in PATTERNS))
    kind_of = "array<struct<place:int,column:string,pii_type:string,named:boolean,hits:bigint,present:bigint>>"
    if not rows:
        return df.sparkSession.createDataFrame([], "place int, column string, pii_type string, sample_count long, detection_method string, risk_level string")
    cells = F.array(*(F.struct(F.lit(k).alias("place"), F.lit(c).alias("column"), F.lit(t).alias("pii_type"), F.lit(named).alias("named"), (F.coalesce(F.col(f"r{i}_{t}"), F.lit(0)) if scanned else F.lit(0).cast("long")).alias("hits"), F.coalesce(F.col(f"n{i}"), F.lit(0)).alias("present")) for k, (i, c, t, named, scanned) in enumerate(rows))).cast(kind_of)
    one = df.agg(*counts).select(F.explode(cells).alias("x")).select("x.*").where("named or hits > 0")
    by_regex = F.col("hits") > 0
    return one.select(
        "place",
        "column",
        "pii_type",
        F.when(by_regex, F.col("hits")).otherwise(F.col("present")).alias("sample_count"),
        F.when(by_regex & F.col("named"), BY_BOTH).when(by_regex, BY_REGEX).otherwise(BY_NAME).alias("detection_method"),
        F.when(by_regex, risk(F.col("pii_type"), F.col("hits"), F.col("present"))).otherwise("medium").alias("risk_level"),
    )


def retention(df: DataFrame, policies: dict[str, int], as_of: datetime, fmt: str | None = None) -> DataFrame:
    """(column, max_age_days, oldest_record_days, records_exceeding, valid) of each date column that a policy names."""
    out, cells = [], []
    for i, (c, most) in enumerate((c, m) for c, m in policies.items() if c in df.columns and (is_time(kind(df, c)) or isinstance(kind(df, c), T.StringType))):
        moment = quoted(c) if is_time(kind(df, c)) else F.try_to_timestamp(quoted(c), F.lit(fmt)) if fmt else F.try_to_timestamp(quoted(c))
        age = age_days(moment, F.lit(as_of.isoformat()).cast("timestamp"))
        out += [F.max(age).alias(f"o{i}"), F.coalesce(F.sum((age > most).cast("long")), F.lit(0)).alias(f"e{i}"), F.count(age).alias(f"v{i}")]
        cells.append(F.struct(F.lit(c).alias("column"), F.lit(most).cast("long").alias("max_age_days"), F.col(f"o{i}").alias("oldest_record_days"), F.col(f"e{i}").alias("records_exceeding"), F.col(f"v{i}").alias("valid")))
    if not cells:
        return df.sparkSession.createDataFrame([], "column string, max_age_days long, oldest_record_days long, records_exceeding long, valid long")
    return df.agg(*out).select(F.explode(F.array(*cells)).alias("x")).select("x.*")


class ComplianceEngine:
    """as_of fixes the moment that ages are counted to; by default it is now. order_by gives samples a stable order."""

    def __init__(self, framework: ComplianceFramework = ComplianceFramework.LGPD, retention_policies: dict[str, int] | None = None, as_of: datetime | None = None, date_format: str | None = None) -> None:
        self.framework, self.retention_policies = framework, dict(retention_policies or {})
        self.as_of, self.date_format = as_of, date_format

    def detect_pii(self, df: DataFrame) -> list[PIIFinding]:
        found = []
        for r in sorted(pii_findings(df).collect()):
            sample = []
            if r.detection_method != BY_NAME:
                hit = F.regexp_extract(quoted(r.column), "(" + java(PATTERNS[r.pii_type]) + ")", 1)
                sample = [x.m for x in df.where(quoted(r.column).rlike(java(PATTERNS[r.pii_type]))).select(masked(hit).alias("m"), hit.alias("h")).orderBy("h").limit(3).collect()]
            found.append(PIIFinding(r.column, r.pii_type, r.sample_count, r.detection_method, r.risk_level, sample))
        return found

    def check_retention(self, df: DataFrame) -> list[RetentionViolation]:
        rows = retention(df, self.retention_policies, self.as_of or datetime.now(UTC), self.date_format).where("records_exceeding > 0").collect()
        return [RetentionViolation(r.column, f"retention_{r.column}", r.max_age_days, r.oldest_record_days, r.records_exceeding, f"{r.records_exceeding} records in '{r.column}' exceed the {r.max_age_days}-day retention limit") for r in rows]

    def run_compliance_check(self, df: DataFrame, dataset_name: str = "unnamed") -> ComplianceReport:
        findings, violations = self.detect_pii(df), self.check_retention(df)
        risks = {f.risk_level for f in findings}
        if RiskLevel.CRITICAL.value in risks:
            level = RiskLevel.CRITICAL
        elif RiskLevel.HIGH.value in risks or violations:
            level = RiskLevel.HIGH
        else:
            level = RiskLevel.MEDIUM if findings else RiskLevel.LOW
        summary = {
            "total_columns_scanned": len(df.columns),
            "pii_columns_found": len({f.column for f in findings}),
            "pii_types_found": sorted({f.pii_type for f in findings}),
            "retention_violations_count": len(violations),
        }
        return ComplianceReport(dataset_name, self.framework.value, now(), RiskLevel.CRITICAL.value not in risks and not violations, level.value, [f.to_dict() for f in findings], [v.to_dict() for v in violations], self.recommendations(findings, violations), summary)

    def recommendations(self, findings: list[PIIFinding], violations: list[RetentionViolation]) -> list[str]:
        types: set[Any] = {f.pii_type for f in findings}
        lines = [text for kinds, text in ADVICE if types & {*kinds}]
        lines += [f"Purge {v.records_exceeding} records in '{v.column}' exceeding the {v.max_age_days}-day retention limit." for v in violations]
        if findings and self.framework.value in FRAMEWORK_ADVICE:
            lines.append(FRAMEWORK_ADVICE[self.framework.value])
        return lines or [NOTHING]
