"""The public vocabulary and the records that operators return."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from datetime import UTC, datetime
from enum import Enum
from typing import Any


# The vocabulary is part of the public interface.
class RuleType(Enum):
    NOT_NULL = "not_null"
    UNIQUE = "unique"
    RANGE_CHECK = "range_check"
    REGEX_MATCH = "regex_match"
    REFERENTIAL_INTEGRITY = "referential_integrity"
    CUSTOM = "custom"


class RuleSeverity(Enum):
    ERROR = "error"
    WARNING = "warning"
    INFO = "info"


class NodeType(Enum):
    DATASET = "dataset"
    TRANSFORMATION = "transformation"
    MODEL = "model"
    FEATURE = "feature"
    PREDICTION = "prediction"
    EXTERNAL = "external"


class PIIType(Enum):
    EMAIL = "email"
    CPF = "cpf"
    CNPJ = "cnpj"
    PHONE_BR = "phone_br"
    PHONE_INTL = "phone_intl"
    CREDIT_CARD = "credit_card"
    IP_ADDRESS = "ip_address"
    DATE_OF_BIRTH = "date_of_birth"
    NAME = "name"
    SSN = "ssn"


class ComplianceFramework(Enum):
    GDPR = "gdpr"
    LGPD = "lgpd"
    HIPAA = "hipaa"
    CCPA = "ccpa"


class RiskLevel(Enum):
    LOW = "low"
    MEDIUM = "medium"
    HIGH = "high"
    CRITICAL = "critical"


class AssetType(Enum):
    DATASET = "dataset"
    MODEL = "model"
    FEATURE = "feature"
    PIPELINE = "pipeline"
    REPORT = "report"
    ARTIFACT = "artifact"


class AssetStatus(Enum):
    ACTIVE = "active"
    DEPRECATED = "deprecated"
    ARCHIVED = "archived"
    DRAFT = "draft"


class CompatibilityMode(Enum):
    BACKWARD = "backward"
    FORWARD = "forward"
    FULL = "full"
    NONE = "none"


class ChangeType(Enum):
    COLUMN_ADDED = "column_added"
    COLUMN_REMOVED = "column_removed"
    COLUMN_RENAMED = "column_renamed"
    TYPE_CHANGED = "type_changed"
    NULLABLE_CHANGED = "nullable_changed"


def now() -> str:
    return datetime.now(UTC).isoformat()


# The names of the fields below, which are the keys of the records as dicts.
class Record:
    """A dataclass whose to_dict() rounds and cuts as its field metadata say, and replaces enums by their values."""

    def to_dict(self) -> dict[str, Any]:
        out = {}
        for f in fields(self):
            value = getattr(self, f.name)
            if isinstance(value, Enum):
                value = value.value
            if "digits" in f.metadata:
                value = rounded(value, f.metadata["digits"])
            if "first" in f.metadata:
                value = value[: f.metadata["first"]]
            out[f.name] = value
        return out


def rounded(value: Any, digits: int = 4) -> Any:
    """NaN and None give None; maps are rounded by value."""
    if isinstance(value, dict):
        return {k: rounded(v, digits) for k, v in value.items()}
    return None if value is None or value != value else round(float(value), digits)


@dataclass
class ValidationRule(Record):
    name: str
    rule_type: RuleType
    column: str
    severity: RuleSeverity = RuleSeverity.ERROR
    parameters: dict[str, Any] = field(default_factory=dict)
    description: str = ""


@dataclass
class RuleResult(Record):
    rule_name: str
    rule_type: str
    column: str
    passed: bool
    severity: str
    total_rows: int
    failing_rows: int = 0
    failure_rate: float = field(default=0.0, metadata={"digits": 4})
    details: str = ""
    sample_failures: list[Any] = field(default_factory=list, metadata={"first": 5})


@dataclass
class QualityReport(Record):
    dataset_name: str
    timestamp: str
    total_rules: int
    passed_rules: int
    failed_rules: int
    warning_rules: int
    overall_pass: bool
    results: list[dict[str, Any]]
    quality_score: float = field(metadata={"digits": 2})


@dataclass
class PIIFinding(Record):
    column: str
    pii_type: str
    sample_count: int
    detection_method: str
    risk_level: str
    sample_matches: list[str] = field(default_factory=list, metadata={"first": 3})


@dataclass
class RetentionViolation(Record):
    column: str
    policy_name: str
    max_age_days: int
    oldest_record_days: int
    records_exceeding: int
    description: str


@dataclass
class ComplianceReport(Record):
    dataset_name: str
    framework: str
    timestamp: str
    overall_compliant: bool
    risk_level: str
    pii_findings: list[dict[str, Any]]
    retention_violations: list[dict[str, Any]]
    recommendations: list[str]
    summary: dict[str, Any]


@dataclass
class SchemaChange(Record):
    change_type: ChangeType
    column: str
    old_value: str | None = None
    new_value: str | None = None
    breaking: bool = False
    description: str = ""


@dataclass
class CompatibilityResult(Record):
    compatible: bool
    mode: str
    breaking_changes: list[dict[str, Any]]
    non_breaking_changes: list[dict[str, Any]]
    summary: str


@dataclass
class SchemaVersion(Record):
    version: int
    schema: dict[str, str]
    timestamp: str
    description: str = ""
    changes_from_previous: list[dict[str, Any]] = field(default_factory=list)
