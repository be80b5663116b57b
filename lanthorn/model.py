"""Schemas and settings of the scanner."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

SEVERITIES = ("info", "warn", "block")
RANK = {s: i for i, s in enumerate(SEVERITIES)}

#: Files at or above this size are left to the manifest rules.
MAX_SOURCE = 2_000_000
#: The most findings that a capped detector reports in one file.
MAX_FINDINGS = 50
#: What a suppression comment starts with; an option of every call that reads directives.
DIRECTIVE_KEYWORD = "lanthorn"
CONFIG_DIR = ".lanthorn"

RANGES = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
TARGETS = T.StructType([T.StructField("path", T.StringType()), T.StructField("added_ranges", RANGES), T.StructField("diff_mode", T.BooleanType())])
HITS = T.StructType(
    [
        T.StructField("rule_id", T.StringType()), T.StructField("severity", T.StringType()), T.StructField("score", T.IntegerType()), T.StructField("line", T.IntegerType()),
        T.StructField("end_line", T.IntegerType()), T.StructField("snippet", T.StringType()), T.StructField("reason", T.StringType()),
        T.StructField("evidence", T.MapType(T.StringType(), T.StringType())), T.StructField("detector_ord", T.IntegerType()), T.StructField("match_ord", T.IntegerType()),
    ]
)
FINDING_COLUMNS = ["rule_id", "severity", "score", "file", "line", "end_line", "snippet", "reason", "enclosing_symbol", "evidence"]


class ScanError(Exception):
    """Something the scanner can't go on with."""


class InputError(ScanError, ValueError):
    """A scan needs exactly one kind of input."""


class RulePackError(ScanError):
    """A folder without any valid language configuration."""


@dataclass(frozen=True)
class PathEntry:
    pattern: str
    rule_id: str | None = None
    max_severity: str | None = None
    reason: str | None = None


@dataclass(frozen=True)
class SnippetEntry:
    rule_id: str
    snippet_hash: str
    reason: str | None = None
    added: str | None = None
    added_by: str | None = None


@dataclass(frozen=True)
class Allowlist:
    paths: tuple[PathEntry, ...] = ()
    snippets: tuple[SnippetEntry, ...] = ()


@dataclass
class ScanResult:
    """findings are in the total order; nothing is computed before an action needs it."""

    findings: DataFrame
    files: DataFrame
    failed: DataFrame
    rules_version: str
    engine_version: str
    options: dict = field(default_factory=dict)

    def failed_detectors(self) -> list[str]:
        return [r[0] for r in self.failed.orderBy("detector").collect()]
