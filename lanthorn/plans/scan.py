"""The scan: files -> findings in their total order."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanthorn import __version__
from lanthorn.functions.text import severity_rank, truncate_snippet
from lanthorn.model import DIRECTIVE_KEYWORD, FINDING_COLUMNS, RANK, Allowlist, InputError, ScanResult
from lanthorn.operators.detectors import Detector, default_detectors
from lanthorn.operators.engine import classified, run_detectors
from lanthorn.operators.rules import RuleSet, default_rule_set
from lanthorn.operators.suppress import extract_directives, in_changed_lines, matches_allowlist, without_disabled
from lanthorn.sources.files import from_diff, from_directory, from_paths, with_targets

def order() -> list[Column]:
    """The total order of findings: severity, score, file, line, and then the detectors' own order."""
    return [F.desc("rank"), F.desc("score"), F.col("file"), F.col("line"), F.col("detector_ord"), F.col("match_ord")]


def raw_findings(files: DataFrame, rules: RuleSet | None = None, detectors: Iterable[Detector] | None = None, disabled: Iterable[str] = (), timeout: float | None = None) -> DataFrame:
    """What the detectors say, before any suppression, in no order; failed detectors have a row too."""
    rules = rules or default_rule_set()
    off = set(disabled)
    chosen = [d for d in (default_detectors() if detectors is None else detectors) if d.id not in off]
    return run_detectors(classified(files, rules), rules, chosen, timeout)


def kept_findings(files: DataFrame, raw: DataFrame, allowlist: Allowlist | None = None, min_severity: str = "info", keyword: str = DIRECTIVE_KEYWORD, symbols: Callable[[str, int], str | None] | None = None) -> DataFrame:
    """Findings after the four filters, with their order columns: changed lines, directives, allowlist, severity floor."""
    found = raw.where(F.col("failed").isNull()).drop("failed").withColumn("snippet", truncate_snippet(F.col("snippet"))).withColumn("rank", severity_rank(F.col("severity")))
    found = found.where(F.col("rank") >= RANK[min_severity])
    if "diff_mode" in files.columns:
        found = in_changed_lines(found, files.where("diff_mode").groupBy("path").agg(F.flatten(F.collect_list("added_ranges")).alias("added_ranges")))
    if allowlist and (allowlist.paths or allowlist.snippets):
        found = found.where(~matches_allowlist(allowlist, F.col("rule_id"), F.col("severity"), F.col("snippet"), F.col("file")))
    found = without_disabled(found, extract_directives(files, keyword))
    symbol = F.lit(None).cast("string")
    if symbols:

        def name(path: str, line: int) -> str | None:
            try:
                return symbols(path, line)
            except Exception:
                return None

        symbol = F.udf(name)("file", "line")
    return found.withColumn("enclosing_symbol", symbol)


def scan(
    spark: SparkSession, *, files: DataFrame | None = None, paths: Iterable[str] | None = None, diff: str | None = None, directory: str | None = None,
    contents: DataFrame | None = None, file_resolver: Callable[[str], str | None] | None = None, symbol_resolver: Callable[[str, int], str | None] | None = None,
    rules: RuleSet | None = None, allowlist: Allowlist | None = None, min_severity: str = "info", disabled_detectors: Iterable[str] = (), detectors: Iterable[Detector] | None = None,
    file_timeout_ms: int | None = None, directive_keyword: str = DIRECTIVE_KEYWORD, partitions: int | None = None,
) -> ScanResult:
    """Scans exactly one of: a table of files, paths, a diff, a directory.

    Rows with a null source are listed in ``files`` and not scanned. ``partitions`` spreads the files anew, for tables whose
    partitions are few or uneven.
    """
    given = [files is not None, paths is not None, diff is not None, directory is not None]
    if sum(given) != 1:
        raise InputError("give exactly one of files, paths, diff and directory")
    if min_severity not in RANK:
        raise InputError(f"min_severity must be one of {', '.join(RANK)}")
    if paths is not None:
        files = from_paths(spark, paths, contents, file_resolver)
    elif diff is not None:
        files = from_diff(spark, diff, contents, file_resolver)
    elif directory is not None:
        files = from_directory(spark, directory)
    whole = diff is None and "diff_mode" not in files.columns or paths is not None or directory is not None
    if partitions:
        files = files.repartition(partitions)
    rules = rules or default_rule_set()
    raw = raw_findings(files, rules, detectors, disabled_detectors, None if file_timeout_ms is None else file_timeout_ms / 1000)
    raw = raw.persist(StorageLevel.MEMORY_AND_DISK)  # findings and failures are read apart; what an executor loses is found anew
    kept = kept_findings(files.drop("diff_mode") if whole else files, raw, allowlist, min_severity, directive_keyword, symbol_resolver)
    failed = raw.where(F.col("failed").isNotNull()).select(F.col("failed").alias("detector")).distinct()
    return ScanResult(kept.orderBy(*order()).select(*FINDING_COLUMNS), with_targets(files).select("path", F.col("source").isNotNull().alias("scanned")), failed, rules.version, __version__)
