"""Summaries of findings: counts, pass or fail, annotations and a Markdown report."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanthorn.functions.text import severity_rank
from lanthorn.model import RANK, SEVERITIES, ScanResult


def count_by_severity(findings: DataFrame) -> DataFrame:
    """One row: block, warn and info counts, zeros included."""
    return findings.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in reversed(SEVERITIES)])


def should_fail(findings: DataFrame, fail_on: str = "block") -> DataFrame:
    """One row: whether a finding is at or above the level; ``never`` never fails."""
    if fail_on == "never":
        return findings.limit(0).agg(F.lit(False).alias("failed"))
    return findings.agg(F.coalesce(F.max(severity_rank(F.col("severity"))) >= RANK[fail_on], F.lit(False)).alias("failed"))


def summary(findings: DataFrame) -> DataFrame:
    """Counts by rule family, rule and severity, with totals of each level (rollup)."""
    family = F.regexp_extract("rule_id", r"\A([^.]*\.[^.]*)", 1)
    return findings.withColumn("family", family).rollup("family", "rule_id", "severity").agg(F.count("*").alias("n"), F.max("score").alias("top_score"))


def _escaped(text: Column, in_property: bool) -> Column:
    for a, b in [("%", "%25"), ("\r", "%0D"), ("\n", "%0A"), *([(":", "%3A"), (",", "%2C")] if in_property else [])]:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def annotations(findings: DataFrame) -> DataFrame:
    """Workflow commands, one line of text for each finding, for ``write.text``."""
    level = F.when(F.col("severity") == "block", "error").when(F.col("severity") == "warn", "warning").otherwise("notice")
    return findings.select(F.concat(F.lit("::"), level, F.lit(" file="), _escaped(F.col("file"), True), F.lit(",line="), F.col("line").cast("string"), F.lit(",title="), _escaped(F.col("rule_id"), True), F.lit("::"), _escaped(F.col("reason"), False)).alias("value"))


def _cell(text: object) -> str:
    out = str(text)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("|", "&#124;")):
        out = out.replace(a, b)
    return re.sub(r"\r?\n", "<br>", out)


def _code(text: str) -> str:
    return f"<code>{_cell(text).replace('`', '&#96;')}</code>"


def markdown(result: ScanResult, max_findings: int = 50, link: str | None = None, duration_ms: int | None = None) -> str:
    """A report of the first findings in order, and counts of all. ``link`` is a URL up to the file's path."""
    counts = count_by_severity(result.findings).first().asDict()
    total = sum(counts.values())
    shown = result.findings.limit(max(1, max_findings)).collect()  # a top-k of the total order
    level = next((s for s in reversed(SEVERITIES) if counts[s]), None)
    status = {None: "No findings.", "block": "Blocking findings.", "warn": "Warnings.", "info": "Notes only."}[level]
    facts = [("Files", result.files.count()), ("Findings", total), *((s.capitalize(), counts[s]) for s in reversed(SEVERITIES)), ("Engine", result.engine_version), ("Rules", result.rules_version)]
    if duration_ms is not None:
        facts.append(("Duration", f"{duration_ms} ms"))
    if failed := result.failed_detectors():
        facts.append(("Failed detectors", ", ".join(failed)))
    out = ["## Scan report", "", f"**Status:** {status}", "", "| Metric | Value |", "|---|---:|", *(f"| {k} | {_cell(v)} |" for k, v in facts)]
    for severity in reversed(SEVERITIES):
        rows = [r for r in shown if r.severity == severity]
        if rows:
            out += ["", f"### {severity.capitalize()}", "", "| Location | Rule | Score | Reason | Snippet |", "|---|---|---:|---|---|"]
        for r in rows:
            place = _cell(f"{r.file}:{r.line}")
            if link:
                place = f"[{place}]({link}/{quote(r.file)}#L{r.line})"
            out.append(f"| {place} | {_code(r.rule_id)} | {r.score} | {_cell(r.reason)} | {_code(' '.join(r.snippet.split())[:160])} |")
    if total > len(shown):
        out += ["", f"{total - len(shown)} more not shown."]
    return "\n".join(out)


@dataclass(frozen=True)
class Inputs:
    fail_on: str = "block"
    min_severity: str = "info"
    comment: bool = True
    max_findings: int = 50
    allowlist_path: str = ".lanthorn/allowlist.json"
    disabled_detectors: tuple[str, ...] = ()
    file_timeout_ms: int | None = None


def read_inputs(env: Mapping[str, str]) -> Inputs:
    """CI inputs from ``INPUT_*`` variables; ValueError for values that aren't allowed."""

    def text(name: str) -> str:
        return (env.get(f"INPUT_{name.upper()}") or env.get(f"INPUT_{name.upper().replace('-', '_')}") or "").strip()

    def one_of(name: str, default: str, allowed: tuple[str, ...]) -> str:
        if (value := text(name) or default) not in allowed:
            raise ValueError(f"{name} must be one of {', '.join(allowed)}")
        return value

    def positive(name: str) -> int | None:
        if not (value := text(name)):
            return None
        if not re.match(r"[0-9]*[1-9][0-9]*", value):
            raise ValueError(f"{name} must be a positive integer")
        return int(re.match(r"[0-9]+", value)[0])

    flag = text("comment").lower() or "true"
    if flag not in ("1", "true", "yes", "on", "0", "false", "no", "off"):
        raise ValueError("comment must be true or false")
    listed = tuple(x.strip() for x in re.split(r"[\n,]", text("disabled-detectors")) if x.strip())
    return Inputs(one_of("fail-on", "block", ("block", "warn", "never")), one_of("min-severity", "info", SEVERITIES), flag in ("1", "true", "yes", "on"), positive("max-findings") or 50, text("allowlist-path") or Inputs.allowlist_path, listed, positive("file-timeout-ms"))
