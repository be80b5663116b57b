"""Suppression: comment directives, allowlists, changed lines and the severity floor; all of it plans of built-in functions."""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanthorn.functions.text import glob_regex, hash_snippet, in_ranges, rule_matches, severity_rank
from lanthorn.model import CONFIG_DIR, DIRECTIVE_KEYWORD, RANK, Allowlist, PathEntry, SnippetEntry

_IDS = r"[A-Za-z0-9_.,\- *]*"


def extract_directives(files: DataFrame, keyword: str = DIRECTIVE_KEYWORD) -> DataFrame:
    """(path, line, rule_ids) of ``<keyword>-disable-line`` and ``-next-line`` in any text; no ids means all rules."""
    mark = rf"{re.escape(keyword)}-disable-(next-line|line)\b\s*({_IDS})"
    some = files.where(F.col("source").contains(f"{keyword}-disable-")).select("path", F.posexplode(F.split("source", "\n", -1)).alias("at", "text"))
    some = some.where(F.col("text").contains(f"{keyword}-disable-"))
    pairs = F.arrays_zip(F.regexp_extract_all("text", F.lit(mark), F.lit(1)).alias("kind"), F.regexp_extract_all("text", F.lit(mark), F.lit(2)).alias("ids"))
    each = some.select("path", "at", F.explode(pairs).alias("m"))
    ids = F.filter(F.split(F.col("m.ids"), r"[\s,]+"), lambda x: x.rlike(r"\A[A-Za-z0-9_.\-]+\z"))
    return each.select("path", (F.col("at") + F.when(F.col("m.kind") == "next-line", 2).otherwise(1)).alias("line"), ids.alias("rule_ids"))


def without_disabled(findings: DataFrame, directives: DataFrame) -> DataFrame:
    """Findings on lines that no directive covers."""
    f, d = findings.alias("f"), directives.alias("d")
    named = (F.size("d.rule_ids") == 0) | F.exists("d.rule_ids", lambda x: rule_matches(F.col("f.rule_id"), x))
    return f.join(d, (F.col("f.file") == F.col("d.path")) & (F.col("f.line") == F.col("d.line")) & named, "left_anti")


def _parsed(data: dict) -> Allowlist:
    paths = tuple(PathEntry(e["pattern"], e.get("ruleId"), e.get("maxSeverity"), e.get("reason")) for e in data.get("paths") or [])
    snippets = tuple(SnippetEntry(e["ruleId"], e["snippetHash"], e.get("reason"), e.get("added"), e.get("addedBy")) for e in data.get("snippets") or [])
    return Allowlist(paths, snippets)


def load_allowlist(root: str | Path) -> Allowlist:
    """The allowlist of a workspace; empty if the file is missing or can't be read."""
    try:
        return _parsed(json.loads((Path(root) / CONFIG_DIR / "allowlist.json").read_text("utf-8")))
    except (OSError, ValueError, KeyError, TypeError, AttributeError):
        return Allowlist()


def save_allowlist(root: str | Path, allowlist: Allowlist) -> None:
    drop = lambda **x: {k: v for k, v in x.items() if v is not None}
    data = {
        "paths": [drop(pattern=e.pattern, ruleId=e.rule_id, maxSeverity=e.max_severity, reason=e.reason) for e in allowlist.paths],
        "snippets": [drop(ruleId=e.rule_id, snippetHash=e.snippet_hash, reason=e.reason, added=e.added, addedBy=e.added_by) for e in allowlist.snippets],
    }
    folder = Path(root) / CONFIG_DIR
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "allowlist.json").write_text(json.dumps(data, indent=2) + "\n", "utf-8")


def matches_allowlist(allowlist: Allowlist, rule_id: Column, severity: Column, snippet: Column, path: Column) -> Column:
    """Whether an entry covers a finding. Entries are plan-time literals: as many as one person writes down."""
    out = F.lit(False)
    for e in allowlist.paths:
        covered = path.rlike(glob_regex(e.pattern))
        if e.rule_id:
            covered &= rule_matches(rule_id, F.lit(e.rule_id))
        if e.max_severity:
            covered &= severity_rank(severity) <= RANK[e.max_severity]
        out |= covered
    if allowlist.snippets:
        digest = hash_snippet(snippet)
        for e in allowlist.snippets:
            out |= (digest == e.snippet_hash) & rule_matches(rule_id, F.lit(e.rule_id))
    return out


def in_changed_lines(findings: DataFrame, targets: DataFrame) -> DataFrame:
    """Of files that targets (path, added_ranges) lists, the findings on added lines; other files keep all."""
    f = findings.join(targets.select(F.col("path").alias("file"), F.struct("added_ranges").alias("target")), "file", "left")
    return f.where(F.col("target").isNull() | F.coalesce(in_ranges(F.col("line"), F.col("target.added_ranges")), F.lit(False))).drop("target")
