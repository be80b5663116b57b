"""A PySpark-native scanner for source code, with tools for training-data pipelines in the subpackage ``llm``."""

from importlib import import_module

__version__ = "0.1.0"

#: Public names and where they are; each is imported when it is first used, so that workers load only what they need.
_PUBLIC = {
    "scan": "plans.scan", "raw_findings": "plans.scan", "kept_findings": "plans.scan", "markdown": "plans.report", "annotations": "plans.report", "count_by_severity": "plans.report",
    "should_fail": "plans.report", "read_inputs": "plans.report", "scan_stream": "streaming.watch", "parse_diff": "sources.diff", "parse_diffs": "sources.diff",
    "from_table": "sources.files", "from_paths": "sources.files", "from_diff": "sources.files", "from_directory": "sources.files", "workspace_resolver": "sources.files",
    "load_rule_set": "operators.rules", "default_rule_set": "operators.rules", "RuleSet": "operators.rules", "Language": "operators.rules",
    "default_detectors": "operators.detectors", "Detector": "operators.detectors", "File": "operators.detectors", "Hit": "operators.detectors",
    "load_allowlist": "operators.suppress", "save_allowlist": "operators.suppress", "matches_allowlist": "operators.suppress", "extract_directives": "operators.suppress",
    "hash_snippet": "functions.text", "Allowlist": "model", "PathEntry": "model", "SnippetEntry": "model", "ScanResult": "model", "ScanError": "model", "InputError": "model", "RulePackError": "model",
}
__all__ = ["__version__", *_PUBLIC]


def __getattr__(name: str) -> object:
    if name not in _PUBLIC:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(f"{__name__}.{_PUBLIC[name]}"), name)
