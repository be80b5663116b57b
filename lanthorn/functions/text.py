"""Column functions that the scanner's plans share; all run in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lanthorn.model import RANK

_SPACES = r"[\s\u000B\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"


def truncate_snippet(text: Column, most: int = 200) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def severity_rank(severity: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, rank in RANK.items():
        out = F.when(severity == name, F.lit(rank)).otherwise(out)
    return out


def rule_matches(rule_id: Column, wanted: Column) -> Column:
    """Equal, or ``wanted`` and then a dot at the start."""
    return (rule_id == wanted) | rule_id.startswith(F.concat(wanted, F.lit(".")))


def hash_snippet(snippet: Column) -> Column:
    """SHA-256 of the snippet with runs of white space as one space, and none at the ends."""
    return F.sha2(F.trim(F.regexp_replace(snippet, F.lit(_SPACES + "+"), F.lit(" "))), 256)


def in_ranges(line: Column, ranges: Column) -> Column:
    return F.exists(ranges, lambda r: line.between(r["start"], r["end"]))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)


def glob_regex(pattern: str) -> str:
    """A Java regex for a glob: ``*`` and ``?`` stop at a slash, ``**`` and a slash after it match anything, classes are kept."""
    out, at = [], 0
    for m in re.finditer(r"\*\*/?|\*|\?|\[[^\]]*\]?", pattern):
        out.append(re.escape(pattern[at : m.start()]))
        at, token = m.end(), m[0]
        out.append(".*" if token.startswith("**") else "[^/]*" if token == "*" else "[^/]" if token == "?" else token if token.endswith("]") else token + "]")
    out.append(re.escape(pattern[at:]))
    return r"\A" + "".join(out) + r"\z"
