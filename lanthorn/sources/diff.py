"""Unified diffs in git's format -> the lines that each file gains."""

from __future__ import annotations

import re
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lanthorn.functions.workers import ready
from lanthorn.model import TARGETS

_FILE = re.compile(r"diff --git a/(.+?) b/(.+)\Z", re.S)
_HUNK = re.compile(r"@@ -\d+(?:,\d+)? \+(\d+)(?:,\d+)? @@", re.ASCII)


def _sections(lines: list[str]):
    """The lines of each file, from its header on."""
    heads = [i for i, line in enumerate(lines) if _FILE.match(line)]
    for a, b in pairwise([*heads, len(lines)]):
        yield lines[a:b], b == len(lines)


def _gained(body: list[str], start: int, at_end: bool) -> list[tuple[int, int]]:
    """Ranges of added lines in the body of one hunk. It ends at the first line that can't be part of it."""
    line, added = start, []
    for i, text in enumerate(body):
        kind = text[:1]
        if kind == "+":
            if added and added[-1][1] == line - 1 and added[-1][2]:
                added[-1][1] = line
            else:
                added.append([line, line, True])
            line += 1
        elif kind == "\\":
            continue
        elif kind in ("-", " ") or text == "" and not (at_end and i == len(body) - 1):
            if added:
                added[-1][2] = False
            line += kind != "-"
        else:
            break
    return [(a, b) for a, b, _ in added]


def parse_diff(diff: str | None) -> list[tuple[str, str, list[tuple[int, int]]]]:
    """(path, status, added ranges) of the files that a diff adds or changes; ranges are 1-based and inclusive."""
    out = []
    for section, at_end in _sections(re.split(r"\r?\n", diff or "")):
        path, status = _FILE.match(section[0])[2], "modified"
        hunks = [i for i, line in enumerate(section) if line.startswith("@@")]
        for line in section[1 : hunks[0] if hunks else len(section)]:
            if line.startswith("new file mode"):
                status = "added"
            elif line.startswith("deleted file mode"):
                status = "deleted"
            elif line.startswith("+++ "):
                name = line[4:].strip()
                if name == "/dev/null":
                    status = "deleted"
                else:
                    path = name.removeprefix("b/")
        ranges = []
        for a, b in pairwise([*hunks, len(section)]):
            if m := _HUNK.match(section[a]):
                ranges += _gained(section[a + 1 : b], int(m[1]), at_end and b == len(section))
        if status != "deleted":
            out.append((path.replace("\\", "/"), status, ranges))
    return out


def diff_targets(spark: SparkSession, diff: str) -> DataFrame:
    rows = [(path, [{"start": a, "end": b} for a, b in ranges], True) for path, _, ranges in parse_diff(diff)]
    return spark.createDataFrame(rows, TARGETS)


def parse_diffs(diffs: DataFrame, id_col: str, diff_col: str) -> DataFrame:
    """One row for each file of each diff of a table: ``id_col``, path, status, added_ranges."""
    ready(diffs.sparkSession)
    kind = diffs.schema[id_col].dataType.simpleString()
    ranges = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for batch in batches:
            found = [(i, *f) for i, text in enumerate(batch.column(1).to_pylist()) for f in parse_diff(text)]
            spans = [[{"start": a, "end": b} for a, b in f[3]] for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([f[0] for f in found], pa.int64())), pa.array([f[1] for f in found], pa.string()), pa.array([f[2] for f in found], pa.string()), pa.array(spans, ranges)], [id_col, "path", "status", "added_ranges"])

    return diffs.select(id_col, diff_col).mapInArrow(run, f"`{id_col}` {kind}, path string, status string, added_ranges array<struct<start:int,end:int>>")
