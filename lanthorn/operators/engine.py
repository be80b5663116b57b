"""One Arrow pass that runs the detectors on the files that can have findings."""

from __future__ import annotations

import time
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lanthorn.functions.workers import ready
from lanthorn.model import HITS
from lanthorn.operators.detectors import Detector, File, LanguageDetector, LongLine, language_gate
from lanthorn.operators.rules import RuleSet

_RAW = T.StructType([T.StructField("file", T.StringType()), T.StructField("failed", T.StringType()), *HITS.fields])


def classified(files: DataFrame, rules: RuleSet) -> DataFrame:
    """Adds language_id, and configured: whether the language has a configuration."""
    ids = sorted(rules.by_name)
    known = F.col("language_id").isin(*ids) if ids else F.lit(False)
    return files.withColumn("language_id", rules.detect_language(F.col("path"))).withColumn("configured", F.coalesce(known, F.lit(False)))


def _text(value: object) -> str | None:
    return value if value is None or isinstance(value, str) else str(value).lower() if isinstance(value, bool) else str(value)


def run_detectors(files: DataFrame, rules: RuleSet, detectors: list[Detector], timeout: float | None = None) -> DataFrame:
    """(file, failed, finding fields) from a table of (path, source, language_id, configured); null sources give nothing.

    A detector that raises, or takes longer than ``timeout`` seconds on a file, gives a row with its id in ``failed``.
    """
    ready(files.sparkSession)
    numbered = list(enumerate(detectors))
    in_python = [(i, d) for i, d in numbered if not isinstance(d, LongLine)]
    some = files.where(F.col("source").isNotNull())
    parts = []
    if in_python:
        by_language = [d for _, d in in_python if isinstance(d, LanguageDetector) and type(d).gate is LanguageDetector.gate]
        gates = [d.gate() for _, d in in_python if d not in by_language] + [language_gate(by_language, rules)] * bool(by_language)
        gate = reduce(lambda a, b: a | b, [F.coalesce(g, F.lit(False)) for g in gates])
        schema = to_arrow_schema(_RAW)
        languages = {name: config for name, config in rules.by_name.items()}

        def rows(file: File) -> Iterator[tuple]:
            for ordinal, d in in_python:
                began, n = time.monotonic(), 0
                try:
                    if not d.applies(file):
                        continue
                    hits = []
                    for n, h in enumerate(d.find(file)):
                        evidence = [(k, _text(v)) for k, v in h.evidence.items()]
                        hits.append((file.path, None, h.rule_id, h.severity, h.score, h.line, h.end_line, h.snippet, h.reason, evidence, ordinal, n))
                    if timeout is not None and time.monotonic() - began > timeout:
                        raise TimeoutError(d.id)
                except Exception:
                    yield (file.path, d.id, *[None] * 10)
                else:
                    yield from hits

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple] = []
            for batch in batches:
                for path, source, language in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    held.extend(rows(File(path or "", source, language, languages.get(language))))
                    if len(held) >= 4000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
                        held = []
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

        parts.append(some.where(gate).select("path", "source", "language_id").mapInArrow(scan, _RAW))
    for ordinal, d in numbered:
        if isinstance(d, LongLine):
            parts.append(long_lines(d, some, ordinal))
    if not parts:
        return files.sparkSession.createDataFrame([], _RAW)
    return reduce(DataFrame.unionByName, parts)


def long_lines(d: LongLine, files: DataFrame, ordinal: int = 0) -> DataFrame:
    very = F.col("line_length") >= d.VERY_LONG
    return d.native(files.select("path", "source")).select(
        F.col("path").alias("file"), F.lit(None).cast("string").alias("failed"), F.lit(d.id).alias("rule_id"), F.when(very, "warn").otherwise("info").alias("severity"), F.when(very, 8).otherwise(5).alias("score"),
        "line", F.lit(None).cast("int").alias("end_line"), F.col("start").alias("snippet"),
        F.concat(F.lit("A line of "), F.col("line_length").cast("string"), F.lit(" characters is how minified and packed code looks.")).alias("reason"),
        F.create_map(F.lit("lineLength"), F.col("line_length").cast("string")).alias("evidence"), F.lit(ordinal).alias("detector_ord"), (F.col("line") - 1).alias("match_ord"),
    )
