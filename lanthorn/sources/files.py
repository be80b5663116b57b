"""Tables of files: (path, source, added_ranges, diff_mode)."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanthorn.functions.workers import ready
from lanthorn.model import RANGES, TARGETS
from lanthorn.sources.diff import diff_targets

Resolver = Callable[[str], "str | None"]


def with_targets(files: DataFrame) -> DataFrame:
    """Adds the columns of a target, whole file in scope, where they are missing."""
    if "added_ranges" not in files.columns:
        files = files.withColumn("added_ranges", F.lit(None).cast(RANGES))
    return files if "diff_mode" in files.columns else files.withColumn("diff_mode", F.lit(False))


def from_table(table: DataFrame, path: str = "path", source: str = "source") -> DataFrame:
    """Any table with a path and a text column; invalid UTF-8 is replaced when the column is binary."""
    text = F.col(source)
    if table.schema[source].dataType.simpleString() == "binary":
        text = F.make_valid_utf8(text.cast("string"))
    return with_targets(table.select(F.col(path).alias("path"), text.alias("source")))


def from_directory(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """All files below a folder of any file system that Spark reads, with paths relative to it."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    prefix = os.path.join(root.split("://", 1)[-1].rstrip("/"), "")
    name = F.udf(lambda p: unquote(p).split(prefix, 1)[-1])
    return from_table(reader.load(root).select(name("path").alias("path"), F.col("content").alias("source")))


def from_paths(spark: SparkSession, paths: Iterable[str], contents: DataFrame | None = None, resolver: Resolver | None = None) -> DataFrame:
    """The given paths, whole; see :func:`resolved` for where the texts come from."""
    return resolved(spark.createDataFrame([(p, None, False) for p in paths], TARGETS), contents, resolver)


def from_diff(spark: SparkSession, diff: str, contents: DataFrame | None = None, resolver: Resolver | None = None) -> DataFrame:
    """The files that a diff adds or changes, with the added lines. Texts are those after the change."""
    return resolved(diff_targets(spark, diff), contents, resolver)


def resolved(targets: DataFrame, contents: DataFrame | None, resolver: Resolver | None) -> DataFrame:
    """Texts by a join with ``contents`` (path, source), or by calling ``resolver`` on executors.

    A path without a text, and one for which the resolver raises, stays with a null source: listed, not scanned.
    """
    if contents is not None:
        return targets.join(contents.select("path", "source"), "path", "left").select("path", "source", "added_ranges", "diff_mode")
    ready(targets.sparkSession)
    if resolver is None:
        resolver = workspace_resolver(os.getcwd())

    def read(path: str) -> str | None:
        try:
            return resolver(path)
        except Exception:
            return None

    return targets.withColumn("source", F.udf(read)("path")).select("path", "source", "added_ranges", "diff_mode")


def workspace_resolver(root: str) -> Resolver:
    """Reads regular files below a folder; paths that lead out of it give null."""
    root = os.path.realpath(root)

    def read(path: str) -> str | None:
        full = os.path.realpath(os.path.join(root, path))
        if os.path.commonpath([root, full]) != root or not os.path.isfile(full):
            return None
        with open(full, encoding="utf-8", errors="replace", newline="") as f:
            return f.read()

    return read
