"""Scanning a stream of files: every detector looks at one file, so the batch plan runs on a stream as it is."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lanthorn.model import Allowlist
from lanthorn.plans.scan import kept_findings, order, raw_findings


def scan_stream(files: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, allowlist: Allowlist | None = None, min_severity: str = "info", **trigger) -> StreamingQuery:
    """Gives ``sink`` the findings of each micro-batch of (path, source) rows, in their order within the batch."""

    def batch(df: DataFrame, number: int) -> None:
        sink(kept_findings(df, raw_findings(df), allowlist, min_severity).orderBy(*order()), number)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
