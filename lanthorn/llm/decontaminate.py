"""Benchmark decontamination: a broadcast hash set of the test items' word windows against all windows of the documents.

Words are runs of digits, letters and all characters that aren't ASCII; A-Z count as a-z. A window is ten consecutive
words of an item, or a whole item of one to nine words. Windows of documents are looked up by a 64-bit hash; what is found
is compared word by word, so a collision can't count as a hit.

The size of the benchmark is measured first. Up to ``max_bytes`` of text it is one set, some five times that in memory, which is
broadcast and looked up in one pass over the documents. A larger one is dealt by a hash of its items into parts of about
that size, one in memory at a time; each has its own pass, hits are written as a table, and the documents are joined with them by a
128-bit hash of their words. The result is the same.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lanthorn.llm.scratch import Scratch, ready
from lanthorn.llm.textcore import ALNUM, LOWER, Group, gram_hashes, groups, mix, row_grams

WINDOW = 10
#: Of a benchmark's text, what one set holds.
MAX_BYTES = 32 << 20


class WindowSet:
    """The windows of some items, by length: hashes in order, and the place of each window's first word."""

    def __init__(self, items: list[tuple[str, str]], size: int = WINDOW) -> None:
        self.items = [i for i, _ in items]
        starts, ends, ptr, data, at = [], [], [np.zeros(1, np.int64)], [], 0
        found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
        words = 0
        for group in groups(pa.array([t for _, t in items], pa.large_string()), ALNUM, LOWER):
            starts.append((group.starts + at).astype(np.uint32))
            ends.append((group.ends + at).astype(np.uint32))
            data.append(LOWER[group.data].tobytes())
            at += len(group.data)
            n = group.counts
            hashes, place = row_grams(group.hashes, group.ptr, size)
            found[size].append((hashes, place + words))
            for k in np.unique(n[(n > 0) & (n < size)]).tolist():
                first = group.ptr[:-1][n == k]
                own = group.hashes[first[:, None] + np.arange(k)].ravel()
                found[k].append((gram_hashes(own, k)[::k], first + words))
            ptr.append(group.ptr[1:] + words)
            words += len(group.hashes)
        self.data, self.starts, self.ends, self.ptr = b"".join(data), np.concatenate([*starts, np.zeros(0, np.uint32)]), np.concatenate([*ends, np.zeros(0, np.uint32)]), np.concatenate(ptr)
        self.windows: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k, parts in found.items():
            hashes, place = np.concatenate([h for h, _ in parts]), np.concatenate([p for _, p in parts])
            order = np.argsort(hashes, kind="stable")
            if len(hashes):
                self.windows[k] = hashes[order], place[order].astype(np.uint32)

    def matches(self, k: int, key: np.uint64, at: int, words: list[bytes]) -> set[str]:
        """The items that have these words, among the windows from the first with this hash on."""
        hashes, place = self.windows[k]
        out = set()
        while at < len(hashes) and hashes[at] == key:
            q = int(place[at])
            if all(self.data[self.starts[q + j] : self.ends[q + j]] == w for j, w in enumerate(words)):
                out.add(self.items[int(np.searchsorted(self.ptr, q, "right")) - 1])
            at += 1
        return out


def _found(group: Group, own: WindowSet):
    """(position of the first word, number of words, items) of every verified hit in a group."""
    for k, (keys, _) in own.windows.items():
        hashes, at = row_grams(group.hashes, group.ptr, k)
        if not len(hashes):
            continue
        where = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        for i in np.flatnonzero(keys[where] == hashes).tolist():
            p = int(at[i])
            if items := own.matches(k, hashes[i], int(where[i]), [group.word(p + j).lower() for j in range(k)]):
                yield p, k, items


def _signatures(group: Group) -> list[np.ndarray]:
    """128 bits of each row's words, as two numbers."""
    place = mix((np.arange(len(group.hashes)) - np.repeat(group.ptr[:-1], group.counts)).astype(np.uint64))
    out = []
    for salt in (np.uint64(0x1B873593), np.uint64(0x38B34AE5A1E38B93)):
        sums = np.zeros(len(group.hashes) + 1, np.uint64)
        np.cumsum(mix((group.hashes + salt) ^ place), out=sums[1:])
        out.append(mix(sums[group.ptr[1:]] - sums[group.ptr[:-1]] + group.counts.astype(np.uint64) * salt).view(np.int64))
    return out


def _parts(benchmark: DataFrame, item_col: str, item_text: str, max_bytes: int) -> tuple[DataFrame, int]:
    """(item, text, part) of the benchmark, and the number of parts."""
    spark = benchmark.sparkSession
    ready(spark)
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).cast("string").alias("text")).where("item IS NOT NULL AND text IS NOT NULL")
    n = max(1, math.ceil((items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / max_bytes))
    return items.withColumn("part", F.pmod(F.xxhash64("item", "text"), F.lit(n))), n


def _broadcast(items: DataFrame, part: int):
    rows = items.where(F.col("part") == part).select("item", "text").collect()  # about max_bytes
    return items.sparkSession.sparkContext.broadcast(WindowSet([(r.item, r.text) for r in rows]))


def _free_names(docs: DataFrame, *names: str) -> list[str]:
    out = []
    for name in names:
        while name in docs.columns:
            name += "_"
        out.append(name)
    return out


def _signed(docs: DataFrame, text_col: str, names: list[str]) -> DataFrame:
    """docs with two columns more, the hash of the words."""

    def sign(batches):
        for batch in batches:
            for group in groups(batch.column(text_col), ALNUM, LOWER):
                yield pa.RecordBatch.from_arrays([*batch.slice(group.lo, group.hi - group.lo).columns, *map(pa.array, _signatures(group))], [*batch.schema.names, *names])

    return docs.mapInArrow(sign, StructType([*docs.schema.fields, *(StructField(n, LongType()) for n in names)]))


def _hits(docs: DataFrame, text_col: str, items: DataFrame, parts: int, names: list[str]) -> DataFrame:
    """(the two names, start, size, item) of every hit, by one pass for each part."""
    scratch = Scratch(docs.sparkSession, "hits")
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    out = []
    for part in range(parts):
        own = _broadcast(items, part)

        def scan(batches, own=own):
            for batch in batches:
                for group in groups(batch.column(0), ALNUM, LOWER):
                    sig = _signatures(group)
                    rows = []
                    for p, k, found in _found(group, own.value):
                        r = int(np.searchsorted(group.ptr, p, "right")) - 1
                        rows += [(int(sig[0][r]), int(sig[1][r]), p - int(group.ptr[r]), k, item) for item in found]
                    columns = list(zip(*rows, strict=True)) or [()] * 5
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()), strict=True)], [*names, "start", "size", "item"])

        out.append(scratch.save(texts.mapInArrow(scan, f"`{names[0]}` long, `{names[1]}` long, start int, size int, item string"), "part"))
        own.destroy()
    return reduce(DataFrame.unionByName, out)


def _covered(spans: Column) -> Column:
    """The number of words in the union of sorted (start, size) spans."""
    add = lambda acc, x: F.struct((acc.n + F.greatest(F.lit(0), x.start + x.size - F.greatest(acc.end, x.start))).alias("n"), F.greatest(acc.end, x.start + x.size).alias("end"))
    return F.aggregate(spans, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), add, lambda acc: acc.n)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", max_bytes: int = MAX_BYTES) -> DataFrame:
    """One row for each row of docs: ``id_col``, n_words, n_hit, n_items, items_sha256, contaminated.

    Other columns are ignored. A null or empty text has no words and no hits. Items with a null id or without words are left
    out; items with the same id count as one. Repeated documents each get their row; empty tables give no rows or no hits.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    docs = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    items, parts = _parts(benchmark, item_col, item_text, max_bytes)
    if parts == 1:
        return _scanned(docs, _broadcast(items, 0), kind).withColumnRenamed("_id", id_col)
    hits = _hits(docs, "_text", items, parts, ["_h1", "_h2"])
    found = hits.groupBy("_h1", "_h2").agg(F.sort_array(F.collect_set(F.struct("start", "size"))).alias("spans"), F.sort_array(F.collect_set("item")).alias("items"))

    def count(batches):
        for batch in batches:
            for group in groups(batch.column(1), ALNUM, LOWER):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(group.lo, group.hi - group.lo), pa.array(group.counts.astype(np.int64)), *map(pa.array, _signatures(group))], ["_id", "n_words", "_h1", "_h2"])

    out = docs.mapInArrow(count, f"_id {kind}, n_words long, _h1 long, _h2 long").join(found, ["_h1", "_h2"], "left")
    n_hit = F.coalesce(_covered(F.col("spans")), F.lit(0)).cast("long")
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(F.col("_id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.size(items_).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", items_), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def _scanned(docs: DataFrame, own, kind: str) -> DataFrame:
    none = hashlib.sha256(b"").hexdigest()

    def scan(batches):
        for batch in batches:
            for group in groups(batch.column(1), ALNUM, LOWER):
                rows = group.hi - group.lo
                hit = np.zeros(len(group.starts), np.int32)
                items: dict[int, set[str]] = defaultdict(set)
                for p, k, found in _found(group, own.value):
                    hit[p : p + k] = 1
                    items[int(np.searchsorted(group.ptr, p, "right")) - 1] |= found
                n_hit = np.diff(np.concatenate([[0], np.cumsum(hit)])[group.ptr])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(group.lo, rows), pa.array(group.counts.astype(np.int64)), pa.array(n_hit.astype(np.int64)),
                        pa.array([len(items[r]) if r in items else 0 for r in range(rows)], pa.int64()),
                        pa.array([hashlib.sha256(",".join(sorted(items[r])).encode()).hexdigest() if r in items else none for r in range(rows)]), pa.array(n_hit > 0),
                    ],
                    ["_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
                )

    return docs.mapInArrow(scan, f"_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", max_bytes: int = MAX_BYTES) -> DataFrame:
    """The rows of docs, with all their columns, in which no window of the benchmark occurs."""
    items, parts = _parts(benchmark, item_col, item_text, max_bytes)
    if parts > 1:
        names = _free_names(docs, "_h1", "_h2")
        hits = _hits(docs, text_col, items, parts, names).select(*names).distinct()
        return _signed(docs, text_col, names).join(hits, names, "left_anti").select(*docs.columns)
    own = _broadcast(items, 0)

    def keep(batches):
        for batch in batches:
            for group in groups(batch.column(text_col), ALNUM, LOWER):
                clean = np.ones(group.hi - group.lo, bool)
                for p, _, _ in _found(group, own.value):
                    clean[np.searchsorted(group.ptr, p, "right") - 1] = False
                yield batch.slice(group.lo, group.hi - group.lo).filter(pa.array(clean))

    return docs.mapInArrow(keep, docs.schema)


def _without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """raw without the bytes of sorted spans, which may overlap."""
    out, last = [], 0
    for a, b in spans:
        out.append(raw[last : max(last, a)])
        last = max(last, b)
    return b"".join([*out, raw[last:]])


def remove_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", max_bytes: int = MAX_BYTES) -> DataFrame:
    """The rows of docs with the words of hits, and what stands between them, cut from the text; null texts stay null."""
    items, parts = _parts(benchmark, item_col, item_text, max_bytes)
    own = _broadcast(items, 0) if parts == 1 else None
    (spans_col,) = _free_names(docs, "_spans")

    def cut(batches):
        for batch in batches:
            column = batch.column(text_col)
            for group in groups(column, ALNUM, LOWER):
                part = batch.slice(group.lo, group.hi - group.lo)
                texts = part.column(text_col).to_pylist()
                spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
                if own is not None:
                    hits = sorted((p, k) for p, k, _ in _found(group, own.value))
                else:
                    hits = [(int(group.ptr[r]) + x["start"], x["size"]) for r, xs in enumerate(part.column(spans_col).to_pylist()) for x in xs or ()]
                for p, k in hits:
                    r = int(np.searchsorted(group.ptr, p, "right")) - 1
                    spans[r].append((int(group.starts[p] - group.offsets[r]), int(group.ends[p + k - 1] - group.offsets[r])))
                for r, found in spans.items():
                    texts[r] = _without(texts[r].encode(), found).decode()
                yield pa.RecordBatch.from_arrays([pa.array(texts, column.type) if n == text_col else part.column(n) for n in names], names)

    names = list(docs.columns)
    if own is None:
        sig = _free_names(docs, "_h1", "_h2")
        hits = _hits(docs, text_col, items, parts, sig).groupBy(*sig).agg(F.sort_array(F.collect_set(F.struct("start", "size"))).alias(spans_col))
        return _signed(docs, text_col, sig).join(hits, sig, "left").mapInArrow(cut, docs.schema)
    return docs.mapInArrow(cut, docs.schema)
