"""Similarity join on word shingles: a blocked sparse product of the document by n-gram incidence matrix.

Rows of the matrix are *classes*, the distinct shingle sets, so that exact copies are one row. Columns are hashed shingles.

1. Counting. A bitmap of the shingles that more than one document has, and the most frequent shingles with their counts. The
   bitmap has ``BITS_EACH`` bits for each of these shingles at least, so that it doesn't fill up as the input grows; it is broadcast
   in pieces of ``PIECE_BYTES``, of which the driver and a worker hold one at a time. The frequent ones are at most ``HOT_KEYS``.
   Both steer the work alone: results stay the same whatever they hold.
2. Incidence. A link needs ceil(percent * n) shingles of a set of n to be shared. A class with fewer is dropped (a bound that
   its size gives); of the others, the matrix keeps the shared shingles, rarest first. Texts are read for this and for counting,
   and not again. Two classes that link share one of the first s - ceil(percent * n) + 1 of their s shared shingles: these
   are the columns in which classes can meet.
3. Stars. A column names its smallest class as anchor. Each class is compared with the two anchors that it meets in most columns.
   This links a large group of near copies with two comparisons for each.
4. Product. What is left is pairs of classes that are in different components and meet in a column. The classes are cut into
   row blocks of at most about ``BLOCK_ROWS`` rows and ``BLOCK_CELLS`` shingles, by neighbourhood (the largest component that a
   class meets) and by size, as sets whose sizes differ by more than the threshold can't link. A column is reduced to the
   blocks that it holds; pairs of blocks of it, if they hold several components, are multiplied. A task accumulates the
   overlap counts of two blocks in one matrix and drops the pairs below the bound that their sizes give. So no row is made
   for a pair of classes, only for a pair of blocks, and at the end one for each link found between two components.

Row blocks steer the work alone; every pair of classes that meets in a column is either in one component by then, or multiplied.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanthorn.llm.blocks import Bits, Pieces, block_bits, by_key, flags, in_blocks, inner_hash, records
from lanthorn.llm.graph import components
from lanthorn.llm.scratch import Scratch
from lanthorn.llm.textcore import LOWER, NON_SPACE, Group, gram_hashes, groups, mix, row_grams

SHINGLE = 5
#: At most so many frequent shingles, 12 bytes each, are broadcast.
HOT_KEYS = 1 << 20
#: Shingles of fewer documents aren't called frequent.
HOT_FROM = 24
#: Bits of the bitmap for each shared shingle: at most two fifths of them are set.
BITS_EACH = 2
#: About so much of the bitmap is broadcast at once.
PIECE_BYTES = 8 << 20
#: With several pieces, so many shingles are tested together.
HELD = 1 << 21
#: A row block has about so many rows and shingles at most; a larger set is a block of its own.
BLOCK_ROWS, BLOCK_CELLS = 1024, 1 << 19


def shingle_sets(group: Group, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, in ascending order within a row, and row pointers.

    A row of fewer words has the whole sequence as its one shingle; a row without words has none.
    """
    hashes, at = row_grams(group.hashes, group.ptr, size)
    cuts = np.searchsorted(at, group.ptr)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        hashes[a:b].sort()
    keep = np.ones(len(hashes), bool)
    keep[1:] = hashes[1:] != hashes[:-1]
    keep[cuts[:-1][cuts[:-1] < len(hashes)]] = True
    ptr = np.concatenate([[0], np.cumsum(keep)])[cuts]
    hashes = hashes[keep]
    counts = group.counts
    few = np.flatnonzero((counts > 0) & (counts < size))
    if len(few):
        whole = np.empty(len(few), np.uint64)
        for n in np.unique(counts[few]).tolist():
            some = np.flatnonzero(counts[few] == n)
            words = group.hashes[group.ptr[few[some]][:, None] + np.arange(n)]
            whole[some] = gram_hashes(words.ravel(), n, salt=8 * n)[::n]
        hashes = np.insert(hashes, ptr[few], whole)
        more = np.zeros(len(ptr), np.int64)
        more[few + 1] = 1
        ptr = ptr + np.cumsum(more)
    return hashes, ptr


def class_ids(hashes: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each set, as two numbers; rows with the same set have the same."""
    out = []
    n = np.diff(ptr).astype(np.uint64)
    for salt in (np.uint64(0x51ED270B), np.uint64(0xA24BAED4963EE407)):
        sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(mix(hashes + salt), out=sums[1:])
        out.append(mix((sums[ptr[1:]] - sums[ptr[:-1]]) + n * np.uint64(0x9E3779B97F4A7C15)).view(np.int64))
    return out[0], out[1]


def needed(n: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap of a set of n shingles with any set that it links with."""
    return (n * percent + 99) // 100


class Order:
    """Which shingles are frequent. Which are shared is in ``pieces``, broadcasts of :class:`Pieces` in the order of ``firsts``, their first blocks."""

    def __init__(self, bits: int, hot: np.ndarray, levels: np.ndarray, firsts: list[int]) -> None:
        self.bits, self.firsts = bits, np.array(firsts, np.int64)
        order = np.argsort(hot)
        self.hot, self.levels = hot[order], levels[order]

    def shared(self, hashes: np.ndarray, pieces: list) -> np.ndarray:
        out = np.zeros(len(hashes), bool)
        which = np.searchsorted(self.firsts, (hashes >> np.uint64(64 - self.bits)).astype(np.int64), "right").astype(np.uint16)
        order = np.argsort(which, kind="stable") if len(pieces) > 1 else np.arange(len(hashes))
        cuts = np.cumsum(np.bincount(which, minlength=len(pieces) + 1))
        for a, b, piece in zip(cuts[:-1].tolist(), cuts[1:].tolist(), pieces, strict=True):
            if b > a:
                # not kept by the worker, where there are several
                part = piece.load_from_path(piece._path) if len(pieces) > 1 and piece._path else piece.value
                at = order[a:b]
                at = at[(hashes[at] >> np.uint64(64 - self.bits)).astype(np.int64) <= part.last]
                out[at] = part.test(hashes[at])
        return out

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        """Sorts rare shingles first, then by hash."""
        key = hashes >> np.uint64(8)
        if len(self.hot):
            short = hashes >> np.uint64(64 - self.bits - 32)
            at = np.minimum(np.searchsorted(self.hot, short), len(self.hot) - 1)
            key = key | (np.where(self.hot[at] == short, self.levels[at], np.uint64(0)) << np.uint64(56))
        return key


def _count(docs: DataFrame, text: str, bits: int, scratch: Scratch) -> tuple:
    """Broadcasts of the :class:`Order` and of its pieces."""

    def send(batches):
        for batch in batches:
            for group in groups(batch.column(0), NON_SPACE, LOWER, 8 << 20):
                hashes, _ = shingle_sets(group)
                yield from records(["block", "blob"], in_blocks(hashes, bits, inner_hash(hashes, bits)), [pa.int32(), pa.binary()])

    share = max(1, HOT_KEYS >> bits)

    def count(batches):
        def rows():
            for block, blobs in by_key(batches):
                keys, n = np.unique(np.concatenate([np.frombuffer(b, np.uint32) for b in blobs]), return_counts=True)
                hot = np.flatnonzero(n >= HOT_FROM)
                hot = hot[np.argsort(-n[hot], kind="stable")[:share]]
                yield block, flags(keys[n > 1], bits, BITS_EACH), keys[hot].tobytes(), np.minimum(n[hot], 1 << 30).astype(np.int32).tobytes()

        yield from records(["block", "bitmap", "hot", "counts"], rows(), [pa.int32(), pa.binary(), pa.binary(), pa.binary()], 16)

    blobs = docs.select(text).mapInArrow(send, "block int, blob binary")
    counted = blobs.repartition(max(8, (1 << bits) // 2), "block").sortWithinPartitions("block").mapInArrow(count, "block int, bitmap binary, hot binary, counts binary")
    counted = scratch.save(counted, "counted")
    sc = docs.sparkSession.sparkContext
    pieces, firsts, held, hot, levels = [], [], {}, [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]

    def send_piece() -> None:
        if held:
            firsts.append(min(held))
            pieces.append(sc.broadcast(Pieces(bits, held)))
            held.clear()

    size = 0
    for r in counted.orderBy("block").toLocalIterator():
        held[r.block] = bytes(r.bitmap)
        size += len(r.bitmap)
        hot.append((np.uint64(r.block) << np.uint64(32)) | np.frombuffer(r.hot, np.uint32).astype(np.uint64))
        levels.append(np.floor(np.log2(np.frombuffer(r.counts, np.int32))).astype(np.uint64))
        if size >= PIECE_BYTES:
            send_piece()
            size = 0
    send_piece()
    scratch.drop(counted)
    return sc.broadcast(Order(bits, np.concatenate(hot), np.concatenate(levels), firsts)), pieces


def _incidence(docs: DataFrame, order, pieces: list, percent: int) -> DataFrame:
    """(id, n, h1, h2, shared) of every row of docs (id, text).

    shared, the shared shingles from the rarest on, is null where the class can't link with another, or where the task has
    sent it before.
    """

    def run(batches):
        own, sent = order.value, set()

        def tested(held):
            every = own.shared(np.concatenate([h for _, h, _ in held]), pieces)
            cuts = np.cumsum([len(h) for _, h, _ in held])[:-1]
            for (ids, hashes, ptr), shared in zip(held, np.split(every, cuts), strict=True):
                h1, h2 = class_ids(hashes, ptr)
                n, known = np.diff(ptr), np.array(ids.is_valid())
                some = np.concatenate([[0], np.cumsum(shared)])[ptr]
                blobs: list[bytes | None] = [None] * len(n)
                for r in np.flatnonzero((n > 0) & known & (np.diff(some) >= needed(n, percent))).tolist():
                    if (key := (int(h1[r]), int(h2[r]))) not in sent:
                        sent.add(key)
                        part = hashes[ptr[r] : ptr[r + 1]][shared[ptr[r] : ptr[r + 1]]]
                        blobs[r] = part[np.argsort(own.keys(part), kind="stable")].tobytes()
                yield pa.RecordBatch.from_arrays([ids, pa.array(n.astype(np.int64)), pa.array(h1), pa.array(h2), pa.array(blobs, pa.binary())], ["id", "n", "h1", "h2", "shared"])

        for batch in batches:
            held, size = [], 0
            for group in groups(batch.column(1), NON_SPACE, LOWER):
                held.append((batch.column(0).slice(group.lo, group.hi - group.lo), *shingle_sets(group)))
                size += len(held[-1][1])
                if len(pieces) <= 1 or size >= HELD:
                    yield from tested(held)
                    held, size = [], 0
            if held:
                yield from tested(held)

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, n long, h1 long, h2 long, shared binary")


def _entries(rows: DataFrame, percent: int) -> DataFrame:
    """(column, node): the columns in which a class must meet any class that it links with."""

    def run(batches):
        for batch in batches:
            node, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            parts = [np.frombuffer(b, np.int64) for b in batch.column(2).to_pylist()]
            size = np.array([len(p) for p in parts], np.int64) - needed(n, percent) + 1
            if len(parts):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[:k] for p, k in zip(parts, size.tolist(), strict=True)])), pa.array(np.repeat(node, size))], ["column", "node"])

    return rows.select("node", "n", "shared").mapInArrow(run, "column long, node long")


def _verified(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that meet the threshold, as (src, dst)."""

    def check(batches):
        for batch in batches:
            a, n, b, m = (batch.column(i).to_numpy() for i in (0, 1, 3, 4))
            common = np.array([len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in zip(batch.column(2).to_pylist(), batch.column(5).to_pylist(), strict=True)], np.int64)
            ok = 100 * common >= percent * (n + m - common)
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], ["src", "dst"])

    left = rows.select(F.col("node").alias("a"), F.col("n").alias("an"), F.col("shared").alias("x"))
    right = rows.select(F.col("node").alias("b"), F.col("n").alias("bn"), F.col("shared").alias("y"))
    return pairs.join(right, "b").join(left, "a").select("a", "an", "x", "b", "bn", "y").mapInArrow(check, "src long, dst long")


def _stars(met: DataFrame) -> DataFrame:
    """(a, b): each class b with the two anchors a that it meets most often; a class meets as many anchors as it has columns at most."""
    counted = met.where("node <> anchor").groupBy("node", "anchor").agg(F.count("*").alias("c"))
    best = counted.groupBy("node").agg(F.slice(F.sort_array(F.collect_list(F.struct("c", "anchor")), False), 1, 2).alias("best"))
    return best.select(F.explode("best.anchor").alias("a"), F.col("node").alias("b"))


def overlaps(rows: list[np.ndarray], others: list[np.ndarray], cells: int = 1 << 22) -> np.ndarray:
    """The product of two row blocks: how many shingles each row shares with each of the others."""
    out = np.zeros((len(rows), len(others)), np.int32)
    of_row, of_other = np.repeat(np.arange(len(rows)), [len(x) for x in rows]), np.repeat(np.arange(len(others)), [len(x) for x in others])
    left, right = np.concatenate(rows), np.concatenate(others)
    order = np.argsort(right, kind="stable")
    right, of_other = right[order], of_other[order]
    columns, first, count = np.unique(right, return_index=True, return_counts=True)
    at = np.minimum(np.searchsorted(columns, left), len(columns) - 1)
    hit = np.flatnonzero(columns[at] == left)
    at, of_row = at[hit], of_row[hit]
    if not len(at):
        return out
    used, at = np.unique(at, return_inverse=True)
    first, count = first[used], count[used]
    if int(count[at].sum()) * 40 > len(rows) * len(others) * len(used):  # dense: as matrices, some columns at a time
        step = max(64, cells // (len(rows) + len(others)))
        entry = np.repeat(np.arange(len(used)), count)
        whose = of_other[np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))]
        for lo in range(0, len(used), step):
            a, b = np.zeros((len(rows), min(step, len(used) - lo)), np.float32), np.zeros((len(others), min(step, len(used) - lo)), np.float32)
            some = (at >= lo) & (at < lo + step)
            a[of_row[some], at[some] - lo] = 1
            some = (entry >= lo) & (entry < lo + step)
            b[whose[some], entry[some] - lo] = 1
            out += (a @ b.T).astype(np.int32)
        return out
    n = count[at]
    ends = np.cumsum(n)
    lo = 0
    while lo < len(at):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + cells, "right")))
        part = n[lo:hi]
        place = np.repeat(first[at[lo:hi]] - (np.cumsum(part) - part), part) + np.arange(int(part.sum()))
        cell = np.repeat(of_row[lo:hi], part) * len(others) + of_other[place]
        out += np.bincount(cell, minlength=out.size).reshape(out.shape).astype(np.int32)
        lo = hi
    return out


def _products(work: DataFrame, percent: int) -> DataFrame:
    """(src, dst): components with a link between them, from the rows of pairs of blocks (i, j, block, n, component, shared)."""

    def multiply(own: dict[int, list]) -> tuple[np.ndarray, np.ndarray]:
        sides = [own[k] for k in sorted(own)]
        left, right = sides[0], sides[-1]
        n, m = (np.array([r[0] for r in s], np.int64) for s in (left, right))
        a, b = (np.array([r[1] for r in s], np.int64) for s in (left, right))
        common = overlaps([np.frombuffer(r[2], np.uint64) for r in left], [np.frombuffer(r[2], np.uint64) for r in right])
        i, j = np.nonzero((common * (100 + percent) >= percent * (n[:, None] + m[None, :])) & (a[:, None] != b[None, :]))
        pairs = np.unique(np.stack([np.minimum(a[i], b[j]), np.maximum(a[i], b[j])]), axis=1)
        return pairs[0], pairs[1]

    def run(batches):
        key, own = None, {}
        for batch in batches:
            for i, j, block, n, component, shared in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (i, j) != key:
                    if own:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in multiply(own)], ["src", "dst"])
                    key, own = (i, j), {}
                own.setdefault(block, []).append((n, component, shared))
        if own:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in multiply(own)], ["src", "dst"])

    return work.repartition("i", "j").sortWithinPartitions("i", "j").select("i", "j", "block", "n", "component", "shared").mapInArrow(run, "src long, dst long")


def _across(met: DataFrame, rows: DataFrame, near: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(src, dst): links between components, of all pairs of classes that meet in a column."""
    component = F.coalesce("component", "node").alias("component")
    placed = rows.select("node", "n").join(near, "node", "left").select("node", "n", component)
    entries = met.select("column", "node").join(placed, "node")
    counted = entries.groupBy("column", "component").agg(F.count("*").alias("c"))
    mixed = counted.groupBy("column").agg(F.max(F.struct("c", F.col("component").alias("home"))).alias("top"), F.count("*").alias("several")).where("several > 1").select("column", "top")
    entries = scratch.save(entries.join(mixed, "column"), "mixed")
    level = F.floor(F.log("n") / (math.log(100 / percent) * 1.000001) if percent < 100 else F.col("n"))
    homes = entries.groupBy("node").agg(F.first("n").alias("n"), F.first("component").alias("component"), F.max("top").alias("top"))
    homes = homes.select("node", "n", "component", F.col("top.home").alias("home"), (F.col("top.home") == F.col("component")).alias("inner"), level.alias("level"))
    lots = F.greatest(F.ceil(F.sum("n") / BLOCK_CELLS), F.ceil(F.count("*") / BLOCK_ROWS))
    sizes = homes.groupBy("home", "inner", "level").agg(lots.alias("lots"))
    blocks = homes.join(sizes, ["home", "inner", "level"])
    blocks = scratch.save(blocks.select("node", "n", "component", "level", F.xxhash64("home", "inner", "level", F.pmod(F.xxhash64("node"), "lots")).alias("block")), "blocks")
    scratch.sweep()
    held = entries.select("column", "node").join(blocks.select("node", "level", "component", "block"), "node")
    held = held.groupBy("column", "block").agg(*[f(c).alias(f"{name}_{c}") for c in ("level", "component") for f, name in ((F.min, "least"), (F.max, "most"))])
    a, b = held.alias("a"), held.alias("b")
    close = (F.col("a.least_level") <= F.col("b.most_level") + 1) & (F.col("b.least_level") <= F.col("a.most_level") + 1)
    differ = F.least("a.least_component", "b.least_component") != F.greatest("a.most_component", "b.most_component")
    pairs = a.join(b, (F.col("a.column") == F.col("b.column")) & (F.col("a.block") <= F.col("b.block")) & close & differ).select(F.col("a.block").alias("i"), F.col("b.block").alias("j")).distinct()
    contents = blocks.select("node", "n", "component", "block").join(rows.select("node", "shared"), "node").drop("node")
    sides = pairs.select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    return _products(sides.join(contents, "block"), percent)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """Components of documents whose shingle sets have 100 * intersection >= percent * union.

    Returns one row for each row of docs: ``id_col``, ``n_shingles`` (long), ``component_id`` (the smallest id reachable).
    Other columns of docs are ignored. Null or blank texts have no shingles and link with nothing. Rows with the same id
    and the same text count as copies; rows with the same id and different texts are linked through that id. Rows with a
    null id are returned with a null component and don't count as links between others. An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    order, pieces = _count(docs, "text", block_bits(docs), scratch)
    scratch.sweep()
    seen = scratch.save(_incidence(docs, order, pieces, percent), "incidence")
    signed = seen.select("id", "n", "h1", "h2")
    rows = seen.where("id IS NOT NULL AND n > 0").groupBy("h1", "h2", "n").agg(F.min("id").alias("first_id"), F.first("shared", ignorenulls=True).alias("shared")).where("shared IS NOT NULL")
    rows = scratch.save(rows.withColumn("node", F.monotonically_increasing_id()), "rows")  # the written table fixes the numbers
    entries = _entries(rows, percent)
    columns = entries.groupBy("column").agg(F.min("node").alias("anchor"), F.max("node").alias("last")).where("anchor <> last").drop("last")
    met = scratch.save(entries.join(columns, "column"), "met")
    scratch.sweep()
    first = scratch.save(_verified(_stars(met), rows, percent), "links")
    near = scratch.save(components(first, scratch), "near")
    scratch.sweep()
    second = _across(met, rows, near, percent, scratch)
    # rows with one id and several texts
    again = signed.where("id IS NOT NULL AND n > 0").groupBy("id").agg(F.count("*").alias("c")).where("c > 1").select("id")
    same = signed.join(again, "id", "left_semi").join(rows.select("h1", "h2", "n", "node"), ["h1", "h2", "n"]).groupBy("id").agg(F.min("node").alias("src"), F.collect_set("node").alias("all"))
    edges = near.select(F.col("node").alias("src"), F.col("component").alias("dst")).unionByName(second).unionByName(same.select("src", F.explode("all").alias("dst")))
    last = scratch.save(components(edges, scratch), "components")
    classes = rows.select("h1", "h2", "n", "node", "first_id").join(last, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = classes.groupBy("component").agg(F.min("first_id").alias("label"))
    labels = scratch.save(classes.join(least, "component").select("h1", "h2", "n", "label"), "labels")
    out = signed.join(labels, ["h1", "h2", "n"], "left").select("id", "n", "label")
    whole = out.join(again, "id", "left_semi").where("n > 0").groupBy("id").agg(F.min("label").alias("common"))
    out = out.join(whole, "id", "left")
    component = F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.coalesce("label", "common", "id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.cast(docs.schema["id"].dataType).alias("component_id"))


def _listed(rows: DataFrame, id_col: str) -> Column:
    """False where an id isn't in rows; else true, but for some others too. A bitmap of fixed size is broadcast; a full one says true."""
    bits = block_bits(rows)

    def send(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy().view(np.uint64)
            yield from records(["block", "blob"], in_blocks(keys, bits, inner_hash(keys, bits)), [pa.int32(), pa.binary()])

    def mark(batches):
        marked = ((block, flags(np.unique(np.concatenate([np.frombuffer(b, np.uint32) for b in blobs])), bits)) for block, blobs in by_key(batches))
        yield from records(["block", "bitmap"], marked, [pa.int32(), pa.binary()], 16)

    blobs = rows.select(F.xxhash64(id_col)).mapInArrow(send, "block int, blob binary")
    found = blobs.repartition("block").sortWithinPartitions("block").mapInArrow(mark, "block int, bitmap binary").collect()
    seen = rows.sparkSession.sparkContext.broadcast(Bits(bits, {r.block: bytes(r.bitmap) for r in found}))

    @F.pandas_udf("boolean")
    def test(keys: pd.Series) -> pd.Series:
        return pd.Series(seen.value.test(keys.to_numpy(np.int64).view(np.uint64)))

    return test(F.xxhash64(id_col))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """The rows of docs, with all their columns, of the smallest id of each component; one row of each id.

    Of rows with one id, the one with the smallest text stays (a null text is the smallest). Rows with a null id stay.
    """
    found = jaccard_components(docs, id_col, text_col, percent)
    scratch = Scratch(docs.sparkSession, "keep")
    ids = found.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count("*").alias("rows"), F.min("component_id").alias("component_id"))
    odd = scratch.save(ids.where((F.col("component_id") != F.col(id_col)) | (F.col("rows") > 1)), "odd")
    scratch.sweep()
    listed = _listed(odd, id_col)
    # rows that surely aren't odd stay as they are, and only the others are dealt out for the joins
    some = docs.where(listed)
    rest = docs.where(~listed).unionByName(some.join(odd.select(id_col), id_col, "left_anti").select(*docs.columns))
    again = some.join(odd.where(F.col("component_id") == F.col(id_col)).select(id_col), id_col, "left_semi")
    if any("map<" in kind or kind == "variant" for _, kind in docs.dtypes):  # rows that can't be put in order
        return rest.unionByName(again.dropDuplicates([id_col]).select(*docs.columns))
    places = [docs.columns.index(text_col), *(i for i, c in enumerate(docs.columns) if c != text_col)]
    first = again.groupBy(id_col).agg(F.min(F.struct(*[F.col(docs.columns[i]).alias(f"f{i}") for i in places])).alias("_first"))
    one = first.select(*[F.col("_first").getField(f"f{i}").alias(c) for i, c in enumerate(docs.columns)])
    return rest.unionByName(one.select(*docs.columns))

