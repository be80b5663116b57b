"""Near duplicates among embeddings by Euclidean p-stable hashing and exact cosines.

Vectors are brought to length one, where cosine 0.98 is Euclidean distance 0.2. Each of ``tables`` hash tables quantises
``projections`` Gaussian projections, floor((a . v + b) / WIDTH) (Datar and others, 2004), into one key. Vectors with a key
in common are compared exactly. A pair that collides in several tables counts in the first of them alone, which both vectors'
keys tell, so no list of pairs is needed to count links.

The number of projections follows the largest label, so that chance collisions stay few at any size; the number of tables
follows from it, so that a pair at the threshold is missed with a probability of 1e-4 at most, and closer pairs far more
rarely.

Equal vectors are one *class*. The classes of a bucket meet in blocks of ``BLOCK`` rows, multiplied as matrices: a
bucket of m classes yields m rows of counts for each of its blocks, never m * m pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanthorn.llm.graph import components
from lanthorn.llm.scratch import Scratch
from lanthorn.llm.textcore import mix

WIDTH = 1.0
BLOCK = 1024


def collision(distance: float, width: float = WIDTH) -> float:
    """The chance that one quantised projection agrees for two vectors at a distance."""
    c = width / distance
    tail = 0.5 * math.erfc(c / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * c) * (1 - math.exp(-c * c / 2))


def plan(largest: int, least_cosine: float, miss: float = 1e-4) -> tuple[int, int]:
    """(projections, tables) for labels of up to ``largest`` vectors."""
    chance = collision(math.sqrt(2))
    projections = max(4, math.ceil(math.log(max(2, largest)) / -math.log(chance)))
    hit = collision(math.sqrt(max(1e-6, 2 - 2 * least_cosine))) ** projections
    return projections, max(1, math.ceil(math.log(miss) / math.log1p(-hit)))


def unit_vectors(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) by number of components; vectors that are null, zero or not finite throughout are left out."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.array(column.value_lengths().fill_null(0), np.int64)
    values = column.flatten()
    flat = values.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    out = []
    for d in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == d)
        matrix = flat[(ends[rows] - d)[:, None] + np.arange(d)]
        with np.errstate(all="ignore"):
            top = np.abs(matrix).max(axis=1)
            ok = np.isfinite(top) & (top > 0)
            rows, matrix = rows[ok], matrix[ok] / top[ok, None]
            out.append((rows, matrix / np.sqrt((matrix * matrix).sum(axis=1, keepdims=True)) + 0.0))
    return out


def _class_ids(labels: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    salt = mix(np.arange(1, matrix.shape[1] + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    total = mix(matrix.view(np.uint64) ^ salt).sum(axis=1, dtype=np.uint64)
    return mix(total ^ mix(labels.view(np.uint64) * np.uint64(0x2545F4914F6CDD1D) + np.uint64(matrix.shape[1]))).view(np.int64)


def keys(matrix: np.ndarray, projections: int, tables: int) -> np.ndarray:
    """A 32-bit key for each vector and table."""
    d = matrix.shape[1]
    rng = np.random.default_rng(d)
    a, b = rng.standard_normal((d, tables * projections)), rng.uniform(0, WIDTH, tables * projections)
    cells = np.floor((matrix @ a + b) / WIDTH).astype(np.int64).view(np.uint64).reshape(len(matrix), tables, projections)
    salt = mix(np.arange(1, projections + 1, dtype=np.uint64))
    return (mix((mix(cells + salt)).sum(axis=2, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def _grouped(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[dict[str, list]]:
    """Batches sorted by ``names`` -> the rows of each key, as lists of columns."""
    key, held = None, None
    for batch in batches:
        columns = {k: batch.column(k) for k in batch.schema.names}
        ids = list(zip(*(columns[k].to_pylist() for k in names), strict=True))
        at = 0
        while at < len(ids):
            to = at
            while to < len(ids) and ids[to] == ids[at]:
                to += 1
            if ids[at] != key:
                if held:
                    yield held
                key, held = ids[at], {k: [] for k in columns}
            for k, v in columns.items():
                held[k].append(v.slice(at, to - at))
            at = to
    if held:
        yield held


def _local_components(near: np.ndarray) -> np.ndarray:
    """The smallest index that links within a symmetric matrix reach from each row."""
    own = np.arange(len(near))
    while True:
        least = np.where(near, own[None, :], len(near)).min(axis=1)
        new = np.minimum(own, least)
        new = new[new]
        if (new == own).all():
            return own
        own = new


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least_cosine: float = 0.98) -> DataFrame:
    """One row for each row of vectors: ``id_col``, n_links, component_id, kept.

    Vectors link when their labels are equal and not null, they have equally many components, and their cosine in double
    precision is at least ``least_cosine``. Null and zero vectors, and those with a null or non-finite component, link with
    nothing. Rows count one by one: equal rows link with each other. Rows with a null id have no links, a null component and
    kept = false, and don't count for others. Other columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embeddings")
    kind = vectors.schema[id_col].dataType.simpleString()
    label = F.when(F.col(label_col).isNotNull(), F.xxhash64(F.col(label_col)))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), label.alias("label"))

    def read(batches):
        for batch in batches:
            for lo in range(0, len(batch), 2048):
                part = batch.slice(lo, 2048)
                cls, blob = np.zeros(len(part), np.int64), [None] * len(part)
                labels = part.column(2)
                known = np.array(labels.is_valid()) & np.array(part.column(0).is_valid())
                hashed = labels.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                for at, matrix in unit_vectors(part.column(1)):
                    use = known[at]
                    at, matrix = at[use], np.ascontiguousarray(matrix[use])
                    cls[at] = _class_ids(hashed[at], matrix)
                    for i, x in zip(at.tolist(), matrix, strict=True):
                        blob[i] = x.tobytes()
                none = np.array([b is None for b in blob])
                yield pa.RecordBatch.from_arrays([part.column(0), labels, pa.array(cls, mask=none), pa.array(blob, pa.binary())], ["id", "label", "cls", "vector"])

    units = scratch.save(rows.mapInArrow(read, f"id {kind}, label long, cls long, vector binary"), "units")
    classes = units.where("cls IS NOT NULL").groupBy("cls").agg(F.count("*").alias("copies"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    projections, tables = plan(largest, least_cosine)

    def hashed(batches):
        for batch in batches:
            for lo in range(0, len(batch), 1024):
                part = batch.slice(lo, 1024)
                blobs = part.column("vector").to_pylist()
                out: list[bytes] = [b""] * len(blobs)
                sizes = np.array([len(b) for b in blobs])
                for size in np.unique(sizes):
                    at = np.flatnonzero(sizes == size)
                    own = keys(np.stack([np.frombuffer(blobs[i]) for i in at]), projections, tables)
                    for i, k in zip(at.tolist(), own, strict=True):
                        out[i] = k.tobytes()
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], [*part.schema.names, "keys"])

    signed = scratch.save(classes.mapInArrow(hashed, "cls long, copies long, label long, vector binary, keys binary"), "keys")

    def spread(batches):
        for batch in batches:
            labels, sizes = batch.column(1).to_numpy(), np.array([len(b) for b in batch.column(3).to_pylist()])
            own = np.stack([np.frombuffer(b, np.uint32) for b in batch.column(2).to_pylist()]) if len(batch) else np.zeros((0, tables), np.uint32)
            base = mix(labels.astype(np.int64).view(np.uint64) + mix(sizes.astype(np.uint64)))
            for t in range(tables):
                bucket = mix(base + mix(own[:, t].astype(np.uint64) + np.uint64(t << 40))).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(np.full(len(batch), t, np.int32)), batch.column(0)], ["bucket", "t", "cls"])

    def blocks(batches):
        for group in _grouped(batches, ["bucket", "t"]):
            cls = np.sort(np.concatenate([x.to_numpy(zero_copy_only=False) for x in group["cls"]]))
            if len(cls) < 2:
                continue
            bucket, t, n = group["bucket"][0][0].as_py(), group["t"][0][0].as_py(), -(-len(cls) // BLOCK)
            for b in range(n):
                own = cls[b * BLOCK : (b + 1) * BLOCK]
                for other in range(n):
                    m = len(own)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(m, bucket)), pa.array(np.full(m, t, np.int32)), pa.array(np.full(m, min(b, other), np.int32)), pa.array(np.full(m, max(b, other), np.int32)), pa.array(np.full(m, b, np.int32)), pa.array(own)], ["bucket", "t", "i", "j", "own", "cls"])

    members = signed.select("cls", "label", "keys", "vector").mapInArrow(spread, "bucket long, t int, cls long")
    members = members.repartition("bucket").sortWithinPartitions("bucket", "t").mapInArrow(blocks, "bucket long, t int, i int, j int, own int, cls long")
    meeting = members.join(signed.select("cls", "copies", "vector", "keys"), "cls").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "t", "i", "j")

    def compare(batches):
        for group in _grouped(batches, ["bucket", "t", "i", "j"]):
            join = lambda k: pa.concat_arrays(group[k])  # noqa: E731, B023
            cls, own, copies = (join(k).to_numpy(zero_copy_only=False) for k in ("cls", "own", "copies"))
            matrix = np.stack([np.frombuffer(b) for b in join("vector").to_pylist()])
            known = np.stack([np.frombuffer(b, np.uint32) for b in join("keys").to_pylist()])
            t, i, j = (group[k][0][0].as_py() for k in ("t", "i", "j"))
            near = matrix @ matrix.T >= least_cosine
            np.fill_diagonal(near, False)
            if i != j:
                near &= own[:, None] != own[None, :]
            if not near.any():
                continue
            least = _local_components(near)
            new = near.copy()
            for e in range(t):  # an earlier table has the pair
                new &= known[:, e][:, None] != known[:, e][None, :]
            links = new @ copies
            some = np.flatnonzero(near.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(cls[some]), pa.array(links[some].astype(np.int64)), pa.array(cls[least[some]])], ["cls", "links", "near"])

    met = scratch.save(meeting.mapInArrow(compare, "cls long, links long, near long"), "met")
    groups_ = components(met.select(F.col("cls").alias("src"), F.col("near").alias("dst")), scratch)
    counted = met.groupBy("cls").agg(F.sum("links").alias("links"))
    per_class = signed.select("cls", "copies").join(counted, "cls", "left").join(groups_.withColumnRenamed("node", "cls"), "cls", "left")
    per_class = per_class.select("cls", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "cls").alias("component"))
    placed = units.select("id", "cls").join(per_class, "cls", "left")
    least = placed.where("component IS NOT NULL").groupBy("component").agg(F.min("id").alias("component_id"))
    out = placed.join(least, "component", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))
