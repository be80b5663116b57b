"""Language identification by nearest centroid.

A text's vector counts byte trigrams within words (with a space at either end), A-Z as a-z, hashed to ``DIMS`` places; counts
enter as 1 + log, times the inverse document frequency, at length one. Each language has several centroids (spherical
k-means over its texts). The prediction is the language of the centroid with the largest cosine. ``min_cosine`` rejects
texts that are far from all of them.

Training uses at most ``per_language`` texts of a language and ``max_rows`` in all, those with the smallest hash of their
id, which bounds what the driver holds. Prediction reads every whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanthorn.llm.scratch import ready
from lanthorn.llm.textcore import utf8

DIMS = 4096
#: A language's rows are dealt to so many lots before the first of them are chosen.
LOTS = 256
_ROWS = 128
UNDETERMINED = "und"

_FOLD = np.full(256, 0x20, np.uint32)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)


def counts(data: np.ndarray, offsets: np.ndarray, step: int = 1 << 21):
    """(first row, count matrix) for up to _ROWS rows at a time; long texts are counted in steps."""
    n = len(offsets) - 1
    for lo in range(0, n, _ROWS):
        hi = min(n, lo + _ROWS)
        out = np.zeros((hi - lo) * DIMS, np.int64)
        at = int(offsets[lo])
        while at < offsets[hi]:
            to = int(min(offsets[hi], at + step))
            # two bytes more on either side, so that no trigram is lost where a step ends
            a, b = max(int(offsets[lo]), at - 1), min(int(offsets[hi]), to + 1)
            x = np.concatenate([[0x20], _FOLD[data[a:b]], [0x20]]).astype(np.uint32)
            mid = np.arange(at, to) - a + 1
            row = np.searchsorted(offsets[lo : hi + 1], np.arange(at, to), "right") - 1
            left, right = x[mid - 1], x[mid + 1]
            edges = offsets[lo : hi + 1]
            first, last = edges[(edges >= at) & (edges < to)] - at, edges[(edges > at) & (edges <= to)] - at - 1
            left[first], right[last] = 0x20, 0x20
            key = (((left << np.uint32(16)) | (x[mid] << np.uint32(8)) | right) * np.uint32(2654435761)) >> np.uint32(20)
            inner = x[mid] != 0x20
            out += np.bincount(row[inner] * DIMS + key[inner], minlength=len(out))
            at = to
        yield lo, out.reshape(hi - lo, DIMS)


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def weighted(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return unit(np.log1p(tf.astype(np.float32, copy=False)) * idf)


@dataclass
class Centroids:
    idf: np.ndarray
    names: list[str]
    vectors: np.ndarray
    of: np.ndarray

    def nearest(self, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not self.names:
            return np.full(len(tf), -1), np.zeros(len(tf))
        cosines = weighted(tf, self.idf) @ self.vectors.T
        best = cosines.argmax(axis=1)
        return self.of[best], np.clip(cosines[np.arange(len(tf)), best], 0, 1).astype(float)


def clusters(rows: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from the row nearest the mean and then the farthest ones; the same rows give the same centroids."""
    centres = rows[[int((rows @ rows.mean(axis=0)).argmax())]]
    while len(centres) < min(k, len(rows)):
        near = (rows @ centres.T).max(axis=1)
        if near.min() > 0.999:
            break
        centres = np.concatenate([centres, rows[[int(near.argmin())]]])
    for _ in range(rounds):
        of = (rows @ centres.T).argmax(axis=1)
        centres = unit(np.stack([rows[of == j].sum(axis=0) if (of == j).any() else centres[j] for j in range(len(centres))]))
    size = np.bincount((rows @ centres.T).argmax(axis=1), minlength=len(centres))
    return centres[size >= max(1, 0.02 * len(rows))]


def _packed(row: np.ndarray) -> bytes:
    """Counts in two bytes each, or four where one needs them."""
    return row.astype("<u2" if row.max() < 1 << 16 else "<u4").tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, "<u2" if len(blob) == 2 * DIMS else "<u4").astype(np.float32)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out_of: int = 5, held_out: int = 0, per_language: int = 1000, max_rows: int = 8000, k: int = 4) -> Centroids:
    ready(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), F.col(lang_col).cast("string").alias("_lang"))
    rows = rows.where("_lang IS NOT NULL AND _text IS NOT NULL AND _id IS NOT NULL").where(_remainder("_id", held_out_of) != held_out)
    ids = rows.select("_id", "_lang", F.xxhash64("_id").alias("_h")).withColumn("_lot", F.pmod("_h", F.lit(LOTS)))
    # the first of each lot of a language, and of these the first of the language: no task gets a whole language
    best = lambda df, *by: df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("_h", "_id"))).where(F.col("_n") <= per_language)
    some = best(best(ids, "_lang", "_lot"), "_lang").orderBy("_n", "_lang").limit(max_rows).select("_id", "_lang").distinct()

    def vectors(batches):
        for batch in batches:
            for lo, tf in counts(*utf8(batch.column(2))):
                part = batch.slice(lo, len(tf))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([_packed(r) for r in tf], pa.binary())], ["id", "lang", "tf"])

    kind = docs.schema[id_col].dataType.simpleString()
    joined = rows.join(F.broadcast(some), ["_id", "_lang"]).select("_id", "_lang", "_text")  # max_rows bounds what is broadcast
    got = sorted(joined.mapInArrow(vectors, f"id {kind}, lang string, tf binary").collect(), key=lambda r: (r.lang, r.id, r.tf))
    got = got[:max_rows]
    if not got:
        return Centroids(np.ones(DIMS, np.float32), [], np.zeros((0, DIMS), np.float32), np.zeros(0, np.int64))
    tf = np.stack([_unpacked(r.tf) for r in got])
    idf = (np.log((1 + len(tf)) / (1 + (tf > 0).sum(axis=0))) + 0.1).astype(np.float32)
    langs = np.array([r.lang for r in got])
    names = sorted(set(langs.tolist()))
    own = [clusters(weighted(tf[langs == name], idf), k) for name in names]
    return Centroids(idf, names, np.concatenate(own).astype(np.float32), np.repeat(np.arange(len(names)), [len(c) for c in own]))


def _remainder(id_col: str, by: int):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % by


def has_letter(raw: bytes) -> bool:
    return any(c.isalpha() for c in raw.decode("utf-8", "replace"))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_cosine: float | None = None, far: float = 0.15, **options) -> DataFrame:
    """One row for each row of docs: ``id_col``, held_out, lang_pred, score (the cosine), rejected (score below ``far``).

    lang_pred is ``und`` where the text is null or has no letter, where nothing could be learned, and where the cosine is
    below ``min_cosine``, if that is given. Rows with a null id, text or language teach nothing; a null id isn't held out.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, id_col, text_col, lang_col, **options))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        ascii_letter = np.zeros(256, bool)
        ascii_letter[0x41:0x5B] = ascii_letter[0x61:0x7B] = True
        own = model.value
        for batch in batches:
            data, at = utf8(batch.column(1))
            for lo, tf in counts(data, at):
                of, score = own.nearest(tf)
                names = []
                for i in range(len(tf)):
                    part = data[at[lo + i] : at[lo + i + 1]]
                    lettered = ascii_letter[part].any() or has_letter(part.tobytes())
                    names.append(own.names[of[i]] if lettered and of[i] >= 0 and (min_cosine is None or score[i] >= min_cosine) else UNDETERMINED)
                score = np.where(np.array(names) == UNDETERMINED, 0.0, score)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(tf)), pa.array(names), pa.array(score), pa.array(score < far)], ["_id", "lang_pred", "score", "rejected"])

    out = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).mapInArrow(run, f"_id {kind}, lang_pred string, score double, rejected boolean")
    held = F.coalesce(_remainder("_id", options.get("held_out_of", 5)) == options.get("held_out", 0), F.lit(False))
    return out.select(F.col("_id").alias(id_col), held.alias("held_out"), "lang_pred", "score", "rejected")
