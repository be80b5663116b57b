"""A toxicity classifier with a counterfactual penalty.

Logistic regression on the distinct words of a text and the distinct starts of its words (4, 5 and 6 bytes, which catch
compounds). Features are scaled by the log ratio of their smoothed rates under either label. The training loss is

    log loss + l2 * |u|^2 + swap_weight * mean of (score of a text - score of the text with its identity terms swapped)^2

where u are the weights before scaling and scores are log odds. The swapped form of a text has each identity term, in the singular or
with an s, replaced by the next one of its category and language, before features are made: a feature goes if no other word of the text has it
too, and one comes if none had it. Words and their starts are covered alike, and a replacement that no training text has counts with weight 0. So
a term's own mention can't move a score much unless words around it do, which lowers false positives on neutral mentions of groups.

Training uses at most ``max_rows`` labelled rows, those with the smallest hash of their id: that alone bounds what the driver
holds, 8 bytes for each distinct feature of each of these rows. They are written first and reach the driver a part at a time, as what
is collected at once is held several times over meanwhile. Training and scoring read every whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lanthorn.llm.scratch import Scratch, ready
from lanthorn.llm.textcore import ALNUM, LOWER, Group, groups, mix, span_hashes

# Identity terms by category, a list for each language (English, German, French, Spanish).
IDENTITY_TERMS = {
    "religion": [["christian", "muslim", "jewish", "hindu", "buddhist", "atheist"], ["christ", "muslim", "jude", "hindu", "buddhist", "atheist"], ["chrétien", "musulman", "juif", "hindou", "bouddhiste", "athée"], ["cristiano", "musulmán", "judío", "hindú", "budista", "ateo"]],
    "origin": [["african", "asian", "european", "american", "mexican", "immigrant"], ["afrikaner", "asiate", "europäer", "amerikaner", "mexikaner", "einwanderer"], ["africain", "asiatique", "européen", "américain", "mexicain", "immigré"], ["africano", "asiático", "europeo", "americano", "mexicano", "inmigrante"]],
    "colour": [["black", "white", "brown"], ["schwarze", "weiße", "braune"], ["noir", "blanc", "brun"], ["negro", "blanco", "moreno"]],
    "gender": [["women", "men", "girls", "boys", "transgender"], ["frauen", "männer", "mädchen", "jungen", "transgender"], ["femme", "homme", "fille", "garçon", "transgenre"], ["mujer", "hombre", "chica", "chico", "transgénero"]],
    "orientation": [["gay", "lesbian", "bisexual", "straight", "queer"], ["schwul", "lesbisch", "bisexuell", "heterosexuell", "queer"], ["gay", "lesbienne", "bisexuel", "hétérosexuel", "queer"], ["gay", "lesbiana", "bisexual", "heterosexual", "queer"]],
    "ability": [["deaf", "blind", "disabled", "autistic"], ["gehörlos", "blind", "behindert", "autistisch"], ["sourd", "aveugle", "handicapé", "autiste"], ["sordo", "ciego", "discapacitado", "autista"]],
    "age": [["old", "young", "elderly"], ["alt", "jung", "betagt"], ["vieux", "jeune", "âgé"], ["viejo", "joven", "anciano"]],
}

STARTS = (4, 5, 6)
_BITS = 20
_AT_ONCE = 1 << 20


def features(group: Group) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and word starts of a group, and the row of each; they repeat as the words do."""
    hashes, words = word_features(group)
    return hashes, group.row_of_word()[words]


def word_features(group: Group) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and word starts of a group, and the word of each."""
    hashes, words = [group.hashes], [np.arange(len(group.hashes))]
    for k in STARTS:
        longer = np.flatnonzero(group.ends - group.starts > k)
        begin = group.starts[longer]
        hashes.append(mix(span_hashes(group.data, begin, begin + k, LOWER) ^ np.uint64(k)))
        words.append(longer)
    return np.concatenate(hashes), np.concatenate(words)


def swaps() -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each identity term's hash, its features and those of what replaces it. A term that two lists have is swapped as in the first."""
    pairs: dict[str, str] = {}
    for lists in IDENTITY_TERMS.values():
        for terms in lists:
            for i, t in enumerate(terms):
                other = terms[(i + 1) % len(terms)]
                pairs.setdefault(t, other)
                pairs.setdefault(t + "s", other + "s")
    (group,) = groups(pa.array([" ".join(x for pair in pairs.items() for x in pair)]), ALNUM, LOWER)
    hashes, words = word_features(group)
    of = [hashes[words == i] for i in range(len(group.hashes))]
    return {int(group.hashes[i]): (of[i], of[i + 1]) for i in range(0, len(of), 2)}


def swapped(hashes: np.ndarray, words: np.ndarray, own: np.ndarray, terms: dict[int, tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The features that go and those that come when the identity terms of one text are swapped.

    hashes and words: the text's features and the word of each, own: the hashes of its words (numbered from 0).
    """
    found = np.isin(own, np.fromiter(terms, np.uint64, len(terms)))
    if not found.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    pairs = [terms[int(h)] for h in np.unique(own[found])]
    rest = np.unique(hashes[~found[words]])
    before, after = (np.unique(np.concatenate([p[i] for p in pairs])) for i in (0, 1))
    return np.setdiff1d(before, np.union1d(rest, after)), np.setdiff1d(after, np.union1d(rest, before))


@dataclass
class Model:
    keys: np.ndarray
    weights: np.ndarray
    bias: float

    def seal(self) -> Model:
        order = np.argsort(self.keys)
        self.keys, self.weights = self.keys[order], self.weights[order]
        return self

    def scores(self, hashes: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        """Probabilities of n rows from the words of each."""
        total = np.zeros(n)
        if len(self.keys) and len(hashes):
            some = np.zeros(1 << _BITS, bool)
            some[self.keys >> np.uint64(64 - _BITS)] = True
            at = np.flatnonzero(some[hashes >> np.uint64(64 - _BITS)])
            where = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
            known = self.keys[where] == hashes[at]
            pair = np.unique(rows[at][known] * len(self.keys) + where[known])
            total += np.bincount(pair // len(self.keys), weights=self.weights[pair % len(self.keys)], minlength=n)
        return 1 / (1 + np.exp(-np.clip(total + self.bias, -30, 30)))


def fit(texts: list[np.ndarray], labels: np.ndarray, changes: list[tuple[np.ndarray, np.ndarray]], l2: float, swap_weight: float, min_docs: int, rounds: int = 300) -> Model:
    """Full-batch Adam; texts are arrays of distinct features, changes what :func:`swapped` says of each."""
    n = len(texts)
    rate = float(np.clip(labels.mean() if n else 0.5, 1e-3, 1 - 1e-3))
    bias = float(np.log(rate / (1 - rate)))
    flat = np.concatenate(texts) if n else np.zeros(0, np.uint64)
    flat.sort()
    first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.zeros(0, np.int64)
    keys, counts = flat[first], np.diff(np.append(first, len(flat)))
    del flat
    keys = keys[counts >= min_docs]
    if not len(keys) or labels.min() == labels.max():
        return Model(np.zeros(0, np.uint64), np.zeros(0), bias)
    found = []
    for text in texts:
        at = np.minimum(np.searchsorted(keys, text), len(keys) - 1)
        found.append(at[keys[at] == text].astype(np.int32))
    del texts
    ptr, col = np.concatenate([[0], np.cumsum([len(c) for c in found])]), np.concatenate(found)
    del found
    # some rows at a time, so that what a step makes besides the features themselves is small
    cuts = np.unique(np.concatenate([np.searchsorted(ptr, np.arange(0, len(col), _AT_ONCE)), [n]]))
    lots = [(a, b, slice(ptr[a], ptr[b]), np.diff(ptr[a : b + 1])) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def by_row(w: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(np.repeat(np.arange(b - a), k), weights=w[col[at]], minlength=b - a) for a, b, at, k in lots])

    def by_feature(x: np.ndarray) -> np.ndarray:
        return sum(np.bincount(col[at], weights=np.repeat(x[a:b], k), minlength=len(keys)) for a, b, at, k in lots)

    # differences between a text and its swapped form: -1 for each feature that goes, +1 for each that comes
    sides = [[c[i] for c in changes] or [np.zeros(0, np.uint64)] for i in (0, 1)]
    pair_row = np.concatenate([np.repeat(np.arange(len(side)), [len(c) for c in side]) for side in sides]).astype(np.int64)
    sign = np.repeat([-1.0, 1.0], [sum(map(len, side)) for side in sides])
    moved = np.concatenate([np.concatenate(side) for side in sides])
    pair_col = np.minimum(np.searchsorted(keys, moved), len(keys) - 1)
    known_pair = keys[pair_col] == moved  # the others have weight 0
    pair_row, pair_col, sign = pair_row[known_pair], pair_col[known_pair], sign[known_pair]
    one, none = by_feature(labels), by_feature(1 - labels)
    scale = np.abs(np.log((one + 1) / (labels.sum() + 1)) - np.log((none + 1) / (n - labels.sum() + 1)))
    size, u = len(keys), np.zeros(len(keys))
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for t in range(1, rounds + 1):
        w = u * scale
        z = by_row(w) + bias
        gap = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / n
        grad = by_feature(gap) * scale + 2 * l2 * u / n
        if len(pair_row):
            change = np.bincount(pair_row, weights=sign * w[pair_col], minlength=n)
            grad += 2 * swap_weight / n * np.bincount(pair_col, weights=sign * change[pair_row], minlength=size) * scale
        gb = gap.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        step = 0.05 / (1 + t / 150)
        u -= step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        bias -= step * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-9)
    return Model(keys, u * scale, bias).seal()


def _remainder(id_col: str, by: int):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % by


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", held_out_of: int = 4, held_out: int = 2, max_rows: int = 6000, l2: float = 0.5, swap_weight: float = 5.0, min_docs: int = 2) -> Model:
    """Fits the classifier on labelled rows whose crc32(id) mod ``held_out_of`` isn't ``held_out``."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
    known = known.where(_remainder("_id", held_out_of) != held_out).groupBy("_id").agg(F.max("_y").alias("_y"))
    some = known.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(some), "_id")  # max_rows bounds what is broadcast

    def words(batches):
        terms = swaps()
        for batch in batches:
            for group in groups(batch.column(0), ALNUM, LOWER):
                hashes, word = word_features(group)
                rows = group.row_of_word()[word]
                order = np.argsort(rows, kind="stable")
                hashes, word, ptr = hashes[order], word[order], np.searchsorted(rows[order], np.arange(group.hi - group.lo + 1))
                own, goes, comes = [], [], []
                for r in range(group.hi - group.lo):
                    mine, begin = hashes[ptr[r] : ptr[r + 1]], group.ptr[r]
                    old, new = swapped(mine, word[ptr[r] : ptr[r + 1]] - begin, group.hashes[begin : group.ptr[r + 1]], terms)
                    for column, x in ((own, np.unique(mine)), (goes, old), (comes, new)):
                        column.append(x.tobytes())
                columns = [batch.column(i).slice(group.lo, group.hi - group.lo) for i in (1, 2)] + [pa.array(c, pa.binary()) for c in (own, goes, comes)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "y", "words", "goes", "comes"])

    kind = docs.schema[id_col].dataType.simpleString()
    saved = scratch.save(rows.select("_text", "_id", "_y").mapInArrow(words, f"id {kind}, y int, words binary, goes binary, comes binary"), "features")
    got = sorted(saved.toLocalIterator(), key=lambda r: (r.id, r.words))[:max_rows]
    scratch.drop(saved)
    changes = [(np.frombuffer(r.goes, np.uint64), np.frombuffer(r.comes, np.uint64)) for r in got]
    known_labels, texts = np.array([r.y for r in got], float), [np.frombuffer(r.words, np.uint64) for r in got]
    del got
    held = [texts]
    del texts
    scratch.sweep()
    model = fit(held.pop(), known_labels, changes, l2, swap_weight, min_docs)
    del changes
    scratch.sweep()
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """Adds a column with the probability of label 1; null and empty texts get the one of a text without known words."""
    ready(docs.sparkSession)
    own = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for group in groups(batch.column(text_col), ALNUM, LOWER):
                n = group.hi - group.lo
                scores = own.value.scores(*features(group), n)
                yield pa.RecordBatch.from_arrays([*batch.slice(group.lo, n).columns, pa.array(scores)], [*batch.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, **options) -> DataFrame:
    """One row for each row of docs: ``id_col``, held_out, score, predicted. Other columns are ignored.

    Labels that are null, or whose document is missing, teach nothing; of several labels of one id the largest counts. Without
    labels of both kinds every score is the share of label 1 (0.5 where there is no label). A null id is not held out.
    """
    model = train(docs, labels, id_col, text_col, **options)
    out = score(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), model, "_text", "_score")
    held = F.coalesce(_remainder("_id", options.get("held_out_of", 4)) == options.get("held_out", 2), F.lit(False))
    return out.select(F.col("_id").alias(id_col), held.alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, **options) -> DataFrame:
    """The rows of docs, with all their columns, that the classifier doesn't reject."""
    model = train(docs, labels, id_col, text_col, **options)
    own = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for group in groups(batch.column(text_col), ALNUM, LOWER):
                n = group.hi - group.lo
                yield batch.slice(group.lo, n).filter(pa.array(own.value.scores(*features(group), n) < threshold))

    return docs.mapInArrow(run, docs.schema)
