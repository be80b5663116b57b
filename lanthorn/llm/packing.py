"""Packing of documents into windows of equal length, each with the same mixture of sources.

Every source is a queue of tokens. A deficit round-robin gives each queue its share of a window and carries what rounding
owes it into the next windows. Here that schedule is a closed form: after N tokens in all, queue i has given
floor(T_i * N / T) tokens, plus one for the queues with the largest remainders (their deficits) until the sum is N. So any
task can compute any window without running those before it, deficits carry across windows and partitions, and the
placing of a document needs its queue's totals alone.

With ``targets`` the shares differ from what the sources hold. Queues then run dry one after another: the schedule has
*phases*, whole numbers of windows at the target shares of the queues that still have tokens.

Queues: every source whose natural share, or whose target, is a token in a window or more has its own; at most ``length`` do by
either. The others share one queue, in which each is spread evenly. So the driver and the tasks hold at most 2 * ``length`` + 1 totals.

Tokens are made once and written to the shared folder. Texts are cut where the tokenizer's own pattern cuts them (tests hold
the ids against those of whole texts), so that a worker tokenizes each distinct part about once.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanthorn.llm.scratch import Scratch
from lanthorn.llm.textcore import GROUP_BYTES, span_hashes, utf8

LENGTH = 4096
END = 2


# Kinds of bytes: white space, letters (ASCII ones, and all bytes of other characters), digits, other ASCII characters.
_SPACE, _LETTER, _DIGIT, _MARK, _WHOLE = range(5)
_KIND = np.full(256, _MARK, np.uint8)
_KIND[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = _SPACE
_KIND[0x30:0x3A] = _DIGIT
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = _KIND[0x80:] = _LETTER
# Bytes of words that aren't cut further: control characters, the apostrophe and < (contractions and special tokens), and
# whatever starts a character outside U+00C0 to U+023F, where all but two are letters that NFC leaves alone.
_RARE = np.zeros(256, bool)
_RARE[:0x20] = _RARE[0x7F] = _RARE[[0x27, 0x3C]] = True
_RARE[0xC0:] = True
_RARE[0xC3:0xC9] = False
_RARE[[0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False


def chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the parts that the tokenizer treats one by one, and whether each is a whole word.

    A word is cut into runs of letters, single digits and runs of other characters, as the tokenizer's own pattern does.
    """
    kind = _KIND[data]
    rare = _RARE[data]
    if len(data) > 1:  # the multiplication and division signs, and a letter that NFC and lower case change
        pair = (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)) | (data[:-1] == 0xC4) & (data[1:] == 0xB0)
        rare[:-1] |= pair
    row_start = offsets[(offsets < len(data))]
    if rare.any():
        space = kind == _SPACE
        begins = ~space
        begins[1:] &= space[:-1]
        begins[row_start] = ~space[row_start]
        number = np.cumsum(begins)
        marked = np.zeros(int(number[-1]) + 1, bool)
        marked[number[rare]] = True
        marked[0] = False
        kind[marked[number] & ~space] = _WHOLE
    new = np.ones(len(kind), bool)
    new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    new[row_start] = True
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(kind))
    some = kind[first] != _SPACE
    first, last = first[some], last[some]
    return first, last, kind[first] == _WHOLE


class Words:
    """Ids of texts, by way of a cache of parts: sorted hashes, and where the ids of each stand in a pool."""

    def __init__(self, path: str, most: int = 2_000_000) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.keys, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def _ids(self, texts: list[str], whole: bool) -> tuple[np.ndarray, np.ndarray]:
        """All ids of parts, and the number of each part's."""
        if not whole:  # each is one token of the tokenizer's pattern, and the last of its ids ends a word
            got = np.array(self.tokenizer.encode(" ".join(texts), add_special_tokens=False).ids, np.uint32)
            last = np.flatnonzero(self.ends[got])
            if len(last) == len(texts) and (not len(got) or last[-1] == len(got) - 1):
                return got, np.diff(last, prepend=-1)
        own = [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        return np.array([i for ids in own for i in ids], np.uint32), np.array([len(ids) for ids in own], np.int64)

    def _learn(self, keys: np.ndarray, texts: list[str], whole: np.ndarray) -> None:
        learnt = []
        for kind in (False, True):
            of = np.flatnonzero(whole == kind)
            for lo in range(0, len(of), 2048):
                part = of[lo : lo + 2048]
                ids, n = self._ids([texts[i] for i in part], kind)
                while self.used + len(ids) > len(self.pool):
                    self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
                self.pool[self.used : self.used + len(ids)] = ids
                at = self.used + np.cumsum(n) - n
                self.used += len(ids)
                learnt.append((keys[part], at, n))
        fresh, at, n = (np.concatenate(x) for x in zip(*learnt, strict=True))
        order = np.argsort(fresh)
        place = np.searchsorted(self.keys, fresh[order])
        self.keys, self.at, self.size = np.insert(self.keys, place, fresh[order]), np.insert(self.at, place, at[order]), np.insert(self.size, place, n[order])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the rows of a UTF-8 buffer, one row after another, and where each row's end."""
        first, last, whole = chunks(data, offsets)
        hashes = span_hashes(data, first, last) ^ whole.astype(np.uint64)
        unique, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) > self.most:
            self.clear()
        place = np.searchsorted(self.keys, unique)
        known = place < len(self.keys)
        known[known] = self.keys[place[known]] == unique[known]
        new = where[~known]
        if len(new):
            raw = data.tobytes()
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(first[new].tolist(), last[new].tolist(), strict=True)]
            self._learn(hashes[new], texts, whole[new])
            place = np.searchsorted(self.keys, unique)
        n = self.size[place][inverse]
        ends = np.cumsum(n)
        flat = self.pool[np.repeat(self.at[place][inverse] - (ends - n), n) + np.arange(int(n.sum()))]
        bounds = np.concatenate([[0], ends])[np.searchsorted(first, offsets)]
        return flat, bounds


_caches: dict[str, Words] = {}


def words_of(path: str) -> Words:
    """The cache of this worker, kept from task to task."""
    if path not in _caches:
        _caches.clear()
        _caches[path] = Words(path)
    return _caches[path]


def row_groups(column: pa.Array, size: int = GROUP_BYTES):
    """(first row, bytes, offsets) of rows in groups of about ``size`` bytes."""
    data, at = utf8(column)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, min(len(column), int(np.searchsorted(at, at[lo] + size, "right")) - 1))
        yield lo, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def _tokens(docs: DataFrame, path: str, end: int) -> DataFrame:
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches):
        words, part = words_of(path), TaskContext.get().partitionId()
        before: dict[str, int] = {}
        for batch in batches:
            for lo, data, offsets in row_groups(batch.column(2)):
                ids, ends = words.encode(data, offsets)
                n = np.diff(ends) + 1
                keys = batch.column(1).slice(lo, len(n)).to_pylist()
                own, blobs = [], []
                for i, k in enumerate(keys):
                    own.append(before.get(k, 0))
                    before[k] = own[-1] + int(n[i])
                    blobs.append(np.append(ids[ends[i] : ends[i + 1]], np.uint32(end)).astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(n)), pa.array(keys, pa.string()), pa.array([part] * len(n), pa.int32()), pa.array(own, pa.int64()), pa.array(n), pa.array(blobs, pa.binary())], ["id", "queue", "part", "before", "n", "ids"])

    return docs.mapInArrow(run, f"id {kind}, queue string, part int, before long, n long, ids binary")


def queues(totals: list[tuple[str, int]], rest: int, length: int) -> tuple[dict[str, int], list[int]]:
    """The queue of each named source, and the queues' tokens; the last queue takes all other sources.

    totals: the largest sources, in descending order; rest: tokens of the others.
    """
    whole = sum(n for _, n in totals) + rest
    named = [(k, n) for k, n in totals if n * length >= whole]
    rest = whole - sum(n for _, n in named)
    while rest and named and rest * length < whole:
        rest += named.pop()[1]
    return {k: i for i, (k, _) in enumerate(named)}, [*(n for _, n in named), rest]


def phases(totals: list[int], weights: list[float] | None, length: int) -> np.ndarray:
    """Tokens of each queue in each phase. All phases but the last fill whole windows."""
    left, out = list(totals), []
    while weights is not None and sum(left) > length:
        live = [i for i, n in enumerate(left) if n and weights[i] > 0]
        if len(live) < 2:
            break
        total = sum(weights[i] for i in live)
        size = int(min(left[i] * total / weights[i] for i in live)) // length * length
        if size < length:
            size = length
        quota = [min(left[i], int(size * weights[i] / total)) if i in live else 0 for i in range(len(left))]
        for i in live:  # what is too little for another phase goes now
            if left[i] - quota[i] < length * weights[i] / total:
                quota[i] = left[i]
        missing = -sum(quota) % length
        for i in sorted(range(len(left)), key=lambda i: quota[i] - left[i]):
            more = min(missing, left[i] - quota[i])
            quota[i], missing = quota[i] + more, missing - more
        if missing:
            break
        out.append(quota)
        left = [a - b for a, b in zip(left, quota, strict=True)]
    if sum(left) or not out:
        out.append(left)
    return np.array(out, dtype=np.int64)


class Schedule:
    """Closed form of the round-robin over one or more phases."""

    def __init__(self, totals: np.ndarray, length: int) -> None:
        self.totals, self.length = totals, length
        self.sums = totals.sum(axis=1)
        self.starts = np.concatenate([np.zeros((1, totals.shape[1]), np.int64), np.cumsum(totals, axis=0)])
        self.first = np.concatenate([[0], np.cumsum(-(-self.sums // length))])

    def given(self, phase: int, windows: np.ndarray) -> np.ndarray:
        """Tokens of each queue in the first so many windows of a phase."""
        own, total = self.totals[phase], int(self.sums[phase])
        n = np.minimum(windows * self.length, total)
        if total >= 3_000_000_000:  # products would not fit 64 bits
            product = n.astype(object)[:, None] * own.astype(object)[None, :]
            low, rest = (product // total).astype(np.int64), (product % total).astype(np.int64)
        else:
            low, rest = np.divmod(n[:, None] * own[None, :], max(1, total))
        rank = np.argsort(np.argsort(-rest, axis=1, kind="stable"), axis=1, kind="stable")
        return low + (rank < (n - low.sum(axis=1))[:, None])

    def pieces(self, queue: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """(document, place in its queue, length, sequence, offset) of the pieces of documents at places of their queues."""
        out = []
        lot = max(16, 2048 * 256 // max(256, self.totals.shape[1]))
        for phase in range(len(self.totals)):
            a = np.maximum(start, self.starts[phase][queue]) - self.starts[phase][queue]
            b = np.minimum(start + size, self.starts[phase + 1][queue]) - self.starts[phase][queue]
            doc = np.flatnonzero(b > a)
            doc = doc[np.argsort(a[doc] / self.totals[phase][queue[doc]], kind="stable")]  # neighbours share windows
            for lo in range(0, len(doc), lot):
                out += self._in_phase(phase, doc[lo : lo + lot], queue, a, b)
        if not out:
            return tuple(np.zeros(0, np.int64) for _ in range(5))
        doc, at, n, window, offset = (np.concatenate(x) for x in zip(*out, strict=True))
        return doc, at, n, window, offset

    def _in_phase(self, phase: int, doc, queue, a, b):
        own, total = self.totals[phase][queue[doc]], int(self.sums[phase])
        # the window of a place is within two tokens' worth of its share's; the doubles are exact enough for that
        slack = 3 + 2 * (total // (own * self.length))
        low = np.maximum(0, (a[doc].astype(float) * total / own / self.length).astype(np.int64) - slack)
        high = np.minimum(-(-total // self.length), (b[doc].astype(float) * total / own / self.length).astype(np.int64) + slack + 1)
        n = high - low
        who = np.repeat(np.arange(len(doc)), n)
        window = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        order = np.argsort(window, kind="stable")
        step = max(64, (1 << 21) // self.totals.shape[1])  # windows at a time, so that memory is bounded for many queues
        cuts = np.searchsorted(window[order], np.unique(window)[::step]) if len(order) else []
        return [self._in_windows(phase, doc, queue, a, b, who[part], window[part]) for part in np.split(order, cuts[1:])]

    def _in_windows(self, phase: int, doc, queue, a, b, who, window):
        distinct, inverse = np.unique(window, return_inverse=True)
        before, after = self.given(phase, distinct), self.given(phase, distinct + 1)
        ahead = np.cumsum(after - before, axis=1) - (after - before)
        q = queue[doc[who]]
        from_, to = np.maximum(a[doc[who]], before[inverse, q]), np.minimum(b[doc[who]], after[inverse, q])
        some = np.flatnonzero(to > from_)
        who, inverse, q = who[some], inverse[some], q[some]
        offset = ahead[inverse, q] + from_[some] - before[inverse, q]
        return doc[who], from_[some] + self.starts[phase][q], to[some] - from_[some], window[some] + self.first[phase], offset


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", source_col: str | None = "source", length: int = LENGTH, end: int = END, targets: dict[str, float] | None = None, with_ids: bool = False) -> DataFrame:
    """One row for each piece: ``id_col``, start, length, ids_crc32, doc_tokens, sequence_id, offset; ``with_ids`` adds the ids.

    tokenizer is the path of a ``tokenizers`` file that every executor can read. A document is its ids and then ``end``; a
    null or empty text is ``end`` alone. A null source is a source of its own. targets gives weights by source (others count
    0 and come last). Rows with equal or null ids are packed one by one; their pieces differ in sequence_id and offset.
    Other columns are ignored. An empty table gives no rows. The last sequence alone can be shorter than ``length``.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    kind = docs.schema[id_col].dataType.simpleString()
    source = F.col(source_col).cast("string") if source_col else F.lit("all")
    key = F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))
    rows = docs.select(F.col(id_col).alias("id"), key.alias("queue"), F.col(text_col).cast("string").alias("text"))
    tokens = scratch.save(_tokens(rows, tokenizer, end), "tokens", compression="zstd")
    by_part = scratch.save(tokens.groupBy("queue", "part").agg(F.sum("n").alias("n")), "totals")
    by_queue = by_part.groupBy("queue").agg(F.sum("n").alias("n"))
    whole = by_part.agg(F.sum("n")).first()[0] or 0
    named = F.col("n") >= F.lit(-(-whole // length))
    positive = {k: w for k, w in (targets or {}).items() if w > 0}
    wanted = ["s" + k for k, w in positive.items() if w * length >= sum(positive.values())]
    largest = [(r.queue, r.n) for r in by_queue.where(named).orderBy(F.desc("n"), "queue").collect()]  # at most length of them
    place, totals = queues(largest, whole - sum(n for _, n in largest), length)
    if small := [k for k in wanted if k not in place]:  # at most length of these too
        more = [(r.queue, r.n) for r in by_queue.where(F.col("queue").isin(small)).orderBy("queue").collect()]
        totals = [*totals[:-1], *(n for _, n in more), totals[-1] - sum(n for _, n in more)]
        place |= {k: len(place) + i for i, (k, _) in enumerate(more)}
    weights = None
    if targets is not None:
        weights = [targets.get(k[1:], 0.0) if k[0] == "s" else 0.0 for k in place] + [0.0]
    own = spark.sparkContext.broadcast(Schedule(phases(totals, weights, length), length))
    number = F.create_map(*[F.lit(x) for pair in place.items() for x in pair]) if place else None
    q = F.coalesce(number[F.col("queue")] if place else F.lit(None).cast("int"), F.lit(len(place)))
    ahead = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_part.select("queue", "part", q.alias("q"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"), F.sum("n").over(Window.partitionBy("queue")).alias("all"))
    joined = tokens.join(bases, ["queue", "part"]).withColumn("at", F.col("base") + F.col("before"))
    placed = joined.where(F.col("q") < len(place)).select("id", "q", "at", "n", "ids")
    if totals[-1]:  # pooled sources: each is spread evenly over the pool, from a start by its name
        lots = int(min(4096, max(1, totals[-1] >> 20)))
        start = (F.xxhash64("queue") % 1000003 + 1000003) % 1000003 / 1000003.0
        pool = joined.where(F.col("q") == len(place)).withColumn("_key", (F.col("at") + start * F.col("n")) / F.col("all"))
        pool = pool.withColumn("_lot", F.least(F.lit(lots - 1), F.floor(F.col("_key") * lots).cast("int")))
        sizes = pool.groupBy("_lot").agg(F.sum("n").alias("_size"))
        sizes = sizes.select("_lot", F.coalesce(F.sum("_size").over(Window.orderBy("_lot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
        within = Window.partitionBy("_lot").orderBy("_key", "queue", "at").rowsBetween(Window.unboundedPreceding, -1)
        own_place = F.col("_base") + F.coalesce(F.sum("n").over(within), F.lit(0))
        placed = placed.unionByName(pool.join(F.broadcast(sizes), "_lot").select("id", "q", own_place.alias("at"), "n", "ids"))

    def run(batches):
        for batch in batches:
            q, at, n = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2, 3))
            doc, place, size, sequence, offset = own.value.pieces(q, at, n)
            order = np.lexsort((place, doc))
            doc, start, size, sequence, offset = doc[order], (place - at[doc])[order], size[order], sequence[order], offset[order]
            blobs = batch.column(4).to_pylist()
            for lo in range(0, len(doc), 20000):
                part = slice(lo, lo + 20000)
                cut = [blobs[d][4 * a : 4 * (a + k)] for d, a, k in zip(doc[part].tolist(), start[part].tolist(), size[part].tolist(), strict=True)]
                columns = [batch.column(0).take(pa.array(doc[part])), pa.array(start[part]), pa.array(size[part]), pa.array([zlib.crc32(x) for x in cut], pa.int64()), pa.array(n[doc[part]]), pa.array(sequence[part]), pa.array(offset[part])]
                names = ["_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
                if with_ids:
                    flat = pa.array(np.frombuffer(b"".join(cut), "<u4").astype(np.int32))
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size[part])]).astype(np.int32)), flat))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    ids = ", ids array<int>" if with_ids else ""
    return placed.mapInArrow(run, f"_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long{ids}").withColumnRenamed("_id", id_col)
