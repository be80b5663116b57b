"""Removal of passages of 50 words and more that documents share.

The suffixes of all documents, cut off after 50 words (*windows*), form a tree over words. Its nodes at depth 50 that suffixes
of several documents reach are the repeated windows, and stretches of neighbouring ones are the maximal repeats. The tree is
built in parts, each from the words themselves (:class:`Subtree`):

- A window's *anchor* is the ten-word gram with the smallest hash in it (the leftmost of equals), a property of the window's
  words alone, and stands in for its first words: equal windows have equal anchors, and windows with different anchors are in
  different subtrees. Neighbours share an anchor for some 20 words, and travel as one *run* of text, where suffixes grouped by
  their first words would each need their own 50 words.
- Anchors that one document alone has can't lead to a repeat. A first pass counts the documents of anchors, and returns bitmaps
  of fixed size of those that several documents have, and of *hot* ones that ``HOT`` have. Bits may be set for other anchors too.
- The prefix of a hot anchor's windows is lengthened to all their words: a second pass counts these windows by a fingerprint,
  dealt by it, so that only windows that several documents have travel, each to a group of its own. So no group grows with the
  number of documents that have a line in common.
- Groups are blocks of anchors, by leading bits of the hash whose number follows the number of input partitions. A block of more
  than ``TOGETHER`` windows is taken in parts by further bits. Within as many windows of a task, those that a smaller
  document among them has too are decided at once, and only the others travel.

Hashes choose groups and candidates. What is removed is decided by the words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanthorn.llm.blocks import Bits, block_bits, by_key, flags, in_blocks, inner_hash, records
from lanthorn.llm.scratch import Scratch
from lanthorn.llm.textcore import NON_SPACE, Group, groups, mix, row_grams, utf8

WINDOW = 50
GRAM = 10
#: Windows of so many that a task looks at together before it sends them on.
TOGETHER = 1 << 18
#: An anchor of so many documents is hot.
HOT = 1 << 10


def _least(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The least of each ``width`` consecutive values, and its first place."""
    n = len(values) - width + 1
    low, at, span = values, np.arange(len(values)), 1

    def join(step: int, size: int):
        later = low[step : step + size] < low[:size]
        return np.where(later, low[step : step + size], low[:size]), np.where(later, at[step : step + size], at[:size])

    while span * 2 <= width:
        low, at = join(span, len(low) - span)
        span *= 2
    return join(width - span, n) if width > span else (low[:n], at[:n])


def windows(group: Group, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each window within a row: its first word, its anchor's hash, its anchor's place, and its fingerprint."""
    marks, at = row_grams(group.hashes, group.ptr, window)
    if not len(at):
        none = np.zeros(0, np.uint64)
        return np.zeros(0, np.int64), none, np.zeros(0, np.int64), none
    grams = np.full(len(group.hashes), np.iinfo(np.uint64).max, np.uint64)
    values, where = row_grams(group.hashes, group.ptr, gram, salt=17)
    grams[where] = values
    low, place = _least(grams, window - gram + 1)
    return at, mix(low[at]), place[at], marks  # least hashes are small, so mixed again they spread over the blocks


def _runs(at: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and length of the runs of neighbouring windows with one anchor."""
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (place[1:] != place[:-1])])
    first = np.flatnonzero(new)
    return first, np.diff(np.concatenate([first, [len(at)]]))


def signatures(group: Group) -> np.ndarray:
    """A hash of each row's words, which tells rows with one id apart."""
    sums = np.zeros(len(group.hashes) + 1, np.uint64)
    place = np.arange(len(group.hashes)) - np.repeat(group.ptr[:-1], group.counts)
    np.cumsum(mix(group.hashes ^ mix(place.astype(np.uint64))), out=sums[1:])
    return mix(sums[group.ptr[1:]] - sums[group.ptr[:-1]] + group.counts.astype(np.uint64)).view(np.int64)


class Subtree:
    """The part of the tree that some runs of text span; runs are of ``size`` windows, and each word ends with a space.

    ``node`` is the node at depth ``window`` of each window, ``place`` its first word, ``at`` the byte offsets of words. Suffixes
    are ranked by their first 1, 2, 4, ... words: ranks of pairs of ranks, which start from the distinct words. Equal ranks at a
    depth are a node of that depth.
    """

    def __init__(self, text: bytes, size: np.ndarray, window: int) -> None:
        self.at = np.concatenate([[0], np.flatnonzero(np.frombuffer(text, np.uint8) == 32) + 1]).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(self.at) - 1, [None, pa.py_buffer(self.at), pa.py_buffer(text)])
        rank, depth = words.dictionary_encode().indices.to_numpy().astype(np.uint64), 1
        while depth < window:
            step = min(depth, window - depth)
            pair = rank << np.uint64(32)
            pair[:-step] |= rank[step:]
            rank = np.unique(pair, return_inverse=True)[1].astype(np.uint64)
            depth += step
        size = size.astype(np.int64)
        before = np.cumsum(size) - size
        self.place = np.arange(int(size.sum())) + np.repeat(np.arange(len(size)) * (window - 1), size)
        self.inside = np.arange(len(self.place)) - np.repeat(before, size)
        self.run = np.repeat(np.arange(len(size)), size)
        self.node = rank[self.place]


def _spaced(group: Group) -> tuple[bytes, np.ndarray]:
    """A group's words, each with a space after it, and their offsets."""
    at = np.concatenate([[0], np.cumsum(group.ends - group.starts + 1)])
    out, letter = np.full(at[-1], 32, np.uint8), np.ones(at[-1], bool)
    letter[at[1:] - 1] = False
    out[letter] = group.data[NON_SPACE[group.data]]
    return out.tobytes(), at


_SEEN = np.dtype([("hash", "<u4"), ("doc", "<i8"), ("n", "<u4")])


def _shared(docs: DataFrame, bits: int, pick, most: int, together: int) -> tuple:
    """Broadcast bitmaps of hashes that several documents have, and that ``most`` have; ``pick`` gives a group's hashes and word places."""

    def seen(hashes, doc):
        """The least and the largest document of each hash, and the number of documents with the former."""
        order = np.lexsort((doc, hashes))
        hashes, doc = hashes[order], doc[order]
        lead = np.ones(len(hashes), bool)
        lead[1:] = hashes[1:] != hashes[:-1]
        fresh = lead.copy()
        fresh[1:] |= doc[1:] != doc[:-1]
        first = np.flatnonzero(lead)
        last = np.concatenate([first[1:], [len(hashes)]])[: len(first)] - 1
        count = np.add.reduceat(fresh.astype(np.uint32), first)
        wide = last[doc[last] != doc[first]]
        key = np.concatenate([hashes[first], hashes[wide]])
        entry = np.zeros(len(key), _SEEN)
        entry["hash"], entry["doc"] = inner_hash(key, bits), np.concatenate([doc[first], doc[wide]])
        entry["n"][: len(first)] = count
        return records(["block", "blob"], in_blocks(key, bits, entry), [pa.int32(), pa.binary()])

    def send(batches):
        held, n = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for group in groups(batch.column(1), NON_SPACE):
                hashes, at = pick(group)
                doc = ids[group.lo + np.searchsorted(group.ptr, at, "right") - 1].astype(np.int64)
                new = np.ones(len(hashes), bool)  # neighbours share anchors
                new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
                held.append((hashes[new], doc[new]))
                n += int(new.sum())
                if n >= together:
                    yield from seen(*(np.concatenate(c) for c in zip(*held, strict=True)))
                    held, n = [], 0
        if n:
            yield from seen(*(np.concatenate(c) for c in zip(*held, strict=True)))

    def count(batches):
        def rows():
            for block, blobs in by_key(batches):
                entry = np.concatenate([np.frombuffer(b, _SEEN) for b in blobs])
                entry = entry[np.argsort(entry["hash"], kind="stable")]
                first = np.flatnonzero(np.concatenate([[True], entry["hash"][1:] != entry["hash"][:-1]]))
                several = np.minimum.reduceat(entry["doc"], first) != np.maximum.reduceat(entry["doc"], first)
                hot = np.add.reduceat(entry["n"].astype(np.int64), first) >= most
                yield block, flags(entry["hash"][first[several]], bits), flags(entry["hash"][first[several & hot]], bits) if (several & hot).any() else None

        yield from records(["block", "several", "hot"], rows(), [pa.int32(), pa.binary(), pa.binary()], 16)

    spread = docs.mapInArrow(send, "block int, blob binary").repartition(max(8, (1 << bits) // 2), "block").sortWithinPartitions("block")
    got = spread.mapInArrow(count, "block int, several binary, hot binary").collect()  # 16 MB in all
    several, hot = {r.block: bytes(r.several) for r in got}, {r.block: bytes(r.hot) for r in got if r.hot is not None}
    return tuple(docs.sparkSession.sparkContext.broadcast(Bits(bits, x) if x else None) for x in (several, hot))


def _first_of(node: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether each window is in the smallest document of its node."""
    order = np.lexsort((doc, node))
    new = np.concatenate([[True], node[order][1:] != node[order][:-1]])
    least = doc[order][np.flatnonzero(new)]
    out = np.empty(len(doc), bool)
    out[order] = doc[order] == least[np.cumsum(new) - 1]
    return out


def _stretches(flag: np.ndarray, start: np.ndarray, owner: np.ndarray):
    """(owner, start, length) of neighbouring flagged windows."""
    at = np.flatnonzero(flag)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.concatenate([[True], (owner[at][1:] != owner[at][:-1]) | (start[at][1:] != start[at][:-1] + 1)])
    first = np.flatnonzero(new)
    return owner[at][first], start[at][first], np.diff(np.concatenate([first, [len(at)]]))


_HEAD = np.dtype([("key", "<u8"), ("doc", "<i8"), ("sig", "<i8"), ("start", "<i4"), ("size", "<i4"), ("bytes", "<i8")])
_COVER = ["doc", "sig", "start", "size"]
_COVER_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]


def _joined(text: bytes, begin: np.ndarray, end: np.ndarray) -> bytes:
    view = memoryview(text)
    return b"".join([view[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)])


def _covers(flag: np.ndarray, head: np.ndarray, tree: Subtree):
    """doc, sig, start, size of stretches of flagged windows."""
    owner, begin, size = _stretches(flag, head["start"][tree.run] + tree.inside, tree.run)
    return [pa.array(head["doc"][owner]), pa.array(head["sig"][owner]), pa.array(begin.astype(np.int32)), pa.array(size.astype(np.int32))]


def covers(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, many: int = HOT, together: int = TOGETHER) -> DataFrame:
    """(doc, sig, start, size): stretches of windows, from word ``start`` on, that start in a smaller document too.

    docs has an integer ``id`` and ``text``. ``many`` documents make an anchor hot, and ``together`` windows are held at a time;
    neither changes the result.
    """
    bits = block_bits(docs)

    def anchors(group):
        at, low, _, _ = windows(group, window, gram)
        return low, at

    shared, hot = _shared(docs, bits, anchors, many, together)
    if shared.value is None:
        return docs.sparkSession.createDataFrame([], "doc long, sig long, start int, size int")
    again = None
    if hot.value is not None:

        def hot_windows(group):
            at, low, _, mark = windows(group, window, gram)
            some = hot.value.test(low)
            return mark[some], at[some]

        again, _ = _shared(docs, bits, hot_windows, many, together)

    def send(batches):
        parts, n = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for group in groups(batch.column(1), NON_SPACE):
                at, low, place, mark = windows(group, window, gram)
                keep = np.flatnonzero(shared.value.test(low))
                single = np.zeros(len(keep), bool)
                if again is not None:
                    single = hot.value.test(low[keep])
                    stay = ~single | (again.value.test(mark[keep]) if again.value is not None else False)
                    keep, single = keep[stay], single[stay]
                if not len(keep):
                    continue
                at, low, place, mark = at[keep], low[keep], place[keep], mark[keep]
                first, size = _runs(at, place)
                row = np.searchsorted(group.ptr, at[first], "right") - 1
                text, byte = _spaced(group)
                head = np.empty(len(first), _HEAD)
                head["key"], head["doc"], head["sig"] = low[first], ids[group.lo + row], signatures(group)[row]
                head["start"], head["size"] = at[first] - group.ptr[row], size
                begin, end = byte[at[first]], byte[at[first] + size + window - 1]
                head["bytes"] = end - begin
                parts.append((head, _joined(text, begin, end), mark, single))
                if (n := n + len(mark)) >= together:
                    yield from settle(parts)
                    parts, n = [], 0
        if n:
            yield from settle(parts)

    def settle(parts):
        """Decides what these runs decide among themselves, and sends the rest."""
        head, mark, single = (np.concatenate([p[i] for p in parts]) for i in (0, 2, 3))
        text = b"".join(p[1] for p in parts)
        parts.clear()
        tree = Subtree(text, head["size"], window)
        first = _first_of(tree.node, head["doc"][tree.run])
        done = _covers(~first, head, tree)
        if n := len(done[0]):
            where = pa.array((done[0].to_numpy() % (1 << bits)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([where, pa.nulls(n, pa.binary()), *done], ["block", "blob", *_COVER])
        # what is left of a run may be in several pieces; a hot anchor's windows go one by one
        keep = np.flatnonzero(first)
        run, inside = tree.run[keep], tree.inside[keep]
        new = np.concatenate([[True], (run[1:] != run[:-1]) | (inside[1:] != inside[:-1] + 1)]) | single[keep]
        begin = np.flatnonzero(new)
        lead = keep[begin]
        piece = head[tree.run[lead]]
        piece["start"] += tree.inside[lead].astype(np.int32)
        piece["size"] = np.diff(np.concatenate([begin, [len(keep)]]))
        piece["key"] = np.where(single[lead], mark[lead], piece["key"])
        low, high = tree.at[tree.place[lead]], tree.at[tree.place[lead] + piece["size"] + window - 1]
        piece["bytes"] = high - low
        block = (piece["key"] >> np.uint64(64 - bits)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        ends = np.searchsorted(block[order], np.arange((1 << bits) + 1))

        def rows():
            for b in np.flatnonzero(np.diff(ends)).tolist():
                of = order[ends[b] : ends[b + 1]]
                yield b, np.int64(len(of)).tobytes() + piece[of].tobytes() + _joined(text, low[of], high[of])

        for out in records(["block", "blob"], rows(), [pa.int32(), pa.binary()], 256):
            yield pa.RecordBatch.from_arrays([*out.columns, *(pa.nulls(len(out), t) for t in _COVER_TYPES)], ["block", "blob", *_COVER])

    def decide(batches):
        def blobs():
            for batch in batches:
                done = batch.column(1).is_null()
                if (part := batch.filter(done)).num_rows:
                    ready_rows.append(part.select(_COVER))
                if (part := batch.filter(pa.array([not x for x in done.to_pylist()]))).num_rows:
                    yield part

        ready_rows: list[pa.RecordBatch] = []
        for _, parts in by_key(blobs()):
            yield from ready_rows
            ready_rows.clear()
            heads, texts = [], []
            for blob in parts:
                n = int(np.frombuffer(blob, np.int64, 1)[0])
                heads.append(np.frombuffer(blob, _HEAD, n, 8))
                texts.append(memoryview(blob)[8 + n * _HEAD.itemsize :])
            head, text = np.concatenate(heads), b"".join(texts)
            heads = texts = parts = None
            end = np.cumsum(head["bytes"])
            pieces = 1 << max(0, int(head["size"].sum(dtype=np.int64)) // together).bit_length()
            part_of = (head["key"] << np.uint64(bits)) >> np.uint64(64 - pieces.bit_length() + 1) if pieces > 1 else np.zeros(len(head), np.uint64)
            for k in range(pieces):
                some = np.flatnonzero(part_of == k)
                own = head[some]
                if not len(some) or own["doc"].min() == own["doc"].max():
                    continue
                tree = Subtree(_joined(text, end[some] - own["bytes"], end[some]), own["size"], window)
                found = _covers(~_first_of(tree.node, own["doc"][tree.run]), own, tree)
                if len(found[0]):
                    yield pa.RecordBatch.from_arrays(found, _COVER)
        yield from ready_rows

    spread = docs.mapInArrow(send, "block int, blob binary, doc long, sig long, start int, size int")
    spread = spread.repartition(max(8, (1 << bits) // 2), "block").sortWithinPartitions("block")
    return spread.mapInArrow(decide, "doc long, sig long, start int, size int")


def _whole(raw: bytes) -> Group:
    (group,) = groups(pa.array([raw], pa.binary()).cast(pa.string()), NON_SPACE)
    return group


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, with_text: bool = False, many: int = HOT, together: int = TOGETHER) -> DataFrame:
    """One row for each row of docs: ``id_col``, n_words, n_removed, kept_sha256; with ``with_text`` also kept_text.

    Words that are in a window which also starts in a document with a smaller id are removed, judged on the input. Ids are
    integers. Null and empty texts have no words. Rows with the same id don't remove each other's words. Rows with a null id
    keep all words and remove none elsewhere. Other columns are ignored; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "substrings")
    kind = docs.schema[id_col].dataType.simpleString()
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    known = docs.where("id IS NOT NULL").select(F.col("id").cast("long").alias("id"), "text")
    found = scratch.save(covers(known, window, gram, many, together), "covers")
    per_doc = found.groupBy("doc").agg(F.collect_list(F.struct("sig", "start", "size")).alias("covers"))
    joined = docs.join(per_doc, F.col("id").cast("long") == F.col("doc"), "left").select("id", "text", "covers")

    def cut(batches):
        for batch in batches:
            data, at = utf8(batch.column(1))
            whole, out = memoryview(data), [[], [], [], []]
            for i, own in enumerate(batch.column(2).to_pylist()):
                raw = whole[at[i] : at[i + 1]].tobytes()
                words = raw.split()
                kept = words
                if own:
                    sig = int(signatures(_whole(raw))[0])
                    change = np.zeros(len(words) + 1, np.int64)
                    for c in own:
                        if c["sig"] == sig:
                            change[c["start"]] += 1
                            change[c["start"] + c["size"] - 1 + window] -= 1
                    kept = [words[j] for j in np.flatnonzero(np.cumsum(change)[:-1] == 0)]
                text = b" ".join(kept)
                for column, x in zip(out, (len(words), len(words) - len(kept), hashlib.sha256(text).hexdigest(), text.decode("utf-8", "replace") if with_text else None), strict=True):
                    column.append(x)
            columns = [batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())]
            names = ["_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                columns, names = [*columns, pa.array(out[3], pa.string())], [*names, "kept_text"]
            yield pa.RecordBatch.from_arrays(columns, names)

    text = ", kept_text string" if with_text else ""
    return joined.mapInArrow(cut, f"_id {kind}, n_words long, n_removed long, kept_sha256 string{text}").withColumnRenamed("_id", id_col)
