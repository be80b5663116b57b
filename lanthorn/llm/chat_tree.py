"""Chat formatting with a prefix tree: turns that conversations share from their start on are emitted once.

Template: a user turn is ``[INST] text [/INST]``, an assistant turn ``<s>text</s>``, any other ``<<SYS>>role`` newline
``text<</SYS>>``. In texts and roles, a backslash is doubled and the control strings ``CONTROLS`` get a backslash after their
first character; so a control string in the output always comes from the template, and escaping can be undone.

A node of the tree is one turn after a given path of turns; its key is a 128-bit hash of the path. The nodes are laid out
depth first in one stream of tokens: a parent stands before its children, and the children's subtrees one after another.
Tokens are the code points of the formatted text. Each node has

- ``start`` and ``length``: its place in the stream;
- ``position``: the position id of its first token, that is the length of its ancestors; ids go up by one from there;
- ``ancestors``: the intervals of the stream that its tokens attend to besides the tokens before them in the node itself;
- ``loss_from`` and ``loss_to``: the part of it that the loss covers, an assistant's text.

A conversation is read in one pass over its sorted turns, so none is held as a whole. Conversations are ranked by their paths, eight
bytes for each turn: whole paths, so that those that share turns to any depth are neighbours. A node belongs to the first of
its conversations, and nodes in the order (rank of that conversation, depth) are the tree depth first. Ranks and places come
from sorted ranges with prefix sums over partitions, in place of one big task; so a first turn that a third of all
conversations share costs no more than others.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lanthorn.llm.scratch import Scratch

# Strings that mean something to the template or to tokenizers used with it.
CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<unk>"]

_ESCAPE = re.compile("|".join(re.escape(c) for c in sorted([*CONTROLS, "\\"], key=len, reverse=True)))
_UNESCAPE = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def format_turn(role: str | None, text: str | None) -> tuple[str, int, int]:
    """The formatted turn, and the part of it under the loss mask."""
    role, own = role or "", escape(text or "")
    if role == "user":
        return f"[INST] {own} [/INST]", 0, 0
    if role == "assistant":
        return f"<s>{own}</s>", 3, 3 + len(own)
    return f"<<SYS>>{escape(role)}\n{own}<</SYS>>", 0, 0


def parse_turns(text: str) -> list[tuple[str, str, int, int]]:
    """(role, text, from, to) of the turns in a formatted text; from and to mark an assistant's escaped text."""
    out, at = [], 0
    while at < len(text):
        if text.startswith("[INST] ", at):
            end = text.index(" [/INST]", at + 7)
            out.append(("user", unescape(text[at + 7 : end]), 0, 0))
            at = end + 8
        elif text.startswith("<s>", at):
            end = text.index("</s>", at + 3)
            out.append(("assistant", unescape(text[at + 3 : end]), at + 3, end))
            at = end + 4
        elif text.startswith("<<SYS>>", at):
            end = text.index("<</SYS>>", at + 7)
            role, _, own = text[at + 7 : end].partition("\n")
            out.append((unescape(role), unescape(own), 0, 0))
            at = end + 8
        else:
            raise ValueError(f"no turn at {at}: {text[at : at + 20]!r}")
    return out


def _batches(rows, names: list[str], types: list[pa.DataType], most: int = 2000):
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)


def _keyed(turns: DataFrame) -> DataFrame:
    """(conv, depth, key, path, role, text) of every turn, by one pass over each conversation's sorted turns; path is whole, on the last turn alone."""

    def run(batches):
        def rows():
            conv, key, path, depth, held = None, b"", [], 0, None
            for batch in batches:
                for c, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    if held is None or c != conv:
                        if held is not None:
                            yield *held[:3], b"".join(path), *held[4:]
                        conv, key, path, depth = c, b"", [], 0
                    else:
                        yield held
                    own = hashlib.blake2b(key, digest_size=16)
                    own.update(len((role or "").encode()).to_bytes(8, "little") + (role or "").encode() + (text or "").encode())
                    key = own.digest()
                    path.append(key[:8])
                    held = (conv, depth, key, None, role or "", text or "")
                    depth += 1
            if held is not None:
                yield *held[:3], b"".join(path), *held[4:]

        yield from _batches(rows(), ["conv", "depth", "key", "path", "role", "text"], [kind, pa.int32(), pa.binary(), pa.binary(), pa.string(), pa.string()])

    kind = to_arrow_type(turns.schema["conv"].dataType)
    spread = turns.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").select("conv", "role", "text")
    return spread.mapInArrow(run, f"conv {turns.schema['conv'].dataType.simpleString()}, depth int, key binary, path binary, role string, text string")


def _ranked(turns: DataFrame) -> DataFrame:
    """(conv, rank) in the order of whole paths; a partition of the sorted range has the ranks from its number times 2^40 on."""
    kind = turns.schema["conv"].dataType.simpleString()

    def number(batches):
        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(range(at, at + len(batch)), pa.int64())], ["conv", "rank"])
            at += len(batch)

    some = turns.where("path IS NOT NULL").select("conv", "path")
    return some.repartitionByRange("path", "conv").sortWithinPartitions("path", "conv").select("conv").mapInArrow(number, f"conv {kind}, rank long")


def _laid_out(turns: DataFrame, owners: DataFrame, scratch: Scratch) -> DataFrame:
    """One row for each node with its place in the depth-first stream; owners has the rank of each node's first conversation."""
    distinct = turns.groupBy("key").agg(F.first("depth").alias("depth"), F.first("role").alias("role"), F.first("text").alias("text")).join(owners, "key")

    def place(batches):
        def rows():
            part, at = TaskContext.get().partitionId(), 0
            for batch in batches:
                for key, owner, depth, role, text in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                    formatted, a, b = format_turn(role, text)
                    yield part, at, len(formatted), a, b, key, owner, depth, formatted
                    at += len(formatted)

        yield from _batches(rows(), ["part", "at", "length", "loss_from", "loss_to", "key", "owner", "depth", "formatted"], [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.string()])

    ordered = distinct.repartitionByRange("owner", "depth").sortWithinPartitions("owner", "depth").select("key", "owner", "depth", "role", "text")
    placed = scratch.save(ordered.mapInArrow(place, "part int, at long, length long, loss_from long, loss_to long, key binary, owner long, depth int, formatted string"), "placed")
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition of the stream
    bases = placed.groupBy("part").agg(F.sum("length").alias("n")).select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    return placed.join(bases, "part").withColumn("start", F.col("base") + F.col("at")).drop("part", "at", "base")


def _walk(batches, columns: list[str]):
    """Rows sorted by conversation and depth -> each with its position and its ancestors' intervals, neighbours joined."""
    conv, begun, position, spans = None, False, 0, []
    for batch in batches:
        values = {k: batch.column(k).to_pylist() for k in columns}
        for i in range(len(batch)):
            row = {k: v[i] for k, v in values.items()}
            if not begun or row["conv"] != conv:
                conv, begun, position, spans = row["conv"], True, 0, []
            yield row, position, spans
            position += row["length"]
            a, b = row["start"], row["start"] + row["length"]
            spans = [*spans[:-1], (spans[-1][0], b)] if spans and spans[-1][1] == a else [*spans, (a, b)]


def prefix_tree(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, paths): the nodes of the tree, and for each turn (conv, depth, key) which node it is.

    Null texts and roles count as empty. Turns are ordered by turn, role and text; repeated rows are turns of their own.
    Rows with a null id are one conversation. Other columns are ignored; an empty table gives empty tables.
    """
    scratch = scratch or Scratch(conversations.sparkSession, "chat")
    turns = conversations.select(F.col(id_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    turns = scratch.save(_keyed(turns), "turns")
    ranks = scratch.save(_ranked(turns), "ranks")
    own = ranks.withColumnRenamed("conv", "_conv")
    paths = scratch.save(turns.select("conv", "depth", "key").join(own, F.col("conv").eqNullSafe(F.col("_conv"))).drop("_conv"), "paths")
    laid = scratch.save(_laid_out(turns, paths.groupBy("key").agg(F.min("rank").alias("owner")), scratch), "laid")
    # a node's ancestors come from the first of its conversations
    steps = paths.join(laid.select("key", "start", "length", "owner"), "key").withColumn("own", F.col("rank") == F.col("owner"))
    walked = steps.repartition("rank").sortWithinPartitions("rank", "depth").select(F.col("rank").alias("conv"), "key", "start", "length", "own")

    def note(batches):
        rows = ((r["key"], p, [{"start": a, "end": b} for a, b in spans]) for r, p, spans in _walk(batches, ["conv", "key", "start", "length", "own"]) if r["own"])
        yield from _batches(rows, ["key", "position", "ancestors"], [pa.binary(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))])

    notes = walked.mapInArrow(note, "key binary, position long, ancestors array<struct<start:bigint,end:bigint>>")
    nodes = laid.join(notes, "key").select(F.col("key").alias("node"), "depth", "start", "length", "position", "ancestors", "loss_from", "loss_to", "formatted")
    return scratch.save(nodes, "nodes"), paths.select("conv", "depth", "key")


def read_back(nodes: DataFrame, paths: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """What each conversation says, read from the nodes: digests of its turns and of the text under the loss mask."""
    kind, arrow = paths.schema["conv"].dataType.simpleString(), to_arrow_type(paths.schema["conv"].dataType)
    steps = paths.join(nodes.select(F.col("node").alias("key"), "start", "length", "position", "formatted", "loss_from", "loss_to", "ancestors"), "key")
    steps = steps.repartition("conv").sortWithinPartitions("conv", "depth").select("conv", "start", "length", "position", "formatted", "loss_from", "loss_to", F.expr("aggregate(ancestors, 0L, (n, x) -> n + x.end - x.start)").alias("seen"))

    def digest(batches):
        def rows():
            last = None
            for row, position, spans in _walk(batches, ["conv", "start", "length", "position", "formatted", "loss_from", "loss_to", "seen"]):
                if last is None or not spans:
                    if last is not None:
                        yield finish(last)
                    last = [row["conv"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                if row["position"] != position or row["seen"] != position:
                    raise ValueError("a node's position or attention intervals don't match its path")
                text = row["formatted"]
                for role, own, _, _ in parse_turns(text):
                    last[1] += 1
                    last[2].update(f"{role}\n{own}\n".encode())
                masked = unescape(text[row["loss_from"] : row["loss_to"]])
                last[3] += len(masked)
                last[4].update(masked.encode())
                last[5] += len(text)
            if last is not None:
                yield finish(last)

        def finish(x):
            return x[0], x[1], x[2].hexdigest(), x[3], x[4].hexdigest(), x[5]

        yield from _batches(rows(), [id_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"], [arrow, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()])

    return steps.mapInArrow(digest, f"`{id_col}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def format_conversations(conversations: DataFrame, id_col: str = "conv_id", **columns: str) -> DataFrame:
    """One row for each conversation: ``id_col``, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the tree."""
    return read_back(*prefix_tree(conversations, id_col, **columns), id_col)


def with_control_case(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """The table and conversation -7, whose texts are made of control strings."""
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(more)
