"""Secret scan: three fixed patterns, and strings that a primed compressor can't shorten.

For the second part, candidates are all unbroken runs of 20 or more base64-like characters in a line that holds a sensitive word
(at any distance), and those of 8 or more that start within 40 bytes of such a word, or of the end of the identifier that holds it,
line ends included. A candidate's *marginal bytes* are the size
that it adds to the zstandard frame of its surroundings, with a dictionary of common identifiers. What costs at least
``least_ratio`` bytes for each of its own (0.02 more for each byte that a run is shorter than 20) is reported as kind ``novel``:
words, identifiers, paths and strings that occur nearby cost far less than random ones. Runs that are nothing but words (letters of one case, a capital first, marks between) are left alone if they
are shorter than 20 or farther away: letters cost a frame this small the same in any order.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from lanthorn.llm.scratch import ready
from lanthorn.llm.textcore import utf8

ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "novel")

# Words after which a string may be a secret.
SENSITIVE = ["key", "secret", "token", "auth", "bearer", "credential", "private", "passphrase", "password", "passwd", "pwd", "signature", "cookie", "session"]
# The identifier dictionary.
IDENTIFIERS = [
    "function", "return", "import", "export", "default", "class", "public", "private", "protected", "static", "const", "string", "number", "boolean", "undefined", "interface", "implements", "extends", "package",
    "exception", "override", "abstract", "async", "await", "require", "module", "prototype", "constructor", "self", "print", "length", "index", "value", "values", "items", "append", "insert", "select", "update", "delete",
    "create", "table", "where", "order", "group", "configuration", "config", "settings", "environment", "request", "response", "headers", "content", "authorization", "application", "connection", "database", "username",
    "password", "token", "secret", "session", "cookie", "credentials", "access", "client", "server", "service", "handler", "controller", "repository", "manager", "factory", "builder", "provider", "context", "options",
    "parameters", "arguments", "callback", "promise", "observable", "subscribe", "listener", "event", "element", "document", "window", "component", "template", "render", "state", "props", "button", "container", "wrapper",
    "https://", "http://", "www.", ".com/", ".org/", "index.html", "node_modules", "src/main/java", "the", "and", "for", "with", "that",
]

_SENSITIVE = re.compile(rb"(?i:" + "|".join(SENSITIVE).encode() + rb")")
_REACH, _SHORTEST, _USUAL = 40, 8, 20
_REST = re.compile(rb"[A-Za-z0-9+/_.-]*")
_WORDS = re.compile(rb"[A-Za-z]?(?:[a-z]*|[A-Z]*)(?:[/_.+-]+[A-Za-z]?(?:[a-z]*|[A-Z]*))*")
_LONG = re.compile(rb"[A-Za-z0-9+/][A-Za-z0-9+/_.-]{%d,}={0,2}" % (_USUAL - 1))
_RUN = re.compile(rb"[A-Za-z0-9+/][A-Za-z0-9+/_.-]{%d,}={0,2}" % (_SHORTEST - 1))
_LIKELY = tuple(w.encode() for w in SENSITIVE)
_START = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

_tools: dict[str, object] = {}


def _compressor() -> zstandard.ZstdCompressor:
    if "c" not in _tools:
        text = "\n".join(IDENTIFIERS) + "\n" + " ".join(w.capitalize() for w in IDENTIFIERS) + "\n" + " ".join(w.upper() for w in IDENTIFIERS)
        primed = zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        _tools["c"] = zstandard.ZstdCompressor(level=6, dict_data=primed, write_checksum=False, write_content_size=False)
    return _tools["c"]


def marginal_bytes(raw: bytes, start: int, end: int, around: int = 256) -> int:
    """The bytes that raw[start:end] adds to the compressed form of what stands around it."""
    own, near = _compressor(), raw[max(0, start - around) : start] + b"\n" + raw[end : end + around]
    return max(0, len(own.compress(near + b"\n" + raw[start:end])) - len(own.compress(near)))


def _candidates(raw: bytes) -> list[tuple[list[int], int]]:
    """Every run in the reach of a sensitive word: where it starts, also behind the last such word in it, and its end.

    After these, the long runs of lines with such a word, that aren't nothing but words.
    """
    out: list[tuple[list[int], int]] = []
    lines: list[tuple[int, int]] = []
    done = rest = 0
    for word in _SENSITIVE.finditer(raw):
        at = word.end()
        if not lines or at > lines[-1][1]:
            end = raw.find(b"\n", at)
            lines.append((raw.rfind(b"\n", 0, word.start()) + 1, len(raw) if end < 0 else end))
        if at > rest:
            rest = _REST.match(raw, at).end()
        if at < done:  # in a run already taken
            near = raw[at : at + _SHORTEST]
            out[-1] = ([out[-1][0][0], at + len(near) - len(near.lstrip(b"_.-"))], done)
        at, stop = max(at, done), min(len(raw), rest + _REACH + _SHORTEST)
        while m := _RUN.search(raw, at, stop):
            m = _RUN.match(raw, m.start())
            out.append(([m.start()], m.end()))
            at = done = m.end()
    taken, near = {a for starts, _ in out for a in starts}, sorted((starts[0], end) for starts, end in out)
    k = 0
    for a, b in lines:
        for m in _LONG.finditer(raw, a, b):
            while k < len(near) and near[k][1] <= m.start():
                k += 1
            if m.start() not in taken and not (k < len(near) and near[k][0] < m.end()) and not _WORDS.fullmatch(raw, m.start(), m.end()):
                out.append(([m.start()], m.end()))
    return out


def _least(size: int, least_ratio: float) -> float:
    """Short strings must cost more for each byte: what any new match or literal run costs weighs more in them."""
    return least_ratio + 0.02 * max(0, _USUAL - size)


def find(raw: bytes, least_ratio: float = 0.62) -> list[tuple[int, int, str, int]]:
    """(start, end, kind, marginal bytes) of the secrets in a UTF-8 text, by start and then kind; places are bytes."""
    low, out = raw.lower(), []
    if any(w in low for w in _START):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(raw) if len(m[1]) >= 6]
    if b"AKIA" in raw:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(raw) if len(m[0]) >= 20]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(raw)]
    spans = [(a, b, k, marginal_bytes(raw, a, b)) for a, b, k in out]
    if any(w in low for w in _LIKELY):
        for starts, b in _candidates(raw):
            for a in starts:
                if b - a >= _SHORTEST and not (b - a < _USUAL and _WORDS.fullmatch(raw, a, b)) and not any(x <= a and b <= y for x, y, _ in out) and (cost := marginal_bytes(raw, a, b)) >= _least(b - a, least_ratio) * (b - a):
                    spans.append((a, b, "novel", cost))
                    break
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def _texts(column: pa.Array):
    data, at = utf8(column)
    whole = memoryview(data)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield whole[a:b].tobytes()


def _in_code_points(raw: bytes, spans: list[tuple[int, int, str, int]]) -> list[tuple[int, int, str, int]]:
    if not spans or raw.isascii():
        return spans
    place = {b: 0 for s in spans for b in s[:2]}
    last = n = 0
    for b in sorted(place):
        n += len(raw[last:b].decode("utf-8", "replace"))
        place[b], last = n, b
    return [(place[a], place[b], k, c) for a, b, k, c in spans]


def _joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k, _ in spans)


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_ratio: float = 0.62) -> DataFrame:
    """One row for each row of docs: ``id_col``, n_assign, n_access, n_hex, n_novel, base_sha256, spans, marginal_bytes.

    Spans are kind:start:end in code points, end exclusive; marginal_bytes has one number for each span. Null and empty texts
    have none (base_sha256 is the digest of the empty string). Other columns are ignored, repeated rows each get a row.
    """
    ready(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            counts, base, joined, costs = [[], [], [], []], [], [], []
            for raw in _texts(batch.column(1)):
                spans = _in_code_points(raw, find(raw, least_ratio))
                for c, k in zip(counts, KINDS, strict=True):
                    c.append(sum(s[2] == k for s in spans))
                base.append(hashlib.sha256(_joined(s for s in spans if s[2] != "novel").encode()).hexdigest())
                joined.append(_joined(spans))
                costs.append([s[3] for s in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(base, pa.string()), pa.array(joined, pa.string()), pa.array(costs, pa.list_(pa.int64()))], [id_col, *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "marginal_bytes"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string, marginal_bytes array<bigint>")


def redact(docs: DataFrame, text_col: str = "text", least_ratio: float = 0.62, count_col: str | None = "n_chars") -> DataFrame:
    """The rows of docs with each secret in the text replaced by ``[REDACTED:kind]``; overlapping spans become one.

    ``count_col``, where there is such a column, gets the new number of code points of changed texts. Null texts stay null.
    """
    ready(docs.sparkSession)

    def run(batches):
        for batch in batches:
            column = batch.column(text_col)
            texts, counted = column.to_pylist(), count_col in batch.schema.names
            counts = batch.column(count_col).to_pylist() if counted else []
            for i, raw in enumerate(_texts(column)):
                if spans := find(raw, least_ratio):
                    merged: list[list] = []
                    for a, b, k, _ in spans:
                        if merged and a < merged[-1][1]:
                            merged[-1][1] = max(b, merged[-1][1])
                        else:
                            merged.append([a, b, k])
                    for a, b, k in reversed(merged):
                        raw = raw[:a] + b"[REDACTED:" + k.encode() + b"]" + raw[b:]
                    texts[i] = raw.decode("utf-8", "replace")
                    if counted:
                        counts[i] = len(texts[i])
            out = batch.set_column(batch.schema.get_field_index(text_col), batch.schema.field(text_col), pa.array(texts, column.type))
            if counted:
                out = out.set_column(out.schema.get_field_index(count_col), out.schema.field(count_col), pa.array(counts, batch.schema.field(count_col).type))
            yield out

    return docs.mapInArrow(run, docs.schema)
