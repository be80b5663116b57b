import json

import pytest

from lanthorn.functions.text import glob_regex, hash_snippet
from lanthorn.model import Allowlist, PathEntry, SnippetEntry
from lanthorn.operators.suppress import extract_directives, load_allowlist, save_allowlist
from lanthorn.plans.report import annotations, count_by_severity, markdown, read_inputs, should_fail
from lanthorn.plans.scan import scan
from lanthorn.sources.diff import parse_diff, parse_diffs
from lanthorn.sources.files import workspace_resolver

DIFF = """diff --git a/src/a.js b/src/a.js
--- a/src/a.js
+++ b/src/a.js
@@ -1,3 +1,5 @@
 one
+eval(s);
+two
 three
-gone

@@ -10,2 +11,2 @@ f
-x
+eval(t);
\\ No newline at end of file
diff --git a/new.py b/new.py
new file mode 100644
--- /dev/null
+++ b/new.py
@@ -0,0 +1,1 @@
+x = 1
diff --git a/old.py b/old.py
deleted file mode 100644
--- a/old.py
+++ /dev/null
@@ -1 +0,0 @@
-x
diff --git a/p.txt b/q.txt
similarity index 100%
rename from p.txt
rename to q.txt
"""


def test_parse_diff(spark):
    want = [("src/a.js", "modified", [(2, 3), (11, 11)]), ("new.py", "added", [(1, 1)]), ("q.txt", "modified", [])]
    assert parse_diff(DIFF) == want
    assert parse_diff(DIFF.replace("\n", "\r\n")) == want
    assert parse_diff("") == parse_diff(None) == parse_diff("--- a\n+++ b\n@@ -1 +1 @@\n+x") == []
    df = spark.createDataFrame([(1, DIFF), (2, None)], "n int, diff string")
    assert [(r.n, r.path) for r in parse_diffs(df, "n", "diff").collect()] == [(1, "src/a.js"), (1, "new.py"), (1, "q.txt")]


def test_diff_scan_keeps_added_lines(spark):
    text = "one\neval(s);\ntwo\nthree\neval(old);\n6\n7\n8\n9\n10\neval(t);\n"
    contents = spark.createDataFrame([("src/a.js", text), ("q.txt", "‮")], "path string, source string")
    result = scan(spark, diff=DIFF, contents=contents)
    assert sorted(f.line for f in result.findings.collect()) == [2, 11]
    assert {r.path: r.scanned for r in result.files.collect()} == {"src/a.js": True, "new.py": False, "q.txt": True}


def test_directives(spark):
    rows = [("a.js", "eval(a); // lanthorn-disable-line\n// lanthorn-disable-next-line obf.dynamic-exec-with-non-literal, obf.x\neval(b); // another one\neval(c); // lanthorn-disable-line obf.dyn\n<!-- lanthorn-disable-line -->"), ("b.js", None), ("c.js", "")]
    files = spark.createDataFrame(rows, "path string, source string")
    assert [(r.line, r.rule_ids) for r in extract_directives(files).orderBy("line").collect()] == [(1, []), (3, ["obf.dynamic-exec-with-non-literal", "obf.x"]), (4, ["obf.dyn"]), (5, ["--"])]
    assert [f.line for f in scan(spark, files=files).findings.collect()] == [4]
    assert [f.line for f in scan(spark, files=files, directive_keyword="other").findings.collect()] == [1, 3, 4]


def test_allowlist(spark, tmp_path):
    files = spark.createDataFrame([("vendor/a.js", "eval(s);"), ("x/vendor/a.js", "eval(s);"), ("b.js", "eval(s);"), ("c.js", "eval(atob(x));"), ("d.js", "require(nm);")], "path string, source string")
    digest = spark.range(1).select(hash_snippet(__import__("pyspark.sql.functions", fromlist=["lit"]).lit(" require(nm);\n "))).first()[0]
    some = Allowlist((PathEntry("**/vendor/**"), PathEntry("c.js", max_severity="warn"), PathEntry("b.*", rule_id="obf.dynamic-exec-with-non-literal")), (SnippetEntry("obf.library-load-non-literal", digest),))
    assert [(f.file, f.severity) for f in scan(spark, files=files, allowlist=some).findings.collect()] == [("c.js", "block")]
    assert scan(spark, files=files, min_severity="block").findings.count() == 1
    assert load_allowlist(tmp_path) == Allowlist()
    save_allowlist(tmp_path, some)
    assert load_allowlist(tmp_path) == some
    (tmp_path / ".lanthorn" / "allowlist.json").write_text("[bad")
    assert load_allowlist(tmp_path) == Allowlist()


@pytest.mark.parametrize(("glob", "path", "want"), [("*.js", "a.js", True), ("*.js", "b/a.js", False), ("**/a.js", "a.js", True), ("**/vendor/**", "myvendor/x", True), ("a?.[jt]s", "ab.ts", True), ("a.js", "a.jsx", False), ("a+b.js", "a+b.js", True)])
def test_globs(spark, glob, path, want):
    assert spark.createDataFrame([(path,)], "p string").where(f"p rlike r'{glob_regex(glob)}'").count() == int(want)


def test_reports(spark):
    files = spark.createDataFrame([("a.js", "eval(atob(x));"), ("b|.js", "eval(s);")], "path string, source string")
    result = scan(spark, files=files)
    counts = count_by_severity(result.findings).first()
    assert (counts.block, counts.warn, counts.info) == (1, 1, 0)
    assert should_fail(result.findings, "block").first().failed and not should_fail(result.findings, "never").first().failed
    text = markdown(result, max_findings=1, link="https://example.com/x", duration_ms=7)
    assert "Blocking findings." in text and "1 more not shown." in text and "#L1" in text and "7 ms" in text
    assert annotations(result.findings).first().value.startswith("::error file=a.js,line=1,title=obf.decode-then-exec.javascript::")
    none = scan(spark, files=files.limit(0))
    assert "No findings." in markdown(none) and not should_fail(none.findings, "warn").first().failed


def test_inputs():
    got = read_inputs({"INPUT_FAIL-ON": "warn", "INPUT_MAX_FINDINGS": "5", "INPUT_DISABLED-DETECTORS": "a, b\nc", "INPUT_COMMENT": "No"})
    assert (got.fail_on, got.max_findings, got.disabled_detectors, got.comment, got.min_severity) == ("warn", 5, ("a", "b", "c"), False, "info")
    for bad in ({"INPUT_FAIL-ON": "x"}, {"INPUT_MAX-FINDINGS": "0"}, {"INPUT_COMMENT": "maybe"}):
        with pytest.raises(ValueError, match="must be"):
            read_inputs(bad)


def test_paths_and_directory(spark, tmp_path):
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.js").write_text("eval(s); // first\r\neval(t);")
    (tmp_path / "secret.js").write_text("eval(s);")
    read = workspace_resolver(str(tmp_path / "w"))
    assert read("../secret.js") is None and read("nothing") is None
    assert len(scan(spark, paths=["a.js", "../secret.js", "no.js"], file_resolver=read).findings.collect()) == 2
    assert [f.file for f in scan(spark, directory=str(tmp_path)).findings.collect()] == ["secret.js", "w/a.js", "w/a.js"]


def test_stream(spark, tmp_path):
    from lanthorn.streaming.watch import scan_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps({"path": "a.js", "source": "eval(s);"}) + "\n")
    out = []
    files = spark.readStream.schema("path string, source string").json(str(tmp_path / "in"))
    scan_stream(files, lambda df, n: out.extend(df.collect()), str(tmp_path / "check")).awaitTermination(60)
    assert [f.rule_id for f in out] == ["obf.dynamic-exec-with-non-literal.javascript"]


def test_public_names():
    import lanthorn

    assert all(getattr(lanthorn, name) is not None for name in lanthorn.__all__)
    with pytest.raises(AttributeError):
        lanthorn.nothing  # noqa: B018
