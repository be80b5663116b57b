"""Registered scans that have no SQL, against brute force over the findings of all rules."""

import hashlib

import pytest
from pyspark.sql import functions as F

from lanthorn.operators.rules import default_rule_set
from lanthorn.plans import queries
from lanthorn.plans.corpus import corpus
from lanthorn.plans.scan import kept_findings, raw_findings


@pytest.fixture(scope="module")
def kept(spark, data):
    files = corpus(spark, data)
    return kept_findings(files, raw_findings(files)).collect()


def key(r):
    return (-r["rank"], -r.score, r.file, r.line, r.detector_ord, r.match_ord)


def test_top_of_report(spark, data, kept):
    got = [(r.file, r.line, r.rule_id) for r in queries.top_of_report(spark, data).collect()]
    assert got == [(r.file, r.line, r.rule_id) for r in sorted(kept, key=key)[:50]] and len({r for _, _, r in got}) > 1


def test_finding_hashes(spark, data, kept):
    got = queries.finding_hashes(spark, data).collect()
    assert sorted((r.file, r.line, r.rule_id, r.digest) for r in got) == sorted((r.file, r.line, r.rule_id, hashlib.sha256(" ".join(r.snippet.split()).encode()).hexdigest()) for r in kept)


def test_annotations_of_all_rules(spark, data, kept):
    assert queries.report_annotations(spark, data).count() == len(kept)


def test_suppression_over_all_files(spark, data, kept):
    marked = {r.path for r in corpus(spark, data).where(F.col("source").contains("lanthorn-disable")).collect()}
    got = queries.suppressed_by_directive(spark, data).collect()
    assert sorted((r.file, r.line) for r in got) == sorted((r.file, r.line) for r in kept if r.file in marked)


def test_suppression_beside_a_long_line(spark, tmp_path):
    from lanthorn.plans.corpus import SNIPPETS

    at = next(i for i, x in enumerate(SNIPPETS) if x[2].endswith("lanthorn-disable-line obf.other"))
    spark.createDataFrame([(at, "word " * 600)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.suppressed_by_directive(spark, str(tmp_path)).collect()
    assert [(r.line, r.rule_id) for r in got] == [(2, "obf.dynamic-exec-with-non-literal.javascript")]


def opened(text, at):
    """Whether what follows a name lets it be a call."""
    rest = text[at : at + 400]
    return rest[:1].isspace() or rest.lstrip()[:1] in ("(", '"')


def mentions(text, names):
    """Places of names from left to right, none within another, tried at each character in turn."""
    at = 0
    while at < len(text):
        name = next((n for n in names if text.startswith(n, at) and opened(text, at + len(n))), None)
        if name:
            yield at, at + len(name)
        at += len(name) if name else 1


def inside(text, at):
    while text[at : at + 1].isspace():
        at += 1
    return at + (text[at : at + 1] in ("(", '"'))


def test_network_then_exec_over_the_corpus(spark, data):
    """Scripts: each sink that a network tool follows within 400 characters, where findings don't overlap. Others: the planted lines."""
    want = set()
    for r in corpus(spark, data).collect():
        if r.path.endswith(".sh"):
            tools, done = list(mentions(r.source, default_rule_set().config_for("bash").network_io)), 0
            for start, end in mentions(r.source, default_rule_set().config_for("bash").dynamic_exec_sinks):
                low = inside(r.source, end)
                used = [b for a, b in tools if low <= a <= low + 400]
                if start >= done and used:
                    done = inside(r.source, used[0])
                    want.add((r.path, 1 + r.source[:start].count("\n")))
        for n, line in enumerate(r.source.split("\n"), 1):
            if line in ("eval(await (await fetch(url)).text());", "const body = fetch(url); eval(body);"):
                want.add((r.path, n))
    got = queries.queries()["rule_network_then_exec"](spark, data).collect()
    assert sorted((r.file, r.line) for r in got) == sorted(want) and len({r.rule_id for r in got}) == 2
