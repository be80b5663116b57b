"""Time budgets for one file, as a table of one row in a warm session, by the clock; and for doubled input.

A slower or busy machine may take twice the budget.
"""

import time

import pytest

from lanthorn.plans.scan import raw_findings, scan


def seconds(spark, source: str) -> float:
    files = spark.createDataFrame([("a.js", source)], "path string, source string")
    began = time.perf_counter()
    raw_findings(files).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


@pytest.fixture(scope="module")
def warm(spark):
    for source in (plain(200) + FLOW, 'const k = "' + "Ab1+" * 50 + '"; const t = [' + ", ".join(f'"item{i:06d}"' for i in range(40)) + "];"):
        for _ in range(3):
            seconds(spark, source)  # starts the workers, compiles patterns and lets the JVM compile
    return spark


def plain(lines: int) -> str:
    return "".join(f"export function name{i}(value) {{ return value + {i}; }} // line {i}\n" for i in range(lines))


FLOW = "const d = atob(x);\neval(d);\n"
SHAPES = {
    "10,000 lines": (lambda: plain(10_000) + FLOW, 1.5),
    "20,000 lines with sinks and decoders": (lambda: plain(19_900) + FLOW * 50, 4.0),
    "one line of 100 KB": (lambda: "let x = [" + "1234," * 20_000 + "];" + FLOW, 1.5),
    "one line of 500 KB": (lambda: "let x = [" + "1234," * 100_000 + "];" + FLOW, 1.5),
    "1,024 nested calls": (lambda: "eval(" * 1024 + "atob(x)" + ")" * 1024, 1.5),
    "1 MB literal": (lambda: 'const k = "' + "Ab1+" * 250_000 + '";' + FLOW, 1.5),
    "20,000 strings": (lambda: "const t = [" + ", ".join(f'"item{i:06d}"' for i in range(20_000)) + "];" + FLOW, 1.5),
    "as many lines as a file may have": (lambda: plain(27_500) + FLOW, 8.0),
}


@pytest.mark.parametrize("shape", SHAPES)
def test_budget(warm, shape):
    make, most = SHAPES[shape]
    source = make()
    assert len(source) < 2_000_000
    assert min(seconds(warm, source) for _ in range(3)) <= 2 * most


def test_doubling(warm):
    small, large = (min(seconds(warm, plain(n) + FLOW) for _ in range(3)) for n in (2500, 5000))
    assert large <= 3.0 * small


def test_a_short_time_limit_ends(warm):
    files = warm.createDataFrame([("a.js", plain(20_000) + FLOW)], "path string, source string")
    assert scan(warm, files=files, file_timeout_ms=100).findings.count() >= 0
