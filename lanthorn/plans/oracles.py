"""SQL that says what the registered queries return, written against lines of the corpus rather than whole texts."""

from __future__ import annotations

from lanthorn.operators.rules import default_rule_set
from lanthorn.plans.corpus import corpus_sql


def _long_lines(rows: str, file: str, text: str, more: str = "") -> str:
    return f"""
    WITH lines AS (
      SELECT {file} AS file, unnest(string_split({text}, chr(10))) AS t, generate_subscripts(string_split({text}, chr(10)), 1) AS n
      FROM {rows} WHERE length({text}) > 2000 AND length({text}) < 2000000)
    SELECT file, CAST(n AS INTEGER) AS line, 'obf.long-line' AS rule_id, CASE WHEN length(t) >= 10000 THEN 'warn' ELSE 'info' END AS severity,
      CASE WHEN length(t) >= 10000 THEN 8 ELSE 5 END AS score{more}
    FROM lines WHERE length(t) >= 2000"""


def _manifests() -> str:
    """Commands of all kinds of manifests, one row for each; those that pipe a download into a shell block."""
    paths = [f"$.scripts.{h}" for h in ("preinstall", "install", "postinstall", "prepare")]
    npm = ", ".join(f"json_extract_string(source, '{p}')" for p in paths)
    hooks = ("pre-install-cmd", "post-install-cmd", "pre-update-cmd", "post-update-cmd", "post-autoload-dump")
    composer = ", ".join(f"""[json_extract_string(source, '$.scripts."{h}"')]""" for h in hooks), ", ".join(f"""json_extract_string(source, '$.scripts."{h}"[*]')""" for h in hooks)
    return f"""WITH {_lines()}, commands AS (
        SELECT path, 1 AS n, unnest([{npm}]) AS c FROM files WHERE path LIKE '%/package.json'
        UNION ALL SELECT path, 1, unnest(list_filter(flatten([{composer[0]}]), lambda c: left(c, 1) <> '[')) FROM files WHERE path LIKE '%/composer.json'
        UNION ALL SELECT path, 1, unnest(flatten([{composer[1]}])) FROM files WHERE path LIKE '%/composer.json'
        UNION ALL SELECT path, n, regexp_extract(t, 'extensions = (.*)$', 1) FROM lines WHERE path LIKE '%.gemspec'
        UNION ALL SELECT path, n, regexp_extract(t, 'type = "(command)"', 1) FROM lines WHERE path LIKE '%.rockspec'
        UNION ALL SELECT path, n, regexp_extract(t, 'build_command = "([^"]*)"', 1) FROM lines WHERE path LIKE '%.rockspec'
        UNION ALL SELECT path, n, regexp_extract(t, 'src="([^"]*install[.]ps1)"', 1) FROM lines WHERE path LIKE '%.nuspec')
      SELECT path AS file, n AS line, 'obf.manifest-install-script' AS rule_id, CASE WHEN contains(c, '| sh') THEN 'block' ELSE 'warn' END AS severity, CASE WHEN contains(c, '| sh') THEN 9 ELSE 6 END AS score
      FROM commands WHERE c <> ''"""


def _diff_ranges() -> str:
    """The ranges that the made diffs were built with."""
    kept = "FROM documents WHERE text IS NOT NULL AND doc_id % 3 <> 0"
    what = "SELECT doc_id, concat('src/d', doc_id, '.txt') AS path, CASE doc_id % 3 WHEN 1 THEN 'added' ELSE 'modified' END AS status"
    return f"{what}, 2 AS first_line, CAST(1 + len(string_split(text, chr(10))) AS INTEGER) AS last_line {kept} UNION ALL {what}, 9000000, 9000000 {kept}"


def _language() -> str:
    ends = " ".join(f"WHEN lower(regexp_extract(path, '[.][^./]*$')) = '{e}' THEN '{i}'" for e, i in default_rule_set().by_extension.items())
    return f"CASE WHEN path LIKE '%/package.json' THEN 'json' WHEN regexp_matches(path, '/Dockerfile([.][^/]*)?$') THEN 'dockerfile' WHEN regexp_matches(path, '/[.]github/workflows/[^/]*[.]ya?ml$') THEN 'yaml' {ends} END"


def _lines() -> str:
    return f"""files AS (SELECT path, source, {_language()} AS lang FROM ({corpus_sql()}) WHERE length(source) > 0 AND length(source) < 2000000),
    lines AS (SELECT path, lang, source, unnest(string_split(source, chr(10))) AS t, CAST(generate_subscripts(string_split(source, chr(10)), 1) AS INTEGER) AS n FROM files)"""


def _found(rule: str, severity: str, score: str, where: str) -> str:
    """One finding for each line that fits; ``where`` speaks of path, lang, the line t and its number n."""
    return f"WITH {_lines()} SELECT path AS file, n AS line, {rule} AS rule_id, '{severity}' AS severity, {score} AS score FROM lines WHERE {where}"


_JS = "lang IN ('javascript', 'typescript')"
_ENTROPY = "list_sum(list_transform(list_distinct(string_split(s, '')), lambda c: -(length(s) - length(replace(s, c, ''))) / length(s) * log2((length(s) - length(replace(s, c, ''))) / length(s))))"
_LOADS = "(lang = 'python' AND regexp_matches(t, 'pickle[.]loads[(][a-z]'))"
_DYNAMIC = f"""({_JS} AND regexp_matches(t, 'eval[(] *[a-z]') AND NOT contains(t, 'eval(atob(')) OR {_LOADS} OR (lang = 'ruby' AND contains(t, '.load(io)')) OR (lang = 'kotlin' AND contains(t, '.eval(code)'))
    OR (lang = 'python' AND regexp_matches(t, '^ *(exec[(]base64|os[.]system[(][a-z]|mod = importlib[.]import_module[(]name)'))"""
_LOAD = f"({_JS} AND contains(t, 'require(name)')) OR (lang = 'python' AND contains(t, 'import_module(name)')) OR (lang = 'ruby' AND contains(t, '.load(io)'))"
#: What a directive on the line itself leaves.
_UNMARKED = "(NOT contains(t, 'lanthorn-disable-line') OR contains(t, 'lanthorn-disable-line obf.other'))"


def oracle_sql() -> dict[str, str]:
    suffixed = lambda rule: f"concat('{rule}.', lang)"
    dynamic = lambda more: _found(suffixed("obf.dynamic-exec-with-non-literal"), "warn", "7", f"({_DYNAMIC}) AND {more}")
    table = "contains(t, '[\"cGF5bG9hZC1zdHViLA0tLS0=\"')"
    out = {
        "long_line_documents": _long_lines("documents", "concat('documents/', doc_id)", "text", ", substr(t, 1, 200) AS snippet"),
        "long_line_pages": _long_lines("pages", "concat('pages/', page_id)", "html", ", substr(t, 1, 200) AS snippet"),
        "language_counts": f"SELECT {_language()} AS language_id, count(*) AS files, CAST(sum(length(source)) AS BIGINT) AS chars FROM ({corpus_sql()}) GROUP BY 1",
        "rule_high_entropy_literal": f"""WITH {_lines()}, strings AS (SELECT path, n, unnest(regexp_extract_all(t, '"([A-Za-z0-9+/=_-]{{40,}})"', 1)) AS s FROM lines), bits AS (SELECT path, n, {_ENTROPY} AS h FROM strings)
            SELECT path AS file, n AS line, 'obf.high-entropy-literal' AS rule_id, 'warn' AS severity, CAST(least(10, floor(h * 1.5 + 0.5)) AS INTEGER) AS score FROM bits WHERE h >= 4.5""",
        "rule_bidi_control": _found("'obf.bidi-control'", "block", "10", "contains(t, chr(8238))"),
        "rule_homoglyph_identifier": _found("'obf.homoglyph-identifier'", "block", "9", "regexp_matches(t, '[A-Za-z_$][A-Za-z0-9_$]*[\\x{0400}-\\x{04FF}]')"),
        "rule_encoded_array": _found("'obf.encoded-array-fingerprint'", "warn", "7", table),
        "rule_string_array_decoder": _found(suffixed("obf.string-array-decoder"), "block", "9", f"{_JS} AND {table} AND contains(source, 'eval(atob(')"),
        "rule_decode_then_exec": _found(suffixed("obf.decode-then-exec"), "block", "9", f"({_JS} AND (contains(t, 'eval(atob(') OR regexp_matches(t, 'const blob = atob[(].*eval[(]blob[)]'))) OR {_LOADS} OR (lang = 'python' AND contains(t, 'exec(base64.b64decode('))"),
        "rule_dynamic_exec": dynamic("TRUE"),
        "rule_deserializer": _found(suffixed("obf.deserializer-untrusted"), "block", "9", "(lang = 'python' AND regexp_matches(t, '^obj = pickle[.]loads[(][a-z]')) OR (lang = 'ruby' AND contains(t, 'Marshal.load(io)')) OR (lang = 'php' AND contains(t, 'unserialize($x)'))"),
        "rule_suspicious_io": _found(suffixed("obf.suspicious-io-cluster"), "warn", "8", "(lang = 'python' AND contains(t, 'requests.post(') AND contains(t, '.npmrc'))"),
        "rule_npm_dropper": _found("'obf.npm-c2-dropper'", "block", "10", f"{_JS} AND contains(t, 'slack.com') AND contains(t, 'chmodSync')"),
        "rule_shell_input": _found(suffixed("obf.shell-with-untrusted-input"), "warn", "7", f"(lang = 'python' AND contains(t, 'os.system(f')) OR ({_JS} AND contains(t, 'child_process.exec(\"ls \" + name'))"),
        "rule_library_load": _found(suffixed("obf.library-load-non-literal"), "warn", "7", _LOAD),
        "rule_python_setup": _found("'obf.python-setup-side-effect'", "block", "9", "path LIKE '%/setup.py' AND regexp_matches(t, '^os[.]system')"),
        "rule_perl_makefile": _found("'obf.perl-makefile-side-effect'", "block", "9", "path LIKE '%/Makefile.PL' AND regexp_matches(t, '^system[(]')"),
        "rule_cargo_build": _found("'obf.cargo-build-rs-network'", "block", "9", "path LIKE '%/build.rs' AND contains(t, 'reqwest::')"),
        "rule_workflow_pipe": _found("'obf.gha-curl-pipe-shell'", "block", "9", "path LIKE '%/.github/workflows/%' AND regexp_matches(t, 'curl [^|]*[|] *bash')"),
        "rule_manifest_scripts": _manifests(),
        "diff_ranges": _diff_ranges(),
        "directives": f"WITH {_lines()} SELECT path, n AS line, trim(regexp_extract(t, 'lanthorn-disable-line *([A-Za-z0-9_.-]*)', 1)) AS rule_ids FROM lines WHERE contains(t, 'lanthorn-disable-line')",
        "suppressed_by_directive": dynamic("contains(t, 'lanthorn-disable-line obf.other')"),
        "changed_lines": dynamic(f"{_UNMARKED} AND n BETWEEN 1 AND 4"),
        "pass_or_fail": f"WITH {_lines()} SELECT count(*) > 0 AS failed FROM lines WHERE contains(t, chr(8238))",
        "snippet_hashes": "SELECT doc_id, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS digest FROM documents",
        "allowlisted": f"""SELECT * FROM ({dynamic(f"{_UNMARKED} AND path NOT LIKE 'vendor/%'")}) UNION ALL
            SELECT * FROM ({_found(suffixed("obf.library-load-non-literal"), "warn", "7", f"({_LOAD}) AND NOT ({_JS})")})""",
        "rule_dockerfile_pipe": f"""WITH {_lines()} SELECT path AS file, CASE WHEN n > 1 AND blank THEN n - 1 ELSE n END AS line, 'obf.dockerfile-curl-pipe-shell' AS rule_id, 'block' AS severity, 9 AS score
            FROM (SELECT path, n, t, coalesce(trim(lag(t) OVER (PARTITION BY path ORDER BY n)) = '', false) AS blank FROM lines WHERE path LIKE 'img/%') WHERE regexp_matches(t, '^RUN curl [^|]*[|] *sh')""",
    }
    rules = {k: sql for k, sql in out.items() if k.startswith("rule_") and k != "rule_dynamic_exec"} | {"unmarked": dynamic(_UNMARKED), "long": _long_lines(f"({corpus_sql()})", "path", "source")}
    enabled = " UNION ALL ".join(f"SELECT file, line, rule_id, severity, score FROM ({sql})" for sql in rules.values())
    counted = ", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS {s}" for s in ("block", "warn", "info"))
    return out | {
        "enabled_findings": enabled,
        "blocking_findings": f"SELECT * FROM ({enabled}) WHERE severity = 'block'",
        "top_findings": f"SELECT * FROM ({enabled}) ORDER BY CASE severity WHEN 'block' THEN 1 WHEN 'warn' THEN 2 ELSE 3 END, score DESC, file, line, rule_id LIMIT 50",
        "enabled_counts": f"SELECT {counted} FROM ({enabled})",
        "enabled_summary": f"SELECT family, rule_id, severity, count(*) AS n, max(score) AS top_score FROM (SELECT *, regexp_extract(rule_id, '^[^.]*[.][^.]*') AS family FROM ({enabled})) GROUP BY ROLLUP (family, rule_id, severity)",
    }
