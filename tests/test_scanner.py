"""Positive and negative cases of every rule, in one scan for all."""

import random

import pytest

from lanthorn.operators.detectors import Detector, File, Hit, default_detectors, entropy
from lanthorn.operators.rules import RuleSet, call_pattern, default_rule_set, load_rule_set, tail_tokens
from lanthorn.plans.scan import raw_findings, scan

BLOB = "Zm9vYmFyYmF6cXV4cXV1eHF1dXV4ZG9nY2F0bW91c2VlbGVwaGFudHJoaW5vY2Vyb3NoaXBwb1BPVEFNVVNYWVo5ODc2NTQz"
TABLE = ", ".join(f'"cGF5bG9hZC1zdHViL{i:02d}tLS0="' for i in range(32))

# path, source, rules that must be there, rules that must not
CASES = [
    ("a/1.js", f'const k = "{BLOB}";', ["obf.high-entropy-literal"], []),
    ("a/2.py", f"K = '{BLOB}'", ["obf.high-entropy-literal"], []),
    ("a/3.unknown", f"k = `{BLOB}`", ["obf.high-entropy-literal"], []),
    ("a/4.js", 'const k = "' + "a" * 60 + '";', [], ["obf.high-entropy-literal"]),
    ("a/5.js", 'const q = "SELECT name, age FROM people WHERE id = 7 ORDER BY name";', [], ["obf.high-entropy-literal"]),
    ("a/6.py", "ok = '‮user'", ["obf.bidi-control"], []),
    ("a/7.py", "ok = 'user'", [], ["obf.bidi-control"]),
    ("a/8.js", "const pаyload = 1;", ["obf.homoglyph-identifier"], []),
    ("a/9.js", "const абвг = 1;", [], ["obf.homoglyph-identifier"]),
    ("a/10.js", "x" * 5000, ["obf.long-line"], []),
    ("a/11.js", "let x = 1;\n" * 400, [], ["obf.long-line"]),
    ("a/12.js", f"const t = [{TABLE}];", ["obf.encoded-array-fingerprint"], ["obf.string-array-decoder"]),
    ("a/13.js", 'const t = ["red", "green", "blue", "pink", "gold"];', [], ["obf.encoded-array-fingerprint"]),
    ("b/1.js", 'eval(atob("Y29uc3Q="));', ["obf.decode-then-exec.javascript"], []),
    ("b/2.js", "new Function(Buffer.from(x, 'base64').toString())();", ["obf.decode-then-exec"], []),
    ("b/3.py", "import base64\nexec(base64.b64decode(x))", ["obf.decode-then-exec.python"], []),
    ("b/4.py", "import zlib\nexec(zlib.decompress(b).decode())", ["obf.decode-then-exec"], []),
    ("b/5.ps1", "IEX ([Text.Encoding]::UTF8.GetString([Convert]::FromBase64String($p)))", ["obf.decode-then-exec.powershell"], []),
    ("b/6.sh", 'eval "$(echo ZWNobw== | base64 -d)"', ["obf.decode-then-exec.bash"], []),
    ("b/7.php", "<?php eval(base64_decode($x));", ["obf.decode-then-exec.php"], []),
    ("b/8.js", 'eval("var x = 1");', [], ["obf.decode-then-exec", "obf.dynamic-exec-with-non-literal"]),
    ("b/9.js", "const d = atob(x);\nconsole.log(d);", [], ["obf.decode-then-exec"]),
    ("b/10.js", "const d = atob(x);\nfoo();\neval(d);", ["obf.decode-then-exec"], []),
    ("b/11.js", "function go(s) { eval(s); }", ["obf.dynamic-exec-with-non-literal"], []),
    ("b/12.rb", "def go(s)\n  instance_eval(s)\nend", ["obf.dynamic-exec-with-non-literal.ruby"], []),
    ("b/13.ts", "class S { constructor(f: (u: U) => void) { this.f = f; } }", [], ["obf.dynamic-exec-with-non-literal"]),
    ("b/14.js", "eval(await (await fetch(url)).text());", ["obf.network-then-exec"], []),
    ("b/15.py", "import requests\nexec(requests.get(url).text)", ["obf.network-then-exec"], []),
    ("b/16.sh", 'eval "$(curl -s $URL)"', ["obf.network-then-exec"], []),
    ("b/17.ts", "const page = got(address).then(show); render(page);", [], ["obf.network-then-exec"]),
    ("b/18.py", "def go(b):\n    return pickle.loads(b)", ["obf.deserializer-untrusted"], []),
    ("b/19.rb", "Marshal.load(io)", ["obf.deserializer-untrusted.ruby"], []),
    ("b/20.js", "function go(s) { return JSON.parse(s); }", [], ["obf.deserializer-untrusted"]),
    ("b/21.js", 'const d = fs.readFileSync(h + "/.npmrc");\nfetch("https://example.com", {body: d});', ["obf.suspicious-io-cluster"], []),
    ("b/22.js", 'const d = fs.readFileSync("./c.json");', [], ["obf.suspicious-io-cluster"]),
    ("b/23.js", f"const t = [{TABLE}];\nfunction d(i) {{ return atob(t[i]); }}\neval(d(0));", ["obf.string-array-decoder", "obf.encoded-array-fingerprint"], []),
    ("b/24.js", "const { exec } = require('child_process');\nexec(`ls ${name}`);", ["obf.shell-with-untrusted-input"], ["obf.library-load-non-literal"]),
    ("b/25.py", 'os.system(f"ls {name}")', ["obf.shell-with-untrusted-input.python"], []),
    ("b/26.ts", "const c = `x '${a}'`;", [], ["obf.shell-with-untrusted-input"]),
    ("b/27.js", "function l(n) { return require(n); }", ["obf.library-load-non-literal"], []),
    ("b/28.js", 'const c2 = "slack.com"; subtle; fs.writeFileSync(p); fs.chmodSync(p); child_process;', ["obf.npm-c2-dropper"], []),
    ("b/29.js", 'const c2 = "slack.com"; fs.writeFileSync(p);', [], ["obf.npm-c2-dropper"]),
    ("c/1/package.json", '{"scripts": {"postinstall": "node x.js"}}', ["obf.manifest-install-script"], []),
    ("c/2/package.json", '{"scripts": {"test": "jest"}}', [], ["obf.manifest-install-script"]),
    ("c/3/composer.json", '{"scripts": {"post-install-cmd": ["php a.php", "php b.php"]}}', ["obf.manifest-install-script"], []),
    ("c/4/x.gemspec", "spec.extensions = ['ext/extconf.rb']", ["obf.manifest-install-script"], []),
    ("c/5/x.gemspec", "spec.name = 'x'", [], ["obf.manifest-install-script"]),
    ("c/6/x.rockspec", "build = { type = 'command', build_command = 'make' }", ["obf.manifest-install-script"], []),
    ("c/7/x.nuspec", "<file src='tools/install.ps1' target='tools' />", ["obf.manifest-install-script"], []),
    ("c/8/setup.py", "import os\nsetup(\n  name='x',\n)\nos.system(c)", ["obf.python-setup-side-effect"], []),
    ("c/9/setup.py", "from setuptools import setup\nsetup(name='x', cmd=os.system)", [], ["obf.python-setup-side-effect"]),
    ("c/10/Makefile.PL", "use strict;\nsystem('x');", ["obf.perl-makefile-side-effect"], []),
    ("c/11/Makefile.PL", "use strict;\n# system('x')\nWriteMakefile(NAME => 'x');", [], ["obf.perl-makefile-side-effect"]),
    ("c/12/build.rs", 'fn main() { reqwest::get("x"); }', ["obf.cargo-build-rs-network"], []),
    ("c/13/build.rs", "fn main() {}", [], ["obf.cargo-build-rs-network"]),
    ("c/14/.github/workflows/x.yml", "run: curl https://example.com | bash", ["obf.gha-curl-pipe-shell"], []),
    ("c/15/Dockerfile", "FROM x\nRUN curl https://example.com | sh", ["obf.dockerfile-curl-pipe-shell"], []),
    ("c/16/Dockerfile", "FROM x\nRUN apt-get update", [], ["obf.dockerfile-curl-pipe-shell"]),
    ("e/1.cs", "byte[] b = Convert.FromBase64String(text);\nvar a = Assembly.Load(b);", ["obf.decode-then-exec.c_sharp"], []),
    ("e/2.cs", "var f = new BinaryFormatter();\nreturn f.Deserialize(stream);", ["obf.deserializer-untrusted.c_sharp"], []),
    ("e/3.cs", 'Console.WriteLine("ready");', [], ["obf"]),
    ("e/4.go", 'raw, _ := base64.StdEncoding.DecodeString(text)\nt, _ := template.New("x").Parse(string(raw))', ["obf.decode-then-exec.go"], []),
    ("e/5.go", 'fmt.Fprintln(w, "ready")', [], ["obf"]),
    ("e/6.java", "ObjectInputStream in = open(s);\nreturn in.readObject();", ["obf.deserializer-untrusted.java"], []),
    ("e/7.java", 'Runtime.getRuntime().exec("ls " + name);', ["obf.shell-with-untrusted-input.java"], []),
    ("e/8.java", "return repository.findAll();", [], ["obf"]),
    ("e/9.kt", "return engine.eval(code)", ["obf.dynamic-exec-with-non-literal.kotlin"], []),
    ("e/10.kt", "data class Point(val x: Int, val y: Int)", [], ["obf"]),
    ("e/11.lua", "local s = string.char(112, 114)\nlocal f = loadstring(s)", ["obf.decode-then-exec.lua"], []),
    ("e/12.lua", "local t = { width = 3 }", [], ["obf"]),
    ("e/13.pl", "use MIME::Base64;\neval(decode_base64($x));", ["obf.decode-then-exec.perl"], []),
    ("e/14.pl", "my $n = length($line);\nprint $n;", [], ["obf"]),
    ("e/15.rs", "let raw = general_purpose::STANDARD.decode(text)?;\nlet l = Library::new(&raw)?;", ["obf.decode-then-exec.rust", "obf.library-load-non-literal.rust"], []),
    ("e/16.rs", "fn add(a: u32, b: u32) -> u32 { a + b }", [], ["obf"]),
    ("e/17.vbs", "s = Chr(87) & Chr(83)\nExecute s", ["obf.decode-then-exec.vbscript"], []),
    ("e/18.vbs", 'WScript.Echo "ready"', [], ["obf"]),
    ("e/19.ps1", "IEX (New-Object Net.WebClient).DownloadString($url)", ["obf.network-then-exec.powershell"], []),
    ("e/20.ps1", "Get-Date | Format-List", [], ["obf"]),
    ("e/21.go", 'resp, _ := http.Get(url)\n// parse (it) with template\nt.Execute (os.Stdout, http.Get (url))', ["obf.network-then-exec.go"], []),
    ("e/22.php", "<?php unserialize($_POST['x']);", ["obf.deserializer-untrusted.php"], []),
    ("e/23.php", "<?php echo htmlspecialchars($name);", [], ["obf"]),
    ("e/24.rb", "class Point\n  attr_reader :x\nend", [], ["obf"]),
    ("e/25.sh", "set -e\nmake all", [], ["obf"]),
    ("f/1.js", "const run = new AsyncFunction(body);", ["obf.dynamic-exec-with-non-literal.javascript"], []),
    ("f/2.js", "const worker = child_process.fork('./' + name);", ["obf.shell-with-untrusted-input.javascript"], []),
    ("f/3.py", "spec = importlib.util.spec_from_file_location(name, place)", ["obf.dynamic-exec-with-non-literal.python", "obf.library-load-non-literal.python"], []),
    ("f/4.py", "exec(requests.delete(address).text)", ["obf.network-then-exec.python"], []),
    ("f/5.py", 'os.execlpe(tool, tool, f"{flag}", env)', ["obf.shell-with-untrusted-input.python"], []),
    ("f/6.java", "Order o = mapper.readValue(body, Order.class);", ["obf.deserializer-untrusted.java"], []),
    ("f/7.java", 'new ProcessBuilder.start("ls " + name);', ["obf.shell-with-untrusted-input.java"], []),
    ("f/8.go", "fn := reflect.MakeFunc(kind, body)", ["obf.dynamic-exec-with-non-literal.go"], []),
    ("f/9.rs", "let v = nix::unistd::execvp(folder + name, list);", ["obf.shell-with-untrusted-input.rust"], []),
    ("f/10.js", "return new Promise((resolve) => resolve(1));", [], ["obf"]),
    ("f/11.java", "Pattern p = Pattern.matcher(text);", [], ["obf"]),
    ("f/12.go", "t.Run(name, check)\nflag.Lookup(name)\nonce.Do(check)", [], ["obf"]),
    ("d/null.js", None, [], ["obf"]),
    ("d/empty.js", "", [], ["obf"]),
]


@pytest.fixture(scope="module")
def found(spark):
    files = spark.createDataFrame([(p, s) for p, s, _, _ in CASES], "path string, source string")
    result = scan(spark, files=files)
    return result, result.findings.collect()


def _is(rule, prefix):
    return rule == prefix or rule.startswith(prefix + ".")


def test_rules(found):
    by = {}
    for f in found[1]:
        by.setdefault(f.file, []).append(f.rule_id)
    for path, _, wanted, unwanted in CASES:
        for rule in wanted:
            assert any(_is(r, rule) for r in by.get(path, [])), (path, rule)
        for rule in unwanted:
            assert not any(_is(r, rule) for r in by.get(path, [])), (path, rule)


def test_total_order_and_failed(found):
    rank = {"info": 0, "warn": 1, "block": 2}
    keys = [(-rank[f.severity], -f.score, f.file, f.line) for f in found[1]]
    assert keys == sorted(keys)
    assert found[0].failed_detectors() == []
    assert {r.path: r.scanned for r in found[0].files.collect()}["d/null.js"] is False


def test_manifest_details(found):
    assert sum(f.file == "c/3/composer.json" for f in found[1]) == 2
    assert sum(f.file == "c/6/x.rockspec" for f in found[1]) == 2


def test_jvm_survives_long_literals(spark):
    big = '"' + "A" * 1_000_000 + '"'
    table = "[" + ", ".join(f'"item{i:06d}"' for i in range(20_000)) + "]"
    rows = [("x.js", big), ("y.js", table), ("z.js", "eval(" * 1024 + ")" * 1024)]
    assert scan(spark, files=spark.createDataFrame(rows, "path string, source string")).findings.count() >= 2


def test_custom_detectors(spark):
    class Shouts(Detector):
        id = "my.shout"

        def find(self, file: File):
            if "!" in file.source:
                yield Hit(self.id, "warn", 3, 1, "!" * 300, "loud")

    class Breaks(Detector):
        id = "my.break"

        def find(self, file: File):
            raise RuntimeError("no")

    files = spark.createDataFrame([("a.txt", "hey!"), ("b.txt", "hey")], "path string, source string")
    result = scan(spark, files=files, detectors=[Shouts(), Breaks()], symbol_resolver=lambda p, n: p[n + 5])
    (f,) = result.findings.collect()
    assert (f.rule_id, f.file, len(f.snippet), f.enclosing_symbol) == ("my.shout", "a.txt", 200, None)
    assert result.failed_detectors() == ["my.break"]
    assert scan(spark, files=files, detectors=[Shouts()], disabled_detectors=["my.shout"]).findings.count() == 0


def test_null_manifest_fails_alone(spark):
    files = spark.createDataFrame([("package.json", "null"), ("a/package.json", "{bad"), ("b/package.json", '{"scripts": {"install": "x"}}')], "path string, source string")
    result = scan(spark, files=files)
    assert [f.file for f in result.findings.collect()] == ["b/package.json"]
    assert result.failed_detectors() == ["obf.manifest-install-script"]


def test_languages(spark):
    rules = default_rule_set()
    rows = [("a/b.PY", "python"), ("x.tsx", "typescript"), ("Rakefile", "ruby"), ("a\\b.js", "javascript"), ("package.json", "json"), ("Dockerfile.dev", "dockerfile"), ("x/.github/workflows/a.yml", "yaml"), (".github/workflows/a.yml", None), ("noext", None), ("a.b/noext", None)]
    df = spark.createDataFrame(rows, "path string, want string")
    got = df.withColumn("got", rules.detect_language(df.path)).collect()
    assert [(r.path, r.want) for r in got] == [(r.path, r.got) for r in got]
    assert rules.config_for("csharp").id == "c_sharp" and rules.config_for("nothing") is None


def test_name_patterns():
    assert call_pattern(("os.system",)) == r"os\.system|(?:\.|::)system"
    assert call_pattern(("os.system",), bare_tails=True) == r"os\.system|system"
    assert call_pattern(("a.b.exec",)) == r"a\.b\.exec|b\.exec|(?:\.|::)exec"
    assert call_pattern(("x.eval", "y.eval")) == r"x\.eval|eval|y\.eval"
    assert call_pattern(("[Convert]::FromBase64String",)) == r"\[Convert\]::FromBase64String"
    assert tail_tokens(("a.eval", "x.go", "base64 -d", "b::eval")) == ["eval"]


def test_rule_pack_loading(tmp_path):
    (tmp_path / "_x.json").write_text("{}")
    with pytest.raises(Exception, match="no valid"):
        load_rule_set(tmp_path)
    (tmp_path / "x.json").write_text('{"id": "x", "extensions": [".x"], "dynamic_exec_sinks": [], "decoders": [], "extra": 1}')
    (tmp_path / "y.json").write_text("not json")
    (x,) = load_rule_set(tmp_path).languages
    assert x.id == "x" and x.other == {"extra": 1}


def test_no_detectors_or_rules(spark):
    files = spark.createDataFrame([("a.js", "eval(x)")], "path string, source string")
    assert raw_findings(files, RuleSet([])).count() == 0
    assert scan(spark, files=files, detectors=[]).findings.count() == 0
    with pytest.raises(ValueError, match="exactly one"):
        scan(spark)
    assert len({d.id for d in default_detectors()}) == 20


def test_entropy():
    assert entropy("aabbccdd") == 2.0 and entropy("") == 0.0


def test_random_texts_terminate(spark):
    random.seed(5)
    rows = [(f"f{i}.{e}", "".join(random.choice("eval(atob'\"`,[]$ {}\n=fetch.") for _ in range(3000))) for i, e in enumerate(["js", "py", "sh", "rb", "php", "ps1"] * 2)]
    scan(spark, files=spark.createDataFrame(rows, "path string, source string")).findings.count()
