"""Dependencies, symbols, summaries, caches, graphs, settings on literal cases."""

import json

import pytest
from pyspark.sql import functions as F

from trailmark.operators import behaviour, commands, ctx, deps, graph, settings, shrink, stats, symbols
from trailmark.operators import text as summaries
from trailmark.operators.dlp_catalog import Group


def names(packages):
    return [(p["name"], p["version"], p["exact"]) for p in packages]


@pytest.mark.parametrize(("command", "want"), [
    ("npm install lodash @types/node", [("lodash", None, False), ("@types/node", None, False)]),
    ("npm i a@1.2.3 @s/b@^2 --save", [("a", "1.2.3", True), ("@s/b", "^2", False)]),
    ("cd x && pip install 'Requests>=2.0,<3' flask==2.0.1; ls", [("requests", "2.0", False), ("flask", "2.0.1", True)]),
    ("pip install -r req.txt \"django[argon2]==4.2; python_version>'3'\"", [("django", "4.2", True)]),
    ("cargo add serde@=1.0.2 tokio --features full", [("serde", "1.0.2", True), ("tokio", None, False)]),
    ("go get golang.org/x/text@v0.3.0", [("golang.org/x/text", "v0.3.0", True)]),
    ("gem install rails -v 7.0.1", [("rails", "7.0.1", True)]),
    ("dotnet add app.csproj package Serilog --version 2.1", [("Serilog", "2.1", True)]),
    ("composer require monolog/monolog:2.0.0 plain", [("monolog/monolog", "2.0.0", True)]),
    ("echo npm install x", []),
])
def test_command_packages(command, want):
    assert names(deps.from_command(command)) == want


@pytest.mark.parametrize(("path", "content", "want"), [
    ("a/requirements-dev.txt", "# c\nflask==2.0\nrequests>=1,<2\n-e .\n", [("flask", "2.0", True), ("requests", "1", False)]),
    ("package.json", json.dumps({"dependencies": {"a": "^1.2", "b": "1.0.0"}, "devDependencies": {"c": "latest"}}), [("a", "1.2", False), ("b", "1.0.0", True), ("c", None, False)]),
    ("Cargo.toml", '[dependencies]\nserde = "1"\nx = { version = "=2.0", features = ["a"] }\n', [("serde", "1", False), ("x", "2.0", True)]),
    ("pyproject.toml", '[project]\nname = "p"\ndependencies = ["a==1.0", "b>=2"]\n', [("a", "1.0", True), ("b", "2", False)]),
    ("go.mod", "module m\nrequire a.b/c v1.0.0\nrequire (\n\td.e/f v2.0.0 // indirect\n)\n", [("a.b/c", "v1.0.0", True), ("d.e/f", "v2.0.0", True)]),
    ("Gemfile", "source 'x'\ngem 'rails', '~> 7.0'\ngem \"pg\"\n", [("rails", "7.0", False), ("pg", None, False)]),
    ("pom.xml", "<project xmlns=\"http://m\"><dependencies><dependency><groupId>g</groupId><artifactId>a</artifactId><version>1.0</version></dependency></dependencies></project>", [("g:a", "1.0", True)]),
    ("build.gradle", "implementation 'g:a:1.0'\n  api(\"h:b:2.+\")\n", [("g:a", "1.0", True), ("h:b", "2.+", True)]),
    ("x.csproj", '<PackageReference Include="N" Version="3.1" />', [("N", "3.1", True)]),
    ("composer.json", '{"require": {"php": "8", "a/b": "^1.0"}}', [("a/b", "1.0", False)]),
    ("package.json", "{broken", []),
    ("readme.md", "x", []),
])
def test_manifests(path, content, want):
    assert names(deps.from_file(path, content)) == want


def test_shell_parts_respect_quotes():
    assert deps.shell_parts("a 'x && y' && b | c; d & e") == ["a 'x && y'", "b", "c", "d & e"]
    assert deps.manifest_of("cd x && npm install --silent") == "package.json" and deps.manifest_of("pip install -r a/r.txt") == "a/r.txt"


def test_symbols():
    got = [(s["kind"], s["name"], s["source"], s["line"]) for s in symbols.extract("a.py", "import os\nfrom .x import y\nclass A:\n    def f(self): ...\ndef g(): ...\n")]
    assert got == [("import", "os", "os", 1), ("import", "y", ".x", 2), ("class", "A", "", 3), ("method", "f", "", 4), ("function", "g", "", 5)]
    got = [(s["kind"], s["name"], s["source"]) for s in symbols.extract("a.js", "import { a, b as c } from './m'\nconst q = require('fs')\nexport class K {}\nexport const f = async (x) => x\n")]
    assert got == [("import", "a", "./m"), ("import", "b", "./m"), ("import", "fs", "fs"), ("class", "K", ""), ("function", "f", "")]
    got = [(s["kind"], s["name"]) for s in symbols.extract("a.rs", "use std::fmt;\npub struct P {}\nimpl P { }\npub async fn run() {}\n")]
    assert got == [("import", "std::fmt"), ("struct", "P"), ("function", "run")]
    assert symbols.extract("a.json", "{}") == [] and symbols.extract("a.py", "def (") == []


def test_browse(spark, tmp_path):
    for name, content in (("a.py", "1\n2\n"), ("sub/b.js", "1\n2\n3"), ("node_modules/c.js", "1"), (".git/d.py", "1"), ("e.bin", "1"), ("Makefile", "x")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(content)
    assert [(r.path, r.lines) for r in symbols.browse(spark, str(tmp_path)).collect()] == [("sub/b.js", 3), ("a.py", 2), ("Makefile", 1)]


@pytest.mark.parametrize(("command", "output", "holds"), [
    ("git status", "On branch dev\nUntracked files:\n\tnew.py\n", ["dev", "untracked: new.py"]),
    ("git log", "commit abcdef1234\nAuthor: x\n\n    Fix it\n", ["abcdef1 Fix it"]),
    ("git push origin", "To x\n   a..b  main -> main\n", ["main -> main"]),
    ("cargo build", "   Compiling a v1\nerror[E0382]: moved\nwarning: unused\n", ["1 crates", "E0382: moved", "1 warnings"]),
    ("cargo test", "test a ... FAILED\ntest result: FAILED. 1 passed; 1 failed\n", ["1 failed", "FAILED a"]),
    ("npm install", "added 120 packages in 4s\n3 vulnerabilities\n", ["+120 packages (4s)", "3 vulnerabilities"]),
    ("ruff check .", "a.py:1:1: F401 unused\nb.py:2:1: F401 unused\nb.py:3:1: E501 long\n", ["3 issues in 2 files", "F401: 2"]),
    ("npx tsc", "src/a.ts(3,1): error TS2304: Cannot find name\n", ["1 errors in 1 files", "TS2304"]),
    ("terraform plan", "Plan: 2 to add, 1 to change, 0 to destroy.\n", ["+2 ~1 -0"]),
    ("pytest", "FAILED t.py::a\n==== 1 failed, 3 passed in 1s ====\n", ["1 failed, 3 passed", "FAILED t.py::a"]),
    ("curl x", "<!doctype html><title>Hi</title>\n", ['HTML: "Hi"']),
    ("env", "API_KEY=abc\nPATH=/bin\n", ["API_KEY=***", "PATH=/bin"]),
    ("ls -la", "total 8\ndrwxr-xr-x 2 u g 4096 Jan 1 00:00 src\n-rw-r--r-- 1 u g 2048 Jan 1 00:00 a b.py\n-rw-r--r-- 1 u g 10 Jan 1 00:00 c\n-rw-r--r-- 1 u g 10 Jan 1 00:00 d\n", ["src/", "a b.py  2.0K", "3 files, 1 dirs"]),
    ("journalctl", "Jan 1 host started\nJan 2 host started\n", ["started (x2)"]),
])
def test_command_summaries(command, output, holds):
    got = commands.by_command(command, output)
    assert all(h in got for h in holds), got


def test_summaries_must_be_shorter():
    assert commands.summarised("x", "short")["method"] == "none" and commands.summarised("x", None or "")["output"] == ""
    long = commands.summarised("unknown", "\n".join(f"line number {i} of the text" for i in range(200)))
    assert long["compressed"] < long["original"] and "omitted" in long["output"] or "unique" in long["output"]


def test_search_keeps_by_root():
    for n, k in ((100, 10), (1000, 30)):
        out = shrink.search("\n".join(f"f{i % 12}.py:{i}:x{i}" for i in range(n)))
        assert len(out.splitlines()) - 1 == k
    assert shrink.search("a:1:x\nb:2:y") is None


def test_json_crusher():
    assert shrink.crush("{}") is None
    out = json.loads(shrink.crush(json.dumps({"items": [{"status": "ok" if i % 2 else "bad", "t": "x" * 50} for i in range(50)], "s": "y" * 2000})))
    assert len(out["items"]) == 11 and out["items"][-1]["__truncated"] == 40 and "20 ok" in out["items"][-1]["__summary"] and "truncated" in out["s"]
    deep = {"a": {"b": {"c": {"d": {"e": {"f": ["x" * 100] * 10}}}}}}
    assert "__depth_exceeded" in shrink.crush(json.dumps(deep))


def test_diff_summary():
    hunk = "@@ -1,20 +1,20 @@\n" + "\n".join([" c"] * 10 + ["-old", "+new"] + [" c"] * 10)
    text = "".join(f"diff --git a/f{i} b/f{i}\n--- a/f{i}\n+++ b/f{i}\n{hunk}\n" for i in range(3))
    out = shrink.diff(text)
    assert len(out) < len(text) and "3 files changed, +3 -3" in out and out.count("\n c") == 12
    assert shrink.omitted({"a": 5, "b": 4, "c": 3, "d": 2, "e": 1}) == "5 in a, 4 in b, 3 in c, 3 in 2 other files"


def test_codec_and_differences():
    text = "abc " * 400
    assert ctx.encode("small") == "small" and ctx.encode(text).startswith("zstd64:") and ctx.decode(ctx.encode(text)) == text
    assert ctx.decode("zstd64:%%") == "zstd64:%%" and ctx.decode(None) is None
    assert ctx.difference("a\nb", "a\nc\nd") == "-2: b\n+2: c\n+3: d\n∂ +2/-1 lines" and ctx.difference("a", "a") == "(no changes)"


def test_labels_and_sizes(spark):
    df = spark.createDataFrame([(100, 60, 1536), (0, 0, 5)], "a long, b long, n long")
    got = [tuple(r) for r in df.select(summaries.savings_label(F.col("a"), F.col("b")), summaries.byte_size(F.col("n"))).collect()]
    assert got == [("[40 tok saved (40%)]", "1.5K"), ("0 tok saved", "5B")]
    m = spark.createDataFrame([("claude-opus-4-5-20250101",), ("gpt-5",)], "m string").select(stats.short_model(F.col("m")).alias("m")).collect()
    assert [r.m for r in m] == ["opus-4-5", "gpt-5"]


def test_ties_between_prompts_and_tools(spark):
    rows = [(1, "2024-01-01 00:00:00", "AgentPrompt", None, None), (2, "2024-01-01 00:00:00", "AgentPrompt", None, None), (3, "2024-01-01 00:00:00", "AgentTool", "Read", "a"), (4, "2024-01-01 00:00:01", "AgentTool", "Edit", "a"), (5, "2023-12-31 00:00:00", "AgentTool", "Edit", "a"), (6, "2024-01-01 00:00:02", "AgentTool", "", "a")]
    df = spark.createDataFrame(rows, "id long, timestamp string, endpoint_name string, tool_name string, file_path string").withColumns({"timestamp": F.to_timestamp("timestamp"), "session_id": F.lit("s"), "backend": F.lit("b"), "cwd": F.lit(""), "input_tokens": F.lit(1), "output_tokens": F.lit(1), "cache_read_tokens": F.lit(0), "dlp_action": F.lit(3)})
    got = {(r.id, r.prompt_id, r.read_before) for r in behaviour.turns(df).collect()}
    assert got == {(3, 2, 0), (4, 2, 1)}
    s = behaviour.sessions(df).first()
    assert (s.turns, s.tools, s.read_first_pct, s.exploration, s.blocked, s.cwd) == (2, 2, 100.0, 1.0, 2, None)


def test_imports_resolve_in_order(spark):
    files = spark.createDataFrame([("src/a.js",), ("src/a.ts",), ("src/lib/index.js",), ("x/core/util.rs",)], "path string")
    edges = spark.createDataFrame([("src/b.js", "./a"), ("src/b.js", "./lib"), ("src/b.js", "../x/core/util.rs"), ("src/b.js", "core::util"), ("src/b.js", "react"), ("src/b.js", "react")], "from_file string, source string")
    got = {r.source: r.to_file for r in graph.resolve(edges, files).collect()}
    assert got == {"./a": "src/a.js", "./lib": "src/lib/index.js", "../x/core/util.rs": "x/core/util.rs", "core::util": "x/core/util.rs", "react": ""}


def test_settings():
    p = settings.Patterns()
    n = p.add(Group("mine", ("a+",)))
    p.update(1, enabled=False)
    assert p.enabled()[-1].name == "mine" and len(p.enabled()) == 18
    p.delete(n)
    for bad in (lambda: p.delete(1), lambda: p.add(Group("x", ("(",))), lambda: p.add(Group("", ("a",))), lambda: settings.updated_backend("z", "{}", {"a"}), lambda: settings.updated_backend("a", "[]", {"a"})):
        with pytest.raises(ValueError):
            bad()
    assert settings.backend_settings('{"dlp_enabled": false, "token_saving": {"ctx_read": true}}')["token_saving"]["ctx_read"] and settings.backend_settings("x")["dlp_enabled"]


def test_transcripts_and_upserts(spark):
    lines = [(1, 0, "user", None, None), (1, 1, "assistant", 5, "a"), (1, 2, "user", None, None), (1, 3, "assistant", 7, "b"), (1, 4, "assistant", 1, None), (1, 5, "user", None, None), (2, 0, "user", None, None)]
    df = spark.createDataFrame(lines, "id long, line long, role string, tokens long, model string")
    assert [tuple(r) for r in ctx.transcript_usage(df).collect()] == [(1, 8, "b", 2)]
    stored = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("b", 1, "x")], "key string, updated_at long, value string")
    assert {(r.key, r.value) for r in ctx.latest(stored, "key").collect()} == {("a", "new"), ("b", "x")}
