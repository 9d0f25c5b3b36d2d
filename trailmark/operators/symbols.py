"""Symbols of source files (imports and definitions), directory listings and pattern settings.

Python is parsed; other languages go by expressions for each, one line at a time.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BYTES = 500_000
SYMBOLS = "array<struct<kind:string,name:string,source:string,line:int>>"
#: Languages by file ending.
LANGUAGES = {
    "javascript": ("js", "jsx", "mjs", "cjs"),
    "typescript": ("ts", "tsx"),
    "python": ("py", "pyi"),
    "rust": ("rs",),
    "go": ("go",),
    "java": ("java",),
    "c": ("c", "h"),
    "cpp": ("cc", "cpp", "cxx", "hpp", "hxx", "hh"),
    "ruby": ("rb", "rake", "gemspec"),
    "csharp": ("cs",),
}
_BY_END = {end: lang for lang, ends in LANGUAGES.items() for end in ends}
_NAME = r"(?P<name>[A-Za-z_$][\w$]*)"
_QUOTED = r"[\"'](?P<source>[^\"']+)[\"']"
_SCRIPT = [
    ("import", rf"^\s*import\b(?P<names>[^;'\"]*?)\bfrom\s*{_QUOTED}"),
    ("import", rf"^\s*import\s*{_QUOTED}"),
    ("import", rf"\brequire\(\s*{_QUOTED}\s*\)"),
    ("function", rf"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*{_NAME}"),
    ("class", rf"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+{_NAME}"),
    ("function", rf"^\s*(?:export\s+)?(?:const|let|var)\s+{_NAME}\s*=\s*(?:async\s*)?(?:function\b|\([^)]*\)\s*(?::[^=]+)?=>|\w+\s*=>)"),
    ("interface", rf"^\s*(?:export\s+)?interface\s+{_NAME}"),
    ("type", rf"^\s*(?:export\s+)?type\s+{_NAME}\s*[=<]"),
    ("enum", rf"^\s*(?:export\s+)?(?:const\s+)?enum\s+{_NAME}"),
]
_C = [
    ("import", r"^\s*#\s*include\s*[\"<](?P<source>[^\">]+)[\">]"),
    ("struct", rf"^\s*(?:typedef\s+)?struct\s+{_NAME}\s*\{{"),
    ("enum", rf"^\s*(?:typedef\s+)?enum\s+(?:class\s+)?{_NAME}\s*[:{{]"),
    ("class", rf"^\s*class\s+{_NAME}"),
    ("function", rf"^[A-Za-z_][\w\s*&:<>,]*?[\s*&]{_NAME}\s*\([^;]*\)\s*(?:const\s*)?\{{?\s*$"),
]
RULES = {
    "javascript": _SCRIPT,
    "typescript": _SCRIPT,
    "rust": [
        ("import", r"^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+(?P<source>[\w:]+?)(?:::\{(?P<names>[^}]*)\}|::\*)?(?:\s+as\s+\w+)?\s*;"),
        *((kind, rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+|async\s+|const\s+|extern\s+\"C\"\s+)*{word}\s+{_NAME}") for kind, word in (("function", "fn"), ("struct", "struct"), ("enum", "enum"), ("trait", "trait"), ("type", "type"), ("module", "mod"))),
    ],
    "go": [
        ("import", r"^\s*(?:import\s+)?(?:[\w.]+\s+)?\"(?P<source>[^\"]+)\"\s*$"),
        ("function", rf"^func\s+(?:\([^)]*\)\s*)?{_NAME}"),
        ("struct", rf"^type\s+{_NAME}\s+struct"),
        ("interface", rf"^type\s+{_NAME}\s+interface"),
        ("type", rf"^type\s+{_NAME}\s+(?!struct|interface)"),
    ],
    "java": [
        ("import", r"^\s*import\s+(?:static\s+)?(?P<source>[\w.]+)"),
        *((kind, rf"^\s*(?:(?:public|private|protected|static|final|abstract|sealed)\s+)*{kind}\s+{_NAME}") for kind in ("class", "interface", "enum", "record")),
        ("method", rf"^\s*(?:(?:public|private|protected|static|final|abstract|synchronized)\s+)+[\w<>\[\],.?\s]+?\s{_NAME}\s*\("),
    ],
    "c": _C,
    "cpp": _C,
    "ruby": [
        ("import", rf"^\s*(?:require|require_relative|load)\s*\(?\s*{_QUOTED}"),
        ("class", r"^\s*class\s+(?P<name>[A-Z][\w:]*)"),
        ("module", r"^\s*module\s+(?P<name>[A-Z][\w:]*)"),
        ("method", r"^\s*def\s+(?:self\.)?(?P<name>\w+[?!=]?)"),
    ],
    "csharp": [
        ("import", r"^\s*using\s+(?:static\s+)?(?P<source>[\w.]+)\s*;"),
        *((kind, rf"^\s*(?:(?:public|private|protected|internal|static|sealed|abstract|partial|readonly)\s+)*{kind}\s+{_NAME}") for kind in ("class", "interface", "enum", "struct", "record")),
        ("method", rf"^\s*(?:(?:public|private|protected|internal|static|virtual|override|async|sealed)\s+)+[\w<>\[\],.?\s]+?\s{_NAME}\s*\("),
    ],
}
RULES = {lang: [(kind, re.compile(p)) for kind, p in rules] for lang, rules in RULES.items()}


def _python(source: str) -> list[dict]:
    out = []

    def walk(node: ast.AST, in_class: bool) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.Import):
                out.extend({"kind": "import", "name": a.name, "source": a.name, "line": child.lineno} for a in child.names)
            elif isinstance(child, ast.ImportFrom):
                source = "." * child.level + (child.module or "")
                out.extend({"kind": "import", "name": a.name, "source": source, "line": child.lineno} for a in child.names)
            elif isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                kind = "class" if isinstance(child, ast.ClassDef) else "method" if in_class else "function"
                out.append({"kind": kind, "name": child.name, "source": "", "line": child.lineno})
            walk(child, isinstance(child, ast.ClassDef) or in_class and not isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef))

    walk(ast.parse(source), False)
    return out


def extract(path: str, source: str) -> list[dict]:
    """Imports and definitions with their lines, in order; none for other files, large ones and Python that does not parse."""
    lang = _BY_END.get(path.rsplit(".", 1)[-1].lower() if "." in path else "")
    if lang is None or len(source.encode()) > MOST_BYTES:
        return []
    if lang == "python":
        try:
            return sorted(_python(source), key=lambda s: s["line"])
        except (SyntaxError, ValueError, RecursionError):
            return []
    out, in_import = [], False
    for number, line in enumerate(source.splitlines(), 1):
        if lang == "go":
            in_import = (in_import or line.startswith("import")) and not line.startswith(")")
        for kind, rule in RULES[lang]:
            m = rule.search(line)
            if m is None or (lang == "go" and kind == "import" and not in_import):
                continue
            groups = m.groupdict()
            names = re.findall(r"[A-Za-z_$][\w$]*", re.sub(r"\s+as\s+[\w$]+", "", groups.get("names") or ""))
            source_name = groups.get("source") or ""
            for name in [n for n in names if n not in ("type", "self")] or [groups.get("name") or source_name]:
                out.append({"kind": kind, "name": name, "source": source_name if kind == "import" else "", "line": number})
            break
    return out


def symbols(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """files with one row for each symbol: kind, name, source, line."""

    def run(series: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for paths, contents in series:
            yield pd.Series([extract(p, c or "") for p, c in zip(paths, contents, strict=True)], dtype=object)

    ends = "|".join(_BY_END)
    found = F.explode(F.pandas_udf(run, SYMBOLS)(F.col(path), F.col(content)))
    return files.filter(F.lower(path).rlike(rf"\.(?:{ends})$")).withColumn("s", found).select(*[c for c in files.columns if c != content], "s.*")


#: Folders that listings leave out, beside those that begin with a dot, and files that count as text.
IGNORED_FOLDERS = ("node_modules", ".git", ".svn", ".hg", "target", "build", "dist", ".next", ".nuxt", "__pycache__", ".tox", ".venv", "venv", ".idea", ".vscode", ".cache", "vendor")
TEXT_ENDS = ("rs", "js", "ts", "tsx", "jsx", "py", "go", "java", "c", "h", "cpp", "hpp", "cc", "cs", "rb", "swift", "kt", "scala", "lua", "sh", "bash", "zsh", "fish", "pl", "pm", "html", "htm", "css", "scss", "sass", "less", "json", "yaml", "yml", "toml", "xml", "csv", "md", "txt", "rst", "ini", "cfg", "conf", "sql", "graphql", "gql", "proto", "vue", "svelte", "astro", "dockerfile", "makefile", "cmake", "r", "jl", "ex", "exs", "erl", "hrl", "zig", "nim", "dart", "v", "vhdl")


def browse(spark: SparkSession, folder: str) -> DataFrame:
    """path, lines of the text files below a folder, longest first. Spark does not read empty files, so they are not listed."""
    files = spark.read.option("recursiveFileLookup", "true").format("binaryFile").load(folder).select("path", "content")
    path = F.regexp_replace("path", "^file:/*", "/")
    inner = F.expr(f"substring(p, length('{folder.rstrip('/')}') + 2)")
    ignored = "|".join(re.escape(x) for x in IGNORED_FOLDERS)
    rows = files.withColumn("p", path).withColumn("p", inner).filter(~F.lower("p").rlike(rf"(?:^|/)(?:{ignored}|\.[^/]*)/"))
    rows = rows.filter(F.lower("p").rlike(rf"\.(?:{'|'.join(TEXT_ENDS)})$") | F.lower("p").rlike("(?:^|/)(?:dockerfile|makefile|gemfile|rakefile|procfile)$"))
    n = F.size(F.split(F.regexp_replace(F.decode("content", "UTF-8"), "\n$", ""), "\n"))
    return rows.select(F.col("p").alias("path"), n.alias("lines")).orderBy(F.desc("lines"), "path")
