"""Dependencies: packages named by install commands and manifests, and what vulnerability and version tables say of them."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PACKAGES = "array<struct<name:string,version:string,ecosystem:string,exact:boolean>>"
#: Flags that swallow the word after them, for each ecosystem.
_VALUED = {
    "PyPI": {"-r", "-c", "-e", "-i", "-f", "--index-url", "--extra-index-url", "--find-links", "--constraint", "--requirement"},
    "crates.io": {"--features", "--git", "--path", "--branch", "--tag", "--rev", "-F"},
}
#: Install commands: ecosystem and the expression for what stands before the packages.
_INSTALLS = [
    ("PyPI", r"(?:pip3?|python3? -m pip|uv pip) install|uv add"),
    ("npm", r"npm (?:install|i|add)|yarn add|pnpm (?:add|install|i)|bun (?:add|install|i)"),
    ("crates.io", r"cargo add"),
    ("Go", r"go (?:get|install)"),
    ("RubyGems", r"gem install"),
    ("NuGet", r"dotnet add(?: [^-\s]\S*)? package"),
    ("Packagist", r"composer require"),
    ("Maven", r"mvn"),
]
_INSTALLS = [(eco, re.compile(rf"(?:{head})(?=\s|$)")) for eco, head in _INSTALLS]


def package(name: str, version: str | None, ecosystem: str, exact: bool) -> dict:
    return {"name": name, "version": version or None, "ecosystem": ecosystem, "exact": bool(version) and exact}


def exact_version(spec: str) -> bool:
    """A digit, no range sign, not 'latest'."""
    return bool(re.search("[0-9]", spec)) and not re.search(r"[\^~><*xX|,\[\]()]", spec) and "latest" not in spec.lower()


def exact_version_column(spec: Column) -> Column:
    return spec.rlike("[0-9]") & ~spec.rlike(r"[\^~><*xX|,\[\]()]") & ~F.lower(spec).contains("latest")


def shell_parts(command: str) -> list[str]:
    """The simple commands of a line: cut at && || ; | outside quotes."""
    parts = [""]
    for piece in re.findall(r"\"[^\"]*\"?|'[^']*'?|&&|\|\||[;|]|[^\"'&|;]+|&", command):
        if piece in ("&&", "||", ";", "|"):
            parts.append("")
        else:
            parts[-1] += piece
    return [p.strip() for p in parts if p.strip()]


def shell_words(command: str) -> list[str]:
    """Words of a command; quotes keep white space and stay."""
    return re.findall(r"(?:[^\s\"']|\"[^\"]*\"?|'[^']*'?)+", command)


def pip_spec(spec: str) -> dict | None:
    """name[extras]==version; marker: the version of the first bound, exact for == only."""
    spec = re.sub(r"\[[^\]]*\]", "", spec.strip("\"'").split(";")[0], count=1).strip()
    for sign in ("==", ">=", "<=", "~=", "!=", ">", "<"):
        if sign in spec:
            name, _, rest = spec.partition(sign)
            version = rest.split(",")[0].strip()
            break
    else:
        name, sign, version = spec, "", None
    name = name.strip().lower()
    return package(name, version, "PyPI", sign == "==") if name and name[0] != "#" else None


def at_spec(spec: str, ecosystem: str) -> dict | None:
    """name@version, where a leading @ belongs to the name."""
    spec = spec.strip("\"'")
    name, _, version = spec.partition("@") if spec[:1] != "@" else ("@" + spec[1:].partition("@")[0], "", spec[1:].partition("@")[2])
    if ecosystem == "crates.io":
        return package(name, version.strip().lstrip("="), ecosystem, version.strip().startswith("=")) if name else None
    return package(name, version, ecosystem, ecosystem == "Go" or exact_version(version)) if name else None


def _words_to_packages(ecosystem: str, words: list[str]) -> list[dict]:
    out: list[dict] = []
    words = iter(words)
    for word in words:
        if ecosystem == "Maven":
            parts = word.removeprefix("-Dartifact=").split(":") if word.startswith("-Dartifact=") else []
            if len(parts) >= 3:
                out.append(package(":".join(parts[:2]), parts[-1], ecosystem, exact_version(parts[-1])))
        elif ecosystem in ("RubyGems", "NuGet") and word in ("-v", "--version"):
            version = next(words, "").strip("\"'")
            if out:
                out[-1] = package(out[-1]["name"], version, ecosystem, exact_version(version))
        elif word.startswith("-") and not (ecosystem == "PyPI" and "==" in word):
            if word in _VALUED.get(ecosystem, ()):
                next(words, None)
        elif ecosystem == "PyPI":
            out.append(pip_spec(word))
        elif ecosystem in ("npm", "crates.io", "Go"):
            out.append(at_spec(word, ecosystem))
        elif ecosystem == "Packagist":
            name, _, version = word.strip("\"'").partition(":")
            if "/" in name:
                out.append(package(name, version.strip(), ecosystem, exact_version(version)))
        elif ecosystem == "NuGet":
            if not out:
                out.append(package(word, None, ecosystem, False))
        else:
            out.append(package(word, None, ecosystem, False))
    return [p for p in out if p]


def from_command(command: str) -> list[dict]:
    """Packages that the install commands of a line name."""
    out = []
    for part in shell_parts(command):
        words = shell_words(part)
        line = " ".join(words)
        for ecosystem, head in _INSTALLS:
            if m := head.match(line):
                out += _words_to_packages(ecosystem, shell_words(line[m.end() :]))
                break
    return out


def manifest_of(command: str) -> str | None:
    """The file that an install without packages reads: for npm-like installs, composer install, pip -r."""
    for part in shell_parts(command):
        line = " ".join(shell_words(part))
        if m := re.match(r"(?:pip3?|python3? -m pip|uv pip) install.*?\s(?:-r|--requirement)[ =](\S+)", line):
            return m[1].strip("\"'")
        if re.fullmatch(r"(?:npm (?:install|i|ci)|yarn(?: install)?|pnpm (?:install|i)|bun install)(?:\s+-\S+)*", line):
            return "package.json"
        if re.fullmatch(r"composer install(?:\s+-\S+)*", line):
            return "composer.json"
    return None


# --- manifests ------------------------------------------------------------------------------------------------------


def _requirements(text: str) -> list[dict]:
    lines = (line.strip() for line in text.splitlines())
    return [p for line in lines if line and line[0] not in "#-" and (p := pip_spec(line))]


def _pyproject(text: str) -> list[dict]:
    data = tomllib.loads(text)
    project = data.get("project", {})
    specs = list(project.get("dependencies", []))
    for extra in project.get("optional-dependencies", {}).values():
        specs += extra
    return [p for s in specs if (p := pip_spec(s))]


def _bare_range(version: str) -> str:
    return re.sub(r"^(?:\^|~>?|>=|<=|>|<|=)+\s*", "", version).strip()


def _package_json(text: str) -> list[dict]:
    data, out = json.loads(text), []
    for section in ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies"):
        for name, spec in (data.get(section) or {}).items():
            bare = _bare_range(spec) if isinstance(spec, str) else ""
            out.append(package(name, bare if bare[:1].isdigit() else None, "npm", isinstance(spec, str) and exact_version(spec)))
    return out


def _cargo(text: str) -> list[dict]:
    data, out = tomllib.loads(text), []
    for section in ("dependencies", "dev-dependencies", "build-dependencies"):
        for name, spec in data.get(section, {}).items():
            version = spec if isinstance(spec, str) else spec.get("version", "")
            out.append(package(name, version.lstrip("="), "crates.io", version.startswith("=")))
    return out


def _go_mod(text: str) -> list[dict]:
    found = re.findall(r"^\s*require\s+([^\s(]+)\s+(\S+)", text, re.M)
    for block in re.findall(r"^\s*require\s*\((.*?)^\s*\)", text, re.M | re.S):
        found += re.findall(r"^\s*(?!//)(\S+)\s+(\S+)", block, re.M)
    return [package(n, v, "Go", True) for n, v in found]


def _gemfile(text: str) -> list[dict]:
    out = []
    for name, spec in re.findall(r"""^\s*gem\s+["']([^"']+)["'](?:\s*,\s*["']([^"']*)["'])?""", text, re.M):
        out.append(package(name, _bare_range(spec), "RubyGems", exact_version(spec)))
    return out


def _pom(text: str) -> list[dict]:
    out = []
    for node in ElementTree.fromstring(re.sub(r"\sxmlns(:\w+)?=\"[^\"]*\"|\sxsi:\S+=\"[^\"]*\"", "", text)).iter("dependency"):
        group, artifact, version = ((node.findtext(k) or "").strip() for k in ("groupId", "artifactId", "version"))
        if artifact:
            out.append(package(f"{group}:{artifact}" if group else artifact, version, "Maven", exact_version(version)))
    return out


def _gradle(text: str) -> list[dict]:
    out = []
    for line in re.findall(r"^\s*(?:implementation|api|compileOnly|runtimeOnly|testImplementation|testRuntimeOnly)\b(.*)", text, re.M):
        for quoted in re.findall(r"""["']([^"']+)["']""", line):
            parts = quoted.split(":")
            if len(parts) >= 3:
                out.append(package(":".join(parts[:2]), parts[2], "Maven", exact_version(parts[2])))
    return out


def _csproj(text: str) -> list[dict]:
    out = []
    for tag in re.findall(r"<PackageReference\b[^>]*", text):
        a = dict(re.findall(r"(\w+)=\"([^\"]*)\"", tag))
        if a.get("Include"):
            out.append(package(a["Include"], a.get("Version"), "NuGet", exact_version(a.get("Version", ""))))
    return out


def _composer(text: str) -> list[dict]:
    data, out = json.loads(text), []
    for section in ("require", "require-dev"):
        for name, spec in (data.get(section) or {}).items():
            if "/" in name:
                out.append(package(name, _bare_range(spec), "Packagist", exact_version(spec)))
    return out


_MANIFESTS = [
    (r"requirements.*\.txt|constraints\.txt", _requirements),
    (r"pyproject\.toml", _pyproject),
    (r"package\.json", _package_json),
    (r"cargo\.toml", _cargo),
    (r"go\.mod", _go_mod),
    (r"gemfile", _gemfile),
    (r"pom\.xml", _pom),
    (r"build\.gradle(?:\.kts)?", _gradle),
    (r".*\.csproj", _csproj),
    (r"composer\.json", _composer),
]


def is_manifest(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, "/"), -1)).rlike("^(?:" + "|".join(p for p, _ in _MANIFESTS) + ")$")


def from_file(path: str, content: str) -> list[dict]:
    """Packages that a manifest names; none if it is not one or cannot be parsed."""
    name = path.rsplit("/", 1)[-1].lower()
    for pattern, parse in _MANIFESTS:
        if re.fullmatch(pattern, name):
            try:
                return parse(content)
            except (ValueError, AttributeError, TypeError, ElementTree.ParseError):
                return []
    return []


def command_packages(rows: DataFrame, command: str = "command") -> DataFrame:
    """rows with one row for each package that the command names."""

    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in series:
            yield pd.Series([from_command(t) if t else [] for t in texts], dtype=object)

    likely = F.when(F.col(command).rlike(r"\b(?:install|i|add|get|require|mvn)\b"), F.col(command))
    return rows.withColumn("p", F.explode(F.pandas_udf(run, PACKAGES)(likely))).select("*", "p.*").drop("p")


def file_packages(rows: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """rows that are manifests, with one row for each package."""

    def run(series: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for paths, contents in series:
            yield pd.Series([from_file(p, c) if c else [] for p, c in zip(paths, contents, strict=True)], dtype=object)

    found = F.pandas_udf(run, PACKAGES)(F.col(path), F.col(content))
    return rows.filter(is_manifest(F.col(path))).withColumn("p", F.explode(found)).select("*", "p.*").drop("p")


def checked(packages: DataFrame, vulnerabilities: DataFrame, latest: DataFrame, most: int = 3) -> DataFrame:
    """packages with effective version, vulnerabilities (the first `most` ids), decision and update advice.

    The effective version is an exact one, or the latest where none is given; ranges are not looked up. Any
    vulnerability blocks; advice is given only without one, for exact versions other than the latest."""
    p = packages.join(latest.select("ecosystem", "name", F.col("version").alias("latest")), ["ecosystem", "name"], "left")
    p = p.withColumn("effective", F.when(F.col("exact"), F.col("version")).when(F.col("version").isNull(), F.col("latest")))
    v = vulnerabilities.groupBy("ecosystem", "name", F.col("version").alias("effective")).agg(F.slice(F.array_sort(F.collect_set("id")), 1, most).alias("ids"))
    p = p.join(v, ["ecosystem", "name", "effective"], "left")
    blocked = F.col("ids").isNotNull()
    update = ~blocked & F.col("exact") & F.col("latest").isNotNull() & (F.col("version") != F.col("latest"))
    return p.withColumns({"ids": F.array_join(F.coalesce("ids", F.array().cast("array<string>")), ","), "decision": F.when(blocked, "block").otherwise("allow"), "update_to": F.when(update, F.col("latest"))})
