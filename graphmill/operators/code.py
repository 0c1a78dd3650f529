"""Tables from source code: definitions, symbols, imports, calls, dependencies, workflows, blame lines.

Parsers are plain functions from a text to rows; each runs once per text inside mapInPandas, so a source is
parsed where it lies and only rows leave the worker. Texts that do not parse give no rows.
"""

from __future__ import annotations

import ast
import configparser
import json
import re
import textwrap
import warnings
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _tree(text: str | None) -> ast.Module | None:
    if not text:
        return None
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        for body in (text, textwrap.dedent(text)):
            try:
                return ast.parse(body.replace("\r\n", "\n"))
            except (SyntaxError, ValueError, RecursionError, MemoryError):
                continue
    return None


def signature(args: ast.arguments) -> str:
    """Names of positional arguments, *args and **kwargs; keyword-only arguments and defaults are left out."""
    names = [a.arg for a in args.posonlyargs + args.args]
    names += [f"*{args.vararg.arg}"] if args.vararg else []
    names += [f"**{args.kwarg.arg}"] if args.kwarg else []
    return f"({', '.join(names)})"


def definitions(text: str | None) -> Iterator[tuple]:
    """(qualified, kind, lineno, end_lineno, signature, doc) of classes, methods and functions at any depth."""
    stack = [(n, "", False) for n in reversed(_tree(text).body)] if _tree(text) else []
    while stack:
        node, prefix, in_class = stack.pop()
        name = prefix
        inside = False
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            name = f"{prefix}.{node.name}".lstrip(".")
            yield name, "method" if in_class else "function", node.lineno, node.end_lineno, signature(node.args), ast.get_docstring(node)
        elif isinstance(node, ast.ClassDef):
            name = f"{prefix}.{node.name}".lstrip(".")
            inside = True
            yield name, "class", node.lineno, node.end_lineno, None, ast.get_docstring(node)
        stack += [(n, name, inside) for n in reversed(list(ast.iter_child_nodes(node))) if isinstance(n, ast.stmt)]


def tree_json(text: str | None, preview: int = 160) -> str | None:
    """The syntax tree as nested JSON; contexts are left out, constants previewed."""

    def dump(node):
        if isinstance(node, ast.AST):
            out = {"_type": type(node).__name__}
            for field, value in ast.iter_fields(node):
                if field != "ctx":
                    out[field] = dump(value)
            if hasattr(node, "lineno"):
                out |= {"lineno": node.lineno, "end_lineno": node.end_lineno}
            return out
        if isinstance(node, list):
            return [dump(x) for x in node]
        return node if node is None or isinstance(node, int | bool) else str(node)[:preview]

    tree = _tree(text)
    try:
        return None if tree is None else json.dumps(dump(tree), ensure_ascii=False)
    except RecursionError:
        return None


def imports(text: str | None) -> Iterator[tuple]:
    """(alias, target, lineno) of every import."""
    tree = _tree(text)
    for node in ast.walk(tree) if tree else ():
        if isinstance(node, ast.Import):
            for a in node.names:
                yield a.asname or a.name.split(".")[0], a.name, node.lineno
        elif isinstance(node, ast.ImportFrom):
            base = "." * node.level + (node.module or "")
            for a in node.names:
                yield a.asname or a.name, f"{base}.{a.name}" if base.strip(".") else f"{base}{a.name}", node.lineno


def chain_of(node: ast.expr) -> str | None:
    """Dotted name of a callee; None for anything but names and attributes."""
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else None


def calls(text: str | None) -> Iterator[tuple]:
    """(lineno, chain) of every call."""
    tree = _tree(text)
    for node in ast.walk(tree) if tree else ():
        if isinstance(node, ast.Call):
            yield node.lineno, chain_of(node.func)


def structure(text: str | None) -> Iterator[tuple]:
    """(parameters, calls, control, literals) of a source as sorted text: what a structural extract keeps."""
    tree = _tree(text)
    if tree is None:
        return
    params, called, control, literals = set(), set(), set(), 0
    for node in ast.walk(tree):
        kind = type(node).__name__
        if isinstance(node, ast.arg):
            params.add(node.arg)
        elif isinstance(node, ast.Call):
            called.add(chain_of(node.func) or "?")
        elif kind in ("If", "For", "AsyncFor", "While", "Try", "With", "AsyncWith", "Match"):
            control.add(kind)
        elif isinstance(node, ast.Constant):
            literals += 1
    yield ",".join(sorted(params)), ",".join(sorted(called)), ",".join(sorted(control)), literals


# ---- dependency manifests: text -> (name, version)


def requirements(text: str) -> Iterator[tuple[str, str | None]]:
    for line in text.splitlines():
        m = re.match(r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)(?:\[[^\]]*\])?\s*(?:[=<>!~]=?=?\s*([^\s;#,]+))?", line.split("#")[0])
        if m and not line.lstrip().startswith(("-", "#")):
            yield m[1], m[2]


def _toml(text: str) -> dict:
    import tomllib

    try:
        return tomllib.loads(text)
    except tomllib.TOMLDecodeError:
        return {}


def pyproject(text: str) -> Iterator[tuple[str, str | None]]:
    data = _toml(text)
    for item in data.get("project", {}).get("dependencies", []):
        yield from requirements(item)
    for name, version in data.get("tool", {}).get("poetry", {}).get("dependencies", {}).items():
        if name != "python":
            yield name, version if isinstance(version, str) else (version or {}).get("version")


def setup_cfg(text: str) -> Iterator[tuple[str, str | None]]:
    parser = configparser.ConfigParser()
    try:
        parser.read_string(text)
    except configparser.Error:
        return
    yield from requirements(parser.get("options", "install_requires", fallback=""))


def pipfile(text: str) -> Iterator[tuple[str, str | None]]:
    data = _toml(text)
    for part in ("packages", "dev-packages"):
        for name, version in data.get(part, {}).items():
            yield name, version if isinstance(version, str) else (version or {}).get("version")


def environment_yml(text: str) -> Iterator[tuple[str, str | None]]:
    for m in re.finditer(r"^\s*-\s*([A-Za-z0-9][\w.-]*)\s*(?:=+\s*([^\s=]+))?", text.partition("dependencies:")[2], re.M):
        if m[1] != "pip" or m[2]:
            yield m[1], m[2]


def package_json(text: str) -> Iterator[tuple[str, str | None]]:
    try:
        data = json.loads(text)
    except ValueError:
        return
    for part in ("dependencies", "devDependencies"):
        yield from (data.get(part) or {}).items()


def pom_xml(text: str) -> Iterator[tuple[str, str | None]]:
    for m in re.finditer(r"<dependency>(.*?)</dependency>", text, re.S):
        tag = lambda t: (re.search(rf"<{t}>([^<]*)</{t}>", m[1]) or [None, None])[1]  # noqa: E731,B023
        if tag("artifactId"):
            yield f"{tag('groupId')}:{tag('artifactId')}", tag("version")


def go_mod(text: str) -> Iterator[tuple[str, str | None]]:
    for m in re.finditer(r"^\s*(?:require\s+)?([\w.-]+\.[\w.-]+/[\w./-]+)\s+(v[\w.+-]+)", text, re.M):
        yield m[1], m[2]


def gemfile_lock(text: str) -> Iterator[tuple[str, str | None]]:
    for m in re.finditer(r"^ {4}([A-Za-z0-9_.-]+) \(([^)]+)\)", text, re.M):
        yield m[1], m[2]


def cargo_toml(text: str) -> Iterator[tuple[str, str | None]]:
    for name, version in _toml(text).get("dependencies", {}).items():
        yield name, version if isinstance(version, str) else (version or {}).get("version")


MANIFESTS: dict[str, tuple[str, Callable[[str], Iterator[tuple[str, str | None]]]]] = {
    "requirements.txt": ("pip", requirements), "pyproject.toml": ("pip", pyproject), "setup.cfg": ("pip", setup_cfg), "Pipfile": ("pip", pipfile), "environment.yml": ("conda", environment_yml),
    "package.json": ("npm", package_json), "pom.xml": ("maven", pom_xml), "go.mod": ("go", go_mod), "Gemfile.lock": ("gem", gemfile_lock), "Cargo.toml": ("cargo", cargo_toml),
}


def dependencies_of(path: str, text: str | None) -> Iterator[tuple]:
    """(ecosystem, name, version) of a manifest by its file name, each once."""
    kind = MANIFESTS.get(path.replace("\\", "/").rsplit("/", 1)[-1])
    if kind and text:
        yield from dict.fromkeys((kind[0], n, v) for n, v in kind[1](text))


def workflow_steps(text: str | None) -> Iterator[tuple]:
    """(job, step, action) of a workflow in YAML; no rows where it isn't one or no YAML reader is installed."""
    try:
        import yaml

        data = yaml.safe_load(text or "")
    except Exception:  # noqa: BLE001 - any damage means there is no workflow
        return
    jobs = data.get("jobs") if isinstance(data, dict) else None
    for job, body in jobs.items() if isinstance(jobs, dict) else ():
        for i, step in enumerate((body or {}).get("steps") or []):
            if isinstance(step, dict):
                yield str(job), i, str(step.get("uses") or step.get("run") or step.get("name") or "")


def blame_lines(text: str | None) -> Iterator[tuple]:
    """(line, sha, author, mail, time, summary) of porcelain blame output; headers of a commit are given once and remembered."""
    known: dict[str, dict[str, str]] = {}
    sha, line = "", 0
    for row in (text or "").splitlines():
        if m := re.match(r"^([0-9a-f]{40}) \d+ (\d+)", row):
            sha, line = m[1], int(m[2])
            known.setdefault(sha, {})
        elif row.startswith("\t"):
            k = known.get(sha, {})
            yield line, sha, k.get("author"), k.get("author-mail", "").strip("<>") or None, int(k["author-time"]) if "author-time" in k else None, k.get("summary")
        elif sha and " " in row:
            key, value = row.split(" ", 1)
            known[sha][key] = value


def rows_of(df: DataFrame, key: str, text: str, parser: Callable[[str | None], Iterator[tuple]], schema: str) -> DataFrame:
    """(key, *schema): rows of ``parser`` over each text. Null texts give no rows."""
    names = [key, *(c.strip().split(" ")[0] for c in schema.split(","))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, *r) for k, t in zip(batch["k"], batch["t"], strict=True) for r in parser(t)]
            yield pd.DataFrame(rows, columns=names).astype(object)

    return df.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).where("t is not null").mapInPandas(run, f"{key} long, {schema}")


def definition_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, name): lines that begin a definition, by pattern alone."""
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("i", "row")).where(F.col("row").rlike(r"^\s*(?:async )?def [A-Za-z_]"))
    return lines.select(key, (F.col("i") + 1).alias("line"), F.regexp_extract("row", r"^\s*(?:async )?def ([A-Za-z_][A-Za-z0-9_]*)", 1).alias("name"))
