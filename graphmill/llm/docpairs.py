"""Functions paired with their documentation.

One packrat grammar per language reads a source into items with their offsets; semantic actions emit a
(definition, documentation) pair for each function at module level or directly in a class. Sources that
do not parse as a whole (cut at a line cap, older dialects, indented as in their class) still yield their
definitions: a string or bracket that never closes is read as plain characters, and a bracket ends where
a definition begins on a line of its own. A pair is kept if its documentation informs: what is blank, a
placeholder, an unfilled template, rules, linter directives or the words of the name alone does not.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.llm import braces
from graphmill.llm.peg import Expr, Parser, act, first, many, maybe, rule, seq, token, unless


warnings.filterwarnings("ignore", category=SyntaxWarning, module="<unknown>")  # odd escapes in the texts that are read


class Item(NamedTuple):
    """What one logical line is. kind: blank, comment, decorator, def, class, text (a string alone) or code."""

    kind: str
    indent: int
    at: int
    end: int
    name: str = ""
    doc: str | None = None
    signature: str = ""


class Pair(NamedTuple):
    """A function with its documentation; offsets are those of ``def`` (or function) and its logical line's end."""

    name: str
    at: int
    end: int
    signature: str
    doc: str
    origin: str


def _width(space: str) -> int:
    return len(space.expandtabs(8)) if "\t" in space else len(space)


def _unquoted(text: str) -> str | None:
    """The characters of a string literal; None for bytes and formatted strings, which document nothing."""
    m = re.match(r"([a-zA-Z]*)('''|\"\"\"|'|\")", text)
    if not m or set(m[1].lower()) & set("bf"):
        return None
    quote = m[2]
    if "\\" in text and "r" not in m[1].lower():
        try:
            return ast.literal_eval(text)
        except (SyntaxError, ValueError):
            pass  # cut off
    body = text[m.end() :]
    body = body.removesuffix(quote)
    if "r" not in m[1].lower():
        body = body.replace("\\\n", "").replace("\\n", "\n").replace("\\t", "\t")
    return body


# ---- Python

_DEFINITION_LINE = r"\n[ \t]*(?:(?:async[ \t]+)?def[ \t]+\w+[ \t]*[\[(]|class[ \t]+\w+[ \t]*[(:]|@\w+[^\n]*\n[ \t]*(?:@|def\b|async\b|class\b))"


_BEGINS_DEFINITION = re.compile(_DEFINITION_LINE).match


def _bracket(p: Parser, at: int):
    """A bracket with all that is nested in it, by a stack of its own, so depth is unbounded.

    What happens to the inner brackets on the way is kept like any other rule's result: those that close with their
    ends, those that are still open where the text ends or a definition begins as failures. So no offset is scanned twice.
    """
    if p.text[at : at + 1] not in ("(", "[", "{") or at >= len(p.text):
        return None
    text, n, memo = p.text, len(p.text), p.memo
    opened, i = [at], at + 1
    while i < n:
        c = text[i]
        if c in "([{":
            known = memo.get(("bracket", i), ...)
            if known is None:
                break  # it never closes, so nothing around it does
            if known is not ...:
                i = known[0]
                continue
            opened.append(i)
            i += 1
        elif c in ")]}":
            start = opened.pop()
            i += 1
            memo[("bracket", start)] = (i, (start, i))
            if not opened:
                return memo[("bracket", at)]
        elif c == "\n":
            if _BEGINS_DEFINITION(text, i):
                break
            i += 1
        else:
            got = p.rules["string"](p, i) or p.rules["comment"](p, i) or p.rules["plain"](p, i)
            i = got[0] if got else i + 1
    for start in opened:
        memo[("bracket", start)] = None
    return None


def _header(kind: str):
    def action(at: int, end: int, v: list) -> Item:
        # v: indent, keyword, name, rest of the signature, colon, tail
        doc = v[5] if isinstance(v[5], str) else None
        return Item(kind, _width(v[0]), at + len(v[0]), end, v[2], doc, " ".join(v[3].split()))

    return action


PYTHON: dict[str, Expr] = {
    "space": token(r"[ \t\f]*"),
    "string": first(
        token(r"(?i:[rbuft]{0,2})(?:'''(?:[^\\']|\\.|'(?!''))*'''|\"\"\"(?:[^\\\"]|\\.|\"(?!\"\"))*\"\"\")", re.S),
        token(r"(?i:[rbuft]{0,2})(?:'''(?:[^\\']|\\.|'(?!''))*\Z|\"\"\"(?:[^\\\"]|\\.|\"(?!\"\"))*\Z)", re.S),  # cut off
        token(r"(?i:[rbuft]{0,2})(?:'(?:[^\\'\n]|\\.)*'|\"(?:[^\\\"\n]|\\.)*\")", re.S),
    ),
    "comment": token(r"#[^\n]*"),
    "join": token(r"\\\n"),
    "plain": token(r"[^\n#'\"()\[\]{}\\a-zA-Z]+|[a-zA-Z_]\w*(?!['\"])|\\(?!\n)"),
    "bracket": lambda p, at: _bracket(p, at),
    "loose": token(r"[()\[\]{}'\"\\a-zA-Z]"),  # whatever never closes
    "rest": many(first(rule("string"), rule("bracket"), rule("join"), rule("plain"), rule("loose"))),
    "line_end": seq(rule("space"), maybe(rule("comment")), token(r"\n|\Z")),
    "blank": act(token(r"[ \t\f]*(?:\n|(?<=[^\n])\Z)"), lambda at, end, v: Item("blank", 0, at, end)),
    "comment_line": act(seq(rule("space"), rule("comment"), token(r"\n|\Z")), lambda at, end, v: Item("comment", _width(v[0]), at + len(v[0]), end, doc=v[1])),
    "decorator": act(seq(rule("space"), token(r"@"), rule("rest"), rule("line_end")), lambda at, end, v: Item("decorator", _width(v[0]), at + len(v[0]), end)),
    "parameters": act(many(seq(unless(token(r"[ \t]*:")), first(rule("string"), rule("bracket"), rule("join"), token(r"[^\n#'\"()\[\]{}\\:]+")))), lambda at, end, v: v),
    "tail": first(act(seq(rule("space"), rule("string"), rule("space"), maybe(token(r";")), rule("rest"), rule("line_end")), lambda at, end, v: _unquoted(v[1])), act(seq(rule("rest"), rule("line_end")), lambda at, end, v: None)),
    "text_line": act(seq(rule("space"), maybe(token(r"\([ \t\n]*")), rule("string"), maybe(token(r"[ \t\n]*\)")), rule("rest"), rule("line_end")), lambda at, end, v: Item("text", _width(v[0]), at + len(v[0]), end, doc=_unquoted(v[2]))),
    "code_line": act(seq(rule("space"), rule("rest"), rule("line_end")), lambda at, end, v: Item("code", _width(v[0]), at + len(v[0]), end)),
    "any_line": act(seq(rule("space"), token(r"[^\n]*(?:\n|\Z)")), lambda at, end, v: Item("code", _width(v[0]), at + len(v[0]), end)),
}


def _python_definition(p: Parser, at: int):
    """def or class, up to the end of its logical line; the signature is the text between name and colon."""
    return _DEF_OR_CLASS(p, at)


def _spelled(part: Expr) -> Expr:
    """``part`` with the text it took as its value."""

    def run(p: Parser, at: int):
        got = part(p, at)
        return None if got is None else (got[0], p.text[at : got[0]])

    return run


_DEF_OR_CLASS = first(
    act(seq(rule("space"), token(r"(?:async[ \t]+)?def(?=[ \t\\])"), act(seq(token(r"(?:[ \t]|\\\n)+"), token(r"[^\W\d]\w*")), lambda a, e, v: v[1]), _spelled(rule("parameters")), token(r"[ \t]*:?"), rule("tail")), _header("def")),
    act(seq(rule("space"), token(r"class(?=[ \t\\])"), act(seq(token(r"(?:[ \t]|\\\n)+"), token(r"[^\W\d]\w*")), lambda a, e, v: v[1]), _spelled(rule("parameters")), token(r"[ \t]*:"), rule("tail")), _header("class")),
)
PYTHON["definition"] = _python_definition
_PLAIN = r"[^\n#'\"()\[\]{}\\]"
_QUOTED = r"\"(?!\"\")[^\"\\\n]*\"|'(?!'')[^'\\\n]*'"
_FLAT = rf"\((?:{_PLAIN}|{_QUOTED})*+\)|\[(?:{_PLAIN}|{_QUOTED})*+\]|\{{(?:{_PLAIN}|{_QUOTED})*+\}}"
_NESTED = rf"\((?:{_PLAIN}|{_QUOTED}|{_FLAT})*+\)|\[(?:{_PLAIN}|{_QUOTED}|{_FLAT})*+\]|\{{(?:{_PLAIN}|{_QUOTED}|{_FLAT})*+\}}"
#: Code that ends with its line and holds nothing that needs the other rules: no definition, no string or bracket that goes on.
_EASY_LINE = re.compile(rf"([ \t\f]*+)(?![\n@(]|(?:def|class|async)\b|(?i:[rbuft]{{0,2}})['\"])(?:{_PLAIN}|{_QUOTED}|{_NESTED})++(?:#[^\n]*+)?+(?:\n|\Z)").match


def _easy_line(p: Parser, at: int):
    m = _EASY_LINE(p.text, at)
    return (m.end(), Item("code", _width(m[1]), m.end(1), m.end())) if m else None


PYTHON["easy_line"] = _easy_line
PYTHON["item"] = first(_easy_line, rule("blank"), rule("comment_line"), rule("definition"), rule("decorator"), rule("text_line"), rule("code_line"), rule("any_line"))


def parse_items(text: str, grammar: dict[str, Expr]) -> list[Item]:
    """All items of a text; the grammar takes any text to its end."""
    parser = Parser(text, grammar)
    items, at, n = [], 0, len(text)
    top = rule("item")
    while at < n:
        got = top(parser, at)
        if got is None or got[0] <= at:
            break
        at = got[0]
        items.append(got[1])
        if len(parser.memo) > 50_000:  # nothing before this offset is tried again
            parser.memo.clear()
    return items


def pair_python(text: str) -> Iterator[Pair]:
    """Pairs of Python text, whatever the documentation is worth."""
    items = parse_items(text, PYTHON)
    scopes: list[tuple[int, str]] = []
    for i, item in enumerate(items):
        if item.kind in ("blank", "comment"):
            continue
        while scopes and scopes[-1][0] >= item.indent:
            scopes.pop()
        if item.kind in ("def", "class"):
            if item.kind == "def" and all(kind == "class" for _, kind in scopes):
                doc, origin = _docstring_below(items, i), "docstring"
                if doc is None:
                    doc, origin = _comments_above(items, i), "comment"
                if doc is not None:
                    yield Pair(item.name, item.at, item.end, item.signature, doc, origin)
            scopes.append((item.indent, item.kind))


def _docstring_below(items: list[Item], i: int) -> str | None:
    if items[i].doc is not None:
        return items[i].doc
    for below in items[i + 1 :]:
        if below.kind in ("blank", "comment"):
            continue
        return below.doc if below.kind == "text" and below.indent > items[i].indent else None
    return None


def _comments_above(items: list[Item], i: int) -> str | None:
    k = i - 1
    while k >= 0 and items[k].kind == "decorator":
        k -= 1
    lines = []
    while k >= 0 and items[k].kind == "comment" and items[k].indent == items[i].indent:
        lines.append(items[k].doc or "")
        k -= 1
    return "\n".join(line.lstrip("#") for line in reversed(lines)) if lines else None


# ---- all languages


def pair_braces(text: str, ending: str = "js") -> Iterator[Pair]:
    """Pairs of a text in a language with braces, by its file ending."""
    for name, at, end, signature, doc in braces.documented(text, ending):
        yield Pair(name, at, end, signature, doc, "comment")


def pairs_of_file(text: str, path: str | None) -> Iterator[Pair]:
    """Pairs by the grammar of the file's ending; whatever has none is read as Python."""
    ending = (path or "").rpartition(".")[2].lower()
    return pair_braces(text, ending) if ending in braces.GRAMMARS else pair_python(text)


# ---- what documentation is worth

#: Words of which placeholders consist.
FILLER = frozenset(
    "todo fixme xxx tbd tba wip hack na n a none docstring doc docs documentation document description desc summary type add your write goes here this the is it missing placeholder "
    "fill in me later pending insert text some lorem ipsum undocumented no to be done for function method note comment please update explain describe".split()
)
_DIRECTIVE = re.compile(r"^\s*(?:!|noqa\b|type:\s*ignore|pylint\s*:|pragma\b|flake8\b|fmt:|isort:|mypy:|yapf:|nosec\b|ruff:|pyright:|black:|-\*-|eslint|prettier|@ts-|coding[:=]|vim?:|cspell|sonar|nolint).*$", re.I | re.M)
_TEMPLATE = re.compile(r"\[(?:summary|description|type|optional|extended[ _]summary|[a-z_ ]*)\]|_(?:summary|description|type|extended_summary)_|<[^<>\n]{0,40}>|\{[^{}\n]{0,40}\}", re.I)
_SECTION = re.compile(r"^\s*(?:args|arguments|parameters?|params|returns?|yields?|raises|examples?|notes?|attributes|see also|warnings?|references|keyword arguments|other parameters)\s*:?\s*$", re.I | re.M)
_FIELD = re.compile(r"^\s*(?:[:@](?:param|type|returns?|rtype|raises?|arg|throws)\b[^:\n]*:?|\*{0,2}\w+\s*(?:\([^()\n]*\))?\s*:)\s*(?:defaults to\s+\S*)?\s*$", re.I | re.M)
_WORDS = re.compile(r"[^\W\d_]+|\d+")
_ARTICLES = frozenset(("a", "an", "the"))


def name_words(name: str) -> set[str]:
    """Words of an identifier in snake or camel case."""
    return {w.lower() for w in _WORDS.findall(re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ", name))}


def informs(doc: str, name: str) -> bool:
    """Whether documentation says more than nothing, a placeholder, a template, a rule, a directive or the name."""
    text = _DIRECTIVE.sub("", doc)
    text = _FIELD.sub("", _SECTION.sub("", _TEMPLATE.sub("", text)))
    words = [w.lower() for w in _WORDS.findall(re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", text))]
    telling = [w for w in words if w not in FILLER and len(w) > 0]
    if not [w for w in telling if not w.isdigit()]:
        return False
    known = name_words(name)
    return any(w not in known and w not in _ARTICLES for w in words)


def extract_pairs(df: DataFrame, id_col: str = "entity_id", source_col: str = "source", path_col: str = "relpath", kind_col: str = "kind") -> DataFrame:
    """(id, def_line, name, signature, doc, origin) of every function documented in earnest.

    def_line counts from 1; a line ends with \\n, \\r\\n or \\r. Null and empty sources and configuration files give
    no row. Copies of a source give their pairs each. Only the named columns are read.
    """
    names = [id_col, "def_line", "name", "signature", "doc", "origin"]
    types = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple] = []
            for rid, source, path in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = source.replace("\r\n", "\n").replace("\r", "\n")
                line, seen = 1, 0
                for pair in pairs_of_file(text, path):
                    line += text.count("\n", seen, pair.at)
                    seen = pair.at
                    if informs(pair.doc, pair.name):
                        found.append((rid, line, pair.name, pair.signature, pair.doc.strip(), pair.origin))
            columns = list(zip(*found, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    wanted = df.where(F.col(source_col).isNotNull() & (F.col(source_col) != "") & (F.coalesce(F.col(kind_col), F.lit("")) != "config") & (F.col(source_col).contains("def") | F.lower(F.element_at(F.split(F.coalesce(F.col(path_col), F.lit("")), r"\."), -1)).isin(*sorted(braces.GRAMMARS))))
    return wanted.select(F.col(id_col).cast("long"), source_col, path_col).mapInArrow(run, f"{id_col} long, def_line int, name string, signature string, doc string, origin string")
