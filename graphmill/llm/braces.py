"""Parsing expression grammars for languages with braces: one each for JavaScript and TypeScript (and PHP), Java and C#, Go, C and C++, Rust.

All share comments, strings, balanced parentheses and scopes; each has its own heads of functions, notes that
may stand between comment and head, and openings of scopes whose functions count as methods (classes, traits,
namespaces and the like; any other brace opens a block, and functions in blocks are no methods).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

from graphmill.llm.peg import Expr, Match, Parser, act, first, many, maybe, rule, seq, token


class Part(NamedTuple):
    """What one item of a text is. kind: def (with its comment), class (opens a scope of methods), block, close or other."""

    kind: str
    at: int = 0
    end: int = 0
    name: str = ""
    signature: str = ""
    doc: str = ""
    method: bool = False


_INSIDE = re.compile(r"[^()\"'`/]+").match


def _parens(p: Parser, at: int) -> Match:
    """Balanced parentheses with the strings and comments in them; depth is unbounded, as no rule calls itself."""
    if not p.text.startswith("(", at):
        return None
    depth, i, n = 1, at + 1, len(p.text)
    while i < n:
        if m := _INSIDE(p.text, i):
            i = m.end()
            continue
        c = p.text[i]
        if c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if not depth:
                return i + 1, p.text[at : i + 1]
        else:
            got = p.rules["string"](p, i) or p.rules["comment"](p, i)
            i = got[0] if got else i + 1
            continue
        i += 1
    return None


class _Named:
    """A terminal whose value is the group ``name`` of its pattern."""

    def __init__(self, pattern: str):
        self.match = re.compile(pattern).match

    def __call__(self, p: Parser, at: int) -> Match:
        m = self.match(p.text, at)
        return (m.end(), m["name"]) if m else None


def _head(before: str, after: str, method: bool = False) -> Expr:
    """A head: the pattern up to the parameters (with the group ``name``), balanced parameters, the pattern after them."""
    start = re.compile(before).match
    finish = re.compile(after).match

    def run(p: Parser, at: int) -> Match:
        if not (m := start(p.text, at)) or not (parameters := _parens(p, m.end())) or not (tail := finish(p.text, parameters[0])):
            return None
        return tail.end(), (at, m["name"], p.text[m.end() : tail.end()].strip(), method)

    return run


#: Words that stand before parentheses and braces without naming a function.
_NOT_A_NAME = r"(?!(?:if|for|foreach|while|switch|catch|return|new|using|lock|else|do|try|synchronized|function|sizeof|typeof|throw|case|await|yield|delete|with|fixed|elif)\b)"
_GENERIC = r"(?:<[^<>(){};]*(?:<[^<>(){};]*(?:<[^<>(){};]*>[^<>(){};]*)*>[^<>(){};]*)*>)?"
_TYPE_AFTER = r"(?:\s*:\s*[^={};()]+(?:<[^={}]*>)?)?"

_JS_WORDS = r"(?:(?:export|default|async|public|private|protected|static|final|abstract|readonly|override|declare|get|set)\s+)*"
_JS_NAME = r"(?P<name>[\w$]+)"
JAVASCRIPT_HEADS = first(
    _head(rf"{_JS_WORDS}function\b\s*[*&]?\s*(?P<name>[\w$]*)\s*{_GENERIC}\s*(?=\()", r""),
    _head(rf"{_JS_WORDS}(?:(?:const|let|var)\s+|(?:[\w$]+\.)+)?{_JS_NAME}{_TYPE_AFTER}\s*[=:]\s*(?:async\s+)?function\b\s*\*?\s*[\w$]*\s*(?=\()", r""),
    _head(rf"{_JS_WORDS}(?:(?:const|let|var)\s+|(?:[\w$]+\.)+)?{_JS_NAME}(?:\s*:[^=\n]+)?\s*[=:]\s*(?:async\s+)?{_GENERIC}(?=\()", rf"{_TYPE_AFTER}\s*=>"),
    act(_Named(rf"{_JS_WORDS}(?:(?:const|let|var)\s+|(?:[\w$]+\.)+)?{_JS_NAME}\s*[=:]\s*(?:async\s+)?[\w$]+\s*=>"), lambda at, end, v: (at, v, "", False)),
    _head(rf"{_JS_WORDS}\*?\s*{_NOT_A_NAME}#?{_JS_NAME}\??\s*{_GENERIC}\s*(?=\()", rf"{_TYPE_AFTER}\s*(?=[{{;])", method=True),
)
_JAVA_WORDS = r"(?:(?:public|private|protected|internal|static|final|abstract|virtual|override|sealed|async|synchronized|native|default|extern|partial|unsafe|new|readonly|strictfp)\s+)*"
JAVA_HEADS = first(
    _head(rf"{_JAVA_WORDS}(?:{_GENERIC}\s+)?(?:(?!return\b|new\b|throw\b|else\b)[\w.$]+{_GENERIC}(?:\[[\s,]*\]|\?|\*)*\s+)?{_NOT_A_NAME}(?P<name>[\w.]+)\s*{_GENERIC}\s*(?=\()", r"\s*(?:throws\b[^{;]*|where\b[^{;]*|:\s*(?:base|this)\s*\([^{;]*)?(?=[{;]|=>)", method=True),
)
GO_HEADS = _head(r"func\s*(?:\([^()]*\)\s*)?(?P<name>\w+)\s*(?:\[[^\[\]]*\])?\s*(?=\()", r"")
_C_FRONT = re.compile(r"(?P<front>[\w:~<>,*&\s]*+)(?P<sign>[^\w\s(){};\"']*+)\s*(?=\()").match
_C_NAME = re.compile(r"(?<![\w:~])(?:\w+::)*~?\w+\s*\Z").search
_C_AFTER = re.compile(r"\s*(?:(?:const|noexcept|override|final|volatile)\b\s*|&{1,2}\s*)*(?:->[^{;]*)?(?::[^;{]*|=\s*(?:0|default|delete)\s*)?(?=[{;])").match
_C_STATEMENTS = frozenset("if for while switch return else do case throw delete goto typedef sizeof catch new using".split())


def C_HEADS(p: Parser, at: int) -> Match:
    """Type and name before parameters, or the name alone of a constructor or destructor; what stands before the parameters is cut once, from its end."""
    m = _C_FRONT(p.text, at)
    if not m or not (named := _C_NAME(m["front"])):
        return None
    name = named[0].strip() + m["sign"]
    before = m["front"][: named.start()].split()
    if m["sign"] and not name.startswith("operator") or {named[0].strip(), *before[:1]} & _C_STATEMENTS:
        return None
    if (not before or set(before) <= {"explicit", "inline", "virtual", "constexpr", "static"}) and not (name[0] in "~" or name[0].isupper() or "::" in name):
        return None
    if not (parameters := _parens(p, m.end())) or not (tail := _C_AFTER(p.text, parameters[0])):
        return None
    return tail.end(), (at, name, p.text[m.end() : tail.end()].strip(), False)


RUST_HEADS = _head(r"(?:pub(?:\s*\([^()]*\))?\s+)?(?:(?:async|const|unsafe|default|extern(?:\s+\"[^\"]*\")?)\s+)*fn\s+(?P<name>\w+)\s*(?:<[^;{]*?>)?\s*(?=\()", r"")

_LINES = r"(?:{0}[^\n]*(?:\n[ \t]*(?={0}))?)+"
_STRINGS = r"\"(?:[^\\\"\n]|\\.)*\""


def _grammar(heads: Expr, classes: str, notes: str, doc: str, strings: str) -> dict[str, Expr]:
    gap = token(r"[ \t\r]*(?:\n[ \t]*)?")
    scope = re.compile(classes).match

    def opens(p: Parser, at: int) -> Match:
        m = scope(p.text, at)
        return (m.end(), Part("class")) if m else None

    return {
        "doc": token(doc, re.S),
        "comment": token(r"/\*.*?(?:\*/|\Z)|//[^\n]*", re.S),
        "string": token(strings, re.S),
        "note": seq(token(notes), maybe(lambda p, at: _parens(p, at)), gap),
        "documented": act(seq(rule("doc"), gap, many(rule("note")), heads), lambda at, end, v: Part("def", v[3][0], end, v[3][1], v[3][2], v[0], v[3][3])),
        "class": opens,
        "brace": first(act(token(r"\{"), lambda at, end, v: Part("block")), act(token(r"\}"), lambda at, end, v: Part("close"))),
        "other": act(first(rule("string"), rule("doc"), rule("comment"), token(r"\s+|[\w$]+|[^\w\s$/\"'`{}#@\[]+|.", re.S)), lambda at, end, v: None),
        "item": first(rule("documented"), rule("class"), rule("brace"), rule("other")),
    }


_BLOCK_DOC = r"/\*(?!\*/).*?\*/"
_CLASSES = r"(?:class|interface|enum|struct|union|trait|namespace|module|object)\b(?!\s*[=.(,)])[^{}();\"'`=]*\{"
#: Grammar of each language, by the endings of its files.
GRAMMARS: dict[str, dict[str, Expr]] = {}
for _endings, _own in (
    ("js jsx ts tsx mjs cjs php", _grammar(JAVASCRIPT_HEADS, _CLASSES + r"|(?:(?:const|let|var)\s+[\w$]+(?:\s*:[^={;]+)?\s*=|module\.exports\s*=|export\s+default)\s*\{|class\b[^{};]*\{", r"@[\w.]+", rf"{_BLOCK_DOC}|{_LINES.format('//')}", _STRINGS + r"|'(?:[^\\'\n]|\\.)*'|`(?:[^\\`]|\\.)*`|(?<=[=(,:!&|?{};\[])/(?![/*])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/|(?<=[=(,:!&|?{};\[] )/(?![/*])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/")),
    ("java cs", _grammar(JAVA_HEADS, _CLASSES + r"|(?:class|interface|struct|record|enum)\s+\w+[^{};=\"']*\{|@interface\b[^{}]*\{", r"@(?!interface\b)[\w.]+|\[[^\[\]\n]*\]", rf"{_BLOCK_DOC}|{_LINES.format('//')}", r"\"\"\".*?\"\"\"|@\"(?:[^\"]|\"\")*\"|" + _STRINGS + r"|'(?:[^\\'\n]|\\.)+'")),
    ("go", _grammar(GO_HEADS, r"(?!)", r"(?!)", rf"{_BLOCK_DOC}|{_LINES.format('//')}", _STRINGS + r"|`[^`]*`|'(?:[^\\'\n]|\\.)+'")),
    ("c h cpp hpp cc cxx hh", _grammar(C_HEADS, _CLASSES + r"|extern\s+\"C\"\s*\{", r"template\s*<[^<>{};()]*(?:<[^<>{};()]*>[^<>{};()]*)*>|\[\[[^\[\]]*\]\]|__attribute__\s*(?=\()", rf"{_BLOCK_DOC}|{_LINES.format('//')}", _STRINGS + r"|'(?:[^\\'\n]|\\.)+'")),
    ("rs", _grammar(RUST_HEADS, r"(?:impl\b|trait\b|mod\b|extern\b)[^{};]*\{", r"#\[(?:[^\[\]]|\[[^\[\]]*\])*\]", rf"/\*(?![*!]?\*/|!).*?\*/|{_LINES.format('//(?!!)')}", r"r(#*)\".*?\"\1|" + _STRINGS + r"|'(?:[^\\'\n]|\\.[^'\n]*)'")),
):
    GRAMMARS |= dict.fromkeys(_endings.split(), _own)

_LEADER = re.compile(r"^[ \t]*(?:/\*+!?|\*+/|\*|//+!?)[ \t]?|[ \t]*\*+/[ \t]*$", re.M)
_MARKUP = re.compile(r"</?(?:summary|remarks|returns|value|para|param|typeparam|c|code|see|exception|paramref)\b[^<>\n]*/?>")


def documented(text: str, ending: str = "js") -> Iterator[tuple[str, int, int, str, str]]:
    """(name, offset, end, signature, documentation) of each function below its comment that stands at module level or directly in a class."""
    parser, at, n = Parser(text, GRAMMARS[ending]), 0, len(text)
    item, scopes, blocks = parser.rules["item"], [], 0
    while at < n:
        got = item(parser, at)
        if got is None or got[0] <= at:
            at += 1
            continue
        at, part = got
        if len(parser.memo) > 50_000:  # nothing before this offset is tried again
            parser.memo.clear()
        if part is None:
            continue
        if part.kind in ("class", "block"):
            scopes.append(part.kind)
            blocks += part.kind == "block"
        elif part.kind == "close":
            if scopes:
                blocks -= scopes.pop() == "block"
        elif not blocks and (scopes or not part.method):
            yield part.name, part.at, part.end, part.signature, _MARKUP.sub(" ", _LEADER.sub("", part.doc))
