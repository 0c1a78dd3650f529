"""Credentials embedded in source code and configuration.

A scanner reads every text once and emits candidate values: literals, assigned words, parts of addresses
and connection strings, header values, values named in comments, and private key blocks. Each candidate
carries the identifier it belongs to, the syntax around it and the file it stands in. Whole texts and whole
values are read; identifier and syntax are found however far before the value they stand. Patterns label some of
them weakly. Two character Markov models (values labelled as credentials, all other values) are counted over
all candidates; their likelihood ratio per character joins features of identifier, syntax, value and path in
a logistic regression, fitted on a bounded number of weakly labelled candidates (``MAX_FIT``, by hash, half of
each label at most) and calibrated on held-out ones. High scores are reported and redacted.

References to values kept elsewhere, placeholders and masks are never redacted, whatever their score.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from operator import ne

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.session import cut

MAX_FIT = 40_000
THRESHOLD = 0.5

# ---- fixed values: published shapes of tokens, key blocks, and words
TOKEN_SHAPES = re.compile(
    r"(?<![A-Za-z0-9_-])(?:(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|gh[pousr]_[A-Za-z0-9]{20,}|github_pat_\w{20,}|glpat-[\w-]{16,}|xox[abeprs]-[\w-]{10,}|AIza[\w-]{15,}|eyJ[\w-]{8,}\.(?:eyJ)?[\w-]{8,}\.[\w-]{6,}|npm_[A-Za-z0-9]{30,}|SG\.[\w-]{16,}\.[\w-]{16,})"
)
PRIVATE_KEY = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----.*?(?:-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----|\Z)", re.S)
PUBLIC_BLOCK = re.compile(r"-----BEGIN (?:PUBLIC KEY|(?:[A-Z0-9]+ )*PUBLIC KEY|CERTIFICATE|(?:[A-Z0-9]+ )*CERTIFICATE|CERTIFICATE REQUEST|PGP PUBLIC KEY BLOCK|(?:[A-Z0-9]+ )*PARAMETERS)-----.*?(?:-----END [A-Z0-9 ]+-----|\Z)", re.S)
SECRET_WORDS = frozenset(
    "password passwd pass passphrase phrase pwd pw pass2 secret token key apikey auth authtoken cred creds credential credentials bearer signing salt login clave passwort kennwort contraseña motdepasse mdp pin encryptionkey privatekey secretkey accesskey hook webhook jwt hmac session sas sig signature pgpassword kodeword authorization".split()
)
#: Words that turn an identifier away from the value itself.
AWAY_WORDS = frozenset("column name file path env type count length min max header url uri ref id ids public cache primary foreign format prefix suffix size hash checksum sha sha256 sha1 md5 digest lock build version commit revision field label title message text help policy rule required expires ttl timeout algorithm host port user username".split())
_PLACEHOLDER = re.compile(
    r"^[\W_]*$|^[$@%][{(]?[\w.-]+[})@%]?$|^\$\w*$|^\$[({]|^\{\{?|\{[a-z_][\w.]*\}|^<[^>]*>$|^%\(|^@[\w.]+@$|\$\{|\{\{|^\{\w*\}$|^[*xX•.#?_-]{3,}$|x{5,}|X{5,}|\*{3,}|(?i:replace|change[-_ ]?me|your[-_ ]|example$|placeholder|dummy|redacted|todo|fixme|insert|<.*here>|not[-_ ]?set|undefined|^none$|^null$|^true$|^false$|^test$|^secret$|^password$|^token$|^changeit$|^required$|^optional$|^string$|^default$|^masked$)"
)
_PATHLIKE = re.compile(r"^(?:[a-zA-Z]:)?[./~\\]|^data:\w+/|^[\w.-]+(?:/[\w.{}-]+)+/?$|^\w+://[^:@]*$|\.(?:py|pem|json|ya?ml|txt|csv|parquet|key|crt|cfg|ini|toml|example|internal)$")
_HEX = re.compile(r"^(?:[0-9a-f]{24,}|[0-9A-F]{24,}|sha\d+:[0-9a-f]+|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})$")
_UUID = re.compile(r"^[0-9a-f]{8}-[0-9a-f]{4}-", re.I)

_LINE_VALUE = r"[^\s\"'<>`()\[\]{}\\|]+"
_VALUE = r"[^\s\"'<>;&,`()\[\]{}\\|]+"
_SCAN: list[tuple[str, re.Pattern]] = [
    # (syntax, pattern with groups name? and value)
    ("userinfo", re.compile(r"\b(?P<name>[a-z][a-z0-9+.-]*)://[^\s/:@\"'<>]*:(?P<value>[^\s/@\"'<>]+)@")),
    ("pair", re.compile(r"\\?\"(?P<name>[\w .-]+)\\?\"\s*:\s*\\?\"(?P<value>(?:[^\"\\\n]|\\[^\"\n])*)\\?\"|'(?P<name2>[\w .-]+)'\s*:\s*'(?P<value2>[^'\n]*)'")),
    ("attribute", re.compile(r"\b(?:name|key|id)=[\"'](?P<name>[\w.:-]+)[\"']\s+(?:value|content)=[\"'](?P<value>[^\"'\n]*)[\"']")),
    ("scheme", re.compile(r"\b(?P<name>[Bb]earer|[Bb]asic|BEARER)[ ]+(?P<value>[A-Za-z0-9._~+/=-]{6,})")),
    ("header", re.compile(r"\b(?P<name>X-[A-Za-z-]+|[Aa]uthorization|[Aa]pi-?[Kk]ey|[Pp]rivate-[Tt]oken)[ ]*:[ ]*(?![Bb]e?a)(?P<value>[^\s\"'\\]+)")),
    ("parameter", re.compile(r"[?&;](?P<name>[A-Za-z_][\w .-]*)=(?P<value>[^&;\s\"'<>]+)")),
    ("element", re.compile(r"<(?P<name>[\w:.-]+)>(?P<value>[^<>\n]+)</(?P=name)>")),
    ("flag", re.compile(r"(?<!\S)--(?P<name>[a-z][\w-]*)[= ](?P<value>[^\s\"']+)")),
    ("flag", re.compile(r"\b(?P<name>curl|wget|http)\b[^\n]*?[ ](?:-u|--user|--proxy-user)[ =][\"']?[\w.@-]+:(?P<value>[^\s\"']+)")),
    ("flag", re.compile(r"\b(?P<name>sshpass|mysql\w*|mariadb|redis-cli|mongo\w*)\b[^\n]*?[ ]-(?:p|a)[ ]?[\"']?(?P<value>[^\s\"']{4,})")),
    ("bare", re.compile(r"\bexport[ \t]+(?P<name>\w+)=(?P<value>[^\s\"'`]+(?:[ ](?!and\b|&&)[^\s\"'`]+)*)")),
    ("flag", re.compile(r"\becho[ ]+[\"']?(?P<value>[^\s\"'|$]+)[\"']?[ ]*\|[^\n]*?--(?P<name>password-stdin|with-token|passphrase-fd)")),
    ("npmrc", re.compile(r":(?P<name>_(?:authToken|auth|password))=(?P<value>[^\s\"']+)")),
]
_COMMENTED = [
    ("said", re.compile(r"(?im)(?:#|//|;|--|<!--|\*|\"\"\")[^\n]*?\b(?P<name>password|passwd|pass|pw|pwd|key|token|secret|login|credentials?|kennwort|clave)[ \t]+(?:was|is|ist|=)\s+(?P<value>\S.*?)(?=\s{2,}|\s*\(|\s*-->|\s*\"\"\"|[ \t\r]*$)")),
    ("said", re.compile(r"(?im)(?:#|//|;|--|<!--|\*)[^\n]*?\b(?P<name>password|passwd|pass|pw|pwd|key|token|secret|credentials?|passphrase|kennwort|clave)\b[^:\n\"'=]{0,30}:[ \t]+(?P<value>\S.*?)(?=[ \t]*-->|[ \t\r]*$)")),
    ("said", re.compile(r"(?im)\b(?P<name>password|passwd|passphrase)[ \t]+(?P<value>[^\s\"'=:,]{5,})[ \t\r]*$")),
    ("said", re.compile(r"(?im)(?:#|//|;|--|<!--|\*)[^\n]*?\b(?P<name>log ?in|user|account|connect|signin)\b[^\n]{0,30}?[ \t]/[ \t](?P<value>\S.*?)(?=[ \t]*-->|[ \t\r]*$)")),
    ("said", re.compile(r"(?im)^[ \t]*(?:#|//|;|--|<!--)[ \t]*(?P<value>\S.*?)[ \t]*(?:<-+|<=|=>|->)[ \t]*[^\n]*?\b(?P<name>password|passwd|pw|key|token|secret|login)\b")),
]
#: Unquoted values, searched from their separator: to the end of the line, or one word.
_BARE = re.compile(rf"(?m)(?:=([ \t]*)|:([ \t]+))({_LINE_VALUE}+(?:[ ]{_LINE_VALUE}+)*)(?=[ \t\r]*$|[ ]and\b)").search
_BARE_WORD = re.compile(rf"=({_VALUE}+)").search
_BARE_NAME = re.compile(r"([\w.-]*)").match
_BARE_SPACE = re.compile(r"[ \t]*").match
_NAME_END = re.compile(r"\b[A-Za-z_][\w.-]*\Z").search
_ENV = re.compile(r"(?m)^[ \t]*ENV[ \t]+(?P<name>\w+)[ \t]+(?P<value>[^\n]*?\S)[ \t\r]*$")
_STRING = re.compile(r"(?<![\w\"'])(?:[rRuUbBfF]{0,2})(?:\"(?!\"\")(?P<a>(?:[^\"\\\n]|\\.)*)\"|'(?!'')(?P<b>(?:[^'\\\n]|\\.)*)')")
_JOIN = re.compile(r"[ \t]*\\?\r?\n?[ \t]*(?:\+[ \t]*\\?\r?\n?[ \t]*)?(?:[rRuUbBfF]{0,2})(?:\"(?!\"\")((?:[^\"\\\n]|\\.)*)\"|'(?!'')((?:[^'\\\n]|\\.)*)')")
#: What stands before a literal, read backwards from its quote: identifier, call or key, however far back it begins.
_OF = {
    "second": re.compile(r"\s*,\s*[\"'](?P<name>[\w.@-]*)[\"']\s*\((?P<call>[\w.]+)"),
    "tuple": re.compile(r"\s*,\s*[\"'][\w.@ -]*[\"']\s*[\[(]\s*=(?:[ \t]*\w+[ \t]*:)?[ \t]*(?P<name>[\w.]+)"),
    "index": re.compile(r"\s*\(?\s*=\s*\][\"'](?P<name>[\w.-]+)[\"']\["),
    "compare": re.compile(r"\s*=[=!]\s*(?P<name>[\w.]+)"),
    "wrapped": re.compile(r"\s*\((?P<call>[\w.]+)\s*=[ \t]*(?:[\w\[\]. ]+[ \t]*:)?[ \t]*(?P<name>[\w.-]+)"),
    "assign": re.compile(r"\s*\(?\s*=[ \t]*(?:[\w\[\]. ]+[ \t]*:)?[ \t]*[\"']?(?P<name>[\w.-]+)"),
    "key": re.compile(r"\s*\(?\s*:\s*[\"']?(?P<name>[\w.-]+)"),
    "argument": re.compile(r"\s*(?:,[^()\"']*)?\((?P<name>[\w.]+)"),
}
#: Which of them can hold, by the last character before the literal.
_BEFORE = {last: [(k, _OF[k].match) for k in kinds.split()] for last, kinds in {"=": "compare index assign", ":": "key", "(": "index wrapped assign key argument", ",": "second tuple argument", "[": "", "{": ""}.items()}
_LAST = re.compile(r"\s*(\S)").match
_OPENER = re.compile(r"\s*=(?:[\w\[\]. ]+[ \t]*:)?[ \t]*([\w.]+)").match
_CALLED = re.compile(r"[\w.]+").match
_NOTE = re.compile(r"[^#\n]{0,4}#[ \t]*([^\n]*)").match
_COLON = re.compile(r"[ \t]*:").match
_BRACKET = re.compile(r"#[^\n]*|[\[\](){}]")
_ARGUMENT = re.compile(r"[\w-]{2,}").fullmatch
_FOREIGN = re.compile(r"://|\b[Bb]earer |\b[Bb]asic |[;&?]\w+=")
_QUOTE_END = re.compile(r"[\"'](?=[\s,)}\]]|$)")


_OPENERS = {")": "(", "]": "[", "}": "{"}


class _Brackets:
    """The calls, lists, tuples and dictionaries that are open at a place; places must be asked for in text order."""

    def __init__(self, text: str):
        self.text, self.at, self.open, self.literals = text, 0, [], []

    def skip(self, start: int, stop: int, value: str) -> None:
        """A literal stands here; the code before it is read only when somebody asks for a bracket."""
        self.literals.append((start, stop, value))

    def go(self, to: int) -> None:
        """Read everything up to here."""
        for start, stop, value in self.literals:
            self._read(start)
            self.at = stop
            if self.open and _ARGUMENT(value):
                self.open[-1][2] = value
        self.literals.clear()
        self._read(to)

    def _read(self, to: int) -> None:
        for m in _BRACKET.finditer(self.text, self.at, to):
            c = m[0]
            if c in "([{":
                self.open.append([c, m.start(), "", False])
            elif (opener := _OPENERS.get(c)) and self.open:
                if self.open[-1][0] == opener:
                    self.open.pop()
                elif any(o[0] == opener for o in self.open):
                    while self.open.pop()[0] != opener:
                        pass
                else:
                    continue
                if self.open:
                    self.open[-1][3] = True
        self.at = max(self.at, to)


def _open_list(brackets: _Brackets, text: str, back: str) -> tuple[str, str]:
    """(identifier, syntax) of the innermost bracket that is open, if nothing nested in it has closed yet."""
    if not brackets.open or brackets.open[-1][3]:
        return "", "string"
    kind, opened, last, _ = brackets.open[-1]
    n = len(text)
    if kind == "(" and (hit := _CALLED(back, n - opened)):
        return f"{hit[0][::-1]} {last}".strip(), "argument"
    hit = _OPENER(back, n - opened)
    return (hit[1][::-1], "list") if hit else ("", "string")


#: What a match of a pattern must hold, in small letters where it ignores case: every group, at least one of it. Nothing that could match is skipped.
_WORDS_SAID = ("passw", "pass", "pw", "key", "token", "secret", "login", "log in", "credential", "kennwort", "clave")
_MARKS = ("#", "//", ";", "--", "*", '"""')
_NEEDS = [
    [("://",)], [(":",), ('"', "'")], [("=",), ("value=", "content=")], [("earer", "asic", "BEARER")], [(":",), ("X-", "uthorization", "pi-", "piK", "pik", "Pi-", "rivate-")], [("=",), ("?", "&", ";")], [("</",)], [("--",)],
    [(" -u", " --user", " --proxy-user"), ("curl", "wget", "http")], [(" -p", " -a"), ("sshpass", "mysql", "mariadb", "redis-cli", "mongo")], [("export",)], [("echo",), ("--password-stdin", "--with-token", "--passphrase-fd")], [(":_",)],
]
_NEEDS_SAID = [[_MARKS, _WORDS_SAID], [_MARKS, _WORDS_SAID + ("passphrase",), (":",)], [("passw", "passphrase")], [_MARKS, ("log", "user", "account", "connect", "signin"), ("/ ", "/\t")], [("#", "//", ";", "--"), _WORDS_SAID, ("<-", "<=", "=>", "->")]]
_WORDS_ALL = (*_WORDS_SAID, "passphrase", "log", "user", "account", "connect", "signin")
#: From a mark of a comment to the end of its line.
_MARKED = re.compile(r"(?:#|//|;|--|\*|\"\"\")[^\n]*")
_SHAPE_STARTS = ("AKIA", "ASIA", "k_live_", "k_test_", "gh", "glpat-", "xox", "AIza", "eyJ", "npm_", "SG.")


def _possible(needs: list[tuple[str, ...]], text: str) -> bool:
    for group in needs:
        for word in group:
            if word in text:
                break
        else:
            return False
    return True


SYNTAXES = ("userinfo", "pair", "attribute", "scheme", "header", "parameter", "element", "flag", "npmrc", "said", "bare", "env", "second", "tuple", "index", "compare", "wrapped", "assign", "key", "argument", "list", "string", "shape", "block")


_IDENTIFIER = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-zß-ÿ]+|\d+")


@lru_cache(1 << 15)
def identifier_words(name: str) -> tuple[str, ...]:
    """Words of an identifier, small."""
    words = [w.lower() for w in _IDENTIFIER.findall(name)]
    return tuple(w[:-1] if len(w) > 4 and w.endswith("s") and w[:-1] in SECRET_WORDS else w for w in words)


@lru_cache(1 << 16)
def is_placeholder(value: str) -> bool:
    """Masks, variables, templates and words that stand for a value."""
    return bool(_PLACEHOLDER.search(value)) or len(set(value)) <= 2


def scan(text: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, value, identifier, syntax) of the candidates of a text; they never overlap."""
    taken = bytearray(len(text) + 1)
    find = taken.find

    def take(a: int, b: int) -> bool:
        if b <= a or find(1, a, b) >= 0:
            return False
        taken[a:b] = b"\1" * (b - a)
        return True

    if "-----BEGIN" in text:
        for m in PRIVATE_KEY.finditer(text):
            end = m.end()
            quote = _QUOTE_END.search(text, m.start(), end) if not m[0].rstrip().endswith("-----") else None
            end = quote.start() if quote else end
            if take(m.start(), end):
                yield m.start(), end, text[m.start() : end], "private key", "block"
        for m in PUBLIC_BLOCK.finditer(text):
            taken[m.start() : m.end()] = b"\1" * (m.end() - m.start())
    for needs, (syntax, pattern) in zip(_NEEDS, _SCAN, strict=True):
        if not _possible(needs, text):
            continue
        for m in pattern.finditer(text):
            g = m.groupdict()
            which = "value2" if g.get("value2") is not None else "value"
            a, b = m.span(which)
            inner = m[which]
            if syntax == "pair" and _FOREIGN.search(inner) and (TOKEN_SHAPES.search(inner) is None):
                continue
            if take(a, b):
                yield a, b, inner, g.get("name2") or g["name"] or "", syntax
    for a, b, value, name in _said_values(text, text.casefold()):
        if take(a, b):
            yield a, b, value, name, "said"
    if '"' in text or "'" in text:
        yield from _literals(text, taken, take)
    if "=" in text or ":" in text:
        yield from _bare_values(text, take)
    elif "ENV" in text:
        for m in _ENV.finditer(text):
            a, b = m.span("value")
            if take(a, b):
                yield a, b, m["value"], m["name"], "env"
    if any(start in text for start in _SHAPE_STARTS):
        for m in TOKEN_SHAPES.finditer(text):
            if take(*m.span()):
                yield *m.span(), m[0], "", "shape"


def _bare_values(text: str, take: Callable[[int, int], bool]) -> Iterator[tuple[int, int, str, str, str]]:
    """The candidates without quotes that nothing else has taken; each value is found by its separator and its identifier read backwards from there."""
    if "ENV" in text:
        for m in _ENV.finditer(text):
            a, b = m.span("value")
            if take(a, b):
                yield a, b, m["value"], m["name"], "env"
    back, n = text[::-1], len(text)
    pos = 0
    while m := _BARE(text, pos):
        at = m.start()
        named = _BARE_NAME(back, n - at)
        if not named[1] and m[1]:  # blanks on both sides of the sign
            named = _BARE_NAME(back, _BARE_SPACE(back, n - at).end())
        name = _NAME_END(named[1][::-1]) if named[1] else None
        # an identifier that begins within a value found before belongs to that value
        if name is None or n - named.end() + name.start() < pos:
            pos = at + 1 if name is None or at + 1 > pos else pos
            continue
        a, b = m.span(3)
        pos = b
        if take(a, b):
            yield a, b, m[3], name[0], "bare"
    pos = 0
    while m := _BARE_WORD(text, pos):
        at = m.start()
        named = _BARE_NAME(back, n - at)
        run = named[1][::-1].rpartition(".")[2]
        name = _NAME_END(run) if run else None
        if name is None or at - len(run) + name.start() < pos:
            pos = at + 1
            continue
        a, b = m.span(1)
        pos = b
        if take(a, b):
            yield a, b, m[1], name[0], "bare"


def _said_values(text: str, small: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, value, name) of values that a comment names, by pattern and place; only lines with a mark and a word are searched."""
    words = [w for w in _WORDS_ALL if w in small]
    if not words:
        return
    aligned = len(small) == len(text)
    spoken = [m.span() for m in _MARKED.finditer(text) if not aligned or any(small.find(w, *m.span()) >= 0 for w in words)]
    for needs, (_, pattern) in zip(_NEEDS_SAID, _COMMENTED, strict=True):
        if not _possible(needs, small):
            continue
        if needs[0] is not _MARKS:
            for m in pattern.finditer(text):
                yield *m.span("value"), m["value"], m["name"] or "key"
            continue
        pos = 0
        for a, b in spoken:
            at = max(a, pos)
            while at < b and (m := pattern.search(text, at)) and m.start() < b:
                yield *m.span("value"), m["value"], m["name"] or "key"
                pos = at = m.end()


def _literals(text: str, taken: bytearray, take: Callable[[int, int], bool]) -> Iterator[tuple[int, int, str, str, str]]:
    """The candidates among string literals that nothing else has taken."""
    at, n, back, brackets = 0, len(text), text[::-1], _Brackets(text)
    while m := _STRING.search(text, at):
        which = "a" if m["a"] is not None else "b"
        a, b = m.span(which)
        at = m.end()
        value, first_end = m[which], b
        while (follow := _JOIN.match(text, at)) and not text[at : follow.start()].strip():
            value += follow[1] if follow[1] is not None else follow[2]
            b = follow.end() - 1
            at = follow.end()
        if not value or taken.find(1, a, first_end) >= 0:
            brackets.skip(m.start(), at, value)
            continue
        name, syntax, here = "", "string", n - m.start()
        last = found[1] if (found := _LAST(back, here)) else ""
        for kind, match in _BEFORE.get(last, ()):
            if hit := match(back, here):
                g = hit.groupdict()
                name = g["name"][::-1]
                name = f"{g['call'][::-1]} {name}" if kind == "second" else f"{name} {g['call'][::-1]}" if kind == "wrapped" else name
                syntax = kind
                break
        else:
            if last and last in "[({,":
                brackets.go(m.start())
                name, syntax = _open_list(brackets, text, back)
        brackets.skip(m.start(), at, value)
        note = _NOTE(text, b + 1)
        if note and not SECRET_WORDS.isdisjoint(identifier_words(note[1])):
            name += " " + note[1]
        if syntax in ("list", "string", "argument") and _COLON(text, b + 1):
            continue  # the key of an entry
        if take(a, b):
            yield a, b, value, name.strip(), syntax


#: Words that name a secret whatever else they stand beside.
_STRONG = SECRET_WORDS - frozenset("key pin hook session login phrase sas sig signature".split())


#: Calls that take a password.
_SIGN_IN = frozenset("connect login authenticate auth signin logon connection client session engine".split())


_SMALL, _CAPITAL, _NUMERAL, _SIGN = (re.compile(p).search for p in ("[a-z]", "[A-Z]", "[0-9]", r"[^\w\s]|_"))
_DIGIT = re.compile(r"\d").search
_TELLING = re.compile(r"[A-Z ]|\d{2}").search
_SHORT_SECRET = re.compile(r"(?=.*\d)[\dA-Za-z]{4}").fullmatch
_PLAIN_WORDS = re.compile(r"[a-z ,.:_-]+|[A-Z_]+|\d+").fullmatch
_TOOLS = re.compile("curl|wget|http|sshpass|mysql|maria|redis|mongo|password-stdin").match
_KEY_BODY = re.compile(r"(?s)KEY(?: BLOCK)?-----(.*?)(?:-----END|\Z)").search


@lru_cache(1 << 16)
def weak_label(value: str, name: str, syntax: str) -> int:
    """1 credential, 0 not, -1 unknown or decided elsewhere: what plain patterns can tell."""
    if syntax == "block":
        body = _KEY_BODY(value)[1].strip("\\n \t\r\"'+")
        return -1 if not body or is_placeholder(body) else 1
    if is_placeholder(value):
        return -1
    words = set(identifier_words(name))
    secret, away, strong = not SECRET_WORDS.isdisjoint(words), not AWAY_WORDS.isdisjoint(words), not _STRONG.isdisjoint(words)
    if len(value) < 5:
        return -1 if secret and not away and _SHORT_SECRET(value) else 0
    if TOKEN_SHAPES.match(value):
        return 1
    digit = bool(_DIGIT(value))
    mixed = sum(find(value) is not None for find in (_SMALL, _CAPITAL, _NUMERAL, _SIGN))
    if _PATHLIKE.search(value):
        return 0
    if syntax in ("userinfo", "npmrc") or syntax == "scheme" and (digit or value.endswith("=")) or syntax == "flag" and _TOOLS(name):
        return 1
    if "hmac" in words and digit and mixed >= 3 and len(value) >= 8:
        return 1
    if not secret:
        if syntax == "argument" and digit and len(value) >= 8 and not _SIGN_IN.isdisjoint(words) and (mixed >= 3 or " " in name and _SMALL(value) and "." not in value):
            return 1
        if syntax == "compare" and digit and len(value) >= 8 and (mixed >= 3 or " " in value):
            return 1
        return 0 if syntax not in ("said", "compare", "argument", "second", "tuple", "header") or mixed < 3 else -1
    if identifier_words(name)[-1] in AWAY_WORDS:
        return 0
    if not away:
        if mixed >= 3 and len(value) >= 8 and " " not in value:
            return 1
        if strong and (_HEX.match(value) or digit and len(value) >= 8 and _SMALL(value) and value.count(" ") <= 5 and _TELLING(value)):
            return 1
    if _PLAIN_WORDS(value):
        return 0
    return -1


# ---- features: of the value, of the identifier and of the path, each kept for the next candidate that has the same

_KINDS = str.maketrans({chr(o): "d" if chr(o).isdigit() else "u" if chr(o).isupper() else "l" if chr(o).islower() else "o" for o in range(128)})
_LOWER_WORDS = re.compile(r"[a-z]+(?:[_. -][a-z]+)*[.:!?]?").fullmatch
_CAPITALS = re.compile(r"[A-Z][A-Z_]+").fullmatch
_NUMBERS = re.compile(r"\d+(?:\.\d+)*").fullmatch
_CODE_SIGNS = re.compile(r"[(){}\[\]]|%s").search
_TEST_PATH = re.compile(r"test|example|sample|fixture|mock", re.I).search
#: Dense features of the value (with its Markov ratio), of both together, of the identifier; then syntaxes, hashed words, path.
_OF_VALUE, _OF_BOTH, _OF_NAME, _HASHED, _PATHS = 19, 2, 5, 32, 8
WIDTH = 1 + _OF_VALUE + _OF_BOTH + _OF_NAME + len(SYNTAXES) + _HASHED + _PATHS


def value_features(value: str, ratio: float) -> tuple[list[float], float, float]:
    """(dense features, is a hexadecimal number, has digits) of a value; ``ratio`` is its Markov log-likelihood ratio per character."""
    n = len(value)
    kinds = value.translate(_KINDS) if value.isascii() else "".join("d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o" for c in value)
    digits, upper = kinds.count("d"), kinds.count("u")
    other = kinds.count("o") - value.count(" ")
    turns = sum(map(ne, kinds, kinds[1:]))
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0
    hexadecimal = float(_HEX.match(value) is not None)
    blanks = value.count(" ")
    dense = [
        max(-6.0, min(6.0, ratio)), min(n, 64) / 32, digits / max(1, n), upper / max(1, n), other / max(1, n), turns / max(1, n - 1), entropy / 4,
        float(TOKEN_SHAPES.match(value) is not None), hexadecimal, float(_UUID.match(value) is not None), float(_PATHLIKE.search(value) is not None), float(blanks > 0), float(blanks > 4),
        float(_LOWER_WORDS(value) is not None), float(_CAPITALS(value) is not None), float(_NUMBERS(value) is not None), float(_CODE_SIGNS(value) is not None),
        float(n < 6), float(n >= 20 and turns / n > 0.25 and not blanks),
    ]
    return dense, hexadecimal, float(digits > 0)


@lru_cache(1 << 15)
def name_features(name: str) -> tuple[list[float], list[int], bool]:
    """(dense features, cells of the hashed words, names a secret) of an identifier."""
    words = identifier_words(name)
    secret, away = not SECRET_WORDS.isdisjoint(words), not AWAY_WORDS.isdisjoint(words)
    dense = [float(secret), float(away), float(bool(words) and words[-1] in SECRET_WORDS), float(bool(words) and words[-1] in AWAY_WORDS), float(not words)]
    return dense, sorted({zlib.crc32(w.encode()) % _HASHED for w in words}), secret


@lru_cache(1 << 12)
def path_features(path: str) -> list[int]:
    """Cells of a path: its ending, whether it is a test's, whether it is code."""
    ending = path.replace("\\", "/").rsplit("/", 1)[-1].rsplit(".", 1)[-1].lower()
    return [zlib.crc32(ending.encode()) % 6] + [6] * bool(_TEST_PATH(path)) + [7] * (ending in ("py", "js", "java", "go"))


def features(value: str, name: str, syntax: str, path: str, ratio: float) -> np.ndarray:
    """The feature vector."""
    dense, hexadecimal, digits = value_features(value, ratio)
    named, cells, secret = name_features(name)
    out = np.zeros(WIDTH)
    at = 1 + _OF_VALUE + _OF_BOTH + _OF_NAME
    out[:at] = [1.0, *dense, *((hexadecimal, digits) if secret else (0.0, 0.0)), *named]
    out[at + SYNTAXES.index(syntax)] = 1.0
    for cell in cells:
        out[at + len(SYNTAXES) + cell] = 1.0
    for cell in path_features(path):
        out[at + len(SYNTAXES) + _HASHED + cell] = 1.0
    return out


class Scorer:
    """Probability of candidates: the same sum of weights as ``features`` times ``weights``, with the parts of value and identifier kept."""

    def __init__(self, models: Markov, weights: np.ndarray):
        w = weights.tolist()
        a, b, c = 1 + _OF_VALUE, 1 + _OF_VALUE + _OF_BOTH, 1 + _OF_VALUE + _OF_BOTH + _OF_NAME
        d = c + len(SYNTAXES)
        of_syntax = dict(zip(SYNTAXES, w[c:d], strict=True))

        @lru_cache(1 << 16)
        def of_value(value: str) -> tuple[float, float]:
            dense, hexadecimal, digits = value_features(value, models.ratio(value))
            return w[0] + sum(x * y for x, y in zip(dense, w[1:a], strict=True)), hexadecimal * w[a] + digits * w[a + 1]

        @lru_cache(1 << 15)
        def of_name(name: str) -> tuple[float, bool]:
            dense, cells, secret = name_features(name)
            return sum(x * y for x, y in zip(dense, w[b:c], strict=True)) + sum(w[d + k] for k in cells), secret

        @lru_cache(1 << 12)
        def of_path(path: str) -> float:
            return sum(w[d + _HASHED + k] for k in path_features(path))

        def score(value: str, name: str, syntax: str, path: str) -> float:
            plain, with_secret = of_value(value)
            named, secret = of_name(name)
            z = plain + named + (with_secret if secret else 0.0) + of_syntax[syntax] + of_path(path)
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

        self.score = score


# ---- character Markov models

_ALPHABET = 98


def codes_of(values: list[str]) -> np.ndarray:
    """Codes of all characters with a mark (0) before, between and after the values."""
    text = "\0" + "\0".join(v.replace("\0", "\1") for v in values) + "\0"
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.where((points >= 32) & (points < 127), points - 31, np.where(points == 0, 0, _ALPHABET - 1))


def count_pairs(values: list[str], into: np.ndarray) -> None:
    """Counts of neighbouring characters, with a mark at both ends of each value."""
    if values:
        codes = codes_of(values)
        into += np.bincount(codes[:-1] * _ALPHABET + codes[1:], minlength=_ALPHABET * _ALPHABET).reshape(_ALPHABET, _ALPHABET)


class Markov:
    """Log-likelihood ratio per character of the two models."""

    def __init__(self, secret: np.ndarray, other: np.ndarray):
        smooth = lambda c: np.log((c + 0.1) / (c + 0.1).sum(1, keepdims=True))
        self.table = smooth(secret) - smooth(other)

    def ratio(self, value: str) -> float:
        codes = codes_of([value])
        return float(self.table[codes[:-1], codes[1:]].mean())


def find_candidates(texts: DataFrame) -> DataFrame:
    """Candidates of texts (src_table, row_id, path, text) with line, span and weak label. Null and empty texts give none."""
    fields = [("src_table", pa.string()), ("row_id", pa.int64()), ("path", pa.string()), ("line_no", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("value", pa.string()), ("name", pa.string()), ("syntax", pa.string()), ("label", pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for table, row, path, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = sorted(scan(text))
                line, seen = 1, 0
                for a, b, value, name, syntax in found:
                    line += text.count("\n", seen, a)
                    seen = a
                    rows.append((table, row, path or "", line, a, b, value, name, syntax, weak_label(value, name, syntax)))
            columns = list(zip(*rows, strict=True)) or [()] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], schema=pa.schema(fields))

    wanted = texts.where("text is not null and text <> ''").select("src_table", F.col("row_id").cast("long"), "path", "text")
    return wanted.mapInArrow(run, "src_table string, row_id long, path string, line_no int, start int, stop int, value string, name string, syntax string, label int")


def markov_models(candidates: DataFrame) -> Markov:
    """Both models, counted over all candidates; counts are added up in the workers, so only tables of 98 x 98 travel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, _ALPHABET, _ALPHABET))
        for batch in batches:
            values, labels = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for k in (0, 1):
                count_pairs([v for v, label in zip(values, labels, strict=True) if label == k], counts[k])
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts.ravel()[at])], names=["cell", "n"])

    cells = candidates.where("label >= 0").select("value", "label").mapInArrow(run, "cell int, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(2 * _ALPHABET * _ALPHABET)
    for row in cells:
        counts[row["cell"]] = row["n"]
    other, secret = counts.reshape(2, _ALPHABET, _ALPHABET)
    return Markov(secret, other)


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights of a penalised logistic regression by Newton steps; both labels weigh the same."""
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (share * (p - y)) + penalty * w
        hess = (x * (share * p * (1 - p) + 1e-6)[:, None]).T @ x + penalty * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-5:
            break
    return w


def calibrate(raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn raw scores into probabilities of the held-out labels."""
    if not len(raw) or y.min() == y.max():
        return 1.0, 0.0
    a, b = fit_logistic(np.stack([raw, np.ones_like(raw)], 1), y, penalty=0.01)
    return float(a), float(b)


def train(candidates: DataFrame, max_fit: int = MAX_FIT) -> tuple[Markov, np.ndarray]:
    """The Markov models and the calibrated weights. Without both labels nothing is learned and all scores are 0.5."""
    models = markov_models(candidates)
    keyed = candidates.where("label >= 0").select("value", "name", "syntax", "path", "label", F.xxhash64("value", "name", "row_id", "start").alias("h"))
    half = [keyed.where(F.col("label") == k).orderBy("h").limit(max_fit // 2) for k in (0, 1)]
    rows = half[0].unionByName(half[1]).toPandas()
    if rows.empty or rows["label"].nunique() < 2:
        return models, np.zeros(WIDTH)
    x = np.stack([features(v, n, s, p, models.ratio(v)) for v, n, s, p in zip(rows["value"], rows["name"], rows["syntax"], rows["path"], strict=True)])
    y = rows["label"].to_numpy(float)
    held = rows["h"].to_numpy() % 5 == 0
    w = fit_logistic(x[~held], y[~held])
    a, b = calibrate(x[held] @ w, y[held])
    w = w * a
    w[0] += b
    return models, w


def score_candidates(candidates: DataFrame, models: Markov, weights: np.ndarray) -> DataFrame:
    """``candidates`` with their calibrated probability; placeholders have 0."""
    names = ["src_table", "row_id", "line_no", "start", "stop", "syntax", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(models, weights)
        for batch in batches:
            scores = []
            for value, name, syntax, path in zip(*(c.to_pylist() for c in batch.columns[6:10]), strict=True):
                scores.append(0.0 if syntax != "block" and is_placeholder(value) else scorer.score(value, name, syntax, path))
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(scores, pa.float64())], names=names)

    own = candidates.select("src_table", "row_id", "line_no", "start", "stop", "syntax", "value", "name", F.col("syntax").alias("kind"), "path")
    return own.mapInArrow(run, "src_table string, row_id long, line_no int, start int, stop int, syntax string, score double")


def find_credentials(texts: DataFrame, max_fit: int = MAX_FIT, threshold: float = THRESHOLD) -> DataFrame:
    """(src_table, row_id, line_no, start, stop, syntax, score) of every credential. Repeated rows are judged one by one; empty tables give no row."""
    candidates = cut(find_candidates(texts))
    models, weights = train(candidates, max_fit)
    return score_candidates(candidates, models, weights).where(F.col("score") > threshold)


def redact_credentials(texts: DataFrame, found: DataFrame) -> DataFrame:
    """(src_table, row_id, text): every credential replaced by [REDACTED], its quotes, line ends and all other text kept."""
    spans = found.groupBy("src_table", "row_id").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("spans"))

    @F.pandas_udf("string")
    def rewrite(text, spans):
        out = []
        for t, own in zip(text, spans, strict=True):
            if t is None or own is None:  # evaluated for every row, whatever stands around it
                out.append(t)
                continue
            parts, at = [], 0
            for s in own:
                if s["start"] >= at:
                    lines = re.findall(r"\r?\n", t[s["start"] : s["stop"]])  # a value over several lines keeps its line count
                    parts += [t[at : s["start"]], "[REDACTED]", *lines]
                    at = s["stop"]
            out.append("".join([*parts, t[at:]]))
        return type(text)(out)

    joined = texts.join(spans, ["src_table", "row_id"], "left")
    return joined.select("src_table", "row_id", F.when(F.col("spans").isNull(), F.col("text")).otherwise(rewrite("text", "spans")).alias("text"))
