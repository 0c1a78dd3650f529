"""Column functions on text: masks, scans, token sets. ASCII character classes only, so every engine agrees."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: patterns of identifiers and literals
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
URL = r"https?://[^\s<>\"')\]]+"
CODE_HOST = r"https?://(?:www\.)?(?:github|gitlab|codehost)\.[^\s<>\"')\]]+"
HASH = r"\b[0-9a-f]{40}\b"
TIMESTAMP = r"[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2})?Z?"
IP = r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"
PHONE = r"\+[0-9]{1,3}[ .-]?[0-9(][0-9 ().-]{6,}[0-9]"
LONG_NUMBER = r"\b[0-9]{6,}\b"
SECRET_ASSIGNMENT = r"(?i)\b(api_?key|secret|token|passwd|password|access_?key|private_?key)(\s*[=:]\s*)[\"'][^\"'\n]{4,}[\"']"
ANY_HASH = r"\b[0-9a-fA-F]{7,40}\b"
USER_FOLDER = r"(?:/home/|/Users/|C:\\{1,2}Users\\{1,2})([A-Za-z0-9_.-]+)"
DOTTED_MODULE = r"\b[a-z_][a-z0-9_]*(?:\.[a-z_][a-z0-9_]*){2,}\b"
FILE_PATH = r"\b[A-Za-z0-9_.-]+(?:/[A-Za-z0-9_.-]+)+\.[A-Za-z]{1,5}\b"


def distinct_matches(text: Column, pattern: str) -> Column:
    """Distinct matches in order of appearance; empty for null text."""
    return F.coalesce(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), F.array().cast("array<string>"))


def mask_whole(value: Column) -> Column:
    """The placeholder of a value that is one literal as a whole, else the value."""
    return F.when(value.rlike(f"^{CODE_HOST}"), "[REPO_URL]").when(value.rlike("^https?://"), "[URL]").when(value.rlike("^[0-9a-f]{40}$"), "[HASH]").otherwise(value)


def mask_inside(text: Column) -> Column:
    """Secrets, addresses, links and hashes within a text, masked in this order; idempotent."""
    steps = [(SECRET_ASSIGNMENT, "$1$2[SECRET]"), (EMAIL, "[EMAIL]"), (CODE_HOST, "[REPO_URL]"), (URL, "[URL]"), (HASH, "[COMMIT_ID]")]
    return reduce(lambda t, s: F.regexp_replace(t, s[0], s[1]), steps, text)


def value_category(value: Column) -> Column:
    """SAFE, PROVENANCE, LITERAL, STRUCTURAL or UNKNOWN by the shape of a value; the first that fits."""
    return (
        F.when(value.isNull() | value.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), "SAFE")
        .when(F.trim(value).rlike("^[0-9a-f]{40}$") | value.rlike("[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}") | value.rlike(r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z]+"), "PROVENANCE")
        .when(value.rlike(r"https?://[^\s]"), "LITERAL")
        .when(value.rlike(r"[A-Za-z0-9_./-]+\.(?:py|json|yaml|yml|txt|md|csv|sh|cfg|ini|toml)") | F.trim(value).rlike(r"^[a-z_]+(?:\.[a-z_]+)+$"), "STRUCTURAL")
        .otherwise("UNKNOWN")
    )


def tokens(text: Column) -> Column:
    """Distinct small tokens between blanks, in order."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda t: t != ""))


def ngrams(words: Column, n: int) -> Column:
    """n-grams of an array of words."""
    last = F.size(words) - (n - 1)
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))


def name_similarity(a: Column, b: Column) -> Column:
    """Shared parts of two names by the greater number of parts."""
    split = lambda c: F.array_distinct(F.filter(F.split(c, r"[._]"), lambda t: t != ""))
    x, y = split(a), split(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.greatest(F.size(x), F.size(y))), F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Shared by united elements; two empty sets are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def estimated_tokens(text: Column) -> Column:
    """A fourth of the characters, at least 1; 0 for an empty text."""
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(F.length(text) / 4))).cast("int")


def truncated(text: Column, limit: int) -> Column:
    """The first ``limit`` characters, back to the last line end if that lies beyond 60 %."""
    head = F.left(text, F.lit(limit))
    back = F.length(head) - F.locate("\n", F.reverse(head))
    return F.when(F.length(text) <= limit, text).when((F.locate("\n", head) > 0) & (back > 0.6 * limit), F.left(text, back)).otherwise(head)


def relative_path(path: Column) -> Column:
    """Forward slashes, all leading dots and slashes off."""
    return F.regexp_replace(F.translate(path, "\\", "/"), r"^[./]+", "")


def single_spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))
