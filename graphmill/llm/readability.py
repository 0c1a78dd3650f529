"""Reading level of documents from classic readability formulas.

A document's prose is what is left without code, tables, log lines, markup and headings. Sentence
length, word length and syllables (counted by hyphenation-style rules per language) enter several
formulas, each of which estimates a school grade; the median of the estimates is the document's grade.
Cut points from grades to the levels of a rating scale are fitted per language on rated documents, as the
monotone assignment with the least absolute error. Only the rated documents' grades (a bounded
number, ``max_ratings``) reach the driver; the grades of all documents are computed once, in place.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache
from statistics import median

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 25
LEVELS = 5
MAX_RATINGS = 100_000

#: Frequent function words that tell the languages apart.
FUNCTION_WORDS = {
    "en": frozenset("the of and is to it in this that was for which with are by from".split()),
    "de": frozenset("der die das und ist nicht ein eine den dem des wir es sich mit für auf".split()),
    "fr": frozenset("le la les et est un une il des que du dans on tu ne pas au".split()),
    "es": frozenset("el los las es un una hay que y del se no en por con está lo".split()),
}
#: Letter groups that are one vowel sound, and endings that are silent.
VOWELS = {
    "en": (re.compile(r"[aeiouyà-öø-ÿ]+"), re.compile(r"(?:[^laeiouy]e|[^aeiouytd]ed|[^aeiouyscgzx]es)$")),
    "de": (re.compile(r"aa|ee|oo|ie|ei|ai|au|eu|äu|ey|ay|[aeiouyäöüéèàâ]"), None),
    "fr": (re.compile(r"eau|oeu|œu|ou|oi|ai|ei|au|eu|ui|ie|io|ia|[aeiouyàâäéèêëîïôöùûüœæ]"), re.compile(r"(?:[^aeiouyéè]es?|[^aeiouyé]ent)$")),
    "es": (re.compile(r"[iuü]?[aeoáéó][iuy]?|[iuüíúy]"), None),
}

_FENCE = re.compile(r"^[ \t]*(?:```|~~~)[^\n]*\n.*?(?:^[ \t]*(?:```|~~~)[ \t]*$|\Z)", re.S | re.M)
_MARKUP = re.compile(r"<!--.*?-->|<(script|style|pre|code)\b.*?</\1\s*>|</?[a-zA-Z][^<>\n]*>", re.S | re.I)
_LINK = re.compile(r"\[([^\]\n]*)\]\([^)\n]*\)|`[^`\n]*`|https?://\S+|www\.\S+|&[a-z]+;|&#\d+;")
#: Lines that are no prose: headings, rules, table rows, log lines, values separated by commas, code.
_NOT_PROSE = re.compile(
    r"""^[ \t]*(?:
      \#{1,6}[ \t].*
    | [|+].*[|+]
    | [-=*_~\#>.\s]*
    | \[?\d{4}-\d\d-\d\d[T ,]\d\d:\d\d.*
    | [^\s,;]+(?:[,;\t][^\s,;]*){2,}
    | (?:async[ ]+)?def[ ]\w+.*
    | class[ ]\w+[^.]*:
    | @\w[\w.]*(?:\(.*\))?
    | (?:import|from)[ ][\w.]+(?:[ ](?:import|as)\b.*)?(?:,.*)?
    | [\w.]+(?:\[[^\]]*\])*[ ]*(?:[-+*/|]?=)[ ].*
    | (?:return|raise|yield|assert|elif|if|for|while|try|except|else|with|pass|break|continue)\b.*[:)\]}]
    | (?:return|raise|pass|break|continue)\b[^.!?]*
    | [\w.]+\(.*\)
    | [\[\](){},;]*
    | \$[ ].*
    )[ \t]*$""",
    re.X,
)
_CODE_START = re.compile(r"^[ \t]*(?:(?:async )?def \w+|class \w+.*:[ \t]*$|@\w[\w.]*(?:\(.*\))?[ \t]*$)")
_DEFINES = re.compile(r"^[ \t]*(?:(?:async )?def \w|class \w|@\w)", re.M)
_SENTENCE = re.compile(r"[.!?…。！？]+[\"'»”)\]]*(?=\s|$)|\n[ \t]*\n")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")


def prose_of(text: str) -> str:
    """The prose of a text; headings, code (also indented below a definition), tables and log lines are off."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "```" in text or "~~~" in text:
        text = _FENCE.sub("\n\n", text)
    if "<" in text:
        text = _MARKUP.sub(" ", text)
    if "](" in text or "`" in text or "://" in text or "www." in text or "&" in text:
        text = _LINK.sub(lambda m: m[1] or " ", text)
    kept: list[str] = []
    inside = False  # of a definition: everything indented belongs to it
    defines = _DEFINES.search(text) is not None
    for line in text.split("\n"):
        if defines:
            if _CODE_START.match(line):
                inside = True
                continue
            if inside:
                if not line.strip() or line[0] in " \t)":
                    continue
                inside = False
        kept.append("" if _NOT_PROSE.match(line) else line)
    return "\n".join(kept)


@lru_cache(maxsize=8)
def syllable_counter(lang: str) -> dict[str, int]:
    """Words met so far with their syllables, at most 200,000 of a language in one worker."""
    group, silent = VOWELS.get(lang, VOWELS["en"])

    class Counts(dict):
        def __missing__(self, word: str) -> int:
            w = word.lower()
            n = len(group.findall(w))
            if silent is not None and n > 1 and silent.search(w):
                n -= 1
            n = max(1, n)
            if len(self) >= 200_000:
                self.clear()
            self[word] = n
            return n

    return Counts()


def language_of(words: list[str], told: str | None = None) -> str:
    """The language whose function words are most frequent; what is told decides only where none occurs."""
    low = [w.lower() for w in words]
    hits = {lang: sum(map(known.__contains__, low)) for lang, known in FUNCTION_WORDS.items()}
    best = max(hits, key=hits.get)
    if hits[best]:
        return best
    told = (told or "").lower()[:2]
    return told if told in FUNCTION_WORDS else "en"


def grade_estimates(lang: str, words: int, sentences: int, letters: int, syllables: int, hard: int, long_words: int, single: int) -> list[float]:
    """School grades by the published formulas; the first five hold for any language, the last for one."""
    wps, spw, lpw = words / sentences, syllables / words, letters / words
    grades = [
        0.39 * wps + 11.8 * spw - 15.59,  # Flesch-Kincaid
        0.4 * (wps + 100 * hard / words),  # Gunning
        1.043 * math.sqrt(hard * 30 / sentences) + 3.1291,  # SMOG
        4.71 * lpw + 0.5 * wps - 21.43,  # automated index
        5.88 * lpw - 29.6 * sentences / words - 15.8,  # Coleman-Liau
        (wps + 100 * long_words / words) / 4 - 2,  # Lix, brought to grades
    ]
    if lang == "de":
        grades.append(0.1935 * 100 * hard / words + 0.1672 * wps + 0.1297 * 100 * long_words / words - 0.0327 * 100 * single / words - 0.875)
    elif lang == "fr":
        grades.append((207 - 1.015 * wps - 73.6 * spw) / -10 + 15)
    elif lang == "es":
        grades.append((206.84 - 60 * spw - 1.02 * wps) / -10 + 15)
    return grades


def measure(text: str | None, told: str | None = None) -> tuple[str, int, float] | None:
    """(language, words of prose, median grade), or None where the prose is too short."""
    if not text or len(text) < 2 * MIN_WORDS - 1:
        return None
    prose = prose_of(text)
    words = _WORD.findall(prose)
    n = len(words)
    if n < MIN_WORDS:
        return None
    lang = language_of(words, told)
    sentences = max(1, sum(1 for s in _SENTENCE.split(prose) if s and not s.isspace()))
    counts = list(map(syllable_counter(lang).__getitem__, words))
    lengths = list(map(len, words))
    single = counts.count(1)
    hard = n - single - counts.count(2)
    grades = grade_estimates(lang, n, sentences, sum(lengths), sum(counts), hard, sum(map((6).__lt__, lengths)), single)
    return lang, n, median(grades)


def grade_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, language, n_words, grade) of every document with at least 25 words of prose.

    Null, blank and shorter documents and those of code, log lines or tables give no row; repeated ids are judged one by one.
    """
    names = [id_col, "language", "n_words", "grade"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, langs, counts, grades = [], [], [], []
            for i, text, told in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if found := measure(text, told):
                    ids.append(i)
                    langs.append(found[0])
                    counts.append(found[1])
                    grades.append(found[2])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(counts, pa.int32()), pa.array(grades, pa.float64())], names=names)

    return df.select(F.col(id_col).cast("long"), F.col(text_col), F.col(lang_col)).where(f"`{text_col}` is not null").mapInArrow(run, f"{id_col} long, language string, n_words int, grade double")


def fit_cuts(grades: np.ndarray, levels: np.ndarray, bins: int = 400) -> list[float]:
    """The LEVELS - 1 grades between which the levels change: the monotone assignment of least absolute error."""
    edges = np.unique(np.quantile(grades, np.linspace(0, 1, bins + 1)[1:-1]))
    slot = np.searchsorted(edges, grades, side="right")
    count = np.zeros((len(edges) + 1, LEVELS + 1))
    np.add.at(count, (slot, levels), 1)
    known = np.arange(LEVELS + 1)
    cost = np.stack([(count * np.abs(known - lv)).sum(1) for lv in range(1, LEVELS + 1)], 1)
    total = np.zeros_like(cost)
    came = np.zeros(cost.shape, int)
    total[0] = cost[0]
    for b in range(1, len(cost)):
        for lv in range(LEVELS):
            came[b, lv] = int(np.argmin(total[b - 1, : lv + 1]))
            total[b, lv] = cost[b, lv] + total[b - 1, came[b, lv]]
    chosen = [int(np.argmin(total[-1]))]
    for b in range(len(cost) - 1, 0, -1):
        chosen.append(came[b, chosen[-1]])
    chosen.reverse()
    cuts = []
    for lv in range(1, LEVELS):
        at = next((b for b, c in enumerate(chosen) if c >= lv), None)
        cuts.append(float("inf") if at is None else (-float("inf") if at == 0 else float(edges[at - 1])))
    return cuts


def rated_cuts(grades: DataFrame, ratings: DataFrame, id_col: str = "doc_id", level_col: str = "reading_level", max_ratings: int = MAX_RATINGS) -> dict[str, list[float]]:
    """Cut points per language, and under "" for all others, from at most ``max_ratings`` ratings.

    They are drawn by hash before the join, so what is joined, broadcast and sent to the driver does not grow with the tables.

    Raters' null levels are left out; where two disagree both count. A language with fewer than 30 ratings
    takes the common cut points; without any rating the levels are fifths of the grades.
    """
    rated = ratings.select(F.col(id_col).cast("long").alias(id_col), F.col(level_col).alias("level")).where(f"level between 1 and {LEVELS}")
    sample = grades.join(F.broadcast(rated.orderBy(F.xxhash64(id_col), id_col, "level").limit(max_ratings)), id_col)
    rows = sample.select("language", "grade", "level").toPandas()
    if rows.empty:
        fifths = grades.approxQuantile("grade", [i / LEVELS for i in range(1, LEVELS)], 0.001)
        return {"": fifths or [float("inf")] * (LEVELS - 1)}
    cuts = {"": fit_cuts(rows["grade"].to_numpy(), rows["level"].to_numpy(int))}
    for lang, part in rows.groupby("language"):
        if len(part) >= 30:
            cuts[lang] = fit_cuts(part["grade"].to_numpy(), part["level"].to_numpy(int))
    return cuts


def levels_of(grades: DataFrame, cuts: dict[str, list[float]]) -> DataFrame:
    """``grades`` with reading_level 1 to 5."""
    above = lambda points: sum(((F.col("grade") > p).cast("int") for p in points), F.lit(1))
    level = above(cuts[""])
    for lang, points in cuts.items():
        if lang:
            level = F.when(F.col("language") == lang, above(points)).otherwise(level)
    return grades.withColumn("reading_level", level.cast("int"))
