"""Scores of predicted texts against references: token overlap, BLEU, ROUGE, chrF, METEOR.

Pairs are (id, prediction, reference), for BLEU also references, a list. n-grams are counted as rows, map-side first.
"""

from __future__ import annotations

import re
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from graphmill.functions import text as X


def fill(pairs: DataFrame) -> DataFrame:
    return pairs.select("id", F.coalesce("prediction", F.lit("")).alias("prediction"), F.coalesce("reference", F.lit("")).alias("reference"))


def token_overlap(pairs: DataFrame) -> DataFrame:
    """(id, precision, recall, f1) over distinct small tokens; both empty give 1, one empty 0."""
    t = fill(pairs).select("id", X.tokens(F.col("prediction")).alias("p"), X.tokens(F.col("reference")).alias("r"))
    n = F.size(F.array_intersect("p", "r"))
    both, none = (F.size("p") == 0) & (F.size("r") == 0), (F.size("p") == 0) | (F.size("r") == 0)
    share = lambda c: F.when(both, 1.0).when(none, 0.0).otherwise(n / F.size(c))
    t = t.select("id", share("p").alias("precision"), share("r").alias("recall"))
    return t.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0))), F.lit(0.0)))


def _words(c: str) -> Column:
    return F.filter(F.split(F.lower(F.col(c)), r"\s+"), lambda t: t != "")


_VOWELS = frozenset("aeiou")


def _consonant(w: str, i: int) -> bool:
    return w[i] not in _VOWELS and (w[i] != "y" or i == 0 or not _consonant(w, i - 1))


def _measure(w: str) -> int:
    """Number of vowel-consonant sequences."""
    kinds = "".join("c" if _consonant(w, i) else "v" for i in range(len(w)))
    return len(re.findall("v+c+", kinds))


def _has_vowel(w: str) -> bool:
    return any(not _consonant(w, i) for i in range(len(w)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1)


def _short_end(w: str) -> bool:
    return len(w) > 2 and _consonant(w, len(w) - 3) and not _consonant(w, len(w) - 2) and _consonant(w, len(w) - 1) and w[-1] not in "wxy"


#: Suffixes of the published algorithm's steps 2, 3 and 4 and what they become.
_STEP_2 = dict(x.split("=") for x in "ational=ate tional=tion enci=ence anci=ance izer=ize abli=able alli=al entli=ent eli=e ousli=ous ization=ize ation=ate ator=ate alism=al iveness=ive fulness=ful ousness=ous aliti=al iviti=ive biliti=ble".split())
_STEP_3 = dict(x.split("=") for x in "icate=ic ative= alize=al iciti=ic ical=ic ful= ness=".split())
_STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _replaced(w: str, suffixes: dict[str, str]) -> str:
    for end in sorted(suffixes, key=len, reverse=True):
        if w.endswith(end):
            base = w[: len(w) - len(end)]
            return base + suffixes[end] if _measure(base) > 0 else w
    return w


@lru_cache(1 << 16)
def stem(w: str) -> str:
    """The stem of a small word by Porter's published algorithm."""
    if len(w) <= 2:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        end = next((e for e in ("ed", "ing") if w.endswith(e) and _has_vowel(w[: -len(e)])), "")
        if end:
            w = w[: -len(end)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif _double(w) and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _short_end(w):
                w += "e"
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    w = _replaced(_replaced(w, _STEP_2), _STEP_3)
    for end in sorted(_STEP_4, key=len, reverse=True):
        if w.endswith(end):
            base = w[: -len(end)]
            if _measure(base) > 1 and (end != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _short_end(w[:-1])):
        w = w[:-1]
    return w[:-1] if _measure(w) > 1 and _double(w) and w.endswith("l") else w


@F.pandas_udf(ArrayType(StringType()))
def stemmed(words: pd.Series) -> pd.Series:
    """Words with the stems of those of more than three letters."""
    return words.map(lambda ws: None if ws is None else [stem(w) if len(w) > 3 else w for w in ws])


def overlaps(tokens: DataFrame, orders: range) -> DataFrame:
    """(id, n, both, p, r) for tokens (id, p, refs: arrays of words): n-grams that occur in both, each as often as in the
    reference that has it most often, and n-grams of the prediction and of the first reference.

    n-grams become rows that are counted before the shuffle, so the cost is linear in the length of a text.
    """
    tag = lambda arr, side, n: F.transform(X.ngrams(arr, n), lambda g: F.struct(F.lit(n).alias("n"), F.lit(side).cast("int").alias("side") if not isinstance(side, Column) else side.alias("side"), g.alias("g")))
    mine = F.flatten(F.array(*(tag(F.col("p"), -1, n) for n in orders)))
    theirs = F.flatten(F.transform("refs", lambda r, i: F.flatten(F.array(*(tag(r, i, n) for n in orders)))))
    each = tokens.select("id", F.explode(F.concat(mine, theirs)).alias("x")).groupBy("id", "x.n", "x.g", "x.side").agg(F.count("*").alias("c"))
    own = F.max(F.when(F.col("side") == -1, F.col("c")).otherwise(0))
    best = F.max(F.when(F.col("side") >= 0, F.col("c")).otherwise(0))
    first = F.max(F.when(F.col("side") == 0, F.col("c")).otherwise(0))
    grams = each.groupBy("id", "n", "g").agg(own.alias("own"), best.alias("best"), first.alias("first"))
    return grams.groupBy("id", "n").agg(F.sum(F.least("own", "best")).alias("both"), F.sum("own").alias("p"), F.sum("first").alias("r"))


def _by_order(counts: DataFrame, most: int) -> DataFrame:
    """One row of sums over the corpus: m, p and r of each order."""
    of = lambda c, n: F.coalesce(F.sum(F.when(F.col("n") == n, F.col(c))), F.lit(0)).cast("double")
    return counts.agg(*(of(c, n).alias(f"{a}{n}") for n in range(1, most + 1) for a, c in (("m", "both"), ("t", "p"), ("r", "r"))))


#: The splits of the 13a tokens, in order.
TOKENS_13A = ((r"([\{-~\[-` -&\(-\+:-@/])", " $1 "), (r"([^0-9])([.,])", "$1 $2 "), (r"([.,])([^0-9])", " $1 $2"), (r"([0-9])(-)", "$1 $2 "))


def tokens_13a(text: Column) -> Column:
    """The 13a tokens of a text, case kept."""
    for a, b in (("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        text = F.replace(text, F.lit(a), F.lit(b))
    text = F.concat(F.lit(" "), text, F.lit(" "))
    for pattern, to in TOKENS_13A:
        text = F.regexp_replace(text, pattern, to)
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def with_references(pairs: DataFrame) -> DataFrame:
    """(id, prediction, refs): all references; where there is only ``reference`` that one."""
    refs = F.transform("references", lambda r: F.coalesce(r, F.lit(""))) if "references" in pairs.columns else F.array(F.coalesce("reference", F.lit("")))
    return pairs.select("id", F.coalesce("prediction", F.lit("")).alias("prediction"), F.when(F.size(refs) > 0, refs).otherwise(F.array(F.lit(""))).alias("refs"))


def corpus_bleu(pairs: DataFrame, most: int = 4) -> DataFrame:
    """(bleu, plen, rlen) over the corpus: 13a tokens, n-grams up to four clipped by the best of all references, the nearest reference's length (the shorter on a tie), brevity penalty; an order without a hit counts as half, a quarter, ... of one."""
    w = with_references(pairs).select("id", tokens_13a(F.col("prediction")).alias("p"), F.transform("refs", tokens_13a).alias("refs"))
    nearest = F.array_min(F.transform("refs", lambda r: F.struct(F.abs(F.size(r) - F.size("p")).alias("d"), F.size(r).alias("n"))))["n"]
    lengths = w.agg(F.sum(F.size("p")).alias("plen"), F.sum(nearest).alias("rlen"))
    row = _by_order(overlaps(w, range(1, most + 1)), most).crossJoin(lengths)  # two rows of one
    misses = lambda n: sum(((F.col(f"m{k}") == 0).cast("int") for k in range(1, n + 1)), F.lit(0))
    hits = lambda n: F.when(F.col(f"m{n}") == 0, 1.0 / F.pow(F.lit(2.0), misses(n))).otherwise(F.col(f"m{n}"))
    logs = sum((F.log(F.try_divide(hits(n), F.col(f"t{n}"))) for n in range(1, most + 1)), F.lit(0.0)) / most
    brevity = F.when(F.col("plen") >= F.col("rlen"), 1.0).otherwise(F.exp(1 - F.try_divide(F.col("rlen").cast("double"), F.col("plen"))))
    return row.select(F.round(F.coalesce(F.when(F.col("m1") > 0, 100 * brevity * F.exp(logs)), F.lit(0.0)), 4).alias("bleu"), F.coalesce("plen", F.lit(0)).alias("plen"), F.coalesce("rlen", F.lit(0)).alias("rlen"))


def corpus_chrf(pairs: DataFrame, most: int = 6, beta: float = 2.0) -> DataFrame:
    """chrF with the first reference: mean precision and recall of character n-grams without blanks, combined with the recall weighted."""
    chars = lambda c: F.filter(F.split(F.regexp_replace(F.col(c), r"\s+", ""), ""), lambda x: x != "")
    w = fill(pairs).select("id", chars("prediction").alias("p"), F.array(chars("reference")).alias("refs"))
    total = _by_order(overlaps(w, range(1, most + 1)), most)
    mean = lambda side: sum((F.coalesce(F.try_divide(F.col(f"m{n}"), F.nullif(F.col(f"{side}{n}"), F.lit(0.0))), F.lit(0.0)) for n in range(1, most + 1)), F.lit(0.0)) / most
    p, r = mean("t"), mean("r")
    score = F.coalesce(F.try_divide((1 + beta**2) * p * r, F.nullif(beta**2 * p + r, F.lit(0.0))), F.lit(0.0))
    return total.select(F.round(100 * score, 4).alias("chrf"))


def rouge_n(pairs: DataFrame, n: int, stems: bool = False) -> DataFrame:
    """(id, f) of ROUGE-n with the first reference over small words of letters and digits, stemmed or as they are."""
    words = lambda c: F.filter(F.split(F.lower(F.regexp_replace(F.col(c), "[^A-Za-z0-9]+", " ")), " "), lambda t: t != "")
    w = fill(pairs).select("id", words("prediction").alias("p"), words("reference").alias("r"))
    w = w.select("id", stemmed("p").alias("p"), stemmed("r").alias("r")) if stems else w
    hits = overlaps(w.select("id", "p", F.array("r").alias("refs")), range(n, n + 1))
    return w.select("id").join(hits, "id", "left").select("id", F.coalesce(F.try_divide(2.0 * F.col("both"), F.nullif(F.col("p") + F.col("r"), F.lit(0))), F.lit(0.0)).alias("f"))


def longest_common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            row[j], last = (last + 1 if x == y else max(row[j], row[j - 1])), row[j]
    return row[-1]


def meteor(prediction: list[str], reference: list[str]) -> float:
    """METEOR: words aligned if equal, the rest if their stems are equal; recall-weighted mean with a penalty for the number of chunks."""
    pairs: list[tuple[int, int]] = []
    left, right = list(range(len(prediction))), list(range(len(reference)))
    for key in (str, stem):
        where: dict[str, list[int]] = {}
        for j in reversed(right):
            where.setdefault(key(reference[j]), []).append(j)
        rest = []
        for i in left:
            hits = where.get(key(prediction[i]))
            if hits:
                pairs.append((i, hits.pop()))
            else:
                rest.append(i)
        taken = {j for _, j in pairs}
        left, right = rest, [j for j in right if j not in taken]
    m = len(pairs)
    if not m:
        return 0.0
    pairs.sort()
    p, r = m / len(prediction), m / len(reference)
    chunks = 1 + sum(1 for (a, b), (c, d) in zip(pairs, pairs[1:]) if c != a + 1 or d != b + 1)
    return (10 * p * r / (r + 9 * p)) * (1 - 0.5 * (chunks / m) ** 3)


def sequence_scores(pairs: DataFrame) -> DataFrame:
    """(id, rouge_l, meteor): order-dependent scores from Arrow batches; stemmed for ROUGE-L, exact then stemmed matches for METEOR."""

    @F.pandas_udf("struct<rouge_l:double,meteor:double>")
    def score(p: pd.Series, r: pd.Series) -> pd.DataFrame:
        rows = []
        for a, b in zip(p, r, strict=True):
            x, y = ([stem(w) if len(w) > 3 else w for w in re.sub("[^a-z0-9]+", " ", t.lower()).split()] for t in (a, b))
            rows.append((2.0 * longest_common(x, y) / (len(x) + len(y)) if x or y else 0.0, meteor(a.lower().split(), b.lower().split())))
        return pd.DataFrame(rows, columns=["rouge_l", "meteor"])

    return fill(pairs).select("id", score("prediction", "reference").alias("s")).select("id", "s.rouge_l", "s.meteor")


def lengths(pairs: DataFrame) -> DataFrame:
    """(id, pred_len_tokens, ref_len_tokens, pred_len_chars, ref_len_chars)."""
    return fill(pairs).select("id", F.size(_words("prediction")).alias("pred_len_tokens"), F.size(_words("reference")).alias("ref_len_tokens"), F.length("prediction").alias("pred_len_chars"), F.length("reference").alias("ref_len_chars"))


def per_node(pairs: DataFrame) -> DataFrame:
    """One row per id with every score of a pair: stemmed ROUGE-1, 2 and L, METEOR, token overlap and lengths."""
    rouge = [rouge_n(pairs, n, stems=True).withColumnRenamed("f", f"rouge{n}") for n in (1, 2)]
    parts = [*rouge, sequence_scores(pairs), token_overlap(pairs), lengths(pairs)]
    return reduce(lambda a, b: a.join(b, "id"), parts)


def summary(pairs: DataFrame) -> DataFrame:
    """(metric, value): BLEU and chrF of the corpus, means of every score of the pairs (in per cent but for lengths)."""
    rows = per_node(pairs)
    scores = ("rouge1", "rouge2", "rouge_l", "meteor", "precision", "recall", "f1")
    sizes = ("pred_len_tokens", "ref_len_tokens", "pred_len_chars", "ref_len_chars")
    means = rows.agg(*(F.round(100 * F.avg(c), 4).alias(c) for c in scores), *(F.round(F.avg(c), 4).alias(f"avg_{c}") for c in sizes))
    long = means.unpivot([], [*scores, *(f"avg_{c}" for c in sizes)], "metric", "value")
    corpus = corpus_bleu(pairs).select(F.lit("bleu").alias("metric"), F.col("bleu").alias("value")).unionByName(corpus_chrf(pairs).select(F.lit("chrf").alias("metric"), F.col("chrf").alias("value")))
    return corpus.unionByName(long)


def lexical_summary(pairs: DataFrame) -> DataFrame:
    """(metric, value): means of token precision, recall and F1 and of lengths in tokens and characters."""
    rows = token_overlap(pairs).join(lengths(pairs), "id")
    of = {"lex_precision": "precision", "lex_recall": "recall", "lex_f1": "f1", "avg_pred_len_tokens": "pred_len_tokens", "avg_ref_len_tokens": "ref_len_tokens", "avg_pred_len_chars": "pred_len_chars", "avg_ref_len_chars": "ref_len_chars"}
    return rows.agg(*(F.round(F.avg(c), 6).alias(k) for k, c in of.items())).unpivot([], list(of), "metric", "value")
