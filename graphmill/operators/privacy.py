"""Privacy operators on records: audit, masking, consistent pseudonyms, residual scans."""

from __future__ import annotations

import difflib
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType

from graphmill.functions import text as X
from graphmill.operators.graph import components
from graphmill.session import cut

#: Roles of functions and the words that tell them, in the order in which ties are decided.
ROLES = {
    "data_loader": ("load", "fetch", "read", "ingest", "download", "unzip", "import", "parse"),
    "data_cleaning": ("clean", "drop", "remove", "filter", "missing", "duplicate", "outlier", "outliers", "mask", "resolve"),
    "feature_engineering": ("feature", "features", "rfm", "build", "encode", "merge", "join", "rank"),
    "analysis": ("analysis", "correlation", "trend", "score", "audit", "count", "split"),
    "ml_model": ("model", "train", "predict", "cluster", "clusters", "pca", "scale", "scaler"),
    "visualization": ("plot", "chart", "radar", "histogram", "heatmap"),
}
#: Modules of the standard library that are never renamed.
STANDARD_MODULES = tuple("os sys re json math csv time datetime pickle logging random collections itertools functools pathlib typing subprocess argparse hashlib io copy".split())


def ranks(df: DataFrame, group: str | None, order: list[str], name: str = "n") -> DataFrame:
    """``df`` numbered from 1 within each group in the given order, without gathering any group in one task.

    Rows are range partitioned by group and order; a row's number is its place in its partition plus the rows of
    its group in the partitions before, which are a few counts per partition. Ties in ``order`` get any order.
    """
    keys = ([group] if group else []) + order
    spread = df.repartitionByRange(*keys).withColumn("__part", F.spark_partition_id())
    spread = cut(spread)
    by = [group, "__part"] if group else ["__part"]
    counts = spread.groupBy(*by).agg(F.count("*").alias("__c"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = before if not group else Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__before"))  # one row per partition and group
    own = Window.partitionBy(*by).orderBy(*order)
    if group:
        same = reduce(lambda a, b: a & b, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by])
    else:
        same = F.col("a.__part") == F.col("b.__part")
    placed = spread.withColumn("__r", F.row_number().over(own)).alias("a").join(offsets.alias("b"), same)
    return placed.select(*(F.col(f"a.{c}") for c in df.columns), (F.col("a.__r") + F.col("b.__before")).cast("long").alias(name))


def placeholders(df: DataFrame, value: str, seen: str, prefix: str, width: int = 3) -> DataFrame:
    """(value, placeholder): distinct values numbered in the order in which they are first seen."""
    first = df.where(F.col(value).isNotNull() & (F.col(value) != "")).groupBy(value).agg(F.min(seen).alias("__seen"))
    return ranks(first, None, ["__seen", value]).select(value, F.concat(F.lit(prefix), F.lpad(F.col("n").cast("string"), F.greatest(F.lit(width), F.length(F.col("n").cast("string"))), F.lit("0"))).alias("placeholder"))


def path_prefix(path: Column) -> Column:
    """The kind of place a file stands in."""
    return F.when(path.contains("test"), "test").when(path.startswith("dags/"), "dags").when(path.startswith("cloudrun/"), "deploy").when(path.contains("src/"), "src").when(path.contains("config"), "config").when(path.contains("data"), "data").otherwise("file")


def role_of(names: DataFrame, name: str) -> DataFrame:
    """(name, role): the role of most matching words; the earlier word, then the earlier role, decides ties; utility without any."""
    listed = [(w, r, i) for i, (r, words) in enumerate(ROLES.items()) for w in words]
    known = names.sparkSession.createDataFrame(listed, "word string, role string, role_order int")
    split = F.split(F.lower(F.regexp_replace(F.col(name), "([a-z0-9])([A-Z])", "$1_$2")), "[_. ]+")
    words = names.select(name).distinct().select(name, F.posexplode(split).alias("pos", "word"))
    hits = words.join(F.broadcast(known), "word").groupBy(name, "role", "role_order").agg(F.count("*").alias("hits"), F.min("pos").alias("first"))  # the list above
    best = hits.groupBy(name).agg(F.min(F.struct((-F.col("hits")).alias("h"), "first", "role_order", "role")).alias("b"))
    return names.select(name).distinct().join(best, name, "left").select(name, F.coalesce("b.role", F.lit("utility")).alias("role"))


def masked_signature(signature: Column) -> Column:
    """Parameters renamed by position; self, cls and stars stay, defaults become [DEFAULT], annotations go."""
    inner = F.regexp_replace(signature, r"^\(|\)$", "")
    one = lambda p, i: F.when(F.trim(p).isin("self", "cls", "*", "/"), F.trim(p)).otherwise(F.concat(F.regexp_extract(F.trim(p), r"^(\*{0,2})", 1), F.lit("param_"), F.lpad((i + 1).cast("string"), 3, "0"), F.when(p.contains("="), "=[DEFAULT]").otherwise("")))
    return F.when(signature.isNull(), None).when(F.trim(inner) == "", "()").otherwise(F.concat(F.lit("("), F.array_join(F.transform(F.split(inner, ","), one), ", "), F.lit(")")))


def masked_commits(commits: Column) -> Column:
    """Nested commits with hash and message masked, element by element."""
    return F.transform(commits, lambda c: F.struct(F.lit("[COMMIT_HASH]").alias("sha"), X.mask_inside(c["message_head"]).alias("message_head")))


#: Words for identifiers of people.
IDENTIFIER_WORDS = ("customerid", "email", "ssn", "phone", "userid", "user_id", "customer_id")


def all_author_signals(df: DataFrame, key: str, text: str, header: str, commit: str, commits: DataFrame) -> DataFrame:
    """Every signal of the reference (key, emails, paths, hashes, numbers, identifiers, pr, provenance, risk, level).

    Counts are of distinct matches, at most ten of a kind. ``header`` is searched for hashes and the number of the
    pull request, ``commit`` (null where there is none) is the commit the text came with. Provenance is such a commit or
    number, or a hash whose first seven characters are those of a commit with an author (commits: sha, author_name).
    Risk is 3 an address, 2 a user's folder, 1 a hash, 2 an identifier word and 3 for provenance, at most 10; long
    numbers are listed but add nothing.
    """
    body, head = F.coalesce(text, F.lit("")), F.coalesce(header, F.lit(""))
    users = F.array_distinct(F.regexp_extract_all(body, F.lit(X.USER_FOLDER), F.lit(1)))
    origin = F.when(F.col(commit) != "", F.array(commit)).otherwise(F.array().cast("array<string>"))
    hashes = F.array_distinct(F.concat(X.distinct_matches(body, X.ANY_HASH), origin, X.distinct_matches(head, X.ANY_HASH)))
    words = F.filter(F.array(*map(F.lit, IDENTIFIER_WORDS)), lambda w: F.contains(F.lower(body), w))
    signals = df.select(key, F.col(commit).alias("__commit"), X.distinct_matches(body, X.EMAIL).alias("emails"), users.alias("paths"), hashes.alias("hashes"), X.distinct_matches(body, X.LONG_NUMBER).alias("numbers"), words.alias("identifiers"), F.nullif(F.regexp_extract(head, r"(?i)introduced_by_pr[=:\s]*([0-9]+)", 1), F.lit("")).alias("pr"))
    known = commits.where("author_name <> ''").select(F.substring("sha", 1, 7).alias("short")).distinct()
    hinted = signals.select(key, F.explode("hashes").alias("h")).select(key, F.substring("h", 1, 7).alias("short")).join(known, "short", "left_semi").select(key).distinct().withColumn("__hint", F.lit(True))
    provenance = F.coalesce(F.col("__commit") != "", F.lit(False)) | F.col("pr").isNotNull() | F.coalesce("__hint", F.lit(False))
    kinds = ("emails", "paths", "hashes", "numbers", "identifiers")
    out = signals.join(hinted, key, "left").select(key, *(F.least(F.lit(10), F.size(k)).alias(k) for k in kinds), "pr", provenance.alias("provenance"))
    risk = F.least(F.lit(10), 3 * F.col("emails") + 2 * F.col("paths") + F.col("hashes") + 2 * F.col("identifiers") + F.when(F.col("provenance"), 3).otherwise(0))
    return out.withColumn("risk", risk).withColumn("level", F.when(F.col("risk") < 3, "LOW").when(F.col("risk") < 6, "MEDIUM").otherwise("HIGH"))


@F.pandas_udf(BooleanType())
def parses(source: pd.Series) -> pd.Series:
    """Whether a text is valid Python; null for null."""
    import ast
    import warnings

    def one(text):
        if text is None:
            return None
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                ast.parse(text)
            return True
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return False

    return source.map(one, na_action=None)


def canonical_contributors(names: DataFrame, name: str) -> DataFrame:
    """(name, contributor): spellings that are equal without case, blanks and order of words share a number by first name."""
    key = F.array_join(F.array_sort(F.split(F.lower(F.trim(F.regexp_replace(F.col(name), "[^A-Za-z0-9]+", " "))), " ")), " ")
    keyed = names.where(F.col(name).isNotNull()).select(name, key.alias("key")).distinct()
    numbered = placeholders(keyed, "key", name, "CONTRIBUTOR_", 1)
    return keyed.join(numbered, "key", "left").select(name, F.col("placeholder").alias("contributor"))


#: Names are alike above this Ratcliff-Obershelp ratio.
ALIKE = 0.85


def _most_edits(short: int, long: int) -> int:
    """Most letters left out or put in between two texts of these lengths that may be alike; -1 if none may."""
    return -(-(short + long) * 15 // 100) - 1


def _parts(length: int, pieces: int) -> list[tuple[int, int]]:
    return [(length * i // pieces, length * (i + 1) // pieces) for i in range(pieces)]


def _own_keys(text: str) -> list[str]:
    """Keys of a text as the shorter one: for each length of the longer, its pieces, one more than there may be edits."""
    n, keys = len(text), []
    for long in range(n, n * 2):
        edits = _most_edits(n, long)
        if edits >= long - n:
            keys += [f"{n},{long},{i},{text[a:b]}" for i, (a, b) in enumerate(_parts(n, edits + 1))]
    return keys


def _other_keys(text: str) -> list[str]:
    """Keys of a text as the longer one: what may have been a piece of a shorter text, as far off as edits may move it."""
    n, keys = len(text), set()
    for short in range(n // 2, n + 1):
        edits, more = _most_edits(short, n), n - short
        if edits >= more:
            for i, (a, b) in enumerate(_parts(short, edits + 1)):
                low, high = max(0, a - (edits - more) // 2), min(n - (b - a), a + (edits + more) // 2)
                keys.update(f"{short},{n},{i},{text[at : at + b - a]}" for at in range(low, high + 1))
    return list(keys)


@F.pandas_udf(ArrayType(StringType()))
def _shorter_keys(names: pd.Series) -> pd.Series:
    return names.map(_own_keys)


@F.pandas_udf(ArrayType(StringType()))
def _longer_keys(names: pd.Series) -> pd.Series:
    return names.map(_other_keys)


@F.pandas_udf(BooleanType())
def _alike(a: pd.Series, b: pd.Series) -> pd.Series:
    def one(x, y):
        match = difflib.SequenceMatcher(None, x, y)
        return match.quick_ratio() > ALIKE and (match.ratio() > ALIKE or difflib.SequenceMatcher(None, y, x).ratio() > ALIKE)

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)


def _grams(name: str) -> Column:
    """All distinct runs of one to three characters."""

    def of(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(name) - (n - 1)), lambda i: F.substring(F.col(name), i, F.lit(n)))

    return F.array_distinct(F.concat(*(F.when(F.length(name) >= n, of(n)).otherwise(F.array().cast("array<string>")) for n in (1, 2, 3))))


def merged_contributors(names: DataFrame, name: str) -> DataFrame:
    """(name, contributor): names without case and outer blanks belong together if one contains the other or their ratio is above ``ALIKE``, and with all that are so linked.

    Pairs are found without loss and verified: a contained name by its rarest run of three characters (itself, if
    shorter) among the runs of the longer; an alike one because of n edits and n + 1 pieces one piece stays whole. Null
    and blank names have no contributor and null names no row.
    """
    spelled = names.where(F.col(name).isNotNull()).select(name, F.lower(F.trim(name)).alias("id")).distinct()
    known = cut(spelled.where("id <> ''").select("id").distinct())
    runs = cut(known.select("id", F.explode(_grams("id")).alias("run")))
    counts = runs.groupBy("run").agg(F.count("*").alias("n"))
    rarest = runs.where("length(run) = least(3, length(id))").join(counts, "run").groupBy("id").agg(F.min(F.struct("n", "run"))["run"].alias("run"))
    within = rarest.join(runs.withColumnRenamed("id", "other"), "run").where("id <> other and contains(other, id)").select("id", "other")
    short = known.select("id", F.explode(_shorter_keys("id")).alias("key"))
    long = known.select(F.col("id").alias("other"), F.explode(_longer_keys("id")).alias("key"))
    near = short.join(long, "key").where("id <> other").select("id", "other").distinct()
    # changing a letter is one edit here and two there, so this drops no alike pair before Python reads it
    close = near.where(F.levenshtein("id", "other") < F.ceil((F.length("id") + F.length("other")) * 15 / 100))
    alike = close.where(_alike("id", "other"))
    links = within.unionByName(alike).select(F.col("id").alias("source"), F.col("other").alias("target")).distinct()
    keyed = cut(spelled.join(components(known, links), "id", "left").select(name, "component"))
    return keyed.join(placeholders(keyed, "component", name, "CONTRIBUTOR_", 1), "component", "left").select(name, F.col("placeholder").alias("contributor"))


def replace_words(df: DataFrame, key: str, text: str, names: DataFrame) -> DataFrame:
    """(key, text) with every word of names (name, placeholder) replaced, whole words only, so the longest name wins by itself.

    Only the distinct words of each text are joined with the names; the row then looks its words up in what was found, so
    neither the number of names nor the length of a text matters. Of a name with several placeholders the least counts.
    Rows with a null text or key are left out; repeated rows give a row each.
    """
    live = df.select(key, text).where(F.col(key).isNotNull() & F.col(text).isNotNull())
    words = F.regexp_extract_all(text, F.lit("[A-Za-z0-9_]+|[^A-Za-z0-9_]+"), F.lit(0))
    known = names.where("name is not null").groupBy(F.col("name").alias("word")).agg(F.min("placeholder").alias("placeholder")).where("placeholder is not null")
    own = live.select(key, F.explode(F.array_distinct(words)).alias("word")).join(known, "word").groupBy(key).agg(F.map_from_entries(F.collect_set(F.struct("word", "placeholder"))).alias("__own"))
    rewritten = F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at("__own", w), w)), "")
    return live.join(own, key, "left").select(key, F.when(F.col("__own").isNull(), F.col(text)).otherwise(rewritten).alias(text))
