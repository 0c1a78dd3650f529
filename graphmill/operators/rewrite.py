"""Rewriting source text with consistent placeholders: an identifier map, and one pass over the words of each text.

A text is cut into words and what lies between. Only its distinct words are joined with the identifier map, so the
shuffle holds a few words per text and never the text; each text gets the part of the map it needs and looks its
words up in the row. So neither the number of identifiers nor the length of a text matters to the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphmill.functions import text as X
from graphmill.operators import privacy as P
from graphmill.operators.graph import module_name, slashed

#: Parameter names that are never renamed.
PARAMETER_STOP = ("self", "cls", "args", "kwargs", "None", "True", "False")
#: What a replaced word can be, in the order in which it is decided.
CHANGES = ("function_def", "function_call", "standalone", "class_def", "parameter")
WORD_OR_GAP = r"[A-Za-z0-9_]+|[^A-Za-z0-9_]+"
_IMPORT_LINE = r"^[ \t]*(?:import|from)[ ]"


def identifiers(code: DataFrame) -> DataFrame:
    """(kind, prefix, name, seen, extension): functions (prefix by role), classes, parameters, modules (prefix by depth), packages and files (prefix by place) of code entities, with the least entity id that shows them."""
    short = F.substring_index("name", ".", -1)
    functions = code.where("kind in ('function', 'method') and name is not null").select("entity_id", short.alias("name"))
    roles = P.role_of(functions, "name").withColumnRenamed("role", "prefix")
    none = F.lit("").alias("extension")
    part = lambda kind, rows, prefix, ext=none: rows.where("name <> ''").groupBy("name").agg(F.min("entity_id").alias("seen")).select(F.lit(kind).alias("kind"), prefix.alias("prefix"), "name", "seen", ext)
    first = functions.where("name <> ''").groupBy("name").agg(F.min("entity_id").alias("seen")).join(roles, "name").select(F.lit("function").alias("kind"), F.concat("prefix", F.lit("_func_")).alias("prefix"), "name", "seen", none)
    classes = part("class", code.where("kind = 'class' and name is not null").select("entity_id", short.alias("name")), F.lit("class_"))
    inner = F.regexp_replace("sig", r"^\(|\)$", "")
    parameters = code.where("sig is not null").select("entity_id", F.explode(F.split(inner, ",")).alias("p")).select("entity_id", F.regexp_extract("p", r"^\s*\*{0,2}([A-Za-z_][A-Za-z0-9_]*)", 1).alias("name"))
    parameters = part("parameter", parameters.where(~F.col("name").isin(*PARAMETER_STOP)), F.lit("param_"))
    paths = code.where("relpath is not null").select("entity_id", slashed(F.col("relpath")).alias("path"))
    modules = part("module", paths.where("path like '%.py'").select("entity_id", module_name(F.col("path")).alias("name")), F.concat(F.lit("module_l"), F.size(F.split("name", r"\.")).cast("string"), F.lit("_")))
    packages = part("package", paths.where("path like '%/%'").select("entity_id", F.substring_index("path", "/", 1).alias("name")), F.lit("pkg_"))
    ending = F.regexp_extract("name", r"(\.[A-Za-z0-9]+)$", 1).alias("extension")
    files = part("file", paths.select("entity_id", F.col("path").alias("name")), F.concat(P.path_prefix(F.col("name")), F.lit("_file_")), ending)
    return first.unionByName(classes).unionByName(parameters).unionByName(modules).unionByName(packages).unionByName(files)


def identifier_map(found: DataFrame) -> DataFrame:
    """(kind, name, placeholder): numbered from 1 within each prefix in the order in which names are first seen."""
    numbered = P.ranks(found, "prefix", ["seen", "name"])
    digits = F.lpad(F.col("n").cast("string"), F.greatest(F.lit(3), F.length(F.col("n").cast("string"))), F.lit("0"))
    return numbered.select("kind", "name", F.concat("prefix", digits, "extension").alias("placeholder"))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD_OR_GAP), F.lit(0))


def _own_map(texts: DataFrame, key: str, words: Column, names: DataFrame, values: list[str]) -> DataFrame:
    """(key, own): the part of ``names`` (name and values, each name once) that occurs among the distinct words of each text; rows of the same key share theirs."""
    spread = texts.select(key, F.explode(F.array_distinct(words)).alias("name"))
    return spread.join(names, "name").groupBy(key).agg(F.map_from_entries(F.collect_set(F.struct("name", F.struct(*values)))).alias("own"))


def import_prefixes(line: Column) -> Column:
    """Dotted names of an import line."""
    return F.regexp_extract_all(line, F.lit(r"[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*"), F.lit(0))


def rewritten_imports(texts: DataFrame, key: str, text: str, modules: DataFrame) -> DataFrame:
    """``texts`` with every known module path (name, placeholder) of import lines replaced, the longest known beginning of a dotted name first."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(_IMPORT_LINE))
    dotted = texts.select(key, F.explode(F.array_distinct(F.flatten(F.transform(lines, import_prefixes)))).alias("dotted"))
    parts = F.split("dotted", r"\.")
    spread = dotted.select(key, "dotted", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))).alias("name"))
    best = spread.join(modules, "name").groupBy(key, "dotted").agg(F.max(F.struct(F.length("name").alias("n"), "placeholder")).alias("b"))
    own = best.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("dotted", F.concat(F.col("b.placeholder"), F.expr("substring(dotted, b.n + 1)"))))).alias("own"))
    pieces = lambda line: F.regexp_extract_all(line, F.lit(r"[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*|[^A-Za-z_]+"), F.lit(0))
    swap = lambda line: F.when(line.rlike(_IMPORT_LINE), F.array_join(F.transform(pieces(line), lambda w: F.coalesce(F.try_element_at("own", w), w)), "")).otherwise(line)
    joined = texts.join(own, key, "left")
    return joined.withColumn(text, F.when(F.col("own").isNull(), F.col(text)).otherwise(F.array_join(F.transform(F.split(text, "\n"), swap), "\n"))).drop("own")


def rewritten_words(texts: DataFrame, key: str, text: str, known: DataFrame) -> DataFrame:
    """``texts`` with every identifier of ``known`` (kind, name, placeholder) replaced, and the number of changes of each kind.

    A function's name is replaced wherever it stands as a word (as a definition, a call or by itself), a class's name in its
    definition, a parameter's name of more than two letters as any other word. Parts of longer words are never touched.
    Null texts stay null, with no changes.
    """
    of = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("placeholder")))
    names = known.where("kind in ('function', 'class', 'parameter')").groupBy("name").agg(of("function").alias("f"), of("class").alias("c"), of("parameter").alias("p"))
    own = _own_map(texts, key, words_of(F.col(text)), names, ["f", "c", "p"])
    joined = texts.join(own, key, "left").withColumn("__w", words_of(F.col(text)))
    at = lambda i: F.coalesce(F.get("__w", i), F.lit(""))

    def one(w: Column, i: Column) -> Column:
        hit = F.try_element_at("own", w)
        after = lambda word: (at(i - 2) == word) & at(i - 1).rlike(r"^[ \t]+$")
        opens = at(i + 1).rlike(r"^[ \t]*\(")
        is_parameter = hit["p"].isNotNull() & (F.length(w) > 2)
        change = (
            F.when(hit["f"].isNotNull() & after("def") & opens, "function_def").when(hit["f"].isNotNull() & opens, "function_call").when(hit["f"].isNotNull(), "standalone")
            .when(hit["c"].isNotNull() & after("class"), "class_def").when(is_parameter, "parameter")
        )
        to = F.coalesce(hit["f"], F.when(hit["c"].isNotNull() & after("class"), hit["c"]), F.when(is_parameter, hit["p"]), w)
        return F.struct(to.alias("w"), change.alias("change"))

    done = joined.withColumn("__d", F.transform("__w", one))
    count = lambda c: F.coalesce(F.size(F.filter("__d", lambda d: d["change"] == c)), F.lit(0))
    counts = [count(c) for c in CHANGES]
    kept = [c for c in texts.columns if c != text]
    return done.select(*kept, F.when(F.col("own").isNull(), F.col(text)).otherwise(F.array_join(F.transform("__d", lambda d: d["w"]), "")).alias(text), *(F.when(F.col("own").isNull(), 0).otherwise(n).alias(c) for n, c in zip(counts, CHANGES, strict=True)))


def masked_contributors(texts: DataFrame, key: str, text: str, contributors: DataFrame, most_words: int = 3) -> DataFrame:
    """``texts`` with every known contributor (column name: one to three words) replaced by [CONTRIBUTOR], whole words only, in any case, longer names first.

    Runs of one to three words of a text are joined with the names, so only names that are there are ever looked for in it.
    """
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[^\s,;:()<>\"'\[\]{}=#]+"), F.lit(0))
    run = lambda n: F.when(F.size("ws") >= n, F.transform(F.sequence(F.lit(1), F.size("ws") - (n - 1)), lambda i: F.array_join(F.slice("ws", i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))
    spread = texts.select(key, words.alias("ws")).select(key, F.explode(F.array_distinct(F.concat(*(run(n) for n in range(1, most_words + 1))))).alias("folded"))
    named = contributors.select(F.lower(F.trim("name")).alias("folded")).where("length(folded) > 2").distinct()
    own = spread.join(named, "folded").groupBy(key).agg(F.array_sort(F.collect_set(F.struct((-F.length("folded")).alias("n"), "folded"))).alias("own"))
    mask = lambda t, n: F.regexp_replace(t, F.concat(F.lit(r"(?i)\b\Q"), n["folded"], F.lit(r"\E(?![A-Za-z0-9_])")), F.lit("[CONTRIBUTOR]"))
    joined = texts.join(own, key, "left")
    return joined.withColumn(text, F.when(F.col("own").isNull(), F.col(text)).otherwise(F.aggregate("own", F.col(text), mask))).drop("own")


def sanitized_sources(texts: DataFrame, key: str, text: str, known: DataFrame, contributors: DataFrame) -> DataFrame:
    """The ordered pipeline: imports, definitions and classes and calls and words and parameters, literals, contributors."""
    imports = rewritten_imports(texts, key, text, known.where("kind = 'module'").select("name", "placeholder"))
    words = rewritten_words(imports, key, text, known).drop(*CHANGES)
    literal = words.withColumn(text, X.mask_inside(F.col(text)))
    return masked_contributors(literal, key, text, contributors)
