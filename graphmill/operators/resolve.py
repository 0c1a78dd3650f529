"""Matching names, paths and line spans: prioritized strategies, suffix and prefix matches, enclosing spans.

Every theta condition is brought to an equality first (last segment, base name, seven characters of a hash, file)
and filtered afterwards, so no join runs over all pairs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphmill.operators.graph import first_by_priority, slashed
from graphmill.session import cut


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows per key; Spark keeps only k rows per key in each task before the shuffle (window group limit)."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)


def set_sizes(left: DataFrame, right: DataFrame) -> DataFrame:
    """Sizes of intersection, differences and union of two columns of ids, from one aggregation."""
    one, two = left.distinct().withColumn("side", F.lit(1)), right.distinct().withColumn("side", F.lit(2))
    sides = one.unionByName(two).groupBy("id").agg(F.sum("side").alias("s"))
    n = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    wide = sides.agg(n(F.col("s") == 3).alias("intersection"), n(F.col("s") == 1).alias("left_only"), n(F.col("s") == 2).alias("right_only"), F.count("*").alias("union"))
    return wide.unpivot([], ["intersection", "left_only", "right_only", "union"], "operation", "n").select("operation", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def basename(path: Column) -> Column:
    return F.substring_index(slashed(path), "/", -1)


def prioritized(strategies: list[DataFrame], keys: list[str], order: list[str]) -> DataFrame:
    """The match of the first strategy that hits; each strategy has the keys, ``strategy`` and the order columns."""
    tagged = [s.withColumn("priority", F.lit(i)) for i, s in enumerate(strategies)]
    return first_by_priority(reduce(DataFrame.unionByName, tagged), keys, order)


def commits_of_prs(prs: DataFrame, commits: DataFrame) -> DataFrame:
    """(number, sha, strategy): the commit of a pull request by equal hash, equal small letters, equal first seven characters, the first seven anywhere in a hash, and last a listed commit whose first seven are those of a known one. The first strategy that hits decides."""
    left = prs.select("number", F.col("merge_commit_sha").alias("want")).where("number is not null and want is not null and want <> ''").distinct()
    have = commits.select("sha").where("sha is not null").distinct()
    low = lambda c: F.lower(F.col(c))
    seven = lambda c: F.substring(low(c), 1, 7)
    exact = left.join(have, F.col("want") == F.col("sha")).select("number", "sha", F.lit("exact").alias("strategy"))
    lower = left.join(have, low("want") == low("sha")).select("number", "sha", F.lit("lower").alias("strategy"))
    prefix = left.join(have, seven("want") == seven("sha")).select("number", "sha", F.lit("prefix7").alias("strategy"))
    open_ = cut(left.join(prefix.select("number").distinct(), "number", "left_anti"))
    inside = contained(open_.select(seven("want").alias("part")).distinct(), have.select(low("sha").alias("whole")))
    within = open_.join(inside, seven("want") == F.col("part")).join(have, low("sha") == F.col("whole")).select("number", "sha", F.lit("contains").alias("strategy"))
    if "commits" not in prs.columns:
        return prioritized([exact, lower, prefix, within], ["number"], ["sha", "strategy"]).select("number", "sha", "strategy")
    listed = prs.select("number", F.explode("commits").alias("c")).where("number is not null and c.sha <> ''").select("number", F.substring(F.lower("c.sha"), 1, 7).alias("s7")).distinct()
    reverse = listed.join(have.withColumn("s7", seven("sha")), "s7").select("number", "sha", F.lit("listed").alias("strategy"))
    return prioritized([exact, lower, prefix, within, reverse], ["number"], ["sha", "strategy"]).select("number", "sha", "strategy")


#: Lines of a file that one block holds when sites look for the spans around them.
BLOCK = 128


def enclosing(sites: DataFrame, spans: DataFrame, block: int = BLOCK) -> DataFrame:
    """sites (file, site_id, line) with the smallest span (file, name, first, last) that holds the line.

    The join is on the file and the block of lines, so a site meets the spans near it and not all of its file; distinct
    spans are repeated once for each block they reach into. The smallest is found by an aggregation. Sites without a
    span keep a null name.
    """
    of = lambda c: F.floor(F.col(c) / block)
    near = spans.select("file", "name", "first", "last").where("first <= last").distinct().withColumn("block", F.explode(F.sequence(of("first"), of("last"))))
    inside = sites.withColumn("block", of("line")).join(near, ["file", "block"]).where("line between first and last")
    best = inside.groupBy("site_id").agg(F.min(F.struct((F.col("last") - F.col("first")).alias("width"), "first", "name")).alias("b")).select("site_id", F.col("b.name").alias("name"), F.col("b.width").alias("width"))
    return sites.join(best, "site_id", "left")


def by_suffix(names: DataFrame, symbols: DataFrame) -> DataFrame:
    """names (short) with the least qualified symbol that ends in ``.short``, else the least that ends in ``short``.

    Both are equalities: the first on the last segment, the second on all endings of the symbols that are as long as one
    of the names the first left open.
    """
    short = names.select("short").where("short <> ''").distinct()
    known = symbols.select("qualified").where("qualified is not null").distinct()
    dotted = cut(short.join(known.withColumn("short", F.substring_index("qualified", ".", -1)), "short").groupBy("short").agg(F.min("qualified").alias("qualified")).withColumn("strategy", F.lit("dotted")))
    open_ = cut(short.join(dotted, "short", "left_anti"))
    sizes = open_.select(F.length("short").alias("n")).distinct()
    endings = known.join(F.broadcast(sizes), F.col("n") <= F.length("qualified")).select("qualified", F.expr("right(qualified, n)").alias("short"))  # as many rows as names have lengths
    bare = open_.join(endings, "short").groupBy("short").agg(F.min("qualified").alias("qualified")).withColumn("strategy", F.lit("bare"))
    return dotted.unionByName(bare).select("short", "qualified", "strategy")


def chain_strategies(sites: DataFrame, symbols: DataFrame, aliases: DataFrame) -> dict[str, DataFrame]:
    """Candidates (module, chain, qualified, strategy) of call chains for each strategy, from distinct sites (module, chain), symbols (qualified) and aliases (module, alias, target).

    direct: the chain is a symbol. module_scoped: a single name in the site's module. alias: the first segment is an alias of
    the module, expanded with as much of the rest as is a symbol. alias_whole: the target itself. progressive, shortest: the
    longest and the shortest beginning of the chain. class_method, class_method_global: two segments in the module, or at
    the end of any symbol. short: the last segment of any symbol; short_single only for single names.
    """
    s = cut(sites.select("module", "chain").where("chain <> ''").distinct())
    known = cut(symbols.select("qualified").where("qualified is not null").distinct())
    parts = F.split("chain", r"\.")
    size = F.size(parts)
    keys = ["module", "chain"]
    named = lambda df, strategy: df.select(*keys, "qualified", F.lit(strategy).alias("strategy"))
    look = lambda df: df.join(known, "qualified", "left_semi")
    heads = s.withColumn("k", F.explode(F.sequence(F.lit(1), size))).withColumn("qualified", F.array_join(F.slice(parts, F.lit(1), F.col("k")), "."))
    begun = look(heads)
    best = lambda df, order: df.groupBy(*keys).agg(F.max(F.struct(order.alias("o"), "qualified"))["qualified"].alias("qualified"))
    mapped = s.join(aliases.select("module", "alias", "target").distinct(), (s["module"] == aliases["module"]) & (F.get(parts, F.lit(0)) == F.col("alias"))).select(s["module"], "chain", "target")
    expanded = mapped.withColumn("k", F.explode(F.sequence(F.lit(0), size - 1))).withColumn("qualified", F.when(F.col("k") == 0, F.col("target")).otherwise(F.concat_ws(".", "target", F.array_join(F.slice(parts, F.lit(2), F.col("k")), "."))))
    tails = lambda n: known.withColumn("tail", F.substring_index("qualified", ".", -n))
    short = s.withColumn("tail", F.substring_index("chain", ".", -1)).join(tails(1), "tail")
    return {
        "direct": named(look(s.withColumn("qualified", F.col("chain"))), "direct"),
        "module_scoped": named(look(s.where(size == 1).withColumn("qualified", F.concat_ws(".", "module", "chain"))), "module_scoped"),
        "alias": named(best(look(expanded.where("k > 0 or chain not like '%.%'")), F.col("k")), "alias"),
        "alias_whole": named(look(expanded.where("k = 0")), "alias_whole"),
        "progressive": named(best(begun, F.col("k")), "progressive"),
        "shortest": named(best(begun, -F.col("k")), "shortest"),
        "class_method": named(look(s.where(size == 2).withColumn("qualified", F.concat_ws(".", "module", "chain"))), "class_method"),
        "class_method_global": named(s.where(size == 2).join(tails(2), F.col("chain") == F.col("tail")).where("qualified <> chain"), "class_method_global"),
        "short": named(short, "short"),
        "short_single": named(short.where(size == 1), "short"),
    }


CHAIN_ORDER = ("direct", "module_scoped", "alias", "progressive", "class_method", "class_method_global", "short")
OLDER_ORDER = ("direct", "shortest", "module_scoped", "short_single", "alias", "alias_whole")


def resolved_chains(sites: DataFrame, symbols: DataFrame, aliases: DataFrame, order: tuple[str, ...] = CHAIN_ORDER) -> DataFrame:
    """(module, chain, qualified, strategy): the first strategy of ``order`` that hits, with its least symbol; chains without any are ``unresolved``."""
    found = chain_strategies(sites, symbols, aliases)
    best = prioritized([found[name] for name in order], ["module", "chain"], ["qualified", "strategy"]).select("module", "chain", "qualified", "strategy")
    return sites.select("module", "chain").where("chain <> ''").distinct().join(best, ["module", "chain"], "left").select("module", "chain", "qualified", F.coalesce("strategy", F.lit("unresolved")).alias("strategy"))


def longest_prefix(names: DataFrame, modules: DataFrame) -> DataFrame:
    """names (name) with the longest module (module, file) that is a dotted prefix: prefixes are listed per name and matched by equality."""
    parts = F.split("name", r"\.")
    listed = names.select("name", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), ".").alias("module")))).alias("p")).select("name", "p.depth", "p.module")
    hits = listed.join(modules.select("module", "file").distinct(), "module")
    return hits.groupBy("name").agg(F.max(F.struct("depth", "module", "file")).alias("b")).select("name", F.col("b.module").alias("module"), F.col("b.file").alias("file"))


def by_path_suffix(targets: DataFrame, entities: DataFrame, k: int = 3) -> DataFrame:
    """The k best entities (entity_id, path, name, first, last) of the same base name for targets (target_id, path, name); equal questions are scored once.

    Path ends with +5, contains +2, equal last two segments +3.5, equal name +3, contained name +1.5, a span +0.5, .py +0.1.
    """
    t = targets.select("target_id", slashed(F.col("path")).alias("want"), F.col("name").alias("want_name"), basename(F.col("path")).alias("base"))
    e = entities.select("entity_id", slashed(F.col("path")).alias("have"), F.col("name").alias("have_name"), "first", "last", basename(F.col("path")).alias("base"))
    asks = t.select("want", "want_name", "base").distinct()
    pairs = asks.join(e, "base")
    two = lambda c: F.substring_index(F.col(c), "/", -2)
    points = [
        F.when(F.col("have").endswith(F.col("want")), 5.0).when(F.col("have").contains(F.col("want")), 2.0).otherwise(0.0),
        F.when(two("have") == two("want"), 3.5).otherwise(0.0),
        F.when(F.col("have_name") == F.col("want_name"), 3.0).when(F.col("have_name").contains(F.col("want_name")), 1.5).otherwise(0.0),
        F.when(F.col("first").isNotNull() & F.col("last").isNotNull(), 0.5).otherwise(0.0),
        F.when(F.col("have").endswith(".py"), 0.1).otherwise(0.0),
    ]
    scored = pairs.select("want", "want_name", "entity_id", F.round(reduce(lambda a, b: a + b, points), 2).alias("score"))
    best = top_k(scored, ["want", "want_name"], [F.desc("score"), F.col("entity_id")], k)
    return t.join(best, ["want", "want_name"]).select("target_id", "entity_id", "score", "rank")


def _runs(text: str) -> Column:
    """All distinct runs of one to three characters."""

    def of(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(F.col(text), i, F.lit(n)))

    return F.array_distinct(F.concat(*(F.when(F.length(text) >= n, of(n)).otherwise(F.array().cast("array<string>")) for n in (1, 2, 3))))


def contained(parts: DataFrame, wholes: DataFrame) -> DataFrame:
    """(part, whole): every pair of parts (part) and wholes (whole) of which the second contains the first; empty texts give none.

    Nothing is lost: a part is looked up by its run of three characters (itself, if shorter) that is rarest among the wholes.
    """
    runs = cut(wholes.where("whole <> ''").distinct().select("whole", F.explode(_runs("whole")).alias("run")))
    own = parts.where("part <> ''").distinct().select("part", F.explode(_runs("part")).alias("run")).where("length(run) = least(3, length(part))")
    counts = runs.groupBy("run").agg(F.count("*").alias("n"))
    rarest = own.join(counts, "run", "left").groupBy("part").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "run"))["run"].alias("run"))
    return rarest.join(runs, "run").where(F.contains("whole", "part")).select("part", "whole")


def best_entities(targets: DataFrame, entities: DataFrame, k: int = 3) -> DataFrame:
    """(target_id, entity_id, score, rank): the k best of all entities for targets (target_id, path, name), without case.

    Entities are (entity_id, path, name, sig, first, last). Path ends with +5, contains +2 (both, then), equal last two
    segments +3.5, each of name and signature equal +3 or containing +1.5, a first or last line +0.5, .py +0.1; an
    empty path or name gives no points. Entities without points count only where no entity has any, those with the base
    name in their path first.

    All with points for path or name are found by containment; of the others, which differ only by line and .py, no more
    than the k best of all entities can be among the k best.
    """
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    base = F.regexp_extract("want", "([^/]+)/*$", 1)
    t = cut(targets.select("target_id", low(slashed(F.col("path"))).alias("want"), low(F.col("name")).alias("want_name")))
    asks = cut(t.select("want", "want_name").distinct().withColumn("base", base))
    has_line = F.col("first").isNotNull() | F.col("last").isNotNull()
    own = F.when(has_line, 0.5).otherwise(0.0) + F.when(F.col("have").endswith(".py"), 0.1).otherwise(0.0)
    e = cut(entities.select("entity_id", low(slashed(F.col("path"))).alias("have"), low(F.col("name")).alias("name"), low(F.col("sig")).alias("sig"), "first", "last").select("entity_id", "have", "name", "sig", own.alias("own")))
    paths = contained(asks.select(F.col("base").alias("part")), e.select(F.col("have").alias("whole")))
    names = contained(asks.select(F.col("want_name").alias("part")), e.select(F.explode(F.array("name", "sig")).alias("whole")))
    keys = ["want", "want_name", "base", "entity_id"]
    by_path = asks.join(paths, F.col("base") == F.col("part")).join(e, F.col("whole") == F.col("have")).select(keys)
    named = names.join(e.select("entity_id", F.explode(F.array_distinct(F.array("name", "sig"))).alias("whole")), "whole").select("part", "entity_id").distinct()
    by_name = asks.join(named, F.col("want_name") == F.col("part")).select(keys)
    top = e.orderBy(F.desc("own"), "entity_id").limit(k).select("entity_id")
    # an entity without any point may still have the base name in its path; those come with by_path
    pairs = by_path.unionByName(by_name).unionByName(asks.crossJoin(F.broadcast(top)).select(keys)).distinct().join(e, "entity_id")  # k rows
    two = lambda c: F.substring_index(F.col(c), "/", -2)
    asked, called = F.col("want") != "", F.col("want_name") != ""
    points = [
        F.when(asked & F.col("have").endswith(F.col("want")), 5.0).otherwise(0.0),
        F.when(asked & F.col("have").contains(F.col("want")), 2.0).otherwise(0.0),
        F.when(asked & (two("have") == two("want")), 3.5).otherwise(0.0),
        *(F.when(called & (F.col(c) == F.col("want_name")), 3.0).when(called & F.col(c).contains(F.col("want_name")), 1.5).otherwise(0.0) for c in ("name", "sig")),
        F.col("own"),
    ]
    relaxed = (F.col("base") != "") & F.col("have").contains(F.col("base"))
    scored = pairs.select("want", "want_name", "entity_id", F.round(reduce(lambda a, b: a + b, points), 2).alias("score"), relaxed.alias("relaxed"))
    ranked = top_k(scored, ["want", "want_name"], [F.desc("score"), F.when(F.col("score") > 0, F.lit(True)).otherwise(F.col("relaxed")).desc(), F.col("entity_id")], k)
    most = ranked.withColumn("most", F.max("score").over(Window.partitionBy("want", "want_name"))).where("score > 0 or most = 0")
    return t.join(most.select("want", "want_name", "entity_id", "score", "rank"), ["want", "want_name"]).select("target_id", "entity_id", "score", "rank")


def vote(calls: DataFrame, least: int = 2) -> DataFrame:
    """(name, place, status) from calls (name, file): the file of most calls, else the directory of most, with at least ``least`` votes; ties are ambiguous."""
    per_file = calls.groupBy("name", "file").agg(F.count("*").alias("votes"))
    folder = F.when(F.col("file").contains("/"), F.regexp_replace("file", "/[^/]*$", "")).otherwise("")
    per_folder = per_file.groupBy("name", folder.alias("folder")).agg(F.sum("votes").alias("votes"))

    def leader(df: DataFrame, place: str, status: str) -> DataFrame:
        top = df.groupBy("name").agg(F.max("votes").alias("votes"))
        tied = df.join(top, ["name", "votes"]).groupBy("name", "votes").agg(F.min(place).alias("place"), F.count("*").alias("n"))
        return tied.where((F.col("n") == 1) & (F.col("votes") >= least)).select("name", "place", F.lit(status).alias("status"))

    found = prioritized([leader(per_file, "file", "file_majority"), leader(per_folder, "folder", "directory_consensus")], ["name"], ["place", "status"])
    return calls.select("name").distinct().join(found, "name", "left").select("name", "place", F.coalesce("status", F.lit("ambiguous")).alias("status"))
