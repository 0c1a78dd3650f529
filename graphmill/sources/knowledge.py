"""Node and edge views of the knowledge graph over the domain tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphmill.operators.graph import module_name, node_id, slashed
from graphmill.sources.tables import load

#: Edge type of each list of a retrieval file.
CATEGORY_EDGES = {"callees": "CALLS", "callers": "CALLED_BY", "same_file": "SAME_FILE", "docs": "MENTIONS"}


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Graph nodes as they are stored; ids may repeat."""
    return load(spark, sf, "nodes")


def entity_id():
    """Graph id of a code entity: its key behind the type of its kind."""
    kind = F.when(F.col("kind").isin("function", "method"), "Function").when(F.col("kind") == "class", "Class").when(F.col("kind") == "module", "Module").otherwise("File")
    return node_id(kind, F.regexp_replace("entity_key", "^code_entities:", ""))


IMPORT_LINE = r"(?m)^[ \t]*(?:import|from)[ ][^\n]*"


def imported(spark: SparkSession, sf: str) -> DataFrame:
    """(module, file, target, alias): names that import lines of module sources bind, by one pattern per line; lines with several names give each."""
    code = load(spark, sf, "code_entities_full").where("kind = 'module' and source is not null and relpath is not null").select(module_name(F.col("relpath")).alias("module"), slashed(F.col("relpath")).alias("file"), F.explode(F.regexp_extract_all("source", F.lit(IMPORT_LINE), F.lit(0))).alias("line"))
    origin = F.regexp_extract("line", r"^[ \t]*from[ ]+([A-Za-z_][A-Za-z0-9_.]*)[ ]+import[ ]", 1)
    names = F.regexp_replace(F.regexp_replace("line", r"^[ \t]*(?:from[ ]+[A-Za-z0-9_.]+[ ]+)?import[ ]+", ""), r"[ \t\r]*(?:#.*)?$", "")
    each = code.where(~F.col("line").rlike(r"^[ \t]*from[ ]+\.")).select("module", "file", origin.alias("origin"), F.explode(F.split(names, ",")).alias("item"))
    name, given = F.regexp_extract("item", r"^\s*\(?\s*([A-Za-z_][A-Za-z0-9_.]*)", 1), F.regexp_extract("item", r"\bas\s+([A-Za-z_][A-Za-z0-9_]*)", 1)
    target = F.when(F.col("origin") == "", name).otherwise(F.concat_ws(".", "origin", name))
    alias = F.when(given != "", given).when(F.col("origin") == "", F.substring_index(name, ".", 1)).otherwise(name)
    return each.where(name != "").select("module", "file", target.alias("target"), alias.alias("alias")).distinct()


def aliases(spark: SparkSession, sf: str) -> DataFrame:
    """(module, alias, target) of all modules; a plain dotted import binds its first segment."""
    return imported(spark, sf).select("module", "alias", F.when(F.col("target").contains(".") & (F.substring_index("target", ".", 1) == F.col("alias")), F.col("alias")).otherwise(F.col("target")).alias("target")).distinct()


def blame(spark: SparkSession, sf: str) -> DataFrame:
    """(entity_key, qualified, name, file, lineno, deleted, sha, author, mail, author_time, summary, lines): the lines of each version of a function or class by the last commit that was written before it was indexed.

    An as-of join without a task that holds all commits: commits are reduced to the last one of each instant, looked up
    within the day of the version, and otherwise the last one of the latest earlier day (one row a day).
    """
    code = load(spark, sf, "code_entities_full").where("kind in ('function', 'method', 'class') and entity_key is not null and indexed_at is not null and relpath is not null and name is not null and lineno is not null")
    versions = code.select("entity_id", "entity_key", F.concat_ws(".", module_name(F.col("relpath")), "name").alias("qualified"), "name", slashed(F.col("relpath")).alias("file"), "lineno", F.col("deleted_at").isNotNull().alias("deleted"), F.greatest(F.lit(1), F.coalesce(F.col("end_lineno") - F.col("lineno") + 1, F.lit(1))).alias("lines"), "indexed_at", F.to_date("indexed_at").alias("day"))
    stored = load(spark, sf, "commits_sample").where("sha is not null and author_date is not null")
    commits = stored.groupBy("author_date").agg(F.min("sha").alias("sha")).withColumn("day", F.to_date("author_date"))
    by_day = commits.groupBy("day").agg(F.max(F.struct("author_date", "sha")).alias("last"))
    before = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)  # one row a day
    days = by_day.select("day").unionByName(versions.select("day")).distinct().join(by_day, "day", "left").select("day", F.last("last", ignorenulls=True).over(before).alias("earlier"))
    within = versions.join(commits, "day").where("author_date <= indexed_at").groupBy("entity_id").agg(F.max(F.struct("author_date", "sha")).alias("same"))
    chosen = versions.join(days, "day", "left").join(within, "entity_id", "left").withColumn("sha", F.coalesce("same", "earlier")["sha"]).where("sha is not null")
    details = stored.groupBy("sha").agg(F.min(F.struct("record_id", F.col("author_name").alias("author"), F.col("author_email").alias("mail"), F.col("author_date").alias("author_time"), F.col("message_head").alias("summary"))).alias("d"))
    return chosen.join(details, "sha").select("entity_key", "qualified", "name", "file", "lineno", "deleted", "sha", "d.author", "d.mail", "d.author_time", "d.summary", "lines")


def raw_edges(spark: SparkSession, sf: str) -> DataFrame:
    """(source, target, type, provenance): one row per observation."""
    kind = reduce(lambda acc, kv: acc.when(F.col("category") == kv[0], kv[1]), CATEGORY_EDGES.items(), F.when(F.lit(False), "")).otherwise("OTHER")
    retrieved = load(spark, sf, "retrieval_debug").select("node_id", "path", F.trim(slashed(F.col("neighbor_id"))).alias("target"), "category", kind.alias("type"), F.col("list_name").alias("provenance")).where("node_id is not null and target <> ''")
    listed = retrieved.select(F.col("node_id").alias("source"), "target", "type", "provenance")
    commits = load(spark, sf, "commits_sample").select("sha", F.explode("parents").alias("parent"))
    parents = commits.select(node_id("Commit", F.col("sha")).alias("source"), node_id("Commit", F.col("parent")).alias("target"), F.lit("PARENT").alias("type"), F.lit("commits").alias("provenance"))
    closed = load(spark, sf, "pull_requests").select("number", F.explode("commits").alias("c"))
    closes = closed.select(node_id("Commit", F.col("c.sha")).alias("source"), node_id("PR", F.col("number").cast("string")).alias("target"), F.lit("CLOSED_BY").alias("type"), F.lit("pull_requests").alias("provenance"))
    code = load(spark, sf, "code_entities_full")
    defines = code.select(node_id("File", F.col("relpath")).alias("source"), entity_id().alias("target"), F.lit("DEFINES").alias("type"), F.lit("code_entities").alias("provenance"))
    # imports: the longest beginning of the target that is a module of the repository, else a dependency on its first segment
    modules = code.where("relpath like '%.py'").select(module_name(F.col("relpath")).alias("name"), slashed(F.col("relpath")).alias("to_file")).groupBy("name").agg(F.min("to_file").alias("to_file"))
    wanted = imported(spark, sf).select("file", "target").distinct()
    parts = F.split("target", r"\.")
    heads = wanted.withColumn("k", F.explode(F.sequence(F.lit(1), F.size(parts)))).withColumn("name", F.array_join(F.slice(parts, F.lit(1), F.col("k")), "."))
    own = heads.join(modules, "name").groupBy("file", "target").agg(F.max(F.struct("k", "to_file"))["to_file"].alias("to_file"))
    placed = wanted.join(own, ["file", "target"], "left")
    imports = placed.where("to_file is not null and to_file <> file").select(node_id("File", F.col("file")).alias("source"), node_id("File", F.col("to_file")).alias("target"), F.lit("IMPORTS").alias("type"), F.lit("file_dependency_graph").alias("provenance"))
    depends = placed.where("to_file is null").select(node_id("File", F.col("file")).alias("source"), F.concat(F.lit("Dependency:"), F.substring_index("target", ".", 1)).alias("target"), F.lit("DEPENDS_ON").alias("type"), F.lit("dependencies").alias("provenance"))
    # calls of what is no node itself are kept between files
    places = load(spark, sf, "nodes").where("id is not null and path is not null").groupBy("id").agg(F.min(slashed(F.col("path"))).alias("to_file"))
    known = load(spark, sf, "nodes").select(F.col("id").alias("node_id")).distinct()
    loose = retrieved.where("category = 'callees' and path is not null").join(known, "node_id", "left_anti").join(places, F.col("target") == F.col("id")).where(slashed(F.col("path")) != F.col("to_file"))
    between = loose.select(node_id("File", F.col("path")).alias("source"), node_id("File", F.col("to_file")).alias("target"), F.lit("CALLS_FILE_LEVEL").alias("type"), F.lit("call_graph_fallback").alias("provenance"))
    changed = blame(spark, sf)
    modified = changed.select(F.concat(F.lit("Function:"), F.regexp_replace("entity_key", "^code_entities:", "")).alias("source"), node_id("Commit", F.col("sha")).alias("target"), F.lit("MODIFIED_BY").alias("type"), F.lit("function_commits").alias("provenance"))
    parts_ = [listed, parents, closes, defines, imports, depends, between, modified]
    return reduce(DataFrame.unionByName, parts_).where("source is not null and target is not null")


_SL = lambda c: f"replace({c}, '\\', '/')"
_MODULE = lambda c: rf"replace(regexp_replace(regexp_replace({_SL(c)}, '\.py$', ''), '/__init__$', ''), '/', '.')"
IMPORTED_SQL = rf"""il as (select {_MODULE('relpath')} as module, {_SL('relpath')} file, unnest(regexp_extract_all(source, '{IMPORT_LINE}', 0)) line from code_entities_full where kind = 'module' and source is not null and relpath is not null),
it as (select module, file, regexp_extract(line, '^[ \t]*from[ ]+([A-Za-z_][A-Za-z0-9_.]*)[ ]+import[ ]', 1) origin, unnest(string_split(regexp_replace(regexp_replace(line, '^[ \t]*(?:from[ ]+[A-Za-z0-9_.]+[ ]+)?import[ ]+', ''), '[ \t\r]*(?:#.*)?$', ''), ',')) item from il where not regexp_matches(line, '^[ \t]*from[ ]+\.')),
im as (select distinct module, file, case when origin = '' then n else origin || '.' || n end target, case when g <> '' then g when origin = '' then split_part(n, '.', 1) else n end alias from (select *, regexp_extract(item, '^\s*\(?\s*([A-Za-z_][A-Za-z0-9_.]*)', 1) n, regexp_extract(item, '\bas\s+([A-Za-z_][A-Za-z0-9_]*)', 1) g from it) where n <> '')"""
ALIASES_SQL = f"{IMPORTED_SQL}, al as (select distinct module, alias, case when contains(target, '.') and split_part(target, '.', 1) = alias then alias else target end target from im)"
BLAME_SQL = rf"""bv as (select entity_id, entity_key, {_MODULE('relpath')} || '.' || name qualified, name, {_SL('relpath')} file, lineno, deleted_at is not null deleted, greatest(1, coalesce(end_lineno - lineno + 1, 1)) lines, indexed_at from code_entities_full where kind in ('function', 'method', 'class') and entity_key is not null and indexed_at is not null and relpath is not null and name is not null and lineno is not null),
bc as (select author_date, min(sha) sha from commits_sample where sha is not null and author_date is not null group by 1), bd as (select * from (select sha, author_name author, author_email mail, author_date author_time, message_head summary, row_number() over (partition by sha order by record_id) r from commits_sample where sha is not null and author_date is not null) where r = 1),
bj as (select bv.*, bc.sha from bv asof join bc on bv.indexed_at >= bc.author_date), blame as (select entity_key, qualified, name, file, lineno, deleted, bj.sha, author, mail, author_time, summary, lines from bj join bd on bd.sha = bj.sha)"""
EDGES_SQL = rf"""
{IMPORTED_SQL}, {BLAME_SQL}, md as (select {_MODULE('relpath')} as name, min({_SL('relpath')}) to_file from code_entities_full where ends_with(relpath, '.py') group by 1), iw as (select distinct file, target from im),
ip as (select file, target, (select to_file from md where md.name = iw.target or starts_with(iw.target, md.name || '.') order by length(md.name) desc limit 1) to_file from iw), np as (select id, min({_SL('path')}) to_file from nodes where id is not null and path is not null group by 1),
raw as (
  select node_id as source, trim(replace(neighbor_id, '\', '/')) target, case category when 'callees' then 'CALLS' when 'callers' then 'CALLED_BY' when 'same_file' then 'SAME_FILE' when 'docs' then 'MENTIONS' else 'OTHER' end as type, list_name provenance from retrieval_debug where node_id is not null and trim(replace(neighbor_id, '\', '/')) <> ''
  union all select 'Commit:' || sha, 'Commit:' || p, 'PARENT', 'commits' from (select sha, unnest(parents) p from commits_sample) where sha is not null and p is not null
  union all select 'Commit:' || c.sha, 'PR:' || number::varchar, 'CLOSED_BY', 'pull_requests' from (select number, unnest(commits) c from pull_requests) where c.sha is not null and number is not null
  union all select 'File:' || replace(relpath, '\', '/'), case when kind in ('function', 'method') then 'Function' when kind = 'class' then 'Class' when kind = 'module' then 'Module' else 'File' end || ':' || replace(regexp_replace(entity_key, '^code_entities:', ''), '\', '/'), 'DEFINES', 'code_entities' from code_entities_full where relpath is not null and entity_key is not null
  union all select 'File:' || file, 'File:' || to_file, 'IMPORTS', 'file_dependency_graph' from ip where to_file is not null and to_file <> file
  union all select 'File:' || file, 'Dependency:' || split_part(target, '.', 1), 'DEPENDS_ON', 'dependencies' from ip where to_file is null
  union all select 'File:' || {_SL('path')}, 'File:' || to_file, 'CALLS_FILE_LEVEL', 'call_graph_fallback' from retrieval_debug join np on np.id = trim({_SL('neighbor_id')}) where category = 'callees' and path is not null and node_id is not null and {_SL('path')} <> to_file and node_id not in (select id from nodes where id is not null)
  union all select 'Function:' || regexp_replace(entity_key, '^code_entities:', ''), 'Commit:' || sha, 'MODIFIED_BY', 'function_commits' from blame),
per as (select source, target, type, provenance, count(*) n from raw group by all),
e as (select source, target, type, sum(n)::bigint as count, array_to_string(list_sort(list(provenance || '=' || n)), ';') provenance from per group by 1, 2, 3)
"""
