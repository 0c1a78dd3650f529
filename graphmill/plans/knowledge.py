"""Queries over the knowledge graph: building, statistics, traversal, resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphmill.operators import graph as G
from graphmill.operators import resolve as V
from graphmill.operators import rewrite as R
from graphmill.plans.rewriting import ROLED_SQL
from graphmill.session import cut
from graphmill.sources import load
from graphmill.sources.knowledge import EDGES_SQL, blame, entity_id, nodes, raw_edges


def edges(spark, sf):
    return G.merge_edges(raw_edges(spark, sf))


def g1_nodes(spark, sf):
    """Nodes of eight sources in order (files, modules, functions and classes, commits, requests, dependencies, documents, stored nodes), the later replacing the earlier."""
    code = load(spark, sf, "code_entities_full").where("relpath is not null")
    path = G.slashed(F.col("relpath"))
    text = lambda c: F.lit(c).cast("string")
    node = lambda df, kind, ident, label, place: df.select(G.node_id(kind, ident).alias("id"), F.lit(kind).alias("node_type"), label.alias("label"), place.alias("path"))
    files = node(code, "File", path, V.basename(F.col("relpath")), path)
    modules = node(code.where("relpath like '%.py'"), "Module", G.module_name(F.col("relpath")), F.substring_index(G.module_name(F.col("relpath")), ".", -1), path)
    entities = load(spark, sf, "code_entities_full").where("kind in ('function', 'method', 'class')").select(entity_id().alias("id"), F.substring_index(entity_id(), ":", 1).alias("node_type"), F.col("name").alias("label"), path.alias("path"))
    commits = node(load(spark, sf, "commits_sample"), "Commit", F.col("sha"), F.substring("sha", 1, 7), text(None))
    requests = node(load(spark, sf, "pull_requests"), "PR", F.col("number").cast("string"), F.concat(F.lit("#"), F.col("number").cast("string")), text(None))
    packages = raw_edges(spark, sf).where("type = 'DEPENDS_ON'").select(F.col("target").alias("id"), F.lit("Dependency").alias("node_type"), F.substring_index("target", ":", -1).alias("label"), text(None).alias("path"))
    listed = load(spark, sf, "retrieval_debug").select(F.trim(G.slashed(F.col("neighbor_id"))).alias("id")).where("id like 'Document:%'")
    documents = listed.select("id", F.lit("Document").alias("node_type"), V.basename(F.substring("id", 10, 100_000)).alias("label"), F.substring("id", 10, 100_000).alias("path"))
    stored = nodes(spark, sf).select("id", "node_type", "label", "path")
    return G.last_wins([d.where("id is not null") for d in (files, modules, entities, commits, requests, packages, documents, stored)], "id")


def g3_file_edges(spark, sf):
    """Edges between files: imports, and calls collapsed to the files of both ends, with count and sorted reasons; what stays within a file is left out."""
    raw = raw_edges(spark, sf)
    paths = nodes(spark, sf).where("path is not null").groupBy("id").agg(F.min("path").alias("path"))
    calls = raw.where("type = 'CALLS'").join(paths.select(F.col("id").alias("source"), F.col("path").alias("source_file")), "source").join(paths.select(F.col("id").alias("target"), F.col("path").alias("target_file")), "target").where("source_file <> target_file")
    imports = raw.where("type in ('IMPORTS', 'CALLS_FILE_LEVEL')").select("type", F.substring("source", 6, 100_000).alias("source_file"), F.substring("target", 6, 100_000).alias("target_file"), "provenance")
    both = calls.select("type", "source_file", "target_file", "provenance").unionByName(imports)
    return both.groupBy("type", "source_file", "target_file").agg(F.count("*").alias("count"), F.array_join(F.array_sort(F.collect_set("provenance")), ";").alias("reasons"))


def _targets(spark, sf):
    return load(spark, sf, "target_ast_map").select(F.col("node_id").alias("id")).where("id is not null").distinct()


def g4_khop(spark, sf):
    """Callees of every mapped target within two hops, and callers likewise; seeds left out."""
    e = edges(spark, sf).where("type in ('CALLS', 'CALLED_BY')")
    callees = cut(e.select(F.when(F.col("type") == "CALLS", F.col("source")).otherwise(F.col("target")).alias("source"), F.when(F.col("type") == "CALLS", F.col("target")).otherwise(F.col("source")).alias("target")).distinct())
    callers = callees.select(F.col("target").alias("source"), F.col("source").alias("target"))
    one = lambda side, adj: G.neighbourhoods(_targets(spark, sf), adj, 2).groupBy("id").agg(F.min("distance").alias("distance"), F.count("*").alias("seeds")).withColumn("side", F.lit(side))
    return one("callees", callees).unionByName(one("callers", callers))


def g5_subgraph(spark, sf):
    """Edges among pull requests and everything one undirected hop away, counted by type."""
    e = edges(spark, sf)
    seeds = e.where("type = 'CLOSED_BY'").select(F.col("target").alias("id")).distinct()
    around = G.hops(seeds, G.undirected(e), 1)
    return G.induced(e, around).groupBy("type").agg(F.count("*").alias("n"), F.sum("count").alias("weight"))


def g6_hop_distance(spark, sf):
    """Shortest distance of commits from the commits that merged a pull request, along parents, at most four hops."""
    merged = load(spark, sf, "pull_requests").where("merge_commit_sha is not null").select(G.node_id("Commit", F.col("merge_commit_sha")).alias("id"))
    parents = edges(spark, sf).where("type = 'PARENT'")
    return G.hops(merged, parents, 4)


def g9_subgraph_density(spark, sf):
    """Nodes, edges, density and average degree of the subgraph of commits and requests, and its edges by type."""
    e = cut(edges(spark, sf).where("type in ('PARENT', 'CLOSED_BY', 'MODIFIED_BY')"))
    ids = e.select(F.col("source").alias("id")).unionByName(e.select(F.col("target").alias("id")))
    whole = G.density(ids, e).select(*(F.col(c).cast("double").alias(c) for c in ("nodes", "edges", "density", "average_degree"))).unpivot([], ["nodes", "edges", "density", "average_degree"], "metric", "value")
    return whole.unionByName(e.groupBy(F.concat(F.lit("type "), "type").alias("metric")).agg(F.count("*").cast("double").alias("value")))


def g11_rerank(spark, sf):
    """The eight best neighbours of each node by 3 caller + 1.5 callee + 1 same file + name + 1/(1 + distance) + 2 cosine; nodes with fewer get neighbours of their neighbours at 0.5 + 1/3."""
    d = load(spark, sf, "retrieval_debug").where("node_id is not null and neighbor_id <> ''")
    base = F.when(F.col("category") == "callers", 3.0).when(F.col("category") == "callees", 1.5).when(F.col("category") == "same_file", 1.0).otherwise(0.5)
    score = base + F.coalesce("name_sim", F.lit(0.0)) + F.coalesce(1 / (1 + F.col("graph_dist")), F.lit(0.0)) + 2 * F.coalesce("emb_sim", F.lit(0.0))
    best = cut(d.groupBy("node_id", "neighbor_id").agg(F.max(F.round(score, 6)).alias("score")))
    own = V.top_k(best, ["node_id"], [F.desc("score"), F.col("neighbor_id")], 8)
    few = best.groupBy("node_id").agg(F.count("*").alias("k")).where("k < 8").select("node_id")
    through = best.join(few, "node_id", "left_semi").select("node_id", F.col("neighbor_id").alias("via")).join(own.select(F.col("node_id").alias("via"), "neighbor_id"), "via").where("neighbor_id <> node_id").select("node_id", "neighbor_id").distinct()
    expanded = through.join(best.select("node_id", "neighbor_id"), ["node_id", "neighbor_id"], "left_anti").withColumn("score", F.round(F.lit(0.5) + 1 / F.lit(3.0), 6))
    return V.top_k(best.withColumn("expanded", F.lit(False)).unionByName(expanded.withColumn("expanded", F.lit(True))), ["node_id"], [F.col("expanded"), F.desc("score"), F.col("neighbor_id")], 8)


def w7_context_union(spark, sf):
    """Neighbours deduplicated by category priority, at most 10 of a category and 50 in all per node."""
    order = F.when(F.col("category") == "callers", 0).when(F.col("category") == "callees", 1).when(F.col("category") == "same_file", 2).otherwise(3)
    d = load(spark, sf, "retrieval_debug").where("node_id is not null and neighbor_id <> ''").groupBy("node_id", "neighbor_id").agg(F.min(F.struct(order.alias("p"), (-F.coalesce("score", F.lit(0.0))).alias("s"))).alias("b"))
    flat = d.select("node_id", "neighbor_id", F.col("b.p").alias("priority"), F.col("b.s").alias("s"))
    capped = V.top_k(flat, ["node_id", "priority"], [F.col("s"), F.col("neighbor_id")], 10, "place")
    return V.top_k(capped, ["node_id"], [F.col("priority"), F.col("place")], 50).select("node_id", "neighbor_id", "priority", "rank")


def g12_same_file(spark, sf):
    """The other functions and classes of each target's file, and documents of its folder or named after its file."""
    stored = nodes(spark, sf).where("path is not null and id is not null").select("id", "node_type", G.slashed(F.col("path")).alias("path")).distinct()
    targets = load(spark, sf, "target_ast_map").where("node_id is not null and path is not null").select(F.col("node_id").alias("target"), G.slashed(F.col("path")).alias("path")).distinct()
    same = targets.join(stored.where("node_type in ('Function', 'Class')"), "path").where("id <> target").select("target", "id", F.lit("same_file").alias("category"))
    folder, stem = (lambda c: F.regexp_replace(c, "/[^/]*$", "")), (lambda c: F.regexp_replace(V.basename(F.col(c)), r"(?:_[0-9]+)?\.[A-Za-z]+$", ""))
    docs = stored.where("node_type = 'Document'").select("id", folder("path").alias("folder"), stem("path").alias("stem"))
    t = targets.select("target", folder("path").alias("folder"), stem("path").alias("stem")).distinct()
    near = t.join(docs.select("id", "folder"), "folder").select("target", "id").unionByName(t.join(docs.select("id", "stem"), "stem").select("target", "id")).distinct().withColumn("category", F.lit("near_doc"))
    return same.unionByName(near).distinct()


def g13_provenance(spark, sf):
    """Commits and functions with what introduced them: for a commit the least request that lists it, for a function its first commit by blame and that commit's request, with all commits that changed it."""
    pr = load(spark, sf, "pull_requests").select("number", "title", F.explode("commits").alias("c")).select(F.col("c.sha").alias("sha"), "number", "title").where("sha is not null and number is not null")
    first = cut(pr.groupBy("sha").agg(F.min(F.struct("number", F.coalesce("title", F.lit("")).alias("title"))).alias("b"), F.count_distinct("number").alias("prs")))
    commits = load(spark, sf, "commits_sample").where("sha is not null").select(F.concat(F.lit("Commit:"), "sha").alias("id"), "sha", F.lit("").alias("modified_by")).distinct()
    changed = blame(spark, sf).groupBy("qualified").agg(F.min(F.struct("author_time", "sha"))["sha"].alias("sha"), F.array_join(F.array_sort(F.collect_set("sha")), ",").alias("modified_by")).select(F.concat(F.lit("Function:"), "qualified").alias("id"), "sha", "modified_by")
    both = commits.unionByName(changed).join(first, "sha", "left")
    return both.select("id", F.col("sha").alias("introduced_by_commit"), F.col("b.number").alias("introduced_by_pr"), F.nullif(F.col("b.title"), F.lit("")).alias("introduced_by_pr_title"), F.coalesce("prs", F.lit(0)).alias("prs"), "modified_by")


def _new_ids(spark, sf):
    """(old_id, new_id): ids of nodes by the identifier map: the longest known module of a dotted name and the placeholder of its last segment, files by theirs; all others by a short hash."""
    known = cut(R.identifier_map(R.identifiers(load(spark, sf, "code_entities_full"))))
    of = lambda kinds: known.where(F.col("kind").isin(*kinds)).groupBy("name").agg(F.min("placeholder").alias("placeholder"))
    ids = nodes(spark, sf).where("id is not null").select(F.col("id").alias("old_id")).distinct().withColumn("kind", F.substring_index("old_id", ":", 1)).withColumn("inner", F.regexp_replace("old_id", "^[^:]*:", ""))
    dotted = ids.where("kind in ('Function', 'Class', 'Module')")
    parts = F.split("inner", r"\.")
    heads = dotted.withColumn("k", F.explode(F.sequence(F.lit(1), F.size(parts)))).withColumn("name", F.array_join(F.slice(parts, F.lit(1), F.col("k")), "."))
    module = heads.join(of(["module"]), "name").groupBy("old_id").agg(F.max(F.struct("k", F.size(parts).alias("n"), "placeholder")).alias("m"))
    short = dotted.withColumn("name", F.substring_index("inner", ".", -1)).join(of(["function", "class"]), "name").select("old_id", F.col("placeholder").alias("last"))
    files = ids.where("kind = 'File'").withColumn("name", F.col("inner")).join(of(["file"]), "name").select("old_id", F.col("placeholder").alias("file"))
    j = ids.join(module, "old_id", "left").join(short, "old_id", "left").join(files, "old_id", "left")
    tail = F.when(F.col("m.k") == F.col("m.n"), F.lit(None)).otherwise(F.coalesce("last", G.short_id(F.substring_index("inner", ".", -1))))
    inner = F.coalesce("file", F.when(F.col("m").isNotNull(), F.concat_ws(".", "m.placeholder", tail)), G.short_id(F.col("old_id")))
    return j.select("old_id", F.concat("kind", F.lit(":"), inner).alias("new_id"))


def g15_rekeyed(spark, sf):
    """All edges with the ids of both ends through the identifier map."""
    return G.rekey(edges(spark, sf), _new_ids(spark, sf)).select("source", "target", "type", "count")


def g16_persist_summaries(spark, sf):
    """Nodes with their summaries appended as versions, and a status per summary."""
    summaries = load(spark, sf, "code_snippets").select("node_id", "snippet_type", "start_line").where("node_id is not null")
    stored = nodes(spark, sf).select("id").distinct()
    joined = summaries.join(stored, summaries["node_id"] == stored["id"], "left")
    return joined.groupBy("node_id", F.when(F.col("id").isNull(), "SKIPPED_NODE_MISSING").otherwise("UPDATED").alias("status")).agg(F.array_join(F.array_sort(F.collect_list(F.coalesce("snippet_type", F.lit("none")))), ",").alias("versions"))


def g8_path_statistics(spark, sf):
    """Distances from a sample of the largest component; the edges are built once for the components and the walks."""
    e = cut(edges(spark, sf).where("type in ('PARENT', 'CLOSED_BY')").select("source", "target"))
    return G.path_statistics(G.components(nodes(spark, sf).where("id is not null"), e), e)


QUERIES = {
    "g1_nodes": g1_nodes,
    "g2_edges": edges,
    "g3_file_edges": g3_file_edges,
    "g4_khop": g4_khop,
    "g5_subgraph": g5_subgraph,
    "g6_hop_distance": g6_hop_distance,
    "g7_components": lambda s, d: G.component_sizes(G.components(nodes(s, d).where("id is not null"), edges(s, d).where("type in ('PARENT', 'CLOSED_BY')"))),
    "g8_path_statistics": g8_path_statistics,
    "g9_subgraph_density": g9_subgraph_density,
    "g11_rerank": g11_rerank,
    "w6_top_scores": lambda s, d: V.top_k(load(s, d, "retrieval_debug").where("node_id is not null").select("node_id", "retrieval_id", F.coalesce("score", F.lit(0.0)).alias("score")), ["node_id"], [F.desc("score"), F.col("retrieval_id")], 5),
    "w7_context_union": w7_context_union,
    "g12_same_file": g12_same_file,
    "g13_provenance": g13_provenance,
    "g14_integrity": lambda s, d: G.integrity(nodes(s, d), edges(s, d)),
    "g15_rekeyed": g15_rekeyed,
    "g16_persist_summaries": g16_persist_summaries,
    "a17_node_types": lambda s, d: G.type_counts(nodes(s, d), "node_type", F.col("attrs")["type"]),
    "a17_edge_types": lambda s, d: G.type_counts(edges(s, d), "type"),
    "a26_weighted_degrees": lambda s, d: G.weighted_degrees(edges(s, d)),
    "a27_degree_stats": lambda s, d: G.degree_stats(nodes(s, d), edges(s, d)),
    "a34_duplicate_ids": lambda s, d: nodes(s, d).groupBy("id").agg(F.count("*").alias("n")).where("n > 1"),
    "j7_stubs": lambda s, d: G.stubs(edges(s, d), nodes(s, d)),
    "j19_dangling": lambda s, d: G.stubs(edges(s, d), nodes(s, d)).groupBy("node_type").agg(F.count("*").alias("n")),
    "so3_adjacency": lambda s, d: G.undirected(edges(s, d)).groupBy("source").agg(F.count("*").alias("neighbours")),
    "w8_top_degree": lambda s, d: G.undirected(edges(s, d)).groupBy(F.col("source").alias("id")).agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "id").limit(15),
    "pj8_node_ids": lambda s, d: load(s, d, "code_entities_full").select("entity_id", entity_id().alias("id"), G.short_id(entity_id()).alias("short_id"), G.module_name(F.col("relpath")).alias("module")),
    "so1_set_operations": lambda s, d: V.set_sizes(nodes(s, d).select("id"), load(s, d, "retrieval_debug").select(F.trim(G.slashed(F.col("neighbor_id"))).alias("id")).where("id <> ''")),
}

_E = lambda body: f"with recursive {EDGES_SQL} {body}"
_UND = "und as (select distinct source, target from (select source, target from e union all select target, source from e) where source <> target)"
_ENT = "case when kind in ('function', 'method') then 'Function' when kind = 'class' then 'Class' when kind = 'module' then 'Module' else 'File' end"
_ENTID = rf"{_ENT} || ':' || replace(regexp_replace(entity_key, '^code_entities:', ''), '\', '/')"
_HOOD = """{n}1 as (select distinct t.id seed, a.target id from targets t join {adj} a on a.source = t.id where a.target <> t.id),
{n}2 as (select distinct h.seed, a.target id from {n}1 h join {adj} a on a.source = h.id where a.target <> h.seed and not exists (select 1 from {n}1 x where x.seed = h.seed and x.id = a.target)),
{n} as (select id, min(d) distance, count(*) seeds from (select seed, id, 1 d from {n}1 union all select seed, id, 2 from {n}2) group by 1)"""

SQL = {
    "g1_nodes": _E(rf""", c as (select *, replace(relpath, '\', '/') p, replace(regexp_replace(regexp_replace(replace(relpath, '\', '/'), '\.py$', ''), '/__init__$', ''), '/', '.') m from code_entities_full), s as (select 'File:' || p id, 'File' node_type, list_last(string_split(p, '/')) label, p path, 0 t from c where relpath is not null
 union all select 'Module:' || m, 'Module', list_last(string_split(m, '.')), p, 1 from c where relpath is not null and ends_with(relpath, '.py')
 union all select {_ENTID}, {_ENT}, name, p, 2 from c where kind in ('function', 'method', 'class')
 union all select 'Commit:' || sha, 'Commit', left(sha, 7), null, 3 from commits_sample union all select 'PR:' || number::varchar, 'PR', '#' || number::varchar, null, 4 from pull_requests
 union all select target, 'Dependency', list_last(string_split(target, ':')), null, 5 from raw where type = 'DEPENDS_ON'
 union all select d, 'Document', list_last(string_split(substr(d, 10), '/')), substr(d, 10), 6 from (select trim(replace(neighbor_id, '\', '/')) d from retrieval_debug) where starts_with(d, 'Document:')
 union all select id, node_type, label, path, 7 from nodes)
select id, node_type, label, path from (select *, row_number() over (partition by id order by t desc, node_type desc nulls last, label desc nulls last, path desc nulls last) r from s where id is not null) where r = 1"""),
    "g2_edges": _E('select source, target, type, "count", provenance from e'),
    "g3_file_edges": _E(""", p as (select id, min(path) path from nodes where path is not null group by 1), b as (select type, s.path source_file, t.path target_file, provenance from raw join p s on s.id = source join p t on t.id = target where type = 'CALLS' and s.path <> t.path union all select type, substr(source, 6), substr(target, 6), provenance from raw where type in ('IMPORTS', 'CALLS_FILE_LEVEL')) select type, source_file, target_file, count(*) as "count", array_to_string(list_sort(list(distinct provenance)), ';') reasons from b group by 1, 2, 3"""),
    "g4_khop": _E(f""", c as (select distinct case when type = 'CALLS' then source else target end as source, case when type = 'CALLS' then target else source end as target from e where type in ('CALLS', 'CALLED_BY')),
r as (select target as source, source as target from c), targets as (select distinct node_id id from target_ast_map where node_id is not null),
{_HOOD.format(n='hc', adj='c')}, {_HOOD.format(n='hr', adj='r')}
select id, distance, seeds, 'callees' side from hc union all select id, distance, seeds, 'callers' from hr"""),
    "g5_subgraph": _E(f""", {_UND}, seeds as (select distinct target id from e where type = 'CLOSED_BY'), ids as (select id from seeds union select u.target from und u join seeds on seeds.id = u.source)
select type, count(*) n, sum("count")::bigint weight from e where source in (select id from ids) and target in (select id from ids) group by 1"""),
    "g6_hop_distance": _E(""", walk as (select distinct 'Commit:' || merge_commit_sha id, 0 d from pull_requests where merge_commit_sha is not null
union select e.target, walk.d + 1 from walk join e on e.source = walk.id and e.type = 'PARENT' where walk.d < 4) select id, min(d) distance from walk group by 1"""),
    "g9_subgraph_density": _E(""", x as (select * from e where type in ('PARENT', 'CLOSED_BY', 'MODIFIED_BY')), n as (select count(*)::double nodes from (select source from x union select target from x)), m as (select count(*)::double edges from x), w as (select nodes, edges, round(edges / (nodes * (nodes - 1)), 10) density, round(2 * edges / nodes, 6) average_degree from n, m)
select 'nodes' metric, nodes as value from w union all select 'edges', edges from w union all select 'density', density from w union all select 'average_degree', average_degree from w union all select 'type ' || type, count(*)::double from x group by 1"""),
    "g11_rerank": """with b as (select node_id, neighbor_id, max(round(case category when 'callers' then 3.0::double when 'callees' then 1.5::double when 'same_file' then 1.0::double else 0.5::double end + coalesce(name_sim, 0) + coalesce(1 / (1 + graph_dist), 0) + 2 * coalesce(emb_sim, 0), 6)) score from retrieval_debug where node_id is not null and neighbor_id <> '' group by 1, 2),
o as (select * from (select *, row_number() over (partition by node_id order by score desc, neighbor_id) r from b) where r <= 8), f as (select node_id from b group by 1 having count(*) < 8),
x as (select distinct b.node_id, o.neighbor_id from b join f using (node_id) join o on o.node_id = b.neighbor_id where o.neighbor_id <> b.node_id), y as (select x.*, round(0.5 + 1 / 3.0, 6)::double score, true expanded from x where not exists (select 1 from b where b.node_id = x.node_id and b.neighbor_id = x.neighbor_id)), z as (select node_id, neighbor_id, score, false expanded from b union all select node_id, neighbor_id, score, expanded from y)
select * from (select *, row_number() over (partition by node_id order by expanded, score desc, neighbor_id) rank from z) where rank <= 8""",
    "g7_components": _E(f""", x as (select * from e where type in ('PARENT', 'CLOSED_BY')), ux as (select distinct source, target from (select source, target from x union all select target, source from x) where source <> target), al as (select id from nodes where id is not null union select source from ux),
rc as (select id, id root from al union select ux.target, rc.root from rc join ux on ux.source = rc.id), cp as (select id, min(root) component from rc group by 1), cs as (select component, count(*) n from cp group by 1) select count(*) components, max(n) largest, round(max(n) / sum(n), 6) largest_share from cs"""),
    "g8_path_statistics": _E(f""", x as (select * from e where type in ('PARENT', 'CLOSED_BY')), ux as (select distinct source, target from (select source, target from x union all select target, source from x) where source <> target), al as (select id from nodes where id is not null union select source from ux),
rc as (select id, id root from al union select ux.target, rc.root from rc join ux on ux.source = rc.id), cp as (select id, min(root) component from rc group by 1), lg as (select component from cp group by 1 order by count(*) desc, component limit 1), sd as (select id seed from cp where component = (select component from lg) order by 1 limit 200),
wk as (select seed, seed id, 0 d from sd union select wk.seed, ux.target, wk.d + 1 from wk join ux on ux.source = wk.id where wk.d < 10), ds as (select seed, id, min(d) d from wk group by 1, 2) select round(avg(d), 4) mean_path, max(d) pseudo_diameter from ds"""),
    "w6_top_scores": "select * from (select node_id, retrieval_id, coalesce(score, 0) score, row_number() over (partition by node_id order by coalesce(score, 0) desc, retrieval_id) rank from retrieval_debug where node_id is not null) where rank <= 5",
    "w7_context_union": """with f as (select node_id, neighbor_id, category, coalesce(score, 0) score, case category when 'callers' then 0 when 'callees' then 1 when 'same_file' then 2 else 3 end priority from retrieval_debug where node_id is not null and neighbor_id <> ''),
d as (select * from (select *, row_number() over (partition by node_id, neighbor_id order by priority, score desc) r from f) where r = 1),
p as (select *, row_number() over (partition by node_id, priority order by score desc, neighbor_id) place from d)
select node_id, neighbor_id, priority, rank from (select *, row_number() over (partition by node_id order by priority, place) rank from p where place <= 10) where rank <= 50""",
    "g12_same_file": r"""with s as (select distinct id, node_type, replace(path, '\', '/') p from nodes where path is not null and id is not null), t as (select distinct node_id target, replace(path, '\', '/') p from target_ast_map where node_id is not null and path is not null),
d as (select id, regexp_replace(p, '/[^/]*$', '') folder, regexp_replace(list_last(string_split(p, '/')), '(?:_[0-9]+)?\.[A-Za-z]+$', '') stem from s where node_type = 'Document'), u as (select target, regexp_replace(p, '/[^/]*$', '') folder, regexp_replace(list_last(string_split(p, '/')), '(?:_[0-9]+)?\.[A-Za-z]+$', '') stem from t)
select distinct target, id, 'same_file' category from t join s using (p) where node_type in ('Function', 'Class') and id <> target union select distinct target, id, 'near_doc' from u join d on u.folder = d.folder or u.stem = d.stem""",
    "g13_provenance": _E(""", p as (select c.sha sha, number, title from (select number, title, unnest(commits) c from pull_requests) where c.sha is not null and number is not null), f as (select sha, number, coalesce(title, '') title, row_number() over (partition by sha order by number, coalesce(title, '')) r from p), n as (select sha, count(distinct number) prs from p group by 1),
q as (select distinct 'Commit:' || sha id, sha, '' modified_by from commits_sample where sha is not null union all select 'Function:' || qualified, first(sha order by author_time, sha), array_to_string(list_sort(list(distinct sha)), ',') from blame group by qualified)
select q.id, q.sha introduced_by_commit, number introduced_by_pr, nullif(title, '') introduced_by_pr_title, coalesce(prs, 0) prs, modified_by from q left join f on f.sha = q.sha and r = 1 left join n on n.sha = q.sha"""),
    "g14_integrity": _E("select 'missing_source' check_name, count(*) n from e where not exists (select 1 from nodes where id = source) union all select 'missing_target', count(*) from e where not exists (select 1 from nodes where id = target) union all select 'duplicate_ids', count(*) from (select id from nodes group by 1 having count(*) > 1)"),
    "g15_rekeyed": _E(rf""", {ROLED_SQL}, ii as (select distinct id old_id, split_part(id, ':', 1) kind, regexp_replace(id, '^[^:]*:', '') i from nodes where id is not null), km as (select name, min(placeholder) p from known where kind = 'module' group by 1), ks as (select name, min(placeholder) p from known where kind in ('function', 'class') group by 1), kf as (select name, min(placeholder) p from known where kind = 'file' group by 1),
mm as (select old_id, p, whole from (select old_id, p, i = name whole, row_number() over (partition by old_id order by length(name) desc) r from ii join km on i = name or starts_with(i, name || '.') where kind in ('Function', 'Class', 'Module')) where r = 1), ls as (select old_id, p last from ii join ks on ks.name = list_last(string_split(i, '.')) where kind in ('Function', 'Class', 'Module')), fs as (select old_id, p file from ii join kf on kf.name = i where kind = 'File'),
m as (select ii.old_id, kind || ':' || coalesce(file, case when mm.p is not null then mm.p || case when whole then '' else '.' || coalesce(last, left(sha1(list_last(string_split(i, '.'))), 8)) end end, left(sha1(ii.old_id), 8)) new_id from ii left join mm on mm.old_id = ii.old_id left join ls on ls.old_id = ii.old_id left join fs on fs.old_id = ii.old_id)
select coalesce(s.new_id, source) source, coalesce(t.new_id, target) target, type, "count" from e left join m s on s.old_id = source left join m t on t.old_id = target"""),
    "g16_persist_summaries": "select node_id, case when n.id is null then 'SKIPPED_NODE_MISSING' else 'UPDATED' end status, array_to_string(list_sort(list(coalesce(snippet_type, 'none'))), ',') versions from code_snippets left join (select distinct id from nodes) n on n.id = node_id where node_id is not null group by 1, 2",
    "a17_node_types": "select coalesce(nullif(node_type, ''), nullif(attrs['type'], ''), 'UNKNOWN') as type, count(*) n from nodes group by 1",
    "a17_edge_types": _E("select type, count(*) n from e group by 1"),
    "a26_weighted_degrees": _E("""select direction, id, degree, rank from (select *, row_number() over (partition by direction order by degree desc, id) rank from (select 'out' direction, source id, sum("count")::bigint degree from e group by 2 union all select 'in', target, sum("count")::bigint from e group by 2)) where rank <= 10"""),
    "a27_degree_stats": _E(f", {_UND}, g as (select source id, count(*) d from und group by 1), a as (select coalesce(d, 0) d from (select distinct id from nodes) n left join g using (id)) select count(*) nodes, min(d) min_degree, max(d) max_degree, round(avg(d), 6) mean_degree, quantile_cont(d, 0.5) median_degree from a"),
    "a34_duplicate_ids": "select id, count(*) n from nodes group by 1 having count(*) > 1",
    "j7_stubs": _E("select id, split_part(id, ':', 1) node_type from (select source id from e union select target from e) where id not in (select id from nodes where id is not null)"),
    "j19_dangling": _E("select split_part(id, ':', 1) node_type, count(*) n from (select source id from e union select target from e) where id not in (select id from nodes where id is not null) group by 1"),
    "so3_adjacency": _E(f", {_UND} select source, count(*) neighbours from und group by 1"),
    "w8_top_degree": _E(f", {_UND} select source id, count(*) degree from und group by 1 order by 2 desc, 1 limit 15"),
    "pj8_node_ids": rf"select entity_id, {_ENTID} id, left(sha1({_ENTID}), 8) short_id, replace(regexp_replace(regexp_replace(replace(relpath, '\', '/'), '\.py$', ''), '/__init__$', ''), '/', '.') module from code_entities_full",
    "so1_set_operations": r"with a as (select distinct id from nodes), b as (select distinct trim(replace(neighbor_id, '\', '/')) id from retrieval_debug where trim(replace(neighbor_id, '\', '/')) <> '') select 'intersection' operation, count(*) n from (select id from a intersect select id from b) union all select 'left_only', count(*) from (select id from a except select id from b) union all select 'right_only', count(*) from (select id from b except select id from a) union all select 'union', count(*) from (select id from a union select id from b)",
}
