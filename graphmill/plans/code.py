"""Queries of code tables and structural anonymity."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphmill.operators import anonymity as A
from graphmill.operators import code as C
from graphmill.operators import graph as G
from graphmill.operators import privacy as P
from graphmill.session import bound_batches, cut
from graphmill.sources import load
from graphmill.sources.knowledge import nodes, raw_edges


def _sources(spark, sf):
    bound_batches(spark)
    return load(spark, sf, "code_entities_full").where("source is not null and coalesce(kind, '') <> 'config'")


def u1_definitions(spark, sf):
    return C.rows_of(_sources(spark, sf), "entity_id", "source", C.definitions, "qualified string, kind string, lineno int, end_lineno int, signature string, doc string")


def u2_trees(spark, sf):
    """The syntax tree of each source as JSON, with its size and number of root statements."""
    trees = C.rows_of(_sources(spark, sf), "entity_id", "source", lambda t: iter([(C.tree_json(t),)]), "tree string")
    return trees.where("tree is not null").select("entity_id", "tree", F.length("tree").alias("size"), F.json_array_length(F.get_json_object("tree", "$.body")).alias("statements"))


def u3_symbols(spark, sf):
    """Qualified symbols with module and file."""
    files = _sources(spark, sf).where("kind = 'module' and relpath is not null").select("entity_id", G.module_name(F.col("relpath")).alias("module"), G.slashed(F.col("relpath")).alias("file"))
    return u1_definitions(spark, sf).join(files, "entity_id").select(F.concat_ws(".", "module", "qualified").alias("symbol"), "kind", "module", "file", "lineno")


def u5_calls(spark, sf):
    return C.rows_of(_sources(spark, sf), "entity_id", "source", C.calls, "lineno int, chain string").groupBy("entity_id", "chain").agg(F.count("*").alias("n"), F.min("lineno").alias("first_line"))


def _functions(spark, sf):
    return nodes(spark, sf).where("node_type = 'Function' and path is not null").select(F.col("path").alias("module"), F.col("id").alias("name")).distinct()


def _calls(spark, sf):
    return raw_edges(spark, sf).where("type = 'CALLS'").select("source", "target")


def _sig(spark, sf):
    return A.signatures(_functions(spark, sf), _calls(spark, sf))


def _roles(spark, sf):
    """(module, name, role) of all functions."""
    f = _functions(spark, sf).withColumn("short", F.regexp_replace(F.substring_index("name", ":", -1), r"^.*\.", ""))
    return f.join(P.role_of(f.select("short"), "short"), "short").select("module", "name", "role")


def _module_roles(spark, sf):
    """The role of most functions of a module; the lesser name on a tie."""
    per = _roles(spark, sf).groupBy("module", "role").agg(F.count("*").alias("n"))
    return per.groupBy("module").agg(F.min(F.struct((-F.col("n")).alias("n"), "role"))["role"].alias("role"))


def _grown(spark, sf):
    return A.diversity(A.augmented(cut(_sig(spark, sf))), _module_roles(spark, sf))


def k4_verdict(spark, sf):
    """Before and after augmentation: class sizes, re-identification and what was added."""
    sig = cut(_sig(spark, sf))
    grown = A.augmented(sig)
    before = A.verdict(A.classes(sig)).select(F.lit("before").alias("graph"), "k_min", "k_avg", "k_max", "p_reid", F.lit(0).cast("long").alias("added_functions"), F.lit(0).cast("long").alias("added_calls"), F.lit(0.0).alias("node_overhead"), F.lit(0.0).alias("edge_overhead"))
    return before.unionByName(A.overheads(sig, grown).withColumn("graph", F.lit("after")))


def k5_utility(spark, sf):
    """Nine questions to the graph before and after augmentation: call pairs, roles of modules, files of at least three functions, and the functions of six roles, to which synthetic functions of the module's role (in classes of one role: of the next) are added."""
    real = cut(_roles(spark, sf))
    grown = cut(_grown(spark, sf))
    order = list(P.ROLES)
    following = F.create_map(*(F.lit(x) for i, r in enumerate(order) for x in (r, order[(i + 1) % len(order)])), F.lit("utility"), F.lit(order[0]))
    made = grown.where("added_functions > 0").select("module", F.when(F.col("swapped"), F.element_at(following, F.col("role"))).otherwise(F.col("role")).alias("role"), F.explode(F.sequence(F.lit(1), F.col("added_functions").cast("int"))).alias("i")).select("module", F.concat_ws(":", F.lit("syn"), "module", F.col("i").cast("string")).alias("name"), "role")
    after = real.unionByName(made)
    calls = _calls(spark, sf).select(F.concat_ws(" ", "source", "target").alias("id"))
    answers = lambda f: {"caller_callee_pairs": calls, "module_roles": _module_roles(spark, sf).select(F.concat_ws(" ", "module", "role").alias("id")), "productive_files": f.groupBy("module").agg(F.count("*").alias("n")).where("n >= 3").select(F.col("module").alias("id"))} | {f"role_{r}": f.where(F.col("role") == r).select(F.col("name").alias("id")) for r in order}
    return A.query_jaccard(answers(real), answers(after))


QUERIES = {
    "u1_definitions": u1_definitions,
    "u2_trees": u2_trees,
    "u3_symbols": u3_symbols,
    "u4_imports": lambda s, d: C.rows_of(_sources(s, d), "entity_id", "source", C.imports, "alias string, target string, lineno int"),
    "u5_calls": u5_calls,
    "u6_structure": lambda s, d: C.rows_of(_sources(s, d), "entity_id", "source", C.structure, "parameters string, calls string, control string, literals int"),
    "u11_definition_lines": lambda s, d: C.definition_lines(load(s, d, "code_entities_full").where("source is not null"), "entity_id", "source"),
    "k1_signatures": _sig,
    "k2_classes": lambda s, d: A.classes(_sig(s, d)),
    "k3_augmentation": lambda s, d: _grown(s, d),
    "k4_verdict": k4_verdict,
    "k5_utility": k5_utility,
}

_SIG = r"""
f as (select distinct path as module, id as name from nodes where node_type = 'Function' and path is not null),
c as (select distinct node_id as source, trim(replace(neighbor_id, '\', '/')) target from retrieval_debug where category = 'callees' and node_id is not null and trim(replace(neighbor_id, '\', '/')) <> ''),
kn as (select c.*, s.module sm, t.module tm from c left join f s on s.name = c.source left join f t on t.name = c.target),
o as (select sm as module, sum((sm is not distinct from tm)::int)::bigint internal, sum((sm is distinct from tm)::int)::bigint ext_out from kn where sm is not null group by 1),
i as (select tm as module, count(*) ext_in from kn where tm is not null and sm is distinct from tm group by 1),
od as (select sm as module, source as name, count(*) od from kn where sm = tm group by 1, 2), ind as (select tm as module, target as name, count(*) ind from kn where sm = tm group by 1, 2),
d as (select f.*, coalesce(od, 0) od, coalesce(ind, 0) ind from f left join od using (module, name) left join ind using (module, name)),
m as (select module, count(*) n_funcs, array_to_string(list_sort(list(od)), ',') degrees, sum(od * ind)::bigint chains, sum(od * (od - 1) // 2)::bigint fan_out, sum(ind * (ind - 1) // 2)::bigint fan_in from d group by 1),
sig as (select m.*, coalesce(internal, 0) internal, coalesce(ext_out, 0) ext_out, coalesce(ext_in, 0) ext_in from m left join o using (module) left join i using (module)),
cl as (select concat_ws('|', n_funcs, internal, ext_out, ext_in, degrees, chains, fan_out, fan_in) signature, count(*) size, count(*) < 3 deficient from sig group by 1)
"""
_RV = ", ".join(f"('{w}', '{r}', {i})" for i, (r, ws) in enumerate(P.ROLES.items()) for w in ws)
_ROLES = rf"""fs as (select module, name, regexp_replace(list_last(string_split(name, ':')), '^.*\.', '') short from f), dn as (select distinct short as name from fs), kw(word, role, ro) as (values {_RV}), wd as (select name, unnest(ws) word, generate_subscripts(ws, 1) pos from (select name, regexp_split_to_array(lower(regexp_replace(name, '([a-z0-9])([A-Z])', '\1_\2', 'g')), '[_. ]+') ws from dn)),
ht as (select name, role, ro, count(*) n, min(pos) fp from wd join kw using (word) group by 1, 2, 3), br as (select name, role, row_number() over (partition by name order by n desc, fp, ro) r from ht), fr as (select fs.module, fs.name, coalesce(role, 'utility') role from fs left join br on br.name = fs.short and r = 1),
mr as (select module, role from (select module, role, row_number() over (partition by module order by count(*) desc, role) r from fr group by 1, 2) where r = 1)"""
_NUM = A.NUMBERS
_GROWN = f"""sz as (select *, concat_ws('|', {', '.join(A.SIGNATURE)}) g, count(*) over (partition by concat_ws('|', {', '.join(A.SIGNATURE)})) size from sig), po as (select * from sz where size < 3), pn as (select *, row_number() over (order by {', '.join(_NUM)}, degrees, module) n, count(*) over () total from po), pb as (select * exclude (size), least((n - 1) // 3, greatest(total // 3 - 1, 0)) bucket from pn),
gt as (select bucket, count(*) size, {', '.join(f'max({c}) g_{c}' for c in _NUM)} from pb group by 1), dg as (select bucket, pos, max(d) d from (select bucket, unnest(l) d, generate_subscripts(l, 1) pos from (select bucket, list_reverse(list_transform(string_split(degrees, ','), lambda x: x::int)) l from pb)) group by 1, 2), gd as (select bucket, array_to_string(list(d order by pos), ',') g_degrees from dg group by 1),
gr as (select module, bucket, gt.size, concat_ws('|', {', '.join('g_' + c for c in A.SIGNATURE)}) goal, g_n_funcs - n_funcs added_functions, (g_internal - internal) + (g_ext_out - ext_out) + (g_ext_in - ext_in) added_calls from pb join gt using (bucket) join gd using (bucket) union all select module, null, size, g, 0, 0 from sz where size >= 3)"""
_NEXT = "case role " + " ".join(f"when '{r}' then '{list(P.ROLES)[(i + 1) % len(P.ROLES)]}'" for i, r in enumerate(P.ROLES)) + f" else '{list(P.ROLES)[0]}' end"
_DIV = f"{_GROWN}, {_ROLES}, go as (select gr.*, coalesce(role, 'utility') role from gr left join mr using (module)), dv as (select *, added_functions + added_calls distance, (select count(distinct role) from go x where x.goal = go.goal) roles from go), dd as (select *, roles < 2 and bucket is not null swapped from dv)"

SQL = {
    "u11_definition_lines": r"with l as (select entity_id, unnest(l) as row, generate_subscripts(l, 1) line from (select entity_id, string_split(source, chr(10)) l from code_entities_full where source is not null)) select entity_id, line, regexp_extract(row, '^\s*(?:async )?def ([A-Za-z_][A-Za-z0-9_]*)', 1) as name from l where regexp_matches(row, '^\s*(?:async )?def [A-Za-z_]')",
    "k1_signatures": f"with {_SIG} select * from sig",
    "k2_classes": f"with {_SIG} select * from cl",
    "k3_augmentation": f"with {_SIG}, {_DIV} select module, bucket, size, goal, added_functions, added_calls, distance, role, roles, swapped from dd",
    "k4_verdict": f"with {_SIG}, {_GROWN}, ac as (select goal, count(*) size from gr group by 1), tt as (select (select sum(n_funcs) from sig) f, (select sum(internal + ext_out + ext_in) from sig) c, (select sum(added_functions) from gr)::bigint af, (select sum(added_calls) from gr)::bigint ac) select 'before' graph, min(size) k_min, round(avg(size), 4) k_avg, max(size) k_max, round(1 / min(size), 6) p_reid, 0 added_functions, 0 added_calls, 0.0::double node_overhead, 0.0::double edge_overhead from cl union all select 'after', k1, k2, k3, k4, af, ac, round(af / f, 6), round(ac / c, 6) from (select min(size) k1, round(avg(size), 4) k2, max(size) k3, round(1 / min(size), 6) k4 from ac), tt",
    "k5_utility": f"with {_SIG}, {_DIV}, mk as (select case when swapped then {_NEXT} else role end role, module, 'syn:' || module || ':' || unnest(generate_series(1, added_functions))::varchar as name from dd where added_functions > 0), af as (select module, name, role from fr union all select module, name, role from mk), pf as (select module, count(*) n from fr group by 1 having count(*) >= 3), pa as (select module, count(*) n from af group by 1 having count(*) >= 3) select 'caller_callee_pairs' query, 1.0::double jaccard union all select 'module_roles', 1.0 union all select 'productive_files', round(coalesce((select count(*) from pf) / nullif((select count(*) from pa), 0), 1), 6) " + " ".join(f"union all select 'role_{r}', round(coalesce((select count(distinct name) from fr where role = '{r}') / nullif((select count(distinct name) from af where role = '{r}'), 0), 1), 6)" for r in P.ROLES),
}
