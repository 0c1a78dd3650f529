"""Queries of name, path and hash resolution and of the aggregates around them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphmill.operators import graph as G
from graphmill.operators import resolve as V
from graphmill.sources import load
from graphmill.sources.knowledge import ALIASES_SQL, aliases, nodes


def _symbols(spark, sf):
    return nodes(spark, sf).where("qualified_name is not null").select(F.col("qualified_name").alias("qualified"))


def j8_suffix(spark, sf):
    return V.by_suffix(load(spark, sf, "retrieval_debug").select(F.col("label").alias("short")), _symbols(spark, sf))


def j9_mentions(spark, sf):
    """Documents whose base name stands within the base name of a file: three letters bring candidates together, containment decides."""
    stem = lambda c: F.lower(F.regexp_replace(V.basename(F.col(c)), r"(?:_[0-9]+)?\.[A-Za-z]+$", ""))
    docs = nodes(spark, sf).where("node_type = 'Document' and label is not null").select(F.col("id").alias("document"), stem("label").alias("stem")).distinct().where("length(stem) >= 3")
    files = nodes(spark, sf).where("node_type = 'File' and path is not null").select(F.col("id").alias("file"), F.lower(V.basename(F.col("path"))).alias("base")).distinct()
    grams = files.where("length(base) >= 3").select("file", "base", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("base") - 2), lambda i: F.substring(F.col("base"), i, F.lit(3))))).alias("gram"))
    return docs.withColumn("gram", F.substring("stem", 1, 3)).join(grams, "gram").where(F.col("base").contains(F.col("stem"))).select("document", "file")


def j10_commit_pr(spark, sf):
    return V.commits_of_prs(load(spark, sf, "pull_requests"), load(spark, sf, "commits_sample"))


def _spans(spark, sf):
    return load(spark, sf, "code_entities_full").where("relpath is not null and lineno is not null and end_lineno is not null").select(G.slashed(F.col("relpath")).alias("file"), "name", F.col("lineno").alias("first"), F.col("end_lineno").alias("last"))


def j12_enclosing(spark, sf):
    sites = load(spark, sf, "code_snippets").where("path is not null and start_line is not null").select(G.slashed(F.col("path")).alias("file"), F.col("snippet_id").alias("site_id"), F.col("start_line").alias("line"))
    return V.enclosing(sites, _spans(spark, sf)).select("site_id", "name", "width")


def _sites(spark, sf):
    """Listed chains with the module they are listed in."""
    chain = F.trim(G.slashed(F.regexp_replace("neighbor_id", "^(?:Function|Class):", "")))
    listed = load(spark, sf, "retrieval_debug").where("(neighbor_id like 'Function:%' or neighbor_id like 'Class:%')").select(G.module_name(F.col("path")).alias("module"), chain.alias("chain"), "label")
    whole = listed.select("module", "chain")
    return whole.unionByName(listed.select("module", F.substring_index("chain", ".", -2).alias("chain"))).unionByName(listed.select("module", F.col("label").alias("chain"))).where("module is not null and chain <> ''").distinct()


def j13_chain_resolution(spark, sf):
    return V.resolved_chains(_sites(spark, sf), _symbols(spark, sf), aliases(spark, sf))


def j22_older_precedence(spark, sf):
    """The older order: beginnings, the shortest first, then the module, a single short name and aliases last."""
    return V.resolved_chains(_sites(spark, sf), _symbols(spark, sf), aliases(spark, sf), V.OLDER_ORDER)


def j14_longest_prefix(spark, sf):
    modules = nodes(spark, sf).where("node_type = 'Module' and qualified_name is not null").select(F.col("qualified_name").alias("module"), F.coalesce("path", F.lit("")).alias("file"))
    return V.longest_prefix(_symbols(spark, sf).select(F.col("qualified").alias("name")).distinct(), modules)


def j18_author_hints(spark, sf):
    """Authors of pull request commits by the first seven characters of the hash, as distinct authors per request."""
    want = load(spark, sf, "pull_requests").select("number", F.explode("commits").alias("c")).select("number", F.substring("c.sha", 1, 7).alias("s7")).where("s7 is not null").distinct()
    have = load(spark, sf, "commits_sample").where("author_name is not null").select(F.substring("sha", 1, 7).alias("s7"), "author_name").distinct()
    return want.join(have, "s7").groupBy("number").agg(F.count_distinct("author_name").alias("authors"), F.min("author_name").alias("first_author"))


def g10_target_resolution(spark, sf):
    """The three best entities for each mapped target by path and name points."""
    targets = load(spark, sf, "target_ast_map").where("path is not null").select(F.col("map_id").alias("target_id"), "path", F.coalesce(F.col("chosen_neighbor.label"), F.lit("")).alias("name"))
    entities = load(spark, sf, "code_entities_full").where("relpath is not null").select("entity_id", F.col("relpath").alias("path"), F.coalesce("name", F.lit("")).alias("name"), F.col("lineno").alias("first"), F.col("end_lineno").alias("last"))
    return V.by_path_suffix(targets, entities)


def g10_best_of_all(spark, sf):
    """The three best of all entities for each mapped target."""
    targets = load(spark, sf, "target_ast_map").select(F.col("map_id").alias("target_id"), "path", F.col("chosen_neighbor.label").alias("name"))
    entities = load(spark, sf, "code_entities_full").select("entity_id", F.col("relpath").alias("path"), "name", "sig", F.col("lineno").alias("first"), F.col("end_lineno").alias("last"))
    return V.best_entities(targets, entities)


def j23_attach_spans(spark, sf):
    """Snippets with the line span of their entity by file and name; the first definition wins."""
    spans = _spans(spark, sf).groupBy("file", "name").agg(F.min(F.struct("first", "last")).alias("s"))
    want = load(spark, sf, "code_snippets").where("path is not null and node_id is not null").select("snippet_id", G.slashed(F.col("path")).alias("file"), F.substring_index("node_id", ".", -1).alias("name"))
    return want.join(spans, ["file", "name"]).select("snippet_id", F.col("s.first").alias("first_line"), F.col("s.last").alias("last_line"))


def a29_location_votes(spark, sf):
    calls = load(spark, sf, "retrieval_debug").where("label is not null and path is not null").select(F.col("label").alias("name"), G.slashed(F.col("path")).alias("file"))
    return V.vote(calls)


def w9_dominance(spark, sf):
    """Candidates that lead the second by at least five (scores times ten)."""
    best = load(spark, sf, "retrieval_debug").where("node_id is not null and neighbor_id <> '' and score is not null").groupBy("node_id", "neighbor_id").agg(F.round(F.max("score") * 10, 4).alias("score"))
    own = Window.partitionBy("node_id").orderBy(F.desc("score"), "neighbor_id")
    # the two best per node are enough, and Spark drops the rest before the shuffle
    two = V.top_k(best, ["node_id"], [F.desc("score"), F.col("neighbor_id")], 2)
    led = two.withColumn("second", F.lead("score").over(own)).where("rank = 1 and (second is null or score - second >= 5)")
    return led.select("node_id", "neighbor_id", "score")


def w10_second_newest(spark, sf):
    ranked = V.top_k(load(spark, sf, "code_entities_full").where("entity_key is not null and indexed_at is not null").select("entity_key", "entity_id", "indexed_at"), ["entity_key"], [F.desc("indexed_at"), F.col("entity_id")], 2)
    return ranked.where("rank = 2").select("entity_key", "entity_id")


def w13_definition_end(spark, sf):
    """The line before the next definition of the file, else the last line of any."""
    rows = _spans(spark, sf).select("file", "first", "last").groupBy("file", "first").agg(F.max("last").alias("last"))
    own = Window.partitionBy("file").orderBy("first")
    whole = rows.groupBy("file").agg(F.max("last").alias("n_lines"))
    return rows.withColumn("next", F.lead("first").over(own)).join(whole, "file").select("file", "first", F.coalesce(F.col("next") - 1, F.col("n_lines")).alias("end_line"))


def a18_coverage(spark, sf):
    """Percentage of source items that the graph holds, per kind; may exceed 100 as the two are counted apart."""
    stored = nodes(spark, sf)
    held = stored.where("node_type in ('Commit', 'PR', 'Function', 'File')").groupBy("node_type").agg(F.count_distinct("id").alias("held"))
    n = lambda df, col, t: df.agg(F.count_distinct(col).alias("total")).select(F.lit(t).alias("node_type"), "total")
    code = load(spark, sf, "code_entities_full")
    totals = n(load(spark, sf, "commits_sample"), "sha", "Commit").unionByName(n(load(spark, sf, "pull_requests"), "number", "PR")).unionByName(n(code.where("kind in ('function', 'method')"), "entity_key", "Function")).unionByName(n(code, "relpath", "File"))
    return totals.join(held, "node_type", "left").select("node_type", "total", F.coalesce("held", F.lit(0)).alias("held"), F.round(F.try_divide(100.0 * F.coalesce("held", F.lit(0)), F.col("total")), 4).alias("percentage"))


def _pr_commits(spark, sf):
    return load(spark, sf, "pull_requests").select("number", "created_at", F.explode("commits").alias("c")).select("number", "created_at", F.col("c.sha").alias("sha"), F.col("c.message_head").alias("message")).where("sha is not null")


def a25_latest_commit(spark, sf):
    """The latest commit per author, by date then hash; without dates the least hash."""
    c = load(spark, sf, "commits_sample").where("author_email is not null")
    return c.groupBy("author_email").agg(F.max_by("sha", F.struct("author_date", "sha")).alias("dated"), F.min("sha").alias("least"), F.max("author_date").alias("latest")).select("author_email", F.when(F.col("latest").isNotNull(), F.col("dated")).otherwise(F.col("least")).alias("sha"))


def s24_unmapped_commits(spark, sf):
    """Commits with their pull requests; an empty list where none is known."""
    known = _pr_commits(spark, sf).groupBy("sha").agg(F.array_join(F.transform(F.array_sort(F.collect_set("number")), lambda x: x.cast("string")), ",").alias("prs"))
    return load(spark, sf, "commits_sample").select("sha").distinct().join(known, "sha", "left").select("sha", F.coalesce("prs", F.lit("")).alias("prs"))


QUERIES = {
    "j8_suffix": j8_suffix,
    "j9_mentions": j9_mentions,
    "j10_commit_pr": j10_commit_pr,
    "j12_enclosing": j12_enclosing,
    "j13_chain_resolution": j13_chain_resolution,
    "j14_longest_prefix": j14_longest_prefix,
    "j18_author_hints": j18_author_hints,
    "j22_older_precedence": j22_older_precedence,
    "j23_attach_spans": j23_attach_spans,
    "g10_target_resolution": g10_target_resolution,
    "g10_best_of_all": g10_best_of_all,
    "a29_location_votes": a29_location_votes,
    "w9_dominance": w9_dominance,
    "w10_second_newest": w10_second_newest,
    "w13_definition_end": w13_definition_end,
    "a18_coverage": a18_coverage,
    "a25_latest_commit": a25_latest_commit,
    "a28_symbols_per_file": lambda s, d: load(s, d, "code_entities_full").groupBy(G.slashed(F.col("relpath")).alias("file")).agg(F.count("*").alias("n")),
    "a35_pr_occurrences": lambda s, d: _pr_commits(s, d).groupBy("number").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "number").limit(10),
    "s24_unmapped_commits": s24_unmapped_commits,
}

_S = lambda c: f"replace({c}, '\\', '/')"
_BASE = lambda c: f"list_last(string_split({_S(c)}, '/'))"
_LAST = lambda c, n: f"array_to_string(list_slice(string_split({c}, '.'), -{n}, -1), '.')"
_TWO = lambda c: f"array_to_string(list_slice(string_split({c}, '/'), -2, -1), '/')"
_PRC = "pc as (select number, created_at, c.sha sha, c.message_head message from (select number, created_at, unnest(commits) c from pull_requests) where c.sha is not null)"
_SPANS = f"spans as (select {_S('relpath')} file, name, lineno as first, end_lineno as last from code_entities_full where relpath is not null and lineno is not null and end_lineno is not null)"
_SITES = rf"""sym as (select distinct qualified_name q from nodes where qualified_name is not null), rl as (select replace(regexp_replace(regexp_replace({_S('path')}, '\.py$', ''), '/__init__$', ''), '/', '.') as module, trim({_S("regexp_replace(neighbor_id, '^(?:Function|Class):', '')")}) chain, label from retrieval_debug where neighbor_id like 'Function:%' or neighbor_id like 'Class:%'),
st as (select distinct module, chain, string_split(chain, '.') p from (select module, chain from rl union select module, {_LAST('chain', 2)} from rl union select module, label from rl) where module is not null and chain <> '')"""
_HEADS = "hd as (select module, chain, k, array_to_string(list_slice(p, 1, k), '.') q from (select *, unnest(generate_series(1, len(p))) k from st)), hk as (select hd.* from hd join sym using (q))"
_EXP = "xp as (select module, chain, k, case when k = 0 then target else target || '.' || array_to_string(list_slice(p, 2, k + 1), '.') end q from (select st.*, target, unnest(generate_series(0, len(p) - 1)) k from st join al on al.module = st.module and al.alias = p[1])), xk as (select xp.* from xp join sym using (q))"
_BY = {
    "direct": "select module, chain, q, 'direct' strategy from st join sym on q = chain",
    "module_scoped": "select module, chain, q, 'module_scoped' from st join sym on q = module || '.' || chain where len(p) = 1",
    "alias": "select module, chain, q, 'alias' from (select *, row_number() over (partition by module, chain order by k desc, q desc) r from xk where k > 0 or not contains(chain, '.')) where r = 1",
    "alias_whole": "select module, chain, q, 'alias_whole' from xk where k = 0",
    "progressive": "select module, chain, q, 'progressive' from (select *, row_number() over (partition by module, chain order by k desc) r from hk) where r = 1",
    "shortest": "select module, chain, q, 'shortest' from (select *, row_number() over (partition by module, chain order by k) r from hk) where r = 1",
    "class_method": "select module, chain, q, 'class_method' from st join sym on q = module || '.' || chain where len(p) = 2",
    "class_method_global": f"select module, chain, q, 'class_method_global' from st join sym on {_LAST('q', 2)} = chain where len(p) = 2 and q <> chain",
    "short": f"select module, chain, q, 'short' from st join sym on {_LAST('q', 1)} = {_LAST('chain', 1)}",
    "short_single": f"select module, chain, q, 'short' from st join sym on {_LAST('q', 1)} = chain where len(p) = 1",
}


def _resolved(order) -> str:
    each = " union all ".join(f"select module, chain, q, strategy, {i} pr from ({_BY[n].replace(chr(39) + n + chr(39), chr(39) + n + chr(39) + ' strategy', 1) if n not in ('direct', 'short_single', 'short') else _BY[n].replace(chr(39) + 'short' + chr(39), chr(39) + 'short' + chr(39) + ' strategy', 1)})" for i, n in enumerate(order))
    return f"with {_SITES}, {ALIASES_SQL}, {_HEADS}, {_EXP}, cd as ({each}), bs as (select *, row_number() over (partition by module, chain order by pr, q) r from cd) select st.module, st.chain, q qualified, coalesce(strategy, 'unresolved') strategy from st left join bs on bs.module = st.module and bs.chain = st.chain and r = 1"


SQL = {
    "j8_suffix": f"""with n as (select distinct label short from retrieval_debug where label <> ''), s as (select distinct qualified_name q from nodes where qualified_name is not null),
c as (select short, q, 'dotted' strategy, 0 p from n join s on {_LAST('q', 1)} = short union all select short, q, 'bare', 1 from n join s on right(short, 3) = right(q, 3) and ends_with(q, short))
select short, q qualified, strategy from (select *, row_number() over (partition by short order by p, q) r from c) where r = 1""",
    "j9_mentions": rf"""with d as (select distinct id document, lower(regexp_replace({_BASE('label')}, '(?:_[0-9]+)?\.[A-Za-z]+$', '')) stem from nodes where node_type = 'Document' and label is not null), f as (select distinct id file, lower({_BASE('path')}) base from nodes where node_type = 'File' and path is not null)
select document, file from d, f where length(stem) >= 3 and contains(base, stem)""",
    "j10_commit_pr": """with w as (select distinct number, merge_commit_sha want from pull_requests where merge_commit_sha <> '' and number is not null), h as (select distinct sha from commits_sample where sha is not null),
li as (select distinct number, left(lower(c.sha), 7) s7 from (select number, unnest(commits) c from pull_requests) where c.sha <> '' and number is not null),
c as (select number, sha, 'exact' strategy, 0 p from w join h on want = sha union all select number, sha, 'lower', 1 from w join h on lower(want) = lower(sha) union all select number, sha, 'prefix7', 2 from w join h on left(lower(want), 7) = left(lower(sha), 7)
 union all select number, sha, 'contains', 3 from w join h on contains(lower(sha), left(lower(want), 7)) union all select number, sha, 'listed', 4 from li join h on left(lower(sha), 7) = s7)
select number, sha, strategy from (select *, row_number() over (partition by number order by p, sha) r from c) where r = 1""",
    "j12_enclosing": f"""with {_SPANS}, t as (select {_S('path')} file, snippet_id site_id, start_line line from code_snippets where path is not null and start_line is not null),
c as (select site_id, name, last - first width, row_number() over (partition by site_id order by last - first, first, name nulls first) r from t join spans using (file) where line between first and last)
select t.site_id, name, width from t left join c on c.site_id = t.site_id and r = 1""",
    "j13_chain_resolution": _resolved(V.CHAIN_ORDER),
    "j22_older_precedence": _resolved(V.OLDER_ORDER),
    "j14_longest_prefix": "with n as (select distinct qualified_name as name from nodes where qualified_name is not null), m as (select distinct qualified_name module, coalesce(path, '') file from nodes where node_type = 'Module' and qualified_name is not null) select name, module, file from (select *, row_number() over (partition by name order by length(module) desc, file desc) r from n join m on name = module or starts_with(name, module || '.')) where r = 1",
    "j18_author_hints": f"with {_PRC} select number, count(distinct author_name) authors, min(author_name) first_author from (select distinct number, left(sha, 7) s7 from pc) join (select distinct left(sha, 7) s7, author_name from commits_sample where author_name is not null) using (s7) group by 1",
    "j23_attach_spans": f"with {_SPANS}, f as (select file, name, first, last, row_number() over (partition by file, name order by first, last) r from spans) select snippet_id, first first_line, last last_line from (select snippet_id, {_S('path')} file, {_LAST('node_id', 1)} as name from code_snippets where path is not null and node_id is not null) join f using (file, name) where r = 1",
    "g10_target_resolution": f"""with t as (select map_id target_id, {_S('path')} w, coalesce(chosen_neighbor.label, '') wn, {_BASE('path')} base from target_ast_map where path is not null), e as (select entity_id, {_S('relpath')} h, coalesce(name, '') hn, lineno, end_lineno, {_BASE('relpath')} base from code_entities_full where relpath is not null),
s as (select target_id, entity_id, round((case when ends_with(h, w) then 5.0 when contains(h, w) then 2.0 else 0.0 end)::double + (case when {_TWO('h')} = {_TWO('w')} then 3.5 else 0.0 end)::double + (case when hn = wn then 3.0 when contains(hn, wn) then 1.5 else 0.0 end)::double + (case when lineno is not null and end_lineno is not null then 0.5 else 0.0 end)::double + (case when ends_with(h, '.py') then 0.1 else 0.0 end)::double, 2) score from t join e using (base))
select * from (select *, row_number() over (partition by target_id order by score desc, entity_id) rank from s) where rank <= 3""",
    "g10_best_of_all": f"""with t as (select map_id target_id, lower(coalesce({_S('path')}, '')) w, lower(coalesce(chosen_neighbor.label, '')) wn from target_ast_map), q as (select distinct w, wn, regexp_extract(w, '([^/]+)/*$', 1) base from t),
e as (select entity_id, lower(coalesce({_S('relpath')}, '')) h, lower(coalesce(name, '')) hn, lower(coalesce(sig, '')) hs, case when lineno is not null or end_lineno is not null then 0.5 else 0 end::double + case when ends_with(lower(coalesce({_S('relpath')}, '')), '.py') then 0.1 else 0 end::double own from code_entities_full),
p as (select w, wn, entity_id, round(own + case when w <> '' and ends_with(h, w) then 5.0 else 0 end::double + case when w <> '' and contains(h, w) then 2.0 else 0 end::double + case when w <> '' and {_TWO('h')} = {_TWO('w')} then 3.5 else 0 end::double + case when wn <> '' and hn = wn then 3.0 when wn <> '' and contains(hn, wn) then 1.5 else 0 end::double + case when wn <> '' and hs = wn then 3.0 when wn <> '' and contains(hs, wn) then 1.5 else 0 end::double, 2) score, base <> '' and contains(h, base) relaxed from q, e),
r as (select *, row_number() over (partition by w, wn order by score desc, case when score > 0 then true else relaxed end desc, entity_id) rank from p), m as (select *, max(score) over (partition by w, wn) most from r where rank <= 3)
select target_id, entity_id, score, rank from t join m using (w, wn) where score > 0 or most = 0""",
    "a29_location_votes": rf"""with c as (select label as name, {_S('path')} file from retrieval_debug where label is not null and path is not null), f as (select name, file, count(*) v from c group by 1, 2),
d as (select name, case when contains(file, '/') then regexp_replace(file, '/[^/]*$', '') else '' end folder, sum(v) v from f group by 1, 2),
lf as (select name, min(file) place from f join (select name, max(v) v from f group by 1) using (name, v) where v >= 2 group by 1 having count(*) = 1), ld as (select name, min(folder) place from d join (select name, max(v) v from d group by 1) using (name, v) where v >= 2 group by 1 having count(*) = 1)
select n.name, coalesce(lf.place, ld.place) place, case when lf.name is not null then 'file_majority' when ld.name is not null then 'directory_consensus' else 'ambiguous' end status from (select distinct name from c) n left join lf using (name) left join ld using (name)""",
    "w9_dominance": "with b as (select node_id, neighbor_id, round(max(score) * 10, 4) score from retrieval_debug where node_id is not null and neighbor_id <> '' and score is not null group by 1, 2), r as (select *, lead(score) over w s2, row_number() over w r from b window w as (partition by node_id order by score desc, neighbor_id)) select node_id, neighbor_id, score from r where r = 1 and (s2 is null or score - s2 >= 5)",
    "w10_second_newest": "select entity_key, entity_id from (select *, row_number() over (partition by entity_key order by indexed_at desc, entity_id) r from code_entities_full where entity_key is not null and indexed_at is not null) where r = 2",
    "w13_definition_end": f"with {_SPANS}, s as (select distinct file, first from spans) select file, first, coalesce(lead(first) over (partition by file order by first) - 1, (select max(last) from spans x where x.file = s.file)) end_line from s",
    "a18_coverage": "with h as (select node_type, count(distinct id) held from nodes group by 1), t as (select 'Commit' node_type, count(distinct sha) total from commits_sample union all select 'PR', count(distinct number) from pull_requests union all select 'Function', count(distinct entity_key) from code_entities_full where kind in ('function', 'method') union all select 'File', count(distinct relpath) from code_entities_full) select node_type, total, coalesce(held, 0) held, round(100.0 * coalesce(held, 0) / nullif(total, 0), 4) percentage from t left join h using (node_type)",
    "a25_latest_commit": "select author_email, case when max(author_date) is not null then (list(sha order by author_date desc nulls last, sha desc))[1] else min(sha) end sha from commits_sample where author_email is not null group by 1",
    "a28_symbols_per_file": f"select {_S('relpath')} file, count(*) n from code_entities_full group by 1",
    "a35_pr_occurrences": f"with {_PRC} select number, count(*) n from pc group by 1 order by 2 desc, 1 limit 10",
    "s24_unmapped_commits": f"with {_PRC} select c.sha, coalesce(prs, '') prs from (select distinct sha from commits_sample) c left join (select sha, array_to_string(list_sort(list(distinct number)), ',') prs from pc group by 1) p on p.sha = c.sha",
}
