"""Queries of commit maps, their repair, and of locations that are filled from what else is known."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphmill.operators import graph as G
from graphmill.operators import resolve as V
from graphmill.session import cut
from graphmill.sources import load
from graphmill.sources.knowledge import BLAME_SQL, EDGES_SQL, blame, nodes, raw_edges


def _summary(spark, sf):
    """Lines of each function by commit."""
    return blame(spark, sf).groupBy("qualified", "sha").agg(F.sum("lines").alias("lines"), F.min("author").alias("author"), F.min("mail").alias("mail"), F.max("author_time").alias("author_time"), F.min("summary").alias("summary"))


def a23_top_commit(spark, sf):
    """The commit of most lines per function (the least hash on a tie), and the latest one, by lines where there is no time."""
    s = _summary(spark, sf)
    by_lines = F.min(F.struct((-F.col("lines")).alias("n"), "sha"))["sha"]
    by_time = F.max_by("sha", F.struct("author_time", "lines", "sha"))
    return s.groupBy("qualified").agg(by_lines.alias("top"), by_time.alias("latest"))


def _functions(spark, sf):
    """Function nodes once each."""
    n = nodes(spark, sf).where("node_type = 'Function' and id is not null and qualified_name is not null")
    return n.groupBy("id").agg(F.min("qualified_name").alias("qualified"), F.min("path").alias("path"), F.min("lineno").alias("lineno"))


def _top(spark, sf):
    return cut(_summary(spark, sf).groupBy("qualified").agg(F.max(F.struct("lines", "author_time", "sha"))["sha"].alias("sha")))


def j11_mapped_nodes(spark, sf):
    """Function nodes and the commit of the blame map: by qualified name, by node id, by an ending equal to the short name, by a key that contains it."""
    top = _top(spark, sf)
    n = cut(_functions(spark, sf).select("id", "qualified").withColumn("short", F.substring_index("qualified", ".", -1)))
    exact = n.join(top, "qualified").select("id", F.col("qualified").alias("key"), "sha", F.lit("exact_qname").alias("strategy"))
    named = n.join(top.withColumnRenamed("qualified", "key"), F.col("id") == F.concat(F.lit("Function:"), F.col("key"))).select("id", "key", "sha", F.lit("exact_nodeid").alias("strategy"))
    keys = top.withColumnRenamed("qualified", "key")
    suffix = n.join(keys.withColumn("short", F.substring_index("key", ".", -1)), "short").select("id", "key", "sha", F.lit("suffix").alias("strategy"))
    open_ = cut(n.join(exact.unionByName(named).unionByName(suffix).select("id").distinct(), "id", "left_anti"))
    inside = V.contained(open_.select(F.col("short").alias("part")).distinct(), keys.select(F.col("key").alias("whole")))
    contains = open_.join(inside, F.col("short") == F.col("part")).join(keys, F.col("whole") == F.col("key")).select("id", "key", "sha", F.lit("contains").alias("strategy"))
    best = V.prioritized([exact, named, suffix, contains], ["id"], ["key", "sha", "strategy"]).select("id", "key", "sha", "strategy")
    return n.select("id").join(best, "id", "left").select("id", "key", "sha", F.coalesce("strategy", F.lit("no_match")).alias("strategy"))


def u16_repair(spark, sf):
    """The commit of every function node by the first step that knows one: its own blame, its whole file, the only function of its short name, a deleted one of that name (renamed since), the nearest function of its file, any of its folder."""
    b = cut(blame(spark, sf).select("qualified", F.substring_index("name", ".", -1).alias("short"), "file", "deleted", "sha", "lines", "author_time"))
    n = cut(_functions(spark, sf).select("id", "qualified", F.substring_index("qualified", ".", -1).alias("short"), G.slashed(F.col("path")).alias("file"), "lineno"))
    most = lambda df, *keys: df.groupBy(*keys, "sha").agg(F.sum("lines").alias("lines"), F.max("author_time").alias("at")).groupBy(*keys).agg(F.max(F.struct("lines", "at", "sha"))["sha"].alias("sha"))
    live = b.where("not deleted")
    own = n.join(most(live, "qualified"), "qualified").select("id", "sha", F.lit("blame").alias("step"))
    whole = n.join(most(live, "file"), "file").select("id", "sha", F.lit("whole_file").alias("step"))
    single = live.groupBy("short").agg(F.count_distinct("qualified").alias("k")).where("k = 1").select("short")
    candidate = n.join(most(live.join(single, "short", "left_semi"), "short"), "short").select("id", "sha", F.lit("candidate").alias("step"))
    renamed = n.join(most(b.where("deleted"), "short"), "short").select("id", "sha", F.lit("renamed").alias("step"))
    folder = F.regexp_replace("file", "/[^/]*$", "")
    around = n.withColumn("folder", folder).join(most(b.withColumn("folder", folder), "folder"), "folder").select("id", "sha", F.lit("neighbour").alias("step"))
    best = V.prioritized([own, whole, candidate, renamed, around], ["id"], ["sha", "step"]).select("id", "sha", "step")
    return n.select("id").join(best, "id", "left").select("id", "sha", F.coalesce("step", F.lit("unknown")).alias("step"))


def _places(spark, sf):
    """(qualified, short, file, first, last) of code entities."""
    code = load(spark, sf, "code_entities_full").where("kind in ('function', 'method', 'class') and name is not null and relpath is not null and lineno is not null")
    return code.select(F.concat_ws(".", G.module_name(F.col("relpath")), "name").alias("qualified"), F.substring_index("name", ".", -1).alias("short"), G.slashed(F.col("relpath")).alias("file"), F.col("lineno").alias("first"), F.coalesce("end_lineno", "lineno").alias("last"))


def _listed(spark, sf):
    """Names that retrieval lists, which may lack a place: those that are nodes with their own path and line, all others without."""
    chain = F.trim(G.slashed(F.regexp_replace("neighbor_id", "^(?:Function|Class):", "")))
    return load(spark, sf, "retrieval_debug").where("neighbor_id like 'Function:%' or neighbor_id like 'Class:%'").select(chain.alias("qualified")).where("qualified <> ''").distinct().withColumn("short", F.substring_index("qualified", ".", -1))


def j21_location_triage(spark, sf):
    """Listed names by how their place can be found: a symbol of the graph, a code entity, the only short name, several, none; with the place that is filled in (U12)."""
    names, places = _listed(spark, sf), cut(_places(spark, sf))
    symbols = nodes(spark, sf).where("qualified_name is not null and path is not null and lineno is not null").groupBy(F.col("qualified_name").alias("qualified")).agg(F.min(F.struct(G.slashed(F.col("path")).alias("file"), F.col("lineno").alias("first"), F.col("lineno").alias("last"))).alias("s"))
    exact = places.groupBy("qualified").agg(F.min(F.struct("file", "first", "last")).alias("e"))
    shorts = places.groupBy("short").agg(F.count_distinct("qualified").alias("k"), F.min(F.struct("file", "first", "last")).alias("u"))
    j = names.join(symbols, "qualified", "left").join(exact, "qualified", "left").join(shorts, "short", "left")
    status = F.when(F.col("s").isNotNull(), "sym_exact").when(F.col("e").isNotNull(), "ce_exact").when(F.col("k") == 1, "short_unique").when(F.col("k") > 1, "ambiguous").otherwise("no_match")
    place = F.coalesce("s", "e", F.when(F.col("k") == 1, F.col("u")))
    return j.select("qualified", status.alias("status"), place["file"].alias("file"), place["first"].alias("first_line"), place["last"].alias("last_line"))


def u13_text_backfill(spark, sf):
    """Lines of names without a place by searching ``def name`` and ``class name`` in the text of all modules: all in one file give its first line, one place in all is unique, else ambiguous."""
    modules = load(spark, sf, "code_entities_full").where("kind = 'module' and source is not null and relpath is not null").select("entity_id", G.slashed(F.col("relpath")).alias("file"), F.posexplode(F.split("source", "\n")).alias("pos", "row"))
    found = modules.select("file", (F.col("pos") + 1).alias("line"), F.regexp_extract("row", r"^\s*(?:async )?(?:def|class) ([A-Za-z_][A-Za-z0-9_]*)", 1).alias("short")).where("short <> ''").distinct()
    names = _listed(spark, sf).select("short").distinct()
    g = names.join(found, "short", "left").groupBy("short").agg(F.count_distinct("file").alias("files"), F.count("line").alias("places"), F.min("file").alias("file"), F.min("line").alias("line"))
    status = F.when(F.col("files") == 0, "not_found").when(F.col("places") == 1, "unique").when(F.col("files") == 1, "same_file").otherwise("ambiguous")
    known = F.col("files") == 1
    return g.select("short", status.alias("status"), F.when(known, F.col("file")).alias("file"), F.when(known, F.col("line")).alias("line"))


def u14_candidate_scores(spark, sf):
    """Files scored as places of a definition: +20 below src, +10 in the manifest, + their symbols, + their commits up to 5, -5 in deploy folders."""
    per = load(spark, sf, "code_entities_full").where("relpath is not null").groupBy(G.slashed(F.col("relpath")).alias("file")).agg(F.count("*").alias("symbols"))
    known = load(spark, sf, "code_snippets").where("path is not null").select(G.slashed(F.col("path")).alias("file")).distinct().withColumn("known", F.lit(10))
    commits = blame(spark, sf).groupBy("file").agg(F.least(F.lit(5), F.count_distinct("sha")).alias("commits"))
    score = F.when(F.col("file").rlike("(^|/)src/"), 20).otherwise(0) + F.coalesce("known", F.lit(0)) + F.col("symbols") + F.coalesce("commits", F.lit(0)) - F.when(F.col("file").startswith("cloudrun/") | F.col("file").startswith("serving/"), 5).otherwise(0)
    return per.join(known, "file", "left").join(commits, "file", "left").select("file", score.cast("long").alias("score"))


def u17_validation(spark, sf):
    """Every node and edge that breaks a declared rule, with the list of its errors."""
    n = nodes(spark, sf)
    kind = F.col("node_type")
    rules = [F.when(F.col("id").isNull() | (F.col("id") == ""), "id_missing"), F.when(kind.isNull() | (kind == ""), "type_missing"), F.when(kind.isNotNull() & ~kind.isin(*G.NODE_TYPES), "type_unknown"), F.when(~F.col("id").contains(":"), "id_without_type"), F.when(F.col("id").contains("\\"), "backslash"), F.when(F.substring_index("id", ":", 1) != kind, "type_differs"), F.when(kind.isin("Function", "Class") & F.col("path").isNull(), "no_path"), F.when(F.col("lineno") < 1, "line_below_1")]
    e = G.merge_edges(raw_edges(spark, sf))
    of_edge = [F.when(~F.col("type").isin(*G.EDGE_TYPES), "type_unknown"), F.when(~F.col("source").contains(":"), "source_without_type"), F.when(~F.col("target").contains(":"), "target_without_type"), F.when(F.col("source") == F.col("target"), "loop"), F.when(F.col("count") < 1, "count_below_1")]
    errors = lambda r: F.array_join(F.array_compact(F.array(*r)), ";")
    a = n.select(F.lit("node").alias("record"), "id", errors(rules).alias("errors"))
    b = e.select(F.lit("edge").alias("record"), F.concat_ws(" ", "source", "type", "target").alias("id"), errors(of_edge).alias("errors"))
    return a.unionByName(b).where("errors <> ''").groupBy("record", "id", "errors").agg(F.count("*").alias("n"))


def a36_orientation(spark, sf):
    """Commit to requests map: inverted if over 60 % of its keys are numbers or over 20 % of its values look like hashes, which they do; (sha, prs) after that."""
    m = load(spark, sf, "pull_requests").select("number", F.explode("commits").alias("c")).select(F.col("number").cast("string").alias("k"), F.col("c.sha").alias("v")).where("k is not null and v is not null").distinct()
    share = m.agg(F.avg(F.col("k").rlike("^[0-9]+$").cast("double")).alias("numeric_keys"), F.avg(F.col("v").rlike("^[0-9a-f]{7,40}$").cast("double")).alias("hex_values")).select(((F.col("numeric_keys") > 0.6) | (F.col("hex_values") > 0.2)).alias("invert"))
    turned = m.join(F.broadcast(share))  # one row
    key, value = F.when(F.col("invert"), F.col("v")).otherwise(F.col("k")), F.when(F.col("invert"), F.col("k")).otherwise(F.col("v"))
    return turned.groupBy(key.alias("sha")).agg(F.array_join(F.array_sort(F.collect_set(value)), ",").alias("prs"))


def a19_precision_recall(spark, sf):
    """Entities and triples: predictions that the gold graph holds, restricted to its ids (entities) or predicates (triples)."""
    gold_ids = nodes(spark, sf).where("id is not null").select("id").distinct()
    said = load(spark, sf, "retrieval_debug").where("neighbor_id <> ''").select(F.trim(G.slashed(F.col("neighbor_id"))).alias("id")).distinct()
    all_edges = raw_edges(spark, sf)
    gold = all_edges.where("provenance not in ('call_graph_fallback') and type <> 'OTHER'").select(F.concat_ws(" ", "source", "type", "target").alias("id"), "type").distinct()
    claimed = load(spark, sf, "retrieval_debug").where("node_id is not null and neighbor_id <> '' and score >= 0.5").select(F.concat_ws(" ", "node_id", F.when(F.col("category") == "callees", "CALLS").when(F.col("category") == "callers", "CALLED_BY").when(F.col("category") == "same_file", "SAME_FILE").otherwise("MENTIONS"), F.trim(G.slashed(F.col("neighbor_id")))).alias("id")).distinct()

    def scores(kind, predicted, true):
        sides = predicted.select("id", F.lit(1).alias("s")).unionByName(true.select("id", F.lit(2).alias("s"))).groupBy("id").agg(F.sum("s").alias("s"))
        c = sides.agg(F.sum((F.col("s") == 3).cast("long")).alias("tp"), F.sum((F.col("s") == 1).cast("long")).alias("fp"), F.sum((F.col("s") == 2).cast("long")).alias("fn"))
        p, r = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0)), F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(0.0))
        return c.select(F.lit(kind).alias("kind"), "tp", "fp", "fn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 6).alias("f1"))

    return scores("entities", said.join(gold_ids, "id", "left_semi"), gold_ids).unionByName(scores("triples", claimed, gold.select("id")))


def a20_edge_reasons(spark, sf):
    """Edges between files with their counts added, counts by provenance and the sorted set of reasons."""
    e = raw_edges(spark, sf).where("type in ('IMPORTS', 'CALLS_FILE_LEVEL', 'DEPENDS_ON')")
    by = e.groupBy("source", "target", "provenance").agg(F.count("*").alias("n"), F.collect_set("type").alias("types"))
    return by.groupBy("source", "target").agg(F.sum("n").alias("count"), F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "provenance", "n"))), ";").alias("provenance"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("types")))), ";").alias("reasons"))


def a21_merged_attributes(spark, sf):
    """Edges with count, provenance and attributes of all observations; of an attribute the last observation wins."""
    d = load(spark, sf, "retrieval_debug").where("node_id is not null and trim(neighbor_id) <> ''").select(F.col("node_id").alias("source"), F.trim(G.slashed(F.col("neighbor_id"))).alias("target"), F.coalesce("category", F.lit("none")).alias("type"), "list_name", "label", "path", F.coalesce("retrieved_at", F.lit("1970-01-01").cast("timestamp_ntz")).alias("at"), "retrieval_id")
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("at", "retrieval_id", c)))[c].alias(c)
    return d.groupBy("source", "target", "type").agg(F.count("*").alias("count"), F.array_join(F.array_sort(F.collect_set("list_name")), ";").alias("provenance"), last("label"), last("path"))


QUERIES = {
    "a22_lines_per_commit": _summary,
    "a23_top_commit": a23_top_commit,
    "a24_top_commit_by_time": lambda s, d: _top(s, d),
    "j11_mapped_nodes": j11_mapped_nodes,
    "u16_repair": u16_repair,
    "j21_location_triage": j21_location_triage,
    "u12_backfilled": lambda s, d: j21_location_triage(s, d).groupBy("status").agg(F.count("*").alias("n"), F.count("file").alias("filled")),
    "u13_text_backfill": u13_text_backfill,
    "u14_candidate_scores": u14_candidate_scores,
    "u17_validation": u17_validation,
    "a36_orientation": a36_orientation,
    "a19_precision_recall": a19_precision_recall,
    "a20_edge_reasons": a20_edge_reasons,
    "a21_merged_attributes": a21_merged_attributes,
}

_S = lambda c: f"replace({c}, '\\', '/')"
_MOD = rf"replace(regexp_replace(regexp_replace({_S('relpath')}, '\.py$', ''), '/__init__$', ''), '/', '.')"
_last = lambda c: f"list_last(string_split({c}, '.'))"
_SUM = f"{BLAME_SQL}, sm as (select qualified, sha, sum(lines)::bigint lines, min(author) author, min(mail) mail, max(author_time) author_time, min(summary) summary from blame group by 1, 2)"
_TOP = f"{_SUM}, tp as (select qualified, sha from (select *, row_number() over (partition by qualified order by lines desc, author_time desc nulls last, sha desc) r from sm) where r = 1)"
_FN = "fn as (select id, min(qualified_name) qualified, min(path) path, min(lineno) lineno from nodes where node_type = 'Function' and id is not null and qualified_name is not null group by 1)"
_most = lambda name, src, key: f"{name} as (select {key}, sha from (select {key}, sha, row_number() over (partition by {key} order by sum(lines) desc, max(author_time) desc nulls last, sha desc) r from {src} group by {key}, sha) where r = 1)"
_BARE = "regexp_replace(neighbor_id, '^(?:Function|Class):', '')"
_LISTED = f"ls as (select distinct q qualified, {_last('q')} short from (select trim({_S(_BARE)}) q from retrieval_debug where neighbor_id like 'Function:%' or neighbor_id like 'Class:%') where q <> '')"
_TRIAGE = rf"""{_LISTED}, pl as (select {_MOD} || '.' || name qualified, {_last('name')} short, {_S('relpath')} file, lineno as first, coalesce(end_lineno, lineno) as last from code_entities_full where kind in ('function', 'method', 'class') and name is not null and relpath is not null and lineno is not null),
sy as (select q qualified, min(row(f, l)) s from (select qualified_name q, {_S('path')} f, lineno l from nodes where qualified_name is not null and path is not null and lineno is not null) group by 1), ex as (select qualified, min(row(file, first, last)) e from pl group by 1), sh as (select short, count(distinct qualified) k, min(row(file, first, last)) u from pl group by 1),
tr as (select ls.qualified, case when s is not null then 'sym_exact' when e is not null then 'ce_exact' when k = 1 then 'short_unique' when k > 1 then 'ambiguous' else 'no_match' end status, coalesce(s[1], e[1], case when k = 1 then u[1] end) file, coalesce(s[2], e[2], case when k = 1 then u[2] end) first_line, coalesce(s[2], e[3], case when k = 1 then u[3] end) last_line from ls left join sy using (qualified) left join ex using (qualified) left join sh using (short))"""
_types = ", ".join(f"'{t}'" for t in G.NODE_TYPES)
_etypes = ", ".join(f"'{t}'" for t in G.EDGE_TYPES)
_prf = lambda kind, p, t: f"select '{kind}' kind, tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) \"precision\", round(coalesce(tp / nullif(tp + fn, 0), 0), 6) recall, round(coalesce(2 * (coalesce(tp / nullif(tp + fp, 0), 0)) * (coalesce(tp / nullif(tp + fn, 0), 0)) / nullif(coalesce(tp / nullif(tp + fp, 0), 0) + coalesce(tp / nullif(tp + fn, 0), 0), 0), 0), 6) f1 from (select (select count(*) from {p} where id in (select id from {t})) tp, (select count(*) from {p} where id not in (select id from {t})) fp, (select count(*) from {t} where id not in (select id from {p})) fn)"

SQL = {
    "a22_lines_per_commit": f"with {_SUM} select * from sm",
    "a23_top_commit": f"with {_SUM} select a.qualified, a.sha top, b.sha latest from (select * from (select *, row_number() over (partition by qualified order by lines desc, sha) r from sm) where r = 1) a join (select * from (select *, row_number() over (partition by qualified order by author_time desc nulls last, lines desc, sha desc) r from sm) where r = 1) b using (qualified)",
    "a24_top_commit_by_time": f"with {_TOP} select * from tp",
    "j11_mapped_nodes": f"""with {_TOP}, {_FN}, n as (select id, qualified, {_last('qualified')} short from fn), c as (select id, tp.qualified key, sha, 'exact_qname' strategy, 0 p from n join tp on tp.qualified = n.qualified union all select id, tp.qualified, sha, 'exact_nodeid', 1 from n join tp on id = 'Function:' || tp.qualified union all select id, tp.qualified, sha, 'suffix', 2 from n join tp on {_last('tp.qualified')} = short union all select id, tp.qualified, sha, 'contains', 3 from n join tp on contains(tp.qualified, short) where short <> '')
select n.id, key, sha, coalesce(strategy, 'no_match') strategy from n left join (select * from (select *, row_number() over (partition by id order by p, key, sha) r from c) where r = 1) b on b.id = n.id""",
    "u16_repair": f"""with {BLAME_SQL}, {_FN}, b as (select *, {_last('name')} short, regexp_replace(file, '/[^/]*$', '') folder from blame), lv as (select * from b where not deleted), n as (select id, qualified, {_last('qualified')} short, {_S('path')} file, regexp_replace({_S('path')}, '/[^/]*$', '') folder from fn),
sg as (select * from lv where short in (select short from lv group by 1 having count(distinct qualified) = 1)), dl as (select * from b where deleted), {_most('m1', 'lv', 'qualified')}, {_most('m2', 'lv', 'file')}, {_most('m3', 'sg', 'short')}, {_most('m4', 'dl', 'short')}, {_most('m5', 'b', 'folder')},
c as (select id, sha, 'blame' step, 0 p from n join m1 using (qualified) union all select id, sha, 'whole_file', 1 from n join m2 using (file) union all select id, sha, 'candidate', 2 from n join m3 using (short) union all select id, sha, 'renamed', 3 from n join m4 using (short) union all select id, sha, 'neighbour', 4 from n join m5 using (folder))
select n.id, sha, coalesce(step, 'unknown') step from n left join (select * from (select *, row_number() over (partition by id order by p, sha) r from c) where r = 1) z on z.id = n.id""",
    "j21_location_triage": f"with {_TRIAGE} select * from tr",
    "u12_backfilled": f"with {_TRIAGE} select status, count(*) n, count(file) filled from tr group by 1",
    "u13_text_backfill": rf"with {_LISTED}, ml as (select {_S('relpath')} file, unnest(l) row_, generate_subscripts(l, 1) line from (select relpath, string_split(source, chr(10)) l from code_entities_full where kind = 'module' and source is not null and relpath is not null)), fd as (select distinct file, line, regexp_extract(row_, '^\s*(?:async )?(?:def|class) ([A-Za-z_][A-Za-z0-9_]*)', 1) short from ml), g as (select short, count(distinct file) files, count(line) places, min(file) file, min(line) line from (select distinct short from ls) left join (select * from fd where short <> '') using (short) group by 1) select short, case when files = 0 then 'not_found' when places = 1 then 'unique' when files = 1 then 'same_file' else 'ambiguous' end status, case when files = 1 then file end file, case when files = 1 then line end line from g",
    "u14_candidate_scores": f"with {BLAME_SQL}, p as (select {_S('relpath')} file, count(*) symbols from code_entities_full where relpath is not null group by 1), k as (select distinct {_S('path')} file from code_snippets where path is not null), c as (select file, least(5, count(distinct sha)) commits from blame group by 1) select p.file, (case when regexp_matches(p.file, '(^|/)src/') then 20 else 0 end + case when k.file is null then 0 else 10 end + symbols + coalesce(commits, 0) - case when starts_with(p.file, 'cloudrun/') or starts_with(p.file, 'serving/') then 5 else 0 end)::bigint score from p left join k on k.file = p.file left join c on c.file = p.file",
    "u17_validation": rf"""with {EDGES_SQL}, a as (select 'node' record, id, concat_ws(';', case when id is null or id = '' then 'id_missing' end, case when node_type is null or node_type = '' then 'type_missing' end, case when node_type not in ({_types}) then 'type_unknown' end, case when not contains(id, ':') then 'id_without_type' end, case when contains(id, '\') then 'backslash' end, case when split_part(id, ':', 1) <> node_type then 'type_differs' end, case when node_type in ('Function', 'Class') and path is null then 'no_path' end, case when lineno < 1 then 'line_below_1' end) errors from nodes
 union all select 'edge', source || ' ' || type || ' ' || target, concat_ws(';', case when type not in ({_etypes}) then 'type_unknown' end, case when not contains(source, ':') then 'source_without_type' end, case when not contains(target, ':') then 'target_without_type' end, case when source = target then 'loop' end, case when "count" < 1 then 'count_below_1' end) from e) select record, id, errors, count(*) n from a where errors <> '' group by 1, 2, 3""",
    "a36_orientation": "with m as (select distinct number::varchar k, c.sha v from (select number, unnest(commits) c from pull_requests) where number is not null and c.sha is not null), s as (select avg((regexp_matches(k, '^[0-9]+$'))::int) > 0.6 or avg((regexp_matches(v, '^[0-9a-f]{7,40}$'))::int) > 0.2 inv from m), t as (select case when inv then v else k end sha, case when inv then k else v end p from m, s) select sha, array_to_string(list_sort(list(distinct p)), ',') prs from t group by 1",
    "a19_precision_recall": f"with {EDGES_SQL}, gi as (select distinct id from nodes where id is not null), si as (select distinct trim({_S('neighbor_id')}) id from retrieval_debug where neighbor_id <> ''), pi as (select id from si where id in (select id from gi)), gt as (select distinct source || ' ' || type || ' ' || target id from raw where provenance not in ('call_graph_fallback') and type <> 'OTHER'), pt as (select distinct node_id || ' ' || case category when 'callees' then 'CALLS' when 'callers' then 'CALLED_BY' when 'same_file' then 'SAME_FILE' else 'MENTIONS' end || ' ' || trim({_S('neighbor_id')}) id from retrieval_debug where node_id is not null and neighbor_id <> '' and score >= 0.5) {_prf('entities', 'pi', 'gi')} union all {_prf('triples', 'pt', 'gt')}",
    "a20_edge_reasons": f"with {EDGES_SQL}, x as (select source, target, provenance, type, count(*) n from raw where type in ('IMPORTS', 'CALLS_FILE_LEVEL', 'DEPENDS_ON') group by all), y as (select source, target, provenance, sum(n) n from x group by all) select y.source, y.target, sum(y.n)::bigint as \"count\", array_to_string(list_sort(list(y.provenance || '=' || y.n)), ';') provenance, (select array_to_string(list_sort(list(distinct type)), ';') from x where x.source = y.source and x.target = y.target) reasons from y group by 1, 2",
    "a21_merged_attributes": f"with d as (select node_id as source, trim({_S('neighbor_id')}) target, coalesce(category, 'none') as type, list_name, label, path, coalesce(retrieved_at, timestamp '1970-01-01') seen, retrieval_id from retrieval_debug where node_id is not null and trim(neighbor_id) <> '') select source, target, type, count(*) as \"count\", array_to_string(list_sort(list(distinct list_name)), ';') provenance, (list(label order by seen desc, retrieval_id desc) filter (label is not null))[1] as label, (list(path order by seen desc, retrieval_id desc) filter (path is not null))[1] as path from d group by 1, 2, 3",
}
