"""Queries of sources, exports and the monitored stream (here over its finished table)."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphmill.operators import graph as G
from graphmill.operators import privacy as P
from graphmill.sources import files, load
from graphmill.sources.knowledge import EDGES_SQL, nodes, raw_edges
from graphmill.streaming.monitor import monitored


def s11_flatten_commits(spark, sf):
    """Commits brought to the shape of the API and flattened again through JSON."""
    c = load(spark, sf, "commits_sample").where("sha is not null")
    nested = c.select(F.to_json(F.struct("sha", F.struct(F.concat(F.coalesce("message_head", F.lit("")), F.lit("\nbody")).alias("message"), F.struct(F.col("author_name").alias("name"), F.col("author_email").alias("email"), F.date_format("author_date", "yyyy-MM-dd'T'HH:mm:ss").alias("date")).alias("author")).alias("commit"), F.transform(F.coalesce("parents", F.array().cast("array<string>")), lambda p: F.struct(p.alias("sha"))).alias("parents"), "html_url")).alias("record"))
    shape = "sha string, commit struct<message:string,author:struct<name:string,email:string,date:string>>, parents array<struct<sha:string>>, html_url string"
    flat = files.flatten_commits(nested.select(F.from_json("record", shape).alias("r")).select("r.*"))
    return flat.select("sha", "message_head", "author_name", "author_email", F.date_format("author_date", "yyyy-MM-dd HH:mm:ss").alias("author_date"), F.size("parents").alias("parents"), "html_url")


def _manifest(spark, sf):
    return load(spark, sf, "code_entities_full").where("relpath is not null and source is not null").groupBy(G.slashed(F.col("relpath")).alias("relpath")).agg(F.max("source").alias("text")).select("relpath", F.length("text").cast("long").alias("size"), F.sha2("text", 256).alias("sha256"))


def s17_merged_manifest(spark, sf):
    """Files of snippets added to the files of entities where their path is new."""
    more = load(spark, sf, "code_snippets").where("path is not null and snippet is not null").groupBy(G.slashed(F.col("path")).alias("relpath")).agg(F.max("snippet").alias("text")).select("relpath", F.length("text").cast("long").alias("size"), F.sha2("text", 256).alias("sha256"))
    return files.merged_manifest(_manifest(spark, sf), more)


def s23_copy_stats(spark, sf):
    """Files, Python files and kilobytes per top folder, skipped folders left out."""
    m = _manifest(spark, sf).where(~F.col("relpath").rlike("(^|/)(node_modules|__pycache__|tools)/"))
    return m.groupBy(F.substring_index("relpath", "/", 1).alias("folder")).agg(F.count("*").alias("files"), F.sum(F.col("relpath").endswith(".py").cast("long")).alias("py_files"), F.round(F.sum("size") / 1024, 4).alias("kb"))


def s20_serving_version(spark, sf):
    models = load(spark, sf, "part").select(F.col("p_brand").alias("family"), F.concat(F.lit("model_"), F.col("p_partkey").cast("string")).alias("name"))
    return files.serving_model(models)


def u8_dependencies(spark, sf):
    """Packages that modules import and the repository and its standard library do not hold, with the files that need them. (Manifest formats are parsed by ``operators.code``; the tables hold no manifests.)"""
    wanted = raw_edges(spark, sf).where("type = 'DEPENDS_ON'").select(F.substring("target", 12, 1000).alias("name"), "source")
    return wanted.where(~F.col("name").isin(*P.STANDARD_MODULES)).groupBy(F.lit("pip").alias("ecosystem"), "name").agg(F.count_distinct("source").alias("files"))


def s18_edges_export(spark, sf):
    """Edges for a drawing: both ends with label and type, weight and joined provenance."""
    n = nodes(spark, sf).where("id is not null").groupBy("id").agg(F.min("label").alias("label"), F.min("node_type").alias("kind"))
    e = G.merge_edges(raw_edges(spark, sf))
    end = lambda side: n.select(F.col("id").alias(side), F.col("label").alias(f"{side}_label"), F.col("kind").alias(f"{side}_type"))
    j = e.join(end("source"), "source", "left").join(end("target"), "target", "left")
    text = lambda c, other: F.coalesce(c, F.regexp_replace(other, "^[^:]*:", ""))
    return j.select("source", "target", "type", "count", text("source_label", "source").alias("source_label"), text("target_label", "target").alias("target_label"), F.coalesce("source_type", F.lit("UNKNOWN")).alias("source_type"), F.coalesce("target_type", F.lit("UNKNOWN")).alias("target_type"), "provenance")


def s18_node_audit(spark, sf):
    """Nodes for an audit: which fields are filled, attribute keys joined, number of records of the id."""
    n = nodes(spark, sf).where("id is not null")
    filled = lambda c: F.max(F.col(c).isNotNull().cast("int")).alias(f"has_{c}")
    return n.groupBy("id").agg(F.count("*").alias("records"), *map(filled, ("label", "path", "qualified_name", "lineno", "sha", "number")), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(F.map_keys("attrs"), F.array().cast("array<string>")))))), ";").alias("attrs"))


def s24_looked_up(spark, sf):
    """Commits with their requests: from the lists of requests, else by a look-up of those that are in none (here among the merge commits), else an empty list."""
    requests = load(spark, sf, "pull_requests")
    known = requests.select("number", F.explode("commits").alias("c")).select(F.col("c.sha").alias("sha"), "number").where("sha is not null and number is not null")
    merged = requests.where("merge_commit_sha is not null and number is not null").select(F.col("merge_commit_sha").alias("sha"), "number")
    shas = load(spark, sf, "commits_sample").where("sha is not null").select("sha").distinct()
    return files.mapped_commits(shas, known, lambda rest: rest.join(merged, "sha"))


QUERIES = {
    "s8_csv_export": lambda s, d: files.with_json_columns(nodes(s, d).select("id", "attrs")).distinct(),
    "s11_flatten_commits": s11_flatten_commits,
    "s12_pull_requests": lambda s, d: load(s, d, "pull_requests").select("record_id", "number", "title", "user", F.array_join(F.transform(F.coalesce("commits", F.array().cast("array<struct<sha:string,message_head:string>>")), lambda c: F.substring(c["sha"], 1, 7)), ",").alias("commits")),
    "s16_text_of_markup": lambda s, d: load(s, d, "documents").where("text is not null").select("doc_id", F.md5(files.text_of_html(F.col("text"))).alias("plain")),
    "s17_merged_manifest": s17_merged_manifest,
    "s18_viz_export": lambda s, d: load(s, d, "commits_sample").select("record_id", F.concat_ws(";", F.coalesce("parents", F.array().cast("array<string>"))).alias("parents"), F.coalesce("author_name", F.lit("")).alias("author")),
    "s18_edges_export": s18_edges_export,
    "s18_node_audit": s18_node_audit,
    "s24_looked_up": s24_looked_up,
    "s20_serving_version": s20_serving_version,
    "s23_copy_stats": s23_copy_stats,
    "u8_dependencies": u8_dependencies,
    "stream_monitor": lambda s, d: monitored(load(s, d, "events"), width="1 hour").select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", "least", "greatest", "mean"),
}

_M = r"m as (select relpath, length(t)::bigint size, sha256(t) sha256 from (select replace(relpath, '\', '/') relpath, max(source) t from code_entities_full where relpath is not null and source is not null group by 1))"

SQL = {
    "s8_csv_export": "select distinct id, case when attrs is not null then '{' || array_to_string(list_transform(list_sort(map_keys(attrs)), lambda k: to_json(k)::varchar || ':' || coalesce(to_json(attrs[k])::varchar, 'null')), ',') || '}' end attrs from nodes",
    "s11_flatten_commits": "select sha, string_split(coalesce(message_head, ''), chr(10))[1] message_head, author_name, author_email, strftime(author_date, '%Y-%m-%d %H:%M:%S') author_date, coalesce(len(parents), 0)::int parents, html_url from commits_sample where sha is not null",
    "s12_pull_requests": "select record_id, number, title, \"user\", coalesce(array_to_string(list_transform(commits, lambda c: left(c.sha, 7)), ','), '') commits from pull_requests",
    "s16_text_of_markup": r"select doc_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(text, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'g'), '<[^<>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '" + '"' + r"'), '&amp;', '&'), '\s+', ' ', 'g'), ' ')) plain from documents where text is not null",
    "s17_merged_manifest": rf"with {_M}, s as (select relpath, length(t)::bigint size, sha256(t) sha256 from (select replace(path, '\', '/') relpath, max(snippet) t from code_snippets where path is not null and snippet is not null group by 1)) select * from m union all select * from s where relpath not in (select relpath from m)",
    "s18_viz_export": "select record_id, coalesce(array_to_string(parents, ';'), '') parents, coalesce(author_name, '') author from commits_sample",
    "s20_serving_version": "select family, name from (select p_brand family, 'model_' || p_partkey::varchar as name, row_number() over (partition by p_brand order by p_partkey desc) r, count(*) over (partition by p_brand) n from part) where r = least(2, n)",
    "s23_copy_stats": f"with {_M} select split_part(relpath, '/', 1) folder, count(*) files, sum(ends_with(relpath, '.py')::int)::bigint py_files, round(sum(size) / 1024, 4) kb from m where not regexp_matches(relpath, '(^|/)(node_modules|__pycache__|tools)/') group by 1",
    "u8_dependencies": f"with {EDGES_SQL} select 'pip' ecosystem, substr(target, 12) as name, count(distinct source) files from raw where type = 'DEPENDS_ON' and substr(target, 12) not in ({', '.join(repr(m) for m in P.STANDARD_MODULES)}) group by 2",
    "s18_edges_export": f"with {EDGES_SQL}, n as (select id, min(label) l, min(node_type) k from nodes where id is not null group by 1) select source, target, type, \"count\", coalesce(a.l, regexp_replace(source, '^[^:]*:', '')) source_label, coalesce(b.l, regexp_replace(target, '^[^:]*:', '')) target_label, coalesce(a.k, 'UNKNOWN') source_type, coalesce(b.k, 'UNKNOWN') target_type, provenance from e left join n a on a.id = source left join n b on b.id = target",
    "s18_node_audit": "select id, count(*) records, " + ", ".join(f"max(({c} is not null)::int) has_{c}" for c in ("label", "path", "qualified_name", "lineno", "sha", "number")) + ", array_to_string(list_sort(list_distinct(flatten(list(coalesce(map_keys(attrs), []))))), ';') attrs from nodes where id is not null group by 1",
    "s24_looked_up": "with k as (select distinct c.sha sha, number from (select number, unnest(commits) c from pull_requests) where c.sha is not null and number is not null), m as (select distinct merge_commit_sha sha, number from pull_requests where merge_commit_sha is not null and number is not null and merge_commit_sha not in (select sha from k)), a as (select sha, array_to_string(list_sort(list(number)), ',') prs from (select * from k union all select * from m) group by 1) select s.sha, coalesce(prs, '') prs from (select distinct sha from commits_sample where sha is not null) s left join a on a.sha = s.sha",
    "stream_monitor": "select strftime(time_bucket(interval 1 hour, ts), '%Y-%m-%d %H:%M') as start, event_type, count(*) n, min(value) least, max(value) greatest, round(avg(value), 6) mean from events group by 1, 2",
}
