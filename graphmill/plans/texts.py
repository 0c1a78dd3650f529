"""Queries of privacy masks and scans, prompt texts and text scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphmill.functions import text as X
from graphmill.operators import graph as G
from graphmill.operators import privacy as P
from graphmill.sources import load
from graphmill.sources.knowledge import nodes



def _bodies(spark, sf):
    return load(spark, sf, "pull_requests").select("record_id", "body")


def _code(spark, sf):
    return load(spark, sf, "code_entities_full")


def _names(spark, sf):
    return _code(spark, sf).where("kind in ('function', 'method') and name is not null").select("entity_id", F.substring_index("name", ".", -1).alias("name"))


def x5_provenance(spark, sf):
    c = load(spark, sf, "commits_sample")
    return c.select("record_id", X.mask_inside(F.col("message_head")).alias("message"), F.when(F.col("author_date").isNotNull(), "[TIMESTAMP]").alias("author_date"), F.when(F.col("author_email").rlike(f"^{X.EMAIL}$"), "[EMAIL]").otherwise(F.col("author_email")).alias("author_email"))


def x13_docstrings(spark, sf):
    doc = F.regexp_replace(F.regexp_replace("doc", X.FILE_PATH, "[FILE]"), X.DOTTED_MODULE, "[MODULE]")
    return _code(spark, sf).where("doc is not null").select("entity_id", doc.alias("doc"))


def x22_residual_names(spark, sf):
    """Function names that documentation still mentions word by word."""
    words = _code(spark, sf).where("doc is not null").select("entity_id", F.explode(F.array_distinct(F.regexp_extract_all("doc", F.lit("[A-Za-z_][A-Za-z0-9_]+"), F.lit(0)))).alias("name"))
    return words.join(_names(spark, sf).select("name").distinct(), "name").select("entity_id", "name")


def x23_unused_placeholders(spark, sf):
    """Function names that no snippet contains as a word."""
    words = load(spark, sf, "code_snippets").where("snippet is not null").select(F.explode(F.array_distinct(F.regexp_extract_all("snippet", F.lit("[A-Za-z_][A-Za-z0-9_]+"), F.lit(0)))).alias("name")).distinct()
    return _names(spark, sf).select("name").distinct().join(words, "name", "left_anti")


def x29_name_similarity(spark, sf):
    d = load(spark, sf, "retrieval_debug").where("label is not null and node_id is not null")
    return d.select("retrieval_id", F.round(X.name_similarity(F.substring_index("node_id", ".", -1), F.col("label")), 6).alias("similarity"))


def pj15_parsed_output(spark, sf):
    """First line as the one-liner, later lines that start with a dash as points, and the notes on what is missing."""
    lines = F.split(F.regexp_replace("body", "\r", ""), "\n")
    points = F.filter(F.slice(lines, F.lit(2), F.greatest(F.size(lines), F.lit(1))), lambda x: x.startswith("-"))
    base = _bodies(spark, sf).where("body is not null").select("record_id", F.trim(lines[0]).alias("one_liner"), F.size(points).alias("points"))
    notes = F.array_join(F.array_compact(F.array(F.when(F.col("one_liner") == "", "no_one_liner"), F.when(F.col("points") < 2, "few_points"))), ";")
    return base.withColumn("notes", notes).withColumn("status", F.when(notes == "", "OK").otherwise("WARN"))


QUERIES = {
    "x4_literal_mask": lambda s, d: load(s, d, "commits_sample").select("record_id", X.mask_whole(F.col("html_url")).alias("html_url"), X.mask_whole(F.col("sha")).alias("sha")),
    "x7_nested_commits": lambda s, d: load(s, d, "pull_requests").where("commits is not null").select("record_id", F.array_join(F.transform(P.masked_commits(F.col("commits")), lambda c: F.concat_ws("|", c["sha"], c["message_head"])), "\n").alias("commits")),
    "x10_contributors": lambda s, d: P.canonical_contributors(load(s, d, "commits_sample").select("author_name"), "author_name"),
    "x10_merged_contributors": lambda s, d: P.merged_contributors(load(s, d, "commits_sample").select("author_name"), "author_name"),
    "x12_signatures": lambda s, d: _code(s, d).where("sig is not null").select("entity_id", P.masked_signature(F.col("sig")).alias("sig")),
    "x13_docstrings": x13_docstrings,
    "x15_roles": lambda s, d: P.role_of(_names(s, d), "name"),
    "x22_residual_names": x22_residual_names,
    "x23_unused_placeholders": x23_unused_placeholders,
    "x24_syntax": lambda s, d: _code(s, d).where("source is not null and kind <> 'config'").groupBy(P.parses("source").alias("parses")).agg(F.count("*").alias("n")),
    "x25_all_author_signals": lambda s, d: P.all_author_signals(load(s, d, "pull_requests"), "record_id", "body", "title", "merge_commit_sha", load(s, d, "commits_sample")),
    "x29_name_similarity": x29_name_similarity,
    "f9_seeded_sample": lambda s, d: nodes(s, d).where("id is not null").select("id").distinct().orderBy(F.md5(F.concat("id", F.lit("#7"))), "id").limit(150),
    "f8_silver_sample": lambda s, d: nodes(s, d).where(F.col("node_type").isin("Function", "Class") & F.col("path").startswith("src/")).select("id", "path").distinct(),
    "f10_skip_lists": lambda s, d: _code(s, d).where(~G.slashed(F.col("relpath")).rlike("(^|/)(tests?|tools|node_modules)/") & ~F.col("relpath").rlike(r"\.(xml|json|toml)$")).select("entity_id"),
    "f13_long_parameters": lambda s, d: _code(s, d).where("sig is not null").select("entity_id", F.explode(F.regexp_extract_all("sig", F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))).alias("p")).where("length(p) > 2").groupBy("p").agg(F.count("*").alias("n")),
    "f14_ordered_distinct": lambda s, d: load(s, d, "commits_sample").where("message_head is not null").select("record_id", F.array_join(F.slice(X.tokens(F.col("message_head")), 1, 10), ",").alias("words")),
    "pj11_path_parts": lambda s, d: _code(s, d).where("relpath is not null").select("entity_id", F.substring_index(G.slashed(F.col("relpath")), "/", -1).alias("base"), F.lower(F.regexp_extract("relpath", r"\.([A-Za-z0-9]+)$", 1)).alias("ext"), P.path_prefix(G.slashed(F.col("relpath"))).alias("place")),
    "pj12_request": lambda s, d: _code(s, d).where("relpath is not null").select("entity_id", X.relative_path(F.concat(F.lit("./../"), F.col("relpath"))).alias("path"), X.single_spaced(F.coalesce("doc", F.lit(""))).alias("request")),
    "pj15_parsed_output": pj15_parsed_output,
    "pj17_token_estimate": lambda s, d: load(s, d, "documents").select("doc_id", X.estimated_tokens(F.col("text")).alias("est_tokens")),
    "pj18_truncated": lambda s, d: load(s, d, "documents").where("text is not null").select("doc_id", F.md5(X.truncated(F.col("text"), 400)).alias("head")),
    "pj25_reference_template": lambda s, d: load(s, d, "code_snippets").where("node_id is not null").select("node_id", F.lit("").alias("reference")).distinct(),
    "s9_grouped_references": lambda s, d: load(s, d, "code_snippets").where("node_id is not null and snippet is not null").groupBy("node_id").agg(F.array_join(F.array_sort(F.transform(F.collect_list("snippet"), lambda x: F.md5(x))), ",").alias("refs"), F.count("*").alias("n")),
}

_q = lambda s: s.replace("'", "''")
_all = lambda c, p: f"regexp_extract_all({c}, '{_q(p)}', 0)"


def _inside(c: str) -> str:
    for pattern, to in ((X.SECRET_ASSIGNMENT, r"\1\2[SECRET]"), (X.EMAIL, "[EMAIL]"), (X.CODE_HOST, "[REPO_URL]"), (X.URL, "[URL]"), (X.HASH, "[COMMIT_ID]")):
        c = f"regexp_replace({c}, '{_q(pattern)}', '{to}', 'g')"
    return c


_whole = lambda c: f"case when regexp_matches({c}, '^{_q(X.CODE_HOST)}') then '[REPO_URL]' when regexp_matches({c}, '^https?://') then '[URL]' when regexp_matches({c}, '^[0-9a-f]{{40}}$') then '[HASH]' else {c} end"
_NAMES = "nm as (select entity_id, list_last(string_split(name, '.')) as name from code_entities_full where kind in ('function', 'method') and name is not null)"
_ROLEVALUES = ", ".join(f"('{w}', '{r}', {i})" for i, (r, ws) in enumerate(P.ROLES.items()) for w in ws)
_ROLES = f"""{_NAMES}, dn as (select distinct name from nm), k(word, role, ro) as (values {_ROLEVALUES}), w as (select name, unnest(ws) word, generate_subscripts(ws, 1) pos from (select name, regexp_split_to_array(lower(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '[_. ]+') ws from dn)),
h as (select name, role, ro, count(*) n, min(pos) f from w join k using (word) group by 1, 2, 3), b as (select name, role, row_number() over (partition by name order by n desc, f, ro) r from h), rl as (select dn.name, coalesce(role, 'utility') role from dn left join b on b.name = dn.name and r = 1)"""
_split = lambda c: f"list_filter(regexp_split_to_array(lower({c}), '\\s+'), lambda t: t <> '')"


_est = lambda c: f"case when coalesce(length({c}), 0) = 0 then 0 else greatest(1, floor(length({c}) / 4)) end::int"

SQL = {
    "x4_literal_mask": f"select record_id, {_whole('html_url')} html_url, {_whole('sha')} sha from commits_sample",
    "x7_nested_commits": f"select record_id, coalesce(array_to_string(list_transform(commits, lambda c: concat_ws('|', '[COMMIT_HASH]', {_inside('c.message_head')})), chr(10)), '') commits from pull_requests where commits is not null",
    "x10_contributors": r"with k as (select distinct author_name, array_to_string(list_sort(string_split(lower(trim(regexp_replace(author_name, '[^A-Za-z0-9]+', ' ', 'g'))), ' ')), ' ') k from commits_sample where author_name is not null), f as (select k, min(author_name) s from k where k <> '' group by 1), n as (select k, row_number() over (order by s, k) i from f) select author_name, 'CONTRIBUTOR_' || i::varchar contributor from k left join n using (k)",
    "x12_signatures": r"select entity_id, case when trim(i) = '' then '()' else '(' || array_to_string(list_transform(string_split(i, ','), lambda p, k: case when trim(p) in ('self', 'cls', '*', '/') then trim(p) else regexp_extract(trim(p), '^(\*{0,2})', 1) || 'param_' || lpad(k::varchar, 3, '0') || case when contains(p, '=') then '=[DEFAULT]' else '' end end), ', ') || ')' end sig from (select entity_id, regexp_replace(sig, '^\(|\)$', '', 'g') i from code_entities_full where sig is not null)",
    "x13_docstrings": f"select entity_id, regexp_replace(regexp_replace(doc, '{_q(X.FILE_PATH)}', '[FILE]', 'g'), '{_q(X.DOTTED_MODULE)}', '[MODULE]', 'g') doc from code_entities_full where doc is not null",
    "x15_roles": f"with {_ROLES} select name, role from rl",
    "x22_residual_names": f"with {_NAMES}, w as (select distinct entity_id, unnest(regexp_extract_all(doc, '[A-Za-z_][A-Za-z0-9_]+', 0)) as name from code_entities_full where doc is not null) select entity_id, name from w where name in (select name from nm)",
    "x23_unused_placeholders": f"with {_NAMES} select distinct name from nm where name not in (select unnest(regexp_extract_all(snippet, '[A-Za-z_][A-Za-z0-9_]+', 0)) from code_snippets where snippet is not null)",
    "x29_name_similarity": "with s as (select retrieval_id, list_distinct(list_filter(regexp_split_to_array(list_last(string_split(node_id, '.')), '[._]'), lambda t: t <> '')) a, list_distinct(list_filter(regexp_split_to_array(label, '[._]'), lambda t: t <> '')) b from retrieval_debug where label is not null and node_id is not null) select retrieval_id, round(coalesce(len(list_intersect(a, b)) / nullif(greatest(len(a), len(b)), 0), 0)::double, 6) similarity from s",
    "f9_seeded_sample": "select id from (select distinct id from nodes where id is not null) order by md5(id || '#7'), id limit 150",
    "x25_all_author_signals": rf"""with b as (select record_id, coalesce(body, '') t, coalesce(title, '') h, merge_commit_sha c from pull_requests), s as (select record_id, c, list_distinct({_all('t', X.EMAIL)}) emails, list_distinct(regexp_extract_all(t, '{_q(X.USER_FOLDER)}', 1)) paths, list_distinct({_all('t', X.ANY_HASH)} || case when c <> '' then [c] else [] end || {_all('h', X.ANY_HASH)}) hashes, list_distinct({_all('t', X.LONG_NUMBER)}) numbers, list_filter([{", ".join(f"'{w}'" for w in P.IDENTIFIER_WORDS)}], lambda w: contains(lower(t), w)) identifiers, nullif(regexp_extract(h, '(?i)introduced_by_pr[=:\s]*([0-9]+)', 1), '') pr from b),
k as (select distinct left(sha, 7) s7 from commits_sample where author_name <> ''), hh as (select record_id, left(unnest(hashes), 7) s7 from s), hi as (select distinct record_id from hh where s7 in (select s7 from k)),
r as (select record_id, least(10, len(emails))::int emails, least(10, len(paths))::int paths, least(10, len(hashes))::int hashes, least(10, len(numbers))::int numbers, least(10, len(identifiers))::int identifiers, pr, coalesce(c <> '', false) or pr is not null or record_id in (select record_id from hi) provenance from s),
z as (select *, least(10, 3 * emails + 2 * paths + hashes + 2 * identifiers + case when provenance then 3 else 0 end) risk from r) select *, case when risk < 3 then 'LOW' when risk < 6 then 'MEDIUM' else 'HIGH' end as level from z""",
    "f8_silver_sample": "select distinct id, path from nodes where node_type in ('Function', 'Class') and starts_with(path, 'src/')",
    "f10_skip_lists": r"select entity_id from code_entities_full where not regexp_matches(replace(relpath, '\', '/'), '(^|/)(tests?|tools|node_modules)/') and not regexp_matches(relpath, '\.(xml|json|toml)$')",
    "f13_long_parameters": "with t as (select unnest(regexp_extract_all(sig, '[A-Za-z_][A-Za-z0-9_]*', 0)) p from code_entities_full where sig is not null) select p, count(*) n from t where length(p) > 2 group by 1",
    "f14_ordered_distinct": f"with t as (select record_id, {_split('message_head')} l from commits_sample where message_head is not null) select record_id, array_to_string(list_slice(list_filter(l, lambda x, i: list_position(l, x) = i), 1, 10), ',') words from t",
    "pj11_path_parts": r"select entity_id, list_last(string_split(p, '/')) base, lower(regexp_extract(p, '\.([A-Za-z0-9]+)$', 1)) ext, case when contains(p, 'test') then 'test' when starts_with(p, 'dags/') then 'dags' when starts_with(p, 'cloudrun/') then 'deploy' when contains(p, 'src/') then 'src' when contains(p, 'config') then 'config' when contains(p, 'data') then 'data' else 'file' end place from (select entity_id, replace(relpath, '\', '/') p from code_entities_full where relpath is not null)",
    "pj12_request": r"select entity_id, regexp_replace(replace('./../' || relpath, '\', '/'), '^[./]+', '') path, trim(regexp_replace(coalesce(doc, ''), '\s+', ' ', 'g')) request from code_entities_full where relpath is not null",
    "pj15_parsed_output": r"with l as (select record_id, string_split(replace(body, chr(13), ''), chr(10)) l from pull_requests where body is not null), b as (select record_id, trim(l[1]) one_liner, len(list_filter(list_slice(l, 2, len(l)), lambda x: starts_with(x, '-')))::int points from l), n as (select *, concat_ws(';', case when one_liner = '' then 'no_one_liner' end, case when points < 2 then 'few_points' end) notes from b) select *, case when notes = '' then 'OK' else 'WARN' end status from n",
    "pj17_token_estimate": f"select doc_id, {_est('text')} est_tokens from documents",
    "pj18_truncated": "with h as (select doc_id, text, left(text, 400) h from documents where text is not null), b as (select *, case when contains(h, chr(10)) then length(h) - length(list_last(string_split(h, chr(10)))) - 1 else 0 end k from h) select doc_id, md5(case when length(text) <= 400 then text when contains(h, chr(10)) and k > 240 then left(text, k) else h end) head from b",
    "pj25_reference_template": "select distinct node_id, '' reference from code_snippets where node_id is not null",
    "s9_grouped_references": "select node_id, array_to_string(list_sort(list(md5(snippet))), ',') refs, count(*) n from code_snippets where node_id is not null and snippet is not null group by 1",
}
