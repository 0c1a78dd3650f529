"""Queries that audit, mask and scan all fields of graph records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.functions import text as X
from graphmill.operators import graph as G
from graphmill.operators import sanitize as Z
from graphmill.session import cut
from graphmill.sources import load

#: Columns of each table as fields of its records; times in ISO form.
NODES = {"type": "node_type", "label": "label", "path": "path", "qualified_name": "qualified_name", "lineno": "lineno", "sha": "sha", "created_at": "created_at"}
COMMITS = {"attrs.sha": "sha", "attrs.message_head": "message_head", "attrs.author_name": "author_name", "attrs.author_email": "author_email", "attrs.author_date": "author_date", "attrs.parents": "parents", "attrs.html_url": "html_url"}
REQUESTS = {"introduced_by_pr": "number", "attrs.title": "title", "text_preview": "body", "attrs.user": "user", "attrs.state": "state", "attrs.created_at": "created_at", "attrs.closed_at": "closed_at", "attrs.merged_at": "merged_at", "attrs.merge_commit_sha": "merge_commit_sha", "attrs.commits": "commits", "attrs.html_url": "html_url"}
ENTITIES = {"type": "kind", "name": "name", "file": "relpath", "lineno": "lineno", "end_lineno": "end_lineno", "signature": "sig", "docstring": "doc"}
TIMES = ("created_at", "closed_at", "merged_at", "author_date")
TABLES = (("Commit", "commits_sample", "record_id", COMMITS), ("PR", "pull_requests", "record_id", REQUESTS), ("Code", "code_entities_full", "entity_id", ENTITIES))


def _text(c):
    if c in TIMES:
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    if c == "parents":
        return F.array_join(c, ",")
    if c == "commits":
        return F.array_join(F.transform(c, lambda x: x["sha"]), ",")
    return F.col(c).cast("string")


def fields(spark, sf) -> DataFrame:
    """(record, node_type, field, value): every field of every node with its attributes, commit, request and code entity."""
    stored = load(spark, sf, "nodes").where("id is not null").groupBy("id").agg(F.max(F.struct("created_at", *(c for c in NODES.values() if c != "created_at"), F.map_entries("attrs").alias("attrs"))).alias("n")).select("id", "n.*")
    wide = stored.select(F.col("id").alias("record"), F.col("node_type").alias("kind"), *(_text(c).alias(k) for k, c in NODES.items()), "attrs")
    flat = wide.select("record", F.col("kind").alias("node_type"), *NODES).unpivot(["record", "node_type"], list(NODES), "field", "value")
    nested = wide.where("attrs is not null").select("record", F.col("kind").alias("node_type"), F.explode("attrs").alias("a")).select("record", "node_type", F.concat(F.lit("attrs."), "a.key").alias("field"), F.col("a.value").alias("value"))
    parts = [flat, nested]
    for tag, table, key, columns in TABLES:
        names = [f"f{i}" for i in range(len(columns))]
        rows = load(spark, sf, table).select(F.concat(F.lit(f"{tag}#"), F.col(key).cast("string")).alias("record"), F.lit(tag).alias("node_type"), *(_text(c).alias(n) for n, c in zip(names, columns.values(), strict=True)))
        label = F.create_map(*(F.lit(x) for kv in zip(names, columns, strict=True) for x in kv))
        parts.append(rows.unpivot(["record", "node_type"], names, "f", "value").select("record", "node_type", F.element_at(label, F.col("f")).alias("field"), "value"))
    return reduce(DataFrame.unionByName, parts)


def _given(spark, sf):
    listed = load(spark, sf, "given_names")
    return listed.select(F.col("given_name").alias("given")).unionByName(listed.select(F.col("short_form").alias("given")))


def _contributors(spark, sf):
    return load(spark, sf, "commits_sample").where("author_name is not null").select(F.col("author_name").alias("name"))


def _hashed(df):
    return df.select("record", "field", F.when(F.length("value") > 60, F.md5("value")).otherwise(F.col("value")).alias("value"))


def x9_replaced(spark, sf):
    """Bodies of requests with typed tokens for the entities in them."""
    bodies = load(spark, sf, "pull_requests").select("record_id", "body")
    return Z.replaced_entities(bodies, ["record_id"], "body", _given(spark, sf)).select("record_id", F.md5("body").alias("body"))


def x14_node_rewrite(spark, sf):
    """Every node with the fields of its type renamed: labels and names by the hash of the name, paths and files by depth and ending, attributes masked."""
    n = load(spark, sf, "nodes").where("id is not null").groupBy("id").agg(F.max(F.struct("node_type", "label", "path", "qualified_name")).alias("n")).select("id", "n.*")
    code, file = F.col("node_type").isin("Function", "Class"), F.col("node_type").isin("File", "Document")
    short = lambda c: F.substring(F.sha1(c), 1, 8)
    label = F.when(code, F.concat(F.lower("node_type"), F.lit("_"), short("label"))).when(file, F.concat(F.lit("file_"), short("label"))).when(F.col("node_type") == "Module", F.concat(F.lit("module_"), short("label"))).when(F.col("node_type") == "Commit", "[COMMIT_ID]").when(F.col("node_type") == "PR", "[PR_REF]").otherwise(F.col("label"))
    depth = F.size(F.split("qualified_name", r"\."))
    qualified = F.when(F.col("qualified_name").isNull(), None).when(code, F.concat(F.lit("module_l"), (depth - 1).cast("string"), F.lit("."), F.lower("node_type"), F.lit("_"), short(F.substring_index("qualified_name", ".", -1)))).otherwise(F.concat(F.lit("module_l"), depth.cast("string"), F.lit("_"), short("qualified_name")))
    path = F.when(F.col("path").isNotNull(), F.concat(F.lit("dir_l"), (F.size(F.split(G.slashed(F.col("path")), "/")) - 1).cast("string"), F.lit("/file_"), short(G.slashed(F.col("path"))), F.regexp_extract("path", r"(\.[A-Za-z0-9]+)$", 1)))
    inner = F.regexp_replace("id", "^[^:]*:", "")
    return n.select("id", F.concat(F.substring_index("id", ":", 1), F.lit(":"), short(inner)).alias("new_id"), label.alias("label"), qualified.alias("qualified_name"), path.alias("path"))


def x18_literals(spark, sf):
    """Sources with secrets, addresses, links and hashes masked; contributors follow in x19_pipeline."""
    return load(spark, sf, "code_entities_full").where("source is not null").select("entity_id", F.md5(X.mask_inside(F.col("source"))).alias("rewritten"))


def x28_redacted_attributes(spark, sf):
    """(record, path): where attributes have a sensitive key or value, with the redacted value."""
    a = fields(spark, sf).where("field like 'attrs.%' and value is not null")
    key = F.lower(F.substring("field", 7, 1000)).rlike("token|secret|password|passwd|hash|api_?key|access_?key|private_?key|credential")
    value = F.col("value").rlike(SENSITIVE_VALUE)
    return a.where(key | value).select("record", F.concat(F.lit("$."), "field").alias("path"), F.when(key, "key").otherwise("value").alias("reason"), F.lit("[REDACTED]").alias("value"))


SENSITIVE_VALUE = r"(?:gh[pousr]_[A-Za-z0-9]{20,}|AKIA[0-9A-Z]{16}|-----BEGIN [A-Z ]*PRIVATE KEY)"


def x30_registry(spark, sf):
    """Look-up of what is masked under a text: every field of a record whose value names the most frequent author."""
    most = load(spark, sf, "commits_sample").where("author_name is not null").groupBy("author_name").agg(F.count("*").alias("k")).agg(F.max(F.struct("k", "author_name"))["author_name"].alias("name"))
    f = fields(spark, sf).where("value is not null")
    return f.join(F.broadcast(most), F.contains("value", "name")).select("record", "field", "name")  # one row


def a39_type_distribution(spark, sf):
    """Nodes per type before and after sanitization, which gives ids anew and may let types be told by them only."""
    before = G.type_counts(load(spark, sf, "nodes").where("id is not null").select("id", "node_type").distinct(), "node_type").withColumnRenamed("n", "before")
    renamed = x14_node_rewrite(spark, sf).select(F.substring_index("new_id", ":", 1).alias("node_type"))
    after = G.type_counts(renamed, "node_type").withColumnRenamed("n", "after")
    return before.join(after, "type", "full_outer").select("type", F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))


def f12_false_positives(spark, sf):
    """Entities of bodies by kind, and how many of each are false."""
    found = Z.entities(load(spark, sf, "pull_requests").select("record_id", "body"), ["record_id"], "body", _given(spark, sf))
    return found.groupBy("entity_type", "false_positive").agg(F.count("*").alias("n"), F.count_distinct("entity").alias("entities"))


QUERIES = {
    "x1_field_audit": lambda s, d: Z.audited(fields(s, d)).select("record", "field", "field_category", "value_category", "final_category", "action"),
    "x2_value_categories": lambda s, d: Z.audited(fields(s, d)).groupBy("field", "value_category").agg(F.count("*").alias("n")),
    "a30_leakage_share": lambda s, d: Z.audited(fields(s, d)).groupBy("final_category").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("field")), ";").alias("fields")),
    "x5_provenance_mask": lambda s, d: _hashed(Z.masked_fields(cut(fields(s, d).where(F.col("field").isin(*Z.ROUTES["author"], *Z.ROUTES["title"], *Z.ROUTES["text"]))), _given(s, d))),
    "x6_hash_lists": lambda s, d: _hashed(Z.masked_fields(fields(s, d).where(F.col("field").isin(*Z.ROUTES["commit"], *Z.ROUTES["commit_list"], *Z.ROUTES["pr"])), _given(s, d))),
    "x8_router": lambda s, d: _hashed(Z.masked_fields(cut(fields(s, d)), _given(s, d))),
    "x9_entities": lambda s, d: Z.entities(load(s, d, "pull_requests").select("record_id", "body"), ["record_id"], "body", _given(s, d)),
    "x9_replaced": x9_replaced,
    "x14_node_rewrite": x14_node_rewrite,
    "x18_literals": x18_literals,
    "x21_residuals": lambda s, d: Z.residuals(fields(s, d), _contributors(s, d)),
    "a38_residual_counts": lambda s, d: Z.residuals(fields(s, d), _contributors(s, d)).groupBy("pattern_type", "severity").agg(F.count("*").alias("n")),
    "x27_pii_scan": lambda s, d: Z.personal_counts(load(s, d, "pull_requests").select(F.concat(F.lit("p"), F.col("record_id").cast("string")).alias("file"), F.col("body").alias("text")).unionByName(load(s, d, "code_entities_full").select(F.concat(F.lit("c"), F.col("entity_id").cast("string")).alias("file"), F.col("source").alias("text"))), "file", "text"),
    "x28_redacted_attributes": x28_redacted_attributes,
    "x30_registry": x30_registry,
    "a39_type_distribution": a39_type_distribution,
    "f12_false_positives": f12_false_positives,
}

_q = lambda s: s.replace("'", "''")
_iso = lambda c: f"strftime({c}, '%Y-%m-%dT%H:%M:%SZ')"


def _sqltext(c):
    if c in TIMES:
        return _iso(c)
    if c == "parents":
        return "array_to_string(parents, ',')"
    if c == "commits":
        return "array_to_string(list_filter(list_transform(commits, lambda x: x.sha), lambda x: x is not null), ',')"
    return f"\"{c}\"::varchar"


_FIELDS = "nn as (select * from (select *, row_number() over (partition by id order by created_at desc nulls last, node_type desc nulls last, label desc nulls last, path desc nulls last, qualified_name desc nulls last, lineno desc nulls last, sha desc nulls last, map_entries(attrs) desc nulls last) r from nodes where id is not null) where r = 1), fields as (" + " union all ".join(
    [f"select id record, node_type, '{k}' field, {_sqltext(c)} as value from nn" for k, c in NODES.items()]
    + ["select id, node_type, 'attrs.' || e.key, e.value from (select id, node_type, unnest(map_entries(attrs)) e from nn where attrs is not null)"]
    + [f"select '{tag}#' || {key}::varchar, '{tag}', '{k}', {_sqltext(c)} from {table}" for tag, table, key, columns in TABLES for k, c in columns.items()]
) + ")"
_in = lambda values: ", ".join(f"'{v}'" for v in values)
_VALUECAT = rf"case when value is null or regexp_matches(value, '^-?[0-9]+(\.[0-9]+)?$') then 'SAFE' when regexp_matches(trim(value), '^[0-9a-f]{{40}}$') or regexp_matches(value, '{Z.TIMED}') or regexp_matches(value, '{Z.MAIL}') then 'PROVENANCE' when regexp_matches(value, 'https?://[^\s]') then 'LITERAL' when regexp_matches(value, '{Z.FILE_NAME}') or regexp_matches(trim(value), '{Z.MODULE}') then 'STRUCTURAL' else 'UNKNOWN' end"
_FIELDCAT = "case field " + " ".join(f"when '{k}' then '{v}'" for k, v in Z.FIELD_CATEGORIES.items()) + " else 'UNKNOWN' end"
_ACTION = "case final_category " + " ".join(f"when '{k}' then '{v}'" for k, v in Z.ACTIONS.items()) + f" else '{Z.REVIEW}' end"
_AUDIT = f"{_FIELDS}, a as (select record, field, {_FIELDCAT} field_category, {_VALUECAT} value_category from fields), b as (select *, case when field_category = 'UNKNOWN' then value_category else field_category end final_category from a)"
_ANY = _q(Z.ANY_ENTITY)
_kinds = list(Z.ENTITIES.items())
_KIND = "case " + " ".join(f"when regexp_matches(entity, '^(?:{_q(p)})$') then '{k}'" for k, (p, _) in _kinds[:-1]) + " else 'PERSON' end"
_TOKEN = "case when contains(entity, 'github.com') or contains(entity, 'codehost.') then '[REPO_URL]' " + " ".join(f"when entity_type = '{k}' then '{t}'" for k, (_, t) in _kinds) + " end"
_FALSE = rf"lower(trim(entity)) in ({_in(Z.SOFTWARE_TERMS)}) or (entity_type = 'URL' and regexp_matches(lower(entity), '^[a-z0-9_-]+\.(py|json|yaml|yml|txt|md|csv|sh|cfg|ini|toml|js|ts|html|css)$')) or (entity_type = 'DATE_TIME' and regexp_matches(entity, '^[0-9]+\.[0-9]+(\.[0-9]+)?$')) or (entity_type = 'PHONE_NUMBER' and regexp_matches(entity, '^[0-9]+$')) or (entity_type = 'PERSON' and regexp_matches(lower(entity), '^[a-z][a-z0-9]*(_[a-z0-9]+)+$')) or regexp_matches(lower(trim(entity)), '^[a-f0-9]{{7,}}$') or length(trim(entity)) <= 2"


def _entities(src: str, keys: str) -> str:
    """CTEs up to ``ent`` for src (keys, t) and ``rep`` (keys, t) with tokens."""
    return f"""gn as (select distinct lower(g) g from (select given_name g from given_names union all select short_form from given_names) where g is not null),
e0 as (select {keys}, unnest(l) entity, generate_subscripts(l, 1) - 1 nth, unnest(g[1:len(l)]) gap from (select {keys}, regexp_extract_all(t, '{_ANY}', 0) l, list_transform(regexp_split_to_array(t, '{_ANY}'), lambda x: length(x)) g from {src} where t is not null)),
e1 as (select *, {_KIND} entity_type from e0), ent as (select {keys}, nth::int nth, gap, entity_type, entity, ({_FALSE}) or (entity_type = 'PERSON' and lower(split_part(entity, ' ', 1)) not in (select g from gn)) false_positive from e1),
own as (select {keys}, list(case when false_positive then entity else {_TOKEN} end order by nth) o from ent group by {keys}),
rep as (select {', '.join('s.' + k.strip() for k in keys.split(','))}, case when o is null then t else array_to_string(list_transform(regexp_split_to_array(t, '{_ANY}'), lambda g, i: g || coalesce(o[i], '')), '') end t from {src} s left join own on {' and '.join(f's.{k.strip()} = own.{k.strip()}' for k in keys.split(','))})"""


_BODIES = "bodies as (select record_id, body t from pull_requests)"
_WHOLE = f"case when regexp_matches(value, '^{_q(X.CODE_HOST)}') then '[REPO_URL]' when regexp_matches(value, '^https?://') then '[URL]' when regexp_matches(value, '^[0-9a-f]{{40}}$') then '[HASH]' else value end"
_route = lambda n: f"field in ({_in(Z.ROUTES[n])})"


def _masked(where: str) -> str:
    return rf"""with {_FIELDS}, ff as (select * from fields where {where}), nc as (select distinct value, array_to_string(list_sort(string_split(lower(trim(regexp_replace(value, '[^A-Za-z0-9]+', ' ', 'g'))), ' ')), ' ') k from ff where {_route('author')} and trim(value) <> ''),
fk as (select k, min(value) s from nc where k <> '' group by 1), ck as (select k, 'CONTRIBUTOR_' || row_number() over (order by s, k)::varchar contributor from fk), cb as (select value, contributor from nc left join ck using (k)),
free as (select record, field, value t from ff where {_route('text')} and value is not null and not regexp_matches(value, '^{Z.TIMED}') and not regexp_matches(value, '^{Z.MAIL}$') and length(value) > 3), {_entities('free', 'record, field')},
m as (select ff.record, ff.field, case when ff.value is null or ff.value = '' then ff.value when {_route('commit').replace('field', 'ff.field')} then '[COMMIT_ID]' when {_route('commit_list').replace('field', 'ff.field')} then array_to_string(list_transform(string_split(ff.value, ','), lambda x: case when regexp_matches(x, '^[0-9a-f]{{40}}$') then '[COMMIT_ID]' else x end), ',') when {_route('pr').replace('field', 'ff.field')} then '[PR_REF]' when {_route('literal').replace('field', 'ff.field')} then {_WHOLE.replace('value', 'ff.value')}
 when {_route('author').replace('field', 'ff.field')} then coalesce(contributor, ff.value) when {_route('title').replace('field', 'ff.field')} then '[PR_TITLE]' when {_route('text').replace('field', 'ff.field')} and regexp_matches(ff.value, '^{Z.TIMED}') then '[TIMESTAMP]' when {_route('text').replace('field', 'ff.field')} and regexp_matches(ff.value, '^{Z.MAIL}$') then '[EMAIL]' when {_route('text').replace('field', 'ff.field')} then coalesce(regexp_replace(rep.t, '[0-9a-f]{{40}}', '[COMMIT_ID]', 'g'), ff.value) else ff.value end as value
 from ff left join cb on cb.value = ff.value left join rep on rep.record = ff.record and rep.field = ff.field) select record, field, case when length(value) > 60 then md5(value) else value end as value from m"""


_KEPT = f"kept as (select record, field, value from fields where value is not null and field not in ({_in(Z.SKIPPED)}))"
_RUNS = r"[^\s,;:()<>\"''\[\]{}=#]+"
_RES = f"{_FIELDS}, {_KEPT}, cn as (select distinct lower(trim(author_name)) as name from commits_sample where length(trim(author_name)) > 3), wl as (select record, field, regexp_extract_all(lower(value), '{_RUNS}', 0) w from kept), rn as (select record, field, unnest(w) as name from wl union select record, field, unnest(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) from wl where len(w) > 1), res as (" + " union all ".join(f"select record, field, '{n}' pattern_type, left(unnest(regexp_extract_all(value, '{_q(p)}', 0)), 80) matched_text, '{s}' severity from kept" for n, (p, s) in Z.RESIDUALS.items()) + " union all select record, field, 'CONTRIBUTOR_NAME', left(name, 80), 'HIGH' from rn join cn using (name))"
_short = lambda c: f"left(sha1({c}), 8)"
_N = "n as (select * from (select *, row_number() over (partition by id order by node_type desc nulls last, label desc nulls last, path desc nulls last, qualified_name desc nulls last) r from nodes where id is not null) where r = 1)"
_P = r"replace(path, '\', '/')"
_X14 = rf"""{_N}, x14 as (select id, split_part(id, ':', 1) || ':' || {_short("regexp_replace(id, '^[^:]*:', '')")} new_id,
case when node_type in ('Function', 'Class') then lower(node_type) || '_' || {_short('label')} when node_type in ('File', 'Document') then 'file_' || {_short('label')} when node_type = 'Module' then 'module_' || {_short('label')} when node_type = 'Commit' then '[COMMIT_ID]' when node_type = 'PR' then '[PR_REF]' else label end as label,
case when qualified_name is null then null when node_type in ('Function', 'Class') then 'module_l' || (len(string_split(qualified_name, '.')) - 1)::varchar || '.' || lower(node_type) || '_' || {_short("list_last(string_split(qualified_name, '.'))")} else 'module_l' || len(string_split(qualified_name, '.'))::varchar || '_' || {_short('qualified_name')} end qualified_name,
case when path is not null then 'dir_l' || (len(string_split({_P}, '/')) - 1)::varchar || '/file_' || {_short(_P)} || regexp_extract(path, '(\.[A-Za-z0-9]+)$', 1) end as path from n)"""


def _inside(c: str) -> str:
    for pattern, to in ((X.SECRET_ASSIGNMENT, r"\1\2[SECRET]"), (X.EMAIL, "[EMAIL]"), (X.CODE_HOST, "[REPO_URL]"), (X.URL, "[URL]"), (X.HASH, "[COMMIT_ID]")):
        c = f"regexp_replace({c}, '{_q(pattern)}', '{to}', 'g')"
    return c


SQL = {
    "x1_field_audit": f"with {_AUDIT} select record, field, field_category, value_category, final_category, {_ACTION} as action from b",
    "x2_value_categories": f"with {_AUDIT} select field, value_category, count(*) n from b group by all",
    "a30_leakage_share": f"with {_AUDIT} select final_category, count(*) n, array_to_string(list_sort(list(distinct field)), ';') fields from b group by 1",
    "x5_provenance_mask": _masked(f"{_route('author')} or {_route('title')} or {_route('text')}"),
    "x6_hash_lists": _masked(f"{_route('commit')} or {_route('commit_list')} or {_route('pr')}"),
    "x8_router": _masked("true"),
    "x9_entities": f"with {_BODIES}, {_entities('bodies', 'record_id')} select * from ent",
    "x9_replaced": f"with {_BODIES}, {_entities('bodies', 'record_id')} select record_id, md5(t) body from rep",
    "x14_node_rewrite": f"with {_X14} select * from x14",
    "x18_literals": f"select entity_id, md5({_inside('source')}) rewritten from code_entities_full where source is not null",
    "x21_residuals": f"with {_RES} select * from res",
    "a38_residual_counts": f"with {_RES} select pattern_type, severity, count(*) n from res group by all",
    "x27_pii_scan": "select file, " + ", ".join(f"coalesce(len(list_distinct(regexp_extract_all(t, '(?i){_q(p)}', 0))), 0)::int {n}" for n, p in Z.PERSONAL.items()) + " from (select 'p' || record_id::varchar file, body t from pull_requests union all select 'c' || entity_id::varchar, source from code_entities_full)",
    "x28_redacted_attributes": f"with {_FIELDS}, a as (select *, regexp_matches(lower(substr(field, 7)), 'token|secret|password|passwd|hash|api_?key|access_?key|private_?key|credential') k, regexp_matches(value, '{SENSITIVE_VALUE}') v from fields where starts_with(field, 'attrs.') and value is not null) select record, '$.' || field as path, case when k then 'key' else 'value' end reason, '[REDACTED]' as value from a where k or v",
    "x30_registry": f"with {_FIELDS}, m as (select author_name as name from commits_sample where author_name is not null group by 1 order by count(*) desc, author_name desc limit 1) select record, field, name from fields, m where contains(value, name)",
    "a39_type_distribution": f"with {_X14}, b as (select coalesce(nullif(node_type, ''), 'UNKNOWN') as type, count(*) n from (select distinct id, node_type from nodes where id is not null) group by 1), a as (select coalesce(nullif(split_part(new_id, ':', 1), ''), 'UNKNOWN') as type, count(*) n from x14 group by 1) select coalesce(b.type, a.type) as type, coalesce(b.n, 0) \"before\", coalesce(a.n, 0) \"after\" from b full join a on a.type = b.type",
    "f12_false_positives": f"with {_BODIES}, {_entities('bodies', 'record_id')} select entity_type, false_positive, count(*) n, count(distinct entity) entities from ent group by 1, 2",
}
