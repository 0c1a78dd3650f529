"""Queries of the identifier map and of rewriting source text with it."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphmill.functions import text as X
from graphmill.operators import privacy as P
from graphmill.operators import rewrite as R
from graphmill.operators.graph import slashed
from graphmill.session import cut
from graphmill.sources import load


def _code(spark, sf):
    return load(spark, sf, "code_entities_full")


def _known(spark, sf):
    return cut(R.identifier_map(R.identifiers(_code(spark, sf))))


def _sources(spark, sf):
    return _code(spark, sf).where("source is not null").select("entity_id", slashed(F.col("relpath")).alias("file"), "source")


def x11_placeholders(spark, sf):
    """Placeholders of every kind: functions numbered without roles, files by place, modules by depth, packages, parameters, and the typed ids of nodes."""
    found = R.identifiers(_code(spark, sf)).withColumn("prefix", F.when(F.col("kind") == "function", "func_").otherwise(F.col("prefix")))
    return R.identifier_map(found)


def x17_rewrite(spark, sf):
    """Every source with functions, classes and parameters replaced word by word, and how many of each kind of change."""
    return R.rewritten_words(_sources(spark, sf).drop("file"), "entity_id", "source", _known(spark, sf)).select("entity_id", F.md5("source").alias("rewritten"), *R.CHANGES)


def a31_replacements(spark, sf):
    """Changes by kind and file."""
    done = R.rewritten_words(_sources(spark, sf), "entity_id", "source", _known(spark, sf))
    return done.select("file", *(F.col(c).cast("long").alias(c) for c in R.CHANGES)).unpivot(["file"], list(R.CHANGES), "change_type", "n").groupBy("file", "change_type").agg(F.sum("n").alias("n")).where("n > 0")


def _contributors(spark, sf):
    return load(spark, sf, "commits_sample").where("author_name is not null").select(F.col("author_name").alias("name"))


def x19_pipeline(spark, sf):
    done = R.sanitized_sources(_sources(spark, sf).drop("file"), "entity_id", "source", _known(spark, sf), _contributors(spark, sf))
    return done.select("entity_id", F.md5("source").alias("rewritten"))


def _typed_secrets(text):
    for words, token in SECRET_TOKENS:
        text = F.regexp_replace(text, SECRET_OF.replace("WORDS", words), f"$1$2{token}")
    return text


#: The token of each kind of secret.
SECRET_TOKENS = (("api_?key", "[API_KEY]"), ("access_?key", "[ACCESS_KEY]"), ("auth_?token|token", "[AUTH_TOKEN]"), ("private_?key", "[PRIVATE_KEY]"), ("secret|passwd|password", "[SECRET]"))
SECRET_OF = r"(?i)\b(WORDS)(\s*[=:]\s*)[\"'][^\"'\n]{4,}[\"']"


def x20_snippets(spark, sf):
    """Snippets with typed secret tokens, imports, names, calls and literals replaced; their node and path by placeholders."""
    known = _known(spark, sf)
    s = load(spark, sf, "code_snippets").select("snippet_id", F.substring_index("node_id", ".", -1).alias("short"), slashed(F.col("path")).alias("path"), _typed_secrets(F.col("snippet")).alias("snippet"))
    imports = R.rewritten_imports(s, "snippet_id", "snippet", known.where("kind = 'module'").select("name", "placeholder"))
    words = R.rewritten_words(imports, "snippet_id", "snippet", known).drop(*R.CHANGES)
    of = lambda kind, col: known.where(F.col("kind") == kind).select(F.col("name").alias(col), F.col("placeholder").alias(f"{col}_to"))
    named = words.join(of("function", "short"), "short", "left").join(of("file", "path"), "path", "left")
    return named.select("snippet_id", F.coalesce("short_to", "short").alias("node"), F.coalesce("path_to", "path").alias("path"), F.md5(X.mask_inside(F.col("snippet"))).alias("rewritten"))


QUERIES = {
    "x11_placeholders": x11_placeholders,
    "x16_role_counters": lambda s, d: R.identifier_map(R.identifiers(_code(s, d))),
    "x17_rewrite": x17_rewrite,
    "x19_pipeline": x19_pipeline,
    "x20_snippets": x20_snippets,
    "a31_replacements": a31_replacements,
}

_q = lambda s: s.replace("'", "''")
_ROLEVALUES = ", ".join(f"('{w}', '{r}', {i})" for i, (r, ws) in enumerate(P.ROLES.items()) for w in ws)
_PREFIX = "case when contains(name, 'test') then 'test' when starts_with(name, 'dags/') then 'dags' when starts_with(name, 'cloudrun/') then 'deploy' when contains(name, 'src/') then 'src' when contains(name, 'config') then 'config' when contains(name, 'data') then 'data' else 'file' end"
_FOUND = rf"""nm as (select entity_id, list_last(string_split(name, '.')) as name from code_entities_full where kind in ('function', 'method') and name is not null),
dn as (select distinct name from nm), k(word, role, ro) as (values {_ROLEVALUES}), w as (select name, unnest(ws) word, generate_subscripts(ws, 1) pos from (select name, regexp_split_to_array(lower(regexp_replace(name, '([a-z0-9])([A-Z])', '\1_\2', 'g')), '[_. ]+') ws from dn)),
h as (select name, role, ro, count(*) n, min(pos) f from w join k using (word) group by 1, 2, 3), b as (select name, role, row_number() over (partition by name order by n desc, f, ro) r from h), rl as (select dn.name, coalesce(role, 'utility') role from dn left join b on b.name = dn.name and r = 1),
fp as (select entity_id, replace(relpath, '\', '/') p from code_entities_full where relpath is not null),
found as (select 'function' kind, FUNCTION_PREFIX prefix, name, min(entity_id) seen, '' ext from nm join rl using (name) where name <> '' group by name, role
 union all select 'class', 'class_', list_last(string_split(name, '.')) n, min(entity_id), '' from code_entities_full where kind = 'class' and name is not null and name <> '' group by n
 union all select 'parameter', 'param_', p, min(entity_id), '' from (select entity_id, regexp_extract(unnest(string_split(regexp_replace(sig, '^\(|\)$', '', 'g'), ',')), '^\s*\*{{0,2}}([A-Za-z_][A-Za-z0-9_]*)', 1) p from code_entities_full where sig is not null) where p not in ('', {", ".join(f"'{x}'" for x in R.PARAMETER_STOP)}) group by p
 union all select 'module', 'module_l' || len(string_split(m, '.'))::varchar || '_', m, min(entity_id), '' from (select entity_id, replace(regexp_replace(regexp_replace(p, '\.py$', ''), '/__init__$', ''), '/', '.') m from fp where ends_with(p, '.py')) where m <> '' group by m
 union all select 'package', 'pkg_', split_part(p, '/', 1) g, min(entity_id), '' from fp where contains(p, '/') and split_part(p, '/', 1) <> '' group by g
 union all select 'file', {_PREFIX} || '_file_', name, min(entity_id), regexp_extract(name, '(\.[A-Za-z0-9]+)$', 1) from (select entity_id, p as name from fp) where name <> '' group by name),
known as (select kind, name, prefix || case when n < 1000 then lpad(n::varchar, 3, '0') else n::varchar end || ext placeholder from (select *, row_number() over (partition by prefix order by seen, name) n from found))"""
ROLED_SQL, _PLAIN = _FOUND.replace("FUNCTION_PREFIX", "role || '_func_'"), _FOUND.replace("FUNCTION_PREFIX", "'func_'")
_NAMES3 = "nt as (select name, max(case when kind = 'function' then placeholder end) f, max(case when kind = 'class' then placeholder end) c, max(case when kind = 'parameter' then placeholder end) p from known where kind in ('function', 'class', 'parameter') group by 1)"


def _rewritten(src: str, key: str) -> str:
    """CTEs up to ``out`` (key, t, counts): the words of src (key, t) replaced."""
    return rf"""{_NAMES3}, tok as (select {key}, unnest(l) w, generate_subscripts(l, 1) i from (select {key}, regexp_extract_all(t, '{R.WORD_OR_GAP}', 0) l from {src} where t is not null)),
ctx as (select *, lag(w, 2) over z b2, lag(w) over z b1, lead(w) over z a1 from tok window z as (partition by {key} order by i)),
chg as (select ctx.*, f, c, p, case when f is not null and b2 = 'def' and regexp_matches(b1, '^[ \t]+$') and regexp_matches(coalesce(a1, ''), '^[ \t]*\(') then 'function_def' when f is not null and regexp_matches(coalesce(a1, ''), '^[ \t]*\(') then 'function_call' when f is not null then 'standalone' when c is not null and b2 = 'class' and regexp_matches(b1, '^[ \t]+$') then 'class_def' when p is not null and length(w) > 2 then 'parameter' end ch from ctx left join nt on nt.name = w),
outs as (select {key}, string_agg(case ch when 'class_def' then c when 'parameter' then p when 'function_def' then f when 'function_call' then f when 'standalone' then f else w end, '' order by i) t, {', '.join(f"count(*) filter (ch = '{c}')::int {c}" for c in R.CHANGES)} from chg group by 1),
out as (select s.{key}, coalesce(outs.t, s.t) t, {', '.join(f'coalesce({c}, 0) {c}' for c in R.CHANGES)} from {src} s left join outs using ({key}))"""


def _imports(src: str, key: str) -> str:
    """CTEs up to ``imp`` (key, t): module paths of import lines replaced."""
    dotted = r"[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*"
    return rf"""ln as (select {key}, unnest(l) line, generate_subscripts(l, 1) li from (select {key}, string_split(t, chr(10)) l from {src} where t is not null)),
pc as (select {key}, li, unnest(l) piece, generate_subscripts(l, 1) pi from (select {key}, li, regexp_extract_all(line, '{dotted}|[^A-Za-z_]+', 0) l from ln where regexp_matches(line, '^[ \t]*(?:import|from)[ ]'))),
dd as (select distinct piece from pc where regexp_matches(piece, '^[A-Za-z_]')), md as (select name, placeholder from known where kind = 'module'),
sw as (select piece, placeholder || substr(piece, length(name) + 1) r from (select piece, name, placeholder, row_number() over (partition by piece order by length(name) desc) k from dd join md on piece = name or starts_with(piece, name || '.')) where k = 1),
il as (select {key}, li, string_agg(coalesce(r, piece), '' order by pi) line from pc left join sw using (piece) group by 1, 2),
imp as (select {key}, string_agg(coalesce(il.line, ln.line), chr(10) order by ln.li) t from ln left join il using ({key}, li) group by 1 union all select {key}, null from {src} where t is null)"""


def _inside(c: str) -> str:
    for pattern, to in ((X.SECRET_ASSIGNMENT, r"\1\2[SECRET]"), (X.EMAIL, "[EMAIL]"), (X.CODE_HOST, "[REPO_URL]"), (X.URL, "[URL]"), (X.HASH, "[COMMIT_ID]")):
        c = f"regexp_replace({c}, '{_q(pattern)}', '{to}', 'g')"
    return c


_snip = "snippet"
for _w, _t in SECRET_TOKENS:
    _snip = f"regexp_replace({_snip}, '{_q(SECRET_OF.replace('WORDS', _w))}', '\\1\\2{_t}', 'g')"
_SRC = "src as (select entity_id, source t from code_entities_full where source is not null)"
_BLANKS = r"[^\s,;:()<>\"''\[\]{}=#]+"
_MASKED = rf"""lit as (select entity_id, {_inside('t')} t from out), ws as (select entity_id, regexp_extract_all(lower(t), '{_BLANKS}', 0) w from lit), runs as (select entity_id, unnest(w) r from ws union select entity_id, unnest(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) from ws where len(w) > 1 union select entity_id, unnest(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) from ws where len(w) > 2),
cn as (select distinct lower(trim(author_name)) r from commits_sample where length(trim(author_name)) > 2), hit as (select entity_id, list(r order by -length(r), r) l from runs join cn using (r) group by 1),
fin as (select entity_id, case when l is null then t else list_reduce(list_prepend(t, l), lambda a, n: regexp_replace(a, '(?i)\b' || regexp_escape(n) || '\b', '[CONTRIBUTOR]', 'g')) end t from lit left join hit using (entity_id))"""
SQL = {
    "x11_placeholders": f"with {_PLAIN} select kind, name, placeholder from known",
    "x16_role_counters": f"with {ROLED_SQL} select kind, name, placeholder from known",
    "x17_rewrite": f"with {ROLED_SQL}, {_SRC}, {_rewritten('src', 'entity_id')} select entity_id, md5(t) rewritten, {', '.join(R.CHANGES)} from out",
    "a31_replacements": f"with {ROLED_SQL}, {_SRC}, {_rewritten('src', 'entity_id')}, j as (select replace(relpath, '\\', '/') file, out.* from out join code_entities_full using (entity_id)), u as (" + " union all ".join(f"select file, '{c}' change_type, {c}::bigint n from j" for c in R.CHANGES) + ") select file, change_type, sum(n)::bigint n from u group by 1, 2 having sum(n) > 0",
    "x19_pipeline": f"with {ROLED_SQL}, {_SRC}, {_imports('src', 'entity_id')}, {_rewritten('imp', 'entity_id')}, {_MASKED} select entity_id, md5(t) rewritten from fin",
    "x20_snippets": f"with {ROLED_SQL}, src as (select snippet_id, {_snip} t from code_snippets), {_imports('src', 'snippet_id')}, {_rewritten('imp', 'snippet_id')}, s as (select snippet_id, list_last(string_split(node_id, '.')) short, replace(path, '\\', '/') path from code_snippets) select snippet_id, coalesce(a.placeholder, short) node, coalesce(b.placeholder, path) path, md5({_inside('t')}) rewritten from out join s using (snippet_id) left join known a on a.kind = 'function' and a.name = short left join known b on b.kind = 'file' and b.name = path",
}
