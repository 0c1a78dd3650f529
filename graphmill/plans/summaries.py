"""Queries of prompts and their parts, of normalized predictions and of their scores."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from graphmill.functions import text as X
from graphmill.operators import evaluation as E
from graphmill.operators import graph as G
from graphmill.operators import resolve as V
from graphmill.sources import load
from graphmill.sources.knowledge import nodes

TOKEN_BUDGET, DOC_CHARS, CODE_CHARS, LISTED = 250, 400, 800, 10
MAX_LINES, CONTEXT = 20, 2
INSTRUCTIONS = "Generate a concise summary for the above function.\n- Provide a one-line purpose summary.\n- Provide 3 bullets: purpose, inputs and outputs, side effects.\n- State uncertainty explicitly."
#: Sequences that come from reading text in the wrong encoding.
GARBLED = (("’", "'"), ("â€™", "'"), ("â€œ", '"'), ("â€\x9d", '"'))
#: Modules that are never renamed, by full path or by root, and parameters that are skipped.
STOP_MODULES = tuple(
    "os sys re ast csv json math time datetime pathlib shutil copy collections itertools functools typing pickle io abc logging warnings unittest pytest argparse hashlib subprocess threading multiprocessing contextlib dataclasses enum struct string random statistics tempfile "
    "numpy pandas scipy sklearn matplotlib seaborn plotly statsmodels xgboost lightgbm catboost tensorflow torch keras transformers cv2 PIL skimage mlflow airflow dvc wandb ray prefect luigi kedro boto3 botocore google azure flask fastapi django requests urllib paramiko fabric docker "
    "sqlalchemy psycopg2 pymongo redis sqlite3 yaml toml dotenv click typer loguru tqdm joblib dill mock hypothesis os.path sklearn.preprocessing sklearn.decomposition sklearn.cluster sklearn.metrics sklearn.model_selection matplotlib.pyplot matplotlib.colors pandas.core numpy.linalg".split()
)
STOP_PARAMETERS = tuple(
    "self cls args kwargs path data file df result output input value key index name type x y z i j k n m col row val var obj msg err exc e ex config params arg opt mode flag size length width height count num idx pos src dst tmp buf ret res logger log level fmt sep end encoding errors newline delimiter".split()
)
#: Media type of each file ending.
MEDIA = {"py": "text/x-python", "json": "application/json", "xml": "application/xml", "yaml": "application/yaml", "yml": "application/yaml", "toml": "application/toml", "md": "text/markdown", "txt": "text/plain", "csv": "text/csv", "sh": "application/x-sh", "html": "text/html", "js": "text/javascript"}


@F.pandas_udf(StringType())
def _composed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def normalized(text):
    """NFC (only what is not plain goes through Python) and garbled sequences repaired."""
    out = F.when(text.rlike(r"[^\x00-\x7F]"), _composed(text)).otherwise(text)
    for a, b in GARBLED:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def first_sentences(text):
    """The first two sentences of a text whose heading marks, bullets and line ends are taken away."""
    lines = F.split(F.regexp_replace(F.regexp_replace(text, r"^\s*[*#=-]+\s*", ""), "\r", "\n"), "\n")
    kept = F.filter(F.transform(lines, lambda x: F.regexp_replace(x, r"^[ \t•-]+|[ \t•-]+$", "")), lambda x: F.trim(x) != "")
    sentences = F.split(F.regexp_replace(F.array_join(kept, " "), r"([.!?])\s+", "$1\u0001"), "\u0001")
    return X.single_spaced(F.array_join(F.slice(sentences, 1, 2), " "))


def _requests(spark, sf):
    """Requests as generated records: title as one-liner, messages of their commits as bullets, body as raw output."""
    bullets = F.filter(F.transform(F.coalesce("commits", F.array().cast("array<struct<sha:string,message_head:string>>")), lambda c: c["message_head"]), lambda m: m.isNotNull() & (m != ""))
    return load(spark, sf, "pull_requests").select("record_id", "number", F.col("title").alias("one_liner"), bullets.alias("bullets"), F.col("body").alias("raw"))


def pj13_normalized(spark, sf):
    joined = F.array_join("bullets", " ")
    one = F.trim("one_liner")
    text = F.when((one != "") & ~one.startswith("**"), X.single_spaced(F.col("one_liner"))).when(F.trim(joined) != "", first_sentences(joined)).when(F.trim("raw") != "", first_sentences(F.col("raw"))).otherwise("")
    return _requests(spark, sf).select("record_id", normalized(text).alias("text"))


def _payload(spark, sf):
    """(snippet_id, node_id, header, ast, graph, docs, code) of each snippet."""
    s = load(spark, sf, "code_snippets").select("snippet_id", "node_id", "path", "snippet")
    sigs = load(spark, sf, "code_entities_full").where("sig is not null and name is not null").groupBy(F.substring_index("name", ".", -1).alias("short")).agg(F.min(F.struct("entity_id", "sig"))["sig"].alias("sig"))
    listed = load(spark, sf, "retrieval_debug").where("node_id is not null and label is not null and category in ('callers', 'callees', 'same_file', 'docs')").select("node_id", "category", "label", "retrieval_id")
    best = V.top_k(listed, ["node_id", "category"], [F.col("retrieval_id")], LISTED)
    of = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col("category") == c, F.struct("rank", "label")))), lambda x: x["label"])
    around = best.groupBy("node_id").agg(*(of(c).alias(c) for c in ("callers", "callees", "same_file", "docs")))
    line = lambda title, c: F.when(F.size(c) > 0, F.concat(F.lit(f"{title}: "), F.array_join(c, ", ")))
    joined = s.withColumn("short", F.substring_index("node_id", ".", -1)).join(sigs, "short", "left").join(around, "node_id", "left")
    header = F.concat_ws("\n", F.concat(F.lit("Node: "), F.coalesce("node_id", F.lit("None"))), F.concat(F.lit("Path: "), F.coalesce("path", F.lit("None"))), F.concat(F.lit("Signature: "), F.col("sig")))
    names = F.filter(F.transform(F.split(F.regexp_replace("sig", r"^\(|\)$", ""), ","), lambda p: F.regexp_extract(p, r"^\s*(\*{0,2}[A-Za-z_][A-Za-z0-9_]*)", 1)), lambda p: p != "")
    tree = F.concat_ws("\n", F.concat(F.lit("AST signature: "), F.col("sig")), F.when(F.size(names) > 0, F.concat(F.lit("Parameters: "), F.array_join(names, ", "))))
    graph = F.concat_ws("\n", line("Callers", "callers"), line("Callees", "callees"), line("Same-file neighbors", "same_file"))
    docs = F.coalesce(F.array_join("docs", "\n\n"), F.lit(""))
    return joined.select("snippet_id", "node_id", header.alias("header"), tree.alias("ast"), graph.alias("graph"), X.truncated(docs, DOC_CHARS).alias("docs"), X.truncated(F.coalesce("snippet", F.lit("")), CODE_CHARS).alias("code"))


def _assembled(docs, code):
    part = lambda title, c: F.when(c != "", F.concat(F.lit(f"\n### {title}\n\n"), c))
    return F.concat_ws("\n\n", F.concat(F.lit("### HEADER\n\n"), F.col("header")), part("AST SUMMARY", F.col("ast")), part("GRAPH CONTEXT", F.col("graph")), part("DOC EXCERPTS", docs), part("CODE SNIPPET", code), F.lit(f"\n### INSTRUCTIONS\n\n{INSTRUCTIONS}"))


def _prompts(spark, sf):
    """Payloads with their text and estimated tokens; over the budget documents and code are cut to half their room and the text assembled once more."""
    p = _payload(spark, sf)
    whole = _assembled(F.col("docs"), F.col("code"))
    half = _assembled(X.truncated(F.col("docs"), DOC_CHARS // 2), X.truncated(F.col("code"), CODE_CHARS // 2))
    p = p.withColumn("text", F.when(X.estimated_tokens(whole) > TOKEN_BUDGET, half).otherwise(whole))
    return p.withColumn("est_tokens", X.estimated_tokens(F.col("text")))


def f15_payload_errors(spark, sf):
    """Seven rules on each payload, as the list of those it breaks."""
    rules = [
        F.when(F.coalesce("node_id", F.lit("")) == "", "missing node_id"), F.when(F.trim("text") == "", "empty payload_text"), F.when(F.coalesce("est_tokens", F.lit(0)) <= 0, "bad est_tokens"), F.when(F.length(F.trim("code")) < 10, "snippet too small/empty"),
        F.when(~F.col("header").contains("Node:") | ~F.col("header").contains("Path:"), "header missing Node/Path"), F.when(F.trim("ast") == "", "ast_summary empty"), F.when(~F.lower("text").contains("one-line"), "instructions might be missing expected guidance"),
    ]
    return _prompts(spark, sf).select("snippet_id", F.array_join(F.array_compact(F.array(*rules)), ";").alias("errors"))


def pj20_snippets_by_span(spark, sf):
    """Lines of a module around the span its target names, trimmed if there are too many; the first lines where there is no span."""
    modules = load(spark, sf, "code_entities_full").where("kind = 'module' and source is not null and relpath is not null").groupBy(G.slashed(F.col("relpath")).alias("file")).agg(F.max(F.struct("indexed_at", "entity_id", "source"))["source"].alias("source"))
    targets = load(spark, sf, "target_ast_map").where("path is not null").select("map_id", G.slashed(F.col("path")).alias("file"), F.col("ast_start_line").alias("first"), F.col("ast_end_line").alias("last"))
    lines, total = F.col("lines"), F.size("lines")
    first = F.greatest(F.lit(1), F.col("first") - CONTEXT)
    count = F.least(total, F.col("last") + CONTEXT) - first + 1
    spanned = (F.col("first") >= 1) & (F.col("first") <= F.col("last")) & (F.col("last") <= total)
    whole = F.slice(lines, first, F.greatest(F.lit(0), count))
    lead = F.least(F.col("first") - 1, F.lit(CONTEXT))
    trimmed = F.slice(lines, F.greatest(F.lit(1), F.col("first") - CONTEXT), F.greatest(F.lit(0), lead + MAX_LINES - 2))
    kind = F.when(~F.coalesce(spanned, F.lit(False)), "top_lines").when(count <= MAX_LINES, "full_function").otherwise("trimmed")
    part = F.when(kind == "top_lines", F.slice(lines, 1, MAX_LINES)).when(kind == "full_function", whole).otherwise(trimmed)
    return targets.join(modules, "file").withColumn("lines", F.split("source", "\n")).select("map_id", kind.alias("snippet_type"), F.md5(F.array_join(part, "\n")).alias("snippet"))


def pj23_metadata(spark, sf):
    """Targets with the metadata of their entity, each field with its fallbacks."""
    t = load(spark, sf, "target_ast_map").select("map_id", "node_id", "path", "chosen_neighbor", "ast_start_line", "ast_end_line", "reason")
    e = load(spark, sf, "code_entities_full").where("entity_key is not null").groupBy("entity_key").agg(F.max(F.struct("indexed_at", "entity_id", "relpath", "sig", "name")).alias("e"))
    j = t.join(e, F.col("chosen_neighbor.id") == F.col("entity_key"), "left")
    text = lambda c: F.nullif(F.col(c), F.lit(""))
    return j.select("map_id", F.coalesce(text("chosen_neighbor.id"), "node_id").alias("node_id"), F.coalesce(text("e.relpath"), text("chosen_neighbor.path"), text("path")).alias("path"), F.coalesce(text("e.sig"), text("e.name"), text("chosen_neighbor.label")).alias("signature"), F.coalesce("chosen_neighbor.start_line", "ast_start_line").alias("start_line"), F.coalesce("chosen_neighbor.end_line", "ast_end_line").alias("end_line"), "reason")


def pj24_node_summary(spark, sf):
    """Compact node records: id, path, type, label and signature with fallbacks."""
    n = nodes(spark, sf).where("id is not null").select("id", "path", "node_type", "label", "qualified_name").distinct()
    text = lambda c: F.nullif(F.col(c), F.lit(""))
    return n.select("id", F.coalesce(text("path"), F.when(F.col("id").startswith("File:"), F.substring("id", 6, 10_000))).alias("path"), F.coalesce(text("node_type"), F.when(text("qualified_name").isNotNull(), "Function").otherwise("File")).alias("node_type"), F.coalesce(text("label"), text("qualified_name"), "id").alias("label"), F.coalesce(text("qualified_name"), text("label")).alias("signature"))


def f11_stop_names(spark, sf):
    """Modules of both import forms and parameters that may be renamed: none of the stop names, whose root is none either."""
    code = load(spark, sf, "code_entities_full")
    modules = code.where("source is not null").select(F.explode(F.regexp_extract_all("source", F.lit(r"(?m)^[ \t]*(?:import|from)[ ]+([A-Za-z_][A-Za-z0-9_.]*)"), F.lit(1))).alias("name")).where(~F.col("name").isin(*STOP_MODULES) & ~F.substring_index("name", ".", 1).isin(*STOP_MODULES)).select(F.lit("module").alias("kind"), "name")
    parameters = code.where("sig is not null").select(F.explode(F.split(F.regexp_replace("sig", r"^\(|\)$", ""), ",")).alias("p")).select(F.lit("parameter").alias("kind"), F.regexp_extract("p", r"^\s*\*{0,2}([A-Za-z_][A-Za-z0-9_]*)", 1).alias("name")).where((F.col("name") != "") & ~F.col("name").isin(*STOP_PARAMETERS))
    return modules.unionByName(parameters).groupBy("kind", "name").agg(F.count("*").alias("n"))


def s15_file_index(spark, sf):
    """Files with category, media type and their first twenty lines."""
    ending = F.lower(F.regexp_extract("relpath", r"\.([A-Za-z0-9]+)$", 1))
    category = F.when(ending == "py", "code").when(ending.isin("yaml", "yml", "json", "toml", "ini", "xml", "env"), "config").when(ending.isin("md", "txt"), "docs").otherwise("other")
    media = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in MEDIA.items() for x in kv)), ending), F.lit("application/octet-stream"))
    sample = F.array_join(F.slice(F.split(F.coalesce("source", F.lit("")), "\n"), 1, 20), "\n")
    return load(spark, sf, "code_entities_full").where("relpath is not null").select("entity_id", category.alias("category"), media.alias("mime"), F.md5(sample).alias("sample"))


def _predictions(spark, sf):
    """Titles of requests as predictions of their commits' messages, of which the first is the first reference."""
    p = load(spark, sf, "pull_requests").where("size(commits) > 0 and number is not null").groupBy("number").agg(F.min(F.struct("record_id", "title", F.transform("commits", lambda c: c["message_head"]).alias("m"))).alias("b"))
    return p.select(F.col("number").alias("id"), F.col("b.title").alias("prediction"), F.col("b.m").alias("references"), F.get("b.m", F.lit(0)).alias("reference"))


def e7_per_node(spark, sf):
    rows = E.per_node(_predictions(spark, sf))
    return rows.select("id", *(F.round(c, 6).alias(c) for c in rows.columns if c != "id"))


QUERIES = {
    "pj13_two_sentences": pj13_normalized,
    "pj14_prediction_text": lambda s, d: _requests(s, d).select("record_id", F.coalesce(F.nullif("one_liner", F.lit("")), F.nullif(F.array_join("bullets", " "), F.lit("")), F.col("raw"), F.lit("")).alias("text")),
    "pj19_payload": lambda s, d: _prompts(s, d).select("snippet_id", F.md5("text").alias("payload"), "est_tokens"),
    "f15_payload_errors": f15_payload_errors,
    "pj20_snippets_by_span": pj20_snippets_by_span,
    "pj23_metadata": pj23_metadata,
    "pj24_node_summary": pj24_node_summary,
    "f11_stdlib_blocklist": f11_stop_names,
    "s15_file_index": s15_file_index,
    "a33_kind_counts": lambda s, d: s15_file_index(s, d).groupBy("category", "mime").agg(F.count("*").alias("n")),
    "e1_token_overlap": lambda s, d: E.token_overlap(_predictions(s, d)).join(E.lengths(_predictions(s, d)), "id").select("id", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")), "pred_len_tokens", "ref_len_tokens", "pred_len_chars", "ref_len_chars"),
    "e1_summary": lambda s, d: E.lexical_summary(_predictions(s, d)),
    "e2_bleu": lambda s, d: E.corpus_bleu(_predictions(s, d)),
    "e3_chrf": lambda s, d: E.corpus_chrf(_predictions(s, d)),
    "e4_rouge1": lambda s, d: E.rouge_n(_predictions(s, d), 1).select("id", F.round("f", 6).alias("f")),
    "e4_rouge2": lambda s, d: E.rouge_n(_predictions(s, d), 2).select("id", F.round("f", 6).alias("f")),
    "e4_rouge1_stemmed": lambda s, d: E.rouge_n(_predictions(s, d), 1, stems=True).select("id", F.round("f", 6).alias("f")),
    "e5_sequence_scores": lambda s, d: E.sequence_scores(_predictions(s, d)),
    "e7_per_node": e7_per_node,
    "e7_summary": lambda s, d: E.summary(_predictions(s, d)),
    "e8_jaccard": lambda s, d: E.fill(_predictions(s, d)).select("id", F.round(X.jaccard(X.tokens(F.col("prediction")), X.tokens(F.col("reference"))), 6).alias("jaccard")),
}

_q = lambda s: s.replace("'", "''")
_last = lambda c: f"list_last(string_split({c}, '.'))"
_slash = lambda c: f"replace({c}, '\\', '/')"
_in = lambda values: ", ".join(f"'{v}'" for v in values)
_REQ = "rq as (select record_id, number, title one_liner, coalesce(list_filter(list_transform(commits, lambda c: c.message_head), lambda m: m is not null and m <> ''), []) bullets, body raw from pull_requests)"
_first = lambda t: rf"trim(regexp_replace(array_to_string(list_slice(string_split(regexp_replace(array_to_string(list_filter(list_transform(string_split(replace(regexp_replace({t}, '^\s*[*#=-]+\s*', ''), chr(13), chr(10)), chr(10)), lambda x: regexp_replace(x, '^[ \t•-]+|[ \t•-]+$', '', 'g')), lambda x: trim(x) <> ''), ' '), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), 1, 2), ' '), '\s+', ' ', 'g'))"


def _normal(t: str) -> str:
    t = f"nfc_normalize({t})"
    for a, b in GARBLED:
        t = f"replace({t}, '{_q(a)}', '{_q(b)}')"
    return t


_est = lambda c: f"case when coalesce(length({c}), 0) = 0 then 0 else greatest(1, floor(length({c}) / 4)) end::int"


def _trunc(t: str, n: int) -> str:
    head = f"left({t}, {n})"
    back = f"(length({head}) - length(list_last(string_split({head}, chr(10)))) - 1)"
    return f"case when length({t}) <= {n} then {t} when contains({head}, chr(10)) and {back} > {0.6 * n} then left({t}, {back}) else {head} end"


_join = lambda *parts: f"concat_ws(chr(10) || chr(10), {', '.join(parts)})"


def _asm(docs: str, code: str) -> str:
    part = lambda title, c: f"case when ({c}) <> '' then chr(10) || '### {title}' || chr(10) || chr(10) || ({c}) end"
    ins = " || chr(10) || ".join(f"'{x}'" for x in INSTRUCTIONS.split("\n"))
    return _join("'### HEADER' || chr(10) || chr(10) || header", part("AST SUMMARY", "ast"), part("GRAPH CONTEXT", "graph"), part("DOC EXCERPTS", docs), part("CODE SNIPPET", code), f"chr(10) || '### INSTRUCTIONS' || chr(10) || chr(10) || {ins}")


_PAY = rf"""sg as (select short, sig from (select {_last('name')} short, sig, row_number() over (partition by {_last('name')} order by entity_id) r from code_entities_full where sig is not null and name is not null) where r = 1),
ls as (select node_id, category, label, row_number() over (partition by node_id, category order by retrieval_id) r from retrieval_debug where node_id is not null and label is not null and category in ('callers', 'callees', 'same_file', 'docs')),
ar as (select node_id, {", ".join(f"array_to_string(list(label order by r) filter (category = '{c}'), '{s}') {c}" for c, s in (('callers', ', '), ('callees', ', '), ('same_file', ', ')))}, array_to_string(list(label order by r) filter (category = 'docs'), chr(10) || chr(10)) docs from ls where r <= {LISTED} group by 1),
pn as (select s.*, sig, callers, callees, same_file, docs, list_filter(list_transform(string_split(regexp_replace(sig, '^\(|\)$', '', 'g'), ','), lambda p: regexp_extract(p, '^\s*(\*{{0,2}}[A-Za-z_][A-Za-z0-9_]*)', 1)), lambda p: p <> '') ps from code_snippets s left join sg on sg.short = {_last('s.node_id')} left join ar on ar.node_id = s.node_id),
pw as (select snippet_id, node_id, concat_ws(chr(10), 'Node: ' || coalesce(node_id, 'None'), 'Path: ' || coalesce(path, 'None'), 'Signature: ' || sig) header, concat_ws(chr(10), 'AST signature: ' || sig, case when len(ps) > 0 then 'Parameters: ' || array_to_string(ps, ', ') end) ast, concat_ws(chr(10), 'Callers: ' || callers, 'Callees: ' || callees, 'Same-file neighbors: ' || same_file) graph, coalesce(docs, '') d0, coalesce(snippet, '') c0 from pn),
py as (select snippet_id, node_id, header, ast, graph, {_trunc('d0', DOC_CHARS)} docs, {_trunc('c0', CODE_CHARS)} code from pw),
pz as (select *, {_asm('docs', 'code')} whole from py), pt as (select *, case when {_est('whole')} > {TOKEN_BUDGET} then {_asm(_trunc('docs', DOC_CHARS // 2), _trunc('code', CODE_CHARS // 2))} else whole end t from pz), pp as (select *, {_est('t')} est_tokens from pt)"""
_split = lambda c: f"list_filter(regexp_split_to_array(lower({c}), '\\s+'), lambda t: t <> '')"
_PREDS = "pr as (select number id, coalesce(title, '') p, coalesce(commits[1].message_head, '') r, list_transform(commits, lambda c: coalesce(c.message_head, '')) refs from (select *, row_number() over (partition by number order by record_id) k from pull_requests where len(commits) > 0 and number is not null) where k = 1)"
_SETS = f"{_PREDS}, st as (select *, list_distinct({_split('p')}) pd, list_distinct({_split('r')}) rd from pr), o as (select *, len(pd) np, len(rd) nr, len(list_intersect(pd, rd)) n from st), ov as (select id, p pt, r rt, case when np = 0 and nr = 0 then 1.0 when np = 0 or nr = 0 then 0.0 else n / np end::double p, case when np = 0 and nr = 0 then 1.0 when np = 0 or nr = 0 then 0.0 else n / nr end::double r from o)"
_F1 = "coalesce(2 * p * r / nullif(p + r, 0), 0)"
_LEN = f"len({_split('pt')})::int pred_len_tokens, len({_split('rt')})::int ref_len_tokens, length(pt)::int pred_len_chars, length(rt)::int ref_len_chars"
_grams = lambda c, n: f"case when len({c}) >= {n} then list_transform(generate_series(1, len({c}) - {n - 1}), lambda i: array_to_string(list_slice({c}, i, i + {n - 1}), ' ')) else [] end"


def _overlaps(orders) -> str:
    """CTE ``ovl`` (id, n, m, t, r) from ``tk`` (id, p, refs: lists of words)."""
    mine = " union all ".join(f"select id, {n} n, -1 side, unnest({_grams('p', n)}) g from tk" for n in orders)
    theirs = " union all ".join(f"select id, {n} n, side, unnest({_grams('ref', n)}) g from rf" for n in orders)
    return f"rf as (select id, unnest(refs) ref, generate_subscripts(refs, 1) side from tk), ea as (select id, n, side, g, count(*) c from ({mine} union all {theirs}) group by all), gr as (select id, n, g, max(case when side = -1 then c else 0 end) own, max(case when side > 0 then c else 0 end) best, max(case when side = 1 then c else 0 end) frst from ea group by all), ovl as (select id, n, sum(least(own, best)) m, sum(own) t, sum(frst) r from gr group by all)"


def _t13(c: str) -> str:
    for a, b in (("'<skipped>'", "''"), ("'-' || chr(10)", "''"), ("chr(10)", "' '"), ("'&quot;'", "'\"'"), ("'&amp;'", "'&'"), ("'&lt;'", "'<'"), ("'&gt;'", "'>'")):
        c = f"replace({c}, {a}, {b})"
    c = f"(' ' || {c} || ' ')"
    for pattern, to in E.TOKENS_13A:
        c = f"regexp_replace({c}, '{_q(pattern)}', '{to.replace('$', chr(92))}', 'g')"
    return f"list_filter(regexp_split_to_array({c}, '\\s+'), lambda t: t <> '')"


_sums = lambda most: ", ".join(f"coalesce(sum(m) filter (n = {n}), 0)::double m{n}, coalesce(sum(t) filter (n = {n}), 0)::double t{n}, coalesce(sum(r) filter (n = {n}), 0)::double r{n}" for n in range(1, most + 1))
_miss = lambda n: " + ".join(f"(m{k} = 0)::int" for k in range(1, n + 1))
_BLEU = f"with {_PREDS}, tk as (select id, {_t13('p')} p, list_transform(refs, lambda x: {_t13('x')}) refs from pr), {_overlaps(range(1, 5))}, ln as (select sum(len(p))::bigint plen, sum(list_min(list_transform(refs, lambda x: [abs(len(x) - len(p)), len(x)]))[2])::bigint rlen from tk), s as (select {_sums(4)} from ovl) select round(case when m1 > 0 then 100 * case when plen >= rlen then 1 else exp(1 - rlen / plen) end * exp(({' + '.join(f'ln(case when m{n} = 0 then 1.0 / pow(2, {_miss(n)}) else m{n} end / t{n})' for n in range(1, 5))}) / 4) else 0 end, 4) bleu, plen, rlen from s, ln"
_chars = lambda c: f"list_filter(string_split(regexp_replace({c}, '\\s+', '', 'g'), ''), lambda x: x <> '')"
_CHRF = f"with {_PREDS}, tk as (select id, {_chars('p')} p, [{_chars('r')}] refs from pr), {_overlaps(range(1, 7))}, s0 as (select {_sums(6)} from ovl), s as (select ({' + '.join(f'coalesce(m{n} / nullif(t{n}, 0), 0)' for n in range(1, 7))}) / 6 p, ({' + '.join(f'coalesce(m{n} / nullif(r{n}, 0), 0)' for n in range(1, 7))}) / 6 r from s0) select round(100 * coalesce(5 * p * r / nullif(4 * p + r, 0), 0), 4) chrf from s"
_words1 = lambda c: f"list_filter(regexp_split_to_array(lower(regexp_replace({c}, '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda t: t <> '')"
_rouge = lambda n: f"with {_PREDS}, tk as (select id, {_words1('p')} p, [{_words1('r')}] refs from pr), {_overlaps(range(n, n + 1))} select id, round(coalesce(2.0 * m / nullif(t + r, 0), 0)::double, 6) f from tk left join ovl using (id)"
_LEX = {"lex_precision": "p", "lex_recall": "r", "lex_f1": _F1, "avg_pred_len_tokens": f"len({_split('pt')})", "avg_ref_len_tokens": f"len({_split('rt')})", "avg_pred_len_chars": "length(pt)", "avg_ref_len_chars": "length(rt)"}
_EXT = r"lower(regexp_extract(relpath, '\.([A-Za-z0-9]+)$', 1))"
_INDEX = rf"ix as (select entity_id, case when e = 'py' then 'code' when e in ('yaml', 'yml', 'json', 'toml', 'ini', 'xml', 'env') then 'config' when e in ('md', 'txt') then 'docs' else 'other' end category, case e {' '.join(f"when '{k}' then '{v}'" for k, v in MEDIA.items())} else 'application/octet-stream' end mime, md5(array_to_string(list_slice(string_split(coalesce(source, ''), chr(10)), 1, 20), chr(10))) sample from (select *, {_EXT} e from code_entities_full where relpath is not null))"
_nn = lambda c: f"nullif({c}, '')"

SQL = {
    "pj13_two_sentences": rf"with {_REQ}, t as (select record_id, case when trim(one_liner) <> '' and not starts_with(trim(one_liner), '**') then trim(regexp_replace(one_liner, '\s+', ' ', 'g')) when trim(array_to_string(bullets, ' ')) <> '' then {_first("array_to_string(bullets, ' ')")} when trim(raw) <> '' then {_first('raw')} else '' end t from rq) select record_id, {_normal('t')} as text from t",
    "pj14_prediction_text": f"with {_REQ} select record_id, coalesce(nullif(one_liner, ''), nullif(array_to_string(bullets, ' '), ''), raw, '') as text from rq",
    "pj19_payload": f"with {_PAY} select snippet_id, md5(t) payload, est_tokens from pp",
    "f15_payload_errors": f"with {_PAY} select snippet_id, concat_ws(';', case when coalesce(node_id, '') = '' then 'missing node_id' end, case when trim(t) = '' then 'empty payload_text' end, case when coalesce(est_tokens, 0) <= 0 then 'bad est_tokens' end, case when length(trim(code)) < 10 then 'snippet too small/empty' end, case when not contains(header, 'Node:') or not contains(header, 'Path:') then 'header missing Node/Path' end, case when trim(ast) = '' then 'ast_summary empty' end, case when not contains(lower(t), 'one-line') then 'instructions might be missing expected guidance' end) errors from pp",
    "pj20_snippets_by_span": f"with m as (select file, string_split(source, chr(10)) l from (select {_slash('relpath')} file, source, row_number() over (partition by {_slash('relpath')} order by indexed_at desc nulls last, entity_id desc) r from code_entities_full where kind = 'module' and source is not null and relpath is not null) where r = 1), t as (select map_id, {_slash('path')} file, ast_start_line s, ast_end_line e from target_ast_map where path is not null), j as (select *, coalesce(s >= 1 and s <= e and e <= len(l), false) ok, greatest(1, s - {CONTEXT}) a, least(len(l), e + {CONTEXT}) b from t join m using (file)), k as (select *, case when not ok then 'top_lines' when b - a + 1 <= {MAX_LINES} then 'full_function' else 'trimmed' end snippet_type from j) select map_id, snippet_type, md5(array_to_string(case snippet_type when 'top_lines' then list_slice(l, 1, {MAX_LINES}) when 'full_function' then list_slice(l, a, b) else list_slice(l, a, s - 1) || list_slice(l, s, s - 1 + {MAX_LINES - 2}) end, chr(10))) snippet from k",
    "pj23_metadata": f"with e as (select * from (select *, row_number() over (partition by entity_key order by indexed_at desc nulls last, entity_id desc) r from code_entities_full where entity_key is not null) where r = 1), t as (select *, chosen_neighbor c from target_ast_map) select map_id, coalesce({_nn('t.c.id')}, t.node_id) node_id, coalesce({_nn('e.relpath')}, {_nn('t.c.path')}, {_nn('t.path')}) as path, coalesce({_nn('e.sig')}, {_nn('e.name')}, {_nn('t.c.label')}) signature, coalesce(t.c.start_line, ast_start_line) start_line, coalesce(t.c.end_line, ast_end_line) end_line, reason from t left join e on e.entity_key = t.c.id",
    "pj24_node_summary": f"select id, coalesce({_nn('path')}, case when starts_with(id, 'File:') then substr(id, 6) end) as path, coalesce({_nn('node_type')}, case when {_nn('qualified_name')} is not null then 'Function' else 'File' end) node_type, coalesce({_nn('label')}, {_nn('qualified_name')}, id) as label, coalesce({_nn('qualified_name')}, {_nn('label')}) signature from (select distinct id, path, node_type, label, qualified_name from nodes where id is not null)",
    "f11_stdlib_blocklist": rf"with m as (select unnest(regexp_extract_all(source, '(?m)^[ \t]*(?:import|from)[ ]+([A-Za-z_][A-Za-z0-9_.]*)', 1)) as name from code_entities_full where source is not null), p as (select regexp_extract(unnest(string_split(regexp_replace(sig, '^\(|\)$', '', 'g'), ',')), '^\s*\*{{0,2}}([A-Za-z_][A-Za-z0-9_]*)', 1) as name from code_entities_full where sig is not null) select 'module' kind, name, count(*) n from m where name not in ({_in(STOP_MODULES)}) and split_part(name, '.', 1) not in ({_in(STOP_MODULES)}) group by name union all select 'parameter', name, count(*) from p where name <> '' and name not in ({_in(STOP_PARAMETERS)}) group by name",
    "s15_file_index": f"with {_INDEX} select * from ix",
    "a33_kind_counts": f"with {_INDEX} select category, mime, count(*) n from ix group by 1, 2",
    "e1_token_overlap": f"with {_SETS} select id, round(p, 6) as \"precision\", round(r, 6) recall, round({_F1}, 6) f1, {_LEN} from ov",
    "e1_summary": f"with {_SETS} " + " union all ".join(f"select '{k}' metric, round(avg({c}), 6) as value from ov" for k, c in _LEX.items()),
    "e2_bleu": _BLEU,
    "e3_chrf": _CHRF,
    "e4_rouge1": _rouge(1),
    "e4_rouge2": _rouge(2),
    "e8_jaccard": f"with {_SETS} select id, round(case when np + nr - n = 0 then 1 else n / (np + nr - n) end::double, 6) jaccard from o",
}
