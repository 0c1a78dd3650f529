"""Sanitizing the fields of graph records: audit, routes, entities in free text, residual scans.

All work on one long table (record, node_type, field, value), so a new field is a row and not a column; nested fields
are named ``attrs.<key>``. Everything is row-wise but the joins with contributors and given names, which are joins of
short words by equality.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphmill.functions import text as X
from graphmill.operators import privacy as P

# ---- fixed values: category and route of each field, shapes of values
FIELD_CATEGORIES = {
    **dict.fromkeys("introduced_by_commit modified_by_commits sha author date prs introduced_by_pr introduced_by_pr_title message created_at merged_at title".split(), "PROVENANCE"),
    **dict.fromkeys("label name qualified_name docstring signature text_preview id".split(), "IDENTIFIER"),
    **dict.fromkeys("file path".split(), "STRUCTURAL"),
    **dict.fromkeys("hash html_url".split(), "LITERAL"),
    **dict.fromkeys("lineno end_lineno mime size version type".split(), "SAFE"),
    "attrs": "NESTED",
    **dict.fromkeys([f"attrs.{k}" for k in "type lineno end_lineno state".split()], "SAFE"),
    "attrs.qualified_name": "IDENTIFIER",
    **dict.fromkeys(["attrs.module", "attrs.file"], "STRUCTURAL"),
    **dict.fromkeys(["attrs.file_hash", "attrs.html_url"], "LITERAL"),
    **dict.fromkeys([f"attrs.{k}" for k in "sha message_head author_name author_email author_date parents closed_at commits created_at merged_at title user merge_commit_sha".split()], "PROVENANCE"),
}
ACTIONS = {"LITERAL": "REPLACE with [LITERAL_TYPE]", "IDENTIFIER": "REPLACE with role-based placeholder", "PROVENANCE": "REPLACE with generalized value", "STRUCTURAL": "REPLACE with abstracted path", "SAFE": "KEEP as-is", "NESTED": "INSPECT individually"}
REVIEW = "MANUAL REVIEW needed"
ROUTES = {
    "commit": ("introduced_by_commit", "sha", "attrs.sha", "attrs.merge_commit_sha"),
    "commit_list": ("modified_by_commits", "attrs.parents", "attrs.commits"),
    "pr": ("introduced_by_pr", "prs"),
    "literal": ("hash", "html_url", "attrs.file_hash", "attrs.html_url"),
    "author": ("author", "attrs.author_name", "attrs.user"),
    "title": ("introduced_by_pr_title", "title", "attrs.title"),
    "text": ("message", "date", "created_at", "merged_at", "attrs.author_email", "attrs.author_date", "attrs.message_head", "attrs.closed_at", "attrs.created_at", "attrs.merged_at", "text_preview"),
}
TIMED = r"[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}"
MAIL = r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z]+"
FILE_NAME = r"[A-Za-z0-9_./-]+\.(?:py|json|yaml|yml|txt|md|csv|sh|cfg|ini|toml)"
MODULE = r"^[a-z_]+(?:\.[a-z_]+)+$"
#: Shapes that must not be left, in the order in which they are reported, with their severity.
RESIDUALS = {
    "EMAIL": (r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z]{2,}", "HIGH"), "GITHUB_URL": (r"https://(?:github\.com|codehost\.example)/[A-Za-z]", "MEDIUM"), "COMMIT_HASH": (r"\b[0-9a-f]{40}\b", "HIGH"), "TIMESTAMP": (TIMED, "MEDIUM"),
    "MODULE_PATH": (r"\b(?:dags|gcpdeploy|src)\.[a-z_]+\.[a-z_]+", "MEDIUM"), "FILE_PATH": (r"dags/src/[a-z_]+\.py", "MEDIUM"),
}
SKIPPED = ("type", "lineno", "end_lineno", "size", "mime", "version", "id", "source", "target", "relation")
#: Shapes of personal data in files, without case.
PERSONAL = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "github_username": r"(?:github\.com/|@)[A-Za-z0-9_-]+", "commit_author": "\"author[\"|']?\\s*:\\s*[\"|']?[^\"|'\\n]+", "commit_message": "\"message[\"|']?\\s*:\\s*[\"|']?[^\"|'\\n]{20,}",
    "user_path": r"/home/[a-zA-Z0-9_]+|C:\\\\Users\\\\[a-zA-Z0-9_]+", "email_in_commit": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", "pr_author": "\"author[\"|']?\\s*:\\s*\\{[^}]*\"login[\"|']?\\s*:\\s*[\"|']?[^\"|'\\n]+", "user_credentials": "(?:password|token|secret|apikey|api_key)[\\s:=]+['\"]?[^\\s'\"]+",
}
#: Entities in free text: kind -> (pattern, token), the earlier kind first where two begin at one place.
ENTITIES = {
    "EMAIL_ADDRESS": (r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)*\.[A-Za-z]{2,}", "[EMAIL]"), "URL": (r"https?://[^\s\"'<>()\]]+|\b[A-Za-z0-9_-]+\.(?:py|json|yaml|yml|txt|md|csv|sh|html|css|js|ts)\b", "[URL]"), "IP_ADDRESS": (r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b", "[URL]"),
    "DATE_TIME": (r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2})?Z?)?|\b[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{2,4}\b", "[TIMESTAMP]"), "CRYPTO": (r"\b(?:bc1|[13])[a-km-zA-HJ-NP-Z1-9]{25,39}\b", "[CRYPTO_ADDRESS]"), "PHONE_NUMBER": (r"\+[0-9]{1,3}[ .-]?[0-9(][0-9 ().-]{5,}[0-9]|\b[0-9]{7,15}\b", "[PHONE]"),
    "PERSON": (r"\b[A-Z][a-zà-öø-ÿ]+ [A-Z][a-zà-öø-ÿ]+", "[PERSON]"),
}
SOFTWARE_TERMS = tuple(
    "flask django fastapi numpy pandas scipy sklearn tensorflow pytorch keras seaborn matplotlib plotly airflow celery redis sqlalchemy alembic pydantic pytest pylint black flake8 mypy bandit semgrep docker kubernetes helm terraform ansible jenkins gitlab github git dvc mlflow grafana prometheus kibana elasticsearch "
    "gcpdeploy gcp aws azure heroku cloudrun bigquery pubsub firestore push merge update add fix refactor bump chore feat docs test ci cd hotfix release revert wip md readme df api monthly weekly daily nightly".split()
)


def audited(fields: DataFrame) -> DataFrame:
    """``fields`` with field_category, value_category, final_category and action; the value decides where the field is unknown."""
    known = F.create_map(*(F.lit(x) for kv in FIELD_CATEGORIES.items() for x in kv))
    actions = F.create_map(*(F.lit(x) for kv in ACTIONS.items() for x in kv))
    by_field = F.coalesce(F.try_element_at(known, F.col("field")), F.lit("UNKNOWN"))
    out = fields.withColumns({"field_category": by_field, "value_category": X.value_category(F.col("value"))})
    final = F.when(F.col("field_category") == "UNKNOWN", F.col("value_category")).otherwise(F.col("field_category"))
    return out.withColumn("final_category", final).withColumn("action", F.coalesce(F.try_element_at(actions, final), F.lit(REVIEW)))


def false_entity(kind: Column, entity: Column) -> Column:
    """Whether an entity of a kind is none: a software term, a file name as a link, a version as a date, bare digits as a phone, snake case as a person, hash-like, one or two letters."""
    small = F.lower(F.trim(entity))
    return (
        small.isin(*SOFTWARE_TERMS)
        | ((kind == "URL") & F.lower(entity).rlike(r"^[a-z0-9_-]+\.(py|json|yaml|yml|txt|md|csv|sh|cfg|ini|toml|js|ts|html|css)$"))
        | ((kind == "DATE_TIME") & entity.rlike(r"^[0-9]+\.[0-9]+(\.[0-9]+)?$"))
        | ((kind == "PHONE_NUMBER") & entity.rlike("^[0-9]+$"))
        | ((kind == "LOCATION") & entity.rlike("^[A-Z]{1,3}$"))
        | ((kind == "PERSON") & small.rlike(r"^[a-z][a-z0-9]*(_[a-z0-9]+)+$"))
        | small.rlike("^[a-f0-9]{7,}$")
        | (F.length(small) <= 2)
    )


ANY_ENTITY = "|".join(f"(?:{p})" for p, _ in ENTITIES.values())


def _kind(entity: Column) -> Column:
    kinds = list(ENTITIES.items())
    return reduce(lambda acc, kv: acc.when(entity.rlike(f"^(?:{kv[1][0]})$"), kv[0]), kinds[1:-1], F.when(entity.rlike(f"^(?:{kinds[0][1][0]})$"), kinds[0][0])).otherwise(kinds[-1][0])


def _token(kind: Column, entity: Column) -> Column:
    named = reduce(lambda acc, kv: acc.when(kind == kv[0], kv[1][1]), ENTITIES.items(), F.when(entity.contains("github.com") | entity.contains("codehost."), "[REPO_URL]"))
    return named


def entities(texts: DataFrame, keys: list[str], text: str, given: DataFrame) -> DataFrame:
    """(keys, nth, start, entity_type, entity, false_positive) of every entity of a text, by place from 0.

    One pass finds all kinds, so entities never overlap. Two capitalised words are a person if the first is a known given
    name (column given), else they are no entity at all; every other kind goes by its shape. Null texts give no row.
    """
    found = F.regexp_extract_all(text, F.lit(ANY_ENTITY), F.lit(0))
    gaps = F.transform(F.split(text, ANY_ENTITY), F.length)
    placed = texts.where(F.col(text).isNotNull()).select(*keys, F.posexplode(F.arrays_zip(found.alias("e"), F.slice(gaps, F.lit(1), F.size(found)).alias("g"))).alias("nth", "z"))
    placed = placed.where("z.e is not null").select(*keys, F.col("nth").cast("int").alias("nth"), F.col("z.e").alias("entity"), F.col("z.g").alias("gap")).withColumn("entity_type", _kind(F.col("entity")))
    first = given.select(F.lower("given").alias("first")).where("given is not null").distinct().withColumn("known", F.lit(True))
    judged = placed.withColumn("first", F.when(F.col("entity_type") == "PERSON", F.lower(F.substring_index("entity", " ", 1)))).join(first, "first", "left")
    real = (F.col("entity_type") != "PERSON") | F.col("known").isNotNull()
    return judged.select(*keys, "nth", "gap", "entity_type", "entity", (false_entity(F.col("entity_type"), F.col("entity")) | ~real).alias("false_positive"))


def replaced_entities(texts: DataFrame, keys: list[str], text: str, given: DataFrame) -> DataFrame:
    """``texts`` with the token of its kind for each entity that is no false positive, everything between unchanged. Rows with the same keys must hold the same text."""
    found = entities(texts, keys, text, given)
    to = F.when(F.col("false_positive"), F.col("entity")).otherwise(_token(F.col("entity_type"), F.col("entity")))
    own = found.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_set(F.struct("nth", to.alias("to")))), lambda x: x["to"]).alias("__to"))
    gaps = F.split(text, ANY_ENTITY)
    built = F.array_join(F.flatten(F.transform(gaps, lambda g, i: F.array(g, F.coalesce(F.get("__to", i), F.lit(""))))), "")
    return texts.join(own, keys, "left").withColumn(text, F.when(F.col("__to").isNull(), F.col(text)).otherwise(built)).drop("__to")


def masked_fields(fields: DataFrame, given: DataFrame) -> DataFrame:
    """``fields`` with every value through the mask of its field's route; fields without a route are kept.

    Commits, lists of commits and requests become references, literals what they are, authors consistent numbers, titles
    [PR_TITLE]; times and addresses as a whole, and entities and hashes inside free text, become their tokens.
    """
    of = lambda name: F.col("field").isin(*ROUTES[name])
    named = fields.where(of("author") & (F.trim("value") != "")).select(F.col("value").alias("name"))
    contributors = P.canonical_contributors(named, "name").select(F.col("name").alias("value"), "contributor")
    free = fields.where(of("text") & F.col("value").isNotNull() & ~F.col("value").rlike(f"^{TIMED}") & ~F.col("value").rlike(f"^{MAIL}$") & (F.length("value") > 3))
    texts = replaced_entities(free.groupBy("record", "field").agg(F.min("value").alias("value")), ["record", "field"], "value", given).select("record", "field", F.regexp_replace("value", r"[0-9a-f]{40}", "[COMMIT_ID]").alias("clean"))
    value = F.col("value")
    each = lambda c: F.array_join(F.transform(F.split(c, ","), lambda x: F.when(x.rlike("^[0-9a-f]{40}$"), "[COMMIT_ID]").otherwise(x)), ",")
    masked = (
        F.when(value.isNull() | (value == ""), value).when(of("commit"), "[COMMIT_ID]").when(of("commit_list"), each(value)).when(of("pr"), "[PR_REF]").when(of("literal"), X.mask_whole(value))
        .when(of("author"), F.coalesce("contributor", value)).when(of("title"), "[PR_TITLE]")
        .when(of("text") & value.rlike(f"^{TIMED}"), "[TIMESTAMP]").when(of("text") & value.rlike(f"^{MAIL}$"), "[EMAIL]").when(of("text"), F.coalesce("clean", value)).otherwise(value)
    )
    joined = fields.join(contributors, "value", "left").join(texts, ["record", "field"], "left")
    return joined.select("record", "node_type", "field", masked.alias("value"))


def residuals(fields: DataFrame, contributors: DataFrame) -> DataFrame:
    """(record, field, pattern_type, matched_text, severity): what is left in any field, by shape, and names of known contributors (column name)."""
    kept = fields.where(F.col("value").isNotNull() & ~F.col("field").isin(*SKIPPED))
    of = lambda kind, pattern, severity: F.transform(F.regexp_extract_all("value", F.lit(pattern), F.lit(0)), lambda m: F.struct(F.lit(kind).alias("pattern_type"), F.left(m, F.lit(80)).alias("matched_text"), F.lit(severity).alias("severity")))
    shaped = kept.select("record", "field", F.explode(F.flatten(F.array(*(of(k, p, s) for k, (p, s) in RESIDUALS.items())))).alias("r")).select("record", "field", "r.*")
    words = F.regexp_extract_all(F.lower("value"), F.lit(r"[^\s,;:()<>\"'\[\]{}=#]+"), F.lit(0))
    two = F.when(F.size("ws") > 1, F.transform(F.sequence(F.lit(1), F.size("ws") - 1), lambda i: F.concat_ws(" ", F.get("ws", i - 1), F.get("ws", i)))).otherwise(F.array().cast("array<string>"))
    runs = kept.select("record", "field", words.alias("ws")).select("record", "field", F.explode(F.array_distinct(F.concat("ws", two))).alias("name"))
    known = contributors.select(F.lower(F.trim("name")).alias("name")).where("length(name) > 3").distinct()
    people = runs.join(known, "name").select("record", "field", F.lit("CONTRIBUTOR_NAME").alias("pattern_type"), F.left("name", F.lit(80)).alias("matched_text"), F.lit("HIGH").alias("severity"))
    return shaped.unionByName(people)


def personal_counts(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, one column per shape): distinct matches of personal data in the whole text, 0 where there is none."""
    count = lambda p: F.coalesce(F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?i){p}"), F.lit(0)))), F.lit(0))
    return texts.select(key, *(count(p).alias(n) for n, p in PERSONAL.items()))
