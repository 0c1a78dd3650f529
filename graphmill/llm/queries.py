"""Registered queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.llm import credentials, docpairs, encoding, names, packing, pii, readability
from graphmill.session import bound_batches, cut
from graphmill.sources import load


def _code_texts(spark: SparkSession, sf: str) -> DataFrame:
    bound_batches(spark)
    entities = load(spark, sf, "code_entities_full").select(F.lit("code_entities_full").alias("src_table"), F.col("entity_id").alias("row_id"), F.col("relpath").alias("path"), F.col("source").alias("text"))
    snippets = load(spark, sf, "code_snippets").select(F.lit("code_snippets").alias("src_table"), F.col("snippet_id").alias("row_id"), "path", F.col("snippet").alias("text"))
    return entities.unionByName(snippets)


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every line on which a credential begins."""
    return credentials.find_credentials(_code_texts(spark, sf)).select("src_table", "row_id", "line_no").distinct()


def p1_redacted(spark: SparkSession, sf: str) -> DataFrame:
    """All those texts with their credentials redacted."""
    texts = _code_texts(spark, sf)
    return credentials.redact_credentials(texts, credentials.find_credentials(texts))


def _message_texts(spark: SparkSession, sf: str) -> DataFrame:
    bound_batches(spark)
    parts = [(table, field) for table, fields in (("commits_sample", ("message_head",)), ("pull_requests", ("title", "body"))) for field in fields]
    each = [load(spark, sf, table).select(F.lit(table).alias("src_table"), F.lit(field).alias("src_field"), "record_id", F.col(field).alias("text")) for table, field in parts]
    return reduce(DataFrame.unionByName, each)


def _given_names(spark: SparkSession, sf: str) -> DataFrame:
    listed = load(spark, sf, "given_names")
    return listed.select(F.col("given_name").alias("given")).unionByName(listed.select(F.col("short_form").alias("given")))


def _mentions(spark: SparkSession, sf: str) -> DataFrame:
    return pii.find_mentions(_message_texts(spark, sf), _given_names(spark, sf))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every mention of personal data in commit messages and pull requests."""
    return _mentions(spark, sf).select("src_table", "src_field", "record_id", "pii_type", "occurrence")


def p4_redacted(spark: SparkSession, sf: str) -> DataFrame:
    """All those texts with typed placeholders."""
    return pii.redact_texts(_message_texts(spark, sf), _mentions(spark, sf))


def _entities(spark: SparkSession, sf: str) -> DataFrame:
    bound_batches(spark)
    return names.link_signatures(load(spark, sf, "contributor_signatures"), load(spark, sf, "given_names"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of signatures of the same person or organisation."""
    return names.pairs_of(_entities(spark, sf))


def p5_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Every signature with the least signature id of its person or organisation."""
    return _entities(spark, sf)


def p6_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Every function documented in earnest, with signature and documentation."""
    bound_batches(spark)
    return docpairs.extract_pairs(load(spark, sf, "code_entities_full"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """The line of every function documented in earnest."""
    return p6_pairs(spark, sf).select("entity_id", "def_line")


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    """The ids of every document."""
    bound_batches(spark)
    return encoding.encode_texts(load(spark, sf, "documents"))


def _sized(spark: SparkSession, sf: str) -> DataFrame:
    bound_batches(spark)
    return cut(encoding.count_tokens(load(spark, sf, "documents")))


def p8_containers(spark: SparkSession, sf: str) -> DataFrame:
    """A container of 2,048 tokens for every document, or for every piece of a longer one."""
    return packing.pack(_sized(spark, sf), "doc_id", "n_tokens")


def p8_report(spark: SparkSession, sf: str) -> DataFrame:
    """Containers, their use and the lower bound from the dual prices."""
    parts = packing.pieces(_sized(spark, sf), "doc_id", "n_tokens")
    histogram = packing.histogram_of(parts)
    plan = packing.solve(histogram)
    tokens = sum(s * n for s, n in histogram.items())
    row = (packing.CAPACITY, tokens, plan.containers, plan.lower_bound, tokens / max(1, packing.CAPACITY * plan.containers))
    return spark.createDataFrame([row], "capacity int, tokens long, containers long, lower_bound long, share_used double")


def _levels(spark: SparkSession, sf: str) -> DataFrame:
    bound_batches(spark)
    grades = cut(readability.grade_documents(load(spark, sf, "documents")))
    return readability.levels_of(grades, readability.rated_cuts(grades, load(spark, sf, "reading_labels")))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    """The reading level of every document with enough prose."""
    return _levels(spark, sf).select("doc_id", "reading_level")


def p9_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and mean grade per language and level."""
    return _levels(spark, sf).groupBy("language", "reading_level").agg(F.count("*").alias("documents"), F.round(F.avg("grade"), 3).alias("mean_grade"))


QUERIES = {"p1_found": p1_found, "p1_redacted": p1_redacted, "p5_found": p5_found, "p5_entities": p5_entities, "p4_found": p4_found, "p4_redacted": p4_redacted, "p6_found": p6_found, "p6_pairs": p6_pairs, "p7_ids": p7_ids, "p8_containers": p8_containers, "p8_report": p8_report, "p9_found": p9_found, "p9_profile": p9_profile}
SQL: dict[str, str] = {}
