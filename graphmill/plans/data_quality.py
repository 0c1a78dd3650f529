"""Queries of problems 2 (references without a record) and 3 (nested records)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.operators import nested, references
from graphmill.session import bound_batches
from graphmill.sources import load


def _classified(spark: SparkSession, sf: str) -> DataFrame:
    ast_map = load(spark, sf, "target_ast_map")
    debug = load(spark, sf, "retrieval_debug")
    ref = lambda df, table, field, row, key, at: df.select(F.lit(table).alias("ref_table"), F.lit(field).alias("ref_field"), F.col(row).alias("row_id"), F.col(key).alias("ref_key"), F.col(at).alias("at"))
    to_entities = reduce(DataFrame.unionByName, [ref(ast_map, "target_ast_map", f, "map_id", f, "mapped_at") for f in ("chosen_neighbor.id", "ast_node_id")])
    to_nodes = ref(debug, "retrieval_debug", "neighbor_id", "retrieval_id", "neighbor_id", "retrieved_at")
    entities = references.parent_intervals(load(spark, sf, "code_entities_full"), "entity_key", "indexed_at", "deleted_at")
    nodes = references.parent_intervals(load(spark, sf, "nodes"), "id", "created_at", "deleted_at")
    return references.classify_references(to_entities, entities).unionByName(references.classify_references(to_nodes, nodes))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every orphan reference of target_ast_map and retrieval_debug."""
    return _classified(spark, sf).where("status <> 'valid'").select("ref_table", "ref_field", "row_id")


def p2_report(spark: SparkSession, sf: str) -> DataFrame:
    """Orphans per table, field, month and reason."""
    return references.orphan_report(_classified(spark, sf).where("status <> 'valid'"))


def _flat(spark: SparkSession, sf: str, payload: bool) -> DataFrame:
    bound_batches(spark)
    return nested.flatten_records(load(spark, sf, "ast_files"), "ast_id", "ast", payload=payload)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Each object under body, names or comparators with its parent."""
    return _flat(spark, sf, False).select(F.col("record_id").alias("ast_id"), F.col("path").alias("child_path"), "parent_path")


def p3_names(spark: SparkSession, sf: str) -> DataFrame:
    """The flat table of imported names with its declared fields."""
    return nested.table_of(_flat(spark, sf, True), "names").withColumnRenamed("record_id", "ast_id")


def p3_table_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and top-level rows per flat table."""
    flat = _flat(spark, sf, False)
    return flat.groupBy("tag").agg(F.count("*").alias("n_rows"), F.sum((F.col("parent_path") == "$").cast("long")).alias("n_top"))


QUERIES = {"p2_found": p2_found, "p2_report": p2_report, "p3_found": p3_found, "p3_names": p3_names, "p3_table_counts": p3_table_counts}

_REFS = r"""
refs as (
  select 'target_ast_map' ref_table, 'chosen_neighbor.id' ref_field, map_id row_id, trim(replace(chosen_neighbor.id, '\', '/'), E' \t\r\n') k, mapped_at ts from target_ast_map
  union all select 'target_ast_map', 'ast_node_id', map_id, trim(replace(ast_node_id, '\', '/'), E' \t\r\n'), mapped_at from target_ast_map
  union all select 'retrieval_debug', 'neighbor_id', retrieval_id, trim(replace(neighbor_id, '\', '/'), E' \t\r\n'), retrieved_at from retrieval_debug),
parents as (
  select 'target_ast_map' t, trim(replace(entity_key, '\', '/'), E' \t\r\n') k, indexed_at b, deleted_at e from code_entities_full
  union all select 'retrieval_debug', trim(replace(id, '\', '/'), E' \t\r\n'), created_at, deleted_at from nodes),
orphans as (
  select ref_table, ref_field, row_id, r.k, ts from refs r where r.k <> '' and ts is not null
  and not exists (select 1 from parents p where p.t = r.ref_table and p.k = r.k and p.b <= r.ts and (p.e is null or p.e > r.ts)))
"""

_TREE = r"""a3 as (select ast_id, ltrim(ast, chr(65279)) t from ast_files where ast is not null), v3 as (select ast_id, case when json_type(t) = 'VARCHAR' then ltrim(t::json->>'$', chr(65279)) else t end t from a3 where json_valid(t)), w3 as (select ast_id, t from v3 where json_valid(t)),
n3 as (select ast_id, j.fullkey, regexp_extract(j.fullkey, '\.(body|names|comparators)(?:\[[0-9]+\])?$', 1) tag, regexp_replace(j.fullkey, '\.(body|names|comparators)(\[[0-9]+\])?$', '') parent_path from w3, json_tree(w3.t::json) j where j.type = 'OBJECT' and regexp_matches(j.fullkey, '\.(body|names|comparators)(\[[0-9]+\])?$'))"""

SQL = {
    "p3_found": f"with {_TREE} select ast_id, fullkey child_path, parent_path from n3",
    "p3_table_counts": f"with {_TREE} select tag, count(*) n_rows, sum((parent_path = '$')::int)::bigint n_top from n3 group by 1",
    "p2_found": f"with {_REFS} select ref_table, ref_field, row_id from orphans",
    "p2_report": f"""with {_REFS}, begun as (select t, k, min(b) b from parents where k <> '' and b is not null group by all)
select ref_table, ref_field, strftime(ts, '%Y-%m') "month", case when b.k is null then 'missing' when b.b > ts then 'late' else 'deleted' end status, count(*) orphans
from orphans o left join begun b on b.t = o.ref_table and b.k = o.k group by all""",
}
