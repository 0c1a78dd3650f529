"""A typed property graph as two tables: building, merging, statistics and bounded traversal.

Nodes are (id, node_type, label, path, name, sha, number, source, ...), edges (source, target, type, count,
provenance). Traversals keep a frontier table and join it with the edges once per hop; what is known is cut at
each hop, so plans stay short. Nothing of the graph is collected to the driver but single figures.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphmill.session import cut, cut_unsized, tidy

#: The declared node and edge types.
NODE_TYPES = ("File", "Module", "Function", "Class", "Commit", "PR", "Dependency", "Document", "Person")
EDGE_TYPES = ("IMPORTS", "CALLS", "CALLS_FILE_LEVEL", "DEFINES", "MODIFIED_BY", "CLOSED_BY", "DEPENDS_ON", "MENTIONS")

#: Pairs of ids of which a single task holds all (some 30 MB).
HELD_PAIRS = 100_000

#: Rows of a frontier that are broadcast (some 2 MB).
HELD_FRONTIER = 20_000


#: Columns of the stored graph.
NODE_SCHEMA = "id string, node_type string, label string, path string, qualified_name string, lineno int, sha string, number bigint, attrs map<string,string>"
EDGE_SCHEMA = "source string, target string, type string, count bigint, provenance string"


def write_schema(spark: SparkSession, path: str) -> bool:
    """Writes the declared types of nodes and edges as JSON where nothing is stored yet; whether it did."""
    files = spark._jvm.org.apache.hadoop.fs
    place = files.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return False
    rows = [("node", t, NODE_SCHEMA) for t in NODE_TYPES] + [("edge", t, EDGE_SCHEMA) for t in EDGE_TYPES]
    spark.createDataFrame(rows, "record string, type string, columns string").coalesce(1).write.json(path)
    return True


def enforced(df: DataFrame, schema: str, column: str, types: tuple[str, ...]) -> DataFrame:
    """``df`` with the columns and types of a schema (missing ones null, others dropped); rows of no declared type are left out."""
    wanted = df.sparkSession.createDataFrame([], schema).schema
    have = set(df.columns)
    shaped = df.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted))
    return shaped.where(F.col(column).isin(*types))


def slashed(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def node_id(node_type: Column | str, ident: Column) -> Column:
    """``Type:identifier`` with forward slashes."""
    return F.concat(F.lit(node_type) if isinstance(node_type, str) else node_type, F.lit(":"), slashed(ident))


def short_id(text: Column) -> Column:
    """First eight characters of the SHA-1."""
    return F.substring(F.sha1(text), 1, 8)


def module_name(path: Column) -> Column:
    """Dotted module of a path: no extension, no __init__, dots for slashes."""
    return F.translate(F.regexp_replace(F.regexp_replace(slashed(path), r"\.py$", ""), r"/__init__$", ""), "/", ".")


def last_wins(sources: list[DataFrame], key: str) -> DataFrame:
    """Rows of all sources; where a key occurs again the later source replaces the earlier (within a source the greatest row)."""
    columns = sources[0].columns
    tagged = [s.select(*columns).withColumn("__turn", F.lit(i)) for i, s in enumerate(sources)]
    rest = [c for c in columns if c != key]
    merged = reduce(DataFrame.unionByName, tagged).groupBy(key).agg(F.max(F.struct("__turn", *rest)).alias("row"))
    return merged.select(key, *(F.col(f"row.{c}").alias(c) for c in rest))


def merge_edges(raw: DataFrame) -> DataFrame:
    """(source, target, type, count, provenance): counts added, provenance as sorted ``name=count``. Two partial aggregations."""
    by = raw.groupBy("source", "target", "type", "provenance").agg(F.count("*").alias("n"))
    return by.groupBy("source", "target", "type").agg(F.sum("n").alias("count"), F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "provenance", "n"))), ";").alias("provenance"))


def type_counts(df: DataFrame, column: str, fallback: Column | None = None) -> DataFrame:
    """Rows per type, through the fallback to UNKNOWN where it is missing or empty."""
    kind = F.coalesce(F.nullif(F.col(column), F.lit("")), *([F.nullif(fallback, F.lit(""))] if fallback is not None else []), F.lit("UNKNOWN"))
    return df.groupBy(kind.alias("type")).agg(F.count("*").alias("n"))


def stubs(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, node_type) of endpoints without a node."""
    ends = edges.select(F.col("source").alias("id")).unionByName(edges.select(F.col("target").alias("id"))).distinct()
    return ends.join(nodes.select("id"), "id", "left_anti").select("id", F.substring_index("id", ":", 1).alias("node_type"))


def integrity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(check_name, n): missing sources and targets (edges), and ids that occur more than once."""
    ids = nodes.select("id").distinct()
    missing = lambda end: edges.join(ids.withColumnRenamed("id", end), end, "left_anti").agg(F.count("*").alias("n")).select(F.lit(f"missing_{end}").alias("check_name"), "n")
    twice = nodes.groupBy("id").agg(F.count("*").alias("k")).where("k > 1").agg(F.count("*").alias("n")).select(F.lit("duplicate_ids").alias("check_name"), "n")
    return missing("source").unionByName(missing("target")).unionByName(twice)


def weighted_degrees(edges: DataFrame, top: int = 10) -> DataFrame:
    """(direction, id, degree, rank): the greatest in and out degrees, weighted by count; a top-k report."""
    both = edges.select(F.lit("out").alias("direction"), F.col("source").alias("id"), "count").unionByName(edges.select(F.lit("in").alias("direction"), F.col("target").alias("id"), "count"))
    sums = both.groupBy("direction", "id").agg(F.sum("count").alias("degree"))
    one = lambda d: sums.where(F.col("direction") == d).orderBy(F.desc("degree"), "id").limit(top)
    return one("out").unionByName(one("in")).withColumn("rank", F.row_number().over(Window.partitionBy("direction").orderBy(F.desc("degree"), "id")))


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of every edge once, without loops."""
    return edges.select("source", "target").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"))).where("source <> target").distinct()


def degree_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Least, greatest, mean and median degree of the undirected simple graph; nodes without edges count."""
    ids = nodes.select("id").distinct()
    degree = undirected(edges).groupBy(F.col("source").alias("id")).agg(F.count("*").alias("d"))
    all_ = ids.join(degree, "id", "left").select(F.coalesce("d", F.lit(0)).alias("d"))
    return all_.agg(F.count("*").alias("nodes"), F.min("d").alias("min_degree"), F.max("d").alias("max_degree"), F.round(F.avg("d"), 6).alias("mean_degree"), F.percentile("d", 0.5).alias("median_degree"))


def density(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes, edges, directed density and average degree."""
    n = nodes.select("id").distinct().agg(F.count("*").alias("nodes"))
    m = edges.agg(F.count("*").alias("edges"))
    share = F.try_divide(F.col("edges"), F.col("nodes") * (F.col("nodes") - 1))
    return n.join(F.broadcast(m)).select("nodes", "edges", F.round(share, 10).alias("density"), F.round(F.try_divide(2 * F.col("edges"), F.col("nodes")), 6).alias("average_degree"))  # one row each


def hops(seeds: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(id, distance): nodes reached from the seeds within ``depth`` directed hops, the seeds at 0."""
    known = cut(seeds.select("id").distinct().withColumn("distance", F.lit(0)))
    frontier = known
    for d in range(1, depth + 1):
        step = edges.select(F.col("source").alias("id"), "target").join(frontier.select("id"), "id").select(F.col("target").alias("id")).distinct()
        frontier = cut(step.join(known, "id", "left_anti").withColumn("distance", F.lit(d)))
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
    return known


def neighbourhoods(seeds: DataFrame, edges: DataFrame, depth: int, held: int = 0) -> DataFrame:
    """(seed, id, distance) for every seed on its own, within ``depth`` directed hops, the seed itself left out. A frontier of ``held`` rows or fewer goes to the edges, so that these are not shuffled."""
    known = cut(seeds.select(F.col("id").alias("seed"), "id").distinct().withColumn("distance", F.lit(0)))
    frontier = known
    for d in range(1, depth + 1):
        near = frontier.select("seed", "id")
        near = F.broadcast(near) if held and near.count() <= held else near
        step = edges.select(F.col("source").alias("id"), "target").join(near, "id").select("seed", F.col("target").alias("id")).distinct()
        frontier = cut(step.join(known, ["seed", "id"], "left_anti").withColumn("distance", F.lit(d)))
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
    return known.where("distance > 0")


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges whose two ends are both among the ids."""
    ids = ids.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def _pairs(edges: DataFrame) -> DataFrame:
    """Every undirected edge once, the lesser end as source, without loops."""
    return edges.where("source <> target").select(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")).distinct()


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, name): least id of the component of each end, for pairs that one task can hold."""
    above: dict = {}
    kind = None

    def root(x):
        while (up := above.setdefault(x, x)) != x:
            above[x] = x = above[up]
        return x

    for batch in batches:
        kind = batch.schema.field(0).type
        for s, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            s, t = sorted((root(s), root(t)))
            above[t] = s
    ids = list(above)
    for i in range(0, len(ids), 10_000):
        part = ids[i : i + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, kind), pa.array([root(x) for x in part], kind)], ["id", "name"])


def _contract(pairs: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """(id, name) of all ends, and the pairs of names that are left.

    Every node follows the least hash of its neighbourhood for two steps and is contracted with all that end where it
    does, under the least id of them. Hashes change with the turn, so that the nodes left are an expected share whatever
    the ids and the length of chains.
    """
    place = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("hash"), F.col(c).alias("to"))
    both = pairs.unionByName(pairs.select(F.col("target").alias("source"), F.col("source").alias("target")))
    best = both.groupBy("source").agg(F.min(place("target")).alias("best"))
    step = best.select(F.col("source").alias("id"), F.least("best", place("source"))["to"].alias("to"))
    ends = cut_unsized(step.join(step.select(F.col("id").alias("to"), F.col("to").alias("end")), "to").select("id", "end"))
    groups = cut_unsized(ends.join(ends.groupBy("end").agg(F.min("id").alias("name")), "end").select("id", "name"))
    for end in ("source", "target"):
        pairs = pairs.join(groups.select(F.col("id").alias(end), "name"), end).drop(end).withColumnRenamed("name", end)
    return groups, cut_unsized(_pairs(pairs))


def components(nodes: DataFrame, edges: DataFrame, held: int = HELD_PAIRS) -> DataFrame:
    """(id, component): least id of each undirected component, by contraction.

    What is left of ``held`` pairs or fewer is united by one task; components are then looked up from the last round
    back to the first.
    """
    pairs = cut_unsized(_pairs(edges))
    rounds = []
    while pairs.count() > held:
        groups, pairs = _contract(pairs, len(rounds))
        rounds.append(groups)
        tidy(pairs.sparkSession)
    kind = pairs.schema["source"].dataType.simpleString()
    known = pairs.select("source", "target").coalesce(1).mapInArrow(_unite, f"id {kind}, name {kind}")
    for groups in reversed(rounds):
        known = groups.join(known.select(F.col("id").alias("name"), F.col("name").alias("last")), "name", "left").select("id", F.coalesce("last", "name").alias("name"))
    return cut_unsized(nodes.select("id").distinct().join(known, "id", "full").select("id", F.coalesce("name", "id").alias("component")))


def component_sizes(parts: DataFrame) -> DataFrame:
    """Number of components, size of the largest, its share of all nodes."""
    sizes = parts.groupBy("component").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("components"), F.max("n").alias("largest"), F.round(F.max("n") / F.sum("n"), 6).alias("largest_share"))


def path_statistics(parts: DataFrame, edges: DataFrame, sample: int = 200, cutoff: int = 10) -> DataFrame:
    """Mean distance and greatest eccentricity from a sample (the least ids) of the largest component, up to a cutoff; zeros count."""
    largest = parts.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    seeds = cut(parts.join(F.broadcast(largest), "component").orderBy("id").limit(sample).select("id"))  # one row is broadcast
    reached = neighbourhoods(seeds, cut(undirected(edges)), cutoff, HELD_FRONTIER)
    zero = seeds.select(F.lit(0).alias("distance"))
    return reached.select("distance").unionByName(zero).agg(F.round(F.avg("distance"), 4).alias("mean_path"), F.max("distance").alias("pseudo_diameter"))


def rekey(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends looked up in (old_id, new_id); ends that are not listed stay."""
    for end in ("source", "target"):
        edges = edges.join(ids.select(F.col("old_id").alias(end), F.col("new_id").alias("__new")), end, "left").withColumn(end, F.coalesce("__new", end)).drop("__new")
    return edges


def first_by_priority(candidates: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The candidate of least priority per key, ties by the given columns in order, as one aggregation."""
    rest = [c for c in candidates.columns if c not in keys and c not in ("priority", *order)]
    best = candidates.groupBy(*keys).agg(F.min(F.struct("priority", *order, *rest)).alias("best"))
    return best.select(*keys, "best.*")
