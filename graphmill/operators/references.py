"""References to records that do not exist: classify every reference against its parents' validity intervals.

References and parent keys are brought into one stream, hash partitioned by the compared key and
sorted by (key, time); one linear pass over each sorted partition then merges both streams. The
pass is a running window (rows unbounded preceding .. current), which Spark evaluates row by row,
so a partition is never held in memory and no Python process is involved.

Hot keys: a key named by more than ``hot_share`` of the references is split into ``salts`` parts;
its parent intervals, already reduced to one per creation time, are repeated once per part. At most
1 / hot_share keys can be hot, so the list of hot keys is broadcast with a proven bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: An open interval ends here.
#: References of one key that one task sorts at most, about, and how many keys may be split for having more.
HOT_ROWS = 2_000_000
HOT_KEYS = 20_000
FOREVER = "9999-12-31 00:00:00"
STATUSES = ("valid", "missing", "deleted", "late")


def compared_key(col: Column) -> Column:
    """Key as compared: backslash reads as slash, outer blanks (space, tab, line ends) are off."""
    return F.regexp_replace(F.translate(col, "\\", "/"), r"^[ \t\r\n]+|[ \t\r\n]+$", "")


def parent_intervals(parents: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(key, starts, ends): one validity interval per key and start, the longest where rows repeat.

    Rows without key or start give none; a null end is open.
    """
    return (
        parents.select(compared_key(F.col(key)).alias("key"), F.col(start).cast("timestamp_ntz").alias("starts"), F.coalesce(F.col(end).cast("timestamp_ntz"), F.lit(FOREVER).cast("timestamp_ntz")).alias("ends"))
        .where("key is not null and key <> '' and starts is not null")
        .groupBy("key", "starts")
        .agg(F.max("ends").alias("ends"))
    )


def classify_references(refs: DataFrame, intervals: DataFrame, hot_share: float = 0.005, salts: int = 32, hot_rows: int = HOT_ROWS) -> DataFrame:
    """refs (ref_table, ref_field, row_id, ref_key, at) with ``status`` added.

    * valid: a parent with starts <= at < ends exists,
    * deleted: parents started by then, but all had ended,
    * late: every parent of the key starts after ``at``,
    * missing: the key never occurs among the parents.

    Null and empty keys and null times are no references and give no row. Repeated references are
    judged and returned one by one. Other columns of ``refs`` are dropped, so clashing names cannot matter.
    An empty parent table makes every reference missing.
    """
    live = refs.select("ref_table", "ref_field", "row_id", compared_key(F.col("ref_key")).alias("key"), F.col("at").cast("timestamp_ntz").alias("at")).where("key is not null and key <> '' and at is not null")
    counts = live.groupBy("key").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    # a key is hot by its share of all rows, or by more rows than one task should sort, but never more than HOT_KEYS keys by the latter
    most = F.greatest(F.lit(float(hot_rows)), F.col("total") / HOT_KEYS)
    limit = F.least(F.greatest(F.lit(1000.0), F.col("total") * hot_share), most)
    hot = counts.join(F.broadcast(total)).where(F.col("n") > limit).select("key", F.greatest(F.lit(salts), F.ceil(F.col("n") / most)).cast("int").alias("parts"))  # one row is broadcast
    hot = F.broadcast(hot)  # at most 1 / hot_share + HOT_KEYS rows
    live = live.join(hot, "key", "left").withColumn("part", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("row_id", "ref_field"), F.col("parts"))).otherwise(F.lit(0)).cast("int"))
    parents = intervals.join(hot, "key", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts") - 1, F.lit(0)))))
    low = F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")
    # side 0: one mark per key that has parents at all, before everything else; side 1: intervals; side 2: references
    none = lambda t: F.lit(None).cast(t)
    shape = lambda df, side, at, ends: df.select("key", "part", F.lit(side).alias("side"), at.alias("at"), ends.alias("ends"), none("string").alias("ref_table"), none("string").alias("ref_field"), none("bigint").alias("row_id"))
    known = shape(parents.select("key", "part").distinct(), 0, low, none("timestamp_ntz"))
    begun = shape(parents, 1, F.col("starts"), F.col("ends"))
    asked = live.select("key", "part", F.lit(2).alias("side"), "at", none("timestamp_ntz").alias("ends"), "ref_table", "ref_field", "row_id")
    merged = Window.partitionBy("key", "part").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    judged = known.unionByName(begun).unionByName(asked).withColumns({"latest_end": F.max("ends").over(merged), "known": F.min("side").over(merged)})
    status = F.when(F.col("latest_end") > F.col("at"), "valid").when(F.col("latest_end").isNotNull(), "deleted").when(F.col("known") == 0, "late").otherwise("missing")
    return judged.where("side = 2").select("ref_table", "ref_field", "row_id", F.col("key").alias("ref_key"), "at", status.alias("status"))


def orphan_references(refs: DataFrame, intervals: DataFrame) -> DataFrame:
    """The references that no valid parent answers, with the reason as ``status``."""
    return classify_references(refs, intervals).where("status <> 'valid'")


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans per table, field, month of the reference and status."""
    return orphans.groupBy("ref_table", "ref_field", F.date_format("at", "yyyy-MM").alias("month"), "status").agg(F.count("*").alias("orphans"))
