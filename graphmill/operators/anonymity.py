"""Structural anonymity of modules: signatures, classes of equal signature, verdict, and augmentation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.session import cut


def signatures(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """One signature per module from functions (module, name) and calls (source, target by name).

    functions, calls inside, out and in, the sorted out-degrees, and the motifs inside: chains a -> b -> c by their middle, pairs of calls from one function (fan-out) and to one function (fan-in).
    """
    placed = functions.select("module", "name").distinct()
    known = calls.select("source", "target").distinct().join(placed.select(F.col("name").alias("source"), F.col("module").alias("sm")), "source", "left").join(placed.select(F.col("name").alias("target"), F.col("module").alias("tm")), "target", "left")
    out = known.where("sm is not null").groupBy(F.col("sm").alias("module")).agg(F.sum((F.col("sm").eqNullSafe(F.col("tm"))).cast("long")).alias("internal"), F.sum((~F.col("sm").eqNullSafe(F.col("tm"))).cast("long")).alias("ext_out"))
    into = known.where("tm is not null and not (sm <=> tm)").groupBy(F.col("tm").alias("module")).agg(F.count("*").alias("ext_in"))
    inner = known.where("sm = tm")
    od = inner.groupBy(F.col("sm").alias("module"), F.col("source").alias("name")).agg(F.count("*").alias("od"))
    idg = inner.groupBy(F.col("tm").alias("module"), F.col("target").alias("name")).agg(F.count("*").alias("ind"))
    degree = placed.join(od, ["module", "name"], "left").join(idg, ["module", "name"], "left").na.fill(0, ["od", "ind"])
    motifs = degree.groupBy("module").agg(
        F.count("*").alias("n_funcs"), F.array_join(F.array_sort(F.collect_list("od")).cast("array<string>"), ",").alias("degrees"),
        F.sum(F.col("od") * F.col("ind")).alias("chains"), F.sum(F.expr("od * (od - 1) div 2")).alias("fan_out"), F.sum(F.expr("ind * (ind - 1) div 2")).alias("fan_in"),
    )
    return motifs.join(out, "module", "left").join(into, "module", "left").na.fill(0, ["internal", "ext_out", "ext_in"])


SIGNATURE = ["n_funcs", "internal", "ext_out", "ext_in", "degrees", "chains", "fan_out", "fan_in"]


def classes(sig: DataFrame, k: int = 3) -> DataFrame:
    """(signature, size, deficient): modules of equal signature."""
    return sig.groupBy(F.concat_ws("|", *(F.col(c).cast("string") for c in SIGNATURE)).alias("signature")).agg(F.count("*").alias("size")).withColumn("deficient", F.col("size") < k)


def verdict(groups: DataFrame) -> DataFrame:
    """Least, mean and greatest class size and the chance of re-identification."""
    return groups.agg(F.min("size").alias("k_min"), F.round(F.avg("size"), 4).alias("k_avg"), F.max("size").alias("k_max"), F.round(1 / F.min("size"), 6).alias("p_reid"), F.sum(F.col("deficient").cast("long")).alias("deficient"))


NUMBERS = ("n_funcs", "internal", "ext_out", "ext_in", "chains", "fan_out", "fan_in")


def augmented(sig: DataFrame, k: int = 3) -> DataFrame:
    """One row per module (module, bucket, size, goal, added_functions, added_calls, distance) after augmentation to k-anonymity.

    Modules of classes with fewer than k members are sorted by their signature, so neighbours are near each other, and cut
    into buckets of k (the last may be larger). All of a bucket grow by synthetic functions and calls to the least signature
    that none of them exceeds: the greatest of each number and, place by place from the greatest down, of the out-degrees. So
    they share one signature and their class has at least k members; ``distance`` is the number of functions and calls added.
    Modules of classes that are large enough stay. Fewer than k deficient modules in all form one bucket, which may stay small.
    """
    from graphmill.operators.privacy import ranks

    own = F.concat_ws("|", *(F.col(c).cast("string") for c in SIGNATURE))
    named = cut(sig.withColumn("signature", own))
    sizes = named.groupBy("signature").agg(F.count("*").alias("size"))
    poor = named.join(sizes.where(F.col("size") < k), "signature", "left_semi").drop("signature")
    numbered = ranks(poor, None, [*NUMBERS, "degrees", "module"])
    total = numbered.agg(F.count("*").alias("total"))
    bucket = F.least(F.floor((F.col("n") - 1) / k), F.greatest(F.floor(F.col("total") / k) - 1, F.lit(0)))
    placed = cut(numbered.join(F.broadcast(total)).withColumn("bucket", bucket).drop("n", "total"))  # one row is broadcast
    top = placed.groupBy("bucket").agg(F.count("*").alias("size"), *(F.max(c).alias(f"goal_{c}") for c in NUMBERS))
    degrees = placed.select("bucket", F.posexplode(F.reverse(F.transform(F.split("degrees", ","), lambda d: d.cast("int")))).alias("pos", "degree"))
    best = degrees.groupBy("bucket", "pos").agg(F.max("degree").alias("degree")).groupBy("bucket").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "degree"))), lambda x: x["degree"].cast("string")), ",").alias("goal_degrees"))
    j = placed.join(top, "bucket").join(best, "bucket")
    calls = sum(((F.col(f"goal_{c}") - F.col(c)) for c in ("internal", "ext_out", "ext_in")), F.lit(0))
    grown = j.select("module", "bucket", "size", F.concat_ws("|", *(F.col(f"goal_{c}").cast("string") for c in SIGNATURE)).alias("goal"), (F.col("goal_n_funcs") - F.col("n_funcs")).alias("added_functions"), calls.alias("added_calls"))
    kept = named.join(sizes.where(F.col("size") >= k), "signature").select("module", F.lit(None).cast("long").alias("bucket"), "size", F.col("signature").alias("goal"), F.lit(0).cast("long").alias("added_functions"), F.lit(0).cast("long").alias("added_calls"))
    return kept.unionByName(grown).withColumn("distance", F.col("added_functions") + F.col("added_calls"))


def diversity(grown: DataFrame, roles: DataFrame, least: int = 2) -> DataFrame:
    """``grown`` with the module's role (module, role), the number of roles in its class and whether synthetic functions must take another role for the class to have ``least`` of them."""
    own = grown.join(roles, "module", "left").withColumn("role", F.coalesce("role", F.lit("utility")))
    per = own.groupBy("goal").agg(F.count_distinct("role").alias("roles"))
    return own.join(per, "goal").withColumn("swapped", (F.col("roles") < least) & F.col("bucket").isNotNull())


def overheads(sig: DataFrame, grown: DataFrame) -> DataFrame:
    """k_min, k_avg, k_max, p_reid of the classes after augmentation, and the share of functions and calls that were added."""
    sizes = grown.groupBy("goal").agg(F.count("*").alias("size"))
    verdict_ = sizes.agg(F.min("size").alias("k_min"), F.round(F.avg("size"), 4).alias("k_avg"), F.max("size").alias("k_max"), F.round(1 / F.min("size"), 6).alias("p_reid"))
    before = sig.agg(F.sum("n_funcs").alias("functions"), F.sum(F.col("internal") + F.col("ext_out") + F.col("ext_in")).alias("calls"))
    added = grown.agg(F.sum("added_functions").alias("f"), F.sum("added_calls").alias("c"))
    one = verdict_.crossJoin(before).crossJoin(added)  # one row each
    return one.select("k_min", "k_avg", "k_max", "p_reid", F.col("f").alias("added_functions"), F.col("c").alias("added_calls"), F.round(F.try_divide(F.col("f"), F.col("functions")), 6).alias("node_overhead"), F.round(F.try_divide(F.col("c"), F.col("calls")), 6).alias("edge_overhead"))


def query_jaccard(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """(query, jaccard) of named answers (one column of ids) before and after."""

    def one(name: str) -> DataFrame:
        a, b = before[name].toDF("id").distinct().withColumn("s", F.lit(1)), after[name].toDF("id").distinct().withColumn("s", F.lit(2))
        sides = a.unionByName(b).groupBy("id").agg(F.sum("s").alias("s"))
        return sides.agg(F.round(F.coalesce(F.avg((F.col("s") == 3).cast("double")), F.lit(1.0)), 6).alias("jaccard")).select(F.lit(name).alias("query"), "jaccard")

    return reduce(DataFrame.unionByName, [one(n) for n in before])
