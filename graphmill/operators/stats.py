"""Scaling, correlation, histograms, cluster quality, and the models of the segmentation."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphmill.session import cut


def check_threshold(value: float) -> float:
    """value, or ValueError unless 0 < value < 1."""
    if not 0 < value < 1:
        raise ValueError("the threshold must lie between 0 and 1")
    return value


def _columns(df: DataFrame, columns: list[str], least: int = 1) -> list[str]:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"missing columns: {missing}")
    if len(columns) < least:
        raise ValueError(f"at least {least} columns are needed")
    return columns


def standardize(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / population deviation; a constant column is divided by 1. One pass gives all statistics (one row)."""
    _columns(df, columns)
    stats = df.agg(*(F.avg(c).alias(f"__m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"__s_{c}") for c in columns))
    wide = df.join(F.broadcast(stats))  # one row
    scale = lambda c: F.when(F.col(f"__s_{c}") > 0, F.col(f"__s_{c}")).otherwise(1.0)
    return wide.withColumns({c: (F.col(c) - F.col(f"__m_{c}")) / scale(c) for c in columns}).select(*df.columns)


def normalize_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each row's columns divided by their Euclidean length; a zero row stays zero."""
    _columns(df, columns)
    norm = F.sqrt(reduce(lambda a, b: a + b, [F.col(c) * F.col(c) for c in columns]))
    return df.withColumns({c: F.coalesce(F.try_divide(F.col(c), F.nullif(norm, F.lit(0.0))), F.lit(0.0)) for c in columns})


def apply_scaling(df: DataFrame, stats: dict[str, tuple[float, float]]) -> DataFrame:
    """Scaling with supplied (mean, deviation) pairs."""
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in stats.items()})


def correlations(df: DataFrame, columns: list[str], threshold: float = 0.8) -> DataFrame:
    """(a, b, corr, strong) for each pair of columns, all from one pass."""
    check_threshold(threshold)
    pairs = list(combinations(_columns(df, columns, 2), 2))
    wide = df.agg(*(F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)))
    rows = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("corr")) for i, (a, b) in enumerate(pairs)))
    return wide.select(F.explode(rows).alias("r")).select("r.a", "r.b", F.round("r.corr", 6).alias("corr"), (F.abs("r.corr") > threshold).alias("strong"))


def histogram(df: DataFrame, features: list[str], cluster: str, bins: int = 20) -> DataFrame:
    """(feature, cluster, bin, n): equal-width bins between the least and greatest value per feature and cluster."""
    long = df.unpivot([cluster], features, "feature", "value").where("value is not null")
    span = long.groupBy("feature", cluster).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    slot = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("value") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")
    return long.join(span, ["feature", cluster]).groupBy("feature", F.col(cluster).alias("cluster"), slot.alias("bin")).agg(F.count("*").alias("n"))


def cluster_shares(df: DataFrame, cluster: str) -> DataFrame:
    """Percentage of rows per cluster."""
    counts = df.groupBy(F.col(cluster).alias("cluster")).agg(F.count("*").alias("n"))
    return counts.select("cluster", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4).alias("percentage"))  # a row per cluster


def centroids(df: DataFrame, features: list[str], cluster: str) -> DataFrame:
    """Mean of the standardized features per cluster."""
    return standardize(df, features).groupBy(F.col(cluster).alias("cluster")).agg(*(F.round(F.avg(c), 6).alias(c) for c in features))


def cosine(a: str, b: str) -> F.Column:
    """Cosine of two arrays: the product runs over the shorter one, the lengths over all; 0 where a length is zero."""
    n = F.least(F.size(a), F.size(b))
    left, right = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)
    add = lambda arr: F.aggregate(arr, F.lit(0.0), lambda s, x: s + x)
    dot = add(F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double")))
    norm = lambda c: F.sqrt(add(F.transform(F.col(c), lambda x: x.cast("double") * x.cast("double"))))
    length = norm(a) * norm(b)
    return F.when(F.least(F.size(a), F.size(b)) <= 0, 0.0).otherwise(F.coalesce(F.try_divide(dot, F.nullif(length, F.lit(0.0))), F.lit(0.0)))


def cluster_quality(df: DataFrame, vector: str, label: str) -> DataFrame:
    """Silhouette (squared Euclidean, from sums per cluster and not from pairs), Calinski-Harabasz and Davies-Bouldin index of given labels, from vector summaries: one row per cluster leaves the first pass. Null where they are not defined (no rows, one cluster)."""
    rows = df.select(F.col(label).alias("label"), array_to_vector(F.col(vector)).alias("v"))
    per = rows.groupBy("label").agg(Summarizer.metrics("mean", "variance", "count").summary(F.col("v")).alias("s")).select("label", "s.mean", "s.variance", "s.count")
    own = rows.join(F.broadcast(per.select("label", vector_to_array("mean").alias("c"))), "label")  # a row per cluster
    gap = F.sqrt(F.aggregate(F.zip_with(vector_to_array("v"), "c", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    spread = own.groupBy("label").agg(F.avg(gap).alias("spread"))
    table = per.select("label", vector_to_array("mean").alias("mean"), vector_to_array("variance").alias("variance"), "count").join(spread, "label").toPandas()  # a row per cluster
    none = "silhouette double, calinski_harabasz double, davies_bouldin double"
    if table.empty:
        return df.sparkSession.createDataFrame([(None, None, None)], none)
    silhouette = ClusteringEvaluator(featuresCol="v", predictionCol="label").evaluate(rows) if len(table) > 1 else None
    means, n = np.array(table["mean"].tolist()), table["count"].to_numpy(float)
    within = float(sum((c - 1) * np.sum(v) for c, v in zip(n, table["variance"], strict=True)))
    between = float((n * ((means - np.average(means, axis=0, weights=n)) ** 2).sum(1)).sum())
    k, total = len(n), n.sum()
    apart = np.sqrt(((means[:, None] - means[None]) ** 2).sum(-1))
    s = table["spread"].to_numpy(float)
    ratio = np.where(np.eye(k, dtype=bool), -np.inf, (s[:, None] + s[None]) / np.where(apart > 0, apart, np.nan))
    ch = (between / (k - 1)) / (within / (total - k)) if k > 1 and total > k and within > 0 else None
    db = float(np.nanmax(ratio, axis=1).mean()) if k > 1 else None
    return df.sparkSession.createDataFrame([tuple(None if x is None else round(float(x), 4) for x in (silhouette, ch, db))], none)


# ---- models


def assembled(df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=_columns(df, columns), outputCol="features", handleInvalid="skip").transform(df).select(*keep, "features")


def components_needed(ratios: list[float], threshold: float, strict: bool = True) -> int:
    """Components to keep: the least number whose ratios sum above the threshold, plus one (``strict``), at most all."""
    check_threshold(threshold)
    total = 0.0
    for i, r in enumerate(ratios, 1):
        total += r
        if total > threshold:
            return min(len(ratios), i + 1 if strict else i)
    return len(ratios)


def principal_components(df: DataFrame, columns: list[str], key: str, threshold: float = 0.8, strict: bool = True) -> DataFrame:
    """Scores pc1.. of the centred columns; needs at least four columns."""
    _columns(df, columns, 4)
    centred = standardize(df, columns)
    rows = assembled(centred, columns, [key])
    model = PCA(k=min(8, len(columns)), inputCol="features", outputCol="pc").fit(rows)
    k = components_needed(list(model.explainedVariance), threshold, strict)
    scores = vector_to_array("pc")
    return model.transform(rows).select(key, *(scores[i].alias(f"pc{i + 1}") for i in range(k)))


def _tree(x: np.ndarray, depth: int, rng: np.random.Generator):
    n = len(x)
    if n <= 1 or depth == 0:
        return n
    col = int(rng.integers(x.shape[1]))
    lo, hi = x[:, col].min(), x[:, col].max()
    if lo == hi:
        return n
    cut = float(rng.uniform(lo, hi))
    left = x[:, col] < cut
    return (col, cut, _tree(x[left], depth - 1, rng), _tree(x[~left], depth - 1, rng))


def _expected(n: np.ndarray | float):
    n = np.maximum(n, 1.0)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / n, np.where(n == 2, 1.0, 0.0))


def _depths(node, x: np.ndarray, depth: int = 0) -> np.ndarray:
    if isinstance(node, int):
        return np.full(len(x), depth + float(_expected(float(node))))
    col, cut, left, right = node
    out, low = np.empty(len(x)), x[:, col] < cut
    out[low], out[~low] = _depths(left, x[low], depth + 1), _depths(right, x[~low], depth + 1)
    return out


def isolation_outliers(df: DataFrame, key: str, columns: list[str], contamination: float = 0.05, trees: int = 100, sample: int = 256, seed: int = 0) -> DataFrame:
    """(key, score, is_outlier): isolation forest. Trees grow on ``trees * sample`` rows at most (by hash of the key); every row is scored."""
    check_threshold(contamination)
    rng = np.random.default_rng(seed)
    known = cut(df.select(key, *(F.col(c).cast("double").alias(c) for c in _columns(df, columns))).na.drop())
    x = known.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(trees * sample).select(*columns).toPandas().to_numpy(float)
    if not len(x):
        return known.select(key, F.lit(0.0).alias("score"), F.lit(0).alias("is_outlier"))
    size = min(sample, len(x))
    forest = df.sparkSession.sparkContext.broadcast([_tree(x[rng.choice(len(x), size, replace=False)], int(np.ceil(np.log2(max(2, size)))), rng) for _ in range(trees)])

    @F.pandas_udf("double")
    def score(*values: pd.Series) -> pd.Series:
        rows = np.stack([v.to_numpy(float) for v in values], 1)
        mean = np.mean([_depths(t, rows) for t in forest.value], axis=0)
        return pd.Series(2.0 ** (-mean / max(1e-9, float(_expected(float(size))))))

    scored = cut(known.select(key, score(*(F.col(c) for c in columns)).alias("score")))
    limit = scored.agg(F.percentile_approx("score", 1 - contamination, 10_000).alias("limit"))
    return scored.join(F.broadcast(limit)).select(key, "score", (F.col("score") > F.col("limit")).cast("int").alias("is_outlier"))  # one row is broadcast


def kmeans_model(rows: DataFrame, k: int = 3, seeds: range = range(10), iterations: int = 100) -> KMeansModel:
    """The model of least cost among several seeds."""
    rows.persist()
    try:
        models = [KMeans(k=k, seed=s, maxIter=iterations).fit(rows) for s in seeds]
        return min(models, key=lambda m: m.summary.trainingCost)
    finally:
        rows.unpersist()


def clustered(rows: DataFrame, model: KMeansModel, key: str) -> DataFrame:
    """(key, cluster) with clusters numbered by size, the largest 0, ties by their old number."""
    found = model.transform(rows).select(key, "prediction")
    sizes = found.groupBy("prediction").agg(F.count("*").alias("n"))
    rank = sizes.select("prediction", (F.row_number().over(Window.orderBy(F.desc("n"), "prediction")) - 1).alias("cluster"))  # k rows
    return found.join(F.broadcast(rank), "prediction").select(key, "cluster")  # k rows


def silhouettes(rows: DataFrame, ks: range = range(2, 16), seed: int = 0) -> DataFrame:
    """(k, silhouette, best): mean silhouette (squared Euclidean) for each number of clusters."""
    rows.persist()
    try:
        judge = ClusteringEvaluator(featuresCol="features", predictionCol="prediction")
        found = [(k, float(judge.evaluate(KMeans(k=k, seed=seed).fit(rows).transform(rows)))) for k in ks]
    finally:
        rows.unpersist()
    best = max(found, key=lambda x: x[1])[0]
    return rows.sparkSession.createDataFrame([(k, s, k == best) for k, s in found], "k int, silhouette double, best boolean")


def parameter_grid(rows: DataFrame, seeds: list[int], iterations: list[int], ks: list[int], inits: list[str]) -> DataFrame:
    """Cost and silhouette of each combination.

    A fit that settles before its limit of iterations is also the fit of every higher limit, so it is made once.
    """
    rows.persist()
    judge = ClusteringEvaluator(featuresCol="features", predictionCol="prediction")
    out = []
    try:
        for seed in seeds:
            for k in ks:
                for init in inits:
                    settled, figures = False, ()
                    for n in sorted(iterations):
                        if not settled:
                            model = KMeans(k=k, seed=seed, maxIter=n, initMode=init).fit(rows)
                            settled = model.summary.numIter < n
                            figures = (float(model.summary.trainingCost), float(judge.evaluate(model.transform(rows))))
                        out.append((seed, n, k, init, *figures))
    finally:
        rows.unpersist()
    return rows.sparkSession.createDataFrame(out, "seed int, iterations int, k int, init string, cost double, silhouette double")


def forest_regression(df: DataFrame, columns: list[str], target: str, order: str, share: float = 0.8, trees: int = 20, seed: int = 0) -> DataFrame:
    """(order, target, prediction) of the last rows in ``order``, from a random forest on the first ``share``; the split point is an exact percentile."""
    at = df.agg(F.percentile(order, share).alias("at"))
    marked = df.join(F.broadcast(at))  # one row
    model = RandomForestRegressor(featuresCol="features", labelCol=target, numTrees=trees, seed=seed).fit(assembled(marked.where(f"{order} <= at"), columns, [order, target]))
    return model.transform(assembled(marked.where(f"{order} > at"), columns, [order, target])).select(order, target, "prediction")
