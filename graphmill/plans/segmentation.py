"""Queries of scaling, correlation, clustering and recommendation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.operators import recommend as R
from graphmill.operators import stats as S
from graphmill.operators import transactions as T
from graphmill.plans.retail import CLEAN_SQL, cleaned
from graphmill.session import cut
from graphmill.sources import load

FEATURES = ["total_transactions", "total_products_purchased", "total_spend", "unique_products_purchased", "average_transaction_value"]

#: The survey's grid of 6 x 4 x 3 x 2 runs.
GRID = {"seeds": [1, 2, 5, 10, 20, 50], "iterations": [100, 250, 500, 1000], "ks": [3, 4, 8], "inits": ["k-means||", "random"]}


def features(spark: SparkSession, sf: str) -> DataFrame:
    """Numeric features per customer with a cluster from the market segment."""
    base = T.rfm(cleaned(spark, sf)).select("customer_id", *(F.col(c).cast("double").alias(c) for c in FEATURES))
    who = load(spark, sf, "customer").select(F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("segment"))
    return cut(base.join(who, "customer_id"))  # written once: statistics and models read it several times


def customers(spark: SparkSession, sf: str) -> DataFrame:
    """Every customer with a cluster."""
    return load(spark, sf, "customer").select(F.col("c_custkey").alias("customer_id"), (F.col("c_custkey") % 3).cast("int").alias("cluster"))


def outliers(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "customer").where("c_custkey % 20 = 0").select(F.col("c_custkey").alias("customer_id"))


def _rounded(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.round(c, 5) for c in columns})


def m1_scaler(spark, sf):
    return _rounded(S.standardize(features(spark, sf), FEATURES), FEATURES).drop("segment")


def m2_normalizer(spark, sf):
    return _rounded(S.normalize_rows(features(spark, sf), FEATURES[:3]), FEATURES[:3]).select("customer_id", *FEATURES[:3])


def pj22_supplied_scaling(spark, sf):
    return _rounded(S.apply_scaling(features(spark, sf), {"total_spend": (1000.0, 250.0), "total_transactions": (5.0, 2.0)}).select("customer_id", "total_spend", "total_transactions"), ["total_spend", "total_transactions"])


def m14_cosine(spark, sf):
    vectors = load(spark, sf, "embeddings").select("vec_id", "embedding")
    pairs = vectors.select(F.col("vec_id").alias("vec_a"), F.col("embedding").alias("a")).join(vectors.select((F.col("vec_id") - 1).alias("vec_a"), F.col("vec_id").alias("vec_b"), F.col("embedding").alias("b")), "vec_a")
    return pairs.select("vec_a", "vec_b", F.round(S.cosine("a", "b"), 5).alias("cosine"))


def _rows(spark, sf):
    return S.assembled(S.standardize(features(spark, sf), FEATURES), FEATURES, ["customer_id"])


def m8_kmeans(spark, sf):
    rows = _rows(spark, sf)
    return S.clustered(rows, S.kmeans_model(rows), "customer_id")


def a13_top_products(spark, sf):
    return R.top_products(cleaned(spark, sf), customers(spark, sf))


def j5_without_outliers(spark, sf):
    return R.without_customers(cleaned(spark, sf), outliers(spark, sf)).groupBy("customer_id").agg(F.count("*").alias("n_rows"))


def recommendations(spark, sf):
    return R.recommendations(cleaned(spark, sf), outliers(spark, sf), customers(spark, sf))


QUERIES = {
    "m1_scaler": m1_scaler,
    "m2_normalizer": m2_normalizer,
    "m3_correlation": lambda s, d: S.correlations(features(s, d), FEATURES),
    "pj22_supplied_scaling": pj22_supplied_scaling,
    "m15_histogram": lambda s, d: S.histogram(features(s, d), FEATURES, "segment"),
    "a15_cluster_share": lambda s, d: S.cluster_shares(load(s, d, "customer"), "c_mktsegment"),
    "a16_centroids": lambda s, d: S.centroids(features(s, d), FEATURES, "segment"),
    "m10_cluster_quality": lambda s, d: S.cluster_quality(load(s, d, "embeddings"), "embedding", "label"),
    "m14_cosine": m14_cosine,
    "m5_pca": lambda s, d: S.principal_components(features(s, d), FEATURES, "customer_id"),
    "m7_isolation_forest": lambda s, d: S.isolation_outliers(features(s, d), "customer_id", FEATURES),
    "pj6_inliers": lambda s, d: S.isolation_outliers(features(s, d), "customer_id", FEATURES).where("is_outlier = 0").select("customer_id"),
    "m8_kmeans": m8_kmeans,
    "m9_silhouette_sweep": lambda s, d: S.silhouettes(_rows(s, d)),
    "m11_parameter_grid": lambda s, d: S.parameter_grid(_rows(s, d), **GRID),
    "m12_forest_regression": lambda s, d: S.forest_regression(features(s, d), FEATURES[:2], "total_spend", "customer_id"),
    "a13_top_products": a13_top_products,
    "a14_purchases": lambda s, d: R.purchases(cleaned(s, d), customers(s, d)),
    "j5_without_outliers": j5_without_outliers,
    "recommendations": recommendations,
}

_FEATURES = f"""{CLEAN_SQL},
feat as (select c.customer_id, count(distinct invoice_no)::double total_transactions, sum(quantity)::double total_products_purchased, round(sum(unit_price * quantity), 4) total_spend, count(distinct stock_code)::double unique_products_purchased,
  round(round(sum(unit_price * quantity), 4) / count(distinct invoice_no), 4) average_transaction_value, any_value(c_mktsegment) segment from c join customer on c_custkey = c.customer_id group by 1)
"""
_F = lambda body: f"with {_FEATURES} {body}"
_scaled = lambda c: f"round(({c} - avg({c}) over ()) / case when stddev_pop({c}) over () > 0 then stddev_pop({c}) over () else 1 end, 5) {c}"
_norm = "nullif(sqrt(total_transactions * total_transactions + total_products_purchased * total_products_purchased + total_spend * total_spend), 0)"
_REC = f"""{CLEAN_SQL},
who as (select c_custkey customer_id, (c_custkey % 3)::int cluster from customer),
kept as (select c.* from c where customer_id % 20 <> 0),
sold as (select cluster, stock_code, description, sum(quantity)::bigint quantity from kept join who using (customer_id) group by 1, 2, 3),
top as (select * from (select *, row_number() over (partition by cluster order by quantity desc, stock_code, description) rank from sold) where rank <= 10),
bought as (select distinct customer_id, cluster, stock_code from kept join who using (customer_id)),
open as (select w.customer_id, w.cluster, stock_code, description, row_number() over (partition by w.customer_id order by rank) k from who w join top using (cluster)
  where not exists (select 1 from bought b where b.customer_id = w.customer_id and b.cluster = w.cluster and b.stock_code = top.stock_code))
"""

SQL = {
    "m1_scaler": _F("select customer_id, " + ", ".join(map(_scaled, FEATURES)) + " from feat"),
    "m2_normalizer": _F("select customer_id, " + ", ".join(f"round(coalesce({c} / {_norm}, 0), 5) {c}" for c in FEATURES[:3]) + " from feat"),
    "m3_correlation": _F(" union all ".join(f"select '{a}' a, '{b}' b, round(corr({a}, {b}), 6) corr, abs(corr({a}, {b})) > 0.8 strong from feat" for i, a in enumerate(FEATURES) for b in FEATURES[i + 1 :])),
    "pj22_supplied_scaling": _F("select customer_id, round((total_spend - 1000) / 250, 5) total_spend, round((total_transactions - 5) / 2, 5) total_transactions from feat"),
    "m15_histogram": _F(
        ", long as (" + " union all ".join(f"select segment, '{c}' feature, {c} v from feat" for c in FEATURES) + "), s as (select segment, feature, min(v) lo, max(v) hi from long group by 1, 2)"
        " select feature, segment as cluster, case when hi > lo then least(floor((v - lo) / ((hi - lo) / 20)), 19) else 0 end::int bin, count(*) n from long join s using (segment, feature) group by 1, 2, 3"
    ),
    "a15_cluster_share": "select c_mktsegment as cluster, round(100 * count(*) / sum(count(*)) over (), 4) percentage from customer group by 1",
    "a16_centroids": _F("select cluster, " + ", ".join(f"round(avg({c}), 6) {c}" for c in FEATURES) + " from (select segment as cluster, " + ", ".join(f"({c} - avg({c}) over ()) / stddev_pop({c}) over () {c}" for c in FEATURES) + " from feat) group by 1"),
    "m10_cluster_quality": """with x as (select label, vec_id, unnest(embedding)::double v, generate_subscripts(embedding, 1) d from embeddings),
c as (select label, d, avg(v) m, count(*) n from x group by 1, 2), g as (select d, avg(v) m from x group by 1),
b as (select sum(n * (c.m - g.m) ** 2) s from c join g using (d)), w as (select sum((v - m) ** 2) s from x join c using (label, d)),
k as (select count(distinct label) k, count(*) n from embeddings),
sp as (select label, avg(dist) s from (select label, vec_id, sqrt(sum((v - m) ** 2)) dist from x join c using (label, d) group by 1, 2) group by 1),
p as (select a.label la, b.label lb, sqrt(sum((a.m - b.m) ** 2)) dist from c a join c b on a.d = b.d and a.label <> b.label group by 1, 2),
db as (select avg(r) r from (select la, max((x.s + y.s) / dist) r from p join sp x on x.label = la join sp y on y.label = lb group by 1)),
nx as (select label, vec_id, sum(v * v) q from x group by 1, 2), ck as (select label, sum(q) s2, count(*) n from nx group by 1), dt as (select x.vec_id, c.label cl, sum(x.v * c.m) dot from x join c on c.d = x.d group by 1, 2),
ds as (select nx.vec_id, nx.label = cl own, n, q + s2 / n - 2 * dot dist from nx join dt on dt.vec_id = nx.vec_id join ck on ck.label = cl), ab as (select vec_id, max(case when own then dist * n / nullif(n - 1, 0) end) a, min(case when not own then dist end) b from ds group by 1),
si as (select avg(case when a is null then 0 else (b - a) / greatest(a, b) end) s from ab)
select round(si.s, 4) silhouette, round((b.s / (k - 1)) / (w.s / (n - k)), 4) calinski_harabasz, round(db.r, 4) davies_bouldin from b, w, k, db, si""",
    "m14_cosine": "select a.vec_id vec_a, b.vec_id vec_b, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: p[1]::double * p[2]::double)) / (sqrt(list_sum(list_transform(a.embedding, lambda x: x::double * x::double))) * sqrt(list_sum(list_transform(b.embedding, lambda x: x::double * x::double)))), 5) cosine from embeddings a join embeddings b on b.vec_id = a.vec_id + 1",
    "a13_top_products": f"with {_REC.replace('kept as (select c.* from c where customer_id % 20 <> 0)', 'kept as (select c.* from c)')} select cluster, stock_code, description, quantity, rank from top",
    "a14_purchases": f"with {CLEAN_SQL} select customer_id, (customer_id % 3)::int cluster, stock_code, sum(quantity)::bigint quantity from c group by 1, 2, 3",
    "j5_without_outliers": f"with {CLEAN_SQL} select customer_id, count(*) n_rows from c where customer_id % 20 <> 0 group by 1",
    "recommendations": f"with {_REC} select w.customer_id, w.cluster, " + ", ".join(f"max(case when k = {i} then stock_code end) rec{i}_code, max(case when k = {i} then description end) rec{i}_description" for i in (1, 2, 3)) + " from who w left join open using (customer_id) group by 1, 2",
}
