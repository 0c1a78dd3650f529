"""Queries of validation, repair and before-after comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphmill.functions import text as X
from graphmill.operators import graph as G
from graphmill.operators import privacy as P
from graphmill.operators import stats as S
from graphmill.plans.segmentation import _rows
from graphmill.session import cut
from graphmill.sources import load


def _code(spark, sf):
    return load(spark, sf, "code_entities_full")


def w11_word_replacement(spark, sf):
    """Documentation with the names of functions replaced by placeholders, word by word."""
    names = _code(spark, sf).where("kind in ('function', 'method') and name is not null").groupBy(F.substring_index("name", ".", -1).alias("name")).agg(F.concat(F.lit("func_"), F.min("entity_id").cast("string")).alias("placeholder"))
    return P.replace_words(_code(spark, sf).where("doc is not null and doc <> ''").select("entity_id", "doc"), "entity_id", "doc", names)


def m13_predictions(spark, sf):
    """Clusters of a batch of requests (a fifth of the customers, by hash) by a model fitted on all others, with both scaled alike."""
    rows = cut(_rows(spark, sf))
    asked = F.pmod(F.xxhash64("customer_id"), F.lit(5)) == 0
    model = S.kmeans_model(rows.where(~asked))
    return model.transform(rows.where(asked)).select("customer_id", F.col("prediction").alias("cluster"))


QUERIES = {
    "m13_predictions": m13_predictions,
    "so4_distinct_values": lambda s, d: _code(s, d).select("kind").distinct(),
    "w11_word_replacement": w11_word_replacement,
}

_q = lambda p: p.replace("'", "''")



SQL = {
    "so4_distinct_values": "select distinct kind from code_entities_full",
    "w11_word_replacement": "with n as (select list_last(string_split(name, '.')) w, 'func_' || min(entity_id)::varchar p from code_entities_full where kind in ('function', 'method') and name is not null group by 1), t as (select entity_id, unnest(l) w, generate_subscripts(l, 1) i from (select entity_id, regexp_extract_all(doc, '[A-Za-z0-9_]+|[^A-Za-z0-9_]+', 0) l from code_entities_full where doc <> '')) select entity_id, string_agg(coalesce(p, t.w), '' order by i) doc from t left join n on n.w = t.w group by 1",
}
