from .common import table
from .hard_negatives import hard_negatives
from .queries import ORACLE, query


@query
def op11_hard_negatives(spark, sf_dir):
    """Hard negatives of every hundredth vector among all vectors, by bit-sliced products."""
    from pyspark.sql import functions as F

    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", "embedding", moved.alias("label")))


ORACLE["op11_hard_negatives"] = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id,
    CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.r AS ar, a.vec_id AS anchor_id, b.r AS br, b.vec_id AS id, a.label = b.label AS same,
    CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.r <> b.r
  WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT ar, anchor_id, id AS positive_id, br AS pr, score AS positive_score
  FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, id, br) <= 5),
mined AS (
  SELECT p.anchor_id, p.positive_id, n.id AS negative_id, p.positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.ar, p.pr ORDER BY n.score DESC, n.id, n.br) AS rank
  FROM positives p JOIN pairs n ON n.ar = p.ar AND NOT n.same
    AND 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM mined WHERE rank <= 10
"""
