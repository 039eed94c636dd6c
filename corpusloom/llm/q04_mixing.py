from .common import table
from .mixing import mix
from .queries import ORACLE, query


@query
def op4_mixing(spark, sf_dir):
    """All documents mixed to source weights 5, 2, 1, repeating."""
    return mix(table(spark, sf_dir, "documents")).drop("source")


ORACLE["op4_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS cap FROM d GROUP BY source),
w AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS n,
    [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM s),
p AS (
  SELECT *, (sum(source_size) OVER ()
      - coalesce(sum(cap) OVER (ORDER BY cap / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(weight) OVER ()
      - coalesce(sum(weight) OVER (ORDER BY cap / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level
  FROM w),
water AS (SELECT min_by(level, (cap / weight, n)) AS water, min((cap / weight, n)) AS k FROM p WHERE level * weight <= cap),
goals AS (
  SELECT source, source_size, CASE WHEN (cap / weight, n) >= k THEN least(water * weight, cap::DOUBLE) ELSE cap::DOUBLE END AS target
  FROM p, water),
r AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, floor(g.target)::BIGINT AS budget,
    CASE WHEN g.source_size > 0 THEN floor(g.target)::BIGINT // g.source_size ELSE 0 END::BIGINT AS epochs,
    (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id NULLS FIRST, d.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size)::BIGINT AS place
  FROM d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
  (epochs * size + greatest(0, least(size, budget - epochs * source_size - place)))::BIGINT AS taken, epochs, place
FROM r
"""
