from .common import table
from .exact_dedup import exact_groups
from .queries import ORACLE, query


@query
def op6_exact_dedup(spark, sf_dir):
    """Exact copies among all documents, by merged counting quotient filters."""
    return exact_groups(table(spark, sf_dir, "documents"))


ORACLE["op6_exact_dedup"] = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id,
  count(*) OVER (PARTITION BY norm) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept,
  sha256(norm) AS text_sha256
FROM d
"""
