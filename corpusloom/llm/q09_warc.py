from .common import table
from .queries import ORACLE, query
from .warc import round_trip


@query
def op9_warc(spark, sf_dir):
    """All pages written as WARC archives and read back along verified record chains."""
    return round_trip(table(spark, sf_dir, "pages")).drop("url")


ORACLE["op9_warc"] = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n::BIGINT AS payload_bytes, p.d AS payload_digest,
  CASE WHEN first IS NOT NULL AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d
"""
