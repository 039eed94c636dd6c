from pyspark.sql import functions as F

from .common import table
from .merkle import manifest
from .queries import ORACLE, query


@query
def op12_merkle(spark, sf_dir):
    """Merkle manifest of all documents by source, with proofs checked against a tampered copy."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return manifest(table(spark, sf_dir, "documents"), changed=(tampered, {"text": lower}))


#: Levels of a tree that the SQL unrolls: 16 ** 7 leaves.
_LEVELS = 7


def _enc(x: str) -> str:
    return f"coalesce(strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join([*map(_enc, ("doc_id", "source", "lang", "n_chars")), _enc(text)]) + ")"


def _tree(name: str, bottom: str, by: str) -> str:
    """CTEs of all levels of trees: ``name{level}`` (by, idx, digest, n), one node a tree where n is 1."""
    out = [f"{name}0 AS ({bottom})"]
    for i in range(_LEVELS):
        out.append(f"""{name}{i + 1} AS (
  SELECT {by}, idx // 16 AS idx, CASE WHEN any_value(n) = 1 THEN any_value(digest) ELSE sha256(string_agg(digest, '' ORDER BY idx)) END AS digest,
    (any_value(n) + 15) // 16 AS n
  FROM {name}{i} GROUP BY {by}, idx // 16)""")
    return ",\n".join(out)


def _path(name: str, trees: str, by: str) -> str:
    """For every leaf place of ``trees``: its siblings, left and right of it, level by level."""
    levels = " UNION ALL ".join(
        f"""SELECT p.{by}, p.idx AS leaf_idx, {i} AS level, coalesce(string_agg(s.digest, '' ORDER BY s.idx) FILTER (s.idx < p.idx // {16**i}), '') AS l,
    coalesce(string_agg(s.digest, '' ORDER BY s.idx) FILTER (s.idx > p.idx // {16**i}), '') AS r
  FROM {trees}0 p JOIN {trees}{i} s ON s.{by} = p.{by} AND s.idx // 16 = p.idx // {16 ** (i + 1)} AND s.n > 1
  GROUP BY p.{by}, p.idx"""
        for i in range(_LEVELS)
    )
    return f"{name} AS ({levels})"


_STEPS = 2 * _LEVELS

ORACLE["op12_merkle"] = f"""
WITH crc_table AS (
  SELECT list(list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, o: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS t
  FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS b)),
docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('s' || source, '') AS grp, {_leaf("text")} AS leaf,
    xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % 5 = 0 AS tampered,
    {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS other
  FROM documents, crc_table),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS idx,
    count(*) OVER (PARTITION BY grp) AS n, dense_rank() OVER (ORDER BY grp) - 1 AS g FROM docs),
{_tree("a", "SELECT g, idx, leaf AS digest, n FROM placed", "g")},
{_tree("b", f"SELECT 0 AS z, g AS idx, digest, (SELECT count(*) FROM a{_LEVELS}) AS n FROM a{_LEVELS}", "z")},
{_path("pa", "a", "g")},
{_path("pb", "b", "z")},
steps AS (
  SELECT g, idx, list(l ORDER BY level) AS ls, list(r ORDER BY level) AS rs FROM (
    SELECT g, leaf_idx AS idx, level, l, r FROM pa
    UNION ALL SELECT p.g, p.idx, {_LEVELS} + level, pb.l, pb.r FROM placed p JOIN pb ON pb.leaf_idx = p.g)
  GROUP BY g, idx),
folded AS (
  SELECT p.doc_id, p.leaf, a{_LEVELS}.digest AS subroot, b{_LEVELS}.digest AS root,
    sha256(list_reduce(list_concat([''], list_transform(coalesce(range(len(ls)), []), lambda i: ls[i + 1] || rs[i + 1])), lambda x, y: x || y)) AS proof_sha256,
    list_reduce(list_concat([CASE WHEN tampered THEN other ELSE leaf END], list_transform(coalesce(range(len(ls)), []), lambda i: ls[i + 1] || '|' || rs[i + 1])),
      lambda d, lr: sha256(split_part(lr, '|', 1) || d || split_part(lr, '|', 2))) AS folded_root
  FROM placed p LEFT JOIN steps s USING (g, idx) JOIN a{_LEVELS} ON a{_LEVELS}.g = p.g CROSS JOIN b{_LEVELS})
SELECT *, folded_root = root AS verified FROM folded
"""
