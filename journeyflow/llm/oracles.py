"""DuckDB SQL of the training-data operators that SQL can express."""

from __future__ import annotations

OP12 = """
WITH v AS (
  SELECT row_number() OVER () AS rn, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (
  SELECT q.rn AS qrn, q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.rn <> v.rn
  WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY qrn ORDER BY score DESC, vec_id) AS place FROM s)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM r WHERE place <= 5
"""

#: crc32 of a short ASCII text, bit by bit.
_CRC32 = """xor(4294967295, list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
    lambda c, b: list_reduce(list_prepend(xor(c, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"""


def _leaf(n_chars: str) -> str:
    fields = ["doc_id", "source", "lang", n_chars, "text"]
    return "sha256(concat(" + ", ".join(
        f"CASE WHEN {c} IS NULL THEN '-' ELSE concat(octet_length(encode(CAST({c} AS VARCHAR))), ':', CAST({c} AS VARCHAR)) END" for c in fields) + "))"


OP13 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, {_leaf("n_chars")} AS leaf,
         CASE WHEN n_chars IS NOT NULL AND {_CRC32} % 7 = 0 THEN {_leaf("(n_chars + 1)")} END AS changed
  FROM documents),
l AS (
  SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n
  FROM d),
low AS (
  SELECT g, 0 AS lvl, pos, n, leaf AS digest FROM l
  UNION ALL
  SELECT g, lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos)) FROM low WHERE n > 1 GROUP BY g, lvl + 1, pos // 2, (n + 1) // 2),
sub AS (SELECT g, digest AS subroot, lvl AS height FROM low WHERE n = 1),
top AS (
  SELECT 0 AS lvl, g AS pos, (SELECT count(*) FROM sub) AS n, subroot AS digest FROM sub
  UNION ALL
  SELECT lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY lvl + 1, pos // 2, (n + 1) // 2),
steps AS (
  SELECT l.g, l.pos, low.lvl AS k, low.pos % 2 = 1 AS sibling_left, s.digest AS sibling
  FROM l JOIN low ON low.g = l.g AND low.pos = l.pos >> low.lvl AND low.n > 1
  LEFT JOIN low AS s ON s.g = low.g AND s.lvl = low.lvl AND s.pos = xor(low.pos, 1)
  UNION ALL
  SELECT l.g, l.pos, sub.height + top.lvl, top.pos % 2 = 1, s.digest
  FROM l JOIN sub ON sub.g = l.g JOIN top ON top.pos = l.g >> top.lvl AND top.n > 1
  LEFT JOIN top AS s ON s.lvl = top.lvl AND s.pos = xor(top.pos, 1)),
folded AS (
  SELECT g, pos, 0 AS k, coalesce(changed, leaf) AS acc FROM l
  UNION ALL
  SELECT f.g, f.pos, f.k + 1, sha256(CASE WHEN s.sibling IS NULL THEN f.acc WHEN s.sibling_left THEN s.sibling || f.acc ELSE f.acc || s.sibling END)
  FROM folded AS f JOIN steps AS s ON s.g = f.g AND s.pos = f.pos AND s.k = f.k),
ends AS (SELECT g, pos, arg_max(acc, k) AS folded_root FROM folded GROUP BY g, pos),
proofs AS (SELECT g, pos, sha256(string_agg(coalesce(sibling, ''), '' ORDER BY k)) AS proof_sha256 FROM steps GROUP BY g, pos)
SELECT l.doc_id, l.leaf, sub.subroot, r.digest AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, e.folded_root, e.folded_root = r.digest AS verified
FROM l JOIN sub USING (g) JOIN ends AS e USING (g, pos) LEFT JOIN proofs AS p USING (g, pos) JOIN top AS r ON r.n = 1
"""

ORACLES = {"op12_pivot_topk": OP12, "op13_merkle_manifest": OP13}
