"""DuckDB SQL of scans, negatives and manifests."""

from __future__ import annotations

_CRC_TABLE = "crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i], range(0, 8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(0, 256) r(i)))"


def crc32(text: str) -> str:
    """CRC-32 of an ASCII text; takes the list t of ``crc``."""
    codes = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295], {codes}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


def _base62(n: str) -> str:
    digits = (f"substr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', CAST({n} // {62**k} % 62 AS INTEGER) + 1, 1)" for k in range(5, -1, -1))
    return " || ".join(digits)


def _matches(kind: str, place: int, pattern: str, group: int = 0) -> str:
    """Leftmost matches of a pattern with their places, from the pieces between them."""
    return f"""SELECT doc_id, '{kind}' AS kind, {place} AS place, m[i] AS m, judged[i] AS judged,
  CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s
FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS m, regexp_extract_all(text, '{pattern}', {group}) AS judged, string_split_regex(text, '{pattern}') AS gaps FROM documents WHERE text IS NOT NULL))"""


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_ASSIGN = f"""({_either("password")}|{_either("passwd")}|{_either("secret")}|{_either("token")}|{_either("api")}_?{_either("key")})["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
OP11_SQL = f"""
WITH {_CRC_TABLE},
found AS (
{_matches("assign", 0, _ASSIGN, 2)}
UNION ALL {_matches("access", 1, "AKIA[A-Z0-9]+")}
UNION ALL {_matches("hex", 2, "[0-9a-f]{32,}")}
UNION ALL {_matches("repo_token", 3, "gh[pousr]_[A-Za-z0-9]{36}" + chr(92) + "b")}
UNION ALL {_matches("package_token", 4, "npm_[A-Za-z0-9]{36}" + chr(92) + "b")}),
summed AS (SELECT found.*, {crc32("substr(m, length(m) - 35, 30)")} AS n FROM found, crc),
kept AS (
  SELECT *, kind || ':' || s || ':' || s + length(m) AS told FROM summed
  WHERE CASE kind WHEN 'assign' THEN length(judged) >= 8 WHEN 'access' THEN length(m) >= 16 WHEN 'hex' THEN true ELSE {_base62("n")} = right(m, 6) END)
SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(told, ',' ORDER BY s, place) FILTER (place < 3), '')) AS base_sha256, coalesce(string_agg(told, ',' ORDER BY s, place), '') AS spans
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id GROUP BY d.doc_id
"""

OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
pos AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM pos JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)
QUALIFY row_number() OVER w <= 10
"""

#: Levels that the SQL spells out: 8 ** 8 documents of a language, 8 ** 3 languages.
_LEVELS, _TOP = 8, 3


def _field(x: str) -> str:
    return f"coalesce(strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"


def _tree(name: str, levels: int) -> str:
    """CTEs of the levels above {name}0 (g, idx, digest, c), and of each node's siblings: left, right."""
    out = ""
    for k in range(levels):
        out += f""",
{name}{k + 1} AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM (
  SELECT g, idx // 8 AS idx, CASE WHEN any_value(c) > 1 THEN sha256(string_agg(digest, '' ORDER BY {name}{k}.idx)) ELSE any_value(digest) END AS digest FROM {name}{k} GROUP BY g, {name}{k}.idx // 8)),
{name}_around{k} AS MATERIALIZED (SELECT g, idx, c, coalesce(string_agg(digest, '') OVER (PARTITION BY g, idx // 8 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
  coalesce(string_agg(digest, '') OVER (PARTITION BY g, idx // 8 ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k})"""
    return out


def _fold(name: str, start: str, levels: int, g: str, idx: str) -> str:
    """CTEs that take cur and proof of ``start`` up the levels of a tree."""
    out = ""
    for k in range(levels):
        out += f""",
{name}_up{k + 1} AS MATERIALIZED (SELECT p.* EXCLUDE (cur, proof), CASE WHEN a.c > 1 THEN sha256(a.l || cur || a.r) ELSE cur END AS cur, CASE WHEN a.c > 1 THEN proof || a.l || a.r ELSE proof END AS proof
  FROM {start if k == 0 else f"{name}_up{k}"} p JOIN {name}_around{k} a ON a.g = {g} AND a.idx = {idx} // {8**k})"""
    return out


OP13_SQL = f"""
WITH {_CRC_TABLE},
docs AS (SELECT d.*, {crc32("CAST(doc_id AS VARCHAR)")} % 3 = 0 AS tampered FROM documents d, crc),
langs AS (SELECT lang AS named, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM (SELECT DISTINCT lang FROM docs)),
leaves AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank
  FROM (SELECT doc_id, g, {_leaf("text")} AS leaf, CASE WHEN tampered THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {_leaf("text")} END AS now
    FROM docs JOIN langs ON lang IS NOT DISTINCT FROM named)),
n0 AS MATERIALIZED (SELECT g, rank AS idx, leaf AS digest, count(*) OVER (PARTITION BY g) AS c FROM leaves){_tree("n", _LEVELS)},
s0 AS MATERIALIZED (SELECT 0 AS g, g AS idx, digest, count(*) OVER () AS c FROM n{_LEVELS}){_tree("s", _TOP)},
start AS (SELECT doc_id, g, rank, leaf, now AS cur, '' AS proof FROM leaves){_fold("n", "start", _LEVELS, "p.g", "p.rank")}{_fold("s", f"n_up{_LEVELS}", _TOP, "0", "p.g")}
SELECT u.doc_id, u.leaf, n.digest AS subroot, r.digest AS root, sha256(u.proof) AS proof_sha256, u.cur AS folded_root, u.cur = r.digest AS verified
FROM s_up{_TOP} u JOIN n{_LEVELS} n ON n.g = u.g, s{_TOP} r
"""
