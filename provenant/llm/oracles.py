"""SQL for the operators that it can express, written for an engine without CRC-32."""

from __future__ import annotations

#: CRC-32 of a text: the table of all bytes, then one step a byte of the text's hex form.
CRC = """crc_table AS (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, b)) AS crcs
)"""


def crc(text: str) -> str:
    """The unsigned CRC-32 of a text, where ``crcs`` of ``crc_table`` is in reach."""
    byte = f"CAST('0x' || substr(hex({text}), 2 * i + 1, 2) AS BIGINT)"
    return f"xor(4294967295, list_reduce(range(CAST(length(hex({text})) // 2 AS BIGINT)), lambda v, i: xor(v // 256, crcs[CAST(xor(v % 256, {byte}) AS BIGINT) + 1]), 4294967295))"


def _part(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE strlen(CAST({column} AS VARCHAR)) || ':' || {column} END"


def manifest_sql(levels: int = 6, top_levels: int = 3) -> str:
    """Levels of nodes by source and over the sources, then each document's digest folded upward; up to 16 to the ``levels`` rows a source."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    parts = [_part(c) for c in ("doc_id", "source", "lang", "n_chars")]
    leaf, lowered = (f"sha256({' || '.join([*parts, _part(t)])})" for t in ("text", f"translate(text, '{capitals}', '{capitals.lower()}')"))
    out = [
        CRC,
        f"t AS (SELECT doc_id, source, {leaf} AS leaf, CASE WHEN {crc('CAST(doc_id AS VARCHAR)')} % 5 = 0 THEN {lowered} ELSE {leaf} END AS claim FROM documents, crc_table)",
        "a0 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS size FROM t)",
        "n0 AS (SELECT source, pos, size, leaf AS digest FROM a0)",
        "f0 AS (SELECT doc_id, source, leaf, leaf AS digest, claim, pos, size, '' AS proof FROM a0)",
    ]
    others = "array_to_string(list_concat(list_slice(children, 1, pos % 16), list_slice(children, pos % 16 + 2, 16)), '')"
    turned = "array_to_string(list_concat(list_slice(children, 1, pos % 16), [claim], list_slice(children, pos % 16 + 2, 16)), '')"
    for k in range(levels):
        out.append(f"n{k + 1} AS (SELECT source, pos // 16 AS pos, (max(size) + 15) // 16 AS size, list(digest ORDER BY pos) AS children, sha256(string_agg(digest, '' ORDER BY pos)) AS digest FROM n{k} WHERE size > 1 GROUP BY source, pos // 16)")
        out.append(
            f"f{k + 1} AS (SELECT doc_id, source, leaf, digest, claim, pos, size, proof FROM f{k} WHERE size = 1 UNION ALL "
            f"SELECT f.doc_id, f.source, f.leaf, n.digest, sha256({turned.replace('pos', 'f.pos')}), n.pos, n.size, f.proof || {others.replace('pos', 'f.pos')} FROM f{k} f JOIN n{k + 1} n ON f.source IS NOT DISTINCT FROM n.source AND f.pos // 16 = n.pos WHERE f.size > 1)"
        )
    out.append(f"s AS (SELECT DISTINCT source, digest FROM f{levels})")
    out.append("m0 AS (SELECT source, digest, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS size FROM s)")
    out.append(f"g0 AS (SELECT f.doc_id, f.leaf, f.digest AS subroot, f.digest, f.claim, m.pos, m.size, f.proof FROM f{levels} f JOIN m0 m ON f.source IS NOT DISTINCT FROM m.source)")
    for k in range(top_levels):
        out.append(f"m{k + 1} AS (SELECT pos // 16 AS pos, (max(size) + 15) // 16 AS size, list(digest ORDER BY pos) AS children, sha256(string_agg(digest, '' ORDER BY pos)) AS digest FROM m{k} WHERE size > 1 GROUP BY pos // 16)")
        out.append(
            f"g{k + 1} AS (SELECT doc_id, leaf, subroot, digest, claim, pos, size, proof FROM g{k} WHERE size = 1 UNION ALL "
            f"SELECT g.doc_id, g.leaf, g.subroot, m.digest, sha256({turned.replace('pos', 'g.pos')}), m.pos, m.size, g.proof || {others.replace('pos', 'g.pos')} FROM g{k} g JOIN m{k + 1} m ON g.pos // 16 = m.pos WHERE g.size > 1)"
        )
    return "WITH " + ",\n".join(out) + f"\nSELECT doc_id, leaf, subroot, digest AS root, sha256(proof) AS proof_sha256, claim AS folded_root, claim = digest AS verified FROM g{top_levels}"


def resampling_sql() -> str:
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = f"regexp_extract_all(translate(text, '{capitals}', '{capitals.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""WITH {CRC},
d AS (SELECT doc_id, row_number() OVER () AS r, coalesce({words}, CAST([] AS VARCHAR[])) AS ws FROM documents),
dw AS (SELECT r, unnest(ws) AS w FROM d),
bw AS (SELECT unnest({words}) AS w FROM benchmark),
hashed AS (SELECT w, {crc('w')} % 10000 AS bucket FROM (SELECT w FROM dw UNION SELECT w FROM bw), crc_table),
dc AS (SELECT r, bucket, count(*) AS c FROM dw JOIN hashed USING (w) GROUP BY ALL),
s AS (SELECT bucket, sum(c) AS s FROM dc GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bw JOIN hashed USING (w) GROUP BY bucket),
n AS (SELECT (SELECT coalesce(sum(s), 0) FROM s)::DOUBLE AS sa, (SELECT coalesce(sum(t), 0) FROM t)::DOUBLE AS ta),
g AS (SELECT s.bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (sa + 10000) / ((s + 1)::DOUBLE * (ta + 10000)))) AS gain FROM s LEFT JOIN t USING (bucket), n),
w AS (SELECT r, sum(c * gain) AS weight FROM dc JOIN g USING (bucket) GROUP BY r),
e AS (
  SELECT r, doc_id, CAST(len(ws) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
  FROM d LEFT JOIN w USING (r)
), f AS (
  SELECT r, doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM e
), k AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place, 10 * count(*) OVER () // 100 AS most FROM f WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= most THEN place END AS rank FROM f LEFT JOIN k USING (r)"""


def near_copies_sql() -> str:
    """All pairs, then the least id that links reach."""
    return """WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), u AS (
  SELECT r, e FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.r AS a, b.r AS b FROM u a JOIN u b ON a.r <> b.r AND list_cosine_similarity(a.e, b.e) >= 0.95
), reach AS (
  SELECT r AS a, r AS b FROM v
  UNION
  SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a
), c AS (
  SELECT reach.a AS r, min(v.vec_id) AS component_id FROM reach JOIN v ON reach.b = v.r GROUP BY reach.a
), n AS (
  SELECT a AS r, count(*) AS n_links FROM l GROUP BY a
)
SELECT v.vec_id, coalesce(n_links, 0) AS n_links, component_id, v.vec_id IS NOT DISTINCT FROM component_id AS kept FROM v JOIN c USING (r) LEFT JOIN n USING (r)"""
