"""Queries of the training-data operators, and their SQL where it can express them."""

from __future__ import annotations

from memlake.llm import components, containers, format_copies, fusion, near_duplicates, neighbours, pii, subjects, tokens
from memlake.runtime import Scratch, table

QUERIES = {
    "p1_found": lambda s, d: neighbours.neighbours(table(s, d, "memory_embeddings")),
    "p1_search": lambda s, d: (lambda t: neighbours.graph_search(t, t.filter("rowid % 20 = 0")))(table(s, d, "memory_embeddings")),
    "p3_found": lambda s, d: components.link_groups(table(s, d, "memory_graph"), table(s, d, "memories")),
    "p4_found": lambda s, d: near_duplicates.near_duplicates(table(s, d, "memories")),
    "p5_found": lambda s, d: format_copies.copies(table(s, d, "memories")),
    "p6_found": lambda s, d: pii.personal_information(table(s, d, "memories"), table(s, d, "given_names")),
    "p6_redacted": lambda s, d: pii.redacted(table(s, d, "memories"), table(s, d, "given_names")),
    "p7_found": lambda s, d: fusion.survivors(table(s, d, "duplicate_sets"), table(s, d, "memories")),
    "p7_fused": lambda s, d: fusion.fuse(fusion.claims(table(s, d, "duplicate_sets"), table(s, d, "memories"))),
    "p8_ids": lambda s, d: tokens.encode(table(s, d, "documents")),
    "p8_decoded": lambda s, d: tokens.decode(tokens.encode(table(s, d, "documents"))),
    "p9_containers": lambda s, d: containers.fill(Scratch(s).save(tokens.token_counts(table(s, d, "documents")), "counts")),
    "p10_found": lambda s, d: subjects.classify(table(s, d, "documents"), table(s, d, "subject_areas"), table(s, d, "subject_labels")),
    "p5_counts": lambda s, d: format_copies.copy_counts(table(s, d, "memories")),
}

SQL: dict[str, str] = {
    "p7_found": """
WITH m AS (
  SELECT DISTINCT s.set_id, e.id,
    CASE WHEN NOT isnan(e.strength) AND e.strength BETWEEN 0.3 AND 5.0 THEN e.strength END AS strength,
    CASE WHEN isnan(e.updated_at) THEN NULL WHEN e.updated_at BETWEEN 1577836800 AND 1772323200 THEN e.updated_at
         WHEN e.updated_at BETWEEN 1577836800000 AND 1772323200000 THEN e.updated_at / 1000 END AS upd,
    CASE WHEN json_valid(e.metadata) AND json_type(CASE WHEN json_valid(e.metadata) THEN e.metadata END) = 'OBJECT' THEN e.metadata END AS j
  FROM duplicate_sets s JOIN memories e ON e.id = s.memory_id),
n AS (
  SELECT set_id, id, strength, coalesce(upd, -1) AS t, upd, j,
    CASE WHEN json_type(j, '$.credibility') IN ('BIGINT', 'UBIGINT', 'DOUBLE') AND CAST(j ->> '$.credibility' AS DOUBLE) BETWEEN 0 AND 1 THEN CAST(j ->> '$.credibility' AS DOUBLE) ELSE -1 END AS trust,
    CASE WHEN j IS NOT NULL THEN len(list_filter(json_keys(j), lambda k: json_type(j, '$."' || k || '"') <> 'NULL' AND NOT (json_type(j, '$."' || k || '"') = 'VARCHAR' AND trim(j ->> ('$."' || k || '"'), ' ' || chr(9) || chr(10) || chr(13)) = ''))) END AS filled
  FROM m)
SELECT set_id, 'strength' AS field_name, id AS winner_id FROM n WHERE strength IS NOT NULL QUALIFY row_number() OVER (PARTITION BY set_id ORDER BY trust DESC, t DESC, id) = 1
UNION ALL SELECT set_id, 'updated_at', id FROM n WHERE upd IS NOT NULL QUALIFY row_number() OVER (PARTITION BY set_id ORDER BY upd DESC, id) = 1
UNION ALL SELECT set_id, 'metadata', id FROM n WHERE j IS NOT NULL QUALIFY row_number() OVER (PARTITION BY set_id ORDER BY filled DESC, t DESC, id) = 1
""",
    "p3_found": r"""
WITH RECURSIVE c AS (SELECT lower(regexp_replace(h, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS h FROM (SELECT source_hash AS h FROM memory_graph UNION ALL SELECT target_hash FROM memory_graph UNION ALL SELECT content_hash FROM memories)),
known AS (SELECT DISTINCT regexp_replace(h, '^sha256:\s*', '') AS h FROM c WHERE h IS NOT NULL),
full_of AS MATERIALIZED (SELECT h, h AS f FROM known WHERE regexp_full_match(h, '[0-9a-f]{64}') UNION ALL SELECT s.h, min(k.h) FROM known s JOIN known k ON regexp_full_match(s.h, '[0-9a-f]{12}') AND regexp_full_match(k.h, '[0-9a-f]{64}') AND substr(k.h, 1, 12) = s.h GROUP BY 1 HAVING count(*) = 1),
g AS (SELECT regexp_replace(lower(regexp_replace(source_hash, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), '^sha256:\s*', '') AS s, regexp_replace(lower(regexp_replace(target_hash, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), '^sha256:\s*', '') AS t
  FROM memory_graph WHERE lower(regexp_replace(relationship_type, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) IN ('related', 'supports') AND similarity >= 0.80 AND NOT isnan(similarity)),
p AS MATERIALIZED (SELECT DISTINCT a.f AS a, b.f AS b FROM g JOIN full_of a ON a.h = s JOIN full_of b ON b.h = t WHERE a.f <> b.f),
e AS MATERIALIZED (SELECT a, b FROM p UNION SELECT b, a FROM p),
r(node, other) AS (SELECT a, b FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.other = e.a)
SELECT node AS content_hash, least(node, min(other)) AS group_hash FROM r GROUP BY 1
""",
}
