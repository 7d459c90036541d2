"""Queries of the packed-field operator."""

from memlake.operators.packed import split_packed
from memlake.runtime import table

QUERIES = {"p2_found": lambda s, d: split_packed(table(s, d, "memories"))}
SQL: dict[str, str] = {
    "p2_found": r"""
WITH t AS (
  SELECT id, unnest(regexp_extract_all(tags, '"(?:\\"|""|[^"])*"|''(?:\\''|''''|[^''])*''|`(?:\\`|``|[^`])*`|“(?:\\”|””|[^”])*”|‘(?:\\’|’’|[^’])*’|[\p{L}\p{N}:_\-./@+]+')) AS raw,
         generate_subscripts(regexp_extract_all(tags, '"(?:\\"|""|[^"])*"|''(?:\\''|''''|[^''])*''|`(?:\\`|``|[^`])*`|“(?:\\”|””|[^”])*”|‘(?:\\’|’’|[^’])*’|[\p{L}\p{N}:_\-./@+]+'), 1) AS k
  FROM memories WHERE tags <> ''
), u AS (
  SELECT id, k, CASE WHEN substr(raw, 1, 1) IN ('"', '''', '`', '“', '‘')
    THEN trim(replace(replace(substr(raw, 2, length(raw) - 2), '\' || substr(raw, length(raw), 1), substr(raw, length(raw), 1)), repeat(substr(raw, length(raw), 1), 2), substr(raw, length(raw), 1)))
    ELSE raw END AS tag FROM t)
SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY k) AS INTEGER) AS tag_pos, tag FROM u WHERE tag <> ''
""",
}
