"""Gates, extraction, routing and importance; the SQL matches Unicode text as the engine does."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.functions import columns as C
from memlake.functions import extract as E
from memlake.functions import fixed as X
from memlake.functions import importance as I
from memlake.plans import pipelines as P
from memlake.queries import sql as S
from memlake.queries.retrieval import mem
from memlake.runtime import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def add(name: str, fn, sql: str | None = None) -> None:
    QUERIES[name] = fn
    if sql:
        SQL[name] = sql


def asked(s, d):
    return table(s, d, "usage_feedback").filter("query_text is not null").select("query_text").distinct()


_ASKED = "(SELECT DISTINCT query_text FROM usage_feedback WHERE query_text IS NOT NULL)"


def _family(name: str, c: str = "content") -> str:
    """A boolean, where no look-behind is at hand: the character before is matched with the family."""
    before = f"(?:^|[^{X.NOT_AFTER[name][1:-1]}])" if name in X.NOT_AFTER else ""
    return S.matches(c, before + "(?:" + "|".join(X.FAMILIES[name]) + ")")


add(
    "EX01_families",
    lambda s, d: mem(s, d).select("id", F.explode(E.families(F.col("content"))).alias("family")),
    "SELECT id, family FROM (SELECT id, unnest(list_filter([" + ", ".join(f"CASE WHEN {_family(n)} THEN '{n}' END" for n in X.FAMILIES) + "], lambda x: x IS NOT NULL)) AS family FROM memories)",
)


def _start(name: str) -> str:
    """Where the first match of a family begins, from 1."""
    return f"strpos({S.folded('content')}, regexp_extract({S.folded('content')}, {S.re2('(?:' + '|'.join(X.FAMILIES[name]) + ')')}))"


add("EX02_context_windows", lambda s, d: mem(s, d).select("id", F.explode(E.context_windows(F.col("content"), E.family("error"))).alias("passage")))
add(
    "EX03_first_windows",
    lambda s, d: P.extraction(mem(s, d)).select("id", "category", "passage"),
    " UNION ALL ".join(f"SELECT id, '{n}' AS category, substr(content, greatest({_start(n)} - 50, 1), 250) AS passage FROM memories WHERE {_family(n)}" for n in X.MESSAGE_FAMILIES),
)
_BONUS = " + ".join(f"CAST({S.matches('passage', p, False)} AS INTEGER)" for p in X.BONUS) + f" - CAST(length(passage) < 40 AS INTEGER) + CAST({S.matches(S.low('passage'), X.TOOLS, False)} AS INTEGER)"


def _points(n: str) -> str:
    parts = [f"CASE WHEN {S.any_of(S.low('passage'), ws)} THEN {k} ELSE 0 END" for ws, k in X.CATEGORY_WORDS.get(n, [])]
    parts += [f"CASE WHEN {S.matches(S.low('passage'), p, False)} THEN {k} ELSE 0 END" for p, k in X.CATEGORY_PATTERNS.get(n, [])]
    if n == "error":
        parts.append(f"CASE WHEN {S.any_of(S.low('passage'), X.PROBLEM)} AND {S.any_of(S.low('passage'), X.RESOLUTION)} THEN 3 ELSE 0 END")
    return " + ".join(parts or ["0"])


add(
    "SC07_extraction_scores",
    lambda s, d: P.extraction(mem(s, d)).select("id", "category", "score"),
    f"SELECT id, category, CAST(CASE category {' '.join(f'WHEN {chr(39)}{n}{chr(39)} THEN {_points(n)}' for n in X.MESSAGE_FAMILIES)} END + {_BONUS} AS INTEGER) AS score FROM ({SQL['EX03_first_windows']})",
)
_CODE_HITS = " + ".join(f"CAST({S.matches('{t}', p, False)} AS INTEGER)" for p in E.CODE_MARKS)


def _code(c: str) -> str:
    flags = f"len(regexp_extract_all({c}, {S.re2(E.CLI_FLAG, False)}))"
    return rf"(len(regexp_extract_all({c}, '\p{{L}}{{2,}}')) < 4 OR {S.matches(c, E.SHELL_PIPE, False)} OR " + _CODE_HITS.replace("{t}", c) + f" + CAST({flags} >= 2 AS INTEGER) + CAST({flags} >= 4 AS INTEGER) >= 2)"


_PRE = f"lower({S.strip('regexp_extract(' + S.strip('content') + ', ' + chr(39) + '^' + chr(92) + '[([^' + chr(92) + ']]{2,30})' + chr(92) + ']' + chr(39) + ', 1)')})"
_TYPE = " ".join(f"WHEN contains(p, '{k}') THEN '{v}'" for k, v in E.PREFIX_TYPES.items())
_RECITED = "(" + " + ".join(f"CAST(contains(content, '{m}') AS INTEGER)" for m in E.SUMMARY_MARKERS) + " >= 2)"
add("EX06_prefix_types", lambda s, d: mem(s, d).select("id", F.coalesce(E.type_by_prefix(F.col("content")), F.lit("none")).alias("kind")), f"SELECT id, CASE WHEN p = '' THEN 'none' {_TYPE} ELSE 'none' END AS kind FROM (SELECT id, {_PRE} AS p FROM memories)")


def _hits(name: str) -> str:
    before = f"(?:^|[^{X.NOT_AFTER[name][1:-1]}])" if name in X.NOT_AFTER else ""
    return f"list_transform(regexp_extract_all(f, {S.re2(before + '(' + '|'.join(X.FAMILIES[name]) + ')')}, 1), lambda h: {S.strip('h')})"


add(
    "EX04_checkpoint_scan",
    lambda s, d: mem(s, d).select("id", F.explode(E.checkpoint_passages(F.col("content"))).alias("p")).select("id", F.translate("p.passage", "İı", "ii").alias("passage"), "p.score"),
    "WITH m AS (SELECT id, " + S.folded("content") + f" AS f, content, {_PRE} AS p FROM memories), h AS (" + " UNION ALL ".join(f"SELECT id, unnest({_hits(n)}) AS passage, {k} AS rank, {score} AS score FROM m WHERE NOT {_RECITED} AND (p = '' OR NOT {S.any_of('p', E.PREFIX_TYPES)})" for k, (n, score) in enumerate(X.CHECKPOINT.items()))
    + f") SELECT id, passage, min_by(score, rank) AS score FROM h WHERE length(passage) BETWEEN 15 AND 500 AND NOT {_code('passage')} GROUP BY id, passage",
)
add(
    "EX10_next_steps",
    lambda s, d: mem(s, d).select("id", F.translate(E.next_step(F.col("content")), "İı", "ii").alias("step"), F.when(F.col("content").rlike(E.family("error")), E.unresolved(E.windows(F.col("content"), E.family("error")))).otherwise(False).alias("blocker")).filter("step is not null or blocker"),
    f"SELECT id, step, blocker FROM (SELECT id, nullif(substr({S.strip('regexp_extract(' + S.folded('content') + ', ' + S.re2(X.NEXT_STEP) + ', 1)')}, 1, 120), '') AS step, CASE WHEN {_family('error')} THEN NOT {S.any_of(S.low('substr(content, greatest(' + _start('error') + ' - 50, 1), 250)'), X.RESOLVED)} ELSE false END AS blocker FROM memories) WHERE step IS NOT NULL OR blocker",
)
add(
    "FLT12_fragments",
    lambda s, d: mem(s, d).select("id", E.is_fragment(F.col("content")).alias("fragment")),
    rf"SELECT id, t = '' OR {S.low('t')} IN ({', '.join(repr(x) for x in E.STUBS)}) OR ends_with(t, ':') OR ends_with(t, '...') OR (length(t) - length(replace(t, '{chr(34)}', ''))) % 2 = 1 OR (p = '' AND (NOT regexp_matches(t, '^\p{{Lu}}') OR length(t) < 50)) AS fragment FROM (SELECT id, {S.strip('content')} AS t, {_PRE} AS p FROM memories)",
)
add("FLT13_code", lambda s, d: mem(s, d).select("id", E.looks_like_code(F.col("content")).alias("code")), f"SELECT id, {_code('t')} AS code FROM (SELECT id, {S.strip('content')} AS t FROM memories)")
add("FLT14_recitations", lambda s, d: mem(s, d).select("id", E.summary_recitation(F.col("content")).alias("recitation")), f"SELECT id, {_RECITED} AS recitation FROM memories")
add(
    "FLT15_actionable",
    lambda s, d: mem(s, d).select("id", E.actionable(F.col("content")).alias("ok")),
    "SELECT id, NOT (" + " OR ".join(f"starts_with(t, '{w}')" for w in X.SKIP_STARTS) + rf") AND len(list_filter(regexp_split_to_array(t, '[\s\x{{0b}}\x{{85}}\p{{Z}}]+'), lambda w: w <> '')) >= 5 AND {S.any_of('t', X.SIGNALS)} AS ok FROM (SELECT id, {S.strip(S.low('content'))} AS t FROM memories)",
)
add(
    "FLT16_trivial_prompts",
    lambda s, d: asked(s, d).select("query_text", E.trivial_prompt(F.col("query_text")).alias("trivial")),
    rf"SELECT query_text, length(query_text) < 15 OR regexp_matches(t, '^(?:evet|hayır|tamam|ok|yes|no|devam|anladım|güzel|teşekkür|thanks|merhaba|hey|hi |hello|peki|hadi|oldu|anlaşıldı|süper|harika)') OR (regexp_matches(t, '^(?:commit|push|pull|merge|rebase|deploy|install|build|run |start |stop |restart|kill )') AND len(list_filter(regexp_split_to_array(t, '\s+'), lambda w: w <> '')) <= 3) OR regexp_matches(query_text, '^/[a-zA-Z][a-zA-Z0-9_-]*($|\s)') AS trivial FROM (SELECT query_text, {S.low('query_text')} AS t FROM {_ASKED})",
)


def _one_of(c: str, patterns) -> str:
    return "(" + " OR ".join(S.matches(c, p, False) for p in patterns) + ")"


_TEXTS = f"(SELECT content AS t FROM memories WHERE content IS NOT NULL UNION SELECT query_text FROM {_ASKED})"


def texts(s, d):
    """Every question asked, and every content taken as one."""
    return mem(s, d).filter("content is not null").select(F.col("content").alias("t")).union(asked(s, d)).distinct()


add("TX12_router", lambda s, d: texts(s, d).groupBy(F.md5("t").alias("text")).agg(F.first(E.route(F.col("t"))).alias("mode")), f"SELECT md5(t) AS text, CASE WHEN {_one_of(S.low('t'), X.RECALL + X.NEGATION)} THEN 'hybrid' WHEN {_one_of(S.low('t'), X.ATTRIBUTE)} THEN 'keyword' ELSE 'hybrid' END AS mode FROM {_TEXTS}")
add("TX13_adaptive_weights", lambda s, d: texts(s, d).groupBy(F.md5("t").alias("text")).agg(F.first(E.lexical_weight(F.col("t"))).alias("lexical_weight")), f"SELECT md5(t) AS text, CAST(CASE WHEN h >= 3 THEN 0.5 WHEN h >= 1 THEN 0.6 ELSE 0.7 END AS DOUBLE) AS lexical_weight FROM (SELECT t, " + " + ".join(f"CAST({S.matches('t', p)} AS INTEGER)" for p in X.TECHNICAL) + f" AS h FROM {_TEXTS})")
add("SC02_importance_bands", lambda s, d: mem(s, d).select("id", I.importance_score(F.col("content")).alias("score")))
_FLOORS = " ".join(f"WHEN '{k}' THEN {v}" for k, v in X.TYPE_FLOORS.items())
_SECRET = "(" + " OR ".join("regexp_matches(content, '" + p.replace("'", "''") + "')" for _, p, _ in E.SECRETS) + " OR contains(content, '[REDACTED:'))"
_V = S.json_number("importance_score")
add(
    "SC03_final_importance",
    lambda s, d: mem(s, d).select("id", F.round(I.final_importance(F.lit(X.BASELINE), E.is_secret(F.coalesce("content", F.lit(""))), C.json_number("importance_score"), F.col("memory_type")), 6).alias("importance")),
    f"SELECT id, round(CAST(CASE WHEN secret THEN 0.5 WHEN v IS NOT NULL AND greatest(0.0, least(1.0, CASE WHEN v >= 1 THEN v / 2 ELSE v END)) >= b THEN v ELSE b END AS DOUBLE), 6) AS importance FROM (SELECT id, coalesce({_SECRET}, false) AS secret, {_V} AS v, greatest(0.5, CASE lower(memory_type) {_FLOORS} ELSE 0 END) AS b FROM memories)",
)
add("SC03_importance_of_texts", lambda s, d: mem(s, d).select("id", F.round(I.final_importance(I.importance_score(F.col("content")), E.is_secret(F.coalesce("content", F.lit(""))), C.json_number("importance_score"), F.col("memory_type")), 6).alias("importance")))
_ALIAS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in E.MACRO_ALIASES.items())
# each memory written as a macro line of its type, and read back
add(
    "EX07_macro_verbs",
    lambda s, d: mem(s, d).filter("memory_type is not null").select("id", F.concat(F.lit("[M#"), "memory_type", F.lit(":3] "), "content").alias("t")).select("id", F.explode(E.macro_verbs(F.col("t"))).alias("m")).select("id", "m.type", "m.importance", "m.content"),
    rf"SELECT id, type, CAST(2.0 AS DOUBLE) AS importance, {S.strip('c')} AS content FROM (SELECT id, coalesce(CASE lower(memory_type) {_ALIAS} END, lower(memory_type)) AS type, regexp_extract(content, '^\s*([^\n]{{4,400}})', 1) AS c FROM memories WHERE regexp_full_match(memory_type, '[a-zA-Z_][a-zA-Z0-9_-]{{0,31}}')) WHERE c <> '' AND type IN ({', '.join(repr(t) for t in E.MACRO_TYPES)})",
)
_BULLETS = r"list_filter(list_transform(regexp_extract_all(s, '(?m)^[ \t]*- (.*)$', 1), lambda b: regexp_replace(regexp_replace(b, '^[- ]+', ''), '^\*\*(.+?)\*\*:\s*', '\1: ')), lambda b: length(b) > 15)[1:5]"
add(
    "EX08_section_bullets",
    lambda s, d: P.section_memories(table(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))),
    rf"SELECT id, section, header, pos, bullet FROM (SELECT id, section, header, CAST(generate_subscripts(b, 1) - 1 AS INTEGER) AS pos, unnest(b) AS bullet FROM (SELECT id, section, trim(split_part(s, chr(10), 1)) AS header, {_BULLETS} AS b FROM (SELECT doc_id AS id, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS section, unnest(p) AS s FROM (SELECT doc_id, regexp_split_to_array(text, '(?m)^## ')[2:] AS p FROM documents)))) WHERE " + "{ok}",
)
_OK = "NOT (" + " OR ".join(f"starts_with(t, '{w}')" for w in X.SKIP_STARTS) + rf") AND len(list_filter(regexp_split_to_array(t, '[\s\x{{0b}}\x{{85}}\p{{Z}}]+'), lambda w: w <> '')) >= 5 AND {S.any_of('t', X.SIGNALS)}"
SQL["EX08_section_bullets"] = SQL["EX08_section_bullets"].replace("{ok}", _OK.replace("(t, ", f"({S.strip(S.low('bullet'))}, "))
