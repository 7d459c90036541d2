"""SQL fragments that the oracle queries share (DuckDB)."""

from memlake.schema import NOW

J = "(CASE WHEN json_valid(metadata) THEN metadata END)"
ACTIVE = "deleted_at IS NULL"
UNTIL = "epoch(try_cast(valid_until AS TIMESTAMP))"
LIVE = f"deleted_at IS NULL AND (valid_until IS NULL OR {UNTIL} > {NOW})"
TAGS = "list_filter(list_transform(string_split(coalesce(tags, ''), ','), lambda x: regexp_replace(x, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')), lambda x: x <> '')"


def json_number(key: str) -> str:
    return f"(CASE WHEN json_type({J}, '$.{key}') IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN CAST({J} ->> '$.{key}' AS DOUBLE) END)"


def num(c: str) -> str:
    return f"(CASE WHEN isnan({c}) THEN NULL ELSE {c} END)"


_I = json_number("importance_score")
IMP = f"(CASE WHEN {_I} IS NULL THEN 0.5 ELSE least(greatest(CASE WHEN {_I} >= 1.0 THEN {_I} / 2.0 ELSE {_I} END, 0.0), 1.0) END)"
AGE = f"greatest(({NOW} - coalesce({num('last_accessed_at')}, {num('created_at')}, {NOW})) / 86400.0, 0.001)"
STRENGTH = f"coalesce({num('strength')}, 1.0)"
PROJECT = f"coalesce(list_filter({TAGS}, lambda x: starts_with(x, 'proj:'))[1], {J} ->> '$.project')"


def score(relevance: str) -> str:
    decay = f"(CASE WHEN {STRENGTH} <= 0 THEN 0.01 ELSE greatest(1.0 / (1.0 + {AGE} / (9.0 * greatest({STRENGTH} * (1.0 + 4.0 * {IMP}), 1e-12))), 0.01) END)"
    return f"(0.25 * {decay} + 0.25 * {IMP} + 0.40 * {relevance} + 0.10 * least({STRENGTH} / 5.0, 1.0))"


def tokens(c: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({c}), '[^a-z0-9]+'), lambda x: x <> '')"


def vector(name: str, dim: int) -> str:
    """Usable vectors as DOUBLE lists."""
    return f"(len({name}) = {dim} AND NOT list_contains(list_transform({name}, lambda x: x IS NULL OR isnan(x) OR isinf(x)), true) AND list_contains(list_transform({name}, lambda x: x <> 0), true))"


def cosine(a: str, b: str) -> str:
    return f"(list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))))"


def re2(pattern: str, fold: bool = True) -> str:
    """A quoted DuckDB pattern that covers Unicode words, spaces and digits; with ``fold`` it ignores case, for use on ``folded`` text."""
    sets = {"s": r"\t-\r\x{85}\p{Z}", "w": r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}", "d": r"\p{Nd}"}
    out, i, inside = [], 0, False
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            n = pattern[i + 1]
            if n in sets:
                out.append(sets[n] if inside else f"[{sets[n]}]")
            elif n.lower() in sets:
                out.append(f"[^{sets[n.lower()]}]")
            else:
                out.append(ch + n)
            i += 2
            continue
        if ch == "[" and not inside:
            inside = True
        elif ch == "]" and inside:
            inside = False
        out.append(ch)
        i += 1
    text = "".join(out).replace("'", "''")
    return "'(?i)" + text.replace("ı", "i").replace("İ", "i") + "'" if fold else "'" + text + "'"


def folded(c: str) -> str:
    """Text with the dotted and dotless i as one, character for character."""
    return f"replace(replace({c}, 'İ', 'i'), 'ı', 'i')"


def low(c: str) -> str:
    """Lower case as the engine makes it."""
    return f"lower(replace({c}, 'İ', 'i̇'))"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"


def matches(c: str, pattern: str, fold: bool = True) -> str:
    return f"regexp_matches({folded(c) if fold else c}, {re2(pattern, fold)})"


def any_of(c: str, words) -> str:
    return "(" + " OR ".join("contains(" + c + ", '" + w.replace("'", "''") + "')" for w in words) + ")"
