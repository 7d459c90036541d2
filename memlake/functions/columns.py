"""Pure column functions: predicates, projections and scores. None reads the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from memlake.schema import NOW

DAY = 86400.0
WHITE = r"(?U)^\s+|\s+$"
#: Identities that say nothing (fixed values).
UNUSABLE_IDS = ("", "unknown", "none", "null", "undefined", "default")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, WHITE, "")


def content_hash(c: Column, salt: Column | None = None) -> Column:
    text = F.lower(strip(c))
    return F.sha2(text if salt is None else F.concat(text, F.lit("|session:"), salt), 256)


def number(c: Column) -> Column:
    """NaN counts as null."""
    return F.when(~F.isnan(c), c)


# --- predicates -------------------------------------------------------------
def active() -> Column:
    return F.col("deleted_at").isNull()


def valid_until() -> Column:
    return F.expr("try_cast(valid_until AS timestamp)")


def unexpired(now: float = NOW) -> Column:
    return F.col("valid_until").isNull() | (valid_until().cast("double") > now)


def type_not_in(*types: str) -> Column:
    """Null-safe: rows without a type stay."""
    return F.col("memory_type").isNull() | ~F.col("memory_type").isin(*types)


def tag_array(c: Column | None = None) -> Column:
    c = F.col("tags") if c is None else c
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: strip(x)), lambda x: x != "")


def has_tag(tag: str) -> Column:
    return F.array_contains(tag_array(), tag)


def like_tag(tag: str, escape: bool = False) -> Column:
    if escape:
        tag = tag.replace("\\", "\\\\").replace("%", r"\%").replace("_", r"\_")
    return F.col("tags").ilike(f"%{tag}%")


# --- JSON metadata ----------------------------------------------------------
def variant(c: Column | str = "metadata") -> Column:
    return F.try_parse_json(F.col(c) if isinstance(c, str) else c)


def json_string(key: str, c: str = "metadata") -> Column:
    return F.try_variant_get(variant(c), f"$.{key}", "string")


def json_number(key: str, c: str = "metadata") -> Column:
    """A value whose JSON type is a number, else null (true and "0.9" aren't numbers)."""
    v = F.try_variant_get(variant(c), f"$.{key}", "variant")
    kind = F.schema_of_variant(v)
    return F.when((kind == "BIGINT") | (kind == "DOUBLE") | kind.like("DECIMAL%"), F.try_variant_get(variant(c), f"$.{key}", "double"))


def importance() -> Column:
    """On one scale: values from 1.0 are of the two-point scale; what isn't a number counts 0.5."""
    v = json_number("importance_score")
    return F.when(v.isNull(), 0.5).otherwise(F.least(F.greatest(F.when(v >= 1.0, v / 2.0).otherwise(v), F.lit(0.0)), F.lit(1.0)))


# --- projections ------------------------------------------------------------
def display_line(chars: int = 300) -> Column:
    return F.concat(F.lit("["), F.coalesce("memory_type", F.lit("general")), F.lit("] "), F.replace(F.substring("content", 1, chars), F.lit("\n"), F.lit(" ")))


def preview(c: Column, cap: int = 80) -> Column:
    flat = F.trim(F.translate(c, "\n\t", "  "))
    return F.when(F.length(flat) > cap, F.concat(F.substring(flat, 1, cap - 3), F.lit("..."))).otherwise(flat)


def trimmed(c: Column, cap: int) -> Column:
    return F.when(F.length(c) > cap, F.concat(F.rtrim(F.substring(c, 1, cap)), F.lit("…(truncated)"))).otherwise(c)


def age_days(now: float = NOW) -> Column:
    seen = F.coalesce(number(F.col("last_accessed_at")), number(F.col("created_at")), F.lit(now))
    return F.greatest((F.lit(now) - seen) / DAY, F.lit(0.001))


def project_tag() -> Column:
    """The first ``proj:`` tag, else the project of the metadata."""
    return F.coalesce(F.try_element_at(F.filter(tag_array(), lambda t: t.startswith("proj:")), F.lit(1)), json_string("project"))


def anchor() -> Column:
    return F.concat(
        F.lit("["), F.coalesce("memory_type", F.lit("general")), F.lit("|src:"), F.coalesce(json_string("source_type"), F.lit("unknown")),
        F.lit("|imp:"), F.format_string("%.2f", importance()), F.lit("|proj:"), F.coalesce(project_tag(), F.lit("none")), F.lit("]"),
    )


def usable_id(c: Column) -> Column:
    return F.coalesce(~F.lower(strip(c)).isin(*UNUSABLE_IDS), F.lit(False))


def proxy_tokens(c: Column) -> Column:
    return F.ceil(F.length(c) * 0.25)


# --- scores -----------------------------------------------------------------
def stability(strength: Column, imp: Column) -> Column:
    return strength * (1.0 + 4.0 * imp)


def retention(days: Column, s: Column) -> Column:
    return 1.0 / (1.0 + days / (9.0 * s))


def unified_score(relevance: Column, now: float = NOW, weights=(0.25, 0.25, 0.40, 0.10)) -> Column:
    """Decay, importance, relevance and strength, in the given weights (not normalised)."""
    s = F.coalesce(number(F.col("strength")), F.lit(1.0))
    imp = importance()
    decay = F.when(s <= 0, 0.01).otherwise(F.greatest(retention(age_days(now), F.greatest(stability(s, imp), F.lit(1e-12))), F.lit(0.01)))
    a, b, c, d = weights
    return a * decay + b * imp + c * relevance + d * F.least(s / 5.0, F.lit(1.0))


#: Weights of the spaced-repetition model (fixed values).
FSRS_W = (0.4, 0.6, 2.4, 5.8, 4.93, 0.94, 0.86, 0.01, 1.49, 0.14, 0.94, 2.18, 0.05, 0.34, 1.26, 0.29, 2.61)
MAX_STRENGTH, FSRS_FACTOR = 5.0, 9.0


def retrievability(s: Column, days: Column) -> Column:
    return F.when(s <= 0, 0.0).when(days <= 0, 1.0).otherwise(1.0 / (1.0 + days / (FSRS_FACTOR * s)))


def stability_after_recall(s: Column, difficulty: Column, r: Column, grade: str = "good") -> Column:
    w = FSRS_W
    factor = (w[15] if grade == "hard" else 1.0) * (w[16] if grade == "easy" else 1.0)
    grown = s * (1.0 + F.exp(F.lit(w[8])) * (11.0 - difficulty) * F.pow(s, F.lit(-w[9])) * (F.exp(w[10] * (1.0 - r)) - 1.0) * factor)
    return F.greatest(s * 0.1, F.least(grown, F.lit(MAX_STRENGTH * 10)))


def stability_after_forget(difficulty: Column, r: Column) -> Column:
    w = FSRS_W
    base = stability_after_recall(F.lit(1.0), difficulty, r)
    return F.greatest(F.lit(0.1), w[11] * F.pow(difficulty, F.lit(-w[12])) * (F.pow(base + 1.0, F.lit(w[13])) - 1.0) * F.exp(w[14] * (1.0 - r)))


def next_interval(s: Column, target: float = 0.9) -> Column:
    return FSRS_FACTOR * s * (1.0 / target - 1.0)


# --- vectors ----------------------------------------------------------------
def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Null where a norm is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def usable_vector(v: Column, dim: int) -> Column:
    """Of the given length, all numbers finite, not all zero."""
    inf = F.lit(float("inf"))
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)) & F.exists(v, lambda x: x != 0)
    return F.coalesce((F.size(v) == dim) & ok, F.lit(False))
