"""Importance at writing and scores of extractions, as column expressions.

The importance of a text is the highest band that any signal reaches; a text
with a secret stays at the baseline, whatever else it says. Signals are read
in the first SCAN characters of the text (a part of the rule), secrets in all
of it. Full-width letters are folded as compatibility normalisation does;
other compatibility forms stay.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from memlake.functions import fixed as X
from memlake.functions.columns import strip
from memlake.functions.extract import is_secret

_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + " 　‘’"
_PLAIN = "".join(chr(c) for c in range(0x21, 0x7F)) + "  ''"


def _any(c: Column, patterns) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | c.rlike(X.as_is(p))
    return out


def _contains(c: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return out


def _committed(low: Column) -> Column:
    """An obligation that is neither negated nor a mere "we'll see"."""
    word = lambda c: c.rlike(X.phrases(X.COMMITMENTS)) | c.rlike(X.as_is(X.OBLIGED_TR))
    suffix = lambda c: c.rlike(X.as_is(X.SUFFIX_TR)) & ~c.rlike(X.as_is(X.NOT_SUFFIX_TR))
    negated = low.rlike(X.as_is(X.NOT_OBLIGED_TR)) & ~suffix(low)
    rest = F.when(negated, F.regexp_replace(low, X.as_is(X.NOT_OBLIGED_TR), " ")).otherwise(low)
    left = F.regexp_replace(rest, X.as_is(X.DEFERRED), " ")
    out = ~low.rlike(X.as_is(X.NEGATED)) & (word(low) | suffix(low)) & (~negated | word(rest))
    return out & (~rest.rlike(X.as_is(X.DEFERRED)) | word(left) | suffix(left))


def importance_score(c: Column) -> Column:
    full = strip(F.coalesce(c, F.lit("")))
    text = F.substring(full, 1, X.SCAN)
    low = F.replace(F.lower(F.translate(text, _WIDE, _PLAIN)), F.lit("̇"), F.lit(""))
    # a lambda's argument is computed once, however often it is used
    forms = F.array(F.struct(full.alias("full"), text.alias("text"), low.alias("low"), F.regexp_replace(low, X.ARABIC_MARKS, "").alias("bare")))
    return F.transform(forms, lambda r: _band(r["full"], r["text"], r["low"], r["bare"]))[0]


def _band(full: Column, text: Column, low: Column, bare: Column) -> Column:
    remember, decision = low.rlike(X.phrases(X.REMEMBER)) | low.rlike(X.phrases(X.CUES)), F.lit(False)
    # phrases of several words count wherever they stand, single ones as whole words
    decision = low.rlike(X.phrases([w for w in X.DECISIONS if " " not in w])) | _contains(low, [w for w in X.DECISIONS if " " in w])
    trivial = (full == "") | low.isin(*X.TRIVIAL_WORDS)
    for name, (script, keep, decide, small) in X.LANGUAGES.items():
        hay = bare if name == "ar" else low
        found = (lambda words, hay=hay, name=name: hay.rlike(X.phrases(words)) if name in X.SPACED else _contains(hay, words))
        here = F.lit(True) if script is None else low.rlike(script)
        remember, decision = remember | here & found(keep), decision | here & found(decide)
        trivial = trivial | low.isin(*small) | bare.isin(*small)
    fact = _any(low, X.DEADLINE_PATTERNS) | low.rlike(X.phrases(X.DEADLINES)) | _any(text, X.FACTS) | _any(text, X.PERSONS) | _any(text, X.IDENTIFIERS)
    fact = fact | low.rlike(X.as_is(X.NUMBERS)) & low.rlike(X.phrases(X.NUMBER_WORDS))
    band = F.when(trivial, X.TRIVIAL).when(is_secret(full), X.BASELINE).when(remember, X.MEMORABLE).when(decision | _committed(low), X.DECISION).when(fact, X.FACT).otherwise(X.BASELINE)
    return F.least(band, F.lit(X.CAP))


def type_floor(kind: Column) -> Column:
    floors = F.create_map(*[F.lit(x) for kv in X.TYPE_FLOORS.items() for x in kv])
    return F.coalesce(floors[F.lower(kind)], F.lit(0.0))


def final_importance(heuristic: Column, secret: Column, supplied: Column, kind: Column) -> Column:
    """The importance to store: a secret holds the baseline, else the strongest of heuristic, floor of the type and supplied value.

    ``supplied`` is a number or null; it is compared on the scale from 0 to 1
    (a value of 1 or more is halved), and returned as it is if it wins.
    """
    v = F.when(~F.isnan(supplied) & (F.abs(supplied) != float("inf")), supplied)
    scaled = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(v >= 1.0, v / 2.0).otherwise(v)))
    # a lambda's argument is computed once, however often it is used
    held = F.transform(F.array(F.greatest(heuristic, type_floor(kind))), lambda best: F.when(v.isNotNull() & (scaled >= best), v).otherwise(best))
    return F.when(secret, F.lit(X.BASELINE)).otherwise(held[0])


def extraction_score(c: Column, category: str) -> Column:
    """How likely a text is a genuine extraction of its category."""
    low = F.lower(c)
    has = lambda ws: F.coalesce(_contains(low, ws), F.lit(False))
    score = F.lit(0)
    if category == "error":
        score = F.when(has(X.PROBLEM) & has(X.RESOLUTION), 3).otherwise(0)
    for ws, n in X.CATEGORY_WORDS.get(category, []):
        score = score + F.when(has(ws), n).otherwise(0)
    for p, n in X.CATEGORY_PATTERNS.get(category, []):
        score = score + F.when(low.rlike(X.as_is(p)), n).otherwise(0)
    score = score - (F.length(c) < 40).cast("int")
    for p in X.BONUS:
        score = score + c.rlike(X.as_is(p)).cast("int")
    return score + low.rlike(X.as_is(X.TOOLS)).cast("int")
