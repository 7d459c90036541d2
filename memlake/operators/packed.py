"""Several values packed in one field: one row per value, with its position.

A value is either quoted and then anything (quoted spans are atomic), or a run
of letters, digits and ``: _ - . / @ +``; everything else separates. Every
field becomes a lattice of its readings: patterns only propose the edges (runs,
quoted spans with each quote that may end them, quotes that merely separate),
and of the readings those with the fewest stray quotes stay, so that quoted
spans remain atomic. Expectation-maximisation estimates how often each value
occurs in the whole column (a field with one reading counts in full, others by
the probabilities of their readings), and the Viterbi path is taken. What a
doubled or backslashed quote means, and where an unbalanced one belongs, is so
decided by the learned frequencies; values side by side without a separator
are improbable.

Defined results: null, empty and blank fields give no rows, nor do empty
quoted spans; repeated values and repeated rows are kept; a stray quote only
separates; columns other than the two named are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.runtime import Scratch, hot_safe_join

#: Opening and closing quotes (fixed values of the format).
QUOTES = {'"': '"', "'": "'", "`": "`", "“": "”", "‘": "’", "„": "“"}
_IN_RUN = r"(?:[^\W]|[:\-./@+])"
_ALL_QUOTES = "".join(sorted(set(QUOTES) | set(QUOTES.values())))
_EVENT = re.compile(rf"{_IN_RUN}+|[{_ALL_QUOTES}]")
_RUN = re.compile(rf"{_IN_RUN}+")
_ANY_QUOTE = re.compile(f"[{_ALL_QUOTES}]")
_SEPARATES = re.compile(rf"(?!{_IN_RUN})[^{_ALL_QUOTES}]")
#: Log-probability that a value follows another one without a separator between them.
TIGHT = -20.0
ROUNDS = 2


def unquote(span: str) -> str:
    inner = span[1:-1]
    for q in {span[0], span[-1]}:
        inner = inner.replace("\\" + q, q).replace(q + q, q)
    return inner.strip()


def _span_ends(field: str, at: int) -> list[int]:
    """Where the quoted span that begins at ``at`` may end: at a doubled or backslashed quote it may go on as well."""
    close, ends = QUOTES[field[at]], []
    j = field.find(close, at + 1)
    while j >= 0:
        ends.append(j + 1)
        if j > at + 1 and field[j - 1] == "\\":
            j = field.find(close, j + 1)
        elif field[j + 1 : j + 2] == close:
            j = field.find(close, j + 2)
        else:
            break
    return ends


def lattice(field: str) -> tuple[int, list[tuple[int, int, str | None, float]]]:
    """(last node, edges (from, to, value or None, log-weight) by rising start) of the readings with the fewest stray quotes.

    Nodes are the places where a run or a quote begins, and the end.
    """
    events = list(_EVENT.finditer(field))
    last = len(events)
    if not _ANY_QUOTE.search(field):
        return last, [(k, k + 1, m.group(), 0.0) for k, m in enumerate(events)]
    starts = [m.start() for m in events]
    edges = []
    for k, m in enumerate(events):
        i, text = m.start(), m.group()
        tight = TIGHT if i and not _SEPARATES.match(field, i - 1) else 0.0
        if text[0] not in _ALL_QUOTES:
            edges.append((k, k + 1, text, tight, 0))
            continue
        edges.append((k, k + 1, None, 0.0, 1))
        if text in QUOTES:
            for end in _span_ends(field, i):
                value = unquote(field[i:end]) or None
                edges.append((k, bisect_left(starts, end), value, tight if value else 0.0, 0))
    far = last + 1
    ahead, behind = [0] + [far] * last, [far] * last + [0]
    for a, b, _, _, stray in edges:
        ahead[b] = min(ahead[b], ahead[a] + stray)
    for a, b, _, _, stray in reversed(edges):
        behind[a] = min(behind[a], behind[b] + stray)
    return last, [(a, b, v, w) for a, b, v, w, stray in edges if ahead[a] + stray + behind[b] == ahead[last]]


def readings(edges) -> bool:
    """Whether a lattice has more than one reading."""
    return len({e[0] for e in edges}) < len(edges)


def best_path(lattice_of: tuple, logp: dict[str, float], unseen: float) -> list[str]:
    """The values along the Viterbi path; of equal readings the one with longer spans."""
    last, edges = lattice_of
    best: list = [None] * (last + 1)
    best[0] = (0.0, None)
    for e in edges:
        if best[e[0]] is not None:
            s = best[e[0]][0] + e[3] + (logp.get(e[2], unseen) if e[2] else 0.0)
            if best[e[1]] is None or s > best[e[1]][0]:
                best[e[1]] = (s, e)
    out, at = [], last
    while at and best[at]:
        e = best[at][1]
        if e[2]:
            out.append(e[2])
        at = e[0]
    return out[::-1]


def expected(lattice_of: tuple, logp: dict[str, float], unseen: float) -> Counter:
    """Forward-backward: the expected number of each value."""
    last, edges = lattice_of
    add = lambda a, b: b if a is None else max(a, b) + math.log1p(math.exp(-abs(a - b)))
    score = [w + (logp.get(v, unseen) if v else 0.0) for _, _, v, w in edges]
    fwd: list = [None] * (last + 1)
    bwd: list = [None] * (last + 1)
    fwd[0] = bwd[-1] = 0.0
    for (a, b, _, _), s in zip(edges, score):
        if fwd[a] is not None:
            fwd[b] = add(fwd[b], fwd[a] + s)
    for (a, b, _, _), s in zip(reversed(edges), reversed(score)):
        if bwd[b] is not None:
            bwd[a] = add(bwd[a], bwd[b] + s)
    out: Counter = Counter()
    for (a, b, v, _), s in zip(edges, score):
        if v and fwd[a] is not None and bwd[b] is not None:
            out[v] += math.exp(fwd[a] + s + bwd[b] - fwd[-1])
    return out


def _parse(batches):
    """Lattices of all fields: the path of those with one reading, the text of the others."""
    for b in batches:
        unsure, values = [], []
        for t in b.column("field").to_pylist():
            made = lattice(t)
            several = readings(made[1])
            unsure.append(t if several else None)
            values.append([] if several else best_path(made, {}, 0.0))
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(unsure, pa.string()), pa.array(values, pa.list_(pa.string()))], names=["id", "unsure", "values"])


def _options(batches):
    for b in batches:
        values = [sorted({e[2] for e in lattice(t)[1] if e[2]}) for t in b.column("unsure").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("unsure"), b.column("n"), pa.array(values, pa.list_(pa.string()))], names=["unsure", "n", "values"])


def _logs(row_total: float, counts) -> tuple[dict[str, float], float]:
    return {v: math.log((c + 0.5) / (row_total + 1)) for v, c in counts}, math.log(0.5 / (row_total + 1))


def _with_counts(step, total: float):
    def run(batches):
        for b in batches:
            for field, n, counts in zip(b.column("unsure").to_pylist(), b.column("n").to_pylist(), b.column("counts").to_pylist()):
                logp, unseen = _logs(total, [(c["value"], c["c"]) for c in counts])
                yield step(field, n, logp, unseen)

    return run


def _expect(field, n, logp, unseen):
    got = expected(lattice(field), logp, unseen)
    return pa.RecordBatch.from_pydict({"value": pa.array(list(got), pa.string()), "c": pa.array([x * n for x in got.values()], pa.float64())})


def _viterbi(field, n, logp, unseen):
    return pa.RecordBatch.from_pydict({"unsure": pa.array([field]), "values": pa.array([best_path(lattice(field), logp, unseen)], pa.list_(pa.string()))})


def split_packed(df: DataFrame, id_col: str = "id", field_col: str = "tags") -> DataFrame:
    """(id, tag_pos int, tag): every value of the field, positions from 1."""
    scratch = Scratch(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(field_col).alias("field")).filter(F.length("field") > 0)
    read = scratch.save(rows.mapInArrow(_parse, f"id {kind}, unsure string, values array<string>"), "read")
    out = read.filter("unsure is null").select("id", F.posexplode("values").alias("pos", "tag"))
    unsure = read.filter("unsure is not null")
    fields = unsure.groupBy("unsure").agg(F.count(F.lit(1)).alias("n"))
    options = scratch.save(fields.mapInArrow(_options, "unsure string, n long, values array<string>"), "options")
    # frequencies of the whole column for the values that some unsure field may hold, and how many such fields may hold each
    wanted = options.select(F.explode("values").alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("m"))
    one = out.groupBy(F.col("tag").alias("value")).agg(F.count(F.lit(1)).cast("double").alias("c"))
    base = scratch.save(wanted.join(one, "value", "left").select("value", "m", F.coalesce("c", F.lit(0.0)).alias("c")), "base")
    total = (read.agg(F.sum(F.size("values"))).first()[0] or 0) + (options.agg(F.sum("n")).first()[0] or 0)
    spread = base.agg(F.sum("m")).first()[0] or 0
    counts = base
    for k in range(ROUNDS + 1):
        each = options.select("unsure", "n", F.explode_outer("values").alias("value"))
        known = hot_safe_join(each, counts, "value", "m", spread, "left")
        known = known.groupBy("unsure", "n").agg(F.collect_list(F.when(F.col("c").isNotNull(), F.struct("value", "c"))).alias("counts"))
        if k == ROUNDS:
            chosen = known.mapInArrow(_with_counts(_viterbi, total), "unsure string, values array<string>")
            break
        soft = known.mapInArrow(_with_counts(_expect, total), "value string, c double")
        both = base.unionByName(soft.withColumn("m", F.lit(0).cast("long")))
        counts = scratch.save(both.groupBy("value").agg(F.max("m").alias("m"), F.sum("c").alias("c")), f"counts{k}")
    chosen = unsure.select("id", "unsure").join(chosen, "unsure").select("id", F.posexplode("values").alias("pos", "tag"))
    return out.unionByName(chosen).select("id", (F.col("pos") + 1).cast("int").alias("tag_pos"), "tag")
