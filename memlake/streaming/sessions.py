"""Keyed session state: count-or-time triggers, rate limits with a memory of shown ids, LRU ledgers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def checkpoint_flushes(events: DataFrame, every: int = 15, seconds: int = 600, least: int = 3) -> DataFrame:
    """(session_id, sec, calls): a flush after ``every`` calls, or after ``seconds`` if at least ``least`` calls wait. Events: session_id, sec."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, since = state.get if state.exists else (0, 0)
        out = []
        for sec in sorted(int(s) for pdf in batches for s in pdf.sec):
            since = since or sec
            if waiting >= least and sec - since >= seconds:
                out.append((key[0], sec, waiting))
                waiting, since = 0, sec
            waiting += 1
            if waiting >= every:
                out.append((key[0], sec, waiting))
                waiting, since = 0, sec
        state.update((waiting, since))
        yield pd.DataFrame(out, columns=["session_id", "sec", "calls"])

    return events.groupBy("session_id").applyInPandasWithState(step, "session_id string, sec long, calls long", "waiting long, since long", "append", GroupStateTimeout.NoTimeout)


def surfacing(events: DataFrame, cooldown: int = 60, calls: int = 5, remembered: int = 200) -> DataFrame:
    """(session_id, sec, memory): memories shown under a rate limit, none twice while remembered. Events: session_id, sec, memory."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, count, shown = state.get if state.exists else (-(10**9), 0, [])
        shown = list(shown)
        out = []
        for sec, m in sorted((int(s), str(x)) for pdf in batches for s, x in zip(pdf.sec, pdf.memory)):
            count += 1
            if sec - last >= cooldown and count >= calls and m not in shown:
                out.append((key[0], sec, m))
                last, count = sec, 0
                shown = [*shown, m][-remembered:]
        state.update((last, count, shown))
        yield pd.DataFrame(out, columns=["session_id", "sec", "memory"])

    return events.groupBy("session_id").applyInPandasWithState(step, "session_id string, sec long, memory string", "last long, count long, shown array<string>", "append", GroupStateTimeout.NoTimeout)


def lru_ledger(events: DataFrame, size: int = 500) -> DataFrame:
    """(session_id, ids): the ids last used, most recent last, after each batch. Events: session_id, sec, memory."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids = list(state.get[0]) if state.exists else []
        for _, m in sorted((int(s), str(x)) for pdf in batches for s, x in zip(pdf.sec, pdf.memory)):
            if m in ids:
                ids.remove(m)
            ids = [*ids, m][-size:]
        state.update((ids,))
        yield pd.DataFrame({"session_id": [key[0]], "ids": [ids]})

    return events.groupBy("session_id").applyInPandasWithState(step, "session_id string, ids array<string>", "ids array<string>", "update", GroupStateTimeout.NoTimeout)


def memory_events(usage: DataFrame) -> DataFrame:
    return usage.filter("session_id is not null and memory_hash is not null").select("session_id", F.unix_seconds("ts").alias("sec"), F.col("memory_hash").alias("memory"))
