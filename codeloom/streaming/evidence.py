"""Stateful operators over streams: evidence windows, once-only notices, capped gates and level transitions.

Each has a batch form in codeloom.operators; on the same events both give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

WINDOW = "45 minutes"


def evidence_join(edits: DataFrame, activity: DataFrame, key: str, time: str, window: str = WINDOW) -> DataFrame:
    """Edits with every activity of their key within the window before them, both streams with watermarks of the window.

    An edit without activity comes out once the watermark has passed it.
    """
    e = edits.withWatermark(time, window)
    a = activity.select(F.col(key).alias("_k"), F.col(time).alias("_t"), *[F.col(c).alias(f"activity_{c}") for c in activity.columns if c not in (key, time)]).withWatermark("_t", window)
    met = e.join(a, (F.col(key) == F.col("_k")) & (F.col("_t") <= F.col(time)) & (F.col("_t") >= F.col(time) - F.expr(f"INTERVAL {window}")), "left_outer")
    return met.withColumnRenamed("_t", "activity_time").drop("_k")


def once(events: DataFrame, key: str, time: str, window: str = WINDOW) -> DataFrame:
    """The first event of each key to arrive, forgotten after the window."""
    return events.withWatermark(time, window).dropDuplicatesWithinWatermark([key])


def capped_gate(stops: DataFrame, key: str, cap: int = 2) -> DataFrame:
    """(key, seq, decision, cached): continue while something is outstanding, at most ``cap`` times a key; state is a counter and the last signature.

    stops: key, seq, outstanding, signature.
    """

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, signature = state.get if state.exists else (0, None)
        rows = []
        for frame in frames:
            for r in frame.sort_values("seq").itertuples(index=False):
                count = min(count + (1 if r.outstanding > 0 else 0), cap + 1)
                rows.append((k[0], r.seq, "continue" if r.outstanding > 0 and count <= cap else "allow", r.signature is not None and r.signature == signature))
                signature = r.signature
        state.update((count, signature))
        yield pd.DataFrame(rows, columns=["key", "seq", "decision", "cached"])

    return stops.select(F.col(key).alias("key"), "seq", "outstanding", "signature").groupBy("key").applyInPandasWithState(step, "key string, seq long, decision string, cached boolean", "count int, signature string", "append", GroupStateTimeout.NoTimeout)


def level_transitions(events: DataFrame, key: str, ranks: tuple[str, ...] = ("low", "elevated", "high")) -> DataFrame:
    """(key, seq, level, from_level) where the level rises, each level once a key; state is the level before and the levels told."""
    order = {name: i for i, name in enumerate(ranks)}

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before, told = state.get if state.exists else (0, [])
        told, rows = set(told), []
        for frame in frames:
            for r in frame.sort_values("seq").itertuples(index=False):
                now = order.get(r.level, before)
                if now > before and r.level not in told:
                    told.add(r.level)
                    rows.append((k[0], r.seq, r.level, ranks[before]))
                before = now
        state.update((before, sorted(told)))
        yield pd.DataFrame(rows, columns=["key", "seq", "level", "from_level"])

    return events.select(F.col(key).alias("key"), "seq", "level").groupBy("key").applyInPandasWithState(step, "key string, seq long, level string, from_level string", "before int, told array<string>", "append", GroupStateTimeout.NoTimeout)
