"""Admission over a stream: the same sliding window, its stamps in keyed state.

Rows of a micro-batch are taken in order of time and id. A row older than one admitted in an earlier batch is
judged against the stamps as they are, so late rows may be judged otherwise than in a batch run; put a
watermark and event-time order before this where that matters.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pantry.operators.admission import Window, retry_after


def verdicts(events: DataFrame, key: str, ts: str, event: str, most: int, window_s: int) -> DataFrame:
    """(key, event, admitted, retry_after_s) of a streaming table; append mode. State: at most ``most`` stamps a key."""
    window = window_s * 1_000_000

    def judge(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = Window(most, window, list(state.get[0]) if state.exists else None)
        rows = pd.concat(list(parts)).sort_values(["t", "e"])
        oldest = [own.admit(int(t)) for t in rows["t"]]
        state.update((list(own.stamps),))
        yield pd.DataFrame({key: k[0], event: rows["e"].to_numpy(), "admitted": [o is None for o in oldest], "retry_after_s": pd.array([None if o is None else retry_after(o, int(t), window, 1_000_000) for o, t in zip(oldest, rows["t"])], "Int64")})

    rows = events.where(F.col(ts).isNotNull()).select(F.col(key).alias("k"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), F.col(event).alias("e"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.groupBy("k").applyInPandasWithState(judge, f"{key} {kinds['k']}, {event} {kinds['e']}, admitted boolean, retry_after_s long", "stamps array<long>", "append", GroupStateTimeout.NoTimeout)
