"""Micro-batching of events by number or by event time."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.session import reach


@dataclass
class StreamBuffer:
    """Collects events; ``add`` gives the batch when it holds ``count`` or spans ``interval`` of event time, else None."""

    count: int = 32
    interval: float | None = None
    held: list[tuple] = field(default_factory=list)

    def add(self, embedding, ts: float, modality: str = "text") -> dict | None:
        self.held.append((embedding, ts, modality))
        full = len(self.held) >= self.count or self.interval is not None and ts - self.held[0][1] >= self.interval
        return self.flush() if full else None

    def flush(self) -> dict | None:
        """What is held as one batch of the last event's modality; None if nothing is."""
        if not self.held:
            return None
        out = {"embeddings": [e for e, _, _ in self.held], "timestamps": [t for _, t, _ in self.held], "modality": self.held[-1][2]}
        self.held = []
        return out


def batches(events: DataFrame, count: int, interval: float | None = None) -> DataFrame:
    """(id, ts, tie, batch): the number of the buffer's batch that each event falls in, by id.

    By number alone it is a window function. With an ``interval`` the rule restarts at each flush: an id's (ts, tie) go to Python, where each step finds a
    whole batch's end.
    """
    rows = events.select("id", "ts", "tie")
    if interval is None:
        place = F.row_number().over(Window.partitionBy("id").orderBy("ts", "tie"))
        return rows.withColumn("batch", F.floor((place - 1) / F.lit(count)))
    reach(events.sparkSession)

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["ts", "tie"], kind="stable")
        ts, begins, begin = rows.ts.to_numpy(), [], 0
        while begin < len(ts):
            begins.append(begin)
            after = max(begin, int(np.searchsorted(ts, ts[begin] + interval)))
            while after > begin and ts[after - 1] - ts[begin] >= interval:  # the sum may be rounded
                after -= 1
            begin = min(begin + count, after + 1)
        sizes = np.diff([*begins, len(ts)])
        return rows.assign(batch=np.repeat(np.arange(len(begins)), sizes))

    return rows.groupBy("id").applyInPandas(walk, "id string, ts double, tie long, batch long")
