"""Incremental representations: one state for each key, updated by batches of events, in memory or in Structured Streaming.

The batch operators ``sequences.ema`` and ``sequences.stream_salient`` give the same values without a sequential pass; here the state is kept
between micro-batches, so that the work follows the new events only. An event that is older than the state's newest one is not dropped: its
decay is that of no time passed, so it leaves the average as it is and counts in mean and variance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from eventloom.session import reach

STATE = "n long, last_ts double, rep array<double>, mean array<double>, m2 array<double>, recent_ts array<double>, recent array<array<double>>"
OUTPUT = "id string, n long, last_ts double, representation array<double>, salient array<int>, predictions array<array<double>>"


@dataclass
class Incremental:
    """The state of one sequence. ``keep`` bounds the recent events that predictions look at."""

    alpha: float = 1.0
    keep: int = 100
    n: int = 0
    last_ts: float = 0.0
    rep: np.ndarray = field(default_factory=lambda: np.zeros(0))
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    m2: np.ndarray = field(default_factory=lambda: np.zeros(0))
    recent_ts: list[float] = field(default_factory=list)
    recent: list[np.ndarray] = field(default_factory=list)

    def update(self, embedding, ts: float) -> np.ndarray:
        return self.update_batch([embedding], [ts])

    def update_batch(self, embeddings, times) -> np.ndarray:
        """The representation after all events, in the order given; no events leave it as it is and give an empty one.

        In closed form: with M the newest time so far, the decays telescope, and an event's weight is exp(-alpha (M_last - M)) minus the same with the M
        before it. Mean and squares are merged with those of the batch.
        """
        n = len(times)
        if not n:
            return np.zeros(0)
        x, t = np.asarray(embeddings, float).reshape(n, -1), np.asarray(times, float)
        newest = np.maximum.accumulate(t if not self.n else np.maximum(t, self.last_ts))
        left = np.exp(-self.alpha * (newest[-1] - newest))
        before = np.exp(-self.alpha * (newest[-1] - (self.last_ts if self.n else newest[0])))
        weight = left - np.concatenate([[before if self.n else 0.0], left[:-1]])
        if not self.n:
            self.rep, self.mean, self.m2 = (np.zeros(x.shape[1]) for _ in range(3))
        self.rep = (before * self.rep if self.n else 0.0) + weight @ x
        mean, total = x.mean(0), self.n + n
        move = mean - self.mean
        self.m2 = self.m2 + ((x - mean) ** 2).sum(0) + move**2 * self.n * n / total
        self.mean = self.mean + move * n / total
        self.n, self.last_ts = total, float(newest[-1])
        self.recent_ts = [*self.recent_ts, *t[-self.keep :].tolist()][-self.keep :]
        self.recent = [*self.recent, *x[-self.keep :]][-self.keep :]
        return self.rep

    def salient(self, threshold: float = 1.5, fallback: int = 5) -> list[int]:
        """Dimensions more than ``threshold`` sample deviations from the mean; fewer than two: the largest by magnitude."""
        d = len(self.rep)
        if self.n < 2:
            return list(range(min(fallback, d)))
        sd = np.sqrt(self.m2 / (self.n - 1))
        z = np.divide(np.abs(self.rep - self.mean), sd, out=np.zeros(d), where=sd > 0)
        hits = np.flatnonzero(z > threshold)
        return hits.tolist() if len(hits) > 1 else np.argsort(-np.abs(self.rep), kind="stable")[:fallback].tolist()

    def predict(self, steps: int = 1) -> list[np.ndarray]:
        """The last event and the decayed trend of the recent ones, step by step; empty without events."""
        if not self.n:
            return []
        x, t = np.array(self.recent), np.array(self.recent_ts)
        if len(x) < 2:
            return [x[-1]] * steps
        w = np.exp(-self.alpha * (t.max() - t[1:]))
        trend = (np.diff(x, axis=0) * w[:, None]).sum(0) / w.sum()
        return [x[-1] + trend * k for k in range(1, steps + 1)]

    def reset(self) -> None:
        self.__init__(self.alpha, self.keep)

    def snapshot(self) -> tuple:
        """Plain values in the order of ``STATE``."""
        return (self.n, self.last_ts, self.rep.tolist(), self.mean.tolist(), self.m2.tolist(), list(self.recent_ts), [x.tolist() for x in self.recent])

    @classmethod
    def restored(cls, snapshot: tuple, alpha: float = 1.0, keep: int = 100) -> Incremental:
        n, last, rep, mean, m2, times, recent = snapshot
        return cls(alpha, keep, n, last, np.array(rep, float), np.array(mean, float), np.array(m2, float), list(times), [np.array(x, float) for x in recent])

    @classmethod
    def of(cls, embeddings, times, alpha: float = 1.0, keep: int = 100) -> Incremental:
        """From a whole sequence in any order."""
        out = cls(alpha, keep)
        order = np.argsort(np.asarray(times, float), kind="stable")
        out.update_batch([embeddings[i] for i in order], [times[i] for i in order])
        return out


def representations(events: DataFrame, alpha: float = 1.0, steps: int = 1, keep: int = 100) -> DataFrame:
    """A stream of (id, ts, embedding) as a stream of each changed id's state after the micro-batch (update mode)."""
    reach(events.sparkSession)

    def advance(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = Incremental.restored(state.get, alpha, keep) if state.exists else Incremental(alpha, keep)
        rows = pd.concat(list(parts)).sort_values("ts", kind="stable")
        held.update_batch(rows.embedding.tolist(), rows.ts.tolist())
        state.update(held.snapshot())
        yield pd.DataFrame({"id": [key[0]], "n": [held.n], "last_ts": [held.last_ts], "representation": [held.rep.tolist()], "salient": [held.salient()], "predictions": [[p.tolist() for p in held.predict(steps)]]})

    return events.select("id", "ts", "embedding").groupBy("id").applyInPandasWithState(advance, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)
