"""Job leases: a job that is not renewed in time is queued again, or lost on its last attempt."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MAX_ATTEMPTS = 3
REMEMBER_MS = 60 * 86_400_000  # how long a lost job's late renewals are still known for such
OUTPUT = "job_id bigint, attempt int, lapsed_ms bigint, outcome string"
STATE = "last_ms bigint, lapses int"


def stretches(batches: Iterator[pd.DataFrame], lease_ms: int) -> list[tuple[int, int]]:
    """The renewals of a job as (first, last) of every stretch of one lease's length in which there are any, in order. Two renewals of a
    stretch are never a lease apart, so nothing else of them matters: what is held grows with the time a batch covers, not with its renewals."""
    ends: dict[int, tuple[int, int]] = {}
    for batch in batches:
        ms = batch["ms"].to_numpy(np.int64)
        stretch, of = np.unique(ms // lease_ms, return_inverse=True)
        first, last = np.full(len(stretch), np.iinfo(np.int64).max), np.full(len(stretch), np.iinfo(np.int64).min)
        np.minimum.at(first, of, ms)
        np.maximum.at(last, of, ms)
        for s, a, b in zip(stretch.tolist(), first.tolist(), last.tolist()):
            low, high = ends.get(s, (a, b))
            ends[s] = (min(low, a), max(high, b))
    return [ends[s] for s in sorted(ends)]


def lease_lapses(renewals: DataFrame, lease_ms: int, remember_ms: int = REMEMBER_MS) -> DataFrame:
    """(job_id, ts) renewals to one row per lapse. Per job the state is the last renewal and the lapses so far; an event-time timer ends a
    lease nobody renews. A job whose lease lapsed and was not taken up again, and a lost one, keep their state for `remember_ms` more, in
    which a lost job takes no renewals, and are then forgotten: the state holds the open leases and those that ended of late."""

    def lapse(job: int, last: int, lapses: int) -> tuple[int, int, int, str]:
        return job, lapses, last + lease_ms, "WORKER_LOST" if lapses >= MAX_ATTEMPTS else "requeued"

    def track(key: tuple[int], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, lapses = state.get if state.exists else (None, 0)
        out = []
        if state.hasTimedOut:
            if last is None:
                state.remove()
                return
            lapses += 1
            out.append(lapse(key[0], last, lapses))
            ended, last = last + lease_ms, None
        else:
            ended = None
            for first, newest in stretches(batches, lease_ms):
                if lapses >= MAX_ATTEMPTS:
                    break
                if last is not None and first - last > lease_ms:
                    lapses += 1
                    out.append(lapse(key[0], last, lapses))
                    ended = last + lease_ms
                last = newest if last is None else max(last, newest)
            if lapses >= MAX_ATTEMPTS:
                last = None
        if last is None and ended is None:
            ended = state.getCurrentWatermarkMs()  # a lost job's renewal: the time to forget it stays about where it was
        state.update((last, lapses))
        due = ended + remember_ms if last is None else last + lease_ms
        state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["job_id", "attempt", "lapsed_ms", "outcome"])

    timed = renewals.withWatermark("ts", "1 second").selectExpr("job_id", "ts", "unix_millis(ts) as ms")
    return timed.groupBy("job_id").applyInPandasWithState(track, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
