"""Ingestion attempts as keyed state: counted, backed off, due again, and ended.

Attempts arrive at least once and out of order. They wait in their upload's state until
the watermark has passed them and are applied in the order of their time, so neither the
split into batches nor repeated ones change the result. Each application and each retry
that falls due without a new attempt is a row of the output; the last one of an upload
is its state. Attempts older than the watermark allows are dropped by it.

A call of the state store takes about as long as hundreds of attempts take to be applied,
so uploads are dealt into buckets by hash, and those of a bucket share one state and one
timer: the calls follow from the buckets that a batch touches, not from attempts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: First pause and longest one in seconds, and the attempts that are made at most.
PAUSE, LONGEST, ATTEMPTS = 60, 6 * 3600, 5
#: Outcomes that end an upload, and its status then.
ENDS = {"completed": "completed", "needs_review": "needs_review", "permanent": "failed"}
STEPS = "upload_id string, step int, attempts int, status string, started_at timestamp, attempted_at timestamp, next_attempt_at timestamp, completed_at timestamp, due int, last_error string"
#: State of the uploads of a bucket, and attempts that wait, an array a column. Times are microseconds since 1970.
UPLOADS = "upload_id array<string>, step array<int>, attempts array<int>, status array<string>, started array<long>, attempted array<long>, attempt_id array<long>, next array<long>, completed array<long>, due array<int>, error array<string>"
WAITING = "upload_id array<string>, at array<long>, attempt_id array<long>, outcome array<string>, error array<string>"
RAW = "upload_id string, step int, attempts int, status string, started long, attempted long, next long, completed long, due int, last_error string"
_FIELDS = [c.split()[0] for c in RAW.split(", ")]
#: Buckets of uploads.
BUCKETS = 4096
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def pause_seconds(attempts: int) -> int:
    return min(PAUSE * 2 ** max(0, attempts - 1), LONGEST)


class _Attempts(StatefulProcessor):
    """The uploads of a bucket."""

    def __init__(self, forget_days: int) -> None:
        self.forget = forget_days * 86_400_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.uploads = handle.getValueState("uploads", UPLOADS)
        self.waiting = handle.getListState("waiting", WAITING)
        self.wake = handle.getValueState("wake", "ms long")

    def _wake_at(self, time: int) -> None:
        """The bucket's one timer, which goes off as soon as the watermark is not below ``time``; an earlier one stays."""
        ms = -(-time // 1000) - 1  # timers go off below the watermark
        known = self.wake.get()
        if known is None or ms < known[0]:
            if known is not None:
                self.handle.deleteTimer(known[0])
            self.handle.registerTimer(ms)
            self.wake.update((ms,))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        come = [tuple(r[c].tolist() for c in ("upload_id", "at", "attempt_id", "outcome", "error")) for r in rows if len(r)]
        if come:
            self.waiting.appendList(come)
            self._wake_at(min(min(at) for _, at, *_ in come))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        ready: dict[str | None, set[tuple]] = {}
        later = []
        for part in self.waiting.get() if self.waiting.exists() else ():
            for w in zip(*part, strict=True):
                if w[1] <= mark:
                    ready.setdefault(w[0], set()).add(w[1:])
                else:
                    later.append(w)
        known = self.uploads.get()
        known = {u[0]: u[1:] for u in zip(*known, strict=True)} if known else {}
        found = []
        for upload, tries in ready.items():
            known[upload] = self._applied(upload, known.get(upload), sorted(tries, key=lambda t: t[:2]), mark, found)
        expected = {w[0] for w in later}
        for upload, state in [u for u in known.items() if u[0] not in ready]:
            if state[6] is not None and state[6] <= mark:
                known[upload] = self._applied(upload, state, (), mark, found)
            elif state[4] + self.forget <= mark and upload not in expected:
                del known[upload]
        if later:
            self.waiting.put([tuple(map(list, zip(*later, strict=True)))])
        else:
            self.waiting.clear()
        self.wake.clear()
        if known:
            self.uploads.update(tuple(map(list, zip(*((u, *state) for u, state in known.items()), strict=True))))
        else:
            self.uploads.clear()
        times = [w[1] for w in later] + [s[6] if s[6] is not None else max(s[4] + self.forget, mark + 1) for s in known.values()]
        if times:
            self._wake_at(min(times))
        if found:
            yield pd.DataFrame({n: pd.Series(v, dtype=object) for n, v in zip(_FIELDS, zip(*found, strict=True), strict=True)})

    def _applied(self, upload: str | None, state: tuple | None, tries: Iterable[tuple], mark: int, found: list[tuple]) -> tuple:
        """The upload's state after these attempts, and after a retry that is due by ``mark``; each step is added to ``found``."""
        step, attempts, status, started, attempted, last, due_at, completed, due, error = state or (0, 0, "pending", None, None, -1, None, None, 0, None)
        for at, number, outcome, said in chain(tries, ((mark + 1, None, None, None),)):
            if number is not None and attempted is not None and (at, number) <= (attempted, last):
                continue
            if due_at is not None and due_at < at:
                step, due, due_at = step + 1, due + 1, None
                found.append((upload, step, attempts, status, started, attempted, due_at, completed, due, error))
            if number is None:
                break
            step, attempts, attempted, last, started = step + 1, attempts + 1, at, number, at if started is None else started
            due_at, completed, error = None, None, None if outcome in ("completed", "needs_review") else said
            status = ENDS.get(outcome) or ("retrying" if attempts < ATTEMPTS else "failed")
            if status == "retrying":
                due_at = at + pause_seconds(attempts) * 1_000_000
            else:
                completed = at
            found.append((upload, step, attempts, status, started, attempted, due_at, completed, due, error))
        return step, attempts, status, started, attempted, last, due_at, completed, due, error

    def close(self) -> None:
        pass


def attempts(stream: DataFrame, late: str = "10 minutes", forget_days: int = 2555, buckets: int = BUCKETS) -> DataFrame:
    """STEPS of a stream of attempts (upload_id string, attempted_at timestamp, attempt_id long, outcome, error).

    ``outcome``: completed, needs_review, permanent, or anything else for a failure that is
    tried again. An upload without news for ``forget_days`` is forgotten; a later attempt is
    its first again. ``buckets`` must stay the same over a checkpoint; a batch reads and writes
    the states of all uploads of those that it touches. The session needs ``spark.sql.streaming.stateStore.providerClass`` to be
    PROVIDER, which keeps state on disk.
    """
    marked = stream.withWatermark("attempted_at", late).where("attempted_at IS NOT NULL")
    number = F.coalesce("attempt_id", F.lit(2**63 - 1)).alias("attempt_id")
    rows = marked.select("upload_id", "attempted_at", F.unix_micros("attempted_at").alias("at"), number, "outcome", "error", F.pmod(F.xxhash64("upload_id"), F.lit(buckets)).alias("bucket"))
    found = rows.groupBy("bucket").transformWithStateInPandas(_Attempts(forget_days), RAW, "Append", "EventTime")
    time = lambda c, n: F.timestamp_micros(c).alias(n)
    return found.select("upload_id", "step", "attempts", "status", time("started", "started_at"), time("attempted", "attempted_at"), time("next", "next_attempt_at"), time("completed", "completed_at"), "due", "last_error")
