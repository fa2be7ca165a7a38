"""Jobs as state machines: statuses with phases, illegal changes as rows, and expiry by timers.

A job is queued, then runs through phases, and is completed or failed. Every event asks for a status (null: the present one) and may set a
phase and an error. What TRANSITIONS does not allow changes nothing and is reported. The same step serves tables
(replay, an ordered fold that may split one job's events over many tasks) and streams (stream_phases).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..runtime import ship
from .folds import Fold, ordered_fold
from .jobs import TERMINAL, TTL_SECONDS

#: Statuses that a status may change to; "" is a job not yet known.
TRANSITIONS = {"": ("queued",), "queued": ("queued", "running", "failed"), "running": ("running", "completed", "failed"), "completed": (), "failed": ()}


def step(status: str, asked: str | None) -> tuple[str, bool]:
    """The status after an event, and whether it was legal."""
    wanted = status if asked is None else asked
    legal = bool(wanted) and wanted in TRANSITIONS[status]
    return (wanted, True) if legal else (status, False)


class Phases(Fold):
    """State: status, phase, error and the time of the first legal event."""

    needs, adds = ("at", "status", "phase", "error"), "now string, now_phase string, now_error string, created_at long, legal boolean"
    start = ["", None, None, None]

    def run(self, state, rows):
        status, phase, error, created = state
        found = []
        for r in rows:
            status, legal = step(status, r["status"])
            if legal:
                phase, error = phase if r["phase"] is None else r["phase"], error if r["error"] is None else r["error"]
                created = r["at"] if created is None else created
            found.append((status, phase, error, created, legal))
        return found, [status, phase, error, created]

    def summary(self, rows):
        """The state after the rows from each status, with nulls for what stays."""
        return {status: self.run([status, None, None, None], rows)[1] for status in TRANSITIONS}

    def apply(self, summary, state):
        status, *new = summary[state[0]]
        phase, error, created = (old if n is None else n for n, old in zip(new, state[1:], strict=True))
        return [status, phase, error, created if state[3] is None else state[3]]


def replay(events: DataFrame) -> DataFrame:
    """events (run, at in microseconds, seq, status, phase, error) with now, now_phase, now_error, created_at (of the job, after the event) and legal."""
    return ordered_fold(events, "run", ["at", "seq"], Phases())


def final(replayed: DataFrame) -> DataFrame:
    """run, status, phase, error, created_at and updated_at of every job that was ever queued, after its last event, and how many events were illegal."""
    last = lambda c: F.max_by(c, F.struct("at", "seq")).alias(c.removeprefix("now_") if c != "now" else "status")
    folded = replayed.groupBy("run").agg(last("now"), last("now_phase"), last("now_error"), F.max("created_at").alias("created_at"), F.max(F.when(F.col("legal"), F.col("at"))).alias("updated_at"), F.count_if(~F.col("legal")).alias("illegal"))
    return folded.where("status <> ''")


class Machine(StatefulProcessor):
    """Phases over a stream. A job that has ended is dropped ttl seconds after it was made, or when it ends, if that is later; an expired row says so."""

    def __init__(self, ttl: int):
        self.ttl, self.fold = ttl, Phases()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "status string, phase string, error string, created_at long")

    def _state(self) -> list:
        return list(self.job.get()) if self.job.exists() else list(self.fold.start)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        listed = sorted((r.asDict() for r in rows), key=lambda r: (r["at"], r["seq"]))
        found, state = self.fold.run(self._state(), listed)
        if state[0]:
            self.job.update(tuple(state))
        for r, (status, phase, error, created, legal) in zip(listed, found, strict=True):
            yield self._row(key[0], r["at"], r["seq"], status, phase, error, created, "change" if legal else "illegal")
        if state[0] in TERMINAL and not list(self.handle.listTimers()):
            self.handle.registerTimer(max(state[3] // 1000 + self.ttl * 1000, timerValues.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        status, phase, error, created = self._state()
        self.job.clear()
        yield self._row(key[0], expiredTimerInfo.getExpiryTimeInMs() * 1000, None, status, phase, error, created, "expired")

    @staticmethod
    def _row(run, at, seq, status, phase, error, created, kind) -> Row:
        return Row(run=run, at=at, seq=seq, status=status, phase=phase, error=error, created_at=created, kind=kind)

    def close(self) -> None:
        pass


def stream_phases(events: DataFrame, late: str = "0 seconds", ttl: int = TTL_SECONDS) -> DataFrame:
    """run, at, seq, status, phase, error, created_at and kind (change, illegal or expired) of a stream of events (run, time, seq, status, phase, error).

    Batches must come in order of time, up to late. Jobs expire as event time goes on, without an event of their own. Needs the RocksDB state store.
    """
    ship(events.sparkSession)
    timed = events.withWatermark("time", late).withColumn("at", F.unix_micros("time"))
    kinds = dict(events.dtypes)
    schema = f"run {kinds['run']}, at long, seq {kinds['seq']}, status string, phase string, error string, created_at long, kind string"
    return timed.groupBy("run").transformWithState(Machine(ttl), schema, "Append", "EventTime")
