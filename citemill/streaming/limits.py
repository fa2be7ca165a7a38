"""Rate limits with bursts: a leaky bucket per key, over tables of any size and over streams."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..runtime import ship
from .folds import Fold, ordered_fold

#: Requests a minute and burst of the two limited pages (fixed values).
SUBMISSIONS, SEARCHES = (5, 2), (20, 10)


class Bucket(Fold):
    """So many requests a period, and so many more at once.

    The level of a key falls by `requests` units a microsecond; an accepted request adds `period`, so all is exact in whole numbers. A
    request that would lift the level over burst * period is refused and adds nothing. The first request of a key, or one
    after the level has run out, leaves it at 0. State: [level, time of the last request]; a level below 0 is time in hand, at most one request's.
    """

    needs, adds = ("at",), "accepted boolean, excess double"

    def __init__(self, requests: int, period: int = 60_000_000, burst: int = 0):
        self.rate, self.one, self.most = requests, period, burst * period

    def _next(self, level: int, fall: int) -> tuple[int, bool]:
        """The level after it fell and a request came, and whether that was accepted."""
        lifted = max(level - fall, -self.one) + self.one
        return (lifted, True) if lifted <= self.most else (lifted - self.one, False)

    def run(self, state, rows):
        level, last = state or (-self.one, rows[0]["at"])
        found = []
        for r in rows:
            level, accepted = self._next(level, self.rate * (r["at"] - last))
            last = r["at"]
            found.append((accepted, level / self.one if accepted else (level + self.one) / self.one))
        return found, [level, last]

    def summary(self, rows):
        """First and last time, and pieces [low, high, moves, offset]: a level from low to high at the first time ends at offset, plus itself if it moves.

        There are about as many pieces as the burst has requests (measured: 13 of a burst of 10, 503 of 500).
        """
        pieces, last = [[-self.one, self.most, 1, 0]], rows[0]["at"]
        for r in rows:
            fall, last = self.rate * (r["at"] - last), r["at"]
            new: list[list[int]] = []
            for low, high, moves, offset in pieces:
                if not moves:
                    cuts = [(low, high, 0, self._next(offset, fall)[0])]
                else:
                    # Levels up to zero leave 0, up to full are lifted, others refused.
                    zero, full = fall - self.one - offset, self.most + fall - self.one - offset
                    cuts = [(low, min(high, zero), 0, 0), (max(low, zero + 1), min(high, full), 1, offset - fall + self.one), (max(low, full + 1), high, 1, offset - fall)]
                for a, b, m, o in cuts:
                    if a <= b:
                        if new and new[-1][2:] == [m, o]:
                            new[-1][1] = b
                        else:
                            new.append([a, b, m, o])
            pieces = new
        return [rows[0]["at"], last, pieces]

    def apply(self, summary, state):
        first, last, pieces = summary
        level = -self.one if state is None else min(max(state[0] - self.rate * (first - state[1]), -self.one), self.most)
        return [next(offset + moves * level for low, high, moves, offset in pieces if low <= level <= high), last]


def limited(events: DataFrame, key: str, time: str, tie: str, requests: int, period: int = 60_000_000, burst: int = 0) -> DataFrame:
    """events with accepted and excess (the level in requests, for refused ones what it would have been), taken in order of time (a timestamp) and tie within each key."""
    timed = events.withColumn("at", F.unix_micros(F.col(time).cast("timestamp")))
    return ordered_fold(timed, key, ["at", tie], Bucket(requests, period, burst)).drop("at")


class Limiter(StatefulProcessor):
    """Bucket over a stream; a key's state goes when its level has run out."""

    def __init__(self, bucket: Bucket, key: str):
        self.bucket, self.key = bucket, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("level", "level long, at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        listed = sorted((r.asDict() for r in rows), key=lambda r: (r["at"], r["tie"]))
        known = self.state.get() if self.state.exists() else None
        found, (level, at) = self.bucket.run([known[0], known[1]] if known else None, listed)
        self.state.update((level, at))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer((at + max(0, level + self.bucket.one) // self.bucket.rate) // 1000 + 1)
        for r, (accepted, excess) in zip(listed, found, strict=True):
            yield Row(**{self.key: key[0], "tie": r["tie"], "at": r["at"], "accepted": accepted, "excess": excess})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_limited(events: DataFrame, key: str, time: str, tie: str, bucket: Bucket, late: str = "0 seconds") -> DataFrame:
    """key, tie, at (microseconds), accepted and excess of a stream of events whose batches come in order of time; later ones than late are dropped."""
    ship(events.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    timed = events.select(F.col(key).alias(key), F.col(tie).alias("tie"), F.unix_micros(F.col(time).cast("timestamp")).alias("at"), F.col(time).cast("timestamp").alias("time")).withWatermark("time", late)
    schema = f"`{key}` {kinds[key]}, tie {kinds[tie]}, at long, accepted boolean, excess double"
    return timed.groupBy(key).transformWithState(Limiter(bucket, key), schema, "Append", "EventTime")

