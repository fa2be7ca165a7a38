"""Counts of a run, taken while its tables pass by: no job of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class RunCounts:
    """Names tables to count; the counts are there once some action has read each of them whole. A table read by several actions is counted by the first."""

    def __init__(self) -> None:
        self._seen: dict[str, Observation] = {}

    def of(self, name: str, df: DataFrame, which: Column | None = None) -> DataFrame:
        """df, with its rows (those that are which) counted under name."""
        if name in self._seen:
            raise ValueError(f"{name} is counted already")
        self._seen[name] = Observation(name)
        return df.observe(self._seen[name], (F.count(F.lit(1)) if which is None else F.count_if(which)).alias("n"))

    def get(self) -> dict[str, int]:
        """Counts by name; waits for the action that reads each table, which must have begun."""
        return {name: seen.get["n"] for name, seen in self._seen.items()}
