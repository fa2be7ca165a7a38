"""Ordered folds over tables: a state per key that each row, in order, changes; a key may hold any share of the rows.

Rows are sorted by ranges of (key, order) into files, so a long key lies in several. What a file does to a state that is not yet
known is summed up for its first key (its other keys begin in it, from the known start). A key's summaries, a row for
each of its files, are chained to the state at the start of each file; then every file folds its own rows. So no task
holds more than a file's rows or a key's list of summaries, and the result is that of one pass in order.
"""

from __future__ import annotations

import json
from itertools import groupby
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import ship, written

State = Any  # what JSON can hold
#: About so many rows go to a file; a task's Python holds one file's at a time.
FILE_ROWS = 100_000


class Fold:
    """A state per key. Rows come as dicts of the columns that are named in needs."""

    needs: tuple[str, ...]
    #: Columns that the fold adds to each row, as a DDL schema.
    adds: str
    start: State = None

    def run(self, state: State, rows: list[dict]) -> tuple[list[tuple], State]:
        """What the fold adds to each row, and the state after the last."""
        raise NotImplementedError

    def summary(self, rows: list[dict]) -> State:
        """What the rows do to any state."""
        raise NotImplementedError

    def apply(self, summary: State, state: State) -> State:
        """The state after the rows of a summary."""
        raise NotImplementedError


def ordered_fold(rows: DataFrame, key: str, order: list[str], fold: Fold) -> DataFrame:
    """rows with the columns that fold adds, in the order of the columns of order (which should leave no ties) within each key.

    A null key is a key. An empty table gives no rows.
    """
    ship(rows.sparkSession)
    by = [key, *order]
    # A number of files that is given is kept by adaptive execution, which would join small ones up to bytes, not rows.
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // FILE_ROWS))
    files = written(rows.repartitionByRange(n, *by).withColumn("_part", F.spark_partition_id()))
    own = [key, *fold.needs]

    def in_order(table: pa.Table) -> pa.Table:
        return table.sort_by([(c, "ascending") for c in by])

    def keyed(table: pa.Table) -> list[tuple[Any, list[dict]]]:
        listed = table.select(list(dict.fromkeys(own))).to_pylist()
        return [(k, list(g)) for k, g in groupby(listed, key=lambda r: r[key])]

    def ends(table: pa.Table) -> pa.Table:
        """A file's first and last key, which may go on in others."""
        found = keyed(in_order(table))
        part = table["_part"][0].as_py()
        shown = [found[0]] if len(found) == 1 else [found[0], found[-1]]
        return pa.table({key: pa.array([k for k, _ in shown], table.schema.field(key).type), "_part": pa.array([part] * len(shown), pa.int32()), "_summary": [json.dumps(fold.summary(g)) for _, g in shown]})

    def chain(table: pa.Table) -> pa.Table:
        table, state, states = table.sort_by("_part"), fold.start, []
        for summary in table["_summary"].to_pylist():
            states.append(json.dumps(state))
            state = fold.apply(json.loads(summary), state)
        return pa.table({"_key": table[key], "_of": table["_part"], "_state": states})

    kind = rows.schema[key].dataType.simpleString()
    narrow = files.select(*dict.fromkeys([*by, *fold.needs, "_part"]))
    summaries = written(narrow.groupBy("_part").applyInArrow(ends, f"`{key}` {kind}, _part int, _summary string"))
    states = written(summaries.groupBy(key).applyInArrow(chain, f"_key {kind}, _of int, _state string"))
    added = T._parse_datatype_string(fold.adds)

    def run(table: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        table = in_order(table)
        states, new, at = table["_state"].to_pylist(), [], 0
        for _, group in keyed(table):
            known = states[at]
            found, _ = fold.run(fold.start if known is None else json.loads(known), group)
            new += found
            at += len(group)
        table = table.drop(["_part", "_state"])
        for k, field in enumerate(to_arrow_schema(added)):
            table = table.append_column(field, pa.array([n[k] for n in new], field.type))
        return table

    schema = T.StructType([*rows.schema.fields, *added.fields])
    met = files.join(states, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_of")), "left").drop("_key", "_of")
    return met.groupBy("_part").applyInArrow(run, schema)
