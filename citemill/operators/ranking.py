"""Places in a global order, without one task that sees all rows."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import written


def numbered(rows: DataFrame, by: tuple[str, ...], order: list[str | Column], name: str = "idx") -> DataFrame:
    """rows with their place (from 0) in the order, which should leave no ties, among the rows that are equal in the columns of by.

    Rows are sorted by ranges into files; each file's rows are counted, by group, and the counts summed up to offsets: the only
    window holds a row for each file and group. A group of any size is spread over as many files as it fills. The sorted rows are
    kept in the shared folder, so what reads the result several times computes it once. Null is a group like any other.
    """
    keys = [*by, *order]
    placed = {"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}
    files = written(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumns(placed))
    counts = files.groupBy(*by, "_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_low"))
    before = F.sum("_n").over(Window.partitionBy(*(by or (F.lit(0),))).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = written(counts.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_part").alias("_of"), (F.coalesce(before, F.lit(0)) - F.col("_low")).alias("_shift")))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by], F.col("_part") == F.col("_of"))
    joined = files.join(offsets, same)
    return joined.select(*rows.columns, (F.col("_row") + F.col("_shift")).cast("long").alias(name))
