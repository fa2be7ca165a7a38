"""What the corpus operators share: reading tables, kept tables, words and text keys, joins on keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import clean_up, new_place, shared_dir, written  # noqa: F401

#: White space that separates words; everything else belongs to a word.
SPACES = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table; whatever other columns it has are left out."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def lowered(text: Column) -> Column:
    """text with A to Z in lower case; other letters stay as they are."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def pinned(df: DataFrame) -> DataFrame:
    """df with its columns computed once per row: projections above are not merged into it, which would evaluate them again for each use inside a lambda."""
    return df.select(F.explode(F.array(F.struct("*"))).alias("pinned")).select("pinned.*")


def keyed_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """left and right joined on column key, which right has once for each value (how: inner or left).

    A key that holds many of left's rows is split by adaptive execution, along the map tasks that its rows come from, whether
    they differ or not. A small right is broadcast by Spark, which knows its size where it comes from written.
    """
    return left.join(right.withColumnRenamed(key, "_key"), F.col(key) == F.col("_key"), how).drop("_key")
