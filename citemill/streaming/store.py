"""Run tables on disk: written aside, then renamed, one folder per run."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def save_run(spark: SparkSession, root: str, run_id: str, tables: dict[str, DataFrame]) -> None:
    """Writes a run's tables, replacing an older version of the run only when all are written; the older one is moved aside and deleted last."""
    files, path = _file_system(spark, root)
    mark = uuid.uuid4().hex
    aside, old, final = path(f"{root}/.{run_id}-{mark}"), path(f"{root}/.{run_id}-{mark}-old"), path(f"{root}/{run_id}")
    for name, table in tables.items():
        table.write.parquet(f"{aside}/{name}.parquet")
    replaced = files.exists(final)
    if replaced and not files.rename(final, old):
        raise OSError(f"{final} could not be renamed to {old}")
    if not files.rename(aside, final):
        if replaced:
            files.rename(old, final)
        raise OSError(f"{aside} could not be renamed to {final}")
    if replaced:
        files.delete(old, True)


def load_run(spark: SparkSession, root: str, run_id: str, name: str) -> DataFrame:
    """A table of a run; while its folder is being replaced, or if that was cut short, the version that was moved aside."""
    files, path = _file_system(spark, root)
    place = path(f"{root}/{run_id}")
    if not files.exists(place):
        old = files.globStatus(path(f"{root}/.{run_id}-*-old")) or []
        place = max(old, key=lambda f: f.getModificationTime()).getPath() if len(old) else place
    return spark.read.parquet(f"{place}/{name}.parquet")


def delete_runs(spark: SparkSession, root: str, run_ids: list[str]) -> None:
    files, path = _file_system(spark, root)
    for run_id in run_ids:
        files.delete(path(f"{root}/{run_id}"), True)


def export_report(report: DataFrame, path: str) -> None:
    """The report as one CSV file with a header, in its order."""
    report.orderBy("bucket", "idx").coalesce(1).write.option("header", True).mode("overwrite").csv(path)
