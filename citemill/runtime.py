"""What jobs share: modules for Python workers, and tables kept in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Sends this package's modules to the executors, once per application."""
    context = spark.sparkContext
    if getattr(context, "_citemill_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="citemill-")) / "citemill_modules.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._citemill_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); where none is set, a temporary one on a local master and an error on a cluster."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="citemill-shared-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found


def new_place(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder, which clean_up of this session deletes."""
    place = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    vars(spark).setdefault("_citemill_places", []).append(place)
    return place


def written(df: DataFrame) -> DataFrame:
    """df, computed once, as a table in the shared folder: it survives lost executors, and has its true size."""
    path = new_place(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """df dealt by key over a few tasks a core, for costly work on each row: a file of few row groups would leave most cores idle."""
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)


def clean_up(spark: SparkSession) -> None:
    """Deletes what this session wrote to the shared folder. Call it when all results have been stored elsewhere."""
    for place in vars(spark).pop("_citemill_places", []):
        folder = spark._jvm.org.apache.hadoop.fs.Path(place)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
