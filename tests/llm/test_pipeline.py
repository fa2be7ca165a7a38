import os

import corpus_pipeline as P
import pytest
from citemill.llm import common, simhash
from pyspark.sql import functions as F


def test_order():
    assert [n for n, _ in P.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "decontamination", "sentencepiece"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    item = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").first().text
    extra = spark.createDataFrame([(10**6, None), (10**6 + 1, ""), (10**6 + 2, item), (10**6 + 3, "plain words that stay here"), (10**6 + 3, "plain words that stay here"), (None, "without a number")], "doc_id long, text string")
    extra = extra.select("doc_id", "text", F.lit(None).cast("string").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    base.unionByName(extra).withColumn("kept", F.lit(1)).write.parquet(f"{d}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").write.parquet(f"{d}/{t}.parquet")
    return d


def test_stages_and_run(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(P.STAGES):
        before = docs.count()
        stage(spark, docs, tables).write.parquet(f"{tmp_path}/{k}.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{k}.parquet")
        assert docs.count() == before if name in ("line_dedup", "sentencepiece") else docs.count() <= before
        if name != "sentencepiece":
            assert docs.columns == columns
    ids = [r.doc_id for r in docs.collect()]
    assert 10**6 + 2 not in ids and ids.count(10**6 + 3) == 1 and None in ids
    assert sorted(map(tuple, docs.collect()), key=repr) == sorted(map(tuple, P.run(spark, tables).collect()), key=repr)


def test_empty_tables(spark, tables, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tables}/{t}.parquet").where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_clean_up(spark):
    places = vars(spark).setdefault("_citemill_places", [])
    kept = common.written(spark.range(5))
    path = places[-1]
    assert kept.count() == 5 and os.path.isdir(path.removeprefix("file:"))
    common.clean_up(spark.newSession())  # another session's tables are its own
    assert kept.count() == 5
    common.clean_up(spark)
    assert not os.path.exists(path.removeprefix("file:")) and "_citemill_places" not in vars(spark)


def test_operators_leave_nothing_after_clean_up(spark):
    docs = spark.createDataFrame([(k, f"some words of text number {k % 3} and more of them") for k in range(9)], "doc_id long, text string")
    common.clean_up(spark)
    root = common.shared_dir(spark).removeprefix("file:")
    before = {d for d, _, files in os.walk(root) if files}
    assert simhash.near_duplicates(docs).count() == simhash.near_copies(docs).count() == 9
    assert {d for d, _, files in os.walk(root) if files} - before
    common.clean_up(spark)
    assert {d for d, _, files in os.walk(root) if files} <= before


def test_hot_keys_are_split(spark):
    """A key with most rows, all equal, is read by several tasks."""
    names = ("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")
    before = {n: spark.conf.get(n) for n in names}
    for n, v in zip(names, ("10k", "10k", "-1", "16"), strict=True):
        spark.conf.set(n, v)
    try:
        left = common.written(spark.range(0, 200_000, 1, 8).selectExpr("if(id % 3 > 0, 7, id % 1000) k", "'x' v"))
        right = common.written(left.groupBy("k").agg(F.count("*").alias("c")).where("k <> 3"))
        joined = common.keyed_join(left, right, "k")
        sizes = joined.groupBy(F.spark_partition_id()).count().collect()
        plan = joined.rdd.getNumPartitions()
        assert plan > 16 or max(r["count"] for r in sizes) < 100_000
        assert joined.count() == left.where("k <> 3").count() and common.keyed_join(left, right, "k", "left").count() == 200_000
        assert common.keyed_join(left, right.where("false"), "k").count() == 0
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
