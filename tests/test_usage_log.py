import glob
import os

import pytest
from citemill.streaming import usage_log as U

SCHEMA = "run string, at double, status string, error_message string, citation_count int"


def rows(df):
    return {r.run: (r.status, r.error_message, r.citation_count, r.created_at, r.updated_at) for r in df.collect()}


def bytes_in(path):
    return sum(os.path.getsize(f) for f in glob.glob(f"{path}/**/*.parquet", recursive=True))


def test_appends_and_compactions_equal_one_fold(spark, tmp_path):
    path = str(tmp_path / "log")
    one = spark.createDataFrame([("a", 1.0, "queued", "", None), ("b", 2.0, "queued", None, 5)], SCHEMA)
    two = spark.createDataFrame([("a", 3.0, "failed", "bad", None), ("c", 4.0, "queued", None, None)], SCHEMA)
    late = spark.createDataFrame([("a", 2.0, "running", None, 7)], SCHEMA)
    with pytest.raises(FileNotFoundError):
        U.current(spark, path, "run")
    U.append(one, path, "run", "first")
    U.append(one, path, "run", "first")  # again: counts once
    assert rows(U.current(spark, path, "run")) == {"a": ("queued", "", None, 1.0, 1.0), "b": ("queued", None, 5, 2.0, 2.0)}
    assert len(U.compact(spark, path, "run")) == 2 and U.compact(spark, path, "run") == []
    U.append(two, path, "run")
    want = {"a": ("failed", "bad", None, 1.0, 3.0), "b": ("queued", None, 5, 2.0, 2.0), "c": ("queued", None, None, 4.0, 4.0)}
    assert rows(U.current(spark, path, "run")) == want
    U.compact(spark, path, "run")
    assert rows(U.current(spark, path, "run")) == want
    U.append(late, path, "run")
    U.append(spark.createDataFrame([("b", 9.0, 1)], "run string, at double, error_count int"), path, "run")  # a column not seen before
    found = U.current(spark, path, "run")
    assert rows(found) == want | {"a": ("failed", "bad", 7, 1.0, 3.0), "b": ("queued", None, 5, 2.0, 9.0)}
    assert {r.run: r.error_count for r in found.collect()}["b"] == 1
    # An append that was not finished is not read.
    os.makedirs(f"{path}/log/half")
    assert U.current(spark, path, "run").count() == 3


def test_work_grows_with_the_batch(spark, tmp_path):
    path = str(tmp_path / "log")
    big = spark.range(20_000).selectExpr("cast(id as string) run", "1D at", "repeat(md5(cast(id as string)), 3) status", "'' error_message", "1 citation_count")
    U.append(big, path, "run")
    U.compact(spark, path, "run")
    log, base = bytes_in(f"{path}/log"), bytes_in(f"{path}/base")
    U.append(spark.createDataFrame([("7", 2.0, "done", None, None)], SCHEMA), path, "run")
    assert bytes_in(f"{path}/log") - log < log / 20
    assert len(U.compact(spark, path, "run")) == 1 and bytes_in(f"{path}/base") - base < base / 20
    assert rows(U.current(spark, path, "run").where("run = '7'")) == {"7": ("done", "", 1, 1.0, 2.0)}


def test_stream_into_the_log(spark, tmp_path):
    source, path, check = (str(tmp_path / x) for x in ("in", "log", "check"))
    for k in range(3):
        spark.createDataFrame([("a", float(k), f"s{k}", None, k), (f"r{k}", float(k), "queued", None, None)], SCHEMA).write.mode("append").parquet(source)
        U.stream_log(spark.readStream.schema(SCHEMA).parquet(source), path, check, "run").awaitTermination()
        if k == 1:
            U.compact(spark, path, "run")
    assert rows(U.current(spark, path, "run")) == {"a": ("s2", None, 2, 0.0, 2.0)} | {f"r{k}": ("queued", None, None, float(k), float(k)) for k in range(3)}


def test_records_replay_into_requests(spark):
    asked = [("a", ["preprint", "x \"y\""], ["1", "22"], 1990, 2000, False), ("b", [], [], 1950, 2025, True), ("c", None, ["3"], None, None, None)]
    requests = spark.createDataFrame(asked, "run string, excluded_type_terms array<string>, parsed_pmids array<string>, start_year int, end_year int, all_years boolean")
    kept = U.recorded(requests)
    assert [r.parsed_pmids for r in kept.orderBy("run").collect()] == ['["1","22"]', "[]", '["3"]']
    back = [tuple(r) for r in U.replayed(kept).orderBy("run").collect()]
    assert back == [asked[0], ("b", [], [], None, None, True), ("c", [], ["3"], None, None, None)]
    odd = spark.createDataFrame([("a", "no json", None)], "run string, excluded_type_terms string, parsed_pmids string")
    assert [tuple(r) for r in U.replayed(odd).collect()] == [("a", [], [])]
