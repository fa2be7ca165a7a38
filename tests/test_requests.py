import pytest
from citemill.functions import requests
from citemill.streaming import store
from pyspark.sql import functions as F


def test_queries():
    assert requests.seed_query("30405060", "Josefa Sigrid Lund") == "30405060 Lund J" and requests.seed_query(" ", "x") == "" and requests.seed_query("1", "Cher") == "1 Cher"
    found = requests.profile_queries("Josefa Lund")
    assert found[0] == 'given-and-family-names:"josefa lund"' and found[-1] == "Josefa Lund" and len(found) == 6
    assert requests.profile_queries(" ") == []


def test_file_names():
    assert requests.file_name("Lund JS", 2020, 2024) == "lundjs_publications_2020_2024"
    assert requests.file_name("Cher", None, None) == "cher_publications_all_years" and requests.file_name("", 1, None) == "author_publications_all_years"


def test_problems():
    assert requests.problems("Lund J", ["1"], 2020, 2021) == []
    assert len(requests.problems("", [], 2, 1)) == 3 and len(requests.problems("Lund J", ["1"] * 501, None, None)) == 1


def test_upload(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"12 \xff 9999\n12")
    assert [r.pmid for r in requests.uploaded_pmids(spark, str(tmp_path)).orderBy("ord").collect()] == ["12", "9999"]
    (tmp_path / "b.txt").write_bytes(b"1" * 70_000)
    with pytest.raises(Exception, match="too large"):
        requests.uploaded_pmids(spark, str(tmp_path)).collect()


def test_author_list(spark):
    df = spark.sql("SELECT array(named_struct('position', 1, 'last_name', 'A&B', 'initials', 'X'), named_struct('position', 2, 'last_name', 'C', 'initials', '')) a")
    assert df.select(requests.author_list(F.col("a")).alias("r")).first().r == "A&B X, C"
    assert df.select(requests.author_list(F.col("a"), F.array(F.lit(1))).alias("r")).first().r == "<strong>A&amp;B X</strong>, C"


def test_runs(spark, tmp_path):
    root = str(tmp_path / "runs")
    for n in (2, 3):
        store.save_run(spark, root, "r1", {"rows": spark.range(n)})
        assert store.load_run(spark, root, "r1", "rows").count() == n
    # A replacement that was cut short between its two moves leaves the old version readable.
    (tmp_path / "runs/r1").rename(tmp_path / "runs/.r1-0123-old")
    assert store.load_run(spark, root, "r1", "rows").count() == n
    (tmp_path / "runs/.r1-0123-old").rename(tmp_path / "runs/r1")
    store.delete_runs(spark, root, ["r1"])
    assert not (tmp_path / "runs" / "r1").exists()
    store.export_report(spark.createDataFrame([(1, 0, "b"), (0, 1, "a")], "bucket int, idx int, pmid string"), str(tmp_path / "out"))
    assert next((tmp_path / "out").glob("*.csv")).read_text().split() == ["bucket,idx,pmid", "0,1,a", "1,0,b"]
