import zipfile
from xml.etree import ElementTree as ET

import pytest
from citemill.operators.counts import RunCounts
from citemill.sources import workbook as W
from pyspark.sql import functions as F

N = {"m": W.MAIN, "p": W.PACKAGE}
REPORT = "pmid string, bucket int, idx long, category string, journal string"
CITES = "pmid string, pmcid string, doi string, title string, journal string, print_date string, authors string, publication_types array<string>"


def opened(path):
    with zipfile.ZipFile(path) as book:
        assert book.testzip() is None
        for name in book.namelist():
            ET.fromstring(book.read(name))  # every file is well-formed
        sheet, targets = ET.fromstring(book.read("xl/worksheets/sheet1.xml")), ET.fromstring(book.read("xl/worksheets/_rels/sheet1.xml.rels"))
        title = ET.fromstring(book.read("xl/workbook.xml")).find("m:sheets/m:sheet", N).get("name")
    rows = [(r.get("r"), {c.get("r"): c.find("m:is/m:t", N).text for c in r}) for r in sheet.iterfind("m:sheetData/m:row", N)]
    urls = {t.get("Id"): t.get("Target") for t in targets}
    links = {h.get("ref"): urls[h.get(f"{{{W.RELATIONS}}}id")] for h in sheet.iterfind("m:hyperlinks/m:hyperlink", N)}
    return sheet, rows, links, title


@pytest.mark.parametrize("files", [1, 9])
def test_workbook(spark, tmp_path, files):
    n = 200
    report = spark.createDataFrame([(str(k), k % 3, k, "coauthor", "x") for k in range(n)] + [("odd", 2, 10**6, "1st/Sr author", "x")], REPORT)
    cites = spark.createDataFrame([(str(k), f"PMC{k}" if k % 2 else None, f"10.1/{k}&a" if k % 5 else "", f"T <{k}>", "J", "2020", "A B", ["Review", "Letter"]) for k in range(n)], CITES)
    path = str(tmp_path / "out" / "report.xlsx")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(files == 1).lower())
    spark.conf.set("spark.sql.shuffle.partitions", str(files))
    try:
        W.write_workbook(report, cites, path, "All & more")
        W.write_workbook(report, cites, path, "All & more")  # replaces the first
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    sheet, rows, links, title = opened(path)
    assert title == "All & more" and [r for r, _ in rows] == [str(k) for k in range(1, n + 3)]
    assert list(rows[0][1].values()) == list(W.COLUMNS)
    order = sorted(range(n), key=lambda k: (k % 3, k))
    for at, k in enumerate(order, 2):
        cells = rows[at - 1][1]
        assert cells[f"A{at}"] == (f"PMID {k} | PMC{k}" if k % 2 else f"PMID {k}") and cells[f"E{at}"] == f"T <{k}>" and cells[f"I{at}"] == "Review, Letter"
        assert cells.get(f"C{at}") == ("PMC" if k % 2 else None) and links[f"B{at}"] == f"https://pubmed.ncbi.nlm.nih.gov/{k}/"
        assert links.get(f"C{at}") == (f"https://pmc.ncbi.nlm.nih.gov/articles/PMC{k}/" if k % 2 else None)
        assert links.get(f"D{at}") == (f"https://doi.org/10.1/{k}&a" if k % 5 else None)
    assert rows[-1][1][f"A{n + 2}"] == "PMID odd" and rows[-1][1][f"J{n + 2}"] == "1st/Sr author"
    assert sheet.find("m:sheetViews/m:sheetView/m:pane", N).get("topLeftCell") == "A2"
    assert [int(c.get("width")) for c in sheet.iterfind("m:cols/m:col", N)] == list(W.COLUMNS.values())
    assert [p.name for p in (tmp_path / "out").iterdir() if p.is_dir()] == []


def test_empty_workbook_and_odd_characters(spark, tmp_path):
    path = str(tmp_path / "none.xlsx")
    W.write_workbook(spark.createDataFrame([], REPORT), spark.createDataFrame([], CITES), path)
    _, rows, links, _ = opened(path)
    assert len(rows) == 1 and not links
    assert "a b&amp;" in W.fragments(2, ["a\x07b&"], {})[0] and W.fragments(2, [None, ""], {})[0] == '<row r="2"></row>'


def test_run_counts_need_no_jobs_of_their_own(spark, tmp_path):
    counts = RunCounts()
    left = counts.of("left", spark.range(100))
    right = counts.of("right", spark.range(40).withColumn("odd", F.col("id") % 2 == 1), F.col("odd"))
    joined = counts.of("joined", left.join(right, "id"))
    joined.write.parquet(str(tmp_path / "out"))
    assert counts.get() == {"left": 100, "right": 20, "joined": 40}
    with pytest.raises(ValueError):
        counts.of("left", spark.range(1))
