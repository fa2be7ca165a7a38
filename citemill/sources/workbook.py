"""A spreadsheet writer: a report's rows go from the tasks into one .xlsx file, with links, a frozen header and column widths.

Every task writes its rows, numbered beforehand, as fragments of sheet XML beside the target; the commit copies them one after
another into the file, in order of their rows and a block at a time, so no process holds the report. A task that failed leaves fragments
that no commit names; they go with the commit's own. A sheet ends at ROWS rows, header included; more raise an error.
"""

from __future__ import annotations

import posixpath
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..operators import ranking
from ..runtime import ship

# The report's columns with their widths, the rows of a sheet, and names of the file format.
COLUMNS = {"PMID/PMCID": 22, "PubMed Link": 14, "PMC Link": 10, "DOI": 28, "Title": 85, "Journal": 24, "Date": 14, "Authors": 56, "Publication Type": 24, "Counted as": 20}
ROWS = 1_048_576
MAIN, RELATIONS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE, TYPES = "http://schemas.openxmlformats.org/package/2006/relationships", "http://schemas.openxmlformats.org/package/2006/content-types"
FORMAT = "application/vnd.openxmlformats-officedocument.spreadsheetml"
HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
KINDS = ("rows", "links", "targets")
SCHEMA = "row long, cells array<string>, links map<int,string>"


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _cell(row: int, column: int, value: str, linked: bool) -> str:
    """A cell with text in place; characters that XML cannot hold become spaces."""
    text = escape(re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]", " ", value))
    return f'<c r="{chr(65 + column)}{row}" t="inlineStr"{" s=\"1\"" if linked else ""}><is><t xml:space="preserve">{text}</t></is></c>'


def fragments(row: int, cells: list[str | None], links: dict[int, str]) -> tuple[str, str, str]:
    """XML of a row, of its links and of what they lead to; links are by column, from 0."""
    body = "".join(_cell(row, k, value, k in links) for k, value in enumerate(cells) if value)
    names = {k: f"r{row}c{k}" for k in links}
    return (
        f'<row r="{row}">{body}</row>',
        "".join(f'<hyperlink ref="{chr(65 + k)}{row}" r:id="{name}"/>' for k, name in names.items()),
        "".join(f'<Relationship Id="{name}" Type="{RELATIONS}/hyperlink" Target={quoteattr(links[k])} TargetMode="External"/>' for k, name in names.items()),
    )


@dataclass
class Fragments(WriterCommitMessage):
    name: str
    first: int
    last: int


class WorkbookWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.title, self.mark = options["path"], options.get("title", "Publications"), uuid.uuid4().hex
        self.columns = dict(COLUMNS)

    def _parts(self) -> str:
        return f"{_place(self.path)[1]}.{self.mark}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Fragments:
        system, _ = _place(self.path)
        system.create_dir(self._parts())
        name, first, last = uuid.uuid4().hex, 0, 0
        out = {kind: system.open_output_stream(f"{self._parts()}/{name}.{kind}") for kind in KINDS}
        for batch in iterator:
            for r in batch.to_pylist():
                first, last = first or r["row"], r["row"]
                if last > ROWS:
                    raise ValueError(f"a sheet ends at row {ROWS}")
                for kind, xml in zip(KINDS, fragments(r["row"], r["cells"], {k: v for k, v in r["links"] if v}), strict=True):
                    out[kind].write(xml.encode())
        for stream in out.values():
            stream.close()
        return Fragments(name, first, last)

    def commit(self, messages: list[Fragments | None]) -> None:
        system, path = _place(self.path)
        system.create_dir(posixpath.dirname(path) or ".")
        parts = sorted((m for m in messages if m is not None and m.first), key=lambda m: m.first)
        if any(a.last >= b.first for a, b in zip(parts, parts[1:])):
            raise ValueError("rows of the tasks are not in order")
        header, _, _ = fragments(1, list(self.columns), {})
        widths = "".join(f'<col min="{k + 1}" max="{k + 1}" width="{w}" customWidth="1"/>' for k, w in enumerate(self.columns.values()))
        frozen = '<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>'
        linked = any(system.get_file_info(f"{self._parts()}/{m.name}.links").size for m in parts)
        with system.open_output_stream(path, compression=None) as target, zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as book:

            def put(name: str, *pieces: str) -> None:
                """A file of the book, of texts and, for a kind's name, all fragments of that kind."""
                with book.open(name, "w", force_zip64=True) as out:
                    for piece in pieces:
                        if piece not in KINDS:
                            out.write(piece.encode())
                            continue
                        for m in parts:
                            with system.open_input_stream(f"{self._parts()}/{m.name}.{piece}") as source:
                                while block := source.read(1 << 20):
                                    out.write(block)

            sheet = [HEAD, f'<worksheet xmlns="{MAIN}" xmlns:r="{RELATIONS}">{frozen}<cols>{widths}</cols><sheetData>{header}', "rows", "</sheetData>"]
            put("xl/worksheets/sheet1.xml", *sheet, *(["<hyperlinks>", "links", "</hyperlinks>"] if linked else []), "</worksheet>")
            put("xl/worksheets/_rels/sheet1.xml.rels", HEAD, f'<Relationships xmlns="{PACKAGE}">', "targets", "</Relationships>")
            put("xl/workbook.xml", HEAD, f'<workbook xmlns="{MAIN}" xmlns:r="{RELATIONS}"><sheets><sheet name={quoteattr(self.title)} sheetId="1" r:id="s1"/></sheets></workbook>')
            put("xl/_rels/workbook.xml.rels", HEAD, f'<Relationships xmlns="{PACKAGE}"><Relationship Id="s1" Type="{RELATIONS}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="s2" Type="{RELATIONS}/styles" Target="styles.xml"/></Relationships>')
            fonts = '<fonts count="2"><font><sz val="11"/><name val="Calibri"/></font><font><u/><sz val="11"/><color rgb="FF0563C1"/><name val="Calibri"/></font></fonts>'
            rest = '<fills count="1"><fill><patternFill patternType="none"/></fill></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs>'
            put("xl/styles.xml", HEAD, f'<styleSheet xmlns="{MAIN}">{fonts}{rest}<cellXfs count="2"><xf/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>')
            put("_rels/.rels", HEAD, f'<Relationships xmlns="{PACKAGE}"><Relationship Id="b1" Type="{RELATIONS}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
            kinds = "".join(f'<Override PartName="/xl/{part}" ContentType="{FORMAT}.{kind}+xml"/>' for part, kind in (("workbook.xml", "sheet.main"), ("worksheets/sheet1.xml", "worksheet"), ("styles.xml", "styles")))
            put("[Content_Types].xml", HEAD, f'<Types xmlns="{TYPES}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{kinds}</Types>')
        if system.get_file_info(self._parts()).type == fs.FileType.Directory:
            system.delete_dir(self._parts())

    def abort(self, messages: list[Fragments | None]) -> None:
        system, _ = _place(self.path)
        if system.get_file_info(self._parts()).type == fs.FileType.Directory:
            system.delete_dir(self._parts())


class WorkbookSource(DataSource):
    """Options: path (of the file), title (of the sheet)."""

    @classmethod
    def name(cls) -> str:
        return "report_workbook"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> WorkbookWriter:
        return WorkbookWriter(self.options)


def workbook_rows(report: DataFrame, cites: DataFrame) -> DataFrame:
    """row (from 2), cells and links of a report (review.report: pmid, bucket, idx, category), with what cites (pmid, pmcid, doi, title, journal, print_date, authors, publication_types) says of each pmid."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    # Keys are written apart from the report's own, whose columns may have the same names.
    about = cites.select(F.col("pmid").alias("c_pmid"), *[blank(c).alias(f"c_{c}") for c in ("pmcid", "doi", "title", "journal", "print_date", "authors")], F.array_join("publication_types", ", ").alias("c_types"))
    met = report.select("pmid", "bucket", "idx", "category").join(about, F.col("pmid") == F.col("c_pmid"), "left")
    known = lambda c: F.coalesce(c, F.lit(""))
    pmc = known(F.col("c_pmcid")) != ""
    cells = F.array(
        F.concat(F.lit("PMID "), "pmid", F.when(pmc, F.concat(F.lit(" | "), "c_pmcid")).otherwise("")), F.lit("PubMed"), F.when(pmc, "PMC").otherwise(""),
        *[known(F.col(f"c_{c}")) for c in ("doi", "title", "journal", "print_date", "authors", "types")], F.col("category"),
    )

    def link(condition: Column, *parts: str | Column) -> Column:
        return F.when(condition, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))

    links = F.create_map(
        F.lit(1), link(F.lit(True), "https://pubmed.ncbi.nlm.nih.gov/", F.col("pmid"), "/"),
        F.lit(2), link(pmc, "https://pmc.ncbi.nlm.nih.gov/articles/", F.col("c_pmcid"), "/"),
        F.lit(3), link(known(F.col("c_doi")) != "", "https://doi.org/", F.col("c_doi")),
    )
    placed = ranking.numbered(met.select("bucket", "idx", "pmid", cells.alias("cells"), links.alias("links")), (), ["bucket", "idx", "pmid"], "row")
    return placed.select((F.col("row") + 2).alias("row"), "cells", "links")


def write_workbook(report: DataFrame, cites: DataFrame, path: str, title: str = "Publications") -> None:
    """The report as a workbook at path, replacing one that is there: excluded rows first, then by bucket and place."""
    spark = report.sparkSession
    ship(spark)
    spark.dataSource.register(WorkbookSource)
    rows = workbook_rows(report, cites)
    rows.repartitionByRange("row").sortWithinPartitions("row").write.format("report_workbook").option("title", title).mode("append").save(path)
