"""Citations from XML: PubMed article sets and full-text (JATS) articles.

Only the extraction from XML is imperative, one pass per document inside mapInArrow; what
follows (shared affiliations, roles, affiliation choice) is DataFrame work on its typed output.
Documents that are not well-formed give no rows, or where errors are asked for a row with nothing but the error.
"""

from __future__ import annotations

import html
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..operators.records import EQUAL, SENIOR
from ..runtime import ship

AUTHOR = "struct<author_ord:int,position:int,last_name:string,fore_name:string,initials:string,blocks:array<string>,orcid:string>"
PUBMED = f"pmid string, title string, journal string, print_date string, doi string, publication_types array<string>, update_in array<string>, update_of array<string>, article_blocks array<string>, authors array<{AUTHOR}>"
CONTRIBUTOR = "struct<author_ord:int,position:int,last_name:string,fore_name:string,orcid:string,inline:array<string>,rids:array<string>,labels:array<string>,note_rids:array<string>,has_xref:boolean>"
PMC = f"pmcid string, doi string, contributors array<{CONTRIBUTOR}>, affs_by_id map<string,string>, affs_by_label map<string,string>, notes map<string,string>"
#: So many characters of documents are parsed into one batch, or one document that has more.
MOST_PARSED = 1 << 21
#: What references and labels are parted into.
PIECES = re.compile(r"[^,\s;]+")
#: Words that make a note an affiliation (fixed values).
HINTS = ("department", "division", "institute", "university", "school", "college", "hospital", "laboratory", "center", "centre", "nih", "national institutes of health")


def _name(node: ET.Element) -> str:
    return node.tag.rpartition("}")[2] if isinstance(node.tag, str) else ""


def _local(root: ET.Element) -> ET.Element:
    """root with all tags below as local names, so that elements are found by tag."""
    for n in root.iter():
        if "}" in n.tag:
            n.tag = _name(n)
    return root


def _all(node: ET.Element, *path: str) -> list[ET.Element]:
    """Descendants by a path of local names; the first step may be at any depth, the others are children."""
    found = [n for n in node.iter(path[0]) if n is not node]
    for step in path[1:]:
        found = [c for n in found for c in n.findall(step)]
    return found


def _by_tag(nodes: Iterable[ET.Element]) -> dict[str, list[ET.Element]]:
    """nodes by local name, in order: one pass, where many names are asked for."""
    found: dict[str, list[ET.Element]] = {}
    for n in nodes:
        if n.tag in found:
            found[n.tag].append(n)
        else:
            found[n.tag] = [n]
    return found


def _below(node: ET.Element) -> dict[str, list[ET.Element]]:
    every = node.iter()
    next(every)
    return _by_tag(every)


def _children(node: ET.Element | None, name: str) -> list[ET.Element]:
    return [] if node is None else node.findall(name)


def _parts(n: ET.Element, skip: tuple[str, ...]) -> Iterator[str]:
    yield n.text or ""
    for c in n:
        if c.tag not in skip:
            yield from _parts(c, skip)
        yield c.tail or ""


def _text(node: ET.Element | None, skip: tuple[str, ...] = ()) -> str:
    """All text below a node, white space collapsed, entities decoded; without the text of skipped elements."""
    if node is None:
        return ""
    told = node.text if not len(node) else "".join(_parts(node, skip) if skip else node.itertext())
    plain = " ".join(told.split()) if told else ""
    return html.unescape(plain) if "&" in plain else plain


def _said(nodes: Iterable[ET.Element]) -> str:
    """Text of the first of nodes that has any."""
    return next((t for n in nodes if (t := _text(n))), "")


def _first(node: ET.Element | None, *names: str) -> str:
    """Text of the first child of each name in turn that has any."""
    return next((t for name in names for c in _children(node, name) if (t := _text(c))), "")


def _roots(document: str, item: str) -> list[ET.Element]:
    root = ET.fromstring(document)
    if "xmlns" in document or "xml:" in document:  # else all names are local
        _local(root)
    return [root] if root.tag == item else _all(root, item)


def _date(node: ET.Element | None) -> str:
    parts = [_first(node, n) for n in ("Year", "Month", "Day")]
    return "-".join(p for p in parts if p) or _first(node, "MedlineDate")


def _authors(body: ET.Element | None) -> list[dict]:
    authors: list[dict] = []
    for i, a in enumerate(n for people in _children(body, "AuthorList") for n in people.findall("Author")):
        own = _by_tag(a)
        if "CollectiveName" in own:
            continue
        ids = [(n.get("Source", "").lower(), _text(n)) for name in ("Identifier", "AuthorIdentifier") for n in own.get(name, ())]
        ids.sort(key=lambda x: x[0] not in ("", "orcid"))
        blocks = [_text(n) for info in own.get("AffiliationInfo", ()) for n in info.findall("Affiliation")] + [_text(n) for n in own.get("Affiliation", ())]
        authors.append({
            "author_ord": len(authors) + 1, "position": i + 1, "last_name": _said(own.get("LastName", ())), "fore_name": _said(own.get("ForeName", ())),
            "initials": _said(own.get("Initials", ())), "blocks": [b for b in blocks if b], "orcid": next((t for _, t in ids if re.search(r"(?:\d{4}-?){3}\d{3}[\dXx]", t)), ""),
        })
    return authors


def _print_date(article: ET.Element) -> str:
    dates = _all(article, "JournalIssue", "PubDate") + [n for n in _all(article, "History", "PubMedPubDate") if n.get("PubStatus") == "pubmed"]
    return next((d for n in dates if (d := _date(n))), "")


def _doi(article: ET.Element, body: ET.Element | None) -> str | None:
    dois = [_text(n) for n in _all(article, "PubmedData", "ArticleIdList", "ArticleId") if n.get("IdType") == "doi"] + [_text(n) for n in _children(body, "ELocationID") if n.get("EIdType") == "doi"]
    return next((d for d in dois if d), None)


def _linked(article: ET.Element, kind: str) -> list[str]:
    links = _all(article, "CommentsCorrectionsList", "CommentsCorrections")
    return sorted({t for n in links if n.get("RefType", "").lower() == kind and (t := _first(n, "PMID"))})


#: How each column is taken from an article and its body.
TAKEN: dict[str, Callable[[ET.Element, ET.Element | None], object]] = {
    "title": lambda article, body: _text(next(iter(_children(body, "ArticleTitle")), None)),
    "journal": lambda article, body: _first(next(iter(_children(body, "Journal")), None), "ISOAbbreviation", "Title") or "(unknown journal)",
    "print_date": lambda article, body: _print_date(article),
    "doi": _doi,
    "publication_types": lambda article, body: [t for n in _all(article, "PublicationTypeList", "PublicationType") if (t := _text(n))],
    "update_in": lambda article, body: _linked(article, "updatein"),
    "update_of": lambda article, body: _linked(article, "updateof"),
    "article_blocks": lambda article, body: [t for n in _children(body, "Affiliation") if (t := _text(n))],
    "authors": lambda article, body: _authors(body),
}


def pubmed_articles(document: str, only: Iterable[str] = tuple(TAKEN)) -> Iterator[dict]:
    """pmid and the columns of only."""
    for article in _roots(document, "PubmedArticle"):
        pmid = next((t for n in _all(article, "MedlineCitation", "PMID") if (t := _text(n))), "")
        if pmid:
            body = next(iter(_all(article, "Article")), None)
            yield {"pmid": pmid} | {c: TAKEN[c](article, body) for c in only}


def _split(value: str | None) -> list[str]:
    return PIECES.findall(value) if value else []


def _label(value: str) -> str:
    return re.sub("[^A-Za-z0-9]+", "", value).lower()


def pmc_articles(document: str) -> Iterator[dict]:
    for article in _roots(document, "article"):
        meta = next(iter(_all(article, "article-meta")), article)
        ids = {n.get("pub-id-type", ""): _text(n) for n in reversed(_all(meta, "article-id"))}
        by_id: dict[str, str] = {}
        by_label: dict[str, str] = {}
        for aff in _all(meta, "aff"):
            value, mark = _text(aff, ("label", "sup")), next((t for n in _all(aff, "label") + _all(aff, "sup") if (t := _label(_text(n)))), "")
            for table, key in ((by_id, aff.get("id")), (by_label, mark)):
                if key and value:
                    table.setdefault(key, value)
        notes = {key: t for name in ("fn", "corresp") for n in _all(article, name) if (key := n.get("id")) and (t := _text(n))}
        people = [n for n in _all(meta, "contrib") if n.get("contrib-type", "author") == "author"] or [n for n in _all(article, "contrib") if n.get("contrib-type") == "author"]
        rows = []
        for i, c in enumerate(people):
            own = _below(c)
            name = next(iter(own.get("name", ())), None)
            last = _first(name, "surname") or _said([*own.get("collab", ()), *own.get("string-name", ())])
            xrefs, known = own.get("xref", []), own.get("contrib-id", [])
            refs = [(n.get("ref-type", ""), r) for n in xrefs for r in _split(n.get("rid"))]
            ids_ = [_text(n) for n in known if n.get("contrib-id-type", "orcid") == "orcid"] + [v for n in (*known, c) for k, v in n.items() if k.rpartition("}")[2] == "href"]
            rows.append({
                "author_ord": i + 1, "position": i + 1, "last_name": last, "fore_name": _first(name, "given-names"), "orcid": next((t for t in ids_ if t), ""),
                "inline": [t for n in own.get("aff", ()) if (t := _text(n, ("label", "sup")))], "rids": [r for k, r in refs if k not in ("fn", "corresp")],
                "labels": [label for n in xrefs + (_children(c, "sup") if "sup" in own else []) for t in _split(_text(n)) if (label := _label(t))],
                "note_rids": [r for k, r in refs if k in ("fn", "corresp") or r in notes], "has_xref": bool(refs),
            })
        pmcid = next((v for k in ("pmc", "pmcid", "pmcaid") if (v := ids.get(k))), "")
        yield {"pmcid": f"PMC{pmcid}" if pmcid.isdigit() else pmcid, "doi": ids.get("doi"), "contributors": rows, "affs_by_id": list(by_id.items()), "affs_by_label": list(by_label.items()), "notes": list(notes.items())}


def batches(documents: Iterator[str | None], parse: Callable[[str], Iterator[dict]], wanted: pa.Schema, errors: bool = False) -> Iterator[pa.RecordBatch]:
    """What documents hold, many documents to a batch, as each batch costs about as much as a document."""
    rows: list[dict] = []
    size = 0
    for document in documents:
        try:
            rows += list(parse(document or ""))
        except ET.ParseError as e:
            rows += [{"error": str(e)}] if errors else []
        size += len(document or "")
        if size >= MOST_PARSED and rows:
            yield pa.RecordBatch.from_pylist(rows, schema=wanted)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=wanted)


def _parsed(documents: DataFrame, parse: Callable[[str], Iterator[dict]], schema: str, errors: bool, only: Iterable[str] | None = None) -> DataFrame:
    ship(documents.sparkSession)
    every = T._parse_datatype_string(f"{schema}, error string" if errors else schema)
    fields = T.StructType([f for f in every.fields if only is None or f.name in (*only, "pmid", "error")])

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        yield from batches((d for batch in found for d in batch.column(0).to_pylist()), parse, to_arrow_schema(fields), errors)

    return documents.select("document").mapInArrow(run, fields)


def unparsable(documents: DataFrame) -> DataFrame:
    """document and error of the documents that are no XML, from which the parsers take nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for document in batch.column(0).to_pylist():
                try:
                    ET.fromstring(document or "")
                except ET.ParseError as e:
                    rows.append((document, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], ["document", "error"])

    return documents.select("document").mapInArrow(run, "document string, error string")


def split_articles(answers: DataFrame) -> DataFrame:
    """pmcid, document and error of answers (ids, document, error): each article of a document as one of its own, with the identifier it answers.

    ids are numbers joined by commas. An article without an identifier takes the one at its place where there are as many articles as ids,
    else it is left out. An answer that cannot be read, or has an error, gives a row with the error for each of its ids.
    """
    ship(answers.sparkSession)

    def articles(ids: list[str], document: str | None, error: str | None) -> Iterator[tuple[str | None, ...]]:
        try:
            root = ET.fromstring(document or "<none/>")
        except ET.ParseError as e:
            error = error or f"ParseError: {e}"
        if error:
            yield from ((i, None, error) for i in ids)
            return
        found = [root] if _name(root) == "article" else [n for n in root.iter() if _name(n) == "article"]
        for k, article in enumerate(found):
            own = next((t for n in article.iter() if _name(n) == "article-id" and n.get("pub-id-type", "").strip().lower() in ("pmc", "pmcid") and (t := _pmcid(_text(n)))), "")
            if pmcid := own or (ids[k] if len(found) == len(ids) else ""):
                yield pmcid, ET.tostring(article, encoding="unicode"), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, document, error in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                rows = list(articles([_pmcid(i) for i in (ids or "").split(",")], document, error))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], ["pmcid", "document", "error"])

    return answers.select("ids", "document", "error").mapInArrow(run, "pmcid string, document string, error string")


def _pmcid(value: str) -> str:
    raw = re.sub("[^A-Za-z0-9]+", "", value).upper()
    return f"PMC{raw}" if raw.isdigit() else raw


def pubmed(documents: DataFrame, errors: bool = False, only: tuple[str, ...] = tuple(TAKEN)) -> DataFrame:
    """Citations of PubMed article sets (document): dates parsed, types distinct without regard to case, DOI without prefix.

    Beside pmid only the columns of only are taken from the documents (print_year with print_date): the parser cannot see which ones a query reads.
    """
    found = _parsed(documents, partial(pubmed_articles, only=only), PUBMED, errors, only)
    low = F.transform("publication_types", lambda t: F.lower(t))
    types = F.filter("publication_types", lambda t, i: F.array_position(low, F.lower(t)) == i + 1)
    new = {"publication_types": ("publication_types", types), "print_year": ("print_date", text.year(F.col("print_date"))), "doi": ("doi", F.nullif(text.parsed_doi(F.col("doi")), F.lit("")))}
    return found.withColumns({c: made for c, (source, made) in new.items() if source in only})


def pubmed_authors(citations: DataFrame) -> DataFrame:
    """One row per author, with blocks; collective authors are gone but keep their place in position."""
    each = citations.select("pmid", F.explode("authors").alias("a")).select("pmid", "a.*")
    return each.withColumns({"orcid": text.orcid(F.col("orcid")), "affiliation": F.array_join("blocks", "; ")})


def pmc(documents: DataFrame, errors: bool = False) -> DataFrame:
    return _parsed(documents, pmc_articles, PMC, errors).withColumn("doi", F.nullif(text.parsed_doi(F.col("doi")), F.lit("")))


def _says(note: Column, phrases: tuple[str, ...]) -> Column:
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    return F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(plain(note), plain(p)))


def affiliation_note(note: Column) -> Column:
    """Whether a note is an affiliation: it has a hint word and speaks of no roles."""
    return F.exists(F.array(*map(F.lit, HINTS)), lambda h: F.contains(F.lower(note), h)) & ~_says(note, EQUAL) & ~_says(note, SENIOR)


def pmc_contributors(articles: DataFrame) -> DataFrame:
    """One row per contributor with blocks: its own affiliations and those its references name; labels only where no reference is known; notes that are affiliations only where nothing else is."""
    c = articles.select("pmcid", "affs_by_id", "affs_by_label", "notes", F.explode("contributors").alias("c"))
    blocks = contributor_blocks(F.col("c"))
    return c.select("pmcid", "c.author_ord", "c.position", "c.last_name", "c.fore_name", text.initials(F.col("c.fore_name"), upper=True).alias("initials"), text.orcid(F.col("c.orcid")).alias("orcid"), blocks.alias("blocks"), F.array_join(blocks, "; ").alias("affiliation"))


def contributor_blocks(c: Column) -> Column:
    """The blocks of a contributor, in a row with its article's tables."""
    look = lambda table, keys: F.filter(F.transform(keys, lambda k: F.try_element_at(F.col(table), k)), lambda v: v.isNotNull())
    ids = look("affs_by_id", c["rids"])
    own = F.concat(c["inline"], ids)
    labels = F.when(F.size(ids) == 0, look("affs_by_label", c["labels"])).otherwise(F.array().cast("array<string>"))
    direct = F.array_distinct(F.concat(own, labels))
    by_note = F.filter(look("notes", c["note_rids"]), affiliation_note)
    return F.when(F.size(direct) > 0, direct).otherwise(F.array_distinct(by_note))


def pmc_notes(articles: DataFrame) -> DataFrame:
    """pmid (the article's pmcid), note_id, note and author_ord: what role inference needs."""
    c = articles.select("pmcid", "notes", F.explode("contributors").alias("c"))
    refs = c.select(F.col("pmcid").alias("pmid"), F.explode(F.array_distinct("c.note_rids")).alias("note_id"), F.col("c.author_ord").alias("author_ord"), "notes")
    return refs.select("pmid", "note_id", F.try_element_at("notes", F.col("note_id")).alias("note"), "author_ord").where("note IS NOT NULL")


def split_batch(articles: DataFrame, requested: DataFrame) -> DataFrame:
    """Articles of a batch with the pmcid they answer (asked).

    An article's own id counts; where all requested (pmcid, ord) got an answer (ord), an article without one takes the id at its place.
    """
    n = lambda df: df.agg(F.count("*").alias("n"))
    same = n(articles).select(F.col("n").alias("a")).join(n(requested), F.col("a") == F.col("n")).select("n")
    placed = requested.select(F.col("ord").alias("r_ord"), F.col("pmcid").alias("r_pmcid")).join(F.broadcast(same), F.lit(True))  # one row or none
    joined = articles.join(placed, F.col("ord") == F.col("r_ord"), "left")
    return joined.withColumn("asked", F.when(F.col("pmcid") != "", F.col("pmcid")).otherwise(F.col("r_pmcid"))).where("asked IS NOT NULL").drop("r_ord", "r_pmcid", "n")
