"""Requests: validation, search queries, file names. One request is one row, so this is plain driver code."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text
from .names import Target, parse_target

MOST_PMIDS, MOST_BYTES = 500, 65_536


def _target(name: str) -> Target | None:
    try:
        return parse_target(name)
    except ValueError:
        return None


def seed_query(pmid: str, name: str) -> str:
    """'seed Surname I', or the seed and the name as given where that is no target."""
    t = _target(name)
    who = f"{t.surname[:1].upper()}{t.surname[1:]} {t.initials[:1].upper()}" if t and t.surname and t.initials else name.strip()
    return " ".join(p for p in (pmid.strip(), who) if p) if pmid.strip() else ""


def profile_queries(name: str) -> list[str]:
    """Profile searches from the narrowest to the name as given; at most seven, distinct without regard to case."""
    raw, t = " ".join(name.split()), _target(name)
    found = []
    if t and t.surname:
        given = t.given.partition(" ")[0]
        found += [f'given-and-family-names:"{given} {t.surname}"', f"family-name:{t.surname} AND given-names:{given}*"] * bool(given)
        found += [f"family-name:{t.surname} AND given-names:{t.initials[0]}*"] * bool(t.initials) + [f"family-name:{t.surname}"]
    if phrase := raw.replace('"', ""):
        found += [f'given-and-family-names:"{phrase}"', f'credit-name:"{phrase}"', raw]
    first: dict[str, str] = {}
    for query in found:
        first.setdefault(query.lower(), query)
    return list(first.values())


def file_name(name: str, start: int | None, end: int | None) -> str:
    """Report file: surname and initials, else the name, else 'author'; then the years."""
    t = _target(name)
    who = f"{t.surname}{t.initials}" if t else re.sub("[^a-z0-9]+", "", name.lower())
    window = "all_years" if start is None or end is None else f"{start}_{end}"
    return f"{who or 'author'}_publications_{window}"


def problems(name: str, pmids: list[str], start: int | None, end: int | None) -> list[str]:
    """What is wrong with a request; empty if it can run."""
    checks = (
        (not pmids, "no PMIDs given"),
        (len(pmids) > MOST_PMIDS, f"more than {MOST_PMIDS} PMIDs"),
        (start is not None and end is not None and start > end, "start year is after end year"),
        (_target(name) is None, "author name must include at least given name and surname"),
    )
    return [said for wrong, said in checks if wrong]


def uploaded_pmids(spark: SparkSession, path: str) -> DataFrame:
    """ord, pmid of the files at path; a file over the size limit is an error."""
    files = spark.read.format("binaryFile").load(path)
    within = F.when(F.col("length") > MOST_BYTES, F.raise_error(F.lit("upload is too large")).cast("binary")).otherwise(F.col("content"))
    decoded = F.make_valid_utf8(within.cast("string"))
    return files.select(F.posexplode(text.pmids_in(decoded)).alias("ord", "pmid"))


def author_list(authors: Column, highlighted: Column | None = None) -> Column:
    """'Last I' of an array of author structs (position, last_name, initials), joined by commas; HTML with the highlighted positions strong, if given."""

    def one(a: Column) -> Column:
        name = F.trim(F.concat_ws(" ", a["last_name"], a["initials"]))
        if highlighted is None:
            return name
        for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
            name = F.replace(name, F.lit(mark), F.lit(entity))
        return F.when(F.array_contains(highlighted, a["position"]), F.concat(F.lit("<strong>"), name, F.lit("</strong>"))).otherwise(name)

    return F.array_join(F.transform(authors, one), ", ")
