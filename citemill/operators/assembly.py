"""Whole citations from two records of each: the citation index and, where there is one, the full text.

Both author lists are arrays in the citation's row. They are compared there, author by author at equal positions, so
choosing between them costs no shuffle beyond the two joins that bring the full text to the citation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..sources import xml_records
from . import records

AUTHOR = "struct<position:int,last_name:string,fore_name:string,initials:string,blocks:array<string>,orcid:string>"
AUTHORS = f"array<{AUTHOR}>"
NAMES = ("last_name", "fore_name", "initials")


def pinned(df: DataFrame) -> DataFrame:
    """df with its columns computed once per row: what stands above is not merged into it, and so not evaluated again for each use inside a lambda."""
    return df.select(F.explode(F.array(F.struct("*"))).alias("pinned")).select("pinned.*")


def author_list(rows: DataFrame, key: str, listed: Column | None = None) -> DataFrame:
    """key and authors, in order of position, of one row per author (key, position, names, blocks, orcid); of those that are listed, where given, which may be none."""
    each = F.struct(F.col("position").cast("int").alias("position"), *[F.coalesce(c, F.lit("")).alias(c) for c in NAMES], F.coalesce("blocks", F.array().cast("array<string>")).alias("blocks"), F.coalesce("orcid", F.lit("")).alias("orcid"))
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(each if listed is None else F.when(listed, each))).alias("authors"))


def _by_position(authors: Column) -> Column:
    """authors as an array whose element k has position k + 1, null where nobody has it; positions are distinct."""
    nobody = F.lit(None).cast(AUTHOR)

    def padded(in_order: Column) -> Column:
        before = lambda i: F.coalesce(F.get(in_order, i - 1)["position"], F.lit(0))
        return F.flatten(F.transform(in_order, lambda a, i: F.concat(F.array_repeat(nobody, a["position"] - before(i) - 1), F.array(a))))

    return F.get(F.transform(F.array(F.array_sort(authors)), padded), 0)  # sorted once, not once an author


def _blocks(author: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.coalesce(author["blocks"], F.array().cast("array<string>")), lambda b: F.trim(b)), lambda b: b != ""))


def _met(authors: Column, others: Column) -> Column:
    """Pairs a, o of authors and who stands at their positions in others (_by_position), with tidy blocks.

    Inside lambdas each use of a value computes it again, so what follows goes on from pair to pair: a step's values are computed once.
    """

    def pair(a: Column) -> Column:
        return F.struct(a.alias("a"), F.get(others, a["position"] - 1).alias("o"))

    return F.transform(F.transform(authors, pair), lambda p: F.struct(p["a"].alias("a"), p["o"].alias("o"), _blocks(p["a"]).alias("blocks"), _blocks(p["o"]).alias("o_blocks")))


def _filled(pairs: Column, fill: Callable[[Column], Column]) -> Column:
    """The authors of pairs, with the other's blocks where they have none, the other has some and fill says so, and whether that was done."""
    able = lambda p: p["o"].isNotNull() & (F.size(p["blocks"]) == 0) & (F.size(p["o_blocks"]) > 0)
    judged = F.transform(pairs, lambda p: F.struct(p["a"].alias("a"), p["blocks"].alias("blocks"), p["o_blocks"].alias("o_blocks"), F.coalesce(able(p) & fill(p), F.lit(False)).alias("filled")))
    return F.transform(judged, lambda p: F.struct(*[p["a"][c].alias(c) for c in ("position", *NAMES)], F.when(p["filled"], p["o_blocks"]).otherwise(p["blocks"]).alias("blocks"), p["a"]["orcid"].alias("orcid"), p["filled"].alias("filled")))


def _from_full_text(authors: Column, index: Column) -> Column:
    """The full text's authors: with the index's names where the full text took a given name into the surname, and the index's affiliation where it has none and the two do not conflict."""
    names = lambda x: {c: x[c] for c in NAMES}
    judged = F.transform(_met(authors, index), lambda p: F.struct(p.alias("p"), (p["o"].isNotNull() & records.prefers_other(names(p["a"]), names(p["o"]))).alias("better")))

    def named(j: Column) -> Column:
        a, o, better = j["p"]["a"], j["p"]["o"], j["better"]
        taken = {c: F.when(better, o[c]).otherwise(a[c]) for c in ("last_name", "fore_name")}
        taken["initials"] = F.when(better & (o["initials"] != ""), o["initials"]).otherwise(a["initials"])
        taken["orcid"] = F.when(better & (a["orcid"] == ""), o["orcid"]).otherwise(a["orcid"])
        return F.struct(F.struct(a["position"].alias("position"), *[v.alias(c) for c, v in taken.items()]).alias("a"), *[j["p"][c].alias(c) for c in ("o", "blocks", "o_blocks")])

    return _filled(F.transform(judged, named), lambda p: records.same_person(names(p["a"]), names(p["o"])))


def _from_index(authors: Column, full: Column) -> Column:
    """The index's authors, with the affiliation that the full text has at their position where they have none."""
    return _filled(_met(authors, full), lambda p: F.lit(True))


def citations(cites: DataFrame, ids: DataFrame, articles: DataFrame, failures: DataFrame | None = None, unmapped: DataFrame | None = None) -> DataFrame:
    """cites (pmid, doi, authors, and others) put together with their full texts.

    ids: pmid, pmcid, ord (the last one counts); articles: pmcid, doi, authors, co_first, co_senior; failures: pmcid, error of full
    texts that could not be had or read; unmapped: pmid, error of citations whose mapping request failed. Of several articles of one
    pmcid one is taken, whatever their order. Authors are of type AUTHORS, at distinct positions from 1; null counts as no authors.

    Comes out: the columns of cites, with doi from the full text where it was missing or empty, authors, and pmcid, author_count,
    co_first, co_senior, source_for_roles (pmc where the full text was read) and notes, which say in this order what was done:
    the mapping failed; there is no full text (nothing else then); the author counts differ; the full text's authors were taken,
    which they are if one of them has a surname, and so many affiliations filled from the index; or else so many filled from
    the full text, its author metadata being incomplete; the full text failed; neither record has a DOI.
    """
    nothing = F.array().cast("array<int>")
    last = ids.groupBy(F.col("pmid").alias("i_pmid")).agg(F.max_by("pmcid", "ord").alias("pmcid"))
    mapped = cites.join(last, F.col("pmid") == F.col("i_pmid"), "left").drop("i_pmid")
    if unmapped is not None:
        failed = unmapped.groupBy(F.col("pmid").alias("u_pmid")).agg(F.min("error").alias("map_error"))
        mapped = mapped.join(failed, F.col("pmid") == F.col("u_pmid"), "left").drop("u_pmid").withColumn("pmcid", F.when(F.col("map_error").isNull(), F.col("pmcid")))
    else:
        mapped = mapped.withColumn("map_error", F.lit(None).cast("string"))
    # Full texts and failures meet the citations in one join; citations without a full text keep to themselves and do not pile up on null.
    # Texts parsed from small rows look small to the planner, which would broadcast them.
    read = articles.select("pmcid", F.struct("doi", F.coalesce("authors", F.array().cast(AUTHORS)).alias("authors"), F.coalesce("co_first", nothing).alias("co_first"), F.coalesce("co_senior", nothing).alias("co_senior")).alias("read"), F.lit(None).cast("string").alias("error"))
    if failures is not None:
        read = read.unionByName(failures.select("pmcid", "error"), allowMissingColumns=True)
    texts = read.groupBy(F.col("pmcid").alias("t_pmcid")).agg(F.max("read").alias("read"), F.min("error").alias("error"))
    met = mapped.withColumn("key", F.coalesce("pmcid", F.concat(F.lit("-"), "pmid"))).join(texts.hint("merge"), F.col("key") == F.col("t_pmcid"), "left").drop("key", "t_pmcid")

    own = F.coalesce("authors", F.array().cast(AUTHORS))
    placed = pinned(met.withColumns({"own": own, "own_at": _by_position(own), "text_at": _by_position(F.coalesce("read.authors", F.array().cast(AUTHORS)))}))
    named = F.exists("read.authors", lambda a: F.trim(a["last_name"]) != "")
    plain = F.transform("own", lambda a: F.struct(*[a[c].alias(c) for c in ("position", *NAMES, "blocks", "orcid")], F.lit(False).alias("filled")))
    replaced, kept = _from_full_text(F.col("read.authors"), F.col("own_at")), _from_index(F.col("own"), F.col("text_at"))
    chosen = pinned(placed.withColumns({"named": F.coalesce(named, F.lit(False)), "chosen": F.when(F.col("read").isNull(), plain).when(named, replaced).otherwise(kept)}))

    have = F.col("read").isNotNull()
    n, listed = F.size(F.filter("chosen", lambda a: a["filled"])), F.size("read.authors")
    doi = F.when(F.coalesce("doi", F.lit("")) == "", F.when(have, F.nullif("read.doi", F.lit("")))).otherwise(F.col("doi"))
    says = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    notes = F.array_compact(F.array(
        F.when(F.col("map_error").isNotNull(), says("PMCID mapping failed: ", F.col("map_error"))),
        F.when(F.col("pmcid").isNull(), F.lit("No PMCID mapping")),
        F.when(have & (listed > 0) & (listed != F.size("own")), says("PMC author count mismatch (PMC ", listed, " vs PubMed ", F.size("own"), ")")),
        F.when(have & F.col("named"), F.lit("Author metadata sourced from PMC")),
        F.when(have & (n > 0), says("Filled ", n, F.when(F.col("named"), " affiliation(s) from PubMed fallback").otherwise(" affiliation(s) from PMC"))),
        F.when(have & ~F.col("named"), F.lit("PMC author metadata incomplete; kept PubMed author list")),
        F.when(F.col("pmcid").isNotNull() & ~have, says("PMC fetch/parse failed: ", F.coalesce("error", says("PMC XML unavailable for ", F.col("pmcid"))))),
        F.when(F.col("pmcid").isNotNull() & (F.coalesce(doi, F.lit("")) == ""), F.lit("DOI not found in PubMed/PMC metadata")),
    ))
    final = F.transform("chosen", lambda a: F.struct(*[a[c].alias(c) for c in ("position", *NAMES, "blocks", "orcid")]))
    new = {"doi": doi, "authors": final}
    return chosen.select(
        *[new[c].alias(c) if c in new else F.col(c) for c in cites.columns], "pmcid", F.size("chosen").alias("author_count"),
        F.coalesce("read.co_first", nothing).alias("co_first"), F.coalesce("read.co_senior", nothing).alias("co_senior"),
        F.when(have, "pmc").otherwise("pubmed").alias("source_for_roles"), notes.alias("notes"),
    )


def shown(authors: Column) -> Column:
    """An author list as one text, for comparing and reading."""
    one = lambda a: F.concat_ws("|", a["position"].cast("string"), a["last_name"], a["fore_name"], a["initials"], F.array_join(a["blocks"], "; "), a["orcid"])
    return F.array_join(F.transform(authors, one), " / ")


def author_rows(assembled: DataFrame) -> DataFrame:
    """One row per author of assembled citations: pmid, author_ord, position, names, blocks, affiliation, orcid, notes and where roles come from."""
    each = assembled.select("pmid", "pmcid", "source_for_roles", "notes", F.posexplode("authors").alias("at", "a"))
    return each.select("pmid", (F.col("at") + 1).alias("author_ord"), "a.*", F.array_join("a.blocks", "; ").alias("affiliation"), "pmcid", "source_for_roles", "notes").withColumn("orcid", text.orcid(F.col("orcid")))


def full_texts(articles: DataFrame) -> DataFrame:
    """pmcid, doi, authors, co_first and co_senior of parsed full texts (xml_records.pmc): what citations takes as articles. All of it stands in the article's row, so nothing is shuffled or parsed twice."""
    who = lambda c: F.struct(c["position"].alias("position"), *[F.coalesce(v, F.lit("")).alias(k) for k, v in zip(NAMES, (c["last_name"], c["fore_name"], text.initials(c["fore_name"], upper=True)))], xml_records.contributor_blocks(c).alias("blocks"), F.coalesce(text.orcid(c["orcid"]), F.lit("")).alias("orcid"))
    referred = F.array_distinct(F.flatten(F.transform("contributors", lambda c: c["note_rids"])))
    at = lambda k: F.transform(F.filter("contributors", lambda c: F.array_contains(c["note_rids"], k)), lambda c: c["author_ord"])
    noted = F.filter(F.transform(referred, lambda k: F.struct(F.try_element_at("notes", k).alias("note"), at(k).alias("at"))), lambda x: x["note"].isNotNull())
    gathered = lambda c: F.array_sort(F.array_distinct(F.flatten(F.transform("roles", lambda r: r[c]))))
    read = articles.select("pmcid", "doi", F.transform("contributors", who).alias("authors"), records.roles(noted, F.size("contributors")).alias("roles"))
    return pinned(read).select("pmcid", "doi", "authors", gathered("f").alias("co_first"), gathered("s").alias("co_senior"))


def index_records(parsed: DataFrame) -> DataFrame:
    """Parsed citations (xml_records.pubmed) with authors as citations takes them; where all blocks of a citation are one value, authors without any get it."""
    every = F.array_distinct(F.concat(F.flatten(F.transform("authors", lambda a: a["blocks"])), F.col("article_blocks")))
    known = pinned(parsed.withColumn("every", every))
    one = lambda a: F.when((F.size(a["blocks"]) == 0) & (F.size("every") == 1), F.col("every")).otherwise(a["blocks"])
    tidy = F.transform("authors", lambda a: F.struct(a["position"].alias("position"), *[a[c].alias(c) for c in NAMES], one(a).alias("blocks"), text.orcid(a["orcid"]).alias("orcid")))
    return known.withColumn("authors", tidy).drop("every", "article_blocks")
