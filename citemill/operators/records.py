"""Joining two records of the same citation, affiliations, and author roles from notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

#: Phrases in notes (fixed values).
EQUAL = (
    "contributed equally", "equal contribution", "equal contributions", "equally contributed", "contributed in equal measure", "co-first", "co first",
)
SENIOR = (
    "co-senior", "co senior", "co-senior authorship", "co senior authorship", "co-last", "co last", "co-last authorship", "co last authorship",
    "share senior authorship", "shared senior authorship", "jointly supervised", "joint supervision", "jointly led", "jointly directed",
    "senior author", "supervised the work",
)


def shared_affiliation(authors: DataFrame, article: DataFrame | None = None) -> DataFrame:
    """Authors with blocks filled: where all blocks of a citation (authors' and, in article, its own) are one distinct value, it goes to authors without any."""
    own = authors.select("pmid", F.explode("blocks").alias("block"))
    if article is not None:
        own = own.union(article.select("pmid", F.explode("blocks")))
    one = own.groupBy(F.col("pmid").alias("o_pmid")).agg(F.min("block").alias("lo"), F.max("block").alias("hi")).where("lo = hi")
    filled = F.when((F.size("blocks") == 0) & F.col("lo").isNotNull(), F.array("lo")).otherwise(F.col("blocks"))
    return authors.join(one, F.col("pmid") == F.col("o_pmid"), "left").withColumn("blocks", filled).drop("o_pmid", "lo", "hi")


def short_name(p: dict[str, Column]) -> Column:
    """A person's initials, from the fore name where none are given."""
    return F.coalesce(F.nullif(text.token(p["initials"]), F.lit("")), text.initials(p["fore_name"]), F.lit(""))


def same_person(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Surnames and first initials do not conflict where both have them."""
    first = lambda p: F.left(short_name(p), F.lit(1))
    last = lambda p: text.token(F.coalesce(p["last_name"], F.lit("")))
    agree = lambda x, y: (x == y) | (x == "") | (y == "")
    return agree(last(a), last(b)) & agree(first(a), first(b))


def backfill(main: DataFrame, other: DataFrame) -> DataFrame:
    """main with affiliation and orcid from other (same pmid and position, same person) where main has none, and whether it did."""
    names = ("last_name", "fore_name", "initials", "affiliation", "orcid")
    side = other.select(F.col("pmid").alias("o_pmid"), F.col("position").alias("o_position"), *[F.col(c).alias(f"o_{c}") for c in names])
    joined = main.join(side, (F.col("pmid") == F.col("o_pmid")) & (F.col("position") == F.col("o_position")), "left")
    match = F.col("o_pmid").isNotNull() & same_person({c: F.col(c) for c in names}, {c: F.col(f"o_{c}") for c in names})
    fill = lambda c: F.when((F.col(c) == "") & match, F.coalesce(f"o_{c}", F.lit(""))).otherwise(F.col(c))
    filled = (F.col("affiliation") == "") & match & (F.coalesce("o_affiliation", F.lit("")) != "")
    new = {c: fill(c).alias(c) for c in ("affiliation", "orcid")}
    return joined.select(*[new.get(c, F.col(c)) for c in main.columns], filled.alias("filled"))


def prefers_other(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Whether a took a given name into the surname, and b's names are the better ones: the initials agree, b's surname is shorter and ends a's, and b's fore name begins with a's."""
    key = {f"{side}{c}": text.token(F.coalesce(cols[c], F.lit(""))) for side, cols in (("a_", a), ("b_", b)) for c in ("last_name", "fore_name")}
    words = lambda c: F.size(F.filter(F.split(F.coalesce(c, F.lit("")), "[^A-Za-z0-9]+"), lambda w: w != ""))
    # What is cheap and mostly false stands first: equal surnames have equally many words.
    return (
        ~a["last_name"].eqNullSafe(b["last_name"]) & (words(a["last_name"]) > words(b["last_name"]))
        & (short_name(a) == short_name(b)) & (short_name(a) != "") & (key["b_last_name"] != "") & key["a_last_name"].endswith(key["b_last_name"])
        & (key["a_fore_name"] != "") & (key["b_fore_name"] != "") & key["b_fore_name"].startswith(key["a_fore_name"])
    )


def reconcile_names(main: DataFrame, other: DataFrame) -> DataFrame:
    """main with last_name and fore_name from other (same pmid and position) where prefers_other says so, and reconciled."""
    names = ("last_name", "fore_name", "initials")
    side = other.select(F.col("pmid").alias("o_pmid"), F.col("position").alias("o_position"), *[F.col(c).alias(f"o_{c}") for c in names])
    joined = main.join(side, (F.col("pmid") == F.col("o_pmid")) & (F.col("position") == F.col("o_position")), "left")
    a, b = {c: F.col(c) for c in names}, {c: F.col(f"o_{c}") for c in names}
    better = F.col("o_pmid").isNotNull() & prefers_other(a, b)
    new = {c: F.when(better, b[c]).otherwise(a[c]).alias(c) for c in ("last_name", "fore_name")}
    return joined.select(*[new.get(c, F.col(c)) for c in main.columns], better.alias("reconciled"))


def roles(notes: Column, author_count: Column) -> Column:
    """For each of notes (note, at: the places it is attached to, in order) the places f that it makes co-first and s that it makes co-senior; see role_positions."""
    says = lambda note, phrases: F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(note, p))
    # Step by step, as each use of a value inside a lambda computes it again.
    plain = F.transform(notes, lambda x: F.struct(text.squash(x["note"]).alias("note"), x["at"].alias("at")))
    said = F.transform(plain, lambda x: F.struct(x["at"].alias("at"), says(x["note"], SENIOR).alias("senior"), says(x["note"], EQUAL).alias("equal")))

    def places(x: Column) -> Column:
        at, senior = x["at"], x["senior"]
        n, low, high = F.size(at), F.array_min(at), F.array_max(at)
        prefix, suffix = (low == 1) & (high == n), (high == author_count) & (high - low + 1 == n)
        equal, none = x["equal"] & ~senior, F.array().cast("array<int>")
        return F.struct(F.when(equal & prefix & ~suffix, at).otherwise(none).alias("f"), F.when(senior | (equal & suffix & ~prefix), at).otherwise(none).alias("s"))

    return F.transform(said, places)


def role_positions(notes: DataFrame, authors: DataFrame) -> DataFrame:
    """pmid, co_first, co_senior: author places whose notes say so.

    notes: pmid, note_id, note, and the author_ord (from 1) it is attached to; authors: pmid, author_count.
    A note with a senior phrase makes its authors co-senior. Otherwise, with a phrase of equal
    contribution, authors that are the first ones of the list are co-first, the last ones co-senior;
    all of them, or others, are neither.
    """
    per = notes.groupBy("pmid", "note_id", "note").agg(F.array_sort(F.collect_set("author_ord")).alias("at")).join(authors.select("pmid", "author_count"), "pmid")
    marked = per.withColumn("r", roles(F.array(F.struct("note", "at")), F.col("author_count"))[0]).select("pmid", "r.f", "r.s")
    gathered = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    return marked.groupBy("pmid").agg(gathered("f").alias("co_first"), gathered("s").alias("co_senior"))


def assemble(cites: DataFrame, ids: DataFrame, loaded: DataFrame) -> DataFrame:
    """Citations (pmid) with pmcid from ids (pmid, pmcid, ord; the last one counts) and the source of their roles: pmc where loaded (pmcid) has the full record."""
    last = ids.groupBy(F.col("pmid").alias("i_pmid")).agg(F.max_by("pmcid", "ord").alias("pmcid"))
    joined = cites.join(last, F.col("pmid") == F.col("i_pmid"), "left").drop("i_pmid")
    have = loaded.select(F.col("pmcid").alias("h_pmcid")).distinct()
    known = joined.join(have, F.col("pmcid") == F.col("h_pmcid"), "left")
    note = F.when(F.col("pmcid").isNull(), "PMCID not found").when(F.col("h_pmcid").isNull(), "PMC fetch/parse failed").otherwise("Author metadata sourced from PMC")
    return known.select(*cites.columns, "pmcid", F.when(F.col("h_pmcid").isNull(), "pubmed").otherwise("pmc").alias("source_for_roles"), F.array(note).alias("notes"))


def extra_ids(found: DataFrame, own: DataFrame, fetched: DataFrame) -> DataFrame:
    """pmids of found that are neither the user's nor fetched, in numeric order."""
    return found.select("pmid").distinct().join(own.select("pmid"), "pmid", "left_anti").join(fetched.select("pmid"), "pmid", "left_anti").orderBy(F.col("pmid").try_cast("decimal(38,0)"))


def source_tags(cites: DataFrame, own: DataFrame, found: DataFrame) -> DataFrame:
    """cites with tags, in display order: user, litsense."""
    u, l = own.select(F.col("pmid").alias("u_pmid")).distinct(), found.select(F.col("pmid").alias("l_pmid")).distinct()
    joined = cites.join(u, F.col("pmid") == F.col("u_pmid"), "left").join(l, F.col("pmid") == F.col("l_pmid"), "left")
    tags = F.array_compact(F.array(F.when(F.col("u_pmid").isNotNull(), "user"), F.when(F.col("l_pmid").isNotNull(), "litsense")))
    return joined.select(*cites.columns, tags.alias("tags"))
