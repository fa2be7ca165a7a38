"""Classifying, filtering and counting citations."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import ranking

#: Publication types left out by default, in their order (fixed values).
EXCLUDED_TYPES = (
    "preprint", "editorial", "comment", "letter", "news", "newspaper article", "published erratum", "retraction of publication",
    "retracted publication", "expression of concern", "corrected and republished article", "patient education handout",
)
#: Reasons that send a citation to review (fixed values).
SEVERAL, BY_INITIALS, NO_ROLES = "multiple matching authors with same/similar name", "matched by initials fallback", "PMC missing; co-first/co-senior not detectable"


def in_window(year: Column, start: int | None, end: int | None) -> Column:
    """Closed range; true without one; false for an unknown year within one."""
    return F.lit(True) if start is None or end is None else F.coalesce(year.between(start, end), F.lit(False))


def has_type(types: Column, term: str) -> Column:
    return F.exists(types, lambda t: F.contains(text.squash(t), F.lit(term)))


def excluded_types(types: Column, terms: tuple[str, ...] = EXCLUDED_TYPES) -> Column:
    """Normalised types that contain one of the terms, distinct in order."""
    wanted = F.array(*[F.lit(t) for t in terms if t]) if any(terms) else F.array().cast("array<string>")
    return F.array_distinct(F.filter(F.transform(types, text.squash), lambda t: F.exists(wanted, lambda w: F.contains(t, w))))


def excluded_reason(cites: DataFrame, start: int | None, end: int | None, terms: tuple[str, ...]) -> DataFrame:
    """cites with excluded_reason: outside the window first, then publication types; null if eligible."""
    hit = excluded_types(F.col("publication_types"), terms)
    outside = F.concat(F.lit(f"Outside year window {start}-{end} (year: "), F.coalesce(F.col("print_year").cast("string"), F.lit("unknown")), F.lit(")"))
    typed = F.concat(F.lit("Excluded by publication type: "), F.array_join(hit, ", "))
    return cites.withColumn("excluded_reason", F.when(~in_window(F.col("print_year"), start, end), outside).when(F.size(hit) > 0, typed))


def superseded(cites: DataFrame) -> DataFrame:
    """pmid, later: preprints with the versions that replace them, by forward links, reverse links or a shared DOI; numbers first, then text.

    Columns update_in and update_of (arrays of pmids) may be absent.
    """
    empty = F.array().cast("array<string>")
    own = cites.select("pmid", has_type(F.col("publication_types"), "preprint").alias("pre"), text.match_doi(F.col("doi")).alias("doi"), *[(F.coalesce(F.col(c), empty) if c in cites.columns else empty).alias(c) for c in ("update_in", "update_of")])
    pre, rest = own.where("pre"), own.where("NOT pre")
    by_doi = pre.where("doi <> ''").select("pmid", "doi").join(rest.where("doi <> ''").select(F.col("pmid").alias("later"), "doi"), "doi").select("pmid", "later")
    reverse = rest.select(F.explode("update_of").alias("pmid"), F.col("pmid").alias("later")).join(pre.select("pmid"), "pmid", "left_semi")
    forward = pre.select("pmid", F.explode("update_in").alias("later")).join(pre.select(F.col("pmid").alias("later")), "later", "left_anti").select("pmid", "later")
    links = by_doi.union(reverse).union(forward).where("pmid <> later").distinct()
    numeric = F.col("later").rlike("^[0-9]+$")
    key = F.struct((~numeric).alias("text"), F.when(numeric, F.col("later").try_cast("decimal(38,0)")).alias("n"), F.col("later").alias("later"))
    return links.groupBy("pmid").agg(F.transform(F.array_sort(F.collect_list(key)), lambda x: x["later"]).alias("later"))


def target_key(*tables: DataFrame) -> list[str]:
    """What separates targets in tables: target_id where all have one."""
    return [c for c in ("target_id",) if all(c in t.columns for t in tables)]


def flagged(rows: DataFrame, among: DataFrame, keys: list[str], name: str) -> DataFrame:
    """rows with a boolean column name: whether their keys are among the keys of another table."""
    mark = f"_{name}_"
    there = among.select(*[F.col(k).alias(mark + k) for k in keys]).distinct()
    same = reduce(and_, [F.col(k) == F.col(mark + k) for k in keys])
    return rows.join(there, same, "left").withColumn(name, F.col(mark + keys[-1]).isNotNull()).drop(*there.columns)


def analysis_rows(cites: DataFrame, found: DataFrame, selected: DataFrame, start: int | None, end: int | None, forced: DataFrame | None = None, excluded: DataFrame | None = None) -> DataFrame:
    """A report row per citation with a selected mention (or forced in).

    cites: citations with author_count, optional co_first and co_senior; found: mentions (pmid,
    position, method, cluster_id); selected: cluster_id; forced and excluded: pmid. Where found has
    target_id, so must the other three, and each target has rows of its own, as if run alone.
    """
    by = target_key(found)
    marked = flagged(found, selected, by + ["cluster_id"], "chosen")
    chosen = F.col("chosen")
    per = marked.groupBy(*by, "pmid").agg(
        F.count("*").alias("n_all"),
        F.array_sort(F.collect_set("position")).alias("all_positions"),
        F.collect_set("method").alias("all_methods"),
        F.array_sort(F.collect_set(F.when(chosen, F.col("position")))).alias("own_positions"),
        F.collect_set(F.when(chosen, F.col("method"))).alias("own_methods"),
    )
    later = superseded(cites).select(F.col("pmid").alias("l_pmid"), "later")
    per = per.withColumn("forced", F.lit(False))
    if forced is not None:
        wanted = forced.select(*by, "pmid").distinct().withColumn("forced", F.lit(True))
        per = per.drop("forced").join(wanted, by + ["pmid"], "full")
    per = per.withColumn("out", F.lit(False)) if excluded is None else flagged(per, excluded, by + ["pmid"], "out")
    joined = cites.join(per.withColumnRenamed("pmid", "m_pmid"), F.col("pmid") == F.col("m_pmid")).join(later, F.col("pmid") == F.col("l_pmid"), "left")
    is_forced, out = F.coalesce("forced", F.lit(False)), F.col("out")
    ints, strings = F.array().cast("array<int>"), F.array().cast("array<string>")
    positions = F.coalesce(F.when(is_forced, F.col("all_positions")).otherwise(F.col("own_positions")), ints)
    methods = F.coalesce(F.when(is_forced, F.col("all_methods")).otherwise(F.col("own_methods")), strings)
    kept = joined.where(is_forced | (~out & in_window(F.col("print_year"), start, end) & (F.size(positions) > 0)))
    extra = lambda c: F.coalesce(F.col(c), ints) if c in cites.columns else ints
    sure = F.array_contains(methods, "orcid")
    reasons = F.array_compact(F.array(
        F.when((F.coalesce("n_all", F.lit(0)) > 1) & ~sure, SEVERAL),
        F.when(F.array_contains(methods, "initials") & ~sure, BY_INITIALS),
        F.when(F.col("source_for_roles") == "pubmed", NO_ROLES),
    ))
    rows = kept.select(
        *by, *cites.columns, positions.alias("positions"), reasons.alias("reasons"), is_forced.alias("forced_include"),
        F.arrays_overlap(positions, F.array_union(F.array(F.lit(1)), extra("co_first"))).alias("counted_first"),
        F.arrays_overlap(positions, F.array_union(F.array(F.col("author_count")), extra("co_senior"))).alias("counted_senior"),
        has_type(F.col("publication_types"), "review").alias("is_review"),
        has_type(F.col("publication_types"), "preprint").alias("is_preprint"),
        F.coalesce("later", strings).alias("superseded_by"),
    )
    counted = rows.select(
        "*", (~F.col("is_review") & ~F.col("is_preprint")).alias("counted_overall"),
        (F.col("is_review") & F.col("counted_senior")).alias("counted_review_senior"),
        ((F.size("reasons") == 0) & ~(F.col("is_preprint") & (F.size("superseded_by") > 0))).alias("include"),
    )
    return counted.withColumn("superseded_by", F.when(F.col("is_preprint"), F.col("superseded_by")).otherwise(strings))


def report_order(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """rows with idx, their place in the report: known years first, latest first, then journal without regard to case, then input order; by splits reports. Rows come out kept (ranking.numbered)."""
    return ranking.numbered(rows, by, [F.col("print_year").isNull(), F.desc("print_year"), F.lower("journal"), F.col("ord")])


def summary(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Totals over report rows (of each by): overall, first or senior among them, reviews as senior, preprints, superseded preprints."""
    counted = F.col("include") & F.col("counted_overall")
    count = lambda c: F.count_if(c).cast("long")
    return rows.groupBy(*by).agg(
        count(counted).alias("total"),
        count(counted & (F.col("counted_first") | F.col("counted_senior"))).alias("first_senior"),
        count(F.col("include") & F.col("counted_review_senior")).alias("review_senior"),
        count(F.col("include") & F.col("is_preprint")).alias("preprints"),
        count(F.size("superseded_by") > 0).alias("superseded_preprints"),
    )


def journal_subtotals(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """journal, publications, detail (of each by) of the counted first and senior rows; detail lists years with their counts, unknown last."""
    counted = rows.where("include AND counted_overall AND (counted_first OR counted_senior)")
    yearly = counted.groupBy(*by, "journal", "print_year").agg(F.count("*").alias("n"))
    name = F.concat(F.when(F.col("n") > 1, F.concat(F.col("n").cast("string"), F.lit("x"))).otherwise(""), F.coalesce(F.col("print_year").cast("string"), F.lit("n/a")))
    order = F.struct(F.col("print_year").isNull().alias("u"), "print_year", name.alias("t"))
    grouped = yearly.groupBy(*by, "journal").agg(F.sum("n").cast("long").alias("publications"), F.array_sort(F.collect_list(order)).alias("years"))
    return grouped.select(*by, "journal", "publications", F.array_join(F.transform("years", lambda y: y["t"]), ", ").alias("detail"))


def summary_line(totals: DataFrame, subtotals: DataFrame, window: str) -> DataFrame:
    """The report's one-line summary (report)."""
    parts = subtotals.select(F.struct((-F.col("publications")).alias("n"), F.lower("journal").alias("j"), F.concat_ws(" ", F.col("publications").cast("string"), "journal", "detail").alias("t")).alias("p"))
    detail = parts.agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["t"]), "; ").alias("detail"))
    text_ = F.concat(
        F.lit(f"Peer-reviewed Publications ({window}): "), F.col("total"), F.lit(" total, "), F.col("first_senior"), F.lit(" 1st/Sr author ("),
        F.when(F.col("detail") == "", "none").otherwise(F.col("detail")), F.lit("). In addition: "), F.col("review_senior"), F.lit(" review(s) as Sr author; "),
        F.col("preprints"), F.lit(" preprint(s)."),
        F.when(F.col("superseded_preprints") > 0, F.concat(F.lit(" Excluded as superseded by a peer-reviewed version: "), F.col("superseded_preprints"), F.lit(" preprint(s)."))).otherwise(""),
    )
    return totals.crossJoin(F.broadcast(detail)).select(text_.alias("report"))  # one row by one row
