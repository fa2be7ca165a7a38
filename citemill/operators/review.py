"""Selection tables, exclusions, and human overrides."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import analysis
from ..functions import text

#: Reasons for review (fixed values).
NO_AFFILIATION, SEVERAL, BY_INITIALS = "No affiliation listed for matched author", "Multiple matched author positions in citation", "Matched by initials fallback"
#: mode: include, overall, senior, review_senior, review, preprint (fixed values); first is always cleared.
MODES = {
    "exclude": (False, False, False, False, False, False),
    "coauthor": (True, True, False, False, False, False),
    "first_senior_author": (True, True, True, False, False, False),
    "coauthor_preprint": (True, False, False, False, False, True),
    "first_senior_preprint": (True, False, True, False, False, True),
    "coauthor_review": (True, False, False, False, True, False),
    "first_senior_review": (True, False, True, True, True, False),
}
#: Older names of modes (fixed values).
ALIASES = {"overall": "coauthor", "senior": "first_senior_author", "review": "coauthor_review", "review_senior": "first_senior_review"}


def filtered_mentions(found: DataFrame, clusters: DataFrame, pmids: DataFrame | None, excluded: DataFrame, forced: DataFrame) -> DataFrame:
    """Mentions for analysis: (cluster selected or forced) and (no pmid filter or pmid selected) and (not excluded or forced); of each target for itself where found has target_id."""
    by = analysis.target_key(found)
    joined = analysis.flagged(found, clusters, by + ["cluster_id"], "_chosen")
    for df, flag in ((excluded, "_out"), (forced, "_forced"), *([(pmids, "_wanted")] if pmids is not None else [])):
        joined = analysis.flagged(joined, df, by + ["pmid"], flag)
    keep = F.expr("(_chosen OR _forced) AND (NOT _out OR _forced)")
    return joined.where(keep if pmids is None else keep & F.col("_wanted")).select(*found.columns)


def selection_rows(cites: DataFrame, shown: DataFrame, every: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per citation with shown mentions: labels, affiliations and positions, and whether a person must look at it.

    shown and every: mentions (pmid, position, method, cluster_id, affiliation); labels: cluster_id,
    label. Where shown has target_id, so must the other two, and each target has rows of its own.
    """
    by = analysis.target_key(shown)
    alike = lambda mark: reduce(and_, [F.col(c) == F.col(mark + c) for c in by], F.lit(True))
    own = lambda mark: [F.col(c).alias(mark + c) for c in by]
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), " | ")
    named = shown.join(labels.select(*own("l_"), F.col("cluster_id").alias("l_id"), F.col("label").alias("l_label")), (F.col("cluster_id") == F.col("l_id")) & alike("l_"), "left")
    per = named.groupBy(*by, F.col("pmid").alias("s_pmid")).agg(
        joined(F.coalesce("l_label", "cluster_id")).alias("cluster_labels"),
        joined(F.when(F.trim("affiliation") != "", F.trim("affiliation"))).alias("affiliations"),
        F.array_join(F.transform(F.array_sort(F.collect_set("position")), lambda p: p.cast("string")), ",").alias("positions"),
    )
    whole = every.groupBy(*own("e_"), F.col("pmid").alias("e_pmid")).agg(F.count_distinct("position").alias("n_positions"), F.max(F.col("method") == "initials").alias("by_initials"))
    rows = cites.join(per, F.col("pmid") == F.col("s_pmid")).join(whole, (F.col("pmid") == F.col("e_pmid")) & alike("e_"), "left")
    reasons = F.concat_ws("; ", F.when(F.col("affiliations") == "", NO_AFFILIATION), F.when(F.col("n_positions") > 1, SEVERAL), F.when(F.col("by_initials"), BY_INITIALS))
    return rows.select(
        *by, "pmid", "print_year", "journal", "source_for_roles", "cluster_labels", "positions",
        F.when(F.col("affiliations") == "", "(no affiliation listed)").otherwise(F.col("affiliations")).alias("affiliations"),
        (reasons != "").alias("needs_review"), reasons.alias("review_reason"),
    )


def side_order(rows: DataFrame) -> DataFrame:
    """Order of side tables: known years first, latest first, then pmid as text."""
    return rows.orderBy(F.col("print_year").isNull(), F.desc("print_year"), "pmid")


def excluded_class(reason: Column) -> Column:
    """type, window or other, by the beginning of the reason."""
    low = F.lower(F.trim(reason))
    return F.when(low.startswith("excluded by publication type"), "type").when(low.startswith("outside year window"), "window").otherwise("other")


def missing_affiliation(affiliation: Column, pmcid: Column, source: Column, notes: Column) -> Column:
    """Why a matched author has no affiliation; '' if there is one."""
    failed = F.get(F.filter(notes, lambda n: n.startswith("PMC fetch/parse failed")), 0)
    says = lambda what: F.exists(notes, lambda n: F.contains(n, F.lit(what)))
    return (
        F.when(F.trim(affiliation) != "", "")
        .when(F.coalesce(pmcid, F.lit("")) == "", "No PMCID mapping, and PubMed author entry has no affiliation.")
        .when((source == "pubmed") & failed.isNotNull(), F.concat(failed, F.lit("; PubMed author entry has no affiliation.")))
        .when(source == "pubmed", "PMC unavailable, and PubMed author entry has no affiliation.")
        .when(says("Author metadata sourced from PMC"), "PMC author entry for this contributor does not include affiliation text.")
        .when(says("PMC author metadata incomplete"), "PMC author metadata incomplete and PubMed fallback also has no affiliation.")
        .otherwise("Affiliation missing in parsed PMC/PubMed author metadata.")
    )


def corrections(entries: DataFrame) -> DataFrame:
    """pmid and mode of entries (entry 'pmid::mode', ord); the last entry of a pmid counts."""
    parts = F.split("entry", "::", 2)
    named = entries.where(F.contains("entry", F.lit("::"))).select(F.trim(parts[0]).alias("pmid"), F.trim(parts[1]).alias("mode"), "ord").where("pmid <> ''")
    last = named.groupBy("pmid").agg(F.max_by("mode", "ord").alias("mode"))
    names = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    return last.select("pmid", F.coalesce(names[F.col("mode")], "mode").alias("mode"))


def apply_modes(rows: DataFrame, modes: DataFrame, only: Column | None = None) -> DataFrame:
    """rows with corrections (pmid, mode) applied, of one target where they name a target_id; unknown modes change nothing; only limits them to some rows."""
    by = analysis.target_key(rows, modes)
    spark = rows.sparkSession
    table = spark.createDataFrame([(k, *v) for k, v in MODES.items()], "m_mode string, m_include boolean, m_overall boolean, m_senior boolean, m_review_senior boolean, m_review boolean, m_preprint boolean")
    known = modes.join(F.broadcast(table), F.col("mode") == F.col("m_mode")).drop("mode").withColumnsRenamed({c: f"m_{c}" for c in by + ["pmid"]})
    joined = rows.join(known, reduce(and_, [F.col(c) == F.col(f"m_{c}") for c in by + ["pmid"]]), "left")
    hit = F.col("m_mode").isNotNull() & (only if only is not None else F.lit(True))
    new = {
        "include": F.col("m_include"), "counted_overall": F.col("m_overall"), "counted_first": F.lit(False), "counted_senior": F.col("m_senior"),
        "counted_review_senior": F.col("m_review_senior"), "is_review": F.col("m_review"), "is_preprint": F.col("m_preprint"),
        "superseded_by": F.array().cast("array<string>"),
    }
    return joined.select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in rows.columns])


def finalize(rows: DataFrame, accepted: DataFrame, modes: DataFrame) -> DataFrame:
    """Uncertain rows are included if their idx (of their target, where accepted has target_id) is accepted; corrections apply to accepted uncertain rows alone."""
    joined = analysis.flagged(rows, accepted, analysis.target_key(rows, accepted) + ["idx"], "_taken")
    unsure = F.size("reasons") > 0
    marked = joined.withColumn("include", F.when(unsure, F.col("_taken")).otherwise(F.col("include")))
    return apply_modes(marked, modes, unsure & F.col("_taken")).drop("_taken")


def report_correct(rows: DataFrame, accepted: DataFrame, modes: DataFrame) -> DataFrame:
    """Uncertain rows are included if their pmid (of their target, where accepted has target_id) is accepted; corrections apply to any row."""
    joined = analysis.flagged(rows, accepted, analysis.target_key(rows, accepted) + ["pmid"], "_taken")
    marked = joined.withColumn("include", F.when(F.size("reasons") > 0, F.col("_taken")).otherwise(F.col("include"))).drop("_taken")
    return apply_modes(marked, modes)


def category(rows: DataFrame) -> DataFrame:
    """rows with category (counted as), counted_mode and default_mode."""
    lead = F.col("counted_first") | F.col("counted_senior")
    senior = F.col("counted_senior") | F.col("counted_review_senior")
    pick = lambda yes, no, c: F.when(c, yes).otherwise(no)
    counted = lambda a, b: (
        F.when(F.col("is_preprint"), pick(a[0], b[0], lead)).when(F.col("is_review"), pick(a[1], b[1], senior)).otherwise(pick(a[2], b[2], lead))
    )
    mode = counted(("first_senior_preprint", "first_senior_review", "first_senior_author"), ("coauthor_preprint", "coauthor_review", "coauthor"))
    by_default = (
        F.when(~F.col("include"), "exclude")
        .when(F.col("is_preprint"), pick("first_senior_preprint", "coauthor_preprint", lead))
        .when(F.col("is_review"), pick("first_senior_review", "coauthor_review", F.col("counted_review_senior")))
        .when(lead, "first_senior_author")
        .when(F.col("counted_overall"), "coauthor")
        .otherwise("exclude")
    )
    return rows.select("*", counted(("1st/Sr preprint", "1st/Sr review", "1st/Sr author"), ("coauthor preprint", "coauthor review", "coauthor")).alias("category"), mode.alias("counted_mode"), by_default.alias("default_mode"))


def report(rows: DataFrame) -> DataFrame:
    """Rows of the final report: excluded first, then by source pubmed, then pmc; bucket orders them, idx inside."""
    bucket = F.when(~F.col("include"), 0).when(F.col("source_for_roles") == "pubmed", 1).otherwise(2)
    status = F.when(F.size("superseded_by") > 0, "superseded").when(F.col("include"), "included").otherwise("excluded")
    link = F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), F.col("pmid"), F.lit("/"))
    return category(rows).select(*analysis.target_key(rows), "pmid", "idx", bucket.alias("bucket"), status.alias("status"), link.alias("link"), "category", "counted_mode", "default_mode", F.array_join("superseded_by", ",").alias("superseded_by"), F.array_join("reasons", "; ").alias("reasons"))


def type_summary(cites: DataFrame, terms: tuple[str, ...] = analysis.EXCLUDED_TYPES) -> DataFrame:
    """pmid with the publication types that exclude it."""
    return cites.select("pmid", analysis.excluded_types(F.col("publication_types"), terms).alias("hit")).where(F.size("hit") > 0)


def selected_defaults(chosen: Column) -> Column:
    """The default type terms that are among chosen, in default order."""
    return F.array_intersect(F.array(*map(F.lit, analysis.EXCLUDED_TYPES)), F.transform(chosen, text.squash))
