"""What a report shows beside its rows: how a citation stands to the person's identifier record, and where it came from."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

#: First year on offer, classes and titles of badges, sources in order.
FIRST_YEAR = 1950
BADGE, WEAK = "orcid-badge", "orcid-badge orcid-badge-weak"
ADDED, MATCH = "Citation added from ORCiD record", "ORCiD match"
SOURCES = {
    "user": ("user", "source-badge source-user", "Citation added from user file"),
    "litsense": ("litsense", "source-badge source-litsense", "Citation added from LitSense"),
}


def year_options(today: date) -> list[int]:
    """Years to choose from, the present one first."""
    return list(range(today.year, FIRST_YEAR - 1, -1))


def badge_class(matched: Column, level: Column) -> Column:
    """Weak for an affiliation that only contains an institution, unless the citation itself is in the record."""
    return F.when(~matched & (F.lower(F.trim(level)) == "contains"), WEAK).otherwise(BADGE)


def badge_title(matched: Column, kinds: Column, level: Column, label: Column) -> Column:
    by = F.array_join(F.transform(kinds, lambda k: F.upper(k)), "/")
    found = F.when(by != "", F.concat(F.lit(f"{ADDED} (matched by "), by, F.lit(")"))).otherwise(ADDED)
    affiliation = F.when(label != "", F.concat(F.lit("ORCiD affiliation "), level, F.lit(": "), label)).otherwise(F.concat(F.lit("ORCiD affiliation "), level, F.lit(" match")))
    return F.when(matched, found).when(level != "", affiliation).otherwise(MATCH)


def record_fields(rows: DataFrame, identifiers: DataFrame, affiliations: DataFrame, orcid: str) -> DataFrame:
    """rows (pmid) with what the record of orcid says of them.

    identifiers: pmid, kinds (organizations.identifier_matches); affiliations: pmid, level, institution, label (organizations.affiliation_matches), one
    row a pmid each. Added are verified, match_types, match_label, affiliation_verified, affiliation_level, affiliation_label,
    affiliation_institution, badge_show, badge_class, badge_title and record_url. A badge shows, and links to the record, only where the citation itself is in it.
    """
    i = identifiers.select(F.col("pmid").alias("i_pmid"), "kinds")
    a = affiliations.select(F.col("pmid").alias("a_pmid"), F.lower(F.trim("level")).alias("a_level"), F.trim("label").alias("a_label"), F.trim("institution").alias("a_institution"))
    met = rows.join(i, F.col("pmid") == F.col("i_pmid"), "left").join(a, F.col("pmid") == F.col("a_pmid"), "left")
    kinds, text_of = F.coalesce("kinds", F.array().cast("array<string>")), lambda c: F.coalesce(c, F.lit(""))
    matched, level, label = F.size(kinds) > 0, text_of("a_level"), text_of("a_label")
    return met.select(
        *rows.columns, matched.alias("verified"), kinds.alias("match_types"), F.array_join(F.transform(kinds, lambda k: F.upper(k)), "/").alias("match_label"),
        ((level != "") & (label != "")).alias("affiliation_verified"), level.alias("affiliation_level"), label.alias("affiliation_label"), text_of("a_institution").alias("affiliation_institution"),
        matched.alias("badge_show"), badge_class(matched, F.lit("")).alias("badge_class"), badge_title(matched, kinds, level, label).alias("badge_title"),
        F.when(matched & (F.lit(orcid) != ""), F.concat(F.lit("https://orcid.org/"), text.orcid(F.lit(orcid)))).alias("record_url"),
    )


def source_badges(tags: Column) -> Column:
    """label, class and title of each source among tags, in display order."""
    fields = ("label", "class", "title")
    each = [F.when(F.array_contains(tags, tag), F.struct(*[F.lit(v).alias(k) for k, v in zip(fields, shown, strict=True)])) for tag, shown in SOURCES.items()]
    return F.array_compact(F.array(*each))
