"""Scalar normalisers as Column expressions. All are JVM-side; null in gives null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that tell no institution from another (fixed values).
GENERIC_WORDS = (
    "and at center centre college department departments division faculty for health hospital in institute institutes "
    "lab laboratory medical medicine of program school state system the university unit"
).split()
#: Short tokens that do (fixed values).
SHORT_NAMES = "nih nyu mit ucla ucsf".split()


def token(c: Column) -> Column:
    """Lower case, letters a-z and digits only."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def squash(c: Column) -> Column:
    """Lower case, white space collapsed to single spaces and trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))


def initials(c: Column, upper: bool = False) -> Column:
    """First letter of each run of ASCII letters."""
    found = F.array_join(F.transform(F.regexp_extract_all(c, F.lit("[A-Za-z]+"), F.lit(0)), lambda x: F.left(x, F.lit(1))), "")
    return F.upper(found) if upper else F.lower(found)


def country_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(squash(c), F.lit("."), F.lit("")), r"^the\s+", ""))


def _spelled(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(squash(c), r"(?U)\s*&\s*", " and "), "[’`´]", "'")


def institution_key(c: Column) -> Column:
    return token(_spelled(c))


def distinctive_tokens(c: Column) -> Column:
    """Words that can tell institutions apart, distinct."""
    words = F.filter(F.split(_spelled(c), "[^a-z0-9]+"), lambda w: w != "")
    common = F.array(*map(F.lit, GENERIC_WORDS))
    short = F.array(*map(F.lit, SHORT_NAMES))
    return F.array_distinct(F.filter(words, lambda w: ~F.array_contains(common, w) & ~w.rlike("^[0-9]+$") & ((F.length(w) >= 3) | F.array_contains(short, w))))


def institution_label(c: Column) -> Column:
    """A label with plain apostrophes, spelled-out ampersands, without detached identifiers and trailing marks."""
    plain = F.regexp_replace(F.regexp_replace(c, "[’`´]", "'"), r"(?U)\s*&\s*", " and ")
    loose = F.regexp_replace(plain, r"(?i)(?<=[A-Za-z])grid\.(?=\s+[A-Z])", " ")
    named = F.regexp_replace(loose, r"(?i)\btexas\s+a\s+and\s+m\b", "Texas A&M")
    return F.regexp_replace(F.trim(F.regexp_replace(named, r"(?U)\s+", " ")), r"[.;,\s]+$", "")


def orcid(c: Column) -> Column:
    """Canonical hyphenated identifier, or '' where there is none."""
    bare = F.regexp_replace(F.trim(c), r"(?i)^(https?://)?orcid\.org/", "")
    dashed = r"(\d{4})-?(\d{4})-?(\d{4})-?(\d{3}[\dXx])"
    parts = lambda x, p: F.upper(F.concat_ws("-", *[F.regexp_extract(x, p, k) for k in (1, 2, 3, 4)]))
    compact = F.regexp_replace(bare, "[^0-9Xx]", "")
    whole = r"^(\d{4})(\d{4})(\d{4})(\d{3}[\dXx])$"
    return F.when(bare.rlike(dashed), parts(bare, dashed)).when(compact.rlike(whole), parts(compact, whole)).otherwise(F.when(c.isNotNull(), ""))


def required_orcid(c: Column) -> Column:
    """As orcid, but text that holds no identifier is an error."""
    found = orcid(c)
    return F.when((F.trim(c) != "") & (found == ""), F.raise_error(F.lit("ORCID must be in the form 0000-0000-0000-0000 (or an ORCID URL)")).cast("string")).otherwise(found)


def year(c: Column) -> Column:
    """The first year from 1900 to 2099 anywhere in a text, or null."""
    return F.regexp_extract(c, r"((?:19|20)\d{2})", 1).try_cast("int")


def _bare_doi(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(c), r"(?i)^https?://(dx\.)?doi\.org/", ""), r"(?i)^doi:\s*", "")


def parsed_doi(c: Column) -> Column:
    """DOI as documents give it: without prefix, case kept."""
    return F.regexp_replace(F.trim(_bare_doi(c)), r"^[.,;]+|[.,;]+$", "")


def record_doi(c: Column) -> Column:
    """DOI as identifier records compare it: without prefix, lower case."""
    return F.lower(parsed_doi(c))


def match_doi(c: Column) -> Column:
    """DOI as citations are matched: trimmed and lower case only; '' for null."""
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def pmid(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def pmcid(c: Column) -> Column:
    """Upper-case letters and digits, with PMC before bare numbers."""
    raw = F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")
    return F.when(raw.rlike("^[0-9]+$"), F.concat(F.lit("PMC"), raw)).otherwise(raw)


def pmcid_number(c: Column) -> Column:
    return F.regexp_replace(pmcid(c), "^PMC", "")


def pmids_in(c: Column) -> Column:
    """All digit runs of a text, distinct in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"(\d+)"), F.lit(1)))


def affiliation_blocks(c: Column) -> Column:
    """Pieces between ; and |, trimmed, distinct in order, blanks dropped."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "[;|]+"), lambda x: F.trim(x)), lambda x: x != ""))


def type_terms(c: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.split(c, r"[,\n;]+"), squash), lambda x: x != ""))


def contains_phrase(text: Column, phrase: Column) -> Column:
    """Whether phrase occurs in text with no letter or digit next to it."""
    return F.regexp_like(text, F.concat(F.lit(r"(?<![a-z0-9])\Q"), phrase, F.lit(r"\E(?![a-z0-9])")))


def organization_signature(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.replace(squash(c), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " "), " +", " "))


def organization_identifier(c: Column) -> Column:
    """The part after ror.org/ if any, lower-case letters and digits."""
    bare = F.regexp_replace(F.trim(c), "/+$", "")
    return F.regexp_replace(F.lower(F.regexp_replace(bare, r"(?i)^.*ror\.org/", "")), "[^a-z0-9]+", "")


def file_stem(surname: Column, given_initials: Column, window: Column) -> Column:
    """Report file name: surname and initials, or 'author', then the window."""
    who = F.concat(token(F.coalesce(surname, F.lit(""))), token(F.coalesce(given_initials, F.lit(""))))
    return F.concat(F.when(who == "", "author").otherwise(who), F.lit("_"), F.regexp_replace(window, "[^A-Za-z0-9]+", "_"))
