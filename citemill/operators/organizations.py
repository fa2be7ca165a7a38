"""Checking citations and affiliations against a person's identifier record."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..runtime import ship, written
from . import resolve

LEVELS = ("possible", "contains", "likely", "verified")
LEAST_KEY, LEAST_RATIO = 10, 0.9
#: What signatures are made of.
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789 "


def identifier_matches(cites: DataFrame, record: DataFrame) -> DataFrame:
    """pmid, kinds: which identifiers (doi, pmcid, pmid) of a citation are in record (kind, value)."""
    sides = {"doi": text.record_doi, "pmid": text.pmid, "pmcid": text.pmcid}
    joined = cites
    for kind, norm in sides.items():
        known = record.where(F.col("kind") == kind).select(norm(F.col("value")).alias(f"r_{kind}")).where(f"r_{kind} <> ''").distinct()
        joined = joined.join(known, norm(F.col(kind)) == F.col(f"r_{kind}"), "left")
    kinds = F.array_sort(F.array_compact(F.array(*[F.when(F.col(f"r_{k}").isNotNull(), k) for k in sides])))
    return joined.select("pmid", kinds.alias("kinds")).where(F.size("kinds") > 0)


def organizations(raw: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """ord, name, key, signature, country, identifier of raw (ord, name, country, identifier); the first of each key, country and identifier.

    With a registry (resolve.resolve) the key is that of the first institution that the name resolves to, so that spellings of one
    institution share it; a name that resolves to nothing has its own.
    """
    shown = raw.withColumn("name", F.trim(F.regexp_replace("name", r"(?U)\s+", " ")))
    if registry is None:
        met = shown.withColumn("canonical", F.lit(None).cast("string"))
    else:
        names = shown.select(F.col("name").alias("block"), F.array().cast("array<string>").alias("context"))
        found = resolve.resolve(names, registry).select(F.col("block").alias("r_name"), F.get("institutions", 0).alias("canonical"))
        met = shown.join(found, F.col("name") == F.col("r_name"), "left").drop("r_name")
    own = text.institution_key(F.col("name"))
    named = met.select(
        "ord", "name", F.coalesce(F.nullif(text.institution_key(F.col("canonical")), F.lit("")), own).alias("key"),
        text.organization_signature(F.col("name")).alias("signature"), F.upper(F.coalesce("country", F.lit(""))).alias("country"),
        text.organization_identifier(F.coalesce("identifier", F.lit(""))).alias("identifier"),
    ).where("key <> ''")
    first = F.row_number().over(Window.partitionBy("key", "country", "identifier").orderBy("ord"))
    return named.withColumn("n", first).where("n = 1").drop("n")


def phrases(affiliation: Column) -> Column:
    """What an unresolved affiliation may name: each ;/| piece, then its comma parts, distinct without regard to case, first spelling kept."""
    pieces = text.affiliation_blocks(affiliation)
    parts = lambda p: F.filter(F.transform(F.split(p, ","), lambda x: F.trim(x)), lambda x: x != "")
    every = F.flatten(F.transform(pieces, lambda p: F.concat(F.array(p), parts(p))))
    lowered = F.transform(every, lambda x: F.lower(x))
    return F.filter(every, lambda x, i: F.array_position(lowered, F.lower(x)) == i + 1)


def letter_counts(signature: Column) -> Column:
    """How often each letter of LETTERS stands in a signature."""
    return F.array(*[F.length(signature) - F.length(F.replace(signature, F.lit(c), F.lit(""))) for c in LETTERS])


def most_alike(a: Column, b: Column, counts_a: Column, counts_b: Column) -> Column:
    """The highest ratio that two signatures can have: matching blocks hold no letter more often than either of them."""
    shared = F.aggregate(F.zip_with(counts_a, counts_b, lambda x, y: F.least(x, y)), F.lit(0), lambda n, x: n + x)
    return 2 * shared / (F.length(a) + F.length(b))


def similarity(left: Column, right: Column) -> Column:
    """Ratio of matching blocks (not an edit distance)."""

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(a=x, b=y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")

    return ratio(left, right)


def possibly_alike(pairs: DataFrame) -> DataFrame:
    """Those of pairs (inst_signature, inst_letters, o_signature, o_letters) that can reach LEAST_RATIO by their lengths and letters; exact, in the JVM."""
    a, b = F.length("inst_signature"), F.length("o_signature")
    near = pairs.where((F.col("inst_signature") != "") & (2 * F.least(a, b) >= LEAST_RATIO * (a + b)))
    return near.where(most_alike(F.col("inst_signature"), F.col("o_signature"), F.col("inst_letters"), F.col("o_letters")) >= LEAST_RATIO)


def candidates(names: DataFrame, orgs: DataFrame) -> DataFrame:
    """Matches of different names (name) with organizations: tier (key, contains or similar), ratio (of signatures, where only similar) and the organization.

    All tiers but the first need a shared distinctive word, so candidates meet on words: an equi-join, never every pair.
    Ratios are taken in Python, only where lengths and letters allow LEAST_RATIO at all; names less alike are left out.
    """
    ship(names.sparkSession)
    keys = names.select("name", text.institution_key(F.col("name")).alias("inst_key"), text.organization_signature(F.col("name")).alias("inst_signature"), text.distinctive_tokens(F.col("name")).alias("words"))
    # Keys and words cost many replacements each: they are computed once a name, not once a use.
    pinned = lambda df: df.select(F.explode(F.array(F.struct("*"))).alias("k")).select("k.*")
    keyed = pinned(pinned(keys).withColumn("inst_letters", letter_counts(F.col("inst_signature")))).where("inst_key <> ''")
    owned = orgs.select(*[F.col(c).alias(f"o_{c}") for c in ("ord", "name", "key", "signature", "identifier")])
    worded = pinned(owned.withColumn("o_words", text.distinctive_tokens(F.col("o_name"))).withColumn("o_letters", letter_counts(F.col("o_signature"))))
    exact = keyed.join(owned, F.col("inst_key") == F.col("o_key")).select("name", *owned.columns, F.lit("key").alias("tier"), F.lit(None).cast("double").alias("ratio"))
    left, right = keyed.withColumn("word", F.explode("words")), worded.withColumn("o_word", F.explode("o_words"))
    met = left.join(right, (F.col("word") == F.col("o_word")) & (F.col("inst_key") != F.col("o_key"))).dropDuplicates(["name", "o_ord"])
    inside = (F.length("o_key") >= LEAST_KEY) & (F.contains("inst_key", "o_key") | F.contains("o_key", "inst_key"))
    tiered = met.withColumn("tier", F.when(inside, "contains").otherwise("similar"))
    contains = tiered.where("tier = 'contains'").select("name", *owned.columns, "tier", F.lit(None).cast("double").alias("ratio"))
    near = possibly_alike(tiered.where("tier = 'similar'"))
    alike = near.withColumn("ratio", similarity(F.col("inst_signature"), F.col("o_signature"))).where(F.col("ratio") >= LEAST_RATIO)
    return exact.union(contains).union(alike.select("name", *owned.columns, "tier", "ratio"))


def affiliation_matches(affiliations: DataFrame, orgs: DataFrame) -> DataFrame:
    """id, level, institution, label: the best match of each id's affiliations.

    The first name (by affiliation, then name) with a key or containment match decides: an equal key
    is verified if the affiliation holds the identifier of any such organization (the first with an
    identifier is named), else likely (the first is named); containment names the longest key. Names
    that are only alike count as possible, and only if no name matched; the most alike is taken.
    Names are matched once each, however many affiliations repeat them.
    """
    matched = candidates(affiliations.select("name").distinct(), orgs).withColumnRenamed("name", "m_name")
    found = affiliations.join(matched, F.col("name") == F.col("m_name"))
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    has = F.when(F.col("o_identifier") != "", F.contains(plain(F.col("affiliation")), plain(F.col("o_identifier")))).otherwise(F.lit(False))
    key = F.col("tier") == "key"
    each = found.groupBy("id", "affiliation_ord", "name_ord").agg(
        F.min(F.when(key, F.struct("o_ord", "o_name"))).alias("by_key"),
        F.min(F.when(key & (F.col("o_identifier") != ""), F.struct("o_ord", "o_name"))).alias("by_identifier"),
        F.coalesce(F.max(F.when(key, has)), F.lit(False)).alias("verified"),
        F.min(F.when(F.col("tier") == "contains", F.struct((-F.length("o_key")).alias("n"), "o_ord", "o_name"))).alias("by_part"),
        F.min(F.when(F.col("tier") == "similar", F.struct((-F.col("ratio")).alias("r"), "affiliation_ord", "name_ord", "o_ord", "o_name"))).alias("alike"),
    )
    level = F.when(F.col("verified"), "verified").when(F.col("by_key").isNotNull(), "likely").otherwise("contains")
    institution = F.when(F.col("verified"), F.col("by_identifier.o_name")).otherwise(F.coalesce("by_key.o_name", "by_part.o_name"))
    strong = F.col("by_key").isNotNull() | F.col("by_part").isNotNull()
    placed = F.when(strong, F.struct("affiliation_ord", "name_ord", level.alias("level"), institution.alias("institution")))
    best = each.groupBy("id").agg(F.min(placed).alias("m"), F.min("alike").alias("alike"))
    every = best.select("id", F.when(F.col("m").isNotNull(), F.col("m.level")).otherwise("possible").alias("level"), F.coalesce("m.institution", "alike.o_name").alias("institution"))
    said = F.create_map(*map(F.lit, ("verified", "organization identifier (", "likely", "institution match (", "contains", "affiliation contains institution (", "possible", "name similarity (")))
    return every.select("*", F.concat(said[F.col("level")], "institution", F.lit(")")).alias("label"))


def text_matches(texts: DataFrame, orgs: DataFrame) -> DataFrame:
    """affiliation, level, institution, label: the best match of each different text of texts (affiliation), by the phrases in it; kept as a table.

    Texts repeat: each is taken apart and matched once, and the result, whose size is known, joins whatever rows hold the texts.
    """
    once = written(texts.select("affiliation").where("affiliation IS NOT NULL").distinct())
    named = once.select(F.col("affiliation").alias("id"), F.lit(0).alias("affiliation_ord"), "affiliation", F.posexplode(phrases(F.col("affiliation"))).alias("name_ord", "name"))
    return written(affiliation_matches(named, orgs).withColumnRenamed("id", "affiliation"))


def level_rank(level: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, LEVELS)), level)


def cluster_levels(rows: DataFrame) -> DataFrame:
    """cluster_id, key, name, level: the strongest level of each institution key in rows (cluster_id, institution, level, ord); the first on ties."""
    keyed = rows.withColumn("key", text.institution_key(F.col("institution"))).where("key <> ''")
    best = F.min_by(F.struct(F.trim("institution").alias("name"), "level"), F.struct((-level_rank(F.col("level"))).alias("r"), "ord"))
    return keyed.groupBy("cluster_id", "key").agg(best.alias("b")).select("cluster_id", "key", "b.name", "b.level")


def cluster_badges(affiliations: DataFrame, levels: DataFrame) -> DataFrame:
    """cluster_id, affiliation, level, institution: the best match of each affiliation of a cluster with the cluster's institutions; an equal key beats containment."""
    a = affiliations.withColumn("own_key", text.institution_key(F.col("affiliation")))
    joined = a.join(levels.withColumnRenamed("cluster_id", "l_cluster"), F.col("cluster_id") == F.col("l_cluster"), "left")
    part = (F.contains("key", "own_key") | F.contains("own_key", "key")) & F.arrays_overlap(text.distinctive_tokens(F.col("affiliation")), text.distinctive_tokens(F.col("name")))
    usable = (F.col("own_key") != "") & (F.col("key") != "")
    level = F.when(usable & (F.col("own_key") == F.col("key")), F.col("level")).when(usable & part, "contains")
    ranked = joined.withColumn("match", level)
    best = F.min_by(F.struct("match", "name"), F.struct((-F.coalesce(level_rank(F.col("match")), F.lit(0))).alias("r"), F.lower("name").alias("n")))
    return ranked.groupBy("cluster_id", "affiliation").agg(best.alias("b")).select("cluster_id", "affiliation", "b.match", F.when(F.col("b.match").isNotNull(), F.col("b.name")).alias("institution"))
