"""Author mentions and their identity clusters.

Every table carries ord, the place of the citation in its input, and position, the place of the
author in it: where a rule takes the first of several, it takes the smallest of these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import names, text
from ..functions.names import Target

NO_AFFILIATION = "no-affiliation"
#: Characters of a fingerprint that count; a key cut there is another key.
FINGERPRINT = 120


def targets(spark: SparkSession, wanted: dict[str, Target]) -> DataFrame:
    """One row per target: target_id, surname, given, initials, style, orcid."""
    rows = [(k, t.surname, t.given, t.initials, t.style, t.orcid) for k, t in wanted.items()]
    return spark.createDataFrame(rows, "target_id string, surname string, given string, initials string, style string, orcid string").withColumnsRenamed({"surname": "t_surname", "given": "t_given", "initials": "t_initials", "style": "t_style", "orcid": "t_orcid"})


def mentions(authors: DataFrame, wanted: DataFrame) -> DataFrame:
    """Authors that match a target, with target_id and method (orcid, given or initials).

    Candidates meet on surname key or identifier, both equi-joins, so many targets run at once.
    Where a citation has identifier matches only those stay. Where authors bring surname_keys
    (names.surname_keys of last_name, worked out where surnames stand once), these are used.
    """
    if "surname_keys" not in authors.columns:
        authors = authors.withColumn("surname_keys", names.surname_keys(F.coalesce("last_name", F.lit(""))))
    by_name = authors.select("*", F.explode("surname_keys").alias("key"))
    named = by_name.join(wanted, F.col("key") == F.col("t_surname")).drop("key")
    known = authors.withColumn("own", text.orcid(F.coalesce("orcid", F.lit("")))).where("own <> ''")
    identified = known.join(wanted.where("t_orcid <> ''"), F.col("own") == F.col("t_orcid")).drop("own")
    author = {k: F.col(k) for k in ("last_name", "fore_name", "initials", "orcid", "surname_keys")}
    target = {k: F.col(f"t_{k}") for k in ("surname", "given", "initials", "style", "orcid")}
    both = named.union(identified).withColumn("method", names.match_method(author, target)).where("method IS NOT NULL")
    once = both.withColumn("again", F.row_number().over(Window.partitionBy("target_id", "ord", "position").orderBy("method"))).where("again = 1")
    any_orcid = F.max((F.col("method") == "orcid").cast("int")).over(Window.partitionBy("target_id", "ord"))
    return once.withColumn("exclusive", any_orcid).where("(exclusive = 0) OR (method = 'orcid')").drop("surname_keys", "again", "exclusive", "t_surname", "t_given", "t_initials", "t_style", "t_orcid")


def fingerprint(institutions: Column, blocks: Column) -> Column:
    """Sorted distinct institution keys joined by |; without institutions the key of the blocks' text; at most FINGERPRINT characters."""
    keys = F.array_sort(F.array_distinct(F.filter(F.transform(institutions, text.institution_key), lambda k: k != "")))
    raw = text.institution_key(F.array_join(blocks, "; "))
    found = F.when(F.size(keys) > 0, F.array_join(keys, "|")).when(raw != "", raw).otherwise(NO_AFFILIATION)
    return F.left(F.when(F.size(blocks) == 0, F.lit(NO_AFFILIATION)).otherwise(found), F.lit(FINGERPRINT))


def with_cluster(found: DataFrame) -> DataFrame:
    """found (mentions with blocks and institutions) with name_key, keys and cluster_id, before merging."""
    print_ = fingerprint(F.col("institutions"), F.col("blocks"))
    name = F.concat_ws("|", text.token(F.col("last_name")), text.initials(F.col("fore_name")))
    named = found.withColumn("name_key", name).withColumn("print", print_)
    alone = F.col("print") == NO_AFFILIATION
    by_orcid = F.col("method") == "orcid"
    cluster = F.when(by_orcid, F.concat(F.lit("orcid:"), text.orcid(F.col("orcid")))).otherwise(
        F.concat(F.col("name_key"), F.lit("|"), F.col("print"), F.when(alone, F.concat(F.lit("|pmid:"), F.col("pmid"))).otherwise(""))
    )
    keys = F.when(by_orcid | alone, F.array().cast("array<string>")).otherwise(F.array_distinct(F.filter(F.split("print", r"\|"), lambda k: k != "")))
    return named.select("*", cluster.alias("cluster_id"), keys.alias("keys")).drop("print")


def subset_edges(clustered: DataFrame) -> DataFrame:
    """cluster_id, merged_id: the best strict superset of each cluster's keys under the same name, with at least as many mentions.

    Best is most mentions, then most keys, then the largest id. A best superset has no superset of
    its own (it would have been better), so one step reaches the end. A superset has the cluster's
    rarest key under the name too, so only clusters that share it meet.
    """
    sizes = clustered.where("size(keys) > 0").groupBy("target_id", "name_key", "cluster_id").agg(F.count("*").alias("n"), F.first("keys").alias("keys"))
    each = sizes.select("*", F.explode("keys").alias("key"))
    shared = each.withColumn("c", F.count("*").over(Window.partitionBy("target_id", "name_key", "key")))
    rarest = shared.groupBy("target_id", "name_key", "cluster_id").agg(F.min_by("key", F.struct("c", "key")).alias("key"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    a, b = rarest.alias("a"), each.alias("b")
    wider = (F.size("a.keys") < F.size("b.keys")) & (F.size(F.array_except("a.keys", "b.keys")) == 0) & (F.col("b.n") >= F.col("a.n"))
    pairs = a.join(b, (F.col("a.target_id") == F.col("b.target_id")) & (F.col("a.name_key") == F.col("b.name_key")) & (F.col("a.key") == F.col("b.key")) & wider)
    best = F.max_by(F.col("b.cluster_id"), F.struct(F.col("b.n"), F.size("b.keys"), F.col("b.cluster_id")))
    return pairs.groupBy(F.col("a.target_id").alias("e_target"), F.col("a.cluster_id").alias("e_cluster")).agg(best.alias("merged_id"))


def merged(clustered: DataFrame) -> DataFrame:
    """clustered with cluster_id after merging and first_id, the cluster before it."""
    edges = subset_edges(clustered)
    joined = clustered.join(edges, (F.col("target_id") == F.col("e_target")) & (F.col("cluster_id") == F.col("e_cluster")), "left")
    return joined.withColumn("first_id", F.col("cluster_id")).withColumn("cluster_id", F.coalesce("merged_id", "first_id")).drop("e_target", "e_cluster", "merged_id")


def clusters(found: DataFrame, cites: DataFrame) -> DataFrame:
    """target_id, cluster_id, label, mention_count, years, affiliations, rank (by mentions, then first appearance); found: merged mentions."""
    years = found.join(cites.select(F.col("ord").alias("c_ord"), "print_year"), F.col("ord") == F.col("c_ord"), "left")
    seen = F.min(F.struct("ord", "position")).over(Window.partitionBy("target_id", "first_id"))
    # after a merge the member that appeared first lends the label, and members follow one another in order of appearance
    placed = years.withColumn("member", seen)
    order = F.struct("member", "ord", "position")
    label = F.concat_ws(", ", "last_name", F.coalesce(F.nullif("fore_name", F.lit("")), "initials"))
    grouped = placed.groupBy("target_id", "cluster_id").agg(
        F.min_by(label, order).alias("label"),
        F.count("*").alias("mention_count"),
        F.array_sort(F.collect_set("print_year")).alias("years"),
        F.min(order).alias("first"),
    )
    place = F.row_number().over(Window.partitionBy("target_id").orderBy(F.desc("mention_count"), "first"))
    named = cluster_labels(placed)
    ranked = grouped.withColumn("rank", place).drop("first")
    return ranked.join(named, ["target_id", "cluster_id"], "left").withColumn("affiliations", F.coalesce("affiliations", F.array(F.lit("(no affiliation listed)"))))


def cluster_labels(placed: DataFrame) -> DataFrame:
    """target_id, cluster_id, affiliations: the first label seen of each institution key, sorted without regard to case."""
    each = placed.select("target_id", "cluster_id", "member", "ord", "position", F.posexplode("institutions").alias("place", "name"))
    keyed = each.withColumn("key", text.institution_key(F.col("name"))).where("key <> ''")
    first = keyed.groupBy("target_id", "cluster_id", "key").agg(F.min_by(text.institution_label(F.col("name")), F.struct("member", "ord", "position", "place")).alias("label"))
    return first.groupBy("target_id", "cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.lower("label").alias("k"), "label"))), lambda x: x["label"]).alias("affiliations"))
