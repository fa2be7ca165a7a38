"""Institutions of affiliation blocks: identifiers, e-mail domains, names, then rules; the first tier that finds any decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import institution_values as V
from ..functions import institutions as I
from ..functions import text


def seed_registry(spark: SparkSession) -> DataFrame:
    """kind (ror, grid, email or text), key, canonical: the pairs known here. A fuller registry has the same columns."""
    return spark.createDataFrame(list(V.SEED), "kind string, key string, canonical string")


def context(mentions: DataFrame) -> DataFrame:
    """mentions (with blocks) and context, the university systems that any of their blocks mentions."""
    return mentions.withColumn("context", F.array_distinct(F.flatten(F.transform("blocks", I.systems))))


def _pinned(df: DataFrame) -> DataFrame:
    """df with its columns computed once per row; projections above are not merged into it."""
    return df.select(F.explode(F.array(F.struct("*"))).alias("pinned")).select("pinned.*")


def _meant(block: Column, holders: Column) -> Column:
    """Those of holders (names) that the block names, or all of them where it names none."""
    said = F.filter(holders, lambda n: (text.institution_key(n) != "") & F.contains(text.institution_key(block), text.institution_key(n)))
    return F.get(F.filter(F.array(said, holders), lambda names: F.size(names) > 0), 0)


def resolve(blocks: DataFrame, registry: DataFrame, readings: bool = False) -> DataFrame:
    """block, context and institutions of the distinct rows of blocks (block, context).

    Everything to look up goes through one equi-join with the registry on (kind, key). Of a GRID's or
    an e-mail's candidates the first that is known counts. Rules run only on rows that no tier before
    them answered. Of several holders of one key in the registry those count that the block names, if it
    names any; of what is left the smallest name is taken, or with readings each in a row of its own.
    """
    empty = F.array().cast("array<string>")
    rows = blocks.select(F.trim("block").alias("block"), F.coalesce("context", empty).alias("context")).distinct()
    rows = rows.withColumn("id", F.xxhash64("block", F.array_join("context", "|")))
    b = F.col("block")
    ruled = F.coalesce(I.system_label(b, F.col("context")), I.state_label(b))
    asked = _pinned(rows.where(~I.narrative(b) & (b != "")).withColumn("label", ruled))
    ask = lambda kind, tier, group, of: F.transform(group, lambda x, i: F.transform(of(x), lambda k, j: F.struct(F.lit(tier).alias("tier"), i.alias("i"), j.alias("j"), F.lit(kind).alias("kind"), k.alias("key"))))
    wanted = F.flatten(F.concat(
        ask("ror", 1, I.ror_ids(b), lambda x: F.array(x)),
        ask("grid", 2, I.grid_ids(b), I.grid_candidates),
        ask("email", 3, I.emails(b), I.email_domains),
        ask("text", 4, I.candidates(b), lambda x: F.array(text.institution_key(x))),
        ask("text", 5, F.array_compact(F.array("label")), lambda x: F.array(text.institution_key(x))),
    ))
    probes = asked.select("id", F.explode(wanted).alias("w")).select("id", "w.*")
    known = registry.select(F.col("kind").alias("k_kind"), F.col("key").alias("k_key"), "canonical").groupBy("k_kind", "k_key").agg(F.array_sort(F.collect_set("canonical")).alias("holders"))
    hits = probes.join(known, (F.col("kind") == F.col("k_kind")) & (F.col("key") == F.col("k_key")))
    first = hits.groupBy("id", "tier", "i").agg(F.min_by("holders", "j").alias("holders"))
    labels = F.array_distinct(F.transform("holders", text.institution_label))
    named = first.select("id", F.when(F.col("tier") <= 2, 1).otherwise(F.col("tier")).alias("tier"), F.struct("tier", "i", labels.alias("names")).alias("hit"))
    tiers = named.groupBy(F.col("id").alias("h_id")).agg(*[F.transform(F.array_sort(F.collect_list(F.when(F.col("tier") == t, F.col("hit")))), lambda h: h["names"]).alias(f"t{t}") for t in (1, 3, 4, 5)])
    joined = asked.join(tiers, F.col("id") == F.col("h_id"), "left")
    some = lambda *ts: F.coalesce(*[F.when(F.size(f"t{t}") > 0, F.col(f"t{t}")) for t in ts])
    from_text = (some(1, 3).isNull() & some(4).isNotNull()).alias("from_text")
    met = _pinned(joined.select("id", "block", "label", from_text, F.coalesce(some(1, 3, 4, 5), F.array().cast("array<array<string>>")).alias("found")))
    meant = _pinned(met.withColumn("found", F.transform("found", lambda names: F.when(F.size(names) > 1, _meant(b, names)).otherwise(names))))
    # In reading k each key stands for its k-th holder, or for its last one where it has fewer.
    most = F.coalesce(F.array_max(F.transform("found", F.size)), F.lit(1))
    read = meant.withColumn("k", F.explode(F.sequence(F.lit(1), most)) if readings else F.lit(1))
    held = read.withColumn("names", F.transform("found", lambda names: F.get(names, F.least(F.col("k"), F.size(names)) - 1)))
    by_rule = F.when(F.size("names") > 0, F.col("names")).when(F.col("label").isNotNull(), F.array(text.institution_label(F.col("label")))).otherwise(empty)
    answered = _pinned(held.select("id", "block", by_rule.alias("names"), F.when(F.col("from_text"), I.kept_state_label(b)).alias("kept"), F.when(F.col("from_text"), text.institution_key(I.state_base(b))).alias("base")))
    swapped = F.transform("names", lambda x: F.when(F.col("kept").isNotNull() & (text.institution_key(x) == F.col("base")), F.col("kept")).otherwise(x))
    literal = _pinned(answered.select("id", "block", F.when(F.size("names") > 0, I.distinct_by_key(swapped)).otherwise(I.literal_labels(b)).alias("names")))
    found = _pinned(literal.select("id", "block", F.when(F.size("names") > 0, F.col("names")).otherwise(F.array_compact(F.array(I.company_label(b)))).alias("names")))
    done = found.select(F.col("id").alias("d_id"), I.with_country(F.col("names"), b).alias("institutions"))
    done = done.distinct() if readings else done
    return rows.join(done, F.col("id") == F.col("d_id"), "left").select("block", "context", F.coalesce("institutions", empty).alias("institutions"))
