"""Benchmark decontamination by size-partitioned MinHash containment search.

Benchmark items are partitioned by their number of distinct word shingles, doubling from one
partition to the next. An item's sketch is the smallest hashes of its shingles (bottom-k MinHash):
SKETCH of them, or fewer where fewer are sure to be hit, as a text that holds a share c of n
shingles has one of any n - c * n + 1. A partition's cut is the largest hash in its own items'
sketches. Long texts are not sketched to a fixed size, which would lose short items inside them:
for each partition a text probes with all its shingle hashes up to that partition's cut, so a
sketch hash that the text contains is always seen, however long the text. A tiny item raises the
cut of its own partition alone. A text and an item that meet in a partition on a sketch hash are a
candidate pair; a text holding the share 0.8 of an item escapes with chance
(1 - 0.8) ** SKETCH, 3e-6, and never if the item has 35 shingles or fewer. Candidates are verified
by the exact share of the item's distinct shingles that the text has: each shingle that a pair asks
for is a row, which meets the text's own shingles in a join, so the work grows with the shingles asked
for, and no text's or item's candidates are gathered in one row.

Texts meet the sketches' keys where they are read: the different keys are broadcast, in blocks of
at most about BLOCK, each block meeting all texts. Only texts with a candidate are shuffled.

Texts: A to Z in lower case, words without white space, shingles of WIDTH words (fewer words: all
of them as one shingle; none: no shingle). Null and empty texts and items match nothing. Rows
equal in doc_id and text give one result; equal items with different ids match each on its own;
an item id with several texts has its best match; an empty table on either side gives no rows.
Other columns are ignored. Null ids are kept. Texts of any length are searched whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lowered, pinned, table, words, written

WIDTH, SHARE, SKETCH = 5, 0.8, 8
#: Sketch keys sent to every executor at a time (8 bytes each).
BLOCK = 1 << 20


def _shingles(w: Column, width: int = WIDTH) -> Column:
    """Shingles of a column of words."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - width + 1, F.lit(1))), lambda start: F.array_join(F.slice(w, start, width), " "))


def _hashes(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """rows with hs, the hashes of the shingles of column w, in place of w; rows without words go."""
    hashed = pinned(rows.where(F.size("w") > 0).withColumn("wh", F.transform("w", lambda x: F.xxhash64(x))).drop("w"))
    # Beyond the last word of a short text there are nulls, which leave the hash as it is.
    one = lambda start: F.xxhash64(*[F.get("wh", start + k) for k in range(width)])
    return pinned(hashed.withColumn("hs", F.transform(F.sequence(F.lit(0), F.greatest(F.size("wh") - width, F.lit(0))), one)).drop("wh"))


def _sketches(units: DataFrame, share: float = SHARE) -> DataFrame:
    """u, part, h and key (one number for part and h) of the sketch of each item (u, w)."""
    sets = pinned(_hashes(units.select("u", "w")).select("u", F.array_sort(F.array_distinct("hs")).alias("hs")))
    n = F.size("hs")
    enough = F.least(F.lit(SKETCH), n - F.ceil(n * share - 1e-9).cast("int") + 1)
    found = sets.select("u", F.ceil(F.log2(n)).cast("int").alias("part"), F.explode(F.slice("hs", 1, F.greatest(enough, F.lit(1)))).alias("h"))
    return found.withColumn("key", _key(F.col("part"), F.col("h")))


def _key(part: Column, h: Column) -> Column:
    return h.bitwiseXOR(part.cast("long"))


def probes(hashed: DataFrame, cuts: dict[int, int]) -> DataFrame:
    """hashed (with hs) with key of every hash up to the cut of each partition, once for each such partition, in place of hs."""

    def own(part: int, cut: int) -> Column:
        return F.transform(F.filter("hs", lambda h: h <= cut), lambda h: _key(F.lit(part), h))

    return hashed.select(*[c for c in hashed.columns if c != "hs"], F.explode(F.concat(*[own(part, cut) for part, cut in sorted(cuts.items())])).alias("key"))


def _candidates(docs: DataFrame, sketches: DataFrame) -> DataFrame:
    """doc_id, th, text and keys (sketch keys that it has) of every text with any."""
    cuts = {r["part"]: r["cut"] for r in sketches.groupBy("part").agg(F.max("h").alias("cut")).collect()}  # a row for each doubling of the size
    texts = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("th"), "text", words(lowered(F.col("text"))).alias("w"))
    met = probes(_hashes(texts), cuts) if cuts else texts.select("doc_id", "th", "text", F.lit(0).cast("long").alias("key")).where("false")
    keys = sketches.select(F.col("key").alias("wanted")).distinct()
    blocks = -(-keys.count() // BLOCK)
    parts = [keys.where(F.pmod(F.xxhash64("wanted"), F.lit(blocks)) == k) if blocks > 1 else keys for k in range(max(1, blocks))]
    found = reduce(DataFrame.union, [met.join(F.broadcast(p), F.col("key") == F.col("wanted"), "left_semi") for p in parts])
    return found.groupBy("doc_id", "th").agg(F.first("text").alias("text"), F.collect_set("key").alias("keys"))


def contained(docs: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    """doc_id, item_id, containment (a share of the item's distinct shingles) and th (hash of the text) of every match; docs has doc_id and text, items item_id and text."""
    worded = pinned(items.select("item_id", words(lowered(F.col("text"))).alias("w"))).where(F.size("w") > 0).withColumn("u", F.xxhash64("w"))
    members = written(worded.select("item_id", "u").distinct())
    units = written(worded.groupBy("u").agg(F.first("w").alias("w")))
    sketches = written(_sketches(units, share))
    texts = written(_candidates(docs.select("doc_id", "text"), sketches))
    hits = texts.select("doc_id", "th", F.explode("keys").alias("key"))
    pairs = written(hits.join(sketches.select(F.col("key").alias("of"), "u"), F.col("key") == F.col("of")).select("doc_id", "th", "u").distinct())
    # A row for each shingle that a text must have, one for each that it has of those that any must have: they meet and are counted.
    asked = units.join(pairs.select("u").distinct(), "u", "left_semi").select("u", F.array_distinct(_shingles(F.col("w"))).alias("need"))
    sizes = written(pinned(asked).select("u", F.size("need").alias("n"), F.explode("need").alias("s")))
    sought = pairs.join(sizes.withColumnRenamed("u", "of"), F.col("u") == F.col("of")).drop("of")
    split = pinned(texts.select("doc_id", "th", words(lowered(F.col("text"))).alias("w")))
    had = split.select("doc_id", "th", F.explode(F.array_distinct(_shingles(F.col("w")))).alias("s")).join(sizes.select(F.col("s").alias("any")), F.col("s") == F.col("any"), "left_semi")
    own = had.select(F.col("doc_id").alias("h_id"), F.col("th").alias("h_th"), F.col("s").alias("h_s"))
    shared = sought.join(own, F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("th") == F.col("h_th")) & (F.col("s") == F.col("h_s")))
    exact = shared.groupBy("doc_id", "th", "u").agg((F.count("*") / F.max("n")).alias("containment")).where(F.col("containment") >= share)
    named = exact.join(members.withColumnRenamed("u", "of"), F.col("u") == F.col("of"))
    return named.groupBy("doc_id", "th", "item_id").agg(F.max("containment").alias("containment")).select("doc_id", "item_id", "containment", "th")


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = contained(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.select("doc_id", "item_id", F.round("containment", 6).alias("containment"))


SQL = rf"""
WITH w AS (
  SELECT 'd' AS side, doc_id AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
  UNION ALL
  SELECT 'b', item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') FROM benchmark),
s AS (
  SELECT DISTINCT side, id, unnest(list_transform(range(1, greatest(len(w) - {WIDTH - 1}, 1) + 1), lambda i: array_to_string(w[i:i + {WIDTH - 1}], ' '))) AS s
  FROM w WHERE len(w) > 0),
n AS (SELECT id, count(*) AS n FROM s WHERE side = 'b' GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, round(count(*) / max(n.n), 6) AS containment
FROM s d JOIN s b ON d.s = b.s AND d.side = 'd' AND b.side = 'b' JOIN n ON n.id = b.id
GROUP BY d.id, b.id HAVING count(*) / max(n.n) >= {SHARE}
"""
