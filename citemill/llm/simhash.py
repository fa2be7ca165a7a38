"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints within r bits share a variant that is at most r/2 bits from either. Every
distinct fingerprint emits all its variants within r/2 bits (65 for r = 2 over 64 bits), the
variants are shuffled, and those that meet on a variant are linked in a chain in order of
fingerprint, so a variant's group gives one link less than it has members, never all pairs.
Links are deduplicated and verified by counting bits. Copies meet as one fingerprint before
any variant is made, so a group of copies costs one row.

Texts: A to Z are lower-cased; words are runs without white space; shingles are `width` words,
repeats included; fewer words are one shingle; no words (null, empty, blank) give fingerprint
zero, which links like any other. Repeated rows get the same answer; an empty table gives no
rows; other columns are ignored. A null doc_id is never the representative unless all are null.

Copies of a given Jaccard similarity mostly differ in more bits than a ball can hold (about 10 of
64 at 0.8), so near_copies takes more meeting points beside the ball of the fingerprint:
BANDS hashes of ROWS minima of a text's shingles (MinHash). Texts that meet at a point are compared by the exact share of their
distinct shingles. Two texts of similarity s share no band with chance (1 - s ** ROWS) ** BANDS,
which is 7e-5 at 0.8. Of a group at a point, every text is compared with the group's centre (the
text that meets most others, as an original does among its copies) and with one near it in hash
order. Texts of groups that this leaves in several components are compared across those by an exact
prefix filter over their rarest shingles, so no link between texts that meet is lost, and pairs within
a group are made only of unconnected texts that share a rare shingle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import ship
from .common import keyed_join, lowered, pinned, table, words, written
from .components import components

BANDS, ROWS = 24, 5
#: Texts of a group that are first compared with one of them; bits of a text's parities.
NEAR, PARITY = 4, 1024
_RANDOM = np.random.default_rng(42)
_FACTOR, _SHIFT = (_RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64) for _ in range(2))
_FACTOR = _FACTOR * np.uint64(2) + np.uint64(1)
#: Shingles whose bits are counted at a time.
BLOCK = 1 << 16


def shingle_hashes(text: str | None, width: int) -> Iterator[np.ndarray]:
    """The shingles' XXH64 (seed 42), a block at a time; none without words."""
    found = (text or "").encode().lower().split()  # of bytes, both concern ASCII alone
    if not found:
        return
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    n = max(1, len(found) - width + 1)
    starts = np.r_[0, ends + 1][:n].tolist()
    lasts = ends[min(width, len(found)) - 1 :].tolist()
    hashed = xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK):
        yield np.array([hashed(joined[a:b], 42) for a, b in zip(starts[at : at + BLOCK], lasts[at : at + BLOCK], strict=True)], np.uint64)


def _fingerprint(blocks: list[np.ndarray] | Iterator[np.ndarray]) -> int:
    counts, n = np.zeros(64, np.int64), 0
    for h in blocks:
        counts += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(h)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprint(text: str | None, width: int = 3) -> int:
    """64 bits, each set where more than half of the shingles' XXH64 (seed 42) have it."""
    return _fingerprint(shingle_hashes(text, width))


def meeting_points(text: str | None, width: int) -> list[int]:
    """The fingerprint and the band hashes by which a text meets candidates, as signed longs; none without words."""
    blocks = list(shingle_hashes(text, width))
    if not blocks:
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for h in blocks:
        for at in range(0, len(h), 2048):
            least = np.minimum(least, (h[at : at + 2048, None] * _FACTOR + _SHIFT).min(axis=0))
    band = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in least.reshape(ROWS, BANDS):
        band = (band ^ row) * np.uint64(0x9E3779B97F4A7C15)
        band ^= band >> np.uint64(29)
    return np.r_[np.array([_fingerprint(blocks)], np.uint64), band].view(np.int64).tolist()


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, th (hash of the text) and fp (the fingerprint as a signed long) of every row of docs (doc_id, text)."""

    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), width) for t in batch.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found)], ["doc_id", "th", "fp"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "xxhash64(text) th", "text").mapInArrow(run, "doc_id long, th long, fp long")


def ball(radius: int) -> list[int]:
    """All 64-bit masks with at most so many bits, as signed longs."""
    masks = [sum(1 << i for i in bits) for k in range(radius + 1) for bits in combinations(range(64), k)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """Links a > b between different fingerprints within radius bits, enough of them to connect all such fingerprints."""
    if radius < 1:
        return distinct.selectExpr("fp a", "fp b").where("false")
    if radius % 2:
        raise ValueError("an odd radius would need every pair that meets; use an even one")
    variants = _variants(distinct, radius)
    meeting = Window.partitionBy("variant").orderBy("fp")
    linked = variants.select("fp", F.lag("fp").over(meeting).alias("other")).where("other is not null")
    return linked.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= radius).selectExpr("fp a", "other b").distinct()


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, th (hash of the text), fp and component_id (the smallest doc_id reachable over links) of every row of docs (doc_id, text)."""
    rows = written(fingerprints(docs, width))
    classes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("c")))
    return _named(rows, classes, components(links(classes.select("fp"), radius)), "fp").select("doc_id", "th", "fp", "component_id")


def _named(rows: DataFrame, classes: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """rows with component_id, by their class (key, first: its smallest doc_id, c: its rows) and the class's component (node, root); copies may be many, and are dealt out."""
    rooted = classes.join(found, F.col(key) == F.col("node"), "left").select(key, "first", "c", F.coalesce("root", key).alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n"))
    return keyed_join(rows, written(keyed_join(rooted, written(least), "root").select(key, "component_id", "c")), key)


def one_of_each(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """The rows of docs that are the smallest doc_id of their component, once each; where a component has no doc_id, all its different texts."""
    return _smallest(docs, near_duplicates(docs, width, radius))


def _smallest(docs: DataFrame, found: DataFrame) -> DataFrame:
    stay = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("s_id"), F.col("th").alias("s_th")).distinct()
    rows = docs.select(F.struct("*").alias("row"))
    kept = rows.join(stay, F.col("row.doc_id").eqNullSafe(F.col("s_id")) & (F.xxhash64("row.text") == F.col("s_th")))
    return kept.dropDuplicates(["s_id", "s_th"]).select("row.*")


def near_copies(docs: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """doc_id, th (hash of the text) and component_id (the smallest doc_id reachable over texts whose distinct shingles have a Jaccard similarity of least or more) of every row of docs (doc_id, text)."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
            texts = batch.column(2).to_pylist()
            same = [xxhash.xxh64_intdigest(b" ".join((t or "").encode().lower().split()), 42) for t in texts]
            points = pa.array([meeting_points(t, width) for t in texts], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(same, np.uint64).view(np.int64)), points], ["doc_id", "th", "same", "points"])

    hashed = docs.selectExpr("cast(doc_id as long) doc_id", "xxhash64(text) th", "text")
    rows = written(hashed.mapInArrow(run, "doc_id long, th long, same long, points array<long>"))
    # Texts of the same words are one class, which has one of them (the smallest hash) compared.
    classes = written(rows.groupBy("same").agg(F.min("doc_id").alias("first"), F.min("th").alias("shown"), F.first("points").alias("points"), F.count("*").alias("c")))
    return _named(rows, classes, _linked(docs, classes, width, least), "same").select("doc_id", "th", "component_id")


def _variants(prints: DataFrame, radius: int) -> DataFrame:
    """fp and variant: all that is at most radius / 2 bits from each fingerprint of prints."""
    masks = F.array(*[F.lit(m).cast("long") for m in ball(radius // 2)])
    return prints.select("fp", F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("variant"))


def _ball_points(classes: DataFrame, radius: int = 2) -> DataFrame:
    """same and point of every class whose fingerprint (the first of its points) has another within radius bits: two that are so near share a variant, and a variant has 65 fingerprints at most."""
    printed = classes.where(F.size("points") > 0).select("same", F.get("points", 0).alias("fp"))
    near = _variants(printed.select("fp").distinct(), radius).groupBy("variant").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    meeting = written(near.select(F.explode("fps").alias("fp"), F.xxhash64("variant", F.lit("ball")).alias("point")))
    return keyed_join(printed, meeting, "fp").select("same", "point")


def _meetings(classes: DataFrame) -> DataFrame:
    """point, same, c (classes at the point) and pop (how many others a class meets, over all its points) of every class at a point with others."""
    points = classes.select("same", F.explode("points").alias("point")).union(_ball_points(classes))
    shared = written(points.groupBy("point").agg(F.count("*").alias("c")).where("c > 1"))
    met = written(keyed_join(points, shared, "point").select("point", "same", "c"))
    popular = met.groupBy("same").agg(F.sum("c").alias("pop")).withColumnRenamed("same", "own")
    return written(met.join(popular, met.same == popular.own).drop("own"))


def _ordered(pairs: DataFrame) -> DataFrame:
    """Columns a > b of pairs (same, other), each pair once."""
    return pairs.where("same <> other").select(F.greatest("same", "other").alias("a"), F.least("same", "other").alias("b")).distinct()


def _linked(docs: DataFrame, classes: DataFrame, width: int, least: float) -> DataFrame:
    """node and root of every class that is linked to another."""
    met = _meetings(classes)
    texts = classes.join(met.select(F.col("same").alias("own")).distinct(), F.col("same") == F.col("own"), "left_semi").select("same", F.col("shown").alias("shown_th"))
    found = docs.select(F.xxhash64("text").alias("th"), "text").join(texts, F.col("th") == F.col("shown_th")).groupBy("same").agg(F.first("text").alias("text"))
    own = pinned(found.select("same", words(lowered(F.col("text"))).alias("w")))
    shingle = lambda at: F.xxhash64(F.array_join(F.slice("w", at, width), " "))
    sets = written(own.select("same", F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1))), shingle)).alias("has")))

    def links(pairs: DataFrame) -> DataFrame:
        """Those of pairs (a, b) whose texts are alike."""
        of = lambda side: written(pairs.select(side).distinct().join(sets, F.col(side) == F.col("same")).select(side, F.col("has").alias(f"has_{side}")))
        one = keyed_join(pairs, of("a"), "a")
        both = keyed_join(one, of("b"), "b")
        shared, total = F.size(F.array_intersect("has_a", "has_b")), F.size("has_a") + F.size("has_b")
        return written(both.select("a", "b", shared.alias("n"), total.alias("total")).where(F.col("n") >= F.lit(least) * (F.col("total") - F.col("n"))).select("a", "b"))

    def star(rows: DataFrame) -> DataFrame:
        """Every class at a point with the point's most popular one; rows has point, same and pop."""
        centres = rows.groupBy("point").agg(F.max(F.struct("pop", "same")).alias("top")).select("point", F.col("top.same").alias("other"))
        return keyed_join(rows.select("point", "same"), written(centres), "point").select("same", "other")

    near = met.withColumn("part", F.pmod(F.xxhash64("same"), F.ceil(F.col("c") / NEAR)))
    firsts = near.groupBy("point", "part").agg(F.min("same").alias("other"))
    tested = written(_ordered(star(met).union(near.join(firsts, ["point", "part"]).select("same", "other"))))
    found = links(tested)
    roots = written(components(found)).withColumnRenamed("node", "own")
    placed = met.join(roots, met.same == roots.own, "left").select("point", "same", F.coalesce("root", "same").alias("root"))
    open_ = placed.groupBy("point").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    left = keyed_join(placed, written(open_.select("point")), "point").select("same", "root").distinct()
    pairs = _apart(written(left.join(sets, "same")), least)
    new = written(_ordered(pairs).join(tested, ["a", "b"], "left_anti"))
    return components(roots.select(F.col("own").alias("a"), F.col("root").alias("b")).union(links(new)))


def _apart(texts: DataFrame, least: float) -> DataFrame:
    """Pairs same, other of texts (same, root, has) of different roots, all of similarity least or more among them.

    Sets that similar share one of the first n - least * n + 1 of their n shingles in any common order; with the rarest
    first, what many texts share comes last, so texts that have only a passage in common do not meet. Of those that meet,
    the join lets through what two upper bounds on the shared shingles allow; both are exact.
    """
    shingles = written(texts.select("same", F.explode("has").alias("h")))
    rarity = written(shingles.groupBy("h").agg(F.count("*").alias("c")))
    ranked = keyed_join(shingles, rarity, "h").groupBy("same").agg(F.array_sort(F.collect_list(F.struct("c", "h"))).alias("hs"))
    n = F.size("hs")
    begun = ranked.select("same", F.posexplode(F.slice("hs", 1, n - F.ceil(n * least - 1e-9).cast("int") + 1)).alias("at", "x")).where("x.c > 1")
    marked = written(texts.select("same", "root", "has").mapInArrow(_parities, "same long, root long, n int, bits array<long>"))
    places = written(begun.join(marked, "same").select("same", "root", "n", "bits", "at", F.col("x.h").alias("h")))
    mixed = places.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select(F.col("h").alias("mixed"))
    open_ = written(places.join(mixed, F.col("h") == F.col("mixed"), "left_semi"))
    one, two = open_.alias("one"), open_.alias("two")
    x, y = (lambda c: F.col(f"one.{c}")), (lambda c: F.col(f"two.{c}"))
    total = x("n") + y("n")
    needed = F.ceil(total * (least / (1 + least)) - 1e-9)
    # Bounds on the number of shared shingles: by the places of the one they meet at, and by the bits that differ, each of which takes a shingle that only one has.
    by_place = F.least(x("at"), y("at")) + F.least(x("n") - x("at"), y("n") - y("at"))
    by_bits = total - reduce(Column.__add__, [F.bit_count(x("bits")[k].bitwiseXOR(y("bits")[k])) for k in range(PARITY // 64)])
    close = (by_place >= needed) & (by_bits >= 2 * needed)
    return one.join(two, (x("h") == y("h")) & (x("root") < y("root")) & close).select(x("same").alias("same"), y("same").alias("other"))


def _parities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """same, root, n (shingles) and bits of each row of same, root, has: bit k is odd or even as are the hashes that are k modulo PARITY."""
    for batch in batches:
        own = [np.array(h.as_py(), np.int64) for h in batch.column(2)]
        bits = [np.packbits(np.bincount(h & (PARITY - 1), minlength=PARITY) & 1).view(np.int64) for h in own]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(h) for h in own], pa.int32()), pa.array(bits, pa.list_(pa.int64()))], ["same", "root", "n", "bits"])


def one_of_near_copies(docs: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """Like one_of_each, with the components of near_copies."""
    return _smallest(docs, near_copies(docs, width, least))


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
