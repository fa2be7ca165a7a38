"""Merkle manifest of a dataset: a digest of every row, one root for all, and a proof that ties each row to the root.

A row's leaf is the sha256 of its fields, each with its length in bytes; a language's leaves stand in order of doc_id. They are
numbered by a distributed rank: sorted by ranges into files, the rows of each file counted, and the counts summed up to offsets.
A node is the sha256 of its run of FAN nodes one level below (the last run may be shorter, even one node).

The tree is walked in aligned blocks of FAN ** LEVELS nodes, each in one task: a recursive postorder traversal returns a
subtree's digest and, while it unwinds, appends to each leaf it contains the step that leads over the siblings to it. A block's
digest is a node LEVELS levels further up, so the blocks' roots feed another distributed traversal, until one node is
left; then the path of a block is appended to those of its leaves. The languages' subroots are the leaves of one more such tree.

A step is the siblings before and the siblings after a node, hex digests run together: before|after. The digest of a node's run is
the hash of before, its own digest and after, so a leaf and its path give the root again, and the steps without | give the proof.

Null fields are written as -. A null doc_id stands first in its language, rows of equal doc_id by their leaf; equal rows have
equal leaves and different places. A null lang is a language of its own, before all others. Empty and long texts are hashed
whole. An empty table gives no rows. Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import ship
from .common import table, written

#: Nodes of a run, and levels that one block spans.
FAN, LEVELS = 2, 10


def sha(*parts: Column) -> Column:
    return F.sha2(F.concat(*[p.cast("binary") for p in parts]), 256)


def _field(value: Column) -> Column:
    """A field as it is hashed: its length in bytes, a colon and its value, or - for null."""
    return F.coalesce(F.concat(F.octet_length(value.cast("string")).cast("string"), F.lit(":"), value.cast("string")), F.lit("-"))


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, lang, leaf and tampered (the leaf with n_chars raised by one where 7 divides the crc32 of doc_id, else null) of every row."""
    of = lambda n: sha(*[_field(c) for c in (F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text"))])
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    return docs.select("doc_id", "lang", of(F.col("n_chars")).alias("leaf"), F.when(hit, of(F.col("n_chars") + 1)).alias("tampered"))


def numbered(rows: DataFrame, tree: str, *order: str) -> DataFrame:
    """rows with i (place in their tree, from 0, by the columns of order; rows equal in them in any order) and n (rows of the tree).

    Written in sorted files, whose row counts by tree give the offsets: no window holds more than a row a file and tree.
    """
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    keys = [tree, *order, "_tie"]  # _tie cuts a stretch of equal rows
    place = {"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}
    files = written(tied.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie").withColumns(place))
    counts = files.groupBy(tree, "_part").agg(F.count("*").alias("_c"), F.min("_row").alias("_low"))
    whole = Window.partitionBy(tree)
    before = F.sum("_c").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = written(counts.select(F.col(tree).alias("_tree"), F.col("_part").alias("_of"), (F.coalesce(before, F.lit(0)) - F.col("_low")).alias("_shift"), F.sum("_c").over(whole).alias("n")))
    joined = files.join(offsets, (F.col(tree) == F.col("_tree")) & (F.col("_part") == F.col("_of")))
    return joined.withColumn("i", F.col("_row") + F.col("_shift")).drop("_part", "_row", "_tree", "_of", "_shift")


def walk(digests: list[str], levels: int, fan: int = FAN) -> tuple[str, list[list[str]]]:
    """The digest of a block of at most fan ** levels nodes as the one node levels higher, and for each of the nodes the steps of its path up to there."""
    paths: list[list[str]] = [[] for _ in digests]

    def visit(low: int, level: int) -> str:
        """The digest of the subtree of that height whose first leaf is low; appends a step to the path of each of its leaves."""
        if not level:
            return digests[low]
        width = fan ** (level - 1)
        starts = range(low, min(low + fan * width, len(digests)), width)
        nodes = [visit(at, level - 1) for at in starts]
        for k, at in enumerate(starts):
            step = "".join(nodes[:k]) + "|" + "".join(nodes[k + 1 :])
            for path in paths[at : at + width]:
                path.append(step)
        return hashlib.sha256("".join(nodes).encode()).hexdigest()

    return visit(0, levels), paths


def _height(n: int, fan: int, most: int) -> int:
    """Levels until n nodes are one, most at most."""
    found = 0
    while n > 1 and found < most:
        n, found = -(-n // fan), found + 1
    return found


def paths(nodes: DataFrame, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """nodes (tree, i from 0, n nodes in the tree, digest, and columns to carry along) with path (steps up to the tree's root) and root."""
    ship(nodes.sparkSession)
    size = fan**levels

    def block(group: pa.Table) -> pa.Table:
        group = group.sort_by("i")
        root, found = walk(group["digest"].to_pylist(), _height(group["n"][0].as_py(), fan, levels), fan)
        group = group.drop(["block"]).append_column("path", pa.array(found, pa.list_(pa.string())))
        return group.append_column("root", pa.array([root] * len(found)))

    schema = ", ".join(f"{name} {kind}" for name, kind in nodes.dtypes)
    keyed = nodes.withColumn("block", F.floor(F.col("i") / size))
    walked = written(keyed.groupBy("tree", "block").applyInArrow(block, f"{schema}, path array<string>, root string"))
    if (walked.agg(F.max("n")).first()[0] or 0) <= size:
        return walked
    higher = walked.where(F.col("i") % size == 0).select("tree", F.floor(F.col("i") / size).alias("i"), F.ceil(F.col("n") / size).alias("n"), F.col("root").alias("digest"))
    up = paths(higher, fan, levels).select(F.col("tree").alias("u_tree"), F.col("i").alias("u_block"), F.col("path").alias("u_path"), F.col("root").alias("u_root"))
    joined = walked.join(up, (F.col("tree") == F.col("u_tree")) & (F.floor(F.col("i") / size) == F.col("u_block")))
    return joined.withColumns({"path": F.concat("path", "u_path"), "root": F.col("u_root")}).drop("u_tree", "u_block", "u_path", "u_root")


def proof(path: Column) -> Column:
    """The digest over the siblings along a path."""
    return F.sha2(F.translate(F.array_join(path, ""), "|", "").cast("binary"), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda node, step: sha(F.substring_index(step, "|", 1), node, F.substring_index(step, "|", -1)))


def manifest(docs: DataFrame, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, tampered, subroot, root and path (all steps from leaf to root) of every row of docs (doc_id, source, lang, n_chars, text)."""
    # A tree's name orders like its lang, null first.
    named = leaves(docs).withColumn("tree", F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))).drop("lang").withColumnRenamed("leaf", "digest")
    rows = paths(numbered(named, "tree", "doc_id", "digest"), fan, levels).withColumnsRenamed({"path": "low", "root": "subroot"})
    subroots = rows.where("i = 0").select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("subroot").alias("digest"))
    top = written(paths(numbered(subroots, "tree", "name"), fan, levels).select("name", F.col("path").alias("high"), "root"))
    joined = rows.join(top, F.col("tree") == F.col("name"))
    return joined.select("doc_id", F.col("digest").alias("leaf"), "tampered", "subroot", "root", F.concat("low", "high").alias("path"))


def op13_manifest(spark, sf_dir: str) -> DataFrame:
    rows = manifest(table(spark, sf_dir, "documents", "doc_id", "source", "lang", "n_chars", "text"))
    again = rows.withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("path")))
    return again.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


SQL = """
WITH RECURSIVE bits AS (SELECT i AS b, list_reduce(range(8), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, i) AS v FROM range(256) t(i)),
crc AS (SELECT list(v ORDER BY b) AS t FROM bits),
fields AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, n_chars,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail,
    coalesce(xor(list_reduce(string_split(doc_id::VARCHAR, ''), lambda c, x: xor(t[(xor(c, ascii(x)) & 255)::INTEGER + 1], c >> 8), 4294967295), 4294967295) % 7 = 0, false) AS hit
    FROM (SELECT doc_id::VARCHAR AS doc_id, source, lang, n_chars, text FROM documents), crc),
leaves AS (SELECT doc_id::BIGINT AS doc_id, tree, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
    CASE WHEN hit THEN sha256(head || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || tail) END AS tampered FROM fields),
rows AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
low AS (SELECT tree, 0 AS level, i, n, leaf AS digest FROM rows
    UNION ALL SELECT tree, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY i)) FROM low WHERE n > 1 GROUP BY tree, level, i // 2, n),
subroots AS MATERIALIZED (SELECT tree, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (SELECT 0 AS level, i, n, subroot AS digest FROM subroots
    UNION ALL SELECT level + 1, i // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY i)) FROM high WHERE n > 1 GROUP BY level, i // 2, n),
steps AS (SELECT r.tree, r.i, own.level, 0 AS upper, CASE WHEN s.digest IS NULL THEN '-' WHEN s.i < own.i THEN 'l' || s.digest ELSE 'r' || s.digest END AS step
    FROM rows r JOIN low own ON own.tree = r.tree AND own.n > 1 AND own.i = r.i >> own.level
    LEFT JOIN low s ON s.tree = own.tree AND s.level = own.level AND s.i = xor(own.i, 1)
    UNION ALL SELECT r.tree, r.i, own.level, 1, CASE WHEN s.digest IS NULL THEN '-' WHEN s.i < own.i THEN 'l' || s.digest ELSE 'r' || s.digest END
    FROM rows r JOIN subroots t USING (tree) JOIN high own ON own.n > 1 AND own.i = t.i >> own.level
    LEFT JOIN high s ON s.level = own.level AND s.i = xor(own.i, 1)),
paths AS (SELECT tree, i, list(step ORDER BY upper, level) AS path FROM steps GROUP BY tree, i),
done AS (SELECT doc_id, leaf, subroot, (SELECT digest FROM high WHERE n = 1) AS root, coalesce(path, []) AS path,
    list_reduce(coalesce(path, []), lambda a, s: sha256(CASE s[1] WHEN 'l' THEN s[2:] || a WHEN 'r' THEN a || s[2:] ELSE a END), coalesce(tampered, leaf)) AS folded_root
    FROM rows JOIN subroots USING (tree) LEFT JOIN paths ON paths.tree = rows.tree AND paths.i = rows.i)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda s: s[2:]), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM done
"""
