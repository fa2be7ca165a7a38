"""Source divergence audit: how far the vocabulary of each source lies from the others of its language.

Plain relational steps. The matches of a regular expression (taken as the pieces between the matches of its complement: extracting
them one by one takes time that grows with the square of a text's length) are exploded to (lang, source, term) and counted with
map-side partial sums; the first of equal terms in a document's sorted list counts the document in the same pass. Each language keeps
the terms of at least LEAST documents. Every (lang, source) group gives every kept term of its language, absent ones with count zero.
An absent term's p is the same for all of a group's absent terms, so these are counted and not spelled out: a pair's sum over all kept
terms is that of a vocabulary which both lack, plus what each source's terms change, counted by p, plus what the terms change that both
have, for which the groups' own terms are joined to themselves on (lang, term). Every part is a whole number, so the sum is exact.
Windows rank sources and terms in each group. The work is, for each term, the square of the sources that have it.

All arithmetic is exact: with N the count's sum over the V kept terms, p = 1 + floor(SCALE * (count + 1) / (N + V)) is
worked out in decimals, so counts of 10^18 do not overflow; p and q are at most SCALE + 1, their squares fit in a long.

Null text, lang and source count as ''. Empty texts have no terms, but their group occurs. Every row is a document, repeated
ones as well. Texts of any length are used whole. Equal values are ranked by item in UTF-8 order. A language with no
kept terms gives its pairs with value 0 and no terms; a language of one source gives no pairs. An empty table gives no rows.
Other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lowered, pinned, table, written

#: Documents that a kept term occurs in at least; parts of a whole; ranks of terms that are reported.
LEAST, SCALE, TOP = 3, 1_000_000_000, 200
#: What stands between terms.
BETWEEN = "[\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, c (occurrences) and docs (documents it occurs in) over all rows of docs (lang, source, text)."""
    text = F.coalesce("text", F.lit(""))
    lower = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(lowered(text))  # the first is faster, for ASCII alone
    listed = pinned(docs.select("lang", "source", F.sort_array(F.array_remove(F.split(lower, BETWEEN), "")).alias("terms"))).where(F.size("terms") > 0)
    before = F.concat(F.array(F.lit(None).cast("string")), F.slice("terms", 1, F.size("terms") - 1))
    each = listed.select("lang", "source", F.explode(F.arrays_zip(F.col("terms").alias("term"), before.alias("before"))).alias("x"))
    return each.groupBy("lang", "source", "x.term").agg(F.count("*").alias("c"), F.sum(F.when(F.col("x.term") == F.col("x.before"), 0).otherwise(1)).alias("docs"))


def _share(count: str, base: str):
    """1 + floor(SCALE * (count + 1) / base), exact: in longs where the product fits, else in decimals."""
    small = f"{SCALE} * ({count} + 1L) div {base}"
    large = f"cast({count} + 1L as decimal(20,0)) * cast({SCALE} as decimal(10,0)) div cast({base} as decimal(20,0))"
    return F.expr(f"1L + if({count} < {(1 << 63) // SCALE - 1}L, {small}, {large})")


def shares(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """groups: lang, source, v (kept terms) and zero (p of an absent term; null if v is 0), one row for every (lang, source); present: lang, source, term, p, q, zero for every group and each kept term that it has."""
    docs = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = written(term_counts(docs))
    vocab = written(counts.groupBy("lang", "term").agg(F.sum("c").alias("all"), F.sum("docs").alias("docs")).where(F.col("docs") >= least).select("lang", "term", "all"))
    sizes = written(vocab.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all").alias("whole")))
    kept = written(counts.select("lang", "source", "term", "c").join(vocab, ["lang", "term"]))
    own = kept.groupBy("lang", "source").agg(F.sum("c").alias("n"))
    found = docs.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(sizes, "lang", "left").fillna({"n": 0, "v": 0, "whole": 0})
    based = found.select("lang", "source", "v", (F.col("n") + F.col("v")).alias("base"), (F.col("whole") + F.col("v")).alias("whole"), F.lit(0).cast("long").alias("none"))
    groups = written(based.select("lang", "source", "v", "base", "whole", F.when(F.col("v") > 0, _share("none", "base")).alias("zero")))
    placed = kept.join(groups.drop("v"), ["lang", "source"])
    return groups, placed.select("lang", "source", "term", _share("c", "base").alias("p"), _share("all", "whole").alias("q"), "zero")


def divergence(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part (pair or term), item, value and rank of every row of the audit of docs (lang, source, text)."""
    groups, present = shares(docs, least)
    far = lambda p, q: F.expr(f"({p} - {q}) * ({p} - {q}) div {q}")
    both = lambda p, q: (far(p, q), far(q, p))
    # Where both sources have the term: what they give, less what each alone (one row of a count below) and neither (v times) gave for it.
    side = present.select("lang", "term", "source", "p", "zero")
    one, two = side.alias("one"), side.alias("two")
    met = one.join(two, F.expr("one.lang = two.lang AND one.term = two.term AND one.source < two.source"))
    pairs = met.selectExpr("one.lang", "one.source", "two.source AS item", "one.p", "two.p AS p2", "one.zero", "two.zero AS zero2")
    more = [x - y - z + w for x, y, z, w in zip(both("p", "p2"), both("p", "zero2"), both("zero", "p2"), both("zero", "zero2"), strict=True)]
    shared = pairs.groupBy("lang", "source", "item").agg(F.sum(more[0]).alias("there"), F.sum(more[1]).alias("back"))
    ways = F.array(F.struct("source", "item", F.col("there").alias("value")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), F.col("back").alias("value")))
    shared = shared.select("lang", F.explode(ways).alias("w")).select("lang", "w.*")
    # Where one has the term: its terms of a count give the same, so the counts meet the other sources, not the terms.
    other = groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("zero2"))
    alone = present.groupBy("lang", "source", "p", "zero").agg(F.count("*").alias("m")).join(other, "lang").where("source <> item")
    less = lambda k: F.col("m") * (both("p", "zero2")[k] - both("zero", "zero2")[k])
    ways = F.array(F.struct("source", "item", less(0).alias("value")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), less(1).alias("value")))
    alone = alone.select("lang", F.explode(ways).alias("w")).select("lang", "w.*")
    # Every kept term as if neither had it; languages that keep no term give 0.
    every = groups.join(other, "lang").where("source <> item").select("lang", "source", "item", F.when(F.col("v") > 0, F.col("v") * far("zero", "zero2")).otherwise(0).cast("long").alias("value"))
    sums = shared.union(alone).union(every).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    terms = present.where("p > q").select("lang", "source", F.col("term").alias("item"), far("p", "q").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = sums.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    best = terms.select("lang", "source", F.lit("term").alias("part"), "item", "value", F.row_number().over(order).alias("rank")).where(F.col("rank") <= top)
    return ranked.union(best)


def op11_divergence(spark, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents", "lang", "source", "text"))


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents),
t AS (SELECT r, lang, source, unnest(terms) AS term FROM d),
vocab AS (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST}),
sizes AS (SELECT lang, count(*) AS v, sum(total) AS whole FROM vocab GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS c FROM t JOIN vocab USING (lang, term) GROUP BY lang, source, term),
groups AS (SELECT DISTINCT lang, source FROM d),
dense AS (SELECT g.lang, g.source, v.term, v.total, coalesce(c.c, 0) AS c FROM groups g JOIN vocab v ON v.lang = g.lang
          LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term),
p AS (SELECT lang, source, term, c, 1 + ({SCALE}::HUGEINT * (c + 1)) // (sum(c) OVER (PARTITION BY lang, source) + v)::HUGEINT AS p,
             1 + ({SCALE}::HUGEINT * (total + 1)) // (whole + v)::HUGEINT AS q FROM dense JOIN sizes USING (lang)),
pairs AS (SELECT g.lang, g.source, h.source AS item, coalesce(s.value, 0) AS value FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source
          LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
                     GROUP BY 1, 2, 3) s ON s.lang = g.lang AND s.source = g.source AND s.item = h.source),
both_parts AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs
          UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS n FROM both_parts)
SELECT lang, source, part, item, value::BIGINT AS value, n::INTEGER AS rank FROM ranked WHERE part = 'pair' OR n <= {TOP}
"""
