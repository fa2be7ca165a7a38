"""Line dedup by content-defined chunks of lines, extended to whole passages.

Lines with words are cut into chunks where a rolling hash over the hashes of a line and its
predecessor, modulo FINE, falls below the line's number of words. Boundaries depend on the lines
around them alone and so survive shifts; a line of FINE words or more is a chunk of its own. Chunks
that occur more than once in the corpus anchor the search: they and BESIDE chunks on either side make up
a document's suspected stretches (a passage's first and last lines lie in chunks that reach beyond
it). From each line of a stretch the passage of LONG words (an argument, 1 to 63) or just over is taken forwards and
backwards. Passages that occur more than once are removed but for the one with the smallest
doc_id (then the smallest text hash and place), so a repeated run of LONG words or more goes line by
line up to its ends, even if its parts were first seen in different documents.

Every line's bytes are compared with those of all lines of the same hash, and passages are compared
by the whole sequence of their lines' hashes, so passages that count as equal have equal lines. A
line whose hash (60 bits) belongs to other bytes as well is never part of a removed passage.
Passages of LONG words or more made of lines under FINE words are missed if no chunk begins and ends
inside them: by computation 2 of 100 such passages at two words a line, 1 of 300 at five, none at ten.

A null text has no lines and stays null. Lines without a word count for nothing, but go with a
passage that they lie in. A text all of whose lines go becomes empty. Rows equal in doc_id and text
are one document: each gets the same result. A null doc_id is never the one that stays unless all
are null. An empty table gives no rows. The input's own columns come back unchanged but for text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keyed_join, pinned, table, written

LONG, FINE = 50, 10
#: Chunks on either side of a repeated one that may hold a passage's ends: the first line of a passage can end a chunk in one document and not in another.
BESIDE = 2
WORD = "[^\\x20\\x09-\\x0D]+"


def _line_hash(line: Column) -> Column:
    """The first 60 bits of a line's MD5 as a number."""
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 15), 16, 10).cast("long")


def _lined(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), the lines with words (place, hash, number of words) and the chunks' last lines among them; one row a text."""
    lines = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("th"), F.split("text", "\n", -1).alias("lines"))
    counted = pinned(lines.select("doc_id", "th", F.transform("lines", lambda x, i: F.struct(i.alias("at"), x.alias("line"), F.regexp_count(x, F.lit(WORD)).alias("w"))).alias("marks")))
    worded = pinned(counted.select("doc_id", "th", F.filter("marks", lambda m: m["w"] > 0).alias("marks"))).where(F.size("marks") > 0)
    parts = {"at": F.transform("marks", lambda m: m["at"]), "v": F.transform("marks", lambda m: _line_hash(m["line"])), "w": F.transform("marks", lambda m: m["w"])}
    hashed = pinned(worded.select("doc_id", "th", *[c.alias(name) for name, c in parts.items()]))

    def ends(i: Column) -> Column:
        rolled = (F.get("v", i) % 1009) * 31 + F.coalesce(F.get("v", i - 1) % 1009, F.lit(0))
        return (i == F.size("v") - 1) | (F.get("w", i + 1) >= FINE) | (rolled % FINE < F.get("w", i))

    return hashed.withColumn("ends", F.filter(F.sequence(F.lit(0), F.size("v") - 1), ends))


def _clashes(docs: DataFrame) -> DataFrame:
    """v of lines that share a hash but not their bytes; hardly ever a row."""
    lines = docs.where("text is not null").select(F.explode(F.split("text", "\n", -1)).alias("line")).where(F.col("line").rlike(WORD))
    return lines.groupBy("line").agg(F.lit(1).alias("one")).groupBy(_line_hash(F.col("line")).alias("clash")).agg(F.count("*").alias("c")).where("c > 1").select("clash")


def _stretches(lined: DataFrame) -> DataFrame:
    """doc_id, th, at, v and w of each suspected stretch of lines."""
    start = lambda k: F.coalesce(F.get("ends", k - 1) + 1, F.lit(0))
    keys = F.transform("ends", lambda end, k: F.xxhash64(F.slice("v", start(k) + 1, end - start(k) + 1)))
    places = written(lined.select("doc_id", "th", F.posexplode(keys).alias("k", "chunk")))
    repeated = written(places.groupBy("chunk").agg(F.count("*").alias("c")).where("c > 1"))
    own = keyed_join(places, repeated, "chunk").groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("k")).alias("ks"))
    found = own.select(F.col("doc_id").alias("own"), F.col("th").alias("own_th"), "ks")
    joined = pinned(lined.join(found, F.col("doc_id").eqNullSafe(F.col("own")) & (F.col("th") == F.col("own_th"))).drop("own", "own_th"))
    # Repeated chunks whose neighbours touch share a stretch.
    firsts = F.filter("ks", lambda k, i: F.coalesce(F.get("ks", i - 1) < k - 2 * BESIDE - 1, F.lit(True)))
    lasts = F.filter("ks", lambda k, i: F.coalesce(F.get("ks", i + 1) > k + 2 * BESIDE + 1, F.lit(True)))
    ranged = joined.select("doc_id", "th", "at", "v", "w", "ends", F.explode(F.arrays_zip(firsts.alias("first"), lasts.alias("last"))).alias("range"))
    low = F.when(F.col("range.first") > BESIDE, F.get("ends", F.col("range.first") - BESIDE - 1) + 1).otherwise(0)
    high = F.get("ends", F.least(F.col("range.last") + BESIDE, F.size("ends") - 1))
    bounds = ranged.select("doc_id", "th", "at", "v", "w", low.alias("low"), (high - low + 1).alias("n"))
    return pinned(bounds.select("doc_id", "th", *[F.slice(c, F.col("low") + 1, F.col("n")).alias(c) for c in ("at", "v", "w")]))


def _passages(lined: DataFrame, least: int) -> DataFrame:
    """doc_id, th, start and n (lines taken, those without words included) and key (the hashes of its lines) of every passage in a suspected stretch."""
    if not 0 < least < 64:
        raise ValueError("a passage has 1 to 63 words at least")
    # A passage has at most least lines with words: sum and number of lines share one number, sum * 64 + lines.
    reach = lambda ws: F.aggregate(ws, F.lit(0).cast("long"), lambda s, w: F.when(s >= least * 64, s).otherwise(s + w * 64 + 1))
    code = lambda first, s: F.when(s >= least * 64, first(s % 64) * 64 + s % 64)
    places = F.sequence(F.lit(0), F.size("w") - 1)
    forwards = F.transform(places, lambda i: code(lambda n: i.cast("long"), reach(F.slice("w", i + 1, F.lit(least)))))
    low = lambda i: F.greatest(i - least + 1, F.lit(0))
    backwards = F.transform(places, lambda i: code(lambda n: i - n + 1, reach(F.reverse(F.slice("w", low(i) + 1, i - low(i) + 1)))))
    coded = pinned(_stretches(lined).withColumn("codes", F.array_distinct(F.filter(F.concat(forwards, backwards), lambda c: c.isNotNull()))))

    def passage(c: Column) -> Column:
        first, n = F.floor(c / 64).cast("int"), (c % 64).cast("int")
        start = F.get("at", first)
        return F.struct(start.alias("start"), (F.get("at", first + n - 1) - start + 1).alias("n"), F.slice("v", first + 1, n).alias("key"))

    # Passages are cut out in the stretch's own row; exploding places would copy the whole stretch for each.
    return coded.select("doc_id", "th", F.explode(F.transform("codes", passage)).alias("p")).select("doc_id", "th", "p.*")


def removals(docs: DataFrame, least: int = LONG) -> DataFrame:
    """doc_id, th and cuts (sorted structs of start and n, lines to take out; they may overlap) of texts that repeat passages of at least so many words; docs has doc_id and text."""
    passages = written(_passages(written(_lined(docs)), least))
    grouped = passages.groupBy("key").agg(F.count("*").alias("c"), F.min("doc_id").alias("first")).where("c > 1")
    doubtful = grouped.select("key", F.explode("key").alias("v")).join(_clashes(docs), F.col("v") == F.col("clash")).select(F.col("key").alias("bad")).distinct()
    repeated = written(grouped.join(doubtful, F.col("key") == F.col("bad"), "left_anti"))
    hits = written(keyed_join(passages, repeated, "key"))
    # Only the document that keeps a passage needs to know which of its places stays, so the many others meet no join.
    own = F.col("doc_id").eqNullSafe(F.col("first"))
    mine, place = hits.where(own), F.struct("th", "start")
    kept = mine.groupBy(F.col("key").alias("k_key")).agg(F.min(place).alias("stays"))
    repeats = mine.join(kept, (F.col("key") == F.col("k_key")) & (place != F.col("stays")))
    gone = hits.where(~own).select("doc_id", "th", "start", "n").union(repeats.select("doc_id", "th", "start", "n"))
    return gone.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set(F.struct("start", "n"))).alias("cuts"))


def line_dedup(docs: DataFrame, least: int = LONG) -> DataFrame:
    """row (the input's columns as a struct), n_lines, n_removed and kept (the text without repeated passages of least words or more) of every row of docs."""
    cuts = removals(docs.select("doc_id", "text"), least).select(F.col("doc_id").alias("cut_id"), F.col("th").alias("cut_th"), "cuts")
    rows = docs.select(F.struct("*").alias("row"))
    joined = rows.join(cuts, F.col("row.doc_id").eqNullSafe(F.col("cut_id")) & (F.xxhash64("row.text") == F.col("cut_th")), "left")
    lined = pinned(joined.select("row", F.coalesce("cuts", F.array().cast("array<struct<start:int,n:int>>")).alias("cuts"), F.split("row.text", "\n", -1).alias("lines")))

    def stretch(k: Column) -> Column:
        """The lines before cut k; where passages overlap, later ones end later, so only the cut before matters."""
        before, after = F.get("cuts", k - 1), F.get("cuts", k)
        start = F.coalesce(before["start"] + before["n"], F.lit(0))
        return F.slice("lines", start + 1, F.greatest(F.coalesce(after["start"], F.size("lines")) - start, F.lit(0)))

    left = F.flatten(F.transform(F.sequence(F.lit(0), F.size("cuts")), stretch))
    cut = pinned(lined.withColumn("left", F.when(F.size("cuts") > 0, left)))
    return cut.select(
        "row",
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.when(F.size("cuts") > 0, F.size("lines") - F.size("left")).otherwise(0).cast("long").alias("n_removed"),
        F.when(F.size("cuts") > 0, F.array_join("left", "\n")).otherwise(F.col("row.text")).alias("kept"),
    )


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    found = line_dedup(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select(F.col("row.doc_id").alias("doc_id"), F.when(F.col("row.text").isNull(), 0).otherwise(F.col("n_lines")).cast("long").alias("n_lines"), "n_removed", F.col("kept").alias("text"))


SQL = rf"""
WITH l AS (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i, unnest(string_split(text, chr(10))) AS line
  FROM documents WHERE text IS NOT NULL),
m AS (
  SELECT *, ('0x' || substr(md5(line), 1, 15))::BIGINT AS v, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS j
  FROM (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM l) WHERE w > 0),
e AS (
  SELECT *, lead(j) OVER d IS NULL OR lead(w) OVER d >= {FINE} OR ((v % 1009) * 31 + coalesce(lag(v) OVER d % 1009, 0)) % {FINE} < w AS ends
  FROM m WINDOW d AS (PARTITION BY doc_id ORDER BY j)),
n AS (
  SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM e),
c AS (SELECT doc_id, k, string_agg(line, chr(10) ORDER BY j) AS chunk FROM n GROUP BY doc_id, k),
h AS (SELECT doc_id, k, (count(*) OVER (PARTITION BY chunk) > 1)::INT AS hot FROM c),
s AS (SELECT doc_id, k, max(hot) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN {BESIDE} PRECEDING AND {BESIDE} FOLLOWING) AS hot FROM h),
g AS (SELECT doc_id, k, k - row_number() OVER (PARTITION BY doc_id ORDER BY k) AS stretch FROM s WHERE hot = 1),
x AS (
  SELECT n.doc_id, stretch, i, j, line, w, sum(w) OVER (PARTITION BY n.doc_id, stretch ORDER BY j) AS total
  FROM n JOIN g ON g.doc_id = n.doc_id AND g.k = n.k),
p AS (
  SELECT a.doc_id, a.j AS a, min(b.j) AS b FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.stretch = b.stretch AND b.j BETWEEN a.j AND a.j + {LONG - 1}
  WHERE b.total - a.total + a.w >= {LONG} GROUP BY a.doc_id, a.j
  UNION
  SELECT b.doc_id, max(a.j), b.j FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.stretch = b.stretch AND b.j BETWEEN a.j AND a.j + {LONG - 1}
  WHERE b.total - a.total + a.w >= {LONG} GROUP BY b.doc_id, b.j),
t AS (
  SELECT p.doc_id, a, min(x.i) AS i, max(x.i) AS last, string_agg(line, chr(10) ORDER BY x.j) AS passage
  FROM p JOIN x ON x.doc_id = p.doc_id AND x.j BETWEEN p.a AND p.b GROUP BY p.doc_id, a, b),
r AS (SELECT *, row_number() OVER (PARTITION BY passage ORDER BY doc_id, i) > 1 AS gone FROM t),
q AS (SELECT DISTINCT l.doc_id, l.i FROM l JOIN r ON r.doc_id = l.doc_id AND gone AND l.i BETWEEN r.i AND r.last),
o AS (
  SELECT l.doc_id, count(*) AS n_lines, count(q.i) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (q.i IS NULL), '') AS text
  FROM l LEFT JOIN q ON q.doc_id = l.doc_id AND q.i = l.i GROUP BY l.doc_id)
SELECT doc_id, n_lines::BIGINT AS n_lines, n_removed::BIGINT AS n_removed, text FROM o
UNION ALL SELECT doc_id, 0::BIGINT, 0::BIGINT, NULL FROM documents WHERE text IS NULL
"""
