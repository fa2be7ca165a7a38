"""Quality by weak supervision: rules vote or abstain, expectation-maximisation weighs them.

Each rule looks at one measure of a text and votes good (1), bad (-1) or abstains (0). The
model is one hidden class, good or bad, with votes independent given the class. Since there
are at most 3 ** len(RULES) vote patterns, the corpus enters EM as a table of pattern counts
over all texts that pass the base checks, however many there are; EM starts from texts without a bad vote as good. A text is kept
if its posterior probability of being good is at least one half and it passes the base checks.

Measures (words are runs without white space): word_chars, n_symbols, n_dup_lines (lines with
a word that equal an earlier line), n_repeat_words (words inside three-word windows that occur
twice or more in the text), and the letters, capitals, digits, exclamation marks, bars and
sentence ends that the rules use. Windows are told apart by 64-bit hashes within one text.

Null and empty texts have no words and fail the base checks. Repeated rows get equal results;
an empty table gives no rows; other columns are ignored; long texts are measured whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, pinned, table, words, written

SYMBOLS = "#*$%&|<>"
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Rule, its measure (SQL over the measures), and its votes: bad if the measure is over the first or under the second bound, good if between the other two.
RULES = (
    ("symbols", "n_symbols / n_words", 0.3, -1.0, 0.0, 0.1),
    ("duplicate_lines", "n_dup_lines / n_lines", 0.3, -1.0, 0.0, 0.1),
    ("repeated_words", "n_repeat_words / n_words", 0.3, -1.0, 0.0, 0.15),
    ("word_length", "word_chars / n_words", 12.0, 2.5, 3.0, 9.0),
    ("capitals", "n_capitals / n_letters", 0.5, -1.0, 0.0, 0.2),
    ("letters", "n_letters / word_chars", 2.0, 0.6, 0.8, 2.0),
    ("digits", "n_digits / word_chars", 0.2, -1.0, 0.0, 0.1),
    ("exclamations", "n_exclamations / n_words", 0.2, -1.0, 0.0, 0.05),
    ("bars", "n_bars / n_words", 0.2, -1.0, 0.0, 0.02),
    ("sentence_ends", "n_ended / n_lines", 2.0, 0.3, 0.6, 1.0),
)
EM_ROUNDS = 50


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and the measures of every row of docs (doc_id, text)."""
    text = F.coalesce("text", F.lit(""))
    without = lambda pattern: F.length(F.regexp_replace(text, pattern, ""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    first = pinned(docs.select(
        "doc_id", words(F.col("text")).alias("w"), lines.alias("lines"),
        without(SPACES).alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).alias("n_symbols"),
        (F.length(text) - without("\\p{L}+")).alias("n_letters"),
        (F.length(text) - without("\\p{Lu}+")).alias("n_capitals"),
        (F.length(text) - F.length(F.translate(text, "0123456789", ""))).alias("n_digits"),
        (F.length(text) - F.length(F.translate(text, "!", ""))).alias("n_exclamations"),
        (F.length(text) - F.length(F.translate(text, "|", ""))).alias("n_bars"),
    ))
    word = lambda i: F.get("w", i)
    window = lambda i: F.struct(F.xxhash64(word(i), word(i + 1), word(i + 2)).alias("h"), i.alias("i"))
    places = F.when(F.size("w") > 2, F.sequence(F.lit(0), F.size("w") - 3)).otherwise(F.array().cast("array<int>"))
    hashed = pinned(first.select(
        "*", F.size("w").alias("n_words"), F.size("lines").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.size(F.filter("lines", lambda x: x.rlike("[.!?\"'»)][\\x20\\x09-\\x0D]*$"))).alias("n_ended"),
        F.sort_array(F.transform(places, window)).alias("windows"),
    ).drop("w", "lines"))
    near = lambda x, k: F.get("windows", k)["h"].eqNullSafe(x["h"])
    again = F.filter("windows", lambda x, k: near(x, k - 1) | near(x, k + 1))
    placed = pinned(hashed.withColumn("again", F.sort_array(F.transform(again, lambda x: x["i"]))).drop("windows"))
    covers = F.transform("again", lambda i, k: F.least(F.lit(3), F.coalesce(F.get("again", k + 1) - i, F.lit(3))))
    counted = placed.withColumn("n_repeat_words", F.aggregate(covers, F.lit(0), lambda s, x: s + x)).drop("again")
    return counted.select("doc_id", *[F.col(c).cast("long").alias(c) for c in counted.columns if c != "doc_id"])


def _vote(rule: tuple) -> Column:
    _, measure, over, under, low, high = rule
    x = F.expr(f"coalesce(try_divide({measure.replace(' / ', ', ')}), 0.0D)")
    return F.when((x > over) | (x < under), -1).when((x >= low) & (x <= high), 1).otherwise(0).cast("int").alias(f"vote_{rule[0]}")


def fit(patterns: dict[tuple[int, ...], int]) -> tuple[float, list[dict[int, tuple[float, float]]]]:
    """Share of good texts, and for each rule the chance of each vote given good and given bad, by EM over counts of vote patterns."""
    n_rules = len(next(iter(patterns), RULES))
    good = {p: 0.05 if min(p) < 0 else 0.95 for p in patterns}  # bad votes are rare, so one outweighs the usual good ones
    share, chances = 0.5, [{v: (1.0, 1.0) for v in (-1, 0, 1)} for _ in range(n_rules)]
    for _ in range(EM_ROUNDS if patterns else 0):
        total = sum(patterns.values())
        mass = sum(n * good[p] for p, n in patterns.items())
        share = (mass + 1) / (total + 2)
        chances = []
        for r in range(n_rules):
            votes = {v: [0.5, 0.5] for v in (-1, 0, 1)}
            for p, n in patterns.items():
                votes[p[r]][0] += n * good[p]
                votes[p[r]][1] += n * (1 - good[p])
            chances.append({v: (a / (mass + 1.5), b / (total - mass + 1.5)) for v, (a, b) in votes.items()})
        good = {p: 1 / (1 + math.exp(-max(-500.0, min(500.0, math.log(share / (1 - share)) + sum(math.log(chances[r][v][0] / chances[r][v][1]) for r, v in enumerate(p)))))) for p in patterns}
    return share, chances


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, the measures, votes, base_failed, posterior and kept of every row of docs (doc_id, text)."""
    votes = [f"vote_{r[0]}" for r in RULES]
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    measured = written(measures(docs).select("*", *map(_vote, RULES), failed.alias("base_failed")))
    counts = measured.where("NOT base_failed").groupBy(*votes).count().collect()  # at most 3 ** len(RULES) rows
    share, chances = fit({tuple(row[v] for v in votes): row["count"] for row in counts})
    odds = F.lit(math.log(share / (1 - share)))
    for name, by_vote in zip(votes, chances, strict=True):
        weight = {v: math.log(a / b) for v, (a, b) in by_vote.items()}
        odds = odds + F.when(F.col(name) == 1, weight[1]).when(F.col(name) == -1, weight[-1]).otherwise(weight[0])
    scored = measured.withColumn("posterior", 1 / (1 + F.exp(-odds)))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    found = quality(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")
