"""Corpus pipeline: toxicity filter, line dedup, near-dedup, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and works on every row its predecessor kept; all but
the last return the columns of documents, extra ones included. Texts of any length are used
whole. An empty table gives an empty table. What else a stage does with odd rows, its docstring says.
"""

from __future__ import annotations

import public_tokenizers
from citemill.llm import common, decontaminate, line_dedup, sentencepiece_codec, simhash, toxicity
from pyspark.sql import functions as F

#: Trained scores, connected components and byte-pair segmentation have no SQL counterpart.
ORACLE_SQL = None


def drop_toxic(spark, docs, sf_dir):
    """Documents that the toxicity operator does not predict to be toxic. Null and empty texts have no segments and stay; repeated rows share one verdict."""
    model = toxicity.train(docs, common.table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return toxicity.toxicity(docs, model, carry=True).where("predicted = 0").select("row.*")


def drop_repeated_lines(spark, docs, sf_dir):
    """All documents, without passages that an earlier document has; n_chars follows the text. A null text stays null, n_chars 0; a text all of whose lines go is empty; equal rows keep equal texts."""
    found = line_dedup.line_dedup(docs)
    new = {"text": F.col("kept"), "n_chars": F.coalesce(F.length("kept"), F.lit(0)).cast("long")}
    return found.select(*[new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns])


def drop_near_duplicates(spark, docs, sf_dir):
    """The document with the smallest doc_id of each group of near-duplicates: texts that meet within two bits of their SimHash, or at a MinHash band, and whose five-word shingles have a similarity of 0.8 or more.

    Null, empty and blank texts are one group; of rows equal in doc_id and text one stays; a null doc_id stays only where its group has no other.
    """
    return simhash.one_of_near_copies(docs, width=5, least=0.8)


def drop_contaminated(spark, docs, sf_dir):
    """Documents that hold no benchmark item. Null and empty texts hold none; of equal rows all stay or none."""
    found = decontaminate.contained(docs, common.table(spark, sf_dir, "benchmark", "item_id", "text"))
    gone = found.select(F.col("doc_id").alias("g_id"), F.col("th").alias("g_th")).distinct()
    rows = docs.select(F.struct("*").alias("row"))
    return rows.join(gone, F.col("row.doc_id").eqNullSafe(F.col("g_id")) & (F.xxhash64("row.text") == F.col("g_th")), "left_anti").select("row.*")


def encode(spark, docs, sf_dir):
    """Token counts and digests of ids and decoded text of each document; null counts as empty, repeated rows give repeated results."""
    return sentencepiece_codec.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode),
]


def run(spark, sf_dir: str):
    """All stages over the whole documents table; each stage's rows are written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
