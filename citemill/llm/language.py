"""Language identification by interpolated Kneser-Ney character models.

For each language, n-grams of up to ORDER characters are counted: the highest order by
occurrences, lower ones by the number of different characters before them. Letters are
lower-cased, everything else becomes one space. Four characters of 16 bits make a 64-bit key
(letters beyond the first plane are folded into 16 bits), and each order's discounted
probabilities and back-off weights lie in sorted arrays of keys. A text's language is that of
the lowest cross-entropy a character. Texts whose cross-entropy exceeds what REJECT of the
calibration texts of the language reach are marked as rejected: none of the languages fits.

Learning takes all texts with a language and crc32(doc_id as text) mod 4 other than 2, each
different text of a language once; n-grams are counted in a grouped sum. A fifth of them, by hash
of the text, calibrates instead, unless the language has fewer than 10.
Scoring is over whole texts. The score is the posterior chance of the language as if the text had
EVIDENCE characters at most of its average evidence, as neighbouring characters say much the same. Distinct n-grams of a block of texts are looked up once.

Null texts and texts without a letter give `und` with score 0. Repeated rows get equal results;
ties go to the language first in alphabetical order; without any learned language all are `und`;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from .common import table

ORDER, REJECT, EVIDENCE = 4, 0.999, 100
UNIFORM = 1 / 2000
#: Characters scored at a time.
BLOCK = 3_000_000
SPACE = 32
_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """For each code point the 16-bit code of its lower-case letter; a space for all that is no letter."""
    if not _letters:
        codes = np.full(0x110000, SPACE, np.uint16)
        for i in range(0x110000):
            if (c := chr(i)).isalpha():
                low = ord(c.lower()[0])
                codes[i] = low if low < 0x10000 else 0xE000 + low % 0x1900
        _letters.append(codes)
    return _letters[0]


def characters(text: str) -> np.ndarray:
    """Codes of a text: words between single spaces; empty if it has no letter."""
    codes = letter_table()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    codes = codes[(codes != SPACE) | (np.r_[SPACE, codes[:-1]] != SPACE)]
    if not len(codes) or (len(codes) == 1 and codes[0] == SPACE):
        return codes[:0]
    return codes if codes[-1] == SPACE else np.r_[codes, np.uint16(SPACE)]


def grams(codes: np.ndarray) -> np.ndarray:
    """Key of the ORDER characters that end at each character; spaces stand before the first."""
    p = np.r_[np.full(ORDER - 1, SPACE, np.uint64), codes.astype(np.uint64)]
    n = len(codes)
    keys = np.zeros(n, np.uint64)
    for k in range(ORDER):
        keys = keys << np.uint64(16) | p[k : k + n]
    return keys


def _mask(order: int) -> np.uint64:
    return np.uint64((1 << 16 * order) - 1)


def _at(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), missing)
    row = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[row] == wanted, values[row], missing)


class LanguageModel:
    def __init__(self, keys: np.ndarray, counts: np.ndarray | None = None):
        """From the keys of all n-grams of highest order, repeats included; or from sorted different keys with their counts."""
        found, counts = np.unique(keys, return_counts=True) if counts is None else (keys, counts)
        self.orders: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for order in range(ORDER, 0, -1):
            if order < ORDER:
                found, counts = np.unique(found & _mask(order), return_counts=True)
            once, twice = int((counts == 1).sum()), int((counts == 2).sum())
            discount = once / (once + 2 * twice) if once and twice else 0.5
            context, first, types = np.unique(found >> np.uint64(16), return_index=True, return_counts=True)
            total = np.add.reduceat(counts, first)
            part = np.maximum(counts - discount, 0) / np.repeat(total, types)
            self.orders.insert(0, (found, part, context, discount * types / total))

    def bits(self, keys: np.ndarray) -> np.ndarray:
        """Minus the binary logarithm of each key's last character given those before it."""
        p = np.full(len(keys), UNIFORM)
        for order, (found, part, context, weight) in enumerate(self.orders, 1):
            own = keys & _mask(order)
            p = _at(found, part, own, 0.0) + _at(context, weight, own >> np.uint64(16), 1.0) * p
        return -np.log2(p)


class Identifier:
    """Models and rejection bounds by language."""

    def __init__(self, models: dict[str, LanguageModel]):
        self.languages = sorted(models)
        self.models = [models[x] for x in self.languages]
        self.bounds = np.full(len(models), np.inf)

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Characters of each text, and bits a character by text and language."""
        sums, sizes = np.zeros((len(texts), len(self.models))), np.zeros(len(texts), np.int64)
        block: list[np.ndarray] = []
        owners: list[tuple[int, int]] = []

        def flush() -> None:
            if block and self.models:
                rows, keys = pd.factorize(np.concatenate(block))
                bits = np.stack([m.bits(keys) for m in self.models])
                starts = np.cumsum([0, *[n for _, n in owners[:-1]]])
                for k in range(len(self.models)):
                    np.add.at(sums[:, k], [i for i, _ in owners], np.add.reduceat(bits[k][rows], starts))
            block.clear()
            owners.clear()

        held = 0
        for i, text in enumerate(texts):
            codes = characters(text or "")
            sizes[i] = len(codes)
            for at in range(0, len(codes), BLOCK):
                part = grams(codes[max(0, at - ORDER + 1) : at + BLOCK])[min(at, ORDER - 1) :]
                block.append(part)
                owners.append((i, len(part)))
                held += len(part)
                if held >= BLOCK:
                    flush()
                    held = 0
        flush()
        return sizes, sums / np.maximum(sizes, 1)[:, None]

    def identify(self, texts: list[str | None]) -> list[tuple[str, float, float | None, bool]]:
        """Language, score, cross-entropy and whether it is rejected."""
        sizes, bits = self.entropies(texts)
        result = []
        for n, own in zip(sizes, bits, strict=True):
            if not n or not len(own):
                result.append(("und", 0.0, None, True))
                continue
            best = int(own.argmin())
            odds = np.exp2(-np.clip((own - own[best]) * min(int(n), EVIDENCE), 0, 500))
            result.append((self.languages[best], float(1 / odds.sum()), float(own[best]), bool(own[best] > self.bounds[best])))
        return result


def _packed(model: LanguageModel) -> list[bytes]:
    return [a.tobytes() for order in model.orders for a in order]


def _unpacked(arrays: list[bytes]) -> LanguageModel:
    model, kinds = LanguageModel.__new__(LanguageModel), (np.uint64, np.float64, np.uint64, np.float64)
    model.orders = [tuple(np.frombuffer(bytes(arrays[4 * k + i]), kind) for i, kind in enumerate(kinds)) for k in range(ORDER)]
    return model


def _counted(texts: DataFrame) -> DataFrame:
    """lang, key and n: how often each n-gram of highest order stands in texts (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, keys in held.items():
                found, n = np.unique(np.concatenate(keys), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "key", "n"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                codes = characters(text.as_py())
                for at in range(0, len(codes), BLOCK):
                    keys = grams(codes[max(0, at - ORDER + 1) : at + BLOCK])[min(at, ORDER - 1) :]
                    held.setdefault(lang.as_py(), []).append(keys)
                    size += len(keys)
                    if size >= 2 * BLOCK:
                        yield from flush()
                        size = 0
        yield from flush()

    return texts.select("lang", "text").mapInArrow(run, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))


def train(labelled: DataFrame) -> Identifier:
    """From labelled (text, lang): a model per language from four fifths of its different texts (all where it has under 10), rejection bounds from the rest."""
    ship(labelled.sparkSession)
    known = labelled.where("text is not null and lang is not null").select("text", "lang", F.xxhash64("text").alias("th"))
    sizes = known.select("lang", "th").distinct().groupBy("lang").count().collect()
    if not sizes:
        return Identifier({})
    few = F.array(F.lit(""), *[F.lit(r["lang"]) for r in sizes if r["count"] < 10])
    apart = F.pmod("th", F.lit(5)) == 0
    distinct = known.where(~apart | F.array_contains(few, F.col("lang"))).groupBy("lang", "th").agg(F.first("text").alias("text"))

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.sort_values("key", key=lambda k: k.to_numpy().view(np.uint64))
        return pd.DataFrame({"lang": [own["lang"].iloc[0]], "arrays": [_packed(LanguageModel(own["key"].to_numpy().view(np.uint64), own["n"].to_numpy()))]})

    learned = _counted(distinct).groupBy("lang").applyInPandas(learn, "lang string, arrays array<binary>").collect()
    found = Identifier({r["lang"]: _unpacked(r["arrays"]) for r in learned})
    shared = labelled.sparkSession.sparkContext.broadcast(found)

    def calibrate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {x: Identifier({x: m}) for x, m in zip(shared.value.languages, shared.value.models, strict=True)}
        for batch in batches:
            pdf = batch.to_pandas()
            for lang, part in pdf[pdf["lang"].isin(own)].groupby("lang"):
                n, bits = own[lang].entropies(part["text"].tolist())
                seen = n >= 20
                yield pa.RecordBatch.from_arrays([pa.array([lang] * int(seen.sum()), pa.string()), pa.array(part["th"].to_numpy()[seen]), pa.array(bits[seen, 0])], ["lang", "th", "bits"])

    scored = known.where(apart).select("lang", "th", "text").mapInArrow(calibrate, "lang string, th long, bits double")
    reached = scored.groupBy("lang", "th").agg(F.min("bits").alias("bits")).groupBy("lang").agg(F.percentile("bits", F.lit(REJECT)).alias("bound"))
    bounds = {r["lang"]: r["bound"] * 1.1 for r in reached.collect()}
    found.bounds = np.array([bounds.get(x, np.inf) for x in found.languages])
    return found


def identify(docs: DataFrame, model: Identifier) -> DataFrame:
    """doc_id, lang_pred, score, bits_per_char and rejected of every row of docs (doc_id, text)."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is that of the different n-grams of the languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                found = shared.value.identify(part.column(1).to_pylist())
                columns = [pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.float64(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", "lang_pred", "score", "bits_per_char", "rejected"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, bits_per_char double, rejected boolean")


def op7_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    found = identify(docs, train(docs.where(~held).select("text", "lang")))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "bits_per_char", "rejected")
