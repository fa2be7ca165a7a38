"""Toxicity by maximum-scoring segments of token log-odds.

Weights. Each token counts once a text, as its repetitions are no evidence. Tokens fall into 2 ** BITS hash buckets, which bounds every table here whatever the
corpus. For each bucket the log-odds of toxic against other labelled texts use an informative
Dirichlet prior, proportional to the bucket's count over all documents; only what lies Z standard
errors and LEAST from zero counts, less a constant drift so that common text scores below zero. A token
without a weight of its own takes that of its longest beginning (PIECES characters) that has one.

Segments. A linear scan (Ruzzo and Tompa) over a text's weights finds all maximal-scoring
segments. Tokens without a weight only add drift, so the scan visits weighted tokens alone.

Calibration. Scores of the best segment in non-toxic texts follow an extreme-value (Gumbel) law
whose place grows with the logarithm of the length; it is fitted to labelled texts that the
weights did not see. A segment's excess over its text's place is its significance. A logistic
function of the best and the summed excess, fitted on the same texts, gives the score.

Learning uses labelled rows with crc32(doc_id as text) mod 5 in 1 to 3 for weights, at most about
WEIGHT_ROWS, and those with 4 for calibration, at most about CALIBRATION_ROWS (bounds on rows a
classifier is fitted on; beyond them a fair share by hash of doc_id). Rows with 0 are held out. Of
texts with nearly the same set of tokens one is learned from, so that copies do not pass for evidence.
The sampled labels are so few that they go to every executor, and no text is shuffled. The prior's
counts cover all documents, for the buckets that the labelled ones make candidates.

Null and empty texts have no tokens and get the score of a text without segments. Repeated rows
get equal results; labels repeated with both values count as toxic; null labels are ignored. With
no labels of either kind the score is the share of toxic labels (0.0 if there are none). An empty
table gives no rows; other columns are ignored. Texts are scored whole.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import ship
from .common import table, written

BITS = 22
#: PRIOR: size of the prior as a share of the labelled tokens.
#: LEAST: log-odds that matter, however sure.
Z, LEAST, DRIFT, PRIOR = 3.3, 1.0, 0.05, 0.1
PIECES = (8, 7, 6, 5, 4)
WEIGHT_ROWS, CALIBRATION_ROWS = 20_000, 8_000
#: Standard errors by which a bucket's raw counts must differ to be a candidate.
CANDIDATE_Z = 2.5
TOKEN = re.compile(r"\w+")


def bucket(token: str) -> int:
    return zlib.crc32(token.encode("utf-8", "replace")) & ((1 << BITS) - 1)


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def names(token: str) -> list[str]:
    """The token and its beginnings, longest first."""
    return [token, *[token[:k] + "*" for k in PIECES if len(token) > k]]


def labelled_counts(docs: DataFrame) -> DataFrame:
    """bucket and the number of toxic (n1) and other (n0) texts that have it; docs has text and toxic."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, pending = (Counter(), Counter()), (Counter(), Counter())

        def add() -> None:
            for total, counter in zip(counts, pending, strict=True):
                for token, n in counter.items():
                    for name in names(token):
                        total[bucket(name)] += n
                counter.clear()

        def rows() -> Iterator[pa.RecordBatch]:
            add()
            at = sorted(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), *[pa.array([c[b] for b in at], pa.int64()) for c in counts]], ["bucket", "n1", "n0"])
            for c in counts:
                c.clear()

        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                pending[0 if toxic else 1].update(set(tokens(text.as_py())))
                if sum(map(len, pending)) > 100_000:
                    add()
                if sum(map(len, counts)) > 400_000:
                    yield from rows()
        yield from rows()

    found = docs.select("text", "toxic").mapInArrow(run, "bucket long, n1 long, n0 long")
    return found.groupBy("bucket").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))


def corpus_counts(docs: DataFrame, wanted: list[int]) -> dict[int, int]:
    """Texts that have each wanted bucket, over all texts; at -1 the sum over all tokens and their beginnings."""
    ship(docs.sparkSession)
    chosen = docs.sparkSession.sparkContext.broadcast(frozenset(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = Counter(), 0
        known: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                pending = Counter()
                for text in batch.column(0).slice(at, 500):
                    pending.update(set(tokens(text.as_py())))
                if len(known) > 150_000:
                    known.clear()
                for token, n in pending.items():
                    total += n * (1 + sum(len(token) > k for k in PIECES))
                    if (hit := known.get(token)) is None:
                        hit = known[token] = tuple(b for b in map(bucket, names(token)) if b in chosen.value)
                    for b in hit:
                        own[b] += n
        own[-1] = total
        yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int64()), pa.array(list(own.values()), pa.int64())], ["bucket", "n"])

    found = docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    return {row["bucket"]: row["n"] for row in found.collect()}


def weights(counts: DataFrame, docs: DataFrame) -> dict[int, float]:
    """Weight of each bucket that differs between the classes by more than chance; at most 2 ** BITS."""
    t1, t0 = (x or 0 for x in counts.agg(F.sum("n1"), F.sum("n0")).first())
    if not t1 or not t0:
        return {}
    a, b = F.col("n1") + 0.5, F.col("n0") + 0.5
    raw = F.abs(F.log(a / t1) - F.log(b / t0)) / F.sqrt(1 / a + 1 / b)
    candidates = counts.where(raw > CANDIDATE_Z).collect()
    prior = corpus_counts(docs, [r["bucket"] for r in candidates])
    size = PRIOR * (t1 + t0)
    found = {}
    for r in candidates:
        share = size * max(prior.get(r["bucket"], 0), r["n1"] + r["n0"]) / max(prior[-1], t1 + t0)
        y1, y0 = r["n1"] + share, r["n0"] + share
        delta = math.log(y1 / (t1 + size - y1)) - math.log(y0 / (t0 + size - y0))
        if abs(delta) > max(LEAST, Z * math.sqrt(1 / y1 + 1 / y0)):
            found[r["bucket"]] = delta
    return found


def segments(at: np.ndarray, weight: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal-scoring segments (score, first token, token after the last) of a sequence whose tokens cost DRIFT each and carry a weight at the ascending places at."""
    kept: list[tuple[float, float, int, int, int]] = []  # left sum, right sum, first, after, link to the last one whose left sum is smaller
    total, before = 0.0, 0
    for place, w in zip(at.tolist(), weight.tolist(), strict=True):
        total -= DRIFT * (place - before)
        before = place + 1
        left, total = total, total + w - DRIFT
        if total <= left:
            continue
        right, first, after = total, place, place + 1
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][0] >= left:
                j = kept[j][4]
            if j < 0 or kept[j][1] >= right:
                kept.append((left, right, first, after, j))
                break
            left, first = kept[j][0], kept[j][2]
            del kept[j:]
    return [(r - l, f, a) for l, r, f, a, _ in kept]


class Known:
    """Tokens met by a task: those without a weight, and the weights of the others; emptied when large."""

    def __init__(self):
        self.light: set[str] = set()
        self.heavy: dict[str, float] = {}

    def learn(self, distinct: set[str], weight: dict[int, float]) -> None:
        if len(self.light) > 200_000:
            self.light.clear()
        for t in distinct - self.light:
            if t not in self.heavy:
                found = next((w for w in map(weight.get, map(bucket, names(t))) if w is not None), 0.0)
                if found:
                    self.heavy[t] = found
                elif len(t) < 64:
                    self.light.add(t)
        if len(self.heavy) > 200_000:
            self.heavy = {t: self.heavy[t] for t in distinct if t in self.heavy}


class Model:
    """Weights by bucket, the extreme-value law and the logistic function."""

    def __init__(self, weight: dict[int, float]):
        self.weight = weight
        self.place, self.scale, self.slope = 0.0, 1.0, 0.0
        self.logit = np.zeros(3)

    def found(self, text: str | None, known: Known) -> tuple[int, list[tuple[float, int, int]]]:
        """Number of tokens, and the segments."""
        own = tokens(text)
        distinct = set(own)
        known.learn(distinct, self.weight)
        heavy = known.heavy
        if distinct.isdisjoint(heavy):
            return len(own), []
        at = [i for i, t in enumerate(own) if t in heavy]
        return len(own), segments(np.array(at), np.array([heavy[own[i]] for i in at]))

    def features(self, n: int, scores: list[float]) -> tuple[float, float]:
        """Excess of the best segment, and the sum of all significant ones, in units of the law's scale."""
        excess = sorted((s - self.place - self.slope * math.log(n + 1)) / self.scale for s in scores)
        return (math.log1p(max(0.0, excess[-1])) if excess else 0.0, math.log1p(sum(x for x in excess if x > 0)))

    def score(self, n: int, scores: list[float]) -> float:
        x = self.logit @ np.array([1.0, *self.features(n, scores)])
        return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))

    def calibrate(self, rows: list[tuple[int, list[float], int]]) -> None:
        """Fits the law to the best scores of non-toxic texts, then the logistic function to all."""
        clean = [(math.log(n + 1), max(s, default=0.0)) for n, s, y in rows if not y]
        if clean:
            x, y = np.array(clean).T
            self.slope = max(0.0, float(np.polyfit(x, y, 1)[0])) if len(set(x.tolist())) > 2 else 0.0
            rest = y - self.slope * x
            self.scale = max(0.5, float(rest.std()) * math.sqrt(6) / math.pi)
            self.place = float(rest.mean()) - 0.5772 * self.scale
        labels = np.array([y for *_, y in rows], float)
        if not len(rows) or labels.min() == labels.max():
            share = float(labels.mean()) if len(rows) else 0.0
            self.logit = np.array([math.log((share + 1e-9) / (1 - share + 1e-9)), 0.0, 0.0])
            return
        features = np.array([[1.0, *self.features(n, s)] for n, s, _ in rows])
        ridge = np.diag([1e-6, 1e-2, 1e-2])
        beta = np.zeros(3)
        for _ in range(50):  # Newton steps
            p = 1 / (1 + np.exp(-np.clip(features @ beta, -30, 30)))
            step = np.linalg.solve(features.T @ (features * (p * (1 - p))[:, None]) + ridge, features.T @ (labels - p) - ridge @ beta)
            beta += np.clip(step, -3, 3)
        self.logit = beta


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, fold, toxic and k0 to k2: keys that texts with nearly the same set of tokens share, each of four minima over hashed tokens."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(7)
        factor, shift = rng.integers(1, 1 << 31, 12, np.uint64) | np.uint64(1), rng.integers(0, 1 << 31, 12, np.uint64)
        for batch in batches:
            keys: list[list[str]] = [[], [], []]
            for text in batch.column(3):
                own = np.array([zlib.crc32(t.encode("utf-8", "replace")) for t in set(tokens(text.as_py()))] or [0], np.uint64)
                least = np.array([((own * f + c) & np.uint64(0xFFFFFFFF)).min() for f, c in zip(factor, shift, strict=True)])
                for k in range(3):
                    keys[k].append(least[4 * k : 4 * k + 4].tobytes().hex())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *map(pa.array, keys)], ["doc_id", "fold", "toxic", "k0", "k1", "k2"])

    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(fold as long) fold", "cast(toxic as int) toxic", "text")
    return rows.mapInArrow(run, "doc_id long, fold long, toxic int, k0 string, k1 string, k2 string")


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from docs (doc_id, text) and labels (doc_id, toxic)."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    usable = labels.where("toxic is not null and doc_id is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic"), fold.alias("fold"))
    sizes = {r["fold"]: r["count"] for r in usable.groupBy("fold").count().collect()}
    share = lambda bound, *folds: min(1.0, bound / max(1, sum(sizes.get(k, 0) for k in folds)))
    part = F.when(F.col("fold") == 4, share(CALIBRATION_ROWS, 4)).when(F.col("fold") > 0, share(WEIGHT_ROWS, 1, 2, 3)).otherwise(0.0)
    chosen = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003.0 < part)

    def of(marks: DataFrame) -> DataFrame:
        """The texts of marks (doc_id, fold, toxic), which are as few as the bounds say, with their columns."""
        own = F.broadcast(marks.withColumnRenamed("doc_id", "l_id"))
        return docs.select("doc_id", "text").join(own, F.col("doc_id") == F.col("l_id")).select("doc_id", "text", "fold", "toxic")

    found = signatures(of(chosen.groupBy("doc_id", "fold").agg(F.max("toxic").alias("toxic"))))
    for k in ("k0", "k1", "k2"):
        found = found.groupBy(k).agg(F.min(F.struct("doc_id", "fold", "toxic", "k0", "k1", "k2")).alias("one")).select("one.*")
    marks = written(found.select("doc_id", "fold", "toxic"))

    def sample(condition: str) -> DataFrame:
        return of(marks.where(condition)).select("text", (F.col("toxic") > 0).alias("toxic"))

    model = Model(weights(written(labelled_counts(sample("fold <> 4"))), docs))
    rows = sample("fold = 4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known()
        for batch in batches:
            found = [model.found(t.as_py(), known) for t in batch.column(0)]
            top = [sorted((s for s, *_ in own), reverse=True) for _, own in found]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in found], pa.int64()), pa.array(top, pa.list_(pa.float64())), pa.array([int(y > 0) for y in batch.column(1).to_pylist()], pa.int64())], ["n", "s", "y"])

    model.calibrate([(r["n"], list(r["s"]), r["y"]) for r in rows.mapInArrow(run, "n long, s array<double>, y long").collect()])
    return model


def toxicity(docs: DataFrame, model: Model, threshold: float = 0.5, carry: bool = False) -> DataFrame:
    """doc_id, score, predicted and segments (first and after: token places; score; significance) of every row of docs (doc_id, text); carry gives row, a struct of all columns of docs, instead of doc_id."""
    ship(docs.sparkSession)
    key = "row" if carry else "doc_id"
    rows = docs.select(F.struct("*").alias("row"), "text") if carry else docs.selectExpr("cast(doc_id as long) doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known()
        for batch in batches:
            scores, passages = [], []
            for text in batch.column(1):
                n, own = model.found(text.as_py(), known)
                scores.append(model.score(n, [s for s, *_ in own]))
                level = model.place + model.slope * math.log(n + 1)
                passages.append([{"first": f, "after": a, "score": s, "significance": (s - level) / model.scale} for s, f, a in own if s > level])
            kind = pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64()), ("score", pa.float64()), ("significance", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array(passages, kind)], [key, "score", "predicted", "segments"])

    fields = "score double, predicted int, segments array<struct<first:long,after:long,score:double,significance:double>>"
    return rows.mapInArrow(run, T.StructType([rows.schema[0], *T._parse_datatype_string(fields).fields]))


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    found = toxicity(docs, train(docs, table(spark, sf_dir, "labels", "doc_id", "toxic")))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "score", "predicted", F.size("segments").cast("long").alias("n_segments"))
