import math
import random
import re
from collections import Counter

import numpy as np
from citemill.llm import language, quality, toxicity
from pyspark.sql import functions as F

D = "/root/testdata/sf0.01"


def brute_segments(scores):
    def best(lo, hi):
        found = (0.0, 0, 0)
        for i in range(lo, hi):
            total = 0.0
            for j in range(i, hi):
                total += scores[j]
                if total > found[0] + 1e-12 or (found[0] and abs(total - found[0]) < 1e-12 and j + 1 - i < found[2] - found[1]):
                    found = (total, i, j + 1)
        return [*best(lo, found[1]), found, *best(found[2], hi)] if found[0] > 1e-12 else []

    return best(0, len(scores))


def test_segments_equal_brute_force():
    rng = random.Random(0)
    for _ in range(200):
        n = rng.randint(1, 25)
        weights = {i: rng.uniform(-2, 2) for i in range(n) if rng.random() < 0.6}
        got = toxicity.segments(np.array(sorted(weights), int), np.array([weights[i] for i in sorted(weights)]))
        want = brute_segments([weights.get(i, 0.0) - toxicity.DRIFT for i in range(n)])
        assert [(round(s, 6), a, b) for s, a, b in got] == [(round(s, 6), a, b) for s, a, b in want]


def test_held_out_toxicity(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{D}/labels.parquet").collect()}
    rows = [r for r in toxicity.op4_toxicity(spark, D).collect() if r.held_out and r.doc_id in labels]
    right = sum(r.predicted == labels[r.doc_id] for r in rows) / len(rows)
    assert right >= 0.9 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_toxicity_of_odd_rows(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.toxicity(odd_docs, toxicity.train(odd_docs, none)).collect()
    assert len(got) == odd_docs.count() and {r.predicted for r in got} == {0}
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)] + [(5, None), (None, 1), (5, 0)], "doc_id long, toxic int")
    model = toxicity.train(odd_docs, labels)
    assert toxicity.toxicity(odd_docs, model, carry=True).where("row.text is null").count() == 1
    assert toxicity.toxicity(no_docs, toxicity.train(no_docs, labels)).count() == 0


def test_kneser_ney_equals_the_formula():
    codes = [int(c) for c in language.characters("the cat sat on the mat and the rat ran")]
    padded = [32] * 3 + codes
    counts = {4: Counter(tuple(padded[i : i + 4]) for i in range(len(codes)))}
    for k in (3, 2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])

    def p(g):
        if not g:
            return language.UNIFORM
        own = counts[len(g)]
        once, twice = (sum(v == k for v in own.values()) for k in (1, 2))
        d = once / (once + 2 * twice) if once and twice else 0.5
        total = sum(v for h, v in own.items() if h[:-1] == g[:-1])
        types = sum(1 for h in own if h[:-1] == g[:-1])
        return max(own.get(g, 0) - d, 0) / total + d * types / total * p(g[1:]) if total else p(g[1:])

    model = language.LanguageModel(language.grams(np.array(codes, np.uint16)))
    other = language.characters("that hat ë")
    bits, ends = model.bits(language.grams(other)), [32] * 3 + [int(c) for c in other]
    assert np.allclose(bits, [-math.log2(p(tuple(ends[i : i + 4]))) for i in range(len(other))])


def test_held_out_language(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    rows = [r for r in language.op7_language(spark, D).collect() if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in rows) / len(rows) >= 0.98


def test_language_of_odd_rows(spark, odd_docs, no_docs):
    model = language.train(spark.createDataFrame([("one two three four", "en"), ("uno dos tres", "es"), (None, "en"), ("x", None)], "text string, lang string"))
    got = {r.doc_id: r for r in language.identify(odd_docs, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 5, 6)] == ["und", "und", "und", "en", "en"] and got[1].score == 0
    assert language.identify(no_docs, model).count() == 0
    assert {r.lang_pred for r in language.identify(odd_docs, language.train(no_docs.select("text", "lang"))).collect()} == {"und"}


def test_languages_of_few_often_copied_texts_are_learned(spark):
    rows = [(f"{word} {k} {word[::-1]}", lang) for lang, word in (("en", "house"), ("es", "perro"), ("fr", "chien"), ("de", "katze")) for k in ("ab", "cd") for _ in range(1500)]
    learned = language.train(spark.createDataFrame(rows, "text string, lang string"))
    assert learned.languages == ["de", "en", "es", "fr"]
    want = language.LanguageModel(np.concatenate([language.grams(language.characters(f"house {k} esuoh")) for k in ("ab", "cd")]))
    own = learned.models[1].orders[0]
    assert all(np.array_equal(x, y) for x, y in zip(own, want.orders[0], strict=True))


def test_blocks_of_characters_change_nothing(monkeypatch):
    model = language.LanguageModel(language.grams(language.characters("the cat sat on the mat " * 20)))
    own = language.Identifier({"en": model})
    texts = ["the cat " * 50, "mat", "", "x" * 200]
    want = own.entropies(texts)[1]
    monkeypatch.setattr(language, "BLOCK", 37)
    assert np.allclose(own.entropies(texts)[1], want)


def brute_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered |= {i, i + 1, i + 2}
    return len(words), sum(map(len, words)), sum(map(text.count, "#*$%&|<>")), len(lines) - len(set(lines)), len(covered)


def test_measures_equal_brute_force(spark, some_docs, no_docs):
    texts = [t for _, t in some_docs] + [None, "", "a a a a", "a b c a b c", "x\ny\nx\n\n \n", "a b c d a b c d a b c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_words", F.lit(0))
    for r in quality.quality(docs).collect():
        want = brute_measures(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
    assert quality.quality(no_docs).count() == 0


def test_verdicts_follow_quality_labels(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{D}/labels.parquet").collect()}
    rows = [r for r in quality.op6_quality_rules(spark, D).collect() if r.doc_id in labels and not r.base_failed]
    assert sum(r.kept == bool(labels[r.doc_id]) for r in rows) / len(rows) >= 0.95


def test_kept_and_posterior_equal_brute_force(spark, odd_docs):
    """The votes, the model and the verdict of every text, from the measures; long, null and repeated rows among them."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").union(odd_docs.select("doc_id", "text"))
    rows = quality.quality(docs).collect()
    assert len(rows) == docs.count()

    def votes(r):
        found = []
        for _, measure, over, under, low, high in quality.RULES:
            a, b = (r[c] for c in measure.split(" / "))
            x = a / b if b else 0.0
            found.append(-1 if x > over or x < under else 1 if low <= x <= high else 0)
        return tuple(found)

    share, chances = quality.fit(Counter(votes(r) for r in rows if not r.base_failed))
    for r in rows:
        odds = math.log(share / (1 - share)) + sum(math.log(chances[k][v][0] / chances[k][v][1]) for k, v in enumerate(votes(r)))
        assert abs(r.posterior - 1 / (1 + math.exp(-odds))) < 1e-9
        assert r.kept == (not r.base_failed and r.posterior >= 0.5)


def test_language_choice_equals_brute_force(spark):
    """The registered query's languages are those of the lowest cross-entropy under models fitted here on the same texts."""
    import zlib

    import xxhash

    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    held = {d: zlib.crc32(str(d).encode()) % 4 == 2 for d, *_ in docs}
    texts = {}
    for d, t, lang in docs:
        if not held[d] and t is not None and lang is not None:
            h = xxhash.xxh64_intdigest(t.encode(), 42)
            texts.setdefault(lang, {})[t] = h - (1 << 64) if h >> 63 else h
    models = {}
    for lang, own in texts.items():
        fitted = [t for t, h in own.items() if h % 5 or len(own) < 10]
        models[lang] = language.LanguageModel(np.concatenate([language.grams(language.characters(t)) for t in fitted]))
    for r in language.op7_language(spark, "/root/testdata/sf0.001").collect():
        text = next(t for d, t, _ in docs if d == r.doc_id)
        codes = language.characters(text or "")
        if not len(codes):
            assert r.lang_pred == "und" and r.score == 0
            continue
        bits = {lang: float(m.bits(language.grams(codes)).mean()) for lang, m in models.items()}
        assert abs(bits[r.lang_pred] - min(bits.values())) < 1e-9 and r.held_out == held[r.doc_id]
        assert abs(r.score - 1 / sum(2 ** -((b - bits[r.lang_pred]) * min(len(codes), language.EVIDENCE)) for b in bits.values())) < 1e-6


def test_em_finds_accurate_rules():
    rng = random.Random(2)
    patterns = Counter()
    for _ in range(20_000):
        good = rng.random() < 0.8
        vote = lambda right: 0 if rng.random() < 0.3 else (1 if good == (rng.random() < right) else -1)  # noqa: E731, B023
        patterns[(vote(0.97), vote(0.95), vote(0.93))] += 1
    share, chances = quality.fit(patterns)
    assert abs(share - 0.8) < 0.05 and chances[0][1][0] > 0.6 and chances[0][-1][0] < 0.06
