import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from citemill.llm import divergence as D
from citemill.llm import manifest as M


def audit(rows, least=3, top=200):
    """The divergence audit in plain Python; rows are (lang, source, text)."""
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in [[x or "" for x in r] for r in rows]:
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text)]
        groups[lang].add(source)
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    found = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        whole = Counter()
        for s in sources:
            whole.update({t: counts[lang, s][t] for t in kept})

        def share(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (total + len(kept)) for t in kept}

        p, q = {s: share(counts[lang, s]) for s in sources}, share(whole)
        far = lambda x, y: (x - y) ** 2 // y
        for s in sources:
            pairs = [(o, sum(far(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, far(p[s][t], q[t])) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                found += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(ranked)]
    return sorted(found)


def test_divergence_equals_plain_python(spark):
    rng = random.Random(5)
    vocabulary = ["Wort", "wort", "ÄPFEL", "äpfel", "a1b", "x-y", "日本", "🙂", "und", "der", "Zug", "é"]
    rows = [(rng.choice(["de", "en", None, ""]), rng.choice(["s1", "s2", None, "S3", "ß"]), " ".join(rng.choices(vocabulary, k=rng.randint(0, 9)))) for _ in range(150)]
    rows += [("de", "s1", None), ("xx", "only", "word"), ("yy", "one", "rare"), ("yy", "two", ""), ("de", "empty", "12 34"), *[("de", "s1", "same row")] * 5, ("en", "long", "lang " * 50_000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "lang string, source string, text string, term int")
    assert sorted(map(tuple, D.divergence(docs).collect())) == audit(rows)
    assert sorted(map(tuple, D.divergence(docs, least=1, top=2).collect())) == audit(rows, 1, 2)
    assert D.divergence(docs.limit(0)).count() == 0


def test_divergence_shares_do_not_overflow(spark):
    counts = [0, 7, 9 * 10**9, 2**63 // 10**9 - 2, 2**63 // 10**9 - 1, 2**63 // 10**9, 9 * 10**17]
    row = spark.createDataFrame([(c, 10**18 + 10**6) for c in counts] + [(c, c + 3) for c in counts], "c long, base long")
    assert all(p == 1 + 10**9 * (c + 1) // base for c, base, p in row.select("c", "base", D._share("c", "base")).collect())


H = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return H(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)])


def climb(nodes):
    """Root of nodes and, by node, its siblings with their side, level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            other = i ^ 1
            paths[k].append((nodes[other], other < i) if other < len(nodes) else ("", False))
        nodes, at = [H(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)], [i // 2 for i in at]
    return nodes[0], paths


def manifest(rows):
    langs = defaultdict(list)
    for r in rows:
        langs[r[2]].append((r[0] is not None, r[0] or 0, leaf(*r), r))
    names = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: climb([n[2] for n in sorted(langs[x], key=lambda n: n[:3])]) for x in names}
    root, upper = climb([trees[x][0] for x in names])
    found = []
    for name, high in zip(names, upper, strict=True):
        subroot, low = trees[name]
        for (*_, own, r), path in zip(sorted(langs[name], key=lambda n: n[:3]), low, strict=True):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            node = leaf(*r[:3], r[3] + 1, r[4]) if hit else own
            for digest, before in path + high:
                node = H(digest, node) if before else H(node, digest)
            found.append((r[0], own, subroot, root, H(*[x for x, _ in path + high]), node, node == root))
    return sorted(found, key=repr)


@pytest.mark.parametrize("levels", [1, 2, 10])
def test_manifest_equals_plain_python(spark, monkeypatch, levels):
    rng = random.Random(levels)
    rows = [(rng.randint(-5, 400), rng.choice(["s", None, ""]), rng.choices(["en", "dé", None, "", "zz"], [30, 5, 2, 1, 1])[0], rng.choice([None, 3, 10**12]), rng.choice(["", None, "text\n🙂", "x" * 50_000])) for _ in range(150)]
    rows += [(None, "s", "en", 1, "a"), (None, "s", "en", 1, "b"), *[(7, "s", "en", 1, "same")] * 9, (1, None, "single", 2, "a")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, tree string")
    whole = M.manifest
    monkeypatch.setattr(M, "table", lambda spark, sf_dir, name, *columns: docs.select(*columns))
    monkeypatch.setattr(M, "manifest", lambda docs: whole(docs, levels=levels))
    found = sorted(map(tuple, M.op13_manifest(spark, "").collect()), key=repr)
    assert found == manifest(rows)
    assert any(not r[-1] for r in found) and any(r[-1] for r in found)
    assert whole(docs.limit(0)).count() == 0


@pytest.mark.parametrize("fan", [2, 3])
def test_walk_gives_paths_that_fold_to_the_root(fan):
    digests = [H(str(k)) for k in range(11)]
    root, paths = M.walk(digests, M._height(11, fan, 9), fan)
    for node, path in zip(digests, paths, strict=True):
        for step in path:
            before, _, after = step.partition("|")
            node = H(before, node, after)
        assert node == root
    assert M.walk(digests[:1], 0) == (digests[0], [[]])


def test_divergence_spells_out_no_absent_terms(spark):
    """Forty sources of one language with terms of their own: their own terms are kept, not every source's row for each."""
    rows = [("x", f"s{i % 40}", f"own{i % 40} common") for i in range(160)] + [("x", "s0", None), ("y", "s1", "lone")]
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    assert D.shares(docs)[1].count() == 80  # 41 kept terms of 40 sources: 1,640 rows before
    assert sorted(map(tuple, D.divergence(docs).collect())) == audit(rows)
