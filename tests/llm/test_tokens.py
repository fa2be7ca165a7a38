import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from citemill.llm import sentencepiece_codec as S
from citemill.llm import token_counts as K
from tokenizers import Tokenizer

PIECE, BYTES = P.path("piece_bpe_32k.model"), P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def texts(some_docs):
    rng = random.Random(1)
    letters = "ab \n\r\t▁  é漢字🙂'<s>|<|endoftext|>\x00ć　;}).  aa"
    made = ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(800)]
    return [t for _, t in some_docs[:60]] + made + ["", "a" * 3000, " " * 500, "<|endoftext|>x<|endoftext|>", "'s're x  \n\n y", "ab" * 2000]


def test_ids_and_decoded_text_equal_the_library(texts):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    own = S.Codec(PIECE)
    assert own.by_chunk
    for text, (ids, decoded) in zip(texts, own.convert(texts), strict=True):
        want = library.encode(text)
        assert ids.tolist() == [1, *want, 2]
        assert decoded == library.decode(want)


def test_round_trip(texts):
    for text, (_, decoded) in zip(texts, S.Codec(PIECE).convert(texts), strict=True):
        assert decoded == text.replace("▁", " ")


def test_full_table_of_chunks_changes_nothing(texts, monkeypatch):
    want = [(i.tolist(), d) for i, d in S.Codec(PIECE).convert(texts)]
    monkeypatch.setattr(S, "TABLE_CHUNKS", 50)
    own = S.Codec(PIECE)
    assert [(i.tolist(), d) for k in range(0, len(texts), 16) for i, d in own.convert(texts[k : k + 16])] == want


def test_counts_equal_the_library(texts):
    library = Tokenizer.from_file(BYTES)
    assert K.Counter(BYTES).count(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_overlapping_pairs_merge_left_to_right():
    library = Tokenizer.from_file(BYTES)
    own = K.Counter(BYTES)
    for n in range(1, 40):
        for unit in ("a", "e", " ", "ab", "aab"):
            assert own.count([unit * n]) == [len(library.encode(unit * n, add_special_tokens=False).ids)]


def test_odd_rows(odd_docs, no_docs):
    rows = S.encode_decode(odd_docs, PIECE, full=True).collect()
    assert len(rows) == odd_docs.count()
    empty = next(r for r in rows if r.doc_id == 1)
    assert empty.ids == [1, 2] and empty.decoded == "" and empty.ids_sha256 == hashlib.sha256(np.array([1, 2], "<u4").tobytes()).hexdigest()
    counts = K.token_counts(odd_docs, BYTES).collect()
    assert {(r.n_bytes, r.n_tokens, r.over_limit) for r in counts if r.doc_id in (1, 2)} == {(0, 0, False)}
    assert next(r for r in counts if r.doc_id == 4).over_limit
    assert S.encode_decode(no_docs, PIECE).count() == K.token_counts(no_docs, BYTES).count() == 0


def test_long_pre_tokens(spark):
    import time

    rng = random.Random(9)
    library, own = Tokenizer.from_file(BYTES), K.Counter(BYTES)
    letters = "etaoinshrdlucmfwypvbgkqjxzEé漢"
    texts = ["".join(rng.choices(letters, k=n)) for n in (512, 513, 2000, 20_000)] + ["a" * 3000, "ab" * 4001, "é" * 700, "!" * 1500, "aab" * 999, "thethe" * 800 + "x"]
    assert own.count(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    whole = "".join(rng.choices(letters, k=1_000_000))
    began = time.time()
    assert own.count([whole]) == [len(library.encode(whole, add_special_tokens=False).ids)]
    assert time.time() - began < 60


def test_the_registered_query_equals_the_library(spark):
    library = Tokenizer.from_file(BYTES)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in K.op3_token_counts(spark, "/root/testdata/sf0.001").collect():
        n = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(texts[r.doc_id].encode()), n > 512)
