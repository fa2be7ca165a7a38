"""SentencePiece encoding and decoding by a table of distinct chunks.

Where no piece of the model has a white-space marker after another character, no merge
crosses the start of a marker run, so a text's ids are the ids of its chunks, one after the
other. A task keeps a table of distinct chunks (marker run plus word): each is segmented
once, by the sentencepiece library, and ids and decoded text are joined back by position.
The table is emptied when it holds TABLE_CHUNKS chunks and when a task ends, as its worker may
idle long; that bounds memory, not results.

Models in which a piece does cross a marker, or whose normaliser rewrites the text, are
encoded text by text.

Null texts count as empty; empty texts give the begin and end ids alone. Repeated rows give
repeated results, an empty table gives none, other columns are ignored. Long chunks (a text
without a space) are segmented but not kept in the table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from ..runtime import ship
from .common import table

TABLE_CHUNKS = 400_000
LONGEST_KEPT = 64
MARKER = "▁"
#: Serialised model settings that switch the leading marker off: field 3 (normaliser), its field 3 = false.
NO_PREFIX = b"\x1a\x02\x18\x00"


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """Fields of a serialised protocol buffer message."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = number(at)
        kind = tag & 7
        if kind == 0:
            value, at = number(at)
            yield tag >> 3, value
        else:
            size, at = number(at) if kind == 2 else (8 if kind == 1 else 4, at)
            yield tag >> 3, data[at : at + size]
            at += size


class Codec:
    """Encodes and decodes as the library does with the same model."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=data + NO_PREFIX)
        normaliser: dict[int, bytes | int] = {}
        kinds = set()
        for number, value in _fields(data):
            if number == 3:
                normaliser |= dict(_fields(value))
            elif number == 1:
                kinds.add(dict(_fields(value)).get(3, 1))
        self.prefix = bool(normaliser.get(3, 1))
        pieces = [self.whole.id_to_piece(i) for i in range(self.whole.get_piece_size())]
        #: Normal, unknown, control and byte pieces only; no rewriting; no marker after another character.
        self.by_chunk = (
            not normaliser.get(2) and not normaliser.get(4, 1) and kinds <= {1, 2, 3, 6} and 6 in kinds
            and all(MARKER not in p.lstrip(MARKER) for p in pieces)
        )
        breaks = "" if any("\n" in p for p in pieces) else "\n"
        self.chunks = re.compile(f"{breaks}|{MARKER}*[^{MARKER}{breaks}]+|{MARKER}+" if breaks else f"{MARKER}*[^{MARKER}]+|{MARKER}+")
        self.known: dict[str, int] = {}
        self._empty()

    def _empty(self) -> None:
        self.known.clear()
        self.ids: list[np.ndarray] = []
        self.texts: list[str] = []

    def _segment(self, chunks: list[str]) -> None:
        ids = self.bare.encode(chunks, num_threads=1)
        for chunk, own, text in zip(chunks, ids, self.bare.decode(ids, num_threads=1), strict=True):
            self.known[chunk] = len(self.ids)
            self.ids.append(np.array(own, "<u4"))
            self.texts.append(text)

    def convert(self, texts: list[str]) -> Iterator[tuple[np.ndarray, str]]:
        """Ids with begin and end, and the decoded text, of each text."""
        begin, end = np.array([self.whole.bos_id()], "<u4"), np.array([self.whole.eos_id()], "<u4")
        if not self.by_chunk:
            for text in texts:
                ids = self.whole.encode(text)
                yield np.concatenate([begin, np.array(ids, "<u4"), end]), self.whole.decode(ids)
            return
        if len(self.ids) > TABLE_CHUNKS:
            self._empty()
        marked = [text.replace(" ", MARKER) for text in texts]
        split = [self.chunks.findall(MARKER + t if self.prefix and t else t) for t in marked]
        new = [c for c in set().union(*split) if c not in self.known]
        self._segment(new)
        for parts in split:
            rows = [self.known[c] for c in parts]
            decoded = "".join([self.texts[r] for r in rows])
            yield np.concatenate([begin, *[self.ids[r] for r in rows], end]), decoded[1:] if self.prefix and decoded[:1] == " " else decoded
        for c in new:
            if len(c) > LONGEST_KEPT:  # its row is freed; the number stays
                row = self.known.pop(c)
                self.ids[row], self.texts[row] = begin[:0], ""


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode_decode(docs: DataFrame, model: str, full: bool = False) -> DataFrame:
    """doc_id, n_tokens, SHA-256 of ids and of the decoded text of every row of docs (doc_id, text).

    full adds the ids and the decoded text themselves. The model's file is read on each executor.
    """

    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        own._empty()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [t or "" for t in part.column(1).to_pylist()]
                columns: list[list] = [[], [], [], [], []]
                for ids, text in (x for i in range(0, len(texts), 64) for x in own.convert(texts[i : i + 64])):
                    columns[0].append(len(ids))
                    columns[1].append(hashlib.sha256(ids.tobytes()).hexdigest())
                    columns[2].append(hashlib.sha256(text.encode()).hexdigest())
                    if full:
                        columns[3].append(ids.astype("i4"))
                        columns[4].append(text)
                arrays = [part.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if full:
                    arrays += [pa.array(columns[3], pa.list_(pa.int32())), pa.array(columns[4], pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(arrays, names)
        own._empty()

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * full
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, schema)


def op1_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
