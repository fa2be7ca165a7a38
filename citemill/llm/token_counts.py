"""Byte-pair token counts by rank-synchronous merging of arrays.

A text is split into the pre-tokens of the vocabulary's pattern. Pre-tokens that a task has
not met yet are held together as ragged arrays of symbols; in each round every sequence
applies its own lowest-ranked pair, at all its places at once (left to right where places
overlap), until no pair is left. The surviving symbols are counted. Counts of short
pre-tokens are kept in a table of at most TABLE_WORDS entries, emptied when full.

Pre-tokens of more than LONG bytes need many rounds, so theirs touch changed places alone: places
wait by rank, a round takes all that wait at the lowest rank, merges those still standing there,
and files the pairs that this makes. The time is in proportion to the length, nearly.

Null texts count as empty and have no tokens. Repeated rows give repeated results, an empty
table gives none, other columns are ignored. A very long pre-token is merged like any other.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ..runtime import ship
from .common import table

TABLE_WORDS = 500_000
LONGEST_KEPT = 64
LONG = 512
#: Symbols merged at a time; more are done in turns.
BLOCK = 2_000_000


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable Latin-1 bytes stand for themselves, the others come after U+00FF in order."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Counter:
    """Counts tokens as the tokenizers library does with the same byte-level BPE file."""

    def __init__(self, path: str):
        import public_tokenizers

        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        vocabulary = data["model"]["vocab"]
        letters = _byte_letters()
        self.of_byte = np.zeros(256, np.int64)
        for letter, byte in letters.items():
            self.of_byte[byte] = vocabulary[letter]
        self.base = 1 << 20
        keys, merged = [], []
        for pair in data["model"]["merges"]:
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            keys.append(vocabulary[left] * self.base + vocabulary[right])
            merged.append(vocabulary[left + right])
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys, self.ranks = np.array(keys, np.int64)[order], order.astype(np.int64)
        self.merged = np.array(merged, np.int64)
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        special = sorted((x["content"] for x in data.get("added_tokens", [])), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.known: dict[str, int] = {}

    def _ranks(self, symbols: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The rank of each symbol's pair with the next one; len(merged) where there is none."""
        none = len(self.merged)
        found = np.full(len(symbols), none, np.int64)
        if len(symbols) > 1:
            pairs = symbols[:-1] * self.base + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, pairs), none - 1)
            found[:-1] = np.where((self.keys[at] == pairs) & ~last[:-1], self.ranks[at], none)
        return found

    def lengths(self, sequences: list[bytes]) -> np.ndarray:
        """Symbols that survive in each sequence."""
        sizes = np.array([len(s) for s in sequences], np.int64)
        result = np.zeros(len(sequences), np.int64)
        symbols = self.of_byte[np.frombuffer(b"".join(sequences), np.uint8)]
        owner = np.repeat(np.arange(len(sequences)), sizes)
        none = len(self.merged)
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            last = np.zeros(len(symbols), bool)
            last[np.r_[starts[1:], len(symbols)] - 1] = True
            ranks = self._ranks(symbols, last)
            lowest = np.minimum.reduceat(ranks, starts)
            counts = np.diff(np.r_[starts, len(symbols)])
            done = lowest == none
            result[owner[starts[done]]] = counts[done]
            live = np.repeat(~done, counts)
            hit = live & (ranks == np.repeat(lowest, counts))
            # Of places that overlap (a pair of equal symbols in a run) take the first, third, ...
            after = np.flatnonzero(hit[1:] & hit[:-1])
            if len(after):
                at = np.arange(len(hit))
                first = hit & ~np.r_[False, hit[:-1]]
                hit &= (at - np.maximum.accumulate(np.where(first, at, 0))) % 2 == 0
            symbols = np.where(hit, self.merged[np.minimum(ranks, none - 1)], symbols)
            keep = live & ~np.r_[False, hit[:-1]]
            symbols, owner = symbols[keep], owner[keep]
        return result

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols; len(merged) where there is none."""
        none = len(self.merged)
        pairs = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, pairs), none - 1)
        return np.where(self.keys[at] == pairs, self.ranks[at], none)

    def long_length(self, sequence: bytes) -> int:
        """Symbols that survive in one long sequence."""
        none, n = len(self.merged), len(sequence)
        symbols = np.r_[self.of_byte[np.frombuffer(sequence, np.uint8)], -1, -1]  # a merged-away symbol and the end are -1
        after, before = np.arange(1, n + 3), np.arange(-1, n + 1)
        after[n:] = n
        waiting: dict[int, list[np.ndarray]] = {}
        lowest: list[int] = []

        def file(places: np.ndarray, ranks: np.ndarray) -> None:
            places, ranks = places[ranks < none], ranks[ranks < none]
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            starts = [0, *cuts.tolist()] if len(places) else []
            for at, part in zip(starts, np.split(places, cuts), strict=False):
                rank = int(ranks[at])
                if rank not in waiting:
                    heapq.heappush(lowest, rank)
                waiting.setdefault(rank, []).append(part)

        places = np.arange(n - 1)
        file(places, self._rank(symbols[: n - 1], symbols[1:n]))
        left = n
        while lowest:
            rank = heapq.heappop(lowest)
            places = np.unique(np.concatenate(waiting.pop(rank)))
            places = places[(symbols[places] >= 0) & (symbols[after[places]] >= 0)]
            places = places[self._rank(symbols[places], symbols[after[places]]) == rank]
            if len(places) > 1 and (overlap := after[places[:-1]] == places[1:]).any():
                # Of places that overlap (a pair of equal symbols in a run) take the first, third, ...
                k = np.arange(len(places))
                first = np.r_[True, ~overlap]
                places = places[(k - np.maximum.accumulate(np.where(first, k, 0))) % 2 == 0]
            if not len(places):
                continue
            gone = after[places]
            symbols[places] = self.merged[rank]
            symbols[gone] = -1
            after[places] = after[gone]
            before[after[places]] = places
            left -= len(places)
            prior = before[places]
            prior = prior[prior >= 0]
            changed = np.unique(np.r_[prior, places])
            file(changed, np.where(symbols[after[changed]] >= 0, self._rank(symbols[changed], np.maximum(symbols[after[changed]], 0)), none))
        return left

    def _learn(self, words: list[str]) -> dict[str, int]:
        found, block, size = {}, [], 0
        for word in words:
            data = word.encode()
            if len(data) > LONG:
                found[word] = self.long_length(data)
                continue
            block.append(word)
            size += len(data)
            if size > BLOCK:
                found |= dict(zip(block, self.lengths([w.encode() for w in block]).tolist(), strict=True))
                block, size = [], 0
        return found | dict(zip(block, self.lengths([w.encode() for w in block]).tolist(), strict=True))

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text; the texts' new pre-tokens are merged together."""
        split, counts, new = [], [], set()
        if len(self.known) > TABLE_WORDS:
            self.known.clear()
        for text in texts:
            parts = self.special.split(text) if self.special is not None and self.special.search(text) else [text]
            words = [w for part in parts for w in self.pattern.findall(part)]
            split.append(words)
            counts.append(len(parts) - 1)
            new.update(words)
        new = [w for w in new if w not in self.known]
        self.known |= self._learn(new)
        counts = [n + sum(map(self.known.__getitem__, words)) for n, words in zip(counts, split, strict=True)]
        for w in new:
            if len(w) > LONGEST_KEPT:
                del self.known[w]
        return counts


_counters: dict[str, Counter] = {}


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of docs (doc_id, text)."""

    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _counters:
            _counters[vocabulary] = Counter(vocabulary)
        counter = _counters[vocabulary]
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [t or "" for t in part.column(1).to_pylist()]
                counts = [n for i in range(0, len(texts), 64) for n in counter.count(texts[i : i + 64])]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
