"""Problem 7: the corpus as token ids of a public byte-level vocabulary.

Pair occurrence index: the distinct pieces of a slice of texts are laid out as one array of symbols with links to their
neighbours, and every pair of neighbours is mapped to all its positions. The ranks that occur are taken in ascending
order; merging a rank at all its positions updates only the lists of the pairs beside them. A pair that a merge creates
holds the new symbol, so its rank is higher, and one pass over the ranks is exact.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termforge.llm.words import slices

#: The public splitting pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Encoded pieces kept for later slices of a task.
CACHE_PIECES = 400_000


def default_vocabulary() -> str:
    """The path of byte_bpe_50k where the public tokenizer files are installed."""
    return "/opt/tokenizers/byte_bpe_50k.tiktoken"


class PairIndexEncoder:
    """Encodes texts by a table of byte strings and ranks (``.tiktoken``), or the same vocabulary as ``.json``."""

    def __init__(self, path: str) -> None:
        self.ranks = _json_ranks(path) if path.endswith(".json") else {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
        self.bytes = {i: b for b, i in self.ranks.items()}
        self.single = [self.ranks[bytes([b])] for b in range(256)]
        self.merged: dict[tuple[int, int], int | None] = {}
        self.cache: dict[str, list[int]] = {}
        self.split = regex.compile(PATTERN).findall

    def merge_of(self, a: int, b: int) -> int | None:
        """The id of two neighbours joined, None if the vocabulary has no such token."""
        try:
            return self.merged[a, b]
        except KeyError:
            if len(self.merged) > 4_000_000:
                self.merged.clear()
            found = self.merged[a, b] = self.ranks.get(self.bytes[a] + self.bytes[b])
            return found

    def encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        symbols: list[int] = []
        ends = []
        for piece in pieces:
            symbols += [self.single[b] for b in piece.encode("utf-8", "replace")]
            symbols.append(-1)
            ends.append(len(symbols))
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merge_of = self.merge_of
        index: dict[tuple[int, int], list[int]] = {}
        active: list[tuple[int, int, int]] = []

        def note(at: int) -> None:
            pair = symbols[at], symbols[after[at]]
            places = index.get(pair)
            if places is not None:
                places.append(at)
            elif (rank := merge_of(*pair)) is not None:
                index[pair] = [at]
                heapq.heappush(active, (rank, *pair))

        for at in range(n - 1):
            if symbols[at] >= 0 and symbols[at + 1] >= 0:
                note(at)
        while active:
            rank, a, b = heapq.heappop(active)
            for at in sorted(index.pop((a, b))):
                right = after[at] if symbols[at] == a else -1
                if right < 0 or symbols[right] != b:
                    continue  # an earlier merge took one of the two
                symbols[at], symbols[right] = rank, -2
                following = after[at] = after[right]
                before[following] = at
                if symbols[following] >= 0:
                    note(at)
                if before[at] >= 0 and symbols[before[at]] >= 0:
                    note(before[at])
        start, out = 0, []
        for end in ends:
            out.append([s for s in symbols[start : end - 1] if s >= 0])
            start = end
        return out

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        split = [self.split(t) if t else [] for t in texts]
        cache = self.cache
        if len(cache) > CACHE_PIECES:
            cache.clear()
        new = list({p for pieces in split for p in pieces if p not in cache})
        cache.update(zip(new, self.encode_pieces(new)))
        return [[i for p in pieces for i in cache[p]] for pieces in split]


def _json_ranks(path: str) -> dict[bytes, int]:
    """Byte strings and ids of a tokenizer file that spells bytes as printable characters."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    spelled = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    model = json.loads(Path(path).read_text())
    special = {t["content"] for t in model.get("added_tokens", [])}
    return {bytes(spelled[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}


@lru_cache(maxsize=2)
def _encoder(path: str) -> PairIndexEncoder:
    """One per Python worker."""
    return PairIndexEncoder(path)


def _run(path: str, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch, texts in slices(batches, 1, most):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(encoder.encode(texts), pa.list_(pa.int32()))], names=["record", "ids"])

    return run


def token_ids(df: DataFrame, record: str, text: str, vocabulary: str | None = None, slice_chars: int = 1_000_000) -> DataFrame:
    """``record, ids array<int>``: one row per row of ``df``, without special tokens (their strings are ordinary text).

    A null or empty text has an empty list; blanks have their own ids. Rows are kept as they are, repeated ones and null
    records too; other columns are not read. The vocabulary file must lie at the same path on every executor. No shuffle.
    """
    source = df.select(F.col(record).alias("record"), F.col(text).alias("text"))
    return source.mapInArrow(_run(vocabulary or default_vocabulary(), slice_chars), f"record {source.schema['record'].dataType.simpleString()}, ids array<int>")
