"""Problem 8: held-out test passages inside the training corpus.

Winnowing: of every window of consecutive k-grams of words the least hash is kept, on both sides by the same rule, so a
shared run of at least ``gram + window - 1`` words has a common kept hash. The kept hashes of both sides are tables that are
joined; before that, a bitmap of fixed size of the test side's hashes takes out most of the corpus's. Each pair of a document and an
item that share a hash is then extended left and right word by word, which is the exact check of the run's length.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termforge.llm.words import slices, words
from termforge.plans.tables import cut, join_sized

#: Bits of the bitmap of the test side's hashes: its 64-bit rows are at most 65,536 at any size. It only saves work; the join decides.
BITMAP_BITS = 22
#: Word hashes that a worker keeps.
CACHE_WORDS = 1_000_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _gram_hashes(ids: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` ids from each position on; grams that hold the id 0 (a text's end) get the greatest value."""
    n = len(ids) - gram + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    value = np.zeros(n, np.uint64)
    for i in range(gram):
        value = value * _ODD + ids[i : i + n]
        value ^= value >> np.uint64(29)
    value *= _MIX
    value ^= value >> np.uint64(32)
    zeros = np.concatenate(([0], np.cumsum(ids == 0)))
    value[zeros[gram:] - zeros[:-gram] > 0] = _NONE
    return value


def _winnowed(hashes: np.ndarray, window: int) -> np.ndarray:
    """The positions whose hash is the least of some window of consecutive grams, all of them on ties."""
    n = len(hashes)
    if n == 0:
        return np.empty(0, np.int64)
    padded = np.concatenate((hashes, np.full(window - 1, _NONE)))
    least = np.min(np.lib.stride_tricks.sliding_window_view(padded, window), axis=1)
    kept = np.zeros(n, bool)
    for i in range(window):
        m = n - i
        kept[i:] |= hashes[i:] == least[:m]
    return np.flatnonzero(kept & (hashes != _NONE))


class WordHashes:
    """64-bit hashes of words, none of them 0."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def of(self, text: str) -> list[int]:
        own = words(text)
        known = self.known
        try:
            return [known[w] for w in own]
        except KeyError:
            if len(known) > CACHE_WORDS:
                known.clear()
            for w in own:
                if w not in known:
                    known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) or 1
            return [known[w] for w in own]


def _bit(hashes: np.ndarray) -> np.ndarray:
    return hashes >> np.uint64(64 - BITMAP_BITS)


def _prints(run: int, gram: int, bitmap: np.ndarray | None):
    """For Arrow batches of (record, text): (record, h) of the kept hashes of each text, once per text; with a bitmap only those that it has."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashing = WordHashes()
        for batch, texts in slices(batches, 1):
            flat: list[int] = []
            starts = [0]
            for text in texts:
                own = hashing.of(text) if text else []
                if len(own) >= run:
                    flat += own
                flat.append(0)
                starts.append(len(flat))
            hashes = _gram_hashes(np.array(flat, np.uint64), gram)
            at = _winnowed(hashes, run - gram + 1)
            kept = hashes[at]
            if bitmap is not None and len(kept):
                bits = _bit(kept)
                there = (bitmap[(bits >> np.uint64(6)).astype(np.int64)] >> (bits & np.uint64(63))) & np.uint64(1) > 0
                at, kept = at[there], kept[there]
            owners = np.searchsorted(np.array(starts), at, side="right") - 1
            once = np.unique(np.stack([owners.astype(np.uint64), kept]), axis=1) if len(at) else np.empty((2, 0), np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(once[0].astype(np.int64))), pa.array(once[1].view(np.int64))], names=["record", "h"])

    return work


def _bitmap(prints: DataFrame) -> np.ndarray:
    """The bitmap of a table's hashes, worked out as an aggregate of at most 2 ** (BITMAP_BITS - 6) rows."""
    bit = F.shiftrightunsigned("h", 64 - BITMAP_BITS)
    rows = prints.select(bit.alias("b")).groupBy(F.expr("shiftrightunsigned(b, 6)").alias("row")).agg(F.expr("bit_or(shiftleft(1L, cast(b & 63 as int)))").alias("bits"))
    out = np.zeros(1 << (BITMAP_BITS - 6), np.uint64)
    for r in rows.collect():
        out[r["row"]] = np.uint64(r["bits"] & 0xFFFFFFFFFFFFFFFF)
    return out


def longest_run(a: list[int], b: list[int], gram: int) -> int:
    """The most consecutive words that two texts share, if at least ``gram``, else 0."""
    places: dict[int, list[int]] = defaultdict(list)
    left, right = (_gram_hashes(np.array(x, np.uint64), gram) for x in (a, b))
    for i, h in enumerate(right.tolist()):
        places[h].append(i)
    best = 0
    for i in np.flatnonzero(np.isin(left, right)).tolist():
        for j in places[int(left[i])]:
            if i and j and a[i - 1] == b[j - 1]:
                continue  # inside a run that was counted from its beginning
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            best = max(best, n)
    return best if best >= gram else 0


def _verified(run: int, gram: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashing, last, own = WordHashes(), None, []
        for batch in batches:
            rows, lengths = [], []
            for i, (text, item) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                if text is not last:
                    last, own = text, hashing.of(text)
                n = longest_run(own, hashing.of(item), gram)
                if n >= run:
                    rows.append(i)
                    lengths.append(n)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(lengths, pa.int64())], names=["doc", "item", "run_words"])

    return work


def leaks(docs: DataFrame, doc: str, text: str, tests: DataFrame, item: str, item_text: str, run: int = 12, gram: int = 10) -> DataFrame:
    """``doc, item, run_words``: every document that shares a run of at least ``run`` consecutive words with a test item, and the longest such run.

    The test side is broadcast only where its measured size allows it, else both sides' hashes are joined by shuffle, skewed hashes split
    by AQE. Texts are read again for the pairs alone. Null ids, null and empty texts and texts with fewer than ``run`` words give no row;
    repeated rows give one. Other columns are not read.
    """
    if not 0 < gram <= run:
        raise ValueError("gram must lie between 1 and run")
    source = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text")).where("doc is not null and text is not null")
    items = tests.select(F.col(item).alias("item"), F.col(item_text).alias("item_text")).where("item is not null and item_text is not null").distinct()
    kinds = {n: s.schema[n].dataType.simpleString() for n, s in (("doc", source), ("item", items))}
    asked = cut(items.mapInArrow(_prints(run, gram, None), f"record {kinds['item']}, h bigint").withColumnRenamed("record", "item").distinct(), "test-prints")
    found = source.mapInArrow(_prints(run, gram, _bitmap(asked)), f"record {kinds['doc']}, h bigint").withColumnRenamed("record", "doc")
    pairs = cut(join_sized(found, asked, "h").select("doc", "item").distinct(), "leak-pairs")
    texts = join_sized(pairs, items, "item", row_bytes=16_384)  # far above the length of an item
    held = join_sized(source, cut(pairs.select("doc").distinct(), "leak-docs"), "doc", "left_semi", 32)
    both = held.join(texts, "doc")
    checked = both.select("doc", "item", "text", "item_text").mapInArrow(_verified(run, gram), f"doc {kinds['doc']}, item {kinds['item']}, run_words bigint")
    return checked.groupBy("doc", "item").agg(F.max("run_words").alias("run_words"))


def leak_report(found: DataFrame) -> DataFrame:
    """Per test item: how many documents hold a passage of it, and the longest run."""
    return cut(found, "leaks").groupBy("item").agg(F.count(F.lit(1)).alias("documents"), F.max("run_words").alias("longest_run"))
