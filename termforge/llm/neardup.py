"""Problem 2: near-duplicate records with small edits.

Each record becomes the set of its word shingles and a SetSketch: register i holds the least of exponentially distributed
hashes of the set, on an exponential scale of base ``BASE`` and truncated to 16 bits. Sketches of parts merge by maximum (``merged``).

1. Records with equal shingle sets form a class; one row per class goes on.
2. Registers are banded. Classes that agree on all registers of a band are candidates. The chance of agreeing on one
   register is close to the similarity, so ``BANDS`` bands of ``ROWS`` registers find a pair at the threshold with
   probability above 0.99 and at 1.1 times the threshold above 0.999.
3. A band's bucket with more than ``BUCKET`` classes (pages of one mould) is not paired up: its classes go through an
   exact prefix-filter join instead, in which two sets at the threshold must share one of their rarest shingles. This is
   another method than SetSketch, for these buckets only; it loses no pair.
4. For each candidate pair the similarity is estimated jointly from both sketches by maximum likelihood over the registers
   that are smaller, equal and larger; pairs far below the threshold are left out, all others are verified on the sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termforge.llm.words import slices, words
from termforge.plans.tables import cut, join_sized, newest_per_key

BASE = 1.001
BANDS, ROWS = 45, 4
REGISTERS = BANDS * ROWS
#: Registers that the likelihood estimate compares.
ESTIMATE = 64
#: Scale of the exponential hashes: register 0 stands for minima above about 20, the greatest for those below BASE ** -65000.
RATE = 20.0
LEVELS = (1 << 16) - 2
#: A bucket with more classes than this is left to the exact join.
BUCKET = 200
#: Standard deviations that the estimate may lie below the threshold before a pair is left out.
SIGMAS = 5.0


@dataclass(frozen=True)
class Shingling:
    words: int = 3
    least_words: int = 20
    threshold: Fraction = Fraction(6, 10)


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Fixed odd multipliers and offsets, one pair per register."""
    raw = np.frombuffer(b"".join(hashlib.blake2b(i.to_bytes(4, "little"), digest_size=16).digest() for i in range(n)), np.uint64).reshape(n, 2)
    return raw[:, 0] | np.uint64(1), raw[:, 1]


_A, _C = _multipliers(REGISTERS)
_WORD_SEED = np.uint64(0x9E3779B97F4A7C15)


def _word_hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "replace"), digest_size=8).digest(), "little")


class Shingler:
    """64-bit hashes of the distinct word shingles of texts; word hashes are kept per worker up to a bound."""

    def __init__(self, shingling: Shingling) -> None:
        self.n, self.least = shingling.words, max(shingling.least_words, shingling.words)
        self.known: dict[str, int] = {}

    def sets(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """All sets joined and sorted, where each begins, and the texts' indexes; texts with too few words are left out."""
        if len(self.known) > 1_000_000:
            self.known.clear()
        known = self.known
        flat: list[int] = []
        sizes, kept = [], []
        for i, text in enumerate(texts):
            own = words(text)
            if len(own) < self.least:
                continue
            try:
                flat += [known[w] for w in own]
            except KeyError:
                for w in own:
                    if w not in known:
                        known[w] = _word_hash(w)
                flat += [known[w] for w in own]
            sizes.append(len(own))
            kept.append(i)
        if not kept:
            return np.empty(0, np.uint64), np.empty(0, np.int64), []
        ids = np.array(flat, np.uint64)
        count = len(ids) - self.n + 1
        grams = np.zeros(count, np.uint64)
        for i in range(self.n):
            grams = (grams ^ ids[i : i + count]) * _WORD_SEED
            grams ^= grams >> np.uint64(32)
        ends = np.cumsum(sizes)
        owner = np.repeat(np.arange(len(sizes)), sizes)[:count]
        inside = np.arange(count) + self.n <= ends[owner]
        grams, owner = grams[inside], owner[inside]
        order = np.lexsort((grams, owner))
        grams, owner = grams[order], owner[order]
        first = np.ones(len(grams), bool)
        first[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
        grams, owner = grams[first], owner[first]
        return grams, np.searchsorted(owner, np.arange(len(sizes))), kept


def sketches(grams: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A row of ``REGISTERS`` 16-bit registers for each set."""
    out = np.empty((len(starts), REGISTERS), np.uint16)
    step = 400  # sets at once, so that the working arrays stay in the cache
    for s in range(0, len(starts), step):
        at = starts[s : s + step]
        part = grams[at[0] : starts[s + step] if s + step < len(starts) else len(grams)]
        local = at - at[0]
        least = np.empty((REGISTERS, len(at)), np.uint64)
        mixed = np.empty_like(part)
        for r in range(REGISTERS):
            np.multiply(part, _A[r], out=mixed)
            np.add(mixed, _C[r], out=mixed)
            np.right_shift(mixed, np.uint64(11), out=mixed)
            least[r] = np.minimum.reduceat(mixed, local)
        # the least uniform hash gives the least exponential one; the register is its level on the exponential scale
        uniform = (least.astype(np.float64) + 0.5) / float(1 << 53)
        level = np.floor(1.0 - np.log(-np.log1p(-uniform) / RATE) / np.log(BASE))
        out[s : s + step] = np.clip(level, 0, LEVELS + 1).astype(np.uint16).T
    return out


def joint_estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity of pairs of sketches (rows of ``a`` and ``b``) of sets of known sizes.

    With u and v the sets' shares of the united size, a register of the first is larger with probability
    p(u - v J), of the second with p(v - u J), and equal otherwise, where p(x) = -log(1 - x (B - 1) / B) / log B.
    """
    larger, smaller = (a > b).sum(1).astype(float), (a < b).sum(1).astype(float)
    equal = a.shape[1] - larger - smaller
    u = size_a / (size_a + size_b)
    v = 1.0 - u
    p = lambda x: -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)
    low, high = np.zeros_like(u), np.minimum(u / v, v / u)

    def likelihood(j: np.ndarray) -> np.ndarray:
        up, down = p(np.maximum(u - v * j, 0)), p(np.maximum(v - u * j, 0))
        tiny = 1e-12
        return larger * np.log(up + tiny) + smaller * np.log(down + tiny) + equal * np.log(np.maximum(1 - up - down, tiny))

    ratio = (np.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = high - ratio * (high - low), low + ratio * (high - low)
        left = likelihood(c) > likelihood(d)
        high, low = np.where(left, d, high), np.where(left, low, c)
    return (low + high) / 2


def _sketch_batches(shingling: Shingling):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(shingling)
        for batch, texts in slices(batches, 1, 2_000_000):
            grams, starts, kept = shingler.sets([t or "" for t in texts])
            if not kept:
                continue
            found = sketches(grams, starts)
            ends = np.append(starts[1:], len(grams))
            at = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), pa.array([_class_of(grams[s:e]) for s, e in zip(starts, ends)], pa.binary()), pa.array((ends - starts).astype(np.int32)), pa.array([r.astype(">u2").tobytes() for r in found], pa.binary())], names=["record", "version", "class", "size", "sketch"])

    return run


def _class_of(grams: np.ndarray) -> bytes:
    """A 128-bit name of a set: equal sets have equal names, and different ones do not meet at any number of documents."""
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sets (or the sketches, row by row): a register stands for the least hash, which the greater level names."""
    return np.maximum(a, b)


def _set_batches(shingling: Shingling):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(shingling)
        for _, texts in slices(batches, 1, 2_000_000):
            grams, starts, _ = shingler.sets([t or "" for t in texts])
            sets = np.split(grams, starts[1:]) if len(starts) else []
            yield pa.RecordBatch.from_arrays([pa.array([_class_of(x) for x in sets], pa.binary()), pa.array([len(x) for x in sets], pa.int32()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["class", "size", "grams"])

    return run


def _estimate_batches(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), ">u2").reshape(batch.num_rows, -1) for c in ("sketch_a", "sketch_b"))
            sizes = [batch.column(c).to_numpy().astype(float) for c in ("size_a", "size_b")]
            found = joint_estimate(a, b, *sizes)
            spread = SIGMAS * np.sqrt(threshold * (1 - threshold) / a.shape[1])
            keep = pa.array(np.flatnonzero(found >= threshold - spread))
            yield pa.RecordBatch.from_arrays([batch.column(c).take(keep) for c in ("class_a", "class_b")], names=["class_a", "class_b"])

    return run


def _verify_batches(threshold: Fraction):
    up, down = threshold.numerator, threshold.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, common_, union_ = [], [], []
            for i, (x, y) in enumerate(zip(batch.column("grams_a").to_pylist(), batch.column("grams_b").to_pylist())):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(a, b, assume_unique=True))
                union = len(a) + len(b) - common
                if down * common >= up * union:
                    keep.append(i)
                    common_.append(common)
                    union_.append(union)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("class_a").take(at), batch.column("class_b").take(at), pa.array(common_, pa.int64()), pa.array(union_, pa.int64())], names=["class_a", "class_b", "common", "all_grams"])

    return run


@dataclass(frozen=True)
class NearDuplicates:
    """``members``: record, class, one row per record. ``links``: class_a < class_b, common, all_grams, one row per pair of different sets, verified as they are read."""

    members: DataFrame
    links: DataFrame


def near_duplicates(df: DataFrame, record: str, texts: list[str], version: str | None = None, shingling: Shingling = Shingling(words=5, threshold=Fraction(8, 10))) -> NearDuplicates:
    """Pairs of records whose sets of word shingles have a Jaccard similarity of at least the threshold.

    The columns ``texts`` are joined by newlines, null as empty. Of several rows with one ``record`` the one with the greatest
    ``version`` counts; rows with a null record are left out, as are records with fewer words than ``least_words``.
    Records of equal sets share a class and are not linked to each other. Candidates of all sizes of group are
    found by one of two ways (see the module), none is dropped.
    """
    t = float(shingling.threshold)
    joined = F.concat_ws("\n", *[F.coalesce(F.col(c), F.lit("")) for c in texts])
    order = F.col(version) if version else F.lit(0)
    source = df.select(F.col(record).alias("record"), joined.alias("text"), order.alias("version")).where("record is not null")
    types = {f.name: f.dataType.simpleString() for f in source.schema}
    # One pass over the texts; all but the verification works on what it writes.
    table = cut(source.mapInArrow(_sketch_batches(shingling), f"record {types['record']}, version {types['version']}, class binary, size int, sketch binary"), "sketches")
    members = cut(newest_per_key(table.select("record", "version", "class"), ["record"], ["version"]).select("record", "class"), "members")

    pairs = cut(_candidates(source, table, shingling), "candidates")
    sketch = table.select("class", "size", F.substring("sketch", 1, 2 * ESTIMATE).alias("sketch"))
    sketch = join_sized(sketch, _classes_of(pairs), "class", "left_semi", 16).dropDuplicates(["class"])
    likely = cut(_with_both(pairs, sketch).mapInArrow(_estimate_batches(t), "class_a binary, class_b binary"), "likely")
    links = _with_both(likely, _sets_of(source, table, _classes_of(likely), shingling)).mapInArrow(_verify_batches(shingling.threshold), _LINK)
    return NearDuplicates(members, links)


_LINK = "class_a binary, class_b binary, common bigint, all_grams bigint"


def _classes_of(pairs: DataFrame) -> DataFrame:
    both = pairs.select(F.explode(F.array("class_a", "class_b")).alias("class"))
    return cut(both.distinct(), "classes")


def _with_both(pairs: DataFrame, side: DataFrame) -> DataFrame:
    for s in "ab":
        pairs = pairs.join(side.select(*[F.col(c).alias(f"{c}_{s}") for c in side.columns]), f"class_{s}")
    return pairs


def _sets_of(source: DataFrame, table: DataFrame, classes: DataFrame, shingling: Shingling) -> DataFrame:
    """``class, size, grams`` of some classes, from the text of one record of each."""
    kept = join_sized(table.select("record", "class"), classes, "class", "left_semi", 16).groupBy("class").agg(F.min("record").alias("record"))
    records = cut(kept.select("record"), "class-records")
    sets = join_sized(source, records, "record", "left_semi").mapInArrow(_set_batches(shingling), "class binary, size int, grams binary")
    return sets.dropDuplicates(["class"])


def _candidates(source: DataFrame, table: DataFrame, shingling: Shingling) -> DataFrame:
    """``class_a < class_b`` of classes that share a band's bucket, and of classes in large buckets that share a rare shingle."""
    bands = F.array(*[F.xxhash64(F.lit(i), F.substring("sketch", 1 + 2 * ROWS * i, 2 * ROWS)) for i in range(BANDS)])
    banded = table.select("class", F.explode(bands).alias("band"))
    # Which buckets hold two classes at all: a state of fixed size per bucket, combined before the shuffle.
    mark = F.xxhash64("class")  # 64 bits for each bucket of a few classes, and numbers are aggregated by hash, names by sorting
    shared = cut(banded.groupBy("band").agg(F.min(mark).alias("least"), F.max(mark).alias("most")).where("least <> most").select("band"), "shared-buckets")
    filled = cut(join_sized(banded, shared, "band", "left_semi", 24).distinct(), "filled-buckets")
    large = cut(filled.groupBy("band").count().where(F.col("count") > BUCKET).select("band"), "large-buckets")
    if large.count() == 0:
        return _pairs_within(filled).distinct()
    small = join_sized(filled, large, "band", "left_anti", 24)
    hot = cut(join_sized(filled, large, "band", "left_semi", 24).select("class").distinct(), "hot-classes")
    return _pairs_within(small).unionByName(_prefix_pairs(source, table, hot, shingling)).distinct()


def _pairs_within(filled: DataFrame) -> DataFrame:
    """Pairs of buckets of at most ``BUCKET`` classes."""
    buckets = filled.groupBy("band").agg(F.sort_array(F.collect_list("class")).alias("classes"))
    first = buckets.select("classes", F.posexplode("classes").alias("at", "class_a"))
    return first.select("class_a", F.explode(F.slice("classes", F.col("at") + 2, BUCKET)).alias("class_b"))


def _prefix_pairs(source: DataFrame, table: DataFrame, hot: DataFrame, shingling: Shingling) -> DataFrame:
    """All pairs at the threshold among some classes, by the prefix filter: no pair is lost.

    With its shingles in one common order, here rarest first, two sets at the threshold t share one among the
    first size - ceil(t * size) + 1 of each.
    """
    t = float(shingling.threshold)
    sets = cut(_sets_of(source, table, hot, shingling), "hot-sets")
    grams = sets.mapInArrow(_gram_rows, "class binary, size int, gram bigint")
    ranked = grams.join(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df")), "gram")
    rows = ranked.groupBy("class", "size").agg(F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("ranked"))
    need = (F.col("size") - F.ceil(F.lit(t) * F.col("size") - 1e-9) + 1).cast("int")
    prefix = cut(rows.select("class", "size", F.explode(F.slice("ranked", F.lit(1), need)).alias("x")).select("class", "size", F.col("x.gram").alias("gram")), "prefixes")
    a, b = (prefix.select(*[F.col(c).alias(f"{c}_{s}") for c in ("class", "size")], "gram") for s in "ab")
    sized = (F.col("size_a") >= F.lit(t - 1e-9) * F.col("size_b")) & (F.col("size_b") >= F.lit(t - 1e-9) * F.col("size_a"))
    return a.join(b, "gram").where((F.col("class_a") < F.col("class_b")) & sized).select("class_a", "class_b")


def _gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.frombuffer(x, np.int64) for x in batch.column("grams").to_pylist()]
        at = pa.array(np.repeat(np.arange(len(sets)), [len(x) for x in sets]))
        yield pa.RecordBatch.from_arrays([batch.column("class").take(at), batch.column("size").take(at), pa.array(np.concatenate(sets) if sets else [], pa.int64())], names=["class", "size", "gram"])


def expanded(found: NearDuplicates) -> DataFrame:
    """``record_a < record_b``: every pair of records at the threshold, those of equal sets included."""
    a, b = (found.members.select(F.col("record").alias(f"record_{s}"), F.col("class").alias(f"class_{s}")) for s in "ab")
    linked = found.links.join(a, "class_a").join(b, "class_b").select("record_a", "record_b")
    copies = a.join(b, F.col("class_a") == F.col("class_b")).where("record_a < record_b").select("record_a", "record_b")
    return linked.select(F.least("record_a", "record_b").alias("record_a"), F.greatest("record_a", "record_b").alias("record_b")).unionByName(copies)
