import random
from fractions import Fraction

import numpy as np

from termforge.llm import neardup
from termforge.llm.neardup import Shingler, Shingling, expanded, joint_estimate, merged, near_duplicates, sketches
from termforge.llm.words import words

THREE = Shingling(words=3, least_words=5, threshold=Fraction(6, 10))


def _grams(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def _brute(rows, shingling):
    sets = {r: _grams(t, shingling.words) for r, t in rows.items() if len(words(t)) >= shingling.least_words}
    t = shingling.threshold
    return {(a, b) for a in sets for b in sets if a < b and t.denominator * len(sets[a] & sets[b]) >= t.numerator * len(sets[a] | sets[b])}


def _mould(rng, n):
    """Pages of one mould with own parts of differing length, edits and copies."""
    base = [rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randrange(1, 4) for _ in range(60)]
    out = {}
    for i in range(n):
        w = list(base)
        for _ in range(rng.choice([0, 0, 1, 2, 6, 15])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10_000)}"
        out[f"d{i:03d}"] = " ".join(w)
    return out


def test_pairs_equal_brute_force_with_and_without_large_buckets(spark, monkeypatch):
    rows = _mould(random.Random(5), 60)
    df = spark.createDataFrame([(k, v) for k, v in rows.items()], "class string, text string")
    expected = _brute(rows, THREE)
    for bucket in (200, 3):
        monkeypatch.setattr(neardup, "BUCKET", bucket)
        got = {(r["record_a"], r["record_b"]) for r in expanded(near_duplicates(df, "class", ["text"], shingling=THREE)).collect()}
        assert got == expected


def test_edges(spark):
    long = "one two three four five six seven eight"
    rows = [(1, "t", long, 1, "x"), (1, "t", long, 1, "x"), (2, "t", long.upper() + "!", 1, "x"), (3, None, None, 1, "x"), (4, "", " \n", 1, "x"), (None, "t", long, 1, "x"), (5, "t", "a b", 1, "x"), (6, "other", "words of an old version here now", 1, "x"), (6, "t", long, 2, "x")]
    df = spark.createDataFrame(rows, "id long, title string, body string, v int, record string")
    found = near_duplicates(df, "id", ["title", "body"], "v", THREE)
    assert {(r[0], r[1]) for r in expanded(found).collect()} == {(1, 2), (1, 6), (2, 6)}
    assert found.members.groupBy("class").count().collect()[0]["count"] == 3
    assert found.links.count() == 0
    empty = near_duplicates(df.limit(0), "id", ["title", "body"], "v", THREE)
    assert expanded(empty).count() == 0 and empty.members.count() == 0


def test_registers_merge_and_the_estimate_is_near_the_similarity():
    rng = np.random.default_rng(1)
    for share in (0.2, 0.6, 0.9):
        common, own = int(300 * share), int(300 * (1 - share) / 2)
        pool = np.unique(rng.integers(0, 1 << 63, common + 2 * own + 50, dtype=np.uint64))
        pool = rng.permutation(pool)[: common + 2 * own]
        a, b = pool[: common + own], np.concatenate([pool[:common], pool[common + own :]])
        s = sketches(np.concatenate([np.sort(a), np.sort(b), np.sort(np.union1d(a, b))]), np.array([0, len(a), len(a) + len(b)]))
        assert (merged(s[0], s[1]) == s[2]).all()
        assert (merged(s[:2], s[1:]) == np.stack([s[2], s[2]])).all()
        j = joint_estimate(s[:1], s[1:2], np.array([float(len(a))]), np.array([float(len(b))]))[0]
        assert abs(j - share) < 0.12


def test_sets_of_shingles():
    shingler = Shingler(THREE)
    grams, starts, kept = shingler.sets(["a b c a b c", "", "x y", "A, B; C a-b c"])
    assert kept == [0, 3] and list(starts) == [0, 3]
    assert (grams[:3] == grams[3:]).all()
