import math
import random
from collections import Counter, defaultdict

import pytest

from termforge.llm import frequency
from termforge.llm.distinctive import PLAIN, Weighting, distinctive_terms, distinctive_values
from termforge.llm.frequency import LastSeen, marked, text_term_counts, value_pairs, value_term_counts


def _texts(n=60):
    rng = random.Random(2)
    pool = ["alpha", "Beta", "gamma", "delta", "eps", "zeta", "eta", "ab", "x1y", "naïve", "Kelvin"]
    return {f"r{i:02d}": " ".join(rng.choice(pool[: 3 + i % 9]) for _ in range(rng.randrange(1, 30))) + (f" only{chr(97 + i % 7)}" if i % 3 == 0 else "") for i in range(n)}


def _terms(text):
    import re

    return [x.lower() for x in re.findall("[A-Za-z]{3,}", text)]


def _brute(texts, score, least=2):
    own = {r: Counter(_terms(t)) for r, t in texts.items()}
    own = {r: c for r, c in own.items() if c}
    df = Counter(t for c in own.values() for t in c)
    out = {}
    for r, c in own.items():
        scored = sorted((-round(score(n, df[t], len(own), sum(c.values())), 6), t) for t, n in c.items() if df[t] >= least)
        out[r] = [(t, -s) for s, t in scored if -s > 0]
    return out


@pytest.mark.parametrize("top", [1, 3])
def test_plain_weights(spark, top):
    texts = _texts()
    df = spark.createDataFrame(list(texts.items()) + [("n1", None), ("n2", ""), ("n3", " \n")], "term string, n string")
    got = defaultdict(list)
    for r in distinctive_terms(df, "term", "n", PLAIN, top=top).orderBy("record", "place").collect():
        got[r["record"]].append((r["term"], r["score"]))
    expected = {r: x[:top] for r, x in _brute(texts, lambda n, d, total, _: n * math.log(total / d)).items() if x}
    assert {r: [t for t, _ in x] for r, x in got.items()} == {r: [t for t, _ in x] for r, x in expected.items()}
    assert distinctive_terms(df.limit(0), "term", "n", PLAIN).count() == 0


def test_saturating_weights_of_values(spark):
    texts = _texts(30)
    average = sum(len(_terms(t)) for t in texts.values()) / len(texts)
    expected = _brute(texts, lambda n, d, total, length: math.log(1 + (total - d + 0.5) / (d + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * length / average)))
    rows = [(r, f" {t.upper()}\t") for r, text in texts.items() for t in _terms(text)] + [("r00", None), ("r00", "  "), (None, "x")]
    df = spark.createDataFrame(rows, "record string, name string")
    got = {r["record"]: r["term"] for r in distinctive_values(value_pairs(df, "record", "name"), Weighting()).collect()}
    assert got == {r: x[0][0] for r, x in expected.items() if x}
    by_text = {r["record"]: r["term"] for r in distinctive_terms(spark.createDataFrame(list(texts.items()), "id string, text string"), "id", "text").collect()}
    assert by_text == got


def test_counts_and_marks(spark, monkeypatch):
    monkeypatch.setattr(frequency, "TABLE_TERMS", 3)  # flushes often
    texts = _texts()
    own = [Counter(_terms(t)) for t in texts.values()]
    occurrences, records = sum(own, Counter()), Counter(t for c in own for t in c)
    total = sum(1 for c in own if c)
    expected = {t: (occurrences[t], records[t], "common" if 100 * records[t] > 40 * total else "rare" if records[t] < 3 else None) for t in occurrences}
    df = spark.createDataFrame([(t, 1) for t in [*texts.values(), None, "", "  "]], "body string, term int")
    assert {r["term"]: (r["occurrences"], r["records"], r["mark"]) for r in marked(text_term_counts(df, "body"), 40).collect()} == expected
    rows = [(r, t) for r, text in texts.items() for t in _terms(text)]
    pairs = value_pairs(spark.createDataFrame(rows, "record string, v string"), "record", "v")
    assert {r["term"]: (r["occurrences"], r["records"], r["mark"]) for r in marked(value_term_counts(pairs), 40).collect()} == expected
    assert marked(text_term_counts(df.limit(0), "body"), 40).count() == 0


def test_last_seen_counts_a_record_once():
    c = LastSeen()
    c.add(1, ["a", "b", "a"])
    c.add(1, ["a"])
    c.add(2, ["a"])
    assert c.table["a"][:2] == [4, 2] and c.table["b"][:2] == [1, 1]
