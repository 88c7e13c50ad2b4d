import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from termforge.llm.byte_bpe import PairIndexEncoder, default_vocabulary, token_ids
from termforge.llm.leakage import WordHashes, _prints, leaks, longest_run
from termforge.llm.words import words

tokenizers = pytest.importorskip("tokenizers")


def _texts():
    rng = random.Random(7)
    odd = ["", " ", "\n\n  x", "it's we'll I'D", "aaaaaaaaaaaaaaaaaaaaaaa", "<|endoftext|>", "naïve Привет 日本語 🙂🙂 ​ ", "1234567 12.5e-3", "\r\n\t \t", "é́", "٣٤٥ ⅷ ½", "ab" * 3000]
    pool = "abc AB'.,\n\té日ж🙂1 <|>_"
    return odd + ["".join(rng.choice(pool) for _ in range(rng.randrange(80))) for _ in range(300)]


def test_ids_equal_the_library():
    path = default_vocabulary()
    library = tokenizers.Tokenizer.from_file(path.replace(".tiktoken", ".json"))
    library.encode_special_tokens = True
    texts = _texts()
    expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert PairIndexEncoder(path).encode(texts) == expected
    assert PairIndexEncoder(path.replace(".tiktoken", ".json")).encode(texts) == expected


def test_token_ids_rows(spark):
    rows = [(1, "cats and dogs", "x"), (2, None, "x"), (3, "", "x"), (3, "", "x"), (None, "a", "x")]
    df = spark.createDataFrame(rows, "record int, text string, ids string")
    got = sorted(((r["record"], list(r["ids"])) for r in token_ids(df, "record", "text").collect()), key=str)
    assert [x for x in got if x[0] in (2, 3)] == [(2, []), (3, []), (3, [])]
    assert len(got) == 5
    assert token_ids(df.limit(0), "record", "text").count() == 0


def _brute(texts, items, run):
    out = set()
    grams = {i: {tuple(w[k : k + run]) for k in range(len(w) - run + 1)} for i, t in items for w in [words(t)]}
    for d, text in enumerate(texts):
        w = words(text or "")
        own = {tuple(w[k : k + run]) for k in range(len(w) - run + 1)}
        out |= {(d, i) for i, g in grams.items() if own & g}
    return out


def test_winnowing_finds_every_shared_run():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(6)]
    for _ in range(60):
        items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(5, 40)))) for i in range(6)]
        texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 60))) for _ in range(10)] + [None, ""]
        for run, gram in ((4, 3), (6, 4), (5, 5), (5, 1)):
            sides = []
            for rows in (list(enumerate(texts)), items):
                batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.string())], names=["record", "text"])
                side = defaultdict(set)
                for out in _prints(run, gram, None)([batch]):
                    for record, h in zip(out.column(0).to_pylist(), out.column(1).to_pylist()):
                        side[h].add(record)
                sides.append(side)
            pairs = {(d, i) for h, own in sides[0].items() for d in own for i in sides[1].get(h, ())}
            expected = _brute(texts, items, run)
            assert expected <= pairs
            hashing = WordHashes()
            assert {(d, i) for d, i in pairs if longest_run(hashing.of(texts[d]), hashing.of(dict(items)[i]), gram) >= run} == expected


def test_a_bitmap_keeps_what_it_has():
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([" ".join(f"w{i}" for i in range(200))])], names=["record", "text"])
    (everything,) = _prints(12, 8, None)([batch])
    full, empty = np.full(1 << 16, 0xFFFFFFFFFFFFFFFF, np.uint64), np.zeros(1 << 16, np.uint64)
    assert next(_prints(12, 8, full)([batch])).equals(everything) and next(_prints(12, 8, empty)([batch])).num_rows == 0


def test_leaks_edges(spark):
    passage = " ".join(f"Word{i}" for i in range(12))
    docs = spark.createDataFrame([(1, "x " + passage.upper() + "! y", "q"), (1, "x " + passage.upper() + "! y", "q"), (2, None, "q"), (3, "", "q"), (4, passage[:-7], "q"), (5, passage.replace(" ", "--\n"), "q")], "doc_id long, text string, item string")
    tests = spark.createDataFrame([(7, passage), (7, passage), (8, "see: " + passage), (9, None), (10, "short")], "item_id long, text string")
    got = {(r["doc"], r["item"], r["run_words"]) for r in leaks(docs, "doc_id", "text", tests, "item_id", "text").collect()}
    assert got == {(d, i, 12) for d in (1, 5) for i in (7, 8)}
    assert leaks(docs.limit(0), "doc_id", "text", tests, "item_id", "text").count() == 0
    assert leaks(docs, "doc_id", "text", tests.limit(0), "item_id", "text").count() == 0
