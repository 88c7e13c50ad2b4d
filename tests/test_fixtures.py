"""Golden values for features and scores on small collections."""

import pytest
from pyspark.sql import functions as F

from termforge.functions import text as T
from termforge.functions.scores import length_code
from termforge.operators import model, retrieval
from termforge.operators.document_features import DOCUMENT_FEATURES, document_features
from termforge.operators.index import build_index, collection_stats, open_index, term_stats, with_ordinals
from termforge.operators.pair_features import pair_features
from termforge.operators.query_features import query_features, query_frequencies

BODIES = {"D1": "cat cat dog", "D2": "cat mouse", "D3": "dog mouse mouse", "D4": "bird dog", "D5": "", "D6": "cat " * 100 + "dog", "D7": "DOG Cat cat,"}
BM25 = {
    "cat dog": [0.87404406, 0.49697345, 0.3063804, 0.31678575, 0, 0.73666215, 0],
    "cat cat dog": [1.4417077, 0.9939469, 0.3063804, 0.31678575, 0, 1.3977633, 0],
    "dog mouse": [0.3063804, 0.7382177, 1.1496032, 0.31678575, 0, 0.07556096, 0],
    "bird dog": [0.3063804, 0, 0.3063804, 1.4212558, 0, 0.07556096, 0],
    "Cat cat,": [0, 0, 0, 0, 0, 0, 2.1363838],
    "missing": [0] * 7,
    "": [0] * 7,
    "only_title": [0] * 7,
}
TFIDF = {"cat dog": [4.79175949, 1.69314718, 1.40546513, 1.40546513, 0], "cat cat dog": [8.17805386, 3.38629436, 1.40546513, 1.40546513, 0], "dog mouse": [1.40546513, 1.69314718, 4.79175949, 1.40546513, 0], "bird dog": [1.40546513, 0, 1.40546513, 3.50407743, 0], "missing": [0] * 5}
TOP = {"cat dog": [0.87404406, 0.73666215, 0.49697345, 0.31678575, 0.3063804], "dog mouse": [1.1496032, 0.7382177, 0.31678575, 0.3063804, 0.07556096], "bird dog": [1.4212558, 0.3063804, 0.3063804, 0.07556096, 0], "Cat cat,": [2.1363838, 0, 0, 0, 0], "missing": [0] * 5}


def _docs(spark, ids):
    return spark.createDataFrame([(i, "only_title cat cat", BODIES[i]) for i in ids], "doc_id string, title string, body string")


def _queries(spark, texts):
    return spark.createDataFrame([(t, t) for t in texts], "query_id string, query string")


def _pairs(spark, texts, ids):
    return spark.createDataFrame([(t, i) for t in texts for i in ids], "query_id string, doc_id string")


def test_bm25_is_exact_in_single_precision(spark):
    docs = _docs(spark, BODIES)
    stats = collection_stats(docs.select(F.size(T.whitespace_tokens("body")).alias("body_length")))
    assert stats.first().asDict() == {"num_docs": 7, "doc_count": 6, "sum_ttf": 114, "average_length": 19.0}
    found = pair_features(_pairs(spark, BM25, BODIES), _queries(spark, BM25), docs, term_stats(docs), stats, ("BM25Score",))
    got = {(r["query_id"], r["doc_id"]): r["BM25Score"] for r in found.collect()}
    import numpy as np

    for q, values in BM25.items():
        for d, v in zip(BODIES, values):
            assert np.float32(got[q, d]) == np.float32(v), (q, d)


def test_tfidf(spark):
    docs = _docs(spark, list(BODIES)[:5])
    stats = collection_stats(docs.select(F.size(T.whitespace_tokens("body")).alias("body_length")))
    found = pair_features(_pairs(spark, TFIDF, list(BODIES)[:5]), _queries(spark, TFIDF), docs, term_stats(docs), stats, ("TFIDFScore",))
    got = {(r["query_id"], r["doc_id"]): r["TFIDFScore"] for r in found.collect()}
    for q, values in TFIDF.items():
        for d, v in zip(BODIES, values):
            assert got[q, d] == pytest.approx(v, rel=1e-6)


def test_top_scores_and_index_round_trip(spark, tmp_path):
    index = build_index(_docs(spark, BODIES))
    index.write(str(tmp_path / "index"))
    index = open_index(spark, str(tmp_path / "index"))
    got = {r["query_id"]: [r[f"BM25Top{i}Score"] for i in range(1, 6)] for r in retrieval.top_scores(_queries(spark, TOP), index, 5).collect()}
    for q, values in TOP.items():
        assert got[q] == pytest.approx(values, rel=1e-6)
    assert with_ordinals(index.docs.select("doc_id")).orderBy("doc_ord").collect() == [(d, i) for i, d in enumerate(BODIES)]
    with pytest.raises(ValueError):
        retrieval.top_k(_queries(spark, TOP), index, 0)


def test_length_code(spark):
    lengths = [0, 1, 23, 24, 39, 40, 41, 55, 56, 57, 101, 1000]
    rows = spark.createDataFrame([(x,) for x in lengths], "n int").select(length_code(F.col("n")).alias("c")).collect()
    assert [r["c"] for r in rows][-2:] == [96, 984] and [r["c"] for r in rows][:7] == [0, 1, 23, 24, 39, 40, 40]


DOCS = [
    (None, None, [0] * 12),
    ("Cat 12", "dog dog!\n\nzzz 3.5 https://x", [7, 2, 5, 2, 1, 1, 1, 4, 33 / 1024, 6 / 9, 6, 1]),
    ("hello,", "WORLD _ 007 café Привет 😀", [7, 2, 11, 1, 0, 1, 1, 5, 41 / 1024, 4 / 6, 4, 0]),
    ("www", ".cat", [2, 1, 1, 1, 0, 0, 1, 1, 7 / 1024, 0.5, 1, 1]),
    (" \t", "\n\n", [0] * 8 + [4 / 1024, 0, 0, 0]),
]
_ORDER = ["doc_word_count", "doc_vowel_count", "doc_special_character_count", "doc_paragraph_count", "doc_title_number_count", "doc_body_number_count", "doc_title_non_dictionary_count", "doc_body_non_dictionary_count", "doc_size_kbyte", "doc_non_dictionary_ratio", "doc_non_dictionary_ratio_count", "doc_has_url"]


def test_document_features(spark):
    docs = spark.createDataFrame([(str(i), t, b) for i, (t, b, _) in enumerate(DOCS)], "doc_id string, title string, body string")
    words = spark.createDataFrame([(w,) for w in ("cat", "dog", "hello", "world", "known")], "word string")
    found = document_features(docs, words)
    assert found.columns == ["doc_id", *DOCUMENT_FEATURES]
    got = {r["doc_id"]: [r[n] for n in _ORDER] for r in found.collect()}
    for i, (_, _, values) in enumerate(DOCS):
        assert got[str(i)] == pytest.approx(values, rel=1e-6), i


QUERIES = {
    "": [0] * 9,
    " \t": [0, 1, 0, 0, 0, 0, 0, 0, 0],
    "cat dog": [2, 0, 2, 4, 0, 0, 1.0986123, 1.3862944, 1.2527629],
    "Cat, dog! 12.5": [3, 3, 2, 4, 3, 1, 0, 0, 0],
    "  cat cat mouse ": [3, 1, 5, 6, 0, 0, 0, 1.3862944, 1.011601],
    "The dog eats food.": [4, 3, 6, 8, 1, 0, 0, 1.0986123, 0.4054651],
    "Привет café 😀": [3, 3, 1, 2, 9, 0, 0, 0, 0],
}
_Q = ["QueryWordCount", "QueryNonDictionaryCount", "QueryVowelCount", "QueryConsonantCount", "QuerySpecialCharacterCount", "QueryNumberCount", "QueryMinLogFrequency", "QueryMaxLogFrequency", "QueryMeanLogFrequency"]


def test_query_features(spark):
    words = spark.createDataFrame([(w,) for w in ("cat", "dog", "hello", "world", "known")], "word string")
    log = spark.createDataFrame([("cat cat dog",), ("cat mouse",), ("dog bird",), ("CAT",)], "query string")
    frequencies = query_frequencies(log)
    assert {tuple(r) for r in frequencies.collect()} == {("cat", 3), ("dog", 2), ("mouse", 1), ("bird", 1)}
    rows = spark.createDataFrame([(str(i), q) for i, q in enumerate(QUERIES)] + [("null", None)], "query_id string, query string")
    got = {r["query_id"]: r for r in query_features(rows, words, frequencies).collect()}
    for i, values in enumerate(QUERIES.values()):
        assert [got[str(i)][n] for n in _Q] == pytest.approx(values, rel=1e-6), i
    assert [got["null"][n] for n in _Q] == [0] * 9
    nouns = {q: got[str(i)]["QueryNounCount"] for i, q in enumerate(QUERIES)}
    assert (nouns["cat dog"], nouns["  cat cat mouse "], nouns[""], nouns[" \t"]) == (2, 3, 0, 0)


def _model(intercept, monomials, names):
    return model.parse_model({"format": model.FORMAT, "intercept": intercept, "feature_names": names, "monomials": [{"trained_coef": c, "splits": [{"feature_idx": names.index(n), "feature_name": n, "comparison": "GT", "border": b} for n, b in s]} for c, s in monomials]})


def test_linear_scores(spark):
    rows = spark.createDataFrame([("d0", 1.0, 1.0), ("d1", 3.0, 1.0), ("d2", 5.0, 1.0), ("d3", 3.0, 0.0)], "doc_id string, doc_word_count float, ExactMatchCount float")
    m = _model(-0.5, [(2.0, [("doc_word_count", 2.0), ("ExactMatchCount", 0.0)]), (-3.0, [("doc_word_count", 4.0)])], ["doc_word_count", "ExactMatchCount"])
    hits = model.ranked(rows, m, -1.0, 10).collect()
    assert [(r["doc_id"], r["score"]) for r in hits] == [("d1", 1.5), ("d0", -0.5), ("d3", -0.5)]
    assert hits[0]["probability"] == pytest.approx(0.8175744761936437)
    assert model.scored(rows, m, 1.5).count() == 0
    assert [r["doc_id"] for r in model.first_matches(rows, m, -1.0, 2).collect()] == ["d0", "d1"]
    active = {r["doc_id"]: [x["monomial"] for x in r["active"]] for r in model.explained(rows, m).collect()}
    assert active == {"d0": [], "d1": [0], "d2": [0, 1], "d3": []}
    assert model.hit_count(model.scored(rows, m, -1.0)) == (3, "EQUAL_TO") and model.hit_count(model.scored(rows, m, -1.0), 2) == (2, "GREATER_THAN_OR_EQUAL_TO")


def test_arbitrary_conditions_and_empty_models(spark):
    bodies = ["cat dog cat dog", "cat", "other", "dog cat x dog", "cat cat dog cat dog", ""]
    rows = spark.createDataFrame([(str(i), float("cat" in b), float("dog" in b), 1.0) for i, b in enumerate(bodies)], "doc_id string, cat float, dog float, yes float")
    m = _model(0.5, [(2.0, [("cat", 0.5)]), (-3.0, [("dog", 0.5)]), (0.25, [("yes", 0.5)])], ["cat", "dog", "yes"])
    got = [r["score"] for r in rows.select("doc_id", model.score_column(m, model.Conditions({c: F.col(c) for c in rows.columns})).alias("score")).orderBy("doc_id").collect()]
    assert got == [-0.25, 2.75, 0.75, -0.25, -0.25, 0.75]
    for t, n in ((-1, 6), (-0.25, 3), (0, 3), (0.75, 1), (2.75, 0), (3, 0)):
        assert model.scored(rows, m, t).count() == n
    empty = _model(1.0, [], [])
    assert model.scored(rows, empty, 1).count() == 0 and model.scored(rows, empty, 0).count() == 6
    negative = _model(0.0, [(-2.0, [("cat", 0.5)])], ["cat"])
    assert model.scored(rows, negative, -1).count() == 2
    constant = model.Conditions({c: F.col(c) for c in rows.columns}, {"cat": 1.0})
    assert constant.all_of(m.monomials[0].splits) is True and constant.all_of((model.Split("cat", 1.0), model.Split("dog", 0.0))) is False


def test_models_are_checked():
    good = {"format": model.FORMAT, "intercept": 0.0, "feature_names": ["a"], "monomials": [{"trained_coef": 1.0, "splits": [{"feature_idx": 0, "feature_name": "a", "comparison": "GT", "border": 0.0}]}]}
    assert model.parse_model(good).bounds == (0.0, 1.0)
    split = good["monomials"][0]["splits"][0]
    for bad in ({"format": "x"}, {"intercept": float("nan")}, {"feature_names": ["a", "a"]}, {"monomials": [{"trained_coef": float("inf"), "splits": []}]}, {"monomials": [{"trained_coef": 1.0, "splits": [split | {"comparison": "LT"}]}]}, {"monomials": [{"trained_coef": 1.0, "splits": [split | {"feature_name": "b"}]}]}, {"monomials": [{"trained_coef": 1.0, "splits": [split | {"border": float("nan")}]}]}):
        with pytest.raises(ValueError):
            model.parse_model(good | bad)
    with pytest.raises(KeyError):
        model.Conditions({}).greater("unknown", 1.0)


def test_search_by_the_index_equals_all_documents(spark):
    from termforge.operators.index import build_index
    from termforge.plans.search import feature_search, needs_a_term, planned, search_rows

    docs = spark.createDataFrame([("d1", "cat", "no such word"), ("d2", "x", "cat dog"), ("d3", "y", "bird"), ("d4", "dog", "cat cat dog bird")], "doc_id string, title string, body string")
    built = build_index(docs)
    query = planned(built, "cat dog cat")
    assert query.terms == ((0, "cat", 2, 2), (1, "dog", 1, 2))
    every = {r["doc_id"]: r.asDict() for r in search_rows(built, query).collect()}
    some = {r["doc_id"]: r.asDict() for r in search_rows(built, query, every=False).collect()}
    assert set(every) == {"d1", "d2", "d3", "d4"} and some == {k: v for k, v in every.items() if k != "d3"}
    assert {r["doc_id"] for r in search_rows(built, query, ("BM25Score",), every=False).collect()} == {"d2", "d4"}
    for feature in ("BM25Score", "TitleExactMatchRatio", "UnorderedWindow4"):
        for border in (0.0, 0.4):
            for comparison, holds in (("GT", float.__gt__), ("LT", float.__lt__), ("GE", float.__ge__), ("LE", float.__le__)):
                got = {r["doc_id"] for r in feature_search(built, query, feature, comparison, border).collect()}
                assert got == {d for d, r in every.items() if holds(float(r[feature]), border)}, (feature, comparison, border)
    by_title = model.Model(0.0, ("TitleExactMatchRatio",), (model.Monomial(1.0, (model.Split("TitleExactMatchRatio", 0.1),)),))
    by_length = model.Model(0.0, ("doc_word_count",), (model.Monomial(1.0, (model.Split("doc_word_count", 1.0),)),))
    assert needs_a_term(by_title, 0.5) and not needs_a_term(by_length, 0.5) and not needs_a_term(by_title, -0.5)
    assert planned(built, "").terms == () and search_rows(built, planned(built, ""), every=False).count() == 0


def test_unknown_features_are_rejected(spark):
    splits = spark.createDataFrame([("m", 0, 1.0, "a", 0.5), ("m", 1, 2.0, "a", 0.5), ("m", 1, 2.0, "gone", 0.5), ("m", 2, 1.0, None, 0.5)], "model_id string, monomial_no int, trained_coef double, feature_name string, border double")
    known, rejected = model.known_monomials(splits, ["a", "b"])
    assert [r["monomial_no"] for r in known.collect()] == [0]
    assert {(r["monomial_no"], r["unknown"]) for r in rejected.collect()} == {(1, 1), (2, 1)}
    with pytest.raises(Exception, match="unknown feature gone"):
        model.known_monomials(splits.where("feature_name is not null"), ["a"], strict=True)[0].collect()
