import pytest

from termforge.operators import model
from termforge.operators.index import build_index
from termforge.operators.query_features import query_frequencies
from termforge.operators.registry import FAMILIES, FEATURES, all_features, checked, described, joined_vector, predicted, vector


def test_thirty_five_features_in_order(spark):
    assert len(FEATURES) == 35 and len(FAMILIES) == 17 and len({n for n, _ in FEATURES}) == 35
    assert described()[0] == {"index": 0, "name": "QueryWordCount", "family": "QueryWords"}
    docs = spark.createDataFrame([("d1", "cat", "cat dog cat"), ("d2", "", "bird dog")], "doc_id string, title string, body string")
    queries = spark.createDataFrame([("q", "cat dog"), ("e", "")], "query_id string, query string")
    words = spark.createDataFrame([("cat",)], "word string")
    pairs = queries.select("query_id").crossJoin(docs.select("doc_id"))
    found = all_features(pairs, queries, docs, build_index(docs), words, query_frequencies(queries))
    assert found.columns[2:] == [n for n, _ in FEATURES]
    rows = {(r["query_id"], r["doc_id"]): r for r in checked(found, found.columns[2:]).collect()}
    one = rows["q", "d1"]
    assert (one["ExactMatchCount"], one["TitleExactMatchCount"], one["BigramCount"], one["UnorderedWindow4"], one["doc_word_count"], one["QueryNonDictionaryCount"]) == (2, 1, 1, 2, 4, 1)
    assert one["BM25Top1Score"] == one["BM25Score"] > one["BM25Top2Score"] > one["BM25Top3Score"] == 0
    assert rows["e", "d2"]["BM25Score"] == 0 and rows["e", "d2"]["QueryWordCount"] == 0


def test_vectors_and_models(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (0.0, -2.0)], "a double, b double")
    got = predicted(rows, ["a", "b"], lambda x: x["a"] + x["b"]).select("probability", joined_vector(vector(["a"]), vector(["b"])).alias("v")).collect()
    assert got[0]["probability"] == pytest.approx(0.9525741268) and list(got[1]["v"]) == [0.0, -2.0]
    with pytest.raises(Exception, match="not finite"):
        checked(spark.createDataFrame([(float("nan"),)], "a double"), ["a"]).collect()


def test_scores_of_a_table_of_models_make_no_row_of_a_record_and_a_split(spark):
    """The same rows as the join, with nulls, NaN, equal values, several splits and monomials, missing coefficients; and where splits are too many to be sent."""
    nan = float("nan")
    splits = [("m1", 0, 0.5, "a", 1.0), ("m1", 0, 0.5, "b", 2.0), ("m1", 1, -0.25, "a", 0.0), ("m2", 0, None, "b", 0.0), ("m2", 1, 1.5, "b", 3.0), ("m3", 0, 2.0, "a", None), ("m4", 7, 1.0, "a", nan), ("m5", 0, 1.0, "b", -5.0), ("m5", 0, 3.0, "b", -6.0)]
    table = spark.createDataFrame(splits, "model_id string, monomial_no int, trained_coef double, feature_name string, border double")
    rows = spark.createDataFrame([("q1", 1.0, 2.0), ("q2", 1.5, 2.5), ("q3", None, 4.0), ("q4", nan, nan), ("q5", -1.0, -9.0), ("q6", 0.5, None)], "query_id string, a float, b float")
    long = rows.selectExpr("struct(query_id) as key", "stack(2, 'a', double(a), 'b', double(b)) as (feature_name, value)")
    as_set = lambda df: {(r["query_id"], r["model_id"], r["score"]) for r in df.collect()}
    expected = as_set(model.model_table_scores(table, long, "key", 0.125).select("key.query_id", "model_id", "score"))
    got = model.table_scores(table, rows, ["a", "b"], 0.125)
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString() and len(expected) > 10
    assert as_set(got) == expected == as_set(model.table_scores(table, rows, ["a", "b"], 0.125, limit=0))
    assert model.table_scores(table.where("false"), rows, ["a", "b"]).count() == 0
