import gzip
import json

import pytest
from pyspark.sql import functions as F

from termforge.functions import text as T
from termforge.operators import dataset, legacy, retrieval, sampling
from termforge.operators.index import build_index, indexable
from termforge.plans.tables import newest_per_key, one_row_per_key
from termforge.sources import files
from termforge.streaming.ingest import append_features, corpus_stream

CLEANED = {"cat!?dog": "cat dog", "cat AND dog OR NOT TO and": "cat dog and", " cat  dog  ": " cat  dog", "cat\tdog": "cat dog"}


def _one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


def test_query_cleaning(spark):
    for raw, clean in CLEANED.items():
        assert _one(spark, T.without_operators(T.without_punctuation("q")), q=raw) == clean
    assert _one(spark, T.query_tokens("q"), q="cat AND OR") == ["cat"]
    assert _one(spark, T.query_tokens("q"), q="OR AND") == [] and _one(spark, T.query_tokens("q"), q=None) == []


def test_tokenizers(spark):
    assert _one(spark, T.whitespace_tokens("q"), q=" Cat,  dog x y \n") == ["Cat,", "dog", "x y"]
    assert [len(x) for x in _one(spark, T.whitespace_tokens("q"), q="a " + "b" * 600)] == [1, 255, 255, 90]
    assert _one(spark, T.leading_split("q"), q=" Cat dog ") == ["", "cat", "dog"]
    assert _one(spark, T.stemmed_words("q"), q="The cities, boxes and dogs running wanted it is") == ["city", "box", "dog", "runn", "want"]
    assert _one(spark, T.ascii_word_set("q"), q="don't dont Café!") == ["dont", "caf"]
    assert _one(spark, T.ascii_words_with_empty("q"), q="!?") == [""]
    assert _one(spark, T.ngrams(T.words("q"), 2), q="a b c") == ["a b", "b c"] and _one(spark, T.ngrams(T.words("q"), 3), q="a b") == []
    assert _one(spark, T.csv_field("q"), q='cats, "dogs"') == '"cats, ""dogs"""' and _one(spark, T.csv_field("q"), q="001") == "001"
    assert _one(spark, T.preview("q", 5), q="a  b\nc d e") == "a b c…" and _one(spark, T.shard_of("q"), q="x_07_1") == 7


def test_corpus_files_and_search(spark, tmp_path):
    with gzip.open(tmp_path / "part.gz", "wt") as f:
        f.write(json.dumps({"docid": "d1", "title": "Cat", "headings": "H", "body": "cat dog cat"}) + "\nno json\n" + json.dumps({"docid": "d2", "title": "Bird", "body": "bird"}) + "\n" + json.dumps({"docid": "d3", "title": "x", "body": ""}) + "\n")
    with gzip.open(tmp_path / "._part.gz", "wt") as f:
        f.write("{}")
    docs = indexable(files.read_corpus(spark, str(tmp_path / "*.gz")))
    assert {r["doc_id"] for r in docs.collect()} == {"d1", "d2"}
    queries = spark.createDataFrame([("a", "cat AND OR"), ("b", "OR AND"), ("c", "bird!"), ("d", "dog dog cat")], "query_id string, query string")
    hits = {(r["query_id"], r["doc_id"], r["rank"]) for r in retrieval.top_k(queries, build_index(docs), 3).collect()}
    assert hits == {("a", "d1", 1), ("c", "d2", 1), ("d", "d1", 1)}
    assert files.read_corpus(spark, str(tmp_path / "part.gz"), with_headings=True).where("doc_id = 'd1'").first()["body"] == "H\ncat dog cat"


def _lines(tmp_path, name, rows):
    path = tmp_path / name
    path.write_text("\n".join(rows) + "\n", encoding="utf-8")
    return str(path)


def test_candidate_lines(spark, tmp_path):
    wrapped = '"' + json.dumps({"title": "t", "body": 'say "x"'}).replace('"', '""') + '"'
    good = _lines(tmp_path, "a.tsv", ["cat q1\t0\td1\t1\t" + wrapped, "", "cat q2\t0\td2\t0.5\t{}"])
    rows = files.parse_candidates(files.read_lines(spark, [good]), ranked=False).orderBy("line_no").collect()
    assert [(r["label"], r["query"], r["doc_id"], r["title"], r["body"]) for r in rows] == [("1", "cat q1", "d1", "t", 'say "x"'), ("0.5", "cat q2", "d2", "", "")]
    ranked = _lines(tmp_path, "b.tsv", ['q\t0\td\t{"body":"b"}\t7', "q\t0\td\t{}\tx", "only\tthree\tfields"])
    lines = files.read_lines(spark, [ranked])
    assert [(r["label"], r["body"]) for r in files.parse_candidates(lines, ranked=True, strict=False).collect()] == [("0", "b")]
    with pytest.raises(Exception, match="bad candidate line"):
        files.parse_candidates(lines, ranked=True).collect()


def test_other_files(spark, tmp_path):
    vectors = [("a", [1.0, -0.5]), ("ü", [0.0, 2.25])]
    for count in (2, 0):
        data = bytearray(files.pack_vectors(vectors))
        data[:4] = count.to_bytes(4, "big")
        (tmp_path / f"v{count}.bin").write_bytes(bytes(data))
        assert {(r["doc_id"], *r["features"]) for r in files.read_vectors_binary(spark, str(tmp_path / f"v{count}.bin")).collect()} == {("a", 1.0, -0.5), ("ü", 0.0, 2.25)}
    df = spark.createDataFrame(vectors, "id string, features array<float>")
    files.write_vectors_text(df, str(tmp_path / "text"))
    assert sorted(files.read_vectors_text(spark, str(tmp_path / "text")).collect()) == sorted(df.collect())
    assert {r["word"] for r in files.read_dictionary(spark, _lines(tmp_path, "d.txt", [" Cat ", "cat", "", "Dog"])).collect()} == {"cat", "dog"}
    assert [r["query"] for r in files.read_query_log(spark, _lines(tmp_path, "q.tsv", ["1\tcat dog", "broken"])).collect()] == ["cat dog"]
    assert [tuple(r) for r in files.read_relevance(spark, _lines(tmp_path, "r.tsv", ["q\t0\td\t1", "x"])).collect()] == [("q", "d")]
    files.write_sharded(spark.createDataFrame([("m_03_1",), ("bad",)], "doc_id string"), str(tmp_path / "shards"))
    assert (tmp_path / "shards" / "shard=3").is_dir()
    files.write_by_query(spark.createDataFrame([(f"q{i % 7}", i) for i in range(40)], "query_id string, x int"), str(tmp_path / "by"), 4)
    assert sorted(r["x"] for r in files.read_by_query(spark, str(tmp_path / "by"), "query_id string, x int", "q3", 4).collect()) == [3, 10, 17, 24, 31, 38]
    assert files.read_by_query(spark, str(tmp_path / "by"), "query_id string, x int").count() == 40 and len(list((tmp_path / "by").glob("bucket=*"))) <= 4
    with pytest.raises(Exception, match="row without query_id"):
        files.write_by_query(spark.createDataFrame([(None, 1)], "query_id string, x int"), str(tmp_path / "by2"))


def _training(spark):
    rows = [(0, i, "1", f"cat q{i % 20}", f"d{i}", "t", "b") for i in range(41)]
    return spark.createDataFrame(rows, "part int, line_no long, label string, query string, doc_id string, title string, body string")


def test_dataset(spark, tmp_path):
    first = _training(spark)
    union = dataset.union_sources(first, dataset.numbered_rows(first, 27), dataset.numbered_rows(first, 0))
    assert union.count() == 68
    split = dataset.group_split(union).withColumn("f", F.lit(0.5))
    assert {r["split"]: r["n"] for r in split.groupBy("split").agg(F.countDistinct("query").alias("n")).collect()} == {"train": 19, "valid": 1}
    assert split.groupBy("query").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    out = dataset.write_dataset(split, [("f", "Family")], str(tmp_path / "set"))
    assert sum(out["rows"].values()) == 68 and (tmp_path / "set" / "feature_schema.csv").read_text() == "column_index,feature_name,family\n3,f,Family\n"
    text = "".join(p.read_bytes().decode() for p in sorted((tmp_path / "set" / "train").glob("*.txt")))
    assert text.endswith("\r\n") and "1,cat q" in text
    with pytest.raises(FileExistsError):
        dataset.write_dataset(split, [("f", "Family")], str(tmp_path / "set"))
    with pytest.raises(ValueError):
        dataset.feature_schema([("f", "x"), ("f", "y")])


def test_samples(spark):
    rows = spark.createDataFrame([("a", i) for i in range(10)] + [("b", i) for i in range(3)], "g string, i int")
    assert sorted((r["g"], r["i"]) for r in sampling.evenly_spaced(rows, ["g"], ["i"], 4).collect()) == [("a", 0), ("a", 2), ("a", 5), ("a", 7), ("b", 0), ("b", 1), ("b", 2)]
    assert sorted((r["g"], r["i"]) for r in sampling.head_fraction(rows, ["g"], ["i"], 0.25).collect()) == [("a", 0), ("a", 1), ("a", 2), ("b", 0)]
    assert sampling.first_per_group(rows, ["g"], ["i"], 2).count() == 4


def test_hard_negatives_and_ranks(spark):
    ranked = spark.createDataFrame([("q", f"d{i}", float(50 - i), i) for i in range(1, 31)] + [("r", "d1", 1.0, 1)], "query_id string, doc_id string, bm25 double, rank int")
    relevant = spark.createDataFrame([("q", "d15"), ("r", "d9")], "query_id string, doc_id string")
    drawn = retrieval.hard_negatives(ranked, relevant)
    places = [(r["query_id"], r["doc_id"], r["rank0"]) for r in drawn.collect()]
    assert places and all(q == "r" or 10 <= p < 30 for q, _, p in places) and ("q", "d15", 14) not in places
    assert sorted(places) == sorted((r["query_id"], r["doc_id"], r["rank0"]) for r in retrieval.hard_negatives(ranked, relevant).collect())
    assert {(r["doc_id"], r["rank"]) for r in retrieval.rank_of(relevant, ranked, 1201).collect()} == {("d15", 15), ("d9", 1201)}


def test_one_row_per_key(spark):
    rows = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("b", 1, "x"), (None, 1, "n"), ("b", 1, "x")], "k string, v int, t string")
    expected = {("a", 2, "new"), ("b", 1, "x")}
    for limit in (1 << 20, 0):
        assert {tuple(r) for r in one_row_per_key(rows, ["k"], ["v"], limit).collect()} == expected
    assert {tuple(r) for r in newest_per_key(rows, ["k"], ["v"]).collect()} == expected
    assert one_row_per_key(rows.limit(0), ["k"], ["v"]).count() == 0


def test_legacy_factors(spark):
    queries = spark.createDataFrame([("q", "cats and dogs"), ("e", "")], "query_id string, query string")
    docs = spark.createDataFrame([("d", "Dogs", "cat and dogs, cats and dog dogs"), ("n", None, None)], "doc_id string, title string, body string")
    pairs = queries.select("query_id").crossJoin(docs.select("doc_id"))
    got = {(r["query_id"], r["doc_id"]): r for r in legacy.legacy_pair_factors(pairs, queries, docs).collect()}
    r = got["q", "d"]
    assert (r["legacy_title_match_count"], r["legacy_exact_match_count"], r["legacy_query_tf_sum"], r["legacy_bigram_count"], r["legacy_stemmed_bigram_count"]) == (1, 3, 5, 2, 2)
    assert got["e", "d"]["legacy_title_match_ratio"] != got["e", "d"]["legacy_title_match_ratio"]  # NaN
    assert got["q", "n"]["legacy_exact_match_count"] == 0 and got["e", "n"]["legacy_query_tf_sum"] == 1
    assert docs.select(legacy.legacy_document_factors()["legacy_doc_special_character_count"].alias("x")).collect()[1]["x"] == 0


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    line = json.dumps({"docid": "d1", "title": "t", "body": "cat dog"}) + "\n"
    (tmp_path / "in" / "1.json").write_text(line)

    def run():
        append_features(corpus_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination(120)
        return sorted((r["doc_id"], r["doc_word_count"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == [("d1", 3.0)]
    (tmp_path / "in" / "2.json").write_text(line.replace("d1", "d2") + line.replace("d1", ""))
    assert run() == [("d1", 3.0), ("d2", 3.0)]
