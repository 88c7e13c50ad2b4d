import json

import pytest
from pyspark.sql import functions as F

from termforge.functions import text as T
from termforge.operators import index, legacy, sampling
from termforge.operators.families import DocumentFactor, Family, QueryFamily, TitleShare, WordLengths, disagreements, with_families
from termforge.operators.pair_features import checked_pairs
from termforge.operators.query_features import noun_count
from termforge.plans import tables
from termforge.sources import files


class Wrong(TitleShare):
    """Its condition is not the comparison of its value."""

    def condition(self, feature, comparison, border):
        return F.lit(True)


def test_families(spark):
    docs = spark.createDataFrame([("a", "Bees", "old bees sleep"), ("b", None, None)], "doc_id string, title string, body string")
    rows = {r["doc_id"]: r for r in with_families(docs, [WordLengths(), TitleShare()]).collect()}
    assert rows["a"]["doc_longest_word"] == 5 and rows["b"]["doc_mean_word_length"] == 0 and rows["b"]["doc_title_share"] == 0
    with pytest.raises(ValueError, match="in two families"):
        with_families(docs, [TitleShare(), TitleShare()])
    assert {r["differing"] for r in disagreements(docs, [WordLengths(), TitleShare()], [0.0, 4.0]).collect()} == {0}
    assert sum(r["differing"] for r in disagreements(docs, [Wrong()], [4.0]).collect()) > 0
    with pytest.raises(KeyError):
        TitleShare().condition("gone", "GT", 0.0)

    class Short(QueryFamily):
        name, features = "Short", ("a", "b")

        def calculate(self, query):
            return (F.length(query),)

    with pytest.raises(ValueError):
        Short().values()  # two features, one value
    assert issubclass(Short, Family)

    class Words(DocumentFactor):
        name = "words"

        def value(self):
            return F.when(F.col("body").isNotNull(), T.word_count("body"))

    assert [r["words"] for r in docs.orderBy("doc_id").select(Words().column()).collect()] == [3.0, 0.0]


def test_places_in_hot_groups(spark):
    rows = spark.range(900).select(F.when(F.col("id") < 600, "hot").when(F.col("id") < 899, F.concat(F.lit("g"), F.col("id") % 9)).alias("g"), ((F.col("id") * 7919) % 1000).alias("v"))
    found = sampling.placed(rows, ["g"], ["v"]).collect()
    groups = {}
    for r in sorted(found, key=lambda r: (str(r["g"]), r["v"])):
        groups.setdefault(r["g"], []).append((r["_at"], r["_n"]))
    assert len(found) == 900 and set(groups) == {"hot", None, *(f"g{i}" for i in range(9))}
    for places in groups.values():
        assert [p for p, _ in places] == list(range(1, len(places) + 1)) and {n for _, n in places} == {len(places)}


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "v")
    vectors = spark.createDataFrame([(f"d{i}", [float(i), 0.5]) for i in range(50)], "id string, features array<float>")
    files.write_vectors_binary(vectors, path, files=4)
    read = files.read_packed_vectors(spark, path)
    assert sorted((r["doc_id"], *r["features"]) for r in read.collect()) == sorted((f"d{i}", float(i), 0.5) for i in range(50))
    count, width, first = files.inspected(read)
    assert (count, width, [r["doc_id"] for r in first]) == (50, 2, ["d0", "d1", "d10", "d11", "d12"])
    with pytest.raises(Exception, match="features, not"):
        files.write_vectors_binary(spark.createDataFrame([("a", [1.0]), ("a", [1.0, 2.0])], "id string, features array<float>").coalesce(1), str(tmp_path / "w"), files=1)
    rows = spark.createDataFrame([("1", "q", "d", [1.0]), ("0", "q", "e", [2.0])], "label string, query string, doc_id string, features array<float>")
    more = spark.createDataFrame([("d", [3.0])], "doc_id string, features array<float>")
    assert [list(r["features"]) for r in files.append_columns(rows.where("doc_id = 'd'"), more, "doc_id").collect()] == [[1.0, 3.0]]
    with pytest.raises(Exception, match="nothing to append for e"):
        files.append_columns(rows, more, "doc_id").collect()
    files.write_stream_rows(rows, str(tmp_path / "s"))
    assert sorted((r["label"], r["doc_id"], *r["features"]) for r in files.read_stream_rows(spark, str(tmp_path / "s")).collect()) == [("0", "e", 2.0), ("1", "d", 1.0)]


def test_lines_of_several_files(spark, tmp_path):
    names = []
    for i, n in enumerate((3, 0, 5)):
        (tmp_path / f"f{i}.txt").write_text("".join(f"{i}-{k}\n" for k in range(n)))
        names.append(str(tmp_path / f"f{i}.txt"))
    got = sorted((r["part"], r["line_no"], r["value"]) for r in files.read_lines(spark, names).collect())
    assert got == [(i, k, f"{i}-{k}") for i, n in ((0, 3), (2, 5)) for k in range(n)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8")  # a file in several splits
    try:
        assert sorted((r["part"], r["line_no"], r["value"]) for r in files.read_lines(spark, names).collect()) == got
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert files.shard_paths(spark, str(tmp_path / "*.txt"), multiplier=1, per_set=2)[-1].endswith("f1.txt") and files.shard_paths(spark, str(tmp_path / "gone*")) == []


def test_missing_documents_and_deleted_ones(spark):
    docs = spark.createDataFrame([("a",), ("b",)], "doc_id string")
    pairs = spark.createDataFrame([("q", "a"), ("q", "c")], "query_id string, doc_id string")
    assert checked_pairs(pairs.where("doc_id = 'a'"), docs).count() == 1
    with pytest.raises(Exception, match="unknown document c"):
        checked_pairs(pairs, docs).collect()
    assert [r["doc_id"] for r in index.live(docs, docs.where("doc_id = 'a'")).collect()] == ["b"]


def test_nouns_and_older_query_factors(spark):
    queries = spark.createDataFrame([("a", "The bowls run quickly 2 x"), ("b", " \t"), ("c", None)], "query_id string, query string")
    count = lambda lexicon: [r["n"] for r in queries.orderBy("query_id").select(noun_count("query", lexicon).alias("n")).collect()]
    assert count(None) == [3, 0, 0] and count({"run": "VB", "quickly": "NNP"}) == [3, 0, 0] and count({"bowls": "VB"}) == [2, 0, 0]
    rows = {r["query_id"]: r.asDict() for r in legacy.legacy_query_factors(queries, None, None).collect()}
    assert rows["a"]["legacy_QueryWordCount"] == 6 and rows["a"]["legacy_QueryNonDictionaryCount"] == 0 and rows["a"]["legacy_QueryMinLogFrequency"] == 0
    assert all(v == 0 for q in "bc" for k, v in rows[q].items() if k != "query_id")


def test_text_functions(spark):
    one = lambda c: spark.createDataFrame([(json.dumps({"n": 1, "docno": 'q "1"'}), "The cat's 1,000 cats, and a dog.")], "line string, text string").select(c.alias("x")).first()["x"]
    assert one(T.json_field("line", "docno")) == 'q \\"1\\"' and one(T.json_field("line", "gone")) is None
    assert one(T.standard_tokens("text")) == ["cat's", "1,000", "cats", "dog"]


def test_shared_folder(spark):
    folder = tables.shared_folder(spark)
    assert spark.sparkContext.applicationId in folder and tables.shared_folder(spark) == folder
    made = tables.cut(spark.range(3), "three")
    fs, path = tables.file_system(spark, folder)
    assert made.count() == 3 and fs.exists(path)


def test_a_stored_index_is_built_once_and_again_after_release(spark):
    built = []

    def docs():
        built.append(1)
        return spark.createDataFrame([("d1", "t", "cat dog cat"), ("d2", "", "dog")], "doc_id string, title string, body string")

    for _ in range(2):
        terms = {r["term"]: (r["df"], r["ttf"]) for r in index.stored_index(spark, "test-collection", docs).terms.collect()}
        assert terms == {"cat": (1, 2), "dog": (2, 2)}
    assert len(built) == 1
    tables.release(spark)
    assert index.stored_index(spark, "test-collection", docs).stats.first()["num_docs"] == 2 and len(built) == 2


def test_a_cluster_needs_a_shared_folder():
    class Session:
        class conf:
            @staticmethod
            def get(name, default=None):
                return default

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        tables.shared_folder(Session)
