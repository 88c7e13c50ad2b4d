import json

import pytest

from termforge.operators import model
from termforge.runner import Search, needed_inputs, run

MODEL = {"format": model.FORMAT, "intercept": 0.0, "feature_names": ["doc_word_count", "QueryWordCount"], "monomials": [{"trained_coef": 2.0, "splits": [{"feature_idx": 0, "feature_name": "doc_word_count", "comparison": "GT", "border": 1.0}, {"feature_idx": 1, "feature_name": "QueryWordCount", "comparison": "GT", "border": 0.0}]}]}


@pytest.fixture
def inputs(tmp_path):
    (tmp_path / "docs.json").write_text("\n".join(json.dumps({"docid": d, "title": t, "body": b}) for d, t, b in [("d1", "Example title", "cat dog cat"), ("d2", "", "cat")]) + "\n")
    (tmp_path / "model.json").write_text(json.dumps(MODEL))
    return ["--corpus", str(tmp_path / "docs.json"), "--model", str(tmp_path / "model.json"), "--query", "cat", "--threshold", "1"], tmp_path


def test_ranked_and_first(spark, inputs):
    arguments, folder = inputs
    out = run([*arguments, "--top-k", "5", "--hot", "--repeat", "2", "--output", str(folder / "out.json")], spark)
    assert out["mode"] == "hot" and len(out["runs"]) == 2 and json.loads((folder / "out.json").read_text())["retrieval_mode"] == "ranked"
    hit = out["runs"][0]["result"]["candidates"]
    assert [(h["doc_id"], h["score"], h["title"], h["body"]) for h in hit] == [("d1", 2.0, "Example title", "cat dog cat")]
    first = run([*arguments, "--limit", "1"], spark)["runs"][0]["result"]
    assert first["limit_reached"] and [h["doc_id"] for h in first["candidates"]] == ["d1"]


def test_strict_options(spark, inputs):
    arguments, _ = inputs
    for bad in (["--limit", "1", "--top-k", "1"], ["--unknown", "1"], ["--repeat", "0"]):
        with pytest.raises(SystemExit):
            run([*arguments, *bad], spark)
    with pytest.raises(SystemExit):
        run(arguments[4:], spark)


def test_needed_inputs(spark):
    m = model.parse_model(MODEL | {"feature_names": ["QueryMinLogFrequency", "doc_non_dictionary_ratio"], "monomials": [{"trained_coef": 1.0, "splits": [{"feature_idx": i, "feature_name": n, "comparison": "GT", "border": 0.0} for i, n in enumerate(["QueryMinLogFrequency", "doc_non_dictionary_ratio"])]}]})
    assert needed_inputs(m) == {"dictionary", "frequencies"}
    with pytest.raises(ValueError, match="dictionary, frequencies"):
        Search(spark.createDataFrame([("d", "t", "b")], "doc_id string, title string, body string"), m)


def test_settings_in_order(spark, tmp_path, monkeypatch):
    from termforge.runner import setting

    (tmp_path / "c").write_text("# note\ncorpus = from file\n")
    assert setting("corpus", None, "default") == "default"
    monkeypatch.setenv("TERMFORGE_CONFIG", str(tmp_path / "c"))
    assert setting("corpus", None) == "from file"
    monkeypatch.setenv("TERMFORGE_CORPUS", "from environment")
    assert setting("corpus", None) == "from environment"
    spark.conf.set("spark.termforge.corpus", "from session")
    assert setting("corpus", None, spark=spark) == "from session" and setting("corpus", "option", spark=spark) == "option"
    spark.conf.unset("spark.termforge.corpus")


def test_explained_hits_from_a_stored_index_and_searches_at_once(spark, inputs):
    from concurrent.futures import ThreadPoolExecutor

    from termforge.operators.index import build_index, open_index
    from termforge.sources.files import read_corpus

    arguments, folder = inputs
    build_index(read_corpus(spark, str(folder / "docs.json"))).write(str(folder / "index"))
    hit = run(["--index", str(folder / "index"), *arguments[2:], "--top-k", "5", "--explain"], spark)["runs"][0]
    assert hit["result"]["candidates"][0]["active"] == [{"monomial": 0, "coefficient": 2.0, "active": True}] and hit["timings_ms"]["explain"] > 0
    search = Search(None, model.parse_model(MODEL), index=open_index(spark, str(folder / "index")))
    with ThreadPoolExecutor(4) as pool:
        found = list(pool.map(lambda q: [r["doc_id"] for r in search.ranked(q, 1.0, 5).collect()], ["cat", "dog", "bird", ""]))
    assert found == [["d1"], ["d1"], ["d1"], []]


def test_trees(spark):
    from termforge.operators.trees import parse_trees, scored_by_trees

    data = {"oblivious_trees": [{"splits": [{"float_feature_index": 0, "border": 0.5}, {"float_feature_index": 1, "border": 0.5}], "leaf_values": [1, 2, 3, 4]}], "scale_and_bias": [2.0, [1.0]]}
    rows = spark.createDataFrame([(0.0, 0.0), (1.0, 0.0), (0.0, 1.0), (1.0, 1.0)], "a double, b double")
    assert [r["raw"] for r in scored_by_trees(rows, parse_trees(data), ["a", "b"]).collect()] == [3.0, 5.0, 7.0, 9.0]
    with pytest.raises(KeyError):
        scored_by_trees(rows, parse_trees(data), ["a"])
    data["oblivious_trees"][0]["leaf_values"].pop()
    with pytest.raises(ValueError, match="3 leaves"):
        parse_trees(data)
