import numpy as np

from termforge.llm.quality import Rule, classified, induced, learned_rules, measures, name_rules, odd_names, rules_sql, statistics

PROSE = "The bees of the valley were calm, and the keepers fed them in the morning. Nobody knew why the hives were so full this year. It takes two days for the combs to settle."
LIST = "- warm combs\n- cold queens\n- old hives\n- damp veils\n- rare drones\n- late honeys"


def test_induction_finds_the_thresholds():
    rng = np.random.default_rng(0)
    values = rng.random((400, 3))
    labels = np.where((values[:, 1] > 0.7) & (values[:, 0] <= 0.6), "junk", np.where(values[:, 2] > 0.9, "list", "prose"))
    rules = induced(values, labels, ["a", "b", "c"], "prose", np.arange(400) % 3)
    out, left = np.full(400, "prose", dtype=object), np.ones(400, bool)
    for r in rules:
        covered = r.holds(values, ["a", "b", "c"]) & left
        out[covered] = r.label
        left &= ~covered
    assert (out == labels).mean() > 0.97
    assert induced(values[:0], labels[:0], ["a", "b", "c"], "prose", np.arange(0)) == []
    assert induced(values, np.full(400, "prose"), ["a", "b", "c"], "prose", np.arange(400) % 3) == []
    assert induced(np.ones((30, 3)), np.array(["junk", "prose"] * 15), ["a", "b", "c"], "prose", np.arange(30) % 3) == []


def test_sql_equals_the_rules(spark):
    rules = [Rule("junk", (("lines", ">=", 3.5), ("words", "<=", 9.0))), Rule("list", (("chars", "<=", 20.0),))]
    assert rules_sql([], "prose") == "'prose'"
    df = spark.createDataFrame([(1, 4.0, 9.0, 50.0), (2, 4.0, 10.0, 20.0), (3, 1.0, 1.0, 21.0)], "record long, lines double, words double, chars double")
    assert {r["record"]: r["kind"] for r in classified(df, rules).collect()} == {1: "junk", 2: "list", 3: "prose"}


def test_statistics_learning_and_edges(spark):
    prose = [(f"p{i}", PROSE + f" Hive {i} was red." * (i % 4), "x") for i in range(30)]
    lists = [(f"l{i}", "\n".join(LIST.split("\n") * (1 + i % 3)), "x") for i in range(30)]
    other = [("n", None, "x"), ("e", "", "x"), ("b", " \n\t", "x"), ("f", "Home | News | FAQ\n© 2020 Bees", "x"), ("s", "!!! ??? ...", "x"), ("p1", prose[1][1], "x"), ("v", PROSE * 500, "x")]
    df = spark.createDataFrame([*prose, *lists, *other], "record string, t string, w string")
    stats = statistics(df, "record", "t").cache()
    assert {r["record"] for r in stats.collect()} == {*(f"p{i}" for i in range(30)), *(f"l{i}" for i in range(30)), "s", "v"}
    labels = spark.createDataFrame([(r, "prose" if r[0] == "p" else "list") for r, *_ in [*prose, *lists]] + [("p3", "prose"), ("p4", "list"), (None, "list"), ("l1", None), ("gone", "junk")], "docid string, body_kind string")
    rules = learned_rules(stats, labels, "docid", "body_kind")
    got = {r["record"]: r["kind"] for r in classified(stats, rules).collect()}
    assert all(got[r] == ("prose" if r[0] == "p" else "list") for r, *_ in [*prose, *lists]) and got["v"] == "prose"
    assert learned_rules(stats, labels.limit(0), "docid", "body_kind") == []
    assert statistics(df.limit(0), "record", "t").count() == 0


def test_measures(spark):
    df = spark.createDataFrame([("a", "The bee sat.\n\n- one (2)\n"), ("n", None), ("e", "")], "record string, body string")
    rows = {r["record"]: r for r in measures(df, "record", "body").collect()}
    assert rows["a"]["doc_word_count"] == 5 and rows["a"]["doc_terminal_line_ratio"] == 0.5 and rows["a"]["doc_common_word_ratio"] == 0.4
    assert abs(rows["a"]["doc_mean_word_length"] - 13 / 5) < 1e-9 and abs(rows["a"]["doc_symbol_ratio"] - 4 / 24) < 1e-9
    for k in "ne":
        assert [rows[k][c] for c in rows[k].asDict() if c != "record"] == [0, 0, 0, 0, 0]


def test_few_labels_are_pruned_too():
    # one labelled row that lies amid prose gives no rule; three that lie apart do, though no third of the rows holds all of them
    rng = np.random.default_rng(1)
    values = rng.random((60, 2))
    labels = np.where(np.arange(60) == 7, "junk", "prose")
    values[7] = 0.5
    values[8:40] = values[7]
    assert induced(values, labels, ["a", "b"], "prose", np.arange(60) % 3) == []
    values, labels = rng.random((60, 2)), np.where(np.arange(60) < 3, "junk", "prose")
    values[:3] = 5.0
    rules = induced(values, labels, ["a", "b"], "prose", np.arange(60) % 3)
    assert rules and all(r.holds(values, ["a", "b"])[:3].any() for r in rules)


def test_many_rules_and_conditions():
    # more kinds of junk than any limit of rules: every one gets its rule
    values = np.repeat(np.arange(140.0), 9)[:, None]
    labels = np.where(np.arange(140) % 2 == 0, "prose", "junk").repeat(9)
    rules = induced(values, labels, ["a"], "prose", np.arange(1260) % 3)
    covered = np.zeros(1260, bool)
    for r in rules:
        covered |= r.holds(values, ["a"])
    assert len(rules) > 60 and (covered == (labels == "junk")).all()


def test_odd_names(spark):
    good = ["doc_word_count", "QueryMinLogFrequency", "BM25Top3Score", "TFIDFScore", "UnorderedWindow8", "doc_body_non_dictionary_count", "QueryVowelCount", "doc_size_kbyte"]
    schemas = [(f"s{i}", v) for i in range(30) for v in good] + [("s1", "-----"), ("s2", "-----")]
    rules = name_rules(spark.createDataFrame(schemas, "schema string, name string"), "schema", "name")
    assert rules and {r.label for r in rules} == {"junk"}
    names = ["doc_word_count", " QueryMinLogFrequency", "BM25TOP3SCORE\t", "tfidfscore", "UnorderedWindow8", "snippet_entropy_max", "url_depth-log", None]
    odd = ["-----", "n/a | n/a", "0x1e68e2f8", "gphcsmdvbxrjxz", "{'a': 60}", "2745;7;2;51", "%col13%_??", "_==>==<>_@==!", "", "  "]
    df = spark.createDataFrame([(i, v) for i, v in enumerate([*names, *odd])], "id long, name string")
    assert {r["id"] for r in odd_names(df, ["id"], "name", rules).collect()} == set(range(len(names), len(names) + len(odd)))
    assert odd_names(df.limit(0), ["id"], "name", rules).count() == 0
    assert name_rules(df.limit(0), "id", "name") == [] and {r["id"] for r in odd_names(df, ["id"], "name", []).collect()} == {16, 17}
