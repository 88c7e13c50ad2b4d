"""Queries that write what the engine writes and read it back, and those of single conditions, lookups and extensions."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termforge import catalogue as C
from termforge.functions import text as T
from termforge.operators import dataset, index, model, retrieval, sampling, trees
from termforge.operators.document_features import text_features
from termforge.operators.families import TitleShare, WordLengths, disagreements, with_families
from termforge.operators.pair_features import checked_pairs
from termforge.operators.query_features import noun_count, query_frequencies
from termforge.operators.registry import described, joined_vector, vector
from termforge.plans import predicates
from termforge.plans.search import planned, search_rows
from termforge.plans.tables import new_path, newest_per_key, read_table, read_text_file, write_text_file
from termforge.sources import files
from termforge.streaming.ingest import append_features, corpus_stream

# Files


def corpus_shards_read(spark: SparkSession, folder: str) -> DataFrame:
    """The corpus as JSON lines in a folder per shard, read again by the sorted list of its files."""
    path = new_path(spark, "shards")
    docs = newest_per_key(read_table(spark, folder, "docs", "docid", "title", "headings", "body", "url", "loaded_at"), ["docid"], ["loaded_at"]).drop("loaded_at")
    files.write_sharded(docs, path, "docid")
    rows = files.read_corpus(spark, files.shard_paths(spark, f"{path}/shard=*/*.json"))
    return rows.select("doc_id", "title", F.md5("body").alias("body_md5"))


def headings_read(spark, folder):
    """The same with the headings before the body, from compressed files."""
    path = new_path(spark, "gz")
    docs = newest_per_key(read_table(spark, folder, "docs", "docid", "title", "headings", "body", "url", "loaded_at"), ["docid"], ["loaded_at"]).drop("loaded_at")
    docs.write.option("compression", "gzip").json(path)
    rows = files.read_corpus(spark, files.shard_paths(spark, f"{path}/*.gz", multiplier=1000), with_headings=True)
    return rows.select("doc_id", F.md5("body").alias("body_md5"))


def index_written(spark, folder):
    """An index written and opened: tokens and distinct terms of each document from its postings."""
    path = new_path(spark, "written-index")
    C.index(spark, folder).write(path)
    opened = index.open_index(spark, path)
    return opened.postings.groupBy("doc_id").agg(F.sum("tf").alias("tokens"), F.count(F.lit(1)).alias("terms"))


def index_lookup(spark, folder):
    """A document by its id and one by its ordinal, which must be there."""
    docs = index.with_ordinals(C.index(spark, folder).docs.select("doc_id", "title"))
    first = docs.agg(F.max("doc_id").alias("m")).first()["m"]
    rows = index.by_id(docs, first).withColumn("by", F.lit("id")).unionByName(index.by_ordinal(docs, 10).withColumn("by", F.lit("ordinal")))
    return index.require(rows, "no such document").select("by", "doc_id", "title")


def queries_read(spark, folder):
    path = new_path(spark, "queries")
    rows = newest_per_key(read_table(spark, folder, "queries", "docno", "text_raw", "relevant_id_doc"), ["docno"], ["text_raw"])
    rows.select(F.col("docno").alias("DOCNO"), "text_raw", F.col("relevant_id_doc").alias("relevantIdDoc")).write.json(path)
    return files.read_queries(spark, path).select("query_id", "query", F.greatest(F.coalesce(F.size("relevant"), F.lit(0)), F.lit(0)).alias("relevant"))


def _candidate_lines(spark, folder, ranked):
    """Training lines of the relevant pairs, every other one with its JSON wrapped as a CSV field, and lines that are none."""
    pairs = retrieval.hydrated(C.relevant_pairs(C.query_set(spark, folder)), C.corpus(spark, folder))
    plain = F.to_json(F.struct("title", "body"))
    wrapped = F.concat(F.lit('"'), F.replace(plain, F.lit('"'), F.lit('""')), F.lit('"'))
    field = F.when(F.pmod(F.xxhash64("query_id", "doc_id"), F.lit(2)) == 0, plain).otherwise(wrapped)
    tail = [field, F.lit("7")] if ranked else [F.lit("1"), field]
    lines = pairs.select(F.concat_ws("\t", "query_id", F.lit("0"), "doc_id", *tail).alias("value"))
    bad = spark.createDataFrame([("",), ("three\tfields\tonly",), ("q\t0\t\t1\t{}",)], "value string")
    path = new_path(spark, "lines")
    lines.unionByName(bad).write.text(path)
    found = files.parse_candidates(files.read_lines(spark, files.shard_paths(spark, f"{path}/part-*")), ranked, strict=False)
    return found.select("label", F.col("query").alias("query_id"), "doc_id", "title", F.md5("body").alias("body_md5"))


def candidate_lines_read(spark, folder):
    return _candidate_lines(spark, folder, False)


def ranked_lines_read(spark, folder):
    return _candidate_lines(spark, folder, True)


def lines_numbered(spark, folder):
    """Lines of a text file by their numbers: each query stands at the place it was written to."""
    path = new_path(spark, "numbered")
    rows = C.query_set(spark, folder).select("query_id").orderBy("query_id").coalesce(1)
    rows.write.text(path)
    return files.read_lines(spark, files.shard_paths(spark, f"{path}/part-*")).select("line_no", F.col("value").alias("query_id"))


def relevance_read(spark, folder):
    path = new_path(spark, "relevance")
    C.relevant_pairs(C.query_set(spark, folder)).select(F.concat_ws("\t", "query_id", F.lit("0"), "doc_id", F.lit("1")).alias("value")).write.text(path)
    return files.read_relevance(spark, path).select(F.col("query").alias("query_id"), "doc_id")


def model_read(spark, folder):
    """A model written as JSON, read and checked: its splits."""
    path = new_path(spark, "model") + ".json"
    write_text_file(spark, path, json.dumps(C.MODEL_JSON))
    read = model.parse_model(read_text_file(spark, path))
    rows = [(i, j, m.coefficient, s.feature, s.border) for i, m in enumerate(read.monomials) for j, s in enumerate(m.splits)]
    return spark.createDataFrame(rows, "monomial int, split int, coefficient double, feature string, border double")


def dictionary_read(spark, folder):
    path = new_path(spark, "dictionary")
    C.query_set(spark, folder).select(F.explode(T.words("query")).alias("w")).select(F.concat(F.lit(" "), F.upper("w")).alias("value")).write.text(path)
    return files.read_dictionary(spark, path)


def query_log_read(spark, folder):
    path = new_path(spark, "log")
    C.query_set(spark, folder).select(F.concat_ws("\t", "query_id", F.regexp_replace("query", r"[\t\r\n]", " ")).alias("value")).write.text(path)
    return query_frequencies(files.read_query_log(spark, path))


def _document_vectors(spark, folder):
    return C.corpus(spark, folder).select(F.col("doc_id").alias("id"), F.array(*[c.cast("float") for c in text_features().values()]).alias("features"))


def _named(vectors, key, digits=3):
    return vectors.select(F.col(key).alias("doc_id"), *[F.round(F.get("features", i).cast("double"), digits).alias(n) for i, n in enumerate(text_features())])


def vectors_text_read(spark, folder):
    path = new_path(spark, "vectors-text")
    files.write_vectors_text(_document_vectors(spark, folder), path)
    return _named(files.read_vectors_text(spark, path), "id")


def vectors_binary_read(spark, folder):
    path = new_path(spark, "vectors-binary")
    files.write_vectors_binary(_document_vectors(spark, folder), path, T.shard_of("id"))
    return _named(files.read_packed_vectors(spark, path), "doc_id")


def vectors_inspected(spark, folder):
    """Rows and width of written pair vectors, and their first ids."""
    path = new_path(spark, "pair-vectors")
    rows = C._pair_features(spark, folder).withColumn("v", joined_vector(vector(["BM25Score"]), vector(["TFIDFScore", "BigramCount"])))
    files.write_vectors_binary(rows.select(F.concat_ws("|", "query_id", "doc_id").alias("id"), F.col("v").alias("features")), path)
    count, width, first = files.inspected(files.read_packed_vectors(spark, path))
    return spark.createDataFrame([(count, width, r["doc_id"]) for r in first], "rows long, width int, id string")


def candidates_json_read(spark, folder):
    """Candidates with the words of their documents, written as JSON lines and read again."""
    path = new_path(spark, "candidates")
    best = sampling.best_query(read_table(spark, folder, "candidates", "query_id", "doc_no", "bm25").where("bm25 is not null and not isnan(bm25)").withColumnRenamed("doc_no", "doc_id"))
    enriched = best.join(C.corpus(spark, folder).select("doc_id", T.word_count("body").alias("words")), "doc_id")
    files.write_candidates(enriched.select("query_id", F.col("doc_id").alias("doc_no"), "bm25", F.col("words").alias("rank")), path)
    return files.read_candidates(spark, path).select("query_id", "doc_no", F.round(F.col("bm25").cast("double"), 4).alias("bm25"), F.col("rank").alias("words"))


def sharded_read(spark, folder):
    """Documents written by shard: rows of each shard, rows without a shard number under null."""
    path = new_path(spark, "sharded")
    files.write_sharded(C.corpus(spark, folder).select("doc_id"), path)
    return spark.read.schema("doc_id string, shard int").json(path).groupBy("shard").agg(F.count(F.lit(1)).alias("rows"))


def by_query_read(spark, folder):
    """Pairs written by query and read again, and those of one query from its bucket alone."""
    path = new_path(spark, "by-query")
    files.write_by_query(C.candidate_pairs(spark, folder), path)
    kinds = "query_id string, doc_id string"
    one = C.query_set(spark, folder).agg(F.min("query_id").alias("q")).first()["q"]
    every = files.read_by_query(spark, path, kinds).groupBy("query_id").agg(F.count(F.lit(1)).alias("rows")).withColumn("read", F.lit("all"))
    return every.unionByName(files.read_by_query(spark, path, kinds, one).groupBy("query_id").agg(F.count(F.lit(1)).alias("rows")).withColumn("read", F.lit("one")))


def dataset_read(spark, folder):
    """A training set published as CSV folders, read again."""
    path = new_path(spark, "dataset")
    rows = dataset.group_split(C._training_rows(spark, folder)).withColumn("query_words", T.word_count("query").cast("float"))
    dataset.write_dataset(rows, [("query_words", "QueryWords")], path)
    read = [spark.read.schema("label string, query string, doc_id string, query_words double").option("lineSep", "\r\n").option("escape", '"').csv(f"{path}/{s}").withColumn("split", F.lit(s)) for s in ("train", "valid")]
    return read[0].unionByName(read[1]).groupBy("split", "label").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("query").alias("queries"), F.sum("query_words").alias("words"))


def dataset_files(spark, folder):
    """The schema and manifest of a published training set."""
    path = new_path(spark, "dataset")
    rows = dataset.group_split(C._training_rows(spark, folder)).withColumn("query_words", T.word_count("query").cast("float"))
    dataset.write_dataset(rows, [("query_words", "QueryWords")], path)
    made = json.loads(read_text_file(spark, f"{path}/manifest.json"))
    schema = spark.read.option("header", True).csv(f"{path}/feature_schema.csv").select(F.concat_ws(",", "column_index", "feature_name", "family").alias("name"), F.lit(1).cast("bigint").alias("rows"))
    return schema.unionByName(spark.createDataFrame(list(made["rows"].items()), "name string, rows long"))


def stream_rows_read(spark, folder):
    """Training rows of the relevant pairs as tab-separated lines, with further features appended to them, read again."""
    path = new_path(spark, "stream")
    pairs = C.relevant_pairs(C.query_set(spark, folder)).join(C.corpus(spark, folder).select("doc_id", T.word_count("body").cast("float").alias("words")), "doc_id")
    rows = pairs.select(F.lit("1").alias("label"), F.col("query_id").alias("query"), "doc_id", F.lit(3).alias("rank"), F.array("words").alias("features"))
    more = C.corpus(spark, folder).select("doc_id", F.array(T.vowel_count("body").cast("float")).alias("features"))
    files.write_stream_rows(files.append_columns(rows, more, "doc_id"), path, ranked=True)
    return files.read_stream_rows(spark, path, ranked=True).select("label", "query", "doc_id", "rank", *[F.get("features", i).cast("double").alias(n) for i, n in enumerate(("words", "vowels"))])


def text_body_read(spark, folder):
    """A plain text file as a document."""
    path = new_path(spark, "plain") + ".txt"
    write_text_file(spark, path, "Old bees\nand new bees\n")
    return files.read_text_body(spark, path).select("title", "body", T.word_count("body").alias("words"))


def streamed_features(spark, folder):
    """The corpus as JSON lines taken in as a stream: its document features."""
    source, table, checkpoint = (new_path(spark, n) for n in ("stream-in", "stream-out", "stream-state"))
    C.corpus(spark, folder).withColumnRenamed("doc_id", "docid").write.json(source)
    append_features(corpus_stream(spark, source), table, checkpoint).awaitTermination()
    rows = spark.read.parquet(table)
    return rows.select("doc_id", *[F.col(c).cast("double").alias(c) for c in rows.columns[1:]])


TREES_JSON = {
    "oblivious_trees": [
        {"splits": [{"float_feature_index": 0, "border": 120.5}, {"float_feature_index": 2, "border": 40.5}], "leaf_values": [-0.5, 0.25, 0.125, 1.5]},
        {"splits": [{"float_feature_index": 6, "border": 1.0}], "leaf_values": [0.75, -0.25]},
        {"splits": [], "leaf_values": [0.0625]},
    ],
    "scale_and_bias": [0.5, [0.25]],
}


def tree_scores(spark, folder):
    """An ensemble of trees written as JSON, read, and scored over the document features."""
    path = new_path(spark, "trees") + ".json"
    write_text_file(spark, path, json.dumps(TREES_JSON))
    rows = C.corpus(spark, folder).select("doc_id", *[c.cast("float").alias(n) for n, c in text_features().items()])
    found = trees.scored_by_trees(rows, trees.parse_trees(read_text_file(spark, path)), list(text_features()))
    return found.select("doc_id", "raw", F.round("probability", 9).alias("probability"))


def nouns_by_lexicon(spark, folder):
    """Nouns of the queries with a lexicon read from lines of word and tag."""
    path = new_path(spark, "lexicon") + ".txt"
    write_text_file(spark, path, "bowls\tNNS\ncold\tJJ\nrun\tVB\nbeing\tNN\nkilns\tVBZ\n")
    return C.query_set(spark, folder).select("query_id", noun_count("query", files.read_lexicon(spark, path)).alias("nouns"))


# Conditions, lookups, samples


def predicate_counts(spark, folder):
    """For the one query, how many documents meet conditions that need no score: a term, terms of the title, an n-gram, a window."""
    built = C.index(spark, folder)
    query = planned(built, C.SEARCH)
    terms = [t for _, t, _, _ in query.terms]
    rows = search_rows(built, query, ("BigramCount", "TrigramCount", "UnorderedWindow4", "UnorderedWindow8"), every=False)
    found = rows.agg(F.count_if(predicates.any_ngram(F.col("BigramCount"), F.col("TrigramCount"))).alias("any_ngram"), F.count_if(predicates.any_window(F.col("UnorderedWindow4"))).alias("any_window4"), F.count_if(predicates.any_window(F.col("UnorderedWindow8"))).alias("any_window8"))
    titles = built.docs.select(F.array(*[F.lit(t) for t in query.tokens]).alias("q"), T.whitespace_tokens(F.lower("title")).alias("t"))
    named = titles.agg(F.count_if(predicates.matches_terms("q", "t", ratio=0.3)).alias("title_ratio"), F.count_if(predicates.matches_terms("q", "t", count=0)).alias("title_count"))
    with_term = predicates.with_any_term(built.docs, built.postings, terms).agg(F.count(F.lit(1)).alias("any_term"))
    return with_term.crossJoin(named).crossJoin(found)  # one row each


def single_term_documents(spark, folder):
    """The documents that hold one term, from its postings."""
    built = C.index(spark, folder)
    return built.postings.where(F.col("term") == C.SEARCH.split()[0]).select("doc_id", "tf")


def hit_counts(spark, folder):
    """Hits of the one search, exact and up to a limit."""
    rows, conditions = C._search_rows(spark, folder, -0.25)
    hits = model.scored(rows, C.MODEL, -0.25, conditions)
    return spark.createDataFrame([("exact", *model.hit_count(hits)), ("limited", *model.hit_count(hits, 5))], "how string, hits long, relation string")


def candidate_entries(spark, folder):
    """The one search as a candidate provider."""
    rows, conditions = C._search_rows(spark, folder, -0.25)
    found = model.provider(lambda _: model.scored(rows, C.MODEL, -0.25, conditions), 25)(C.SEARCH)
    return spark.createDataFrame([(i, d, float(s), found.found) for i, (d, s) in enumerate(found.entries)], "place int, doc_id string, score double, found long")


def compared_model_ranks(spark, folder):
    """Ranks of the relevant documents by the model and by BM25 among each query's candidates."""
    built = C.index(spark, folder)
    plain = built.docs.select("doc_id", *[c.cast("float").alias(n) for n, c in text_features().items() if n in C.MODEL.features])
    lengths = C.query_set(spark, folder).select("query_id", T.word_count("query").cast("float").alias("QueryWordCount"))
    scored = model.scored(C._pair_features(spark, folder, C.LEXICAL).join(plain, "doc_id").join(lengths, "query_id"), C.MODEL, -1000.0).select("query_id", "doc_id", "score", F.round(F.col("BM25Score").cast("double"), 4).alias("bm25"))
    first, second = (retrieval._ranked(scored, by) for by in ("score", "bm25"))
    found = retrieval.compared_ranks(C.relevant_pairs(C.query_set(spark, folder)), first, second)
    return found.select("query_id", "doc_id", *[F.col(c).cast("bigint").alias(c) for c in ("first_rank", "second_rank", "difference")])


def pairs_above_both(spark, folder):
    rows = sampling.above_both(C._runs(spark, folder).where("not isnan(tfidf)"), "bm25", "tfidf")
    return rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("rows"))


def live_documents(spark, folder):
    """The index without the documents of one site, as if they were deleted."""
    deleted = read_table(spark, folder, "docs", "docid", "site").where("site = 'mibralehub.test'").select(F.col("docid").alias("doc_id"))
    built = C.index(spark, folder)
    return index.live(built.postings, deleted).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def mandatory_pairs(spark, folder):
    """Relevant pairs whose documents all must be known, with titles."""
    docs = C.corpus(spark, folder)
    known = C.relevant_pairs(C.query_set(spark, folder)).join(docs.select("doc_id"), "doc_id", "left_semi")
    return checked_pairs(known, docs).join(docs.select("doc_id", "title"), "doc_id").select("query_id", "doc_id", "title")


def sorted_pairs(spark, folder):
    """Pairs in batches that are sorted by score."""
    found = C._pair_features(spark, folder, ("BM25Score",))
    return sampling.sorted_batches(found, "BM25Score", "doc_id").select("query_id", "doc_id", F.round(F.col("BM25Score").cast("double"), 4).alias("BM25Score"))


def split_by_rows(spark, folder):
    return dataset.row_split(C._training_rows(spark, folder), ["query", "doc_id", "label"]).select("source", "label", "query", "doc_id", "split")


def limited_rows(spark, folder):
    """The first 500 rows of a source by part and line."""
    docs = index.with_ordinals(C.corpus(spark, folder).select("doc_id"))
    rows = docs.select(F.lit(0).alias("part"), F.col("doc_ord").alias("line_no"), "doc_id")
    return dataset.numbered_rows(rows, 500).select("line_no", "doc_id")


def first_candidates(spark, folder):
    """The first three candidates of each run and query."""
    return sampling.first_per_group(C._runs(spark, folder), ["run_id", "query_id"], ["rank_no"], 3).select("run_id", "query_id", "rank_no", "doc_no")


def nonzero_features(spark, folder):
    return C.corpus(spark, folder).select("doc_id", sampling.nonzero_count(F.array(*[c.cast("float") for c in text_features().values()])).alias("nonzero"))


def standard_analysis(spark, folder):
    return C.query_set(spark, folder).select("query_id", F.array_join(T.standard_tokens(T.without_operators("query")), "|").alias("tokens"))


def json_fields(spark, folder):
    lines = C.query_set(spark, folder).select(F.to_json(F.struct(F.lit(1).alias("n"), F.col("query_id").alias("docno"), "relevant")).alias("line"))
    return lines.select(T.json_field("line", "docno").alias("docno"), T.json_field("line", "gone").alias("gone"))


def family_values(spark, folder):
    found = with_families(C.corpus(spark, folder), [WordLengths(), TitleShare()])
    return found.select("doc_id", *[F.round(F.col(c).cast("double"), 4).alias(c) for c in ("doc_mean_word_length", "doc_longest_word", "doc_title_share")])


def family_conditions(spark, folder):
    """Where the conditions of added families differ from the comparison of their values."""
    return disagreements(C.corpus(spark, folder), [WordLengths(), TitleShare()], [0.0, 5.5])


def feature_names(spark, folder):
    return spark.createDataFrame([(d["index"], d["name"], d["family"]) for d in described()], "place int, name string, family string")


_NAMES = """tree_scores nouns_by_lexicon corpus_shards_read headings_read index_written index_lookup queries_read candidate_lines_read ranked_lines_read lines_numbered relevance_read model_read dictionary_read query_log_read vectors_text_read vectors_binary_read
vectors_inspected candidates_json_read sharded_read by_query_read dataset_read dataset_files stream_rows_read text_body_read streamed_features predicate_counts single_term_documents hit_counts candidate_entries compared_model_ranks
pairs_above_both live_documents mandatory_pairs sorted_pairs split_by_rows limited_rows first_candidates nonzero_features standard_analysis json_fields family_values family_conditions feature_names""".split()
QUERIES = {n: globals()[n] for n in _NAMES}
