"""Command line: one search over an index or corpus, cold or prepared, with timings.

    python -m termforge.runner --corpus 'shards/*.gz' --model model.json --query 'grammar terms' --top-k 10
"""

from __future__ import annotations

import argparse
import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termforge.operators import model
from termforge.operators.document_features import DOCUMENT_FEATURES, document_features, text_features
from termforge.operators.index import Index, build_index, indexable, open_index
from termforge.operators.pair_features import PAIR_FEATURES
from termforge.operators.query_features import QUERY_FEATURES, query_features, query_frequencies
from termforge.operators.retrieval import hydrated
from termforge.plans.search import needs_a_term, planned, search_rows
from termforge.sources import files

DICTIONARY_FEATURES = {n for n in DOCUMENT_FEATURES if "dictionary" in n} | {"QueryNonDictionaryCount"}
FREQUENCY_FEATURES = {n for n in QUERY_FEATURES if n.endswith("LogFrequency")}


def setting(name: str, value: str | None, default: str | None = None, spark: SparkSession | None = None) -> str | None:
    """An option, else the session's property spark.termforge.<name>, else the environment variable TERMFORGE_<NAME>, else the line <name>=... of the file
    that TERMFORGE_CONFIG names, else the default."""
    if value is not None:
        return value
    found = spark.conf.get(f"spark.termforge.{name}", None) if spark is not None else None
    found = found or os.environ.get(f"TERMFORGE_{name.upper()}")
    if found is None and (config := os.environ.get("TERMFORGE_CONFIG")):
        with open(config, encoding="utf-8") as file:
            lines = dict(x.strip().split("=", 1) for x in file if "=" in x and not x.lstrip().startswith("#"))
        found = {k.strip(): v.strip() for k, v in lines.items()}.get(name)
    return found if found is not None else default


def needed_inputs(m: model.Model) -> set[str]:
    """Which further inputs a model asks for: ``dictionary`` or ``frequencies``."""
    used = m.used_features()
    return ({"dictionary"} if used & DICTIONARY_FEATURES else set()) | ({"frequencies"} if used & FREQUENCY_FEATURES else set())


class Search:
    """A model over a document collection; ``prepare`` works out a query once, further searches reuse its rows."""

    def __init__(self, docs: DataFrame, m: model.Model, dictionary: DataFrame | None = None, query_log: DataFrame | None = None, index: Index | None = None) -> None:
        missing = needed_inputs(m) - ({"dictionary"} if dictionary is not None else set()) - ({"frequencies"} if query_log is not None else set())
        if missing:
            raise ValueError(f"the model needs {', '.join(sorted(missing))}")
        unknown = m.used_features() - {*DOCUMENT_FEATURES, *PAIR_FEATURES, *QUERY_FEATURES}
        if unknown:
            raise KeyError(f"unknown features {sorted(unknown)}")
        self.model, self.dictionary, self.query_log = m, dictionary, query_log
        self.index = index if index is not None else build_index(indexable(docs))
        self.docs = self.index.docs

    def prepare(self, query: str, threshold: float | None = None) -> tuple[DataFrame, model.Conditions]:
        """The documents with the features that the model uses, and its conditions with the query's own features as constants.

        With a threshold only documents that can score above it: where that takes a term of the query, those of the terms' postings.
        """
        used = self.model.used_features()
        spark = self.docs.sparkSession
        constants: dict[str, float] = {}
        if used & set(QUERY_FEATURES):
            none = spark.createDataFrame([], "word string")
            log = query_frequencies(self.query_log) if self.query_log is not None else spark.createDataFrame([], "word string, n bigint")
            asked = spark.createDataFrame([("q", query)], "query_id string, query string")
            constants = query_features(asked, self.dictionary if self.dictionary is not None else none, log).drop("query_id").first().asDict()
        lexical = tuple(n for n in PAIR_FEATURES if n in used)
        every = threshold is None or not needs_a_term(self.model, threshold, constants)
        found = search_rows(self.index, planned(self.index, query), lexical, every) if lexical or not every else self.docs
        rows = found.select("doc_id", *lexical, *[c.cast("float").alias(n) for n, c in text_features().items() if n in used])
        if used & DICTIONARY_FEATURES & set(DOCUMENT_FEATURES):
            wanted = sorted(used & DICTIONARY_FEATURES & set(DOCUMENT_FEATURES))
            kept = self.docs.join(rows.select("doc_id"), "doc_id", "left_semi")
            rows = rows.join(document_features(kept, self.dictionary).select("doc_id", *wanted), "doc_id")
        return rows, model.Conditions({c: F.col(c) for c in rows.columns}, constants)

    def ranked(self, query: str, threshold: float, k: int, prepared: tuple | None = None) -> DataFrame:
        rows, conditions = prepared or self.prepare(query, threshold)
        return model.ranked(rows, self.model, threshold, k, conditions=conditions).select("doc_id", "score", "probability")

    def first(self, query: str, threshold: float, n: int, prepared: tuple | None = None) -> DataFrame:
        rows, conditions = prepared or self.prepare(query, threshold)
        return model.first_matches(rows, self.model, threshold, n, conditions=conditions).select("doc_id", "score")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="termforge", allow_abbrev=False)
    p.add_argument("--corpus", help="JSON-lines files (environment: TERMFORGE_CORPUS)")
    p.add_argument("--index", help="folder of a written index, in place of a corpus (environment: TERMFORGE_INDEX)")
    p.add_argument("--model", help="model file (environment: TERMFORGE_MODEL)")
    p.add_argument("--query", required=True)
    p.add_argument("--threshold", type=float, default=3.0)
    some = p.add_mutually_exclusive_group()
    some.add_argument("--limit", type=int, help="the first matches in document order")
    some.add_argument("--top-k", type=int, help="the best by score")
    p.add_argument("--dictionary")
    p.add_argument("--query-log")
    p.add_argument("--hot", action="store_true", help="prepare once and warm up")
    p.add_argument("--explain", action="store_true", help="with the conjunctions that hold for each hit")
    p.add_argument("--repeat", type=int, default=1)
    p.add_argument("--output")
    return p


def run(arguments: list[str], spark: SparkSession | None = None) -> dict:
    options = parser().parse_args(arguments)
    corpus, stored, model_file = (setting(n, getattr(options, n), spark=spark) for n in ("corpus", "index", "model"))
    if not (corpus or stored) or not model_file:
        raise SystemExit("--model and one of --corpus and --index are required")
    if options.repeat < 1 or (options.limit or options.top_k or 1) < 1:
        raise SystemExit("counts must be positive")
    spark = spark or SparkSession.builder.appName("termforge").getOrCreate()
    dictionary = files.read_dictionary(spark, options.dictionary) if options.dictionary else None
    log = files.read_query_log(spark, options.query_log) if options.query_log else None
    index = open_index(spark, stored) if stored else None
    docs = index.docs if index else files.read_corpus(spark, corpus)
    search = Search(docs, model.read_model(model_file), dictionary, log, index)
    ranked, most = options.limit is None, options.limit or options.top_k or 10
    began = time.perf_counter()
    prepared = None
    if options.hot:
        rows, conditions = search.prepare(options.query, options.threshold)
        prepared = rows.persist(), conditions
        prepared[0].count()
    prepare_ms = (time.perf_counter() - began) * 1000
    runs = []
    for i in range(options.repeat):
        began = time.perf_counter()
        hits = (search.ranked if ranked else search.first)(options.query, options.threshold, most, prepared)
        built = time.perf_counter()
        found = [r.asDict() for r in hits.collect()]  # at most ``most`` rows
        searched = time.perf_counter()
        texts = {r["doc_id"]: r.asDict() for r in hydrated(spark.createDataFrame([(h["doc_id"],) for h in found], "doc_id string"), docs).collect()} if found else {}
        ended = time.perf_counter()
        active = {}
        if options.explain and found:
            rows, conditions = prepared or search.prepare(options.query, options.threshold)
            active = {r["doc_id"]: [x.asDict() for x in r["active"]] for r in model.explained(rows.where(F.col("doc_id").isin([h["doc_id"] for h in found])), search.model, conditions).select("doc_id", "active").collect()}
            found = [h | {"active": active.get(h["doc_id"], [])} for h in found]
        told = time.perf_counter()
        timings = {"build_query": (built - began) * 1000, "search": (searched - built) * 1000, "fetch_documents": (ended - searched) * 1000, "explain": (told - ended) * 1000}
        runs.append({"run": i + 1, "search_ms": sum(timings.values()), "timings_ms": timings, "result": {"query": options.query, "threshold": options.threshold, "returned": len(found), "limit_reached": not ranked and len(found) == most, "candidates": [h | {k: texts[h["doc_id"]][k] for k in ("title", "body")} for h in found if h["doc_id"] in texts]}})
    out = {"mode": "hot" if options.hot else "cold", "retrieval_mode": "ranked" if ranked else "first", "prepare_ms": prepare_ms, "runs": runs}
    if options.output:
        with open(options.output, "w", encoding="utf-8") as file:
            json.dump(out, file, ensure_ascii=False, indent=1)
    return out


if __name__ == "__main__":
    import sys

    print(json.dumps(run(sys.argv[1:]), ensure_ascii=False))
