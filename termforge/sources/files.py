"""Readers and writers of the engine's file formats."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termforge.functions import text as T
from termforge.plans.tables import file_system

CORPUS_SCHEMA = "docid string, title string, headings string, body string, url string"
QUERY_SCHEMA = "DOCNO string, text_raw string, relevantIdDoc array<string>"
CANDIDATE_SCHEMA = "query_id string, doc_no string, bm25 float, tfidf float, rank int"


def read_corpus(spark: SparkSession, paths: str | list[str], with_headings: bool = False) -> DataFrame:
    """``doc_id, title, body`` of JSON lines (gz or plain); lines that are no JSON objects are skipped, hidden files too."""
    rows = spark.read.schema(CORPUS_SCHEMA).option("mode", "DROPMALFORMED").option("pathGlobFilter", "[!._]*").json(paths)
    body = F.concat(T.text("headings"), F.lit("\n"), T.text("body")) if with_headings else F.col("body")
    return rows.select(F.col("docid").alias("doc_id"), "title", body.alias("body"))


def read_queries(spark: SparkSession, paths: str | list[str], limit: int | None = None) -> DataFrame:
    """``query_id, query, relevant`` of JSON lines; rows without id or text are skipped."""
    rows = spark.read.schema(QUERY_SCHEMA).option("mode", "DROPMALFORMED").json(paths).where("DOCNO <> '' and text_raw <> ''")
    rows = rows.select(F.col("DOCNO").alias("query_id"), F.col("text_raw").alias("query"), F.col("relevantIdDoc").alias("relevant"))
    return rows.limit(limit) if limit is not None else rows


def unescaped_json(c: Column | str) -> Column:
    """JSON that was wrapped as a CSV field (quotes around, inner quotes doubled or backslashed); other JSON stays as it is."""
    column = F.col(c) if isinstance(c, str) else c
    wrapped = column.startswith('"') & column.endswith('"') & (F.length(column) > 1)
    inner = F.substring(column, F.lit(2), F.length(column) - 2)
    slashed = inner.rlike(r'^\s*\{\s*\\"')
    plain = F.replace(F.replace(inner, F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))
    return F.when(wrapped & slashed, plain).when(wrapped, F.replace(inner, F.lit('""'), F.lit('"'))).otherwise(column)


def parse_candidates(lines: DataFrame, ranked: bool, strict: bool = True) -> DataFrame:
    """Candidates from ``part, line_no, value`` rows of tab-separated lines.

    Five fields: query, 0, docid, label, JSON; or, ``ranked``, query, 0, docid, JSON, rank, whose label is 0. Blank lines are
    skipped. Bad rows (field count, empty query or docid, label or rank no finite number, no JSON) fail if ``strict``, else drop out.
    """
    f = F.split("value", "\t", 5)
    fields = lines.where(T.control_trim("value") != "").select("part", "line_no", "value", F.size(f).alias("n"), F.get(f, 0).alias("query"), F.get(f, 2).alias("doc_id"), F.get(f, 4 if ranked else 3).alias("number"), unescaped_json(F.get(f, 3 if ranked else 4)).alias("json"))
    parsed = fields.withColumns({"x": F.from_json("json", "title string, body string"), "number": F.expr("try_cast(trim(number) as double)")})
    good = (F.col("n") == 5) & (F.col("query") != "") & (F.col("doc_id") != "") & F.col("number").isNotNull() & ~F.isnan("number") & (F.abs("number") != float("inf")) & F.col("x").isNotNull()
    good = F.coalesce(good, F.lit(False))
    checked = parsed.where(F.when(good, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("bad candidate line: "), F.col("value"))).cast("boolean"))) if strict else parsed.where(good)
    label = F.lit("0") if ranked else F.trim(F.get(F.split("value", "\t", 5), 3))
    return checked.select("part", "line_no", label.alias("label"), "query", "doc_id", T.text("x.title").alias("title"), T.text("x.body").alias("body"))


def shard_paths(spark: SparkSession, pattern: str, multiplier: int | None = None, per_set: int = 60) -> list[str]:
    """The files of a pattern in order of their names, hidden ones left out; with a multiplier the first ``per_set`` times as many. Missing shards are simply not there."""
    files, path = file_system(spark, pattern)
    found = sorted(str(s.getPath().toString()) for s in (files.globStatus(path) or []) if s.isFile() and s.getPath().getName()[:1] not in "._!")
    return found if multiplier is None else found[: per_set * multiplier]


def _plain(path: Column | str) -> Column:
    return F.regexp_replace(path, "^file:/+", "/")


def read_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``part, line_no, value``: the lines of text files numbered from 0, a part per path; missing paths must be left out.

    Files are read by their splits: lines are numbered within a split and shifted by the lines of the splits before it.
    """
    if not paths:
        raise ValueError("no paths")
    named = [(i, re.sub("^file:/+", "/", str(file_system(spark, p)[0].makeQualified(file_system(spark, p)[1]).toString()))) for i, p in enumerate(paths)]
    parts = spark.createDataFrame(named, "part int, _path string")  # one row per path
    rows = spark.read.text(paths).select("value", _plain(F.col("_metadata.file_path")).alias("_path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    sizes = rows.groupBy("_path", "_block").agg(F.count(F.lit(1)).alias("_n"))  # one row per split
    before = F.sum("_n").over(Window.partitionBy("_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_path", "_block", F.coalesce(before, F.lit(0)).alias("_start"))
    numbered = rows.withColumn("_r", F.row_number().over(Window.partitionBy("_path", "_block").orderBy("_id")) - 1)
    return numbered.join(starts, ["_path", "_block"]).join(F.broadcast(parts), "_path").select("part", (F.col("_start") + F.col("_r")).alias("line_no"), "value")


def read_text_body(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``doc_id, title, body`` of plain text files: a document per file, named by the file, without a title."""
    rows = spark.read.text(paths, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), "([^/]*)$", 1).alias("doc_id"), F.lit("").alias("title"), F.col("value").alias("body"))
    return rows


def read_relevance(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``query, doc_id`` from tab-separated lines query, 0, docid, ...; other lines are skipped."""
    f = F.split("value", "\t")
    return spark.read.text(paths).where(F.size(f) >= 3).select(F.get(f, 0).alias("query"), F.get(f, 2).alias("doc_id")).where("query <> '' and doc_id <> ''")


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """``word``: the trimmed, lower-cased lines, once each."""
    return spark.read.text(path).select(F.lower(T.control_trim("value")).alias("word")).where("word <> ''").distinct()


#: A lexicon is held by the plan, so it may have at most this many words.
MOST_LEXICON = 100_000


def read_lexicon(spark: SparkSession, path: str) -> dict[str, str]:
    """Lower-cased word -> tag from lines of word and tag; of several tags of a word the first in order counts. A longer file is an error."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where(F.size(f) >= 2).select(F.lower(T.control_trim(F.get(f, 0))).alias("word"), T.control_trim(F.get(f, 1)).alias("tag")).where("word <> '' and tag <> ''").groupBy("word").agg(F.min("tag").alias("tag"))
    found = rows.limit(MOST_LEXICON + 1).collect()
    if len(found) > MOST_LEXICON:
        raise ValueError(f"more than {MOST_LEXICON} words in {path}")
    return {r["word"]: r["tag"] for r in found}


def read_query_log(spark: SparkSession, path: str) -> DataFrame:
    """``query``: the second field of tab-separated lines; lines with fewer fields are skipped."""
    f = F.split("value", "\t")
    return spark.read.text(path).where(F.size(f) >= 2).select(F.get(f, 1).alias("query"))


def write_sharded(rows: DataFrame, folder: str, docid: str = "doc_id") -> None:
    """JSON lines in a folder per shard number of the document id; rows without one go to shard=__HIVE_DEFAULT_PARTITION__."""
    rows.withColumn("shard", T.shard_of(docid)).write.mode("overwrite").partitionBy("shard").json(folder)


#: Folders of a table partitioned by query.
QUERY_BUCKETS = 256


def _bucket(c: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int")


def write_by_query(rows: DataFrame, folder: str, buckets: int = QUERY_BUCKETS) -> None:
    """Appends JSON lines to a folder per bucket of the query id's hash, rows of a query together; a row without a query id is an error."""
    checked = rows.where(F.when(F.col("query_id").isNotNull(), F.lit(True)).otherwise(F.raise_error(F.lit("row without query_id")).cast("boolean")))
    placed = checked.withColumn("bucket", _bucket(F.col("query_id"), buckets))
    # a query of any size spreads over tasks; within a file its rows stand together
    placed.repartitionByRange("bucket", "query_id", F.rand(7)).sortWithinPartitions("bucket", "query_id").write.mode("append").partitionBy("bucket").json(folder)


def read_by_query(spark: SparkSession, folder: str, schema: str, query_id: str | None = None, buckets: int = QUERY_BUCKETS) -> DataFrame:
    """The rows of a table partitioned by query, of one query from its bucket alone."""
    rows = spark.read.schema(f"{schema}, bucket int").json(folder)
    if query_id is not None:
        rows = rows.where((F.col("bucket") == _bucket(F.lit(query_id), buckets)) & (F.col("query_id") == query_id))
    return rows.drop("bucket")


def write_candidates(rows: DataFrame, folder: str) -> None:
    rows.write.mode("errorifexists").json(folder)


def read_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(CANDIDATE_SCHEMA).json(folder)


def write_stream_rows(rows: DataFrame, folder: str, ranked: bool = False) -> None:
    """Tab-separated training rows: label, query, docid, the rank if ``ranked``, and the features (four decimals)."""
    numbers = F.array_join(F.transform("features", lambda x: F.format_string("%.4f", x)), "\t")
    head = ["label", "query", "doc_id", *(["rank"] if ranked else [])]
    rows.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in head], numbers).alias("value")).write.text(folder)


def read_stream_rows(spark: SparkSession, folder: str, ranked: bool = False) -> DataFrame:
    """``label, query, doc_id[, rank], features`` of such rows."""
    f = F.split("value", "\t")
    head = [F.get(f, i).alias(n) for i, n in enumerate(["label", "query", "doc_id"])] + ([F.get(f, 3).cast("int").alias("rank")] if ranked else [])
    at = 4 if ranked else 3
    return spark.read.text(folder).select(*head, F.slice(f, F.lit(at + 1), F.size(f) - at).cast("array<float>").alias("features"))


def append_columns(rows: DataFrame, extra: DataFrame, key: str) -> DataFrame:
    """Training rows with the features of a second table (``key``, ``features``) at the end of theirs; a row without a match is an error."""
    more = extra.select(key, F.col("features").alias("_more"))
    missing = F.raise_error(F.concat(F.lit("nothing to append for "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("boolean")
    return rows.join(more, key, "left").where(F.when(F.col("_more").isNotNull(), F.lit(True)).otherwise(missing)).withColumn("features", F.concat("features", "_more")).select(*rows.columns)


def write_vectors_text(vectors: DataFrame, folder: str) -> None:
    """Lines ``id<TAB>f1,f2,...`` with four decimals."""
    numbers = F.array_join(F.transform("features", lambda x: F.format_string("%.4f", x)), ",")
    vectors.select(F.concat_ws("\t", F.col("id"), numbers).alias("value")).write.text(folder)


def read_vectors_text(spark: SparkSession, folder: str) -> DataFrame:
    f = F.split("value", "\t", 2)
    return spark.read.text(folder).select(F.get(f, 0).alias("id"), F.split(F.get(f, 1), ",").cast("array<float>").alias("features"))


def pack_vectors(rows: list[tuple[str, list[float]]]) -> bytes:
    """A binary vector file: count and width as big-endian ints, then per row a two-byte length, the id and the floats."""
    width = len(rows[0][1]) if rows else 0
    out = [struct.pack(">ii", len(rows), width)]
    for name, values in rows:
        raw = name.encode()
        out.append(struct.pack(">H", len(raw)) + raw + struct.pack(f">{width}f", *values))
    return b"".join(out)


def _pack_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One file's bytes from all rows of a partition, in pieces; the header comes first, with a count of 0 (up to the end)."""
    width = None
    for batch in batches:
        out = []
        for name, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if width is None:
                width = len(values)
                out.append(struct.pack(">ii", 0, width))
            if len(values) != width:
                raise ValueError(f"{name} has {len(values)} features, not {width}")
            raw = name.encode()
            out.append(struct.pack(">H", len(raw)) + raw + struct.pack(f">{width}f", *values))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.binary())], names=["content"])


def write_vectors_binary(rows: DataFrame, folder: str, shard: Column | None = None, files: int = 16) -> None:
    """Binary vector files of ``id, features`` rows, each row of the table one piece of a file: a folder of Parquet tables of such pieces, one per task.

    Spark has no sink of raw bytes; ``read_vectors_binary`` reads files of the format itself, ``read_packed_vectors`` these.
    """
    placed = rows.select("id", "features").repartition(files, shard if shard is not None else F.col("id"))
    placed.mapInArrow(_pack_batches, "content binary").withColumn("part", F.spark_partition_id()).withColumn("piece", F.monotonically_increasing_id()).write.parquet(folder)


def _unpack_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for pieces in batch.column(0).to_pylist():
            rows = unpack_vectors(b"".join(pieces))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.float32()))], names=["doc_id", "features"])


def read_packed_vectors(spark: SparkSession, folder: str) -> DataFrame:
    whole = spark.read.parquet(folder).groupBy("part").agg(F.transform(F.sort_array(F.collect_list(F.struct("piece", "content"))), lambda x: x["content"]).alias("pieces"))
    return whole.select("pieces").mapInArrow(_unpack_pieces, "doc_id string, features array<float>")


def inspected(vectors: DataFrame, most: int = 5) -> tuple[int, int, list]:
    """Rows, width and the first rows of a table of vectors."""
    row = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("features")).alias("width")).first()
    return row["n"], row["width"] or 0, vectors.orderBy("doc_id").limit(most).collect()


def unpack_vectors(data: bytes) -> list[tuple[str, list[float]]]:
    """Rows of a binary vector file; a count of 0 means up to the end."""
    count, width = struct.unpack_from(">ii", data)
    at, out = 8, []
    while at < len(data) and (count <= 0 or len(out) < count):
        (size,) = struct.unpack_from(">H", data, at)
        name = data[at + 2 : at + 2 + size].decode()
        at += 2 + size
        out.append((name, list(struct.unpack_from(f">{width}f", data, at))))
        at += 4 * width
    return out


def _unpack_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column(0).to_pylist():
            rows = unpack_vectors(data)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.float32()))], names=["doc_id", "features"])


def read_vectors_binary(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``doc_id, features`` of binary vector files, a task per file."""
    return spark.read.format("binaryFile").load(paths).select("content").mapInArrow(_unpack_batches, "doc_id string, features array<float>")
