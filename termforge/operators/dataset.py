"""Training sets: union of candidate sources, split by query, features, files."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termforge.functions import text as T
from termforge.plans.tables import file_system, write_text_file

SPLIT_SEED, TRAIN_FRACTION, BM25_ROWS = 42, 0.95, 100_002
CANDIDATE = ["source", "part", "line_no", "label", "query", "doc_id", "title", "body"]


def numbered_rows(rows: DataFrame, limit: int = -1) -> DataFrame:
    """The first ``limit`` rows of a source by part and line (all for -1, none for 0)."""
    if limit < 0:
        return rows
    return rows.orderBy("part", "line_no").limit(limit)


def union_sources(*sources: DataFrame) -> DataFrame:
    """All rows of all sources, repeated ones too, in the order of the arguments (column ``source``)."""
    return reduce(DataFrame.unionByName, [s.withColumn("source", F.lit(i)).select(*CANDIDATE) for i, s in enumerate(sources)])


def group_split(rows: DataFrame, group: str = "query", fraction: float = TRAIN_FRACTION, seed: int = SPLIT_SEED) -> DataFrame:
    """Adds ``split``: all rows of a group go to ``train`` or ``valid``; the first floor(fraction * groups) groups by a hash train.

    The order of the groups is that of md5(seed|group), which does not depend on partitions or runs. Ranks are taken in two
    steps: groups are counted by the hash's first four hex digits, and only those at the boundary are numbered.
    """
    if not 0 < fraction < 1:
        raise ValueError("fraction must lie between 0 and 1")
    groups = rows.select(group).distinct().withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(group))))
    bins = groups.groupBy(F.substring("_h", 1, 4).alias("_bin")).agg(F.count(F.lit(1)).alias("_n"))  # at most 65,536 rows
    before = bins.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    total = bins.agg(F.sum("_n").alias("_total"))
    placed = groups.withColumn("_bin", F.substring("_h", 1, 4)).join(F.broadcast(before), "_bin").crossJoin(F.broadcast(total))
    at = F.col("_before") + F.row_number().over(Window.partitionBy("_bin").orderBy("_h", group))
    split = placed.withColumn("split", F.when(at <= F.floor(F.col("_total") * F.lit(fraction)), "train").otherwise("valid"))
    return rows.join(split.select(group, "split"), group)


def row_split(rows: DataFrame, keys: list[str], fraction: float = TRAIN_FRACTION, seed: int = SPLIT_SEED) -> DataFrame:
    """Adds ``split`` by single rows: a hash of the row's keys and the seed below the fraction trains."""
    value = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *keys)), 1, 12), 16, 10).cast("double") / float(1 << 48)
    return rows.withColumn("split", F.when(value < fraction, "train").otherwise("valid"))


def manifest(rows: DataFrame) -> DataFrame:
    """Rows, queries and documents by source and split."""
    return rows.groupBy("source", "split").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("query").alias("queries"), F.countDistinct("doc_id").alias("documents"))


def feature_schema(families: list[tuple[str, str]], first: int = 3) -> list[tuple[int, str, str]]:
    """(column index, feature, family) rows; features follow the label, query and document columns."""
    names = [n for n, _ in families]
    if len(set(names)) != len(names):
        raise ValueError("feature names repeat")
    return [(first + i, n, f) for i, (n, f) in enumerate(families)]


def write_dataset(rows: DataFrame, features: list[tuple[str, str]], folder: str) -> dict:
    """Writes ``train`` and ``valid`` as CSV folders, the schema, names and manifest; the folder must not exist and appears, by a rename, only when complete.

    Rows of a query stand together, in source order. Any file system that Spark writes to.
    """
    spark = rows.sparkSession
    files, target = file_system(spark, folder)
    if files.exists(target):
        raise FileExistsError(folder)
    staging = folder.rstrip("/") + ".staging"
    files.delete(file_system(spark, staging)[1], True)  # what a run that broke off left
    names = [n for n, _ in features]
    counts = {r["split"]: r["n"] for r in rows.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    for split in ("train", "valid"):
        if not counts.get(split):
            raise ValueError(f"no rows in {split}")
    columns = [T.csv_field(F.col("label").cast("string")), *[T.csv_field(c) for c in ("query", "doc_id")], *[F.col(n).cast("float").cast("string") for n in names]]
    for split in ("train", "valid"):
        ordered = rows.where(F.col("split") == split).repartitionByRange("query").sortWithinPartitions("query", "source", "part", "line_no")
        ordered.select(F.concat_ws(",", *columns).alias("value")).write.option("lineSep", "\r\n").text(f"{staging}/{split}")
    by_source = [r.asDict() for r in manifest(rows).orderBy("source", "split").toLocalIterator()]
    out = {"rows": {k: counts[k] for k in ("train", "valid")}, "by_source": by_source, "features": len(names), "seed": SPLIT_SEED, "train_fraction": TRAIN_FRACTION}
    schema = "".join(f"{i},{n},{f}\n" for i, n, f in feature_schema(features))
    for name, text in (("header.csv", ",".join(["label", "query", "doc_id", *names]) + "\r\n"), ("feature_schema.csv", "column_index,feature_name,family\n" + schema), ("feature_names.txt", "\n".join(names) + "\n"), ("manifest.json", json.dumps(out, indent=1))):
        write_text_file(spark, f"{staging}/{name}", text)
    if not files.rename(file_system(spark, staging)[1], target):
        raise OSError(f"could not publish {folder}")
    return out
