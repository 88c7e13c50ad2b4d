"""Tables on shared storage: reading, cutting lineage, size-checked broadcasts and one row per key.

Nothing here keeps data on one machine: lineage is cut by writing Parquet to the folder that the
session names in ``spark.checkpoint.dir``, which every executor can read again after a loss.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when its measured rows times a row width stay under this many bytes.
BROADCAST_BYTES = 48 << 20


def read_table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """The Parquet table ``name`` of ``folder``, narrowed to ``columns`` (so that the scan reads no others)."""
    table = spark.read.parquet(f"{folder}/{name}.parquet")
    return table.select(*columns) if columns else table


_MADE: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """This application's folder below the one in ``spark.checkpoint.dir``; it is deleted when the application ends.

    Where the setting is unset, a local session gets a temporary folder; on a cluster that is an error, as executors would write
    to their own disks.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="termforge-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    folder = f"{base.rstrip('/')}/termforge-{context.applicationId}"
    if _MADE.get(context.applicationId) != folder:
        files, path = file_system(spark, folder)
        files.mkdirs(path)
        files.deleteOnExit(path)
        _MADE[context.applicationId] = folder
    return folder


def release(spark: SparkSession) -> None:
    """Deletes what the queries of this application wrote so far; their results must have been read or written elsewhere."""
    folder = _MADE.pop(spark.sparkContext.applicationId, None)
    if folder:
        files, path = file_system(spark, folder)
        files.delete(path, True)


def file_system(spark: SparkSession, path: str):
    """The file system of a path and the path as its object, whatever its scheme."""
    context = spark.sparkContext
    there = context._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(context._jsc.hadoopConfiguration()), there


def write_text_file(spark: SparkSession, path: str, text: str) -> None:
    """One small file of text."""
    files, there = file_system(spark, path)
    out = files.create(there, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text_file(spark: SparkSession, path: str) -> str:
    """The whole of one small file of text."""
    return "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing stands at yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to a new table in the shared folder and read it back: later jobs restart from the files."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fits_broadcast(table: DataFrame, row_bytes: int = 64, limit: int = BROADCAST_BYTES) -> bool:
    """Whether a table (already cut, so that counting reads only footers) is small enough to broadcast."""
    return table.count() * row_bytes <= limit


def join_sized(big: DataFrame, small: DataFrame, on, how: str = "inner", row_bytes: int = 64, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Join with ``small`` broadcast if its measured size allows it, else by shuffle (with AQE's skew handling)."""
    return big.join(F.broadcast(small) if fits_broadcast(small, row_bytes, limit) else small, on, how)


def newest_per_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key: the greatest by ``order``, then by a hash of the whole row.

    An aggregate, not a window: it combines before the shuffle, so a key that holds a third of all rows
    never gathers in one task. Rows with a null in ``key`` are dropped.
    """
    rest = [c for c in df.columns if c not in key]
    rank = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.xxhash64(*[F.col(c) for c in df.columns]).alias("h"))
    top = F.max_by(F.struct(*[F.col(c) for c in rest]), rank).alias("_row")
    kept = df.where(F.expr(" and ".join(f"`{k}` is not null" for k in key))).groupBy(*key).agg(top)
    return kept.select(*[F.col(c) if c in key else F.col(f"_row.`{c}`").alias(c) for c in df.columns])


def one_row_per_key(df: DataFrame, key: list[str], order: list[str], limit: int = BROADCAST_BYTES) -> DataFrame:
    """``newest_per_key`` for tables where few keys repeat: wide columns of the other rows are not shuffled.

    A first pass over ``key`` alone lists the keys that occur more than once. If that list is small enough to
    broadcast, only the rows of those keys go through the shuffle; otherwise all rows do. Same result either way.
    """
    there = df.where(F.expr(" and ".join(f"`{k}` is not null" for k in key)))
    repeated = cut(there.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*key), "repeated-keys")
    rows = repeated.count()
    if rows == 0:
        return there
    if rows * 48 * len(key) > limit:
        return newest_per_key(there, key, order)
    few = F.broadcast(repeated)
    return there.join(few, key, "left_anti").select(*df.columns).unionByName(newest_per_key(there.join(few, key, "left_semi").select(*df.columns), key, order))


def text_or_empty(c: str | Column) -> Column:
    """Null text counts as empty text."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
