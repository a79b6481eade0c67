"""What the operators of this folder share: the shared folder, written intermediate tables, table access."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder that the driver and all executors reach: spark.checkpoint.dir.

    Only a session on one machine (master local[...]) may leave it unset; it then gets a temporary folder.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor reaches")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="opsignal-shared-")
    return _own[app]


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: cuts lineage, survives lost executors.

    The table goes when the session ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables of written() whose consumers have been written themselves."""
    for t in tables:
        at = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.written_path)
        at.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def lower_ascii(col):
    """A-Z to a-z; no other letter changes."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def named(docs: DataFrame) -> DataFrame:
    """docs with an id for rows without doc_id: a hash of the text, so that they are told apart by their texts."""
    return docs.withColumn("doc_id", _row_id(docs))


def _row_id(docs: DataFrame):
    return F.coalesce(docs["doc_id"], F.xxhash64(F.lit("no id"), F.coalesce(docs["text"], F.lit(""))))


def with_ids(docs: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of docs, all columns kept, whose id is (left_semi) or isn't (left_anti) in ids.doc_id, which are ids of named(docs)."""
    other = ids.select(F.col("doc_id").alias("__other_id")).distinct()
    return docs.join(other, _row_id(docs) == other["__other_id"], how)


def by_bytes(batches, most: int = 4 << 20):
    """The batches in slices of about `most` bytes, of one row at least."""
    for b in batches:
        step = max(1, b.num_rows * most // max(b.nbytes, 1))
        for k in range(0, b.num_rows, step):
            yield b.slice(k, step)


def session_parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
