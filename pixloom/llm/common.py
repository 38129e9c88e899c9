"""What the operators of this subpackage share: the shared folder, written tables, word rules."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: bytes.translate table: A-Z become a-z, and \x09-\x0D become a space.
LOWER_AND_SPACE = bytes(32 if 9 <= i <= 13 else i + 32 if 65 <= i <= 90 else i for i in range(256))

#: Records of one Arrow batch; a batch of the longest documents must fit a Python worker.
ARROW_RECORDS = 512


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Where it is unset, one machine alone (a local master, as in tests) gets a
    folder of its own; on a cluster that is an error, as executors would each
    write to their own disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='shared-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends here, and a lost executor costs nothing that came before."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bounds the records of an Arrow batch for this session's later actions."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_RECORDS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_RECORDS)


def grouped(rows: DataFrame, by: str, split: list[str], part: list, whole: list, having: str = "true") -> DataFrame:
    """rows with figures of their group (equal `by`), for groups that meet `having`; no task holds a whole group.

    Rows are dealt out by (by, salt), the salt from their columns `split`.  Each
    (by, salt) gives partial figures `part`, each group the figures `whole` from
    these, and they go back to the salts that the group has.  A hot group is thus
    spread over all partitions.  Rows without a group go.  Rows are dealt out once if `part`
    uses all their columns and no Python made them.
    """
    n = partitions(rows.sparkSession)
    salt = F.coalesce(F.pmod(F.xxhash64(*split), F.lit(n)).cast("int"), F.lit(0))
    dealt = rows.where(F.col(by).isNotNull()).withColumn("salt", salt).repartition(n, by, "salt")
    parts = dealt.groupBy(by, "salt").agg(*part)
    groups = parts.groupBy(by).agg(*whole, F.collect_list("salt").alias("salts")).where(having)
    return dealt.join(groups.withColumn("salt", F.explode("salts")).drop("salts"), [by, "salt"]).drop("salt")


def keyed(docs: DataFrame) -> DataFrame:
    """(row: struct of doc_id and the text's digest, text): ids may be null or repeat."""
    return docs.select(F.struct("doc_id", F.xxhash64("text").alias("digest")).alias("row"), "text")


def rows_of(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id, null or not, and text digest rows (doc_id, digest) has."""
    rows = rows.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_digest"))
    return docs.join(rows, same, "left_semi").select(docs.columns)


def one_of(docs: DataFrame, rows: DataFrame, every: DataFrame) -> DataFrame:
    """rows_of(docs, rows), each once; every has (doc_id, digest) of all rows of docs."""
    again = every.groupBy("doc_id", "digest").count().where("count > 1")
    kept = rows_of(docs, rows)
    return kept if again.isEmpty() else kept.dropDuplicates(["doc_id", "text"])  # texts move for it only where rows repeat


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
