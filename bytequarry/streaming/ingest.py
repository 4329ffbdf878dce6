"""Files that arrive: a stream appends them to the indexed corpus, and a search reads what is indexed and what isn't yet.

The stream's checkpoint says which files are done. A batch is written under its number, so one that is run again
after a failure replaces itself and no document comes twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

SCHEMA = T.StructType([T.StructField("doc", T.LongType()), T.StructField("info", T.StringType()), T.StructField("content", T.BinaryType())])


def start(spark: SparkSession, staging: str, index: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Begin to move Parquet corpora from ``staging`` to ``index``; with ``once``, stop when there is nothing more."""

    def put(batch: DataFrame, number: int) -> None:
        batch.select("doc", "info", "content").write.mode("overwrite").parquet(f"{index}/batch={number}")

    writer = spark.readStream.schema(SCHEMA).parquet(staging).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def indexed(spark: SparkSession, index: str) -> DataFrame:
    return spark.read.schema(T.StructType([*SCHEMA.fields, T.StructField("batch", T.IntegerType())])).parquet(index).drop("batch")


def everything(spark: SparkSession, staging: str, index: str) -> DataFrame:
    """What is indexed and, of what is staged, the documents that aren't."""
    done = indexed(spark, index)
    new = spark.read.schema(SCHEMA).parquet(staging).join(done.select("doc"), "doc", "left_anti")
    return done.unionByName(new)


def running_counts(spark: SparkSession, staging: str, pattern: bytes) -> DataFrame:
    """A streaming DataFrame of one row, n: how many documents that arrived so far hold a string."""
    stream = spark.readStream.schema(SCHEMA).parquet(staging)
    return stream.filter(F.contains("content", F.lit(pattern))).agg(F.count(F.lit(1)).alias("n"))
