"""Continuous ingest: micro-batches upserted by id into a table of deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ingest(spark: SparkSession, source: str, schema: str, target: str, key: str, order: str, checkpoint: str) -> DataFrame:
    """Takes in what is new in a Parquet folder and returns the table: of each id the row of the highest order in the
    latest batch that has it.

    A batch adds a folder with its own rows, one for each id, and rewrites nothing; it writes the same folder anew when it
    runs again after a failure, so each row takes effect once. Without new files nothing is written.
    """

    def apply(batch: DataFrame, epoch: int) -> None:
        newest = F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))
        batch.withColumn("_n", newest).where("_n = 1").drop("_n").write.mode("overwrite").parquet(f"{target}/batch={epoch}")

    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return current(spark, schema, target, key)


def current(spark: SparkSession, schema: str, target: str, key: str) -> DataFrame:
    """The table as it is after the latest batch; empty before the first."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, batch long").parquet(target)
    columns = [c for c in rows.columns if c != "batch"]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), "batch").alias("_row")).select("_row.*")


def compact(spark: SparkSession, schema: str, target: str, key: str) -> None:
    """The table as one batch, numbered as the latest; run it while no stream writes."""
    rows = spark.read.schema(f"{schema}, batch long").parquet(target)
    last = rows.agg(F.max("batch")).first()[0]
    if last is None:
        return
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    files = path(target).getFileSystem(conf)
    current(spark, schema, target, key).write.mode("overwrite").parquet(f"{target}_compacted")
    for status in files.listStatus(path(target)):
        files.delete(status.getPath(), True)
    files.rename(path(f"{target}_compacted"), path(f"{target}/batch={last}"))
