"""Calls that arrive over time, merged into a store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def follow(spark: SparkSession, source: str, target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append the Parquet calls that appear under source to target, by contig; what a batch repeats, or the target has, is left out.

    Batches are numbered by the stream's checkpoint; a batch that runs again finds its rows there and adds none.
    """
    schema = spark.read.parquet(source).schema
    key = ["sample_id", "hap", "v_idx"]

    def merge(batch: DataFrame, _: int) -> None:
        new = batch.dropDuplicates(key)
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            contigs = [r["chrom"] for r in new.select("chrom").distinct().collect()]  # the target's other contigs are not read
            new = new.join(spark.read.schema(schema).parquet(target).where(F.col("chrom").isin(contigs)).select(*key), key, "left_anti")
        new.write.mode("append").partitionBy("chrom").parquet(target)

    writer = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
