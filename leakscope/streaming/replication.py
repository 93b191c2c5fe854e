"""Replication search over files that keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from leakscope.operators.search import candidate_files, verified_files


def watch_files(spark: SparkSession, path: str, schema: StructType, patches: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Search each batch of new files (doc_id, file_repo, text, crawled_at) for copies of the patches.

    A file is searched when its doc_id first arrives, whenever it was crawled, and dropped each time it comes again. The ids
    of each batch are stored beside ``checkpoint``, in ``{checkpoint}-seen``. Ids and verified copies of a batch go to folders
    of its own number, so a batch that is run again after a failure replaces its rows instead of adding to them, and only
    the ids of earlier batches count as seen.
    """
    files = spark.readStream.schema(schema).parquet(path)
    ids = StructType([StructField("doc_id", schema["doc_id"].dataType), StructField("batch", IntegerType())])

    def search(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        batch = batch.dropDuplicates(["doc_id"])
        if number:
            batch = batch.join(session.read.schema(ids).parquet(f"{checkpoint}-seen").where(F.col("batch") < number).select("doc_id"), "doc_id", "left_anti")
        batch = batch.persist()
        batch.select("doc_id").where("doc_id is not null").write.mode("overwrite").parquet(f"{checkpoint}-seen/batch={number:08d}")
        found = verified_files(patches, batch, candidate_files(patches, batch)).where("verified")
        found.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number:08d}")
        batch.unpersist()

    return files.writeStream.foreachBatch(search).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
