"""New files as a stream: each key is taken once, however often it arrives; availableNow drains what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from millrace.operators.tables import Catalog


def arrivals(spark: SparkSession, folder: str, schema: StructType, keys: list[str]) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder).dropDuplicates(keys)


def drain(stream: DataFrame, catalog: Catalog, table: str, checkpoint: str) -> StreamingQuery:
    """Each batch is inserted where its keys are missing, so a batch that is run again adds nothing."""
    q = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, _: catalog.insert_missing(table, df)).start()
    q.awaitTermination()
    return q
