"""Files that arrive in a folder, each micro-batch upserted into a table (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.rules import col
from ..sources.load import Store, with_lineage


def watch(spark: SparkSession, folder: str, columns: list[str]) -> DataFrame:
    """A stream of the CSV files of a folder, all columns text."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    rows = spark.readStream.schema(schema).option("header", True).option("quote", '"').option("escape", '"').csv(folder)
    return rows.select(*[F.coalesce(col(c), F.lit("")).alias(c) for c in columns])


def upsert_stream(store: Store, stream: DataFrame, table: str, key: str, checkpoint: str, source: str = "stream") -> StreamingQuery:
    """Starts the upserts, each of which writes the partitions of keys that its batch touches; a
    batch that ran before gives the same table when it runs again."""

    def step(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        store.upsert(table, with_lineage(batch, source, number), key)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
