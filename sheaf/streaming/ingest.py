"""Triples that arrive as files: parsed as they come, appended to a table partitioned by predicate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from sheaf.sources.readers import parse_triples


def stream_triples(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of triples from the text files that appear in a folder."""
    return parse_triples(spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder))


def append_triples(triples: DataFrame, table: str, state: str, once: bool = True) -> StreamingQuery:
    """Append the stream to a Parquet table; ``state`` keeps what was read, so a restart goes on where it stopped."""
    writer = triples.writeStream.format("parquet").option("path", table).option("checkpointLocation", state).partitionBy("pred").outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
