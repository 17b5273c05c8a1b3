"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id BIGINT, text STRING) of a document table; any other columns are left behind, rows without doc_id go."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")


def map_batches(df: DataFrame, work: Callable[[pa.RecordBatch], Iterator[dict]], schema: str) -> DataFrame:
    """mapInArrow with column dicts: ``work`` yields dicts of arrays for each batch."""
    spark_schema = T._parse_datatype_string(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(spark_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns in work(batch):
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type, from_pandas=False) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in target], schema=target)

    return df.mapInArrow(run, spark_schema)


def filter_rows(df: DataFrame, keep: Callable[[pa.RecordBatch], pa.Array]) -> DataFrame:
    """Rows of ``df`` for which ``keep`` is true, all columns kept, nothing shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(keep(batch), pa.bool_()))

    return df.mapInArrow(run, df.schema)


#: Ids that may be broadcast; above it the rows are joined by a shuffle.
BROADCAST_IDS = 2_000_000


def drop_ids(docs: DataFrame, ids: DataFrame, limit: int = BROADCAST_IDS) -> DataFrame:
    """Documents whose doc_id is not in ``ids`` (one column doc_id, materialised); null ids stay."""
    small = ids.select(F.col("doc_id").alias("__drop_id")).distinct()
    side = F.broadcast(small) if ids.count() <= limit else small
    return docs.join(side, docs["doc_id"] == side["__drop_id"], "left_anti")


def only_ids(docs: DataFrame, ids: DataFrame, limit: int = BROADCAST_IDS) -> DataFrame:
    """Documents whose doc_id is in ``ids`` (one column doc_id, materialised), where these are few enough to broadcast; else ``docs`` as it is, for the join to come."""
    small = ids.select(F.col("doc_id").alias("__only_id")).distinct()
    return docs.join(F.broadcast(small), docs["doc_id"] == small["__only_id"], "left_semi") if small.count() <= limit else docs
