"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def session(app: str = "sheaf", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, Arrow transfer and UTC; ``conf`` overrides."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    } | conf
    builder = SparkSession.builder.appName(app).config(map=settings)
    return (builder.master(master) if master else builder).getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    Where that is unset and Spark runs inside one process, a temporary folder is made once and
    kept in the session; on a cluster an unset folder is an error, since a machine-local one
    would lose data with its executor.
    """
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("sheaf.scratch.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="sheaf-")
    spark.conf.set("sheaf.scratch.dir", made)
    return made


#: Folders written by :func:`materialize` and not deleted yet.
_written: list[str] = []


def _delete(spark: SparkSession, folder: str, on_exit: bool = False) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.deleteOnExit(path) if on_exit else files.delete(path, True)


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and lost executors don't matter. The files go when the application ends, if not before."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    _delete(spark, path, on_exit=True)
    return spark.read.schema(df.schema).parquet(path)


def settle(spark: SparkSession, make: Callable[[], DataFrame], name: str = "table") -> DataFrame:
    """``materialize(make())``; the tables that ``make`` wrote on its way are deleted once the result is there."""
    mark = len(_written)
    table = materialize(make(), name)
    for path in _written[mark:-1]:
        _delete(spark, path)
    del _written[mark:-1]
    return table


def materialize_measured(df: DataFrame, name: str, **measures: Column) -> tuple[DataFrame, dict]:
    """:func:`materialize`, and aggregates of the rows taken while they are written, so that loops need no job of their own to see whether they are done."""
    seen = Observation()
    table = materialize(df.observe(seen, *[c.alias(k) for k, c in measures.items()]), name)
    return table, seen.get


def discard(df: DataFrame) -> None:
    """Delete the files behind a table that :func:`materialize` returned; only for tables nothing will read again."""
    spark = df.sparkSession
    name = lambda path: path.split("://")[-1].removeprefix("file:").replace("//", "/")
    folders = {name(f.rsplit("/", 1)[0]) for f in df.inputFiles()}
    for path in [p for p in _written if name(p) in folders]:
        _delete(spark, path)
        _written.remove(path)
