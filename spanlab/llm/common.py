"""What the operators of this subpackage share: tables, the shared folder, Arrow maps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it in spark.checkpoint.dir.

    Where it is unset a folder is made, on a local master only: on a cluster a
    machine-local folder would be wrong, so that raises ``ValueError``.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spanlab-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


#: tables of this process that are still there, oldest first
_made: list[str] = []


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; what is left there goes when the application ends."""
    path = f"{shared_folder(spark)}/llm-{label}-{uuid.uuid4().hex}"
    fs, where = _folder(spark, path)
    fs.deleteOnExit(where)
    _made.append(path)
    return path


def _folder(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage and outlives any executor."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that materialize() wrote and nobody reads any more."""
    for df in tables:
        _delete(df.sparkSession, df.written_to)


def _delete(spark: SparkSession, path: str) -> None:
    fs, where = _folder(spark, path)
    fs.delete(where, True)
    _made.remove(path)


class Passing:
    """Tables made inside the block that only serve the ones that are kept.

    ``keep(df, label)`` writes a table that stays; when the block ends without an error, all
    others that were made inside it are deleted.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.kept = spark, set()

    def __enter__(self) -> Passing:
        self.before = len(_made)
        return self

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        out = materialize(df, label)
        self.kept.add(_made[-1])
        return out

    def __exit__(self, kind, *_):
        if kind is None:
            for path in [p for p in _made[self.before :] if p not in self.kept]:
                _delete(self.spark, path)


def map_arrow(
    df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch | pa.Table]], schema: str
) -> DataFrame:
    """mapInArrow of a function from one batch to some batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for out in fn(batch):
                if isinstance(out, pa.Table):
                    yield from out.to_batches()
                else:
                    yield out

    return df.mapInArrow(run, schema)


def positional(df: DataFrame) -> DataFrame:
    """The same columns named c0, c1, ...: no name of a caller's can clash with ours."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def unit_hash(col: Column) -> Column:
    """A number in [0, 1) fixed by the value; the same in SQL through md5."""
    digits = F.substring(F.md5(F.coalesce(col.cast("string"), F.lit("null"))), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(4294967296.0)
