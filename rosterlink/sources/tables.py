"""CSV intake and Parquet hand-offs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql.types import StringType, StructField, StructType

_local_folders: dict[str, str] = {}
#: Intermediates written by the flows that are open, the innermost last.
_owned: list[list[str]] = []


def read_grants_csv(
    spark: SparkSession, path: str, columns: list[str] | StructType, bad_records: str | None = None
) -> DataFrame:
    """CSV with a header; quoted fields may hold newlines and doubled quotes.

    Everything is read as text (inference would drop leading zeros) and bytes that are not
    UTF-8 become U+FFFD. A quoted field may cross lines, so a single file is one task: a
    large export should come as many files.

    A record with too many or too few fields fails the read. With ``bad_records``, the name of
    a further column, such records are kept: that column holds the record as it stands.
    """
    schema = columns if isinstance(columns, StructType) else StructType(
        [StructField(c, StringType()) for c in columns]
    )
    reader = spark.read.options(header=True, multiLine=True, quote='"', escape='"')
    if bad_records is None:
        return reader.options(enforceSchema=False, mode="FAILFAST").schema(schema).csv(path)
    kept = StructType([*schema.fields, StructField(bad_records, StringType())])
    reader = reader.options(mode="PERMISSIVE", columnNameOfCorruptRecord=bad_records)
    return reader.schema(kept).csv(path)


def read_stage(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_stage(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as named by ``spark.checkpoint.dir``.

    A temporary folder stands in only on a local master, where one machine is all there is.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _local_folders:
        _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="rosterlink-")
    return _local_folders[context.applicationId]


def materialize_observed(
    df: DataFrame, label: str, **metrics: Column
) -> tuple[DataFrame, dict[str, object]]:
    """``materialize`` that also returns aggregates of the rows written, from the same job.

    A task that is run again can count twice, so ask for what bears that, like a maximum.
    """
    seen = Observation(f"{label}-{uuid.uuid4().hex}")
    written = materialize(df.observe(seen, *[m.alias(n) for n, m in metrics.items()]), label)
    return written, seen.get


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage with something that outlives any executor, and gives later joins
    real file sizes to plan with.
    """
    spark = df.sparkSession
    path = "/".join(
        [
            shared_folder(spark),
            "rosterlink",
            spark.sparkContext.applicationId,
            f"{label}-{uuid.uuid4().hex}",
        ]
    )
    if _owned:
        _owned[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _located(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    """The file system that holds a path, and the path as it knows it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    files, at = _located(spark, path)
    return files.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this library has written."""
    files, at = _located(spark, path)
    files.delete(at, True)


@contextmanager
def owned_intermediates(spark: SparkSession) -> Iterator[list[str]]:
    """Removes the intermediates that ``materialize`` writes inside, at the end or on failure.

    What the caller goes on with has to be written elsewhere before.
    """
    _owned.append([])
    try:
        yield _owned[-1]
    finally:
        for path in _owned.pop():
            remove(spark, path)


class Steps:
    """The written tables of a run under one folder, each marked once it is finished.

    A run is known by its stamp: one that is started again under the same stamp reads the
    finished tables and goes on with the first that is not; another stamp makes all anew.
    """

    def __init__(self, spark: SparkSession, folder: str, run: str) -> None:
        self.spark, self.folder, self.run = spark, folder, run
        #: Names of the tables that this object has made, as opposed to read.
        self.made: list[str] = []

    def _mark(self, name: str) -> str:
        return f"{self.folder}/_finished/{self.run}/{name}"

    def finished(self, name: str) -> bool:
        return exists(self.spark, self._mark(name))

    def finish(self, name: str) -> None:
        files, at = _located(self.spark, self._mark(name))
        files.create(at, True).close()
        self.made.append(name)

    def table(
        self, name: str, make: Callable[[], DataFrame], partition_by: list[str] | None = None
    ) -> DataFrame:
        """The table of a step: made and written, or read if it was finished before."""
        path = f"{self.folder}/{name}"
        if not self.finished(name):
            write_stage(make(), path, partition_by)
            self.finish(name)
        return read_stage(self.spark, path)

    def do(self, name: str, work: Callable[[], None]) -> None:
        """Work that writes by itself, done once in a run."""
        if not self.finished(name):
            work()
            self.finish(name)
