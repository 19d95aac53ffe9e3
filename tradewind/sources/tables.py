"""Tables of a data set or model as parquet folders, published a whole version at a time.

A load writes its tables into a version folder of its own and then makes one empty marker file,
which is the switch: the greatest marker names the current version. Readers resolve it once with
``current`` and so see all tables of one load, old or new. A load that fails leaves no marker, and
its folder is dropped. Nothing is renamed or replaced, so this needs no more of the file system than
that a file appears at once.

    folder/_versions/000002-1f0c…/relational/events/…
    folder/_published/000002-1f0c…
"""

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..schemas import CLEAN

# Versions that stay readable after a load: its own and the one that it replaces, for readers that began before.
KEPT = 2


def write_tables(tables: dict[str, DataFrame], folder: str, partition_by: dict[str, str] | None = None) -> None:
    """Write each table to ``folder/name``, replacing what is there, table by table; see ``publication``.

    ``partition_by`` names the column to lay a table out by, such as the month of events.
    """
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        if partition_by and name in partition_by:
            writer = writer.partitionBy(partition_by[name])
        writer.parquet(f"{folder}/{name}")


def read_tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}


def read_clean(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The current cleaned tables, read with their fixed schemas."""
    path = current(spark, folder)
    return {name: spark.read.schema(schema).parquet(f"{path}/{name}") for name, schema in CLEAN.items()}


# ── versions ────────────────────────────────────────────────────────────────────────────────────


@dataclass(frozen=True)
class Version:
    """A load under way. ``path`` takes any folders of tables."""

    spark: SparkSession
    folder: str
    name: str

    @property
    def path(self) -> str:
        return f"{self.folder}/_versions/{self.name}"

    def write(self, tables: dict[str, DataFrame], partition_by: dict[str, str] | None = None) -> dict[str, DataFrame]:
        """Store tables of the version and return scans of them."""
        write_tables(tables, self.path, partition_by)
        return {name: self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}") for name, df in tables.items()}


class _Files:
    """The file system of a folder, whichever Spark knows it."""

    def __init__(self, spark: SparkSession, folder: str):
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._system = self._path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        place = self._path(folder)
        return sorted(s.getPath().getName() for s in self._system.listStatus(place)) if self._system.exists(place) else []

    def mark(self, file: str) -> None:
        if not self._system.createNewFile(self._path(file)):
            raise FileExistsError(file)

    def drop(self, place: str) -> None:
        self._system.delete(self._path(place), True)


def published(spark: SparkSession, folder: str) -> list[str]:
    """The versions that can be read, oldest first."""
    return _Files(spark, folder).names(f"{folder}/_published")


def current(spark: SparkSession, folder: str) -> str:
    """The path of the current version's tables; the folder itself if nothing was published there."""
    versions = published(spark, folder)
    return f"{folder}/_versions/{versions[-1]}" if versions else folder


@contextmanager
def publication(spark: SparkSession, folder: str, keep: int = KEPT) -> Iterator[Version]:
    """A new version of ``folder``, published when the block ends, or dropped if it fails.

    Versions before the last ``keep`` are dropped then, with what loads left behind that were killed
    before them. Loads may overlap: each has a folder of its own, and the one with the greater name stays current.
    """
    files = _Files(spark, folder)
    last = max([0, *(int(name.split("-")[0]) for name in files.names(f"{folder}/_versions"))])
    version = Version(spark, folder, f"{last + 1:06d}-{uuid.uuid4().hex}")
    try:
        yield version
    except BaseException:
        files.drop(version.path)
        raise
    files.mark(f"{folder}/_published/{version.name}")
    oldest = published(spark, folder)[-keep:][0]
    for name in files.names(f"{folder}/_versions"):
        if name < oldest:
            files.drop(f"{folder}/_published/{name}")
            files.drop(f"{folder}/_versions/{name}")
