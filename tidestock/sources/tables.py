"""Parquet layers under one root folder, and database reads.

A table is a folder of versions. A reload writes a new version beside the old one and then marks it in
the table's log, one empty file per version, which is the only step that readers can see: a reload that fails on the
way leaves the former table as it was, and a query that has begun keeps reading the version it began
with. The last versions are kept, older ones and those of failed reloads are deleted by later reloads.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from ..plans.clean import conform

POLICY_TABLE = "opt_inventory_policy"


#: Layers that are kept are packed closer than intermediate tables, which are read once or twice.
CODEC = "zstd"
#: Versions that stay readable, the current one included.
KEPT_VERSIONS = 2
#: Age in hours from which a version that no reload marked counts as that of a failed one.
FAILED_AFTER = 24


class _Folder:
    """A folder of any Hadoop file system."""

    def __init__(self, spark: SparkSession, path: str):
        self._java = spark.sparkContext._jvm
        self.path = self._java.org.apache.hadoop.fs.Path(path)
        self.system = self.path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._java.org.apache.hadoop.fs.Path(self.path, name)

    def names(self) -> dict[str, int]:
        """Names in the folder and their times of change, in milliseconds; none where there is no folder."""
        if not self.system.exists(self.path):
            return {}
        return {f.getPath().getName(): f.getModificationTime() for f in self.system.listStatus(self.path)}

    def mark(self, name: str) -> bool:
        """Make an empty file; False if it is there already."""
        try:
            return self.system.createNewFile(self._at(name))
        except Py4JJavaError:
            return False

    def delete(self, name: str = "") -> None:
        self.system.delete(self._at(name) if name else self.path, True)


def _marks(log: _Folder) -> list[tuple[int, str]]:
    """(number, version) of every marked version, in order."""
    found = (name.split("-", 1) for name in log.names() if not name.startswith(("_", ".")))
    return sorted((int(number), version) for number, version in found)


def overwrite_table(df: DataFrame, root: str, name: str) -> None:
    """Full, repeatable reload of one table, seen by readers at once or not at all.

    Of two reloads at a time the one that is marked last is current.
    """
    spark, version = df.sparkSession, f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{name}/{version}", compression=CODEC)
    log = _Folder(spark, f"{root}/{name}/log")
    log.system.mkdirs(log.path)
    while True:
        last = _marks(log)[-1:]
        number = last[0][0] + 1 if last else 1
        # The number is taken by a file of its own name, so that two reloads cannot share it.
        if log.mark(f"_{number:09d}") and log.mark(f"{number:09d}-{version}"):
            break
        if number in (n for n, _ in _marks(log)):
            continue
        log.delete(f"_{number:09d}")  # left by a reload that failed between the two
    _expire(spark, root, name, log)


def _expire(spark: SparkSession, root: str, name: str, log: _Folder) -> None:
    table, marks = _Folder(spark, f"{root}/{name}"), _marks(log)
    kept = {version for _, version in marks[-KEPT_VERSIONS:]}
    known = {version for _, version in marks}
    now = max(table.names().values())
    for version, changed in table.names().items():
        failed = version not in known and now - changed > FAILED_AFTER * 3_600_000
        if version.startswith("v-") and version not in kept and (version in known or failed):
            table.delete(version)
    for number, version in marks[:-KEPT_VERSIONS]:
        log.delete(f"{number:09d}-{version}")
        log.delete(f"_{number:09d}")


def current_path(spark: SparkSession, root: str, name: str) -> str:
    """The folder of the current version; the table's own folder where it was written without versions."""
    marks = _marks(_Folder(spark, f"{root}/{name}/log"))
    return f"{root}/{name}/{marks[-1][1]}" if marks else f"{root}/{name}"


def write_clean(df: DataFrame, root: str, name: str) -> None:
    overwrite_table(conform(df, name), root, name)


def write_mart(df: DataFrame, root: str, name: str) -> None:
    """Marts keep the columns of their query; row order carries no meaning and is not kept."""
    overwrite_table(df, root, name)


def write_policy(df: DataFrame, root: str) -> None:
    overwrite_table(df, root, POLICY_TABLE)


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(current_path(spark, root, name))


read_mart = read_table


def stage_root(spark: SparkSession) -> str:
    """A new folder for intermediate tables under the shared folder that the session names.

    What is staged stays until `remove_stages`, as results are lazy and may still read it.
    """
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not shared:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors can reach")
    root = f"{shared}/tidestock-{uuid.uuid4().hex}"
    _roots.setdefault(context.applicationId, []).append(root)
    return root


_roots: dict[str, list[str]] = {}


def remove_stages(spark: SparkSession) -> None:
    """Delete every intermediate table this application staged; results that still read them must be done."""
    for root in _roots.pop(spark.sparkContext.applicationId, []):
        _Folder(spark, root).delete()


def stage(df: DataFrame, root: str, name: str, by: str | None = None, codec: str | None = None) -> DataFrame:
    """Store an intermediate table, partitioned by a column if given, and read it back.

    Later plans start from the stored rows and know their real size, so small
    dimensions are broadcast by Spark's own threshold before any fact is shuffled.
    """
    writer = df.write.mode("overwrite")
    writer.parquet(f"{root}/{name}", partitionBy=by, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(f"{root}/{name}")


def read_mart_jdbc(spark: SparkSession, name: str, options: Mapping[str, str]) -> DataFrame:
    """Read a mart from a database.

    `options` are Spark's JDBC options (url, user, password, and for a parallel read
    partitionColumn, lowerBound, upperBound, numPartitions); none are built in.
    """
    return spark.read.format("jdbc").options(**options).option("dbtable", name).load()


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    return df.limit(n)
