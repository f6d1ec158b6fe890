"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; in local mode without one, a temporary folder.

    A cluster that names no shared folder is an error: a machine-local folder would be
    invisible to the other executors and lost with its machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="volclock-")
    return _OWN[app]


#: Whether shuffle files go as soon as a query of the session has ended, not when the driver's
#: garbage collection comes upon it.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _written(df: DataFrame, name: str, tidy: bool = False) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/volclock-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    if tidy:
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if tidy:
            spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    This cuts the lineage: losing an executor later costs a read, not the whole history.
    """
    return _written(df, name)[0]


class Temporary:
    """Stored tables that are removed at the end of a ``with`` block, or earlier by ``drop``.

    Whatever a result still has to read must be stored outside of the block's tables. With
    ``tidy``, what was shuffled to make a table is removed once the table is written.
    """

    def __init__(self, spark: SparkSession, tidy: bool = False):
        self._spark, self._tidy = spark, tidy
        self._held: list[tuple[DataFrame, str]] = []

    def __enter__(self) -> Temporary:
        return self

    def __exit__(self, *_) -> None:
        self.drop(*[df for df, _ in self._held])

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        self._held.append(_written(df, name, self._tidy))
        return self._held[-1][0]

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables that nothing reads any more."""
        gone = [path for df, path in self._held if any(df is t for t in tables)]
        self._held = [(df, path) for df, path in self._held if path not in gone]
        context = self._spark.sparkContext
        for path in gone:
            at = context._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
