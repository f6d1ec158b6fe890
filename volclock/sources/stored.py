"""Tables written in the folder that all executors share, which cuts what they were made from."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame

_OWN: dict[str, str] = {}


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df``, written as Parquet under ``spark.checkpoint.dir`` and read again. Local mode without
    that setting uses a temporary folder; a cluster without it is an error."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = _OWN.setdefault(spark.sparkContext.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="volclock-")
        _OWN[spark.sparkContext.applicationId] = folder
    path = f"{folder.rstrip('/')}/volclock-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
