"""Tables that are written once and read several times, in the folder of ``spark.checkpoint.dir``.

A plan that uses an intermediate result more than once would work it out again for each use, and a
lost executor would go back to the sources.  On a cluster the folder must be one that driver and
executors share; only on one machine a temporary folder stands in.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_MADE: list[str] = []


def folder(spark: SparkSession) -> str:
    """Where this application's intermediate tables go."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="isoflow-")
    return _OWN[app]


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` as a table: evaluated now, once, and read from there on.  ``options`` are those of Spark's writer."""
    path = f"{folder(df.sparkSession)}/isoflow-{uuid.uuid4().hex}/{name}"
    _MADE.append(path)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that are written inside the block when it ends.

    Results that read them must have been used or saved by then; without such a block they stay until the
    folder is cleared.
    """
    before = len(_MADE)
    try:
        yield
    finally:
        for path in _MADE[before:]:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where.getParent(), True)
        del _MADE[before:]
