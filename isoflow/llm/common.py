"""Helpers shared by the training-data operators.

Intermediate results that cut lineage are Parquet tables under the folder the cluster names in
``spark.checkpoint.dir`` (shared by driver and executors), so a lost executor costs a re-run of
its tasks and nothing else.  Only where that setting is missing and Spark runs on one machine, as in
tests, a temporary folder is used; on a cluster it is an error.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIRS: dict[str, str] = {}
_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared scratch folder of this application."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        base = _OWN_DIRS.setdefault(app, "") or tempfile.mkdtemp(prefix="isoflow-")
        _OWN_DIRS[app] = base
    return base.rstrip("/")


ARROW_ROWS = 1000
"""Rows of a batch that Spark hands to Python: whole texts are long, and a batch is held several times over."""


def prepare(spark: SparkSession) -> None:
    """Session settings the operators count on: small batches for Python, and shuffle files deleted
    when a query ends instead of at some garbage collection on the driver, since an operator runs
    several queries one after another."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return a DataFrame that reads it."""
    spark = df.sparkSession
    prepare(spark)
    path = f"{shared_dir(spark)}/isoflow-{uuid.uuid4().hex}/{name}"
    _MADE.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard(df: DataFrame) -> None:
    """Delete the files behind a DataFrame made by :func:`materialize` once nothing reads it."""
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/isoflow-" in parent:
            _delete(df.sparkSession, parent)


def made() -> int:
    """How many tables :func:`materialize` has made so far in this process."""
    return len(_MADE)


def discard_between(spark: SparkSession, begin: int, end: int) -> None:
    """Delete the tables that were made from the ``begin``-th to before the ``end``-th, as far as they are still there."""
    for path in _MADE[begin:end]:
        _delete(spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test data by Spark's own reader."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without_ids(docs: DataFrame, dropped: DataFrame, doc_id: str = "doc_id", broadcast_rows: int = 250_000) -> DataFrame:
    """``docs`` without the rows whose id is in column ``doc_id`` of ``dropped``; rows with a null id stay.

    A short list is broadcast; a longer one is joined by a shuffle.
    """
    gone = materialize(dropped.select(dropped["doc_id"].alias("_gone")).distinct(), "dropped")
    gone = F.broadcast(gone) if gone.count() <= broadcast_rows else gone
    return docs.join(gone, docs[doc_id] == gone["_gone"], "left_anti")
