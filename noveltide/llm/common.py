"""Small helpers that several corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000
_own_dirs: dict[str, str] = {}
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Where that is unset and driver and executors are one process (tests), a temporary folder of the application is made;
    on a cluster it must be set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _own_dirs.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="noveltide-")
        _own_dirs[spark.sparkContext.applicationId] = found
    return found


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends here and survives lost executors.

    The shuffle files of the work behind it are dropped once the table is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before else spark.conf.unset(CLEANUP)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Empty tables made by ``cut`` that are not read any more (others are left alone)."""
    for df in tables:
        if path := _paths.pop(df, None):
            df.sparkSession.range(0).write.mode("overwrite").parquet(path)


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after a limit on the session's Arrow batches: of whole texts, JVM and Python hold a few MB at once.

    (The limit is the session's, as it is read when a query runs; a smaller one is left alone.)
    """
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(BATCH)) <= BATCH_ROWS:
        conf.set(BATCH, str(BATCH_ROWS))
    return df
