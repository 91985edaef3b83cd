"""Stage tables: parquet written to the shared checkpoint folder to cut lineage.

Iterative operators read each table more than once and would otherwise replay
their whole history. A written table survives the loss of executors, keeps
columnar pruning and gives the next plan real sizes to choose joins by.

Tables live until :func:`drop_stages`, until the end of the :func:`stage_scope`
they were written in, or until :func:`release` where a round is known to be done.
"""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_dir: str | None = None
_written: list[str] = []


def stage_root(spark: SparkSession) -> str:
    """Folder for stage tables: ``spark.checkpoint.dir``, else a local one.

    The local folder is only for a local master, where every task sees it.
    """
    global _local_dir
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="seqbin-")
        atexit.register(shutil.rmtree, _local_dir, ignore_errors=True)
    return _local_dir


def stage_path(spark: SparkSession, name: str) -> str:
    """A new, unused path for a stage table or output."""
    path = f"{stage_root(spark)}/seqbin/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def delete_paths(spark: SparkSession, paths: list[str]) -> None:
    """Delete files or folders of any file system; what does not exist is left out."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        target = hadoop(path)
        target.getFileSystem(conf).delete(target, True)


def drop_stages(spark: SparkSession) -> None:
    """Delete all stage tables this process wrote; tables read from them end here too."""
    paths = _written[:]
    _written.clear()
    delete_paths(spark, paths)


@contextmanager
def stage_scope(spark: SparkSession) -> Iterator[None]:
    """Delete the stage tables written inside the block when it ends.

    Results must be written or collected before the end of the block.
    """
    before = set(_written)
    try:
        yield
    finally:
        new = [path for path in _written if path not in before]
        _written[:] = [path for path in _written if path in before]
        delete_paths(spark, new)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a stage table and return the scan over it."""
    path = stage_path(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._stage_path = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete stage tables from which everything needed has been written on."""
    for table in tables:
        path = getattr(table, "_stage_path", None)
        if path in _written:
            _written.remove(path)
            delete_paths(table.sparkSession, [path])


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of tables that nothing refers to any more.

    It does so when the driver collects its garbage, which a driver with little to do puts off
    while the files of all steps add up.
    """
    for _ in range(2):  # what the first one finds is still held by what is yet to be told to the JVM
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.25)


def spread(scan: DataFrame, key: str) -> DataFrame:
    """Repartition a plain file scan when it has fewer splits than there are cores.

    Large inputs have many splits and pass unchanged; a small file would
    otherwise keep all the work that follows in one task.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() >= cores:
        return scan
    return scan.repartition(2 * cores, key)
