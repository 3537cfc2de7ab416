"""Where intermediate tables go: the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.

    Only where the session names none and runs in one process (tests) is a local folder taken.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='tabloom-')}")
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _delete_made() -> None:
    for spark, path in _made:
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001  the session is gone, and its folder with it; others may be alive
            continue


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder's path within the shared one; it is deleted with the intermediate tables."""
    if not _made:
        atexit.register(_delete_made)
    path = f"{shared_dir(spark)}/tabloom-{label}-{uuid.uuid4().hex[:12]}"
    _made.append((spark, path))
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: its lineage ends there.

    Lost executors then cost a re-read, never a recomputation of what came before.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    _paths[id(found)] = weakref.ref(found), path
    return found


_paths: dict[int, tuple[weakref.ref[DataFrame], str]] = {}


def forget(spark: SparkSession) -> None:
    """Collect plans that nothing refers to, on both sides: Spark then deletes the files of their shuffles.

    A long chain of steps would otherwise keep the files of all of them.
    """
    gc.collect()
    spark._jvm.System.gc()


def release(df: DataFrame) -> None:
    """Delete a materialised table that nothing reads any more, as its readers are materialised themselves."""
    owner, path = _paths.pop(id(df), (None, ""))
    if owner is not None and owner() is df:
        delete(df.sparkSession, path)
        _made.remove((df.sparkSession, path))
    forget(df.sparkSession)
