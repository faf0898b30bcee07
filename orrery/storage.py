"""Tables in the folder that driver and executors share (``spark.checkpoint.dir``)."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SCRATCH: list[tuple[SparkSession, str]] = []
_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a local one is made only where none is set (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    if spark.sparkContext.master.startswith("local-cluster") or not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN:
        _OWN.append(f"file://{tempfile.mkdtemp(prefix='orrery-')}")
    return _OWN[0]


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/orrery/{name}-{uuid.uuid4().hex}"
    _SCRATCH.append((spark, path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there, and a
    lost executor costs at most the tasks it was running."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def drop(df: DataFrame | None) -> None:
    """Delete a scratch table that no later plan reads."""
    path = getattr(df, "_scratch_path", None)
    if path:
        delete_path(df.sparkSession, path)


def mark() -> int:
    """Where the scratch tables stand, for ``settle``."""
    return len(_SCRATCH)


def settle(df: DataFrame, since: int, name: str) -> DataFrame:
    """Write ``df``, then delete the scratch tables made since ``since`` that led to it."""
    stale = _SCRATCH[since:]
    out = materialize(df, name)
    for spark, path in stale:
        delete_path(spark, path)
    del _SCRATCH[since:-1]
    return out


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _SCRATCH:
        try:
            delete_path(spark, path)
        except Exception:  # the session may be gone by now
            return
