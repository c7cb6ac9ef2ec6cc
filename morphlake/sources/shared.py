"""The folder that all executors share, for tables and files that a query writes and reads again."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import SparkSession

_roots: dict[str, str] = {}


def folder(spark: SparkSession, what: str) -> str:
    """A new name under ``spark.checkpoint.dir``; a local temporary folder only under a local master without that setting."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not spark.sparkContext.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="morphlake-")
        _roots[app] = f"{base.rstrip('/')}/morphlake-queries-{app}"
        atexit.register(_remove, spark, _roots[app])
    return f"{_roots[app]}/{what}-{uuid.uuid4().hex[:12]}"


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is gone: the folder stays for the cluster's own clean-up
        pass


def write_lines(spark: SparkSession, path: str, lines: Iterable[str]) -> str:
    """A small text file (its folder's only one), for definitions that are given inline."""
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    return path


#: Bytes of an Arrow batch sent to a worker, which makes several times as much of it.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session in bytes, not in rows alone."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(key).rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
