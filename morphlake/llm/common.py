"""Helpers that the operators of this folder share: lineage cuts, checked broadcasts, table reads."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if its measured rows times its width stay below this.
BROADCAST_BYTES = 48 << 20

#: Bytes of an Arrow batch sent to a worker, which holds several times as much while it works on it.
BATCH_BYTES = 4 << 20

_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """Folder for this application's intermediate tables, under the session's shared checkpoint folder.

    ``spark.checkpoint.dir`` is read from the session. Only where it is unset (tests, a laptop)
    is a local temporary folder used.
    """
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not spark.sparkContext.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="morphlake-")
        _roots[app] = f"{base.rstrip('/')}/morphlake-{app}"
        atexit.register(_remove, spark, _roots[app])
    return _roots[app]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is gone: the folder stays for the cluster's own clean-up
        pass


def drop_tables(spark: SparkSession, *paths: str) -> None:
    """Remove intermediate tables that no later plan reads."""
    for path in paths:
        _remove(spark, path)


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_root(spark)}/{what}-{uuid.uuid4().hex[:12]}"


def cut_at(df: DataFrame, what: str = "cut") -> tuple[DataFrame, str]:
    """Write a table to the shared folder and read it back: ends the lineage, survives lost executors. Also its path,
    for ``drop_tables`` once nothing reads it any more."""
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame, what: str = "cut") -> DataFrame:
    return cut_at(df, what)[0]


@contextmanager
def spent_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within, the shuffle files of a query are removed when it ends, not when the driver happens to collect its garbage.

    For queries whose results are written or collected; a plan that is run a second time shuffles again.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Hint a broadcast if the measured size allows it; else leave the choice to the planner (shuffle join)."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Project an input to the operator's own column names, so that extra or clashing columns can't matter."""
    return df.select(*[df[source].alias(name) for name, source in columns.items()])


def shielded(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The table with plain column names c0, c1, ..., and the new name of each old one: none can clash then."""
    new = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*new.values()), new


def arrow(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with batches of a bounded size in bytes, after which the worker gives back what it doesn't need."""
    key, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(key).rstrip("b")) <= BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))

    def run(batches):
        yield from function(batches)
        import pyarrow as pa

        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:  # not every C library has it
            pass

    return df.mapInArrow(run, schema)


def parallel(df: DataFrame) -> int:
    """Shuffle partitions configured for this session."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def components(links: DataFrame) -> DataFrame:
    """(doc_id, label): the lowest id of each document's connected group, by propagation and pointer jumping."""
    a, b = F.col("doc_id").alias("doc_id"), F.col("keeper_id").alias("nbr")
    edges, edges_path = cut_at(links.select(a, b).union(links.select(F.col("keeper_id"), F.col("doc_id"))), "groups-edges")
    labels, old = cut_at(edges.groupBy("doc_id").agg(F.least("doc_id", F.min("nbr")).alias("label")), "groups-labels")
    while True:
        of = labels.select(F.col("doc_id").alias("o"), F.col("label").alias("of"))
        seen = edges.join(of, F.col("nbr") == F.col("o")).groupBy("doc_id").agg(F.min("of").alias("seen"))
        least = labels.join(seen, "doc_id").select("doc_id", F.col("label").alias("old"), F.least("label", "seen").alias("l"))
        jumped = least.join(of, F.col("l") == F.col("o")).select("doc_id", F.least("l", "of").alias("label"), (F.least("l", "of") < F.col("old")).alias("moved"))
        now, path = cut_at(jumped, "groups-labels")
        drop_tables(links.sparkSession, old)
        if now.filter("moved").isEmpty():
            drop_tables(links.sparkSession, edges_path)
            return now.drop("moved")
        labels, old = now.drop("moved"), path
