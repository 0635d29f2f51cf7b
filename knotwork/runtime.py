"""Session helpers shared by every operator: code shipping, lineage cuts, shared scratch space."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from knotwork.sources.files import Folder


def ship_package(spark: SparkSession) -> None:
    """Make this package importable by Python workers, once per Spark context.

    Executors need not have the repository on their path: a zip of the sources is served by the driver.
    """
    sc = spark.sparkContext
    if getattr(sc, "_knotwork_shipped", False):
        return
    root = Path(__file__).resolve().parent
    fd, name = tempfile.mkstemp(prefix="knotwork-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(Path(root.name) / p.relative_to(root)))
    sc.addPyFile(name)
    sc._knotwork_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only in a session on one machine without the setting, as in tests, a temporary folder takes its place; on a cluster that
    folder would be another one on every machine, so there the setting is required.
    """
    sc = spark.sparkContext
    if not getattr(sc, "_knotwork_shared", None):
        given = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
        if not given and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc._knotwork_shared = given or f"file://{tempfile.mkdtemp(prefix='knotwork-shared-')}"
    return sc._knotwork_shared


def scratch_path(spark: SparkSession, what: str) -> str:
    """A fresh path below the shared folder for a table that cuts lineage."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Evaluate ``df`` once and cut its lineage with a reliable checkpoint.

    The files live in the shared folder, so they outlast executors. Spark's context cleaner removes them when nothing
    refers to them any longer, if the session was started with ``spark.cleaner.referenceTracking.cleanCheckpoints``, as the command
    line does; otherwise they stay until the folder is emptied.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


#: Rows of one partition where their number is known.
PARTITION_ROWS = 500_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` of about so many rows, dealt by ``keys`` to partitions of bounded size.

    Adaptive execution joins partitions by their bytes; few bytes of compressed keys may be millions of rows in the memory of an
    aggregation. It leaves a given number of partitions alone, and an aggregation by these keys needs no other shuffle.
    """
    return df.repartition(max(1, -(-rows // PARTITION_ROWS)), *keys)


@contextmanager
def tables(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A function that evaluates a step of a loop into a Parquet table of the shared folder and reads it back.

    A checkpoint keeps the estimated size of the plan before it, and a join's estimate is the product of its sides, so in a loop of
    joins over checkpoints estimates double their digits in every round, until planning takes longer than the work. A table
    has the size of its files, by which small sides are broadcast. The tables are deleted when the block ends, so what
    leaves it has to be cut before.
    """
    paths: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        paths.append(path := scratch_path(spark, "step"))
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield keep
    finally:
        for path in paths:
            Folder(spark, path).delete()


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps that are evaluated and out of reach.

    Spark removes them when the JVM collects what refers to them, by itself only every half hour; long chains of large
    shuffles ask for it between their steps. The driver also gives back memory that it has freed outside the JVM's heap: the
    C library keeps an arena for each few of the driver's hundreds of threads, and what a step has freed there stays resident.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    give_back()
    _trim_driver(spark)


def _trim_driver(spark: SparkSession) -> None:
    """Run the JDK's diagnostic command ``System.trim_native_heap`` in the driver's JVM, where there is one."""
    sc = spark.sparkContext
    jvm, array = sc._jvm, sc._gateway.new_array
    if not getattr(sc, "_knotwork_trims", True):
        return
    try:
        kinds, given = array(jvm.Class, 4), array(jvm.Object, 4)
        for i, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[i] = jvm.Class.forName(name)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        # by the interface, as the class of the server is not open to callers
        call = jvm.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds)
        call.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JJavaError:  # before Java 17.0.9, or not on Linux
        sc._knotwork_trims = False


#: What workers keep between tasks, by the module that keeps it, and how it is dropped.
KEPT: dict[str, Callable[[], None]] = {}


def trimmed(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task for ``mapInArrow`` that gives freed memory back when it ends.

    Workers stay for later tasks and stages, and their allocators would keep what a large task once needed. A task also
    drops what other modules keep between tasks.
    """
    owner = task.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for module, drop in KEPT.items():
            if module != owner:
                drop()
        try:
            yield from task(batches)
        finally:
            give_back()

    return run


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
