"""Shared plumbing of the training-data operators.

Every operator projects its input to the columns it needs first, so extra
columns (also ones that share a name with a result column) never reach it.
"""

from __future__ import annotations

import gc
import os
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def importable(spark: SparkSession) -> None:
    """Let Python workers import this library even where only the driver has it on its path."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset a temporary one is made, in local mode alone."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="hushlake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class _Scratch(threading.local):
    """The open scratch blocks of a thread, each with what undoes the tables it holds."""

    def __init__(self) -> None:
        self.blocks: list[list[Callable[[], object]]] = []


_OPEN = _Scratch()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables stored within are removed at the end, and the shuffles that nothing refers to any more."""
    block: list[Callable[[], object]] = []
    _OPEN.blocks.append(block)
    try:
        yield
    finally:
        _OPEN.blocks[:] = [b for b in _OPEN.blocks if b is not block]
        for undo in block:
            undo()
        gc.collect()
        spark.sparkContext._jvm.java.lang.System.gc()
        trimmed(spark)


def trimmed(spark: SparkSession) -> str:
    """Give memory that the driver's JVM has freed outside its heap (by compilers, for the most part) back to the system; what the JVM says of it, empty where it can't."""
    jvm = spark.sparkContext._jvm
    of = jvm.java.lang.Class.forName
    array = lambda kind, *have: _array(spark, kind, have)
    try:
        # By the interface: the server's own class is in a package that is not open.
        kinds = [of(c) for c in ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")]
        invoke = of("javax.management.MBeanServer").getMethod("invoke", array(jvm.java.lang.Class, *kinds))
        command = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        return invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), array(jvm.java.lang.Object, command, "systemTrimNativeHeap", None, None)) or ""
    except Py4JJavaError:  # another system or an older JVM
        return ""


def _array(spark: SparkSession, kind: object, have: tuple) -> object:
    out = spark.sparkContext._gateway.new_array(kind, len(have))
    for k, x in enumerate(have):
        out[k] = x
    return out


def on_release(spark: SparkSession, path: str, undo: Callable[[], object] | None = None, result: bool = False) -> None:
    """Remove ``path`` (and call ``undo``) when the scratch block ends, for a ``result`` the one around it; without one, when the application ends."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    level = 2 if result else 1
    if len(_OPEN.blocks) >= level:
        block = _OPEN.blocks[-level]
        if undo:
            block.append(undo)
        block.append(lambda: files.delete(at, True))
    files.deleteOnExit(at)


def _folders(spark: SparkSession, path: str) -> None:
    """Make the folders of a write ahead, in a local file system.

    Without its native library Hadoop starts a process to set the mode of each
    folder and file it makes, and until that runs its program it has all the memory
    of the driver over again. For that reason a table has no marker of success either.
    """
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/_temporary/0")
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri().getScheme() == "file":
        jvm.java.io.File(at.toUri().getPath()).mkdirs()


def stored(df: DataFrame, result: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and a lost executor costs no recompute.

    A ``result`` outlives the scratch block it is made in.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/hushlake-{uuid.uuid4().hex}"
    _folders(spark, path)
    df.write.mode("append").option("compression", "zstd").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    trimmed(spark)
    on_release(spark, path, result=result)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """A-Z only; ``lower`` would also fold other scripts."""
    return F.translate(text, UPPER, LOWER)


def shuffle_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
