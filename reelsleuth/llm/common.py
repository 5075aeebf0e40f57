"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import posixpath
import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode, where it may be unset, a temporary one."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir is unset: a cluster needs a folder that driver and executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="reelsleuth-"))
    return _LOCAL[0]


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialises `df` in the shared folder and forgets its lineage; lost executors cost nothing that was cut.

    The shuffle files behind it are removed at once, and not when the driver happens to collect its garbage. Should `df` itself run
    again, Spark makes them anew.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    found = df.checkpoint(eager=True)
    plan = df._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":  # others' files go with the garbage
        for shuffle in list(plan.context().shuffleIds().keySet().toArray()):
            context._jsc.sc().shuffleDriverComponents().removeShuffle(int(shuffle), True)
    return found


def release(spark: SparkSession) -> None:
    """Lets the driver forget what was cut: shuffle files that no live DataFrame needs are removed once it collects its garbage."""
    for _ in range(2):  # Python lets go of the JVM's objects a little later
        gc.collect()
        time.sleep(0.3)
        spark.sparkContext._jvm.System.gc()


def trim() -> None:
    """Gives memory that a worker has freed back to the system: idle workers and the next operator's share an executor."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):  # glibc alone
        libc.malloc_trim(0)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` evaluated once a row.

    Catalyst may otherwise copy a costly expression into each call of a lambda that mentions it.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def put(folder: str, name: str, data: bytes) -> str:
    """Writes a file of the shared folder whole or not at all: a task that runs again, or twice, leaves one whole file."""
    from pyarrow import fs

    uri = folder if "://" in folder else f"file://{folder}"
    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(path, recursive=True)
    draft = posixpath.join(path, f"_{name}.{uuid.uuid4().hex}")
    with system.open_output_stream(draft) as out:
        out.write(data)
    system.move(draft, posixpath.join(path, name))
    return name


def fetch(uri: str) -> bytes:
    """A file whole; `file:/x` is how Hadoop names a local file."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri("file:///" + uri[6:].lstrip("/") if uri.startswith("file:/") else uri if "://" in uri else f"file://{uri}")
    with system.open_input_stream(path) as got:
        return got.read()
