"""Session helpers shared by every subpackage."""

from __future__ import annotations

import atexit
import gc
import logging
import os
import re
import shutil
import tempfile
import zipfile
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")
_SHIPPED: set[str] = set()
_ARROW = "spark.sql.execution.arrow.maxBytesPerBatch"
_CLEAN = "spark.cleaner.referenceTracking.cleanCheckpoints"
_log = logging.getLogger(__name__)
ARROW_BYTES = 8 << 20


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("corpusloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config(_CLEAN, "true")
        .config("spark.driver.memory", os.environ.get("CORPUSLOOM_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def prepare(spark: SparkSession) -> None:
    """Make a session ready for this package's functions in Python workers.

    Arrow batches are bounded by bytes (``ARROW_BYTES``, unless the session has less), as rows of long texts are
    large. The package's source is sent to the executors, once per application: workers import the modules of the
    functions they are sent, even where nobody has installed them.
    """
    bound = spark.conf.get(_ARROW).rstrip("bB")
    if not bound.isdigit() or int(bound) > ARROW_BYTES:
        spark.conf.set(_ARROW, str(ARROW_BYTES))
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="corpusloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder) / "corpusloom.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(app)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """``df`` dealt over tasks by a hash of columns that tell its rows apart, for steps that cost much for each row.

    A small file is read by one task, and adaptive execution joins partitions of few bytes, however long their rows take;
    a number of partitions that is asked for is kept.
    """
    n = max(shuffle_partitions(df.sparkSession), 2 * df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(n, *by)


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir.

    In local mode a temporary one is made where it names none, and deleted when Python ends; elsewhere that is an error, as executors
    would not share it. Checkpoints under a folder that is set here go when the application ends; before that Spark deletes those
    that nothing refers to, if the session has spark.cleaner.referenceTracking.cleanCheckpoints.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not named:
            if not re.match(r"local(\[|$)", sc.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            named = tempfile.mkdtemp(prefix="corpusloom-checkpoint-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
        delete_at_exit(spark, sc._jsc.sc().getCheckpointDir().get())
        if sc.getConf().get(_CLEAN, "false") != "true":
            _log.warning("%s isn't set: checkpoints stay until the application ends", _CLEAN)
    return sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().get()


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of any store."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def delete_at_exit(spark: SparkSession, folder: str) -> None:
    """Have a folder of any store deleted when the application ends, whether it exists by now or not."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)  # what doesn't exist can't be marked
    fs.deleteOnExit(path)


def durable(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder: a lost executor costs no recomputation of what came before."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def at_once(spark: SparkSession, *steps: Callable[[], T]) -> list[T]:
    """What some steps give, run from threads of their own: small jobs of a change needn't wait for one another."""
    with ThreadPoolExecutor(max(1, len(steps))) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(step)) for step in steps]]


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files that no DataFrame refers to any more.

    Its cleaner waits for the driver to collect garbage, by default half an hour; a step that has just
    kept its result with ``durable`` needs none of the files behind it.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
