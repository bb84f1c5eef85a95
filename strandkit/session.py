"""Session helpers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one spark.checkpoint.dir names. Only on a local master, as in tests, one of our own
    is set where none is named; elsewhere that is an error, for each machine would write to its own disk."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        if not named:
            named = os.path.join(tempfile.gettempdir(), f"checkpoints-{uuid.uuid4().hex}")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def drop_path(spark: SparkSession, path: str) -> None:
    """Removes a folder on any file system that Spark knows."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def ship_package(spark: SparkSession) -> None:
    """Sends this package's Python files to the executors once a SparkContext, as --py-files would, so workers can import it anywhere."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp()  # the driver alone reads it; its file server hands it to the executors while the session lives
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    stage = Path(folder, "stage")
    shutil.copytree(root, stage / root.name, ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(os.path.join(folder, root.name), "zip", stage))
    _SHIPPED.add(sc.applicationId)
