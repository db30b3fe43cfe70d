"""Python workers and this package."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession


def reach(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it, also when PYTHONPATH doesn't say so."""
    root, known = str(Path(__file__).parents[1]), spark.sparkContext.environment
    if root not in known.get("PYTHONPATH", "").split(os.pathsep):
        known["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known.get("PYTHONPATH", "")]))


def work_root(spark: SparkSession) -> str:
    """This application's folder below the shared one that the cluster names. Where none is named, below a temporary folder
    of this machine, but only if all of Spark runs on it: executors elsewhere would each write to a disk of their own."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("quire.work.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master.partition("[")[0] != "local":
            raise ValueError(f"spark.checkpoint.dir must name a folder that driver and executors share; the master is {master}")
        root = "file://" + tempfile.mkdtemp(prefix="quire-")
        spark.conf.set("quire.work.dir", root)
    return f"{root.rstrip('/')}/quire-{spark.sparkContext.applicationId}"


def shared_dir(spark: SparkSession) -> str:
    """A new path in work_root()."""
    return f"{work_root(spark)}/{uuid.uuid4().hex}"


def clean(spark: SparkSession) -> None:
    """Deletes all intermediate tables of this application. Call it once no DataFrame made from them is in use."""
    path = spark._jvm.org.apache.hadoop.fs.Path(work_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
