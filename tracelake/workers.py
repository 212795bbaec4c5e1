"""What Python workers need to run functions of this package."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def reachable(spark: SparkSession) -> None:
    """Lets workers import this package from where the driver has it.

    Enough where executors share the driver's installation; elsewhere ship it with --py-files.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def scratch(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see, below spark.checkpoint.dir.

    A local session without that setting gets a temporary folder; a cluster session is refused.
    """
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="tracelake-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        shared = f"file://{own}"
    return f"{shared.rstrip('/')}/tracelake-scratch/{uuid.uuid4().hex}"
