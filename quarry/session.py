"""The session the engine expects."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark import SparkConf
from pyspark.sql import SparkSession

#: What the engine's semantics need; any other value that the cluster's configuration names stays.
DEFAULTS = {"spark.app.name": "quarry", "spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC"}


def get_spark(cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """The running session if there is one; else a new one, with settings only for keys that nobody has set.

    Started by spark-submit or with PYSPARK_SUBMIT_ARGS, master, memory and partitions are the cluster's. Started by plain
    Python, it is a local session of `cores` threads with `partitions` shuffle partitions, or has the master of SPARK_MASTER.
    """
    if running := SparkSession.getActiveSession():
        return running
    wanted = dict(DEFAULTS)
    if "PYSPARK_GATEWAY_PORT" in os.environ or os.environ.get("PYSPARK_SUBMIT_ARGS"):
        given = SparkConf()  # the JVM is there, or starts with the submit arguments
        wanted["spark.master"] = f"local[{cores}]"
        wanted = {k: v for k, v in wanted.items() if not given.contains(k)}
    else:
        master = os.environ.get("SPARK_MASTER", f"local[{cores}]")
        wanted |= {"spark.master": master}
        if master.startswith("local"):
            wanted |= {"spark.sql.shuffle.partitions": str(partitions), "spark.driver.memory": "8g", "spark.ui.enabled": "false"}
        # workers import the package from where it lies, whatever the working directory; installed, it is there anyway
        wanted["spark.executorEnv.PYTHONPATH"] = os.pathsep.join(filter(None, [str(Path(__file__).resolve().parents[1]), os.environ.get("PYTHONPATH")]))
    return SparkSession.builder.config(map=wanted).getOrCreate()
