"""Session set-up for local runs and tests; a cluster brings its own session."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Selected ticket headers filter the ticket lines before their shuffle. By default the filter is built from
#: sides below 10 MB only and holds a million keys; these are sizes for headers of a few years. At most
#: max_num_bits / 8 = 64 MB go to each executor, however many keys there are.
RUNTIME_FILTER = {
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "10g",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "1g",
    "spark.sql.optimizer.runtime.bloomFilter.maxNumItems": "64000000",
    "spark.sql.optimizer.runtime.bloomFilter.maxNumBits": "536870912",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **extra) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("harborline")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in (RUNTIME_FILTER | extra).items():
        builder = builder.config(key, str(value))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which driver and executors share.

    Where the session names none, a temporary one serves as long as all tasks run in this process; on a
    cluster that would put every executor's files on its own disk, so there it is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a folder under the shared one that nothing else uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder once and reads on from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
