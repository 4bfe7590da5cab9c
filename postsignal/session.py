"""Session helper and the shared folder for tables that cut a long lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "postsignal", **conf: str) -> SparkSession:
    """A session with the settings the library relies on; all can be overridden.

    Adaptive execution is what splits hot join keys and picks broadcast joins from measured
    sizes, so it is on, and nothing in the library forces a broadcast on its own.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # Sizes measured at run time may go higher than the ones guessed beforehand (10 MB).
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "64MB",
        "spark.sql.parquet.filterPushdown": "true",
        **{key.replace("__", "."): value for key, value in conf.items()},
    }
    builder = SparkSession.builder.appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``.

    Only a session whose driver is its one executor may go without that setting. It then gets a
    temporary folder, which is deleted when the process ends; a folder that was set is its owner's.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="postsignal-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, **options: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder, with the writer's ``options``, and read back.

    Used where a table is expensive and read several times. The files outlive any executor.
    """
    path = shared_folder(df.sparkSession)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(table: DataFrame) -> None:
    """Deletes what ``written`` returned. No frame that still reads it may be left."""
    spark = table.sparkSession
    for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
