"""Session helpers: settings for large runs, reliable checkpoints."""

from __future__ import annotations

import pickle
import re
import tempfile
import uuid
from typing import Any

from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, app: str = "evalweave", **conf: str) -> SparkSession:
    """A session for tests and benches on one machine."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    base = {
        "spark.sql.shuffle.partitions": str(cores),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir.

    Where no folder is named, a temporary one is set on a local master; on a
    cluster, where executors do not share their disks, that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="evalweave-ckpt-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """The frame, written to the shared folder of spark.checkpoint.dir; survives the loss of executors."""
    _shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The frame, written as compressed Parquet to the shared folder, for texts: a checkpoint holds them as they are.

    It is deleted when the application ends.
    """
    spark = df.sparkSession
    path = f"{_shared_folder(spark)}/written-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def share(spark: SparkSession, obj: object) -> Broadcast:
    """Broadcast an object of the package; its class travels with it.  Read it with ``received``."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(obj))


def received(b: Broadcast) -> Any:
    return pickle.loads(b.value)
