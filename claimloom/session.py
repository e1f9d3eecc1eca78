"""Session defaults and the shared scratch location."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def local_session(cores: str = "8", partitions: int = 8, app: str = "claimloom") -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def reach(spark: SparkSession) -> None:
    """Let the Python workers import this package from the folder that the driver uses.

    Enough where workers see the driver's folders; on other clusters ship the package
    with ``addPyFile`` or install it.
    """
    root = str(Path(__file__).resolve().parents[1])
    known = spark.sparkContext.environment
    paths = [p for p in known.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        known["PYTHONPATH"] = os.pathsep.join([root, *paths])


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for tables written between stages.

    On a cluster it lies under the shared folder named by
    ``spark.checkpoint.dir``.  A machine-local folder is used only in local
    mode, where driver and executors are one process.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/claimloom/{name}-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(
            "set spark.checkpoint.dir to a folder all executors can reach; "
            "claimloom writes intermediate tables there"
        )
    return f"{tempfile.mkdtemp(prefix='claimloom-')}/{name}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Used where several passes follow over something costly to derive; a lost
    executor then costs a re-read, not the derivation.
    """
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    _FOLDERS[made] = path
    return made


#: Folders of the tables that ``stage`` gave out, for ``unstage``.
_FOLDERS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def unstage(*staged: DataFrame) -> None:
    """Delete the folders of staged tables; what still has to be computed must not read them."""
    for table in staged:
        path = _FOLDERS.pop(table, None)
        if path is not None:
            spark = table.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
