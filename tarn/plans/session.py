"""Session defaults and table access."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Adaptive execution does the sizing; nothing here depends on the data's size.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
}


def local_session(cores: str = "8", shuffle_partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A session for tests and the bench on one machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("tarn").config("spark.driver.memory", memory).config("spark.ui.enabled", "false")
    for key, value in {**DEFAULTS, "spark.sql.shuffle.partitions": str(shuffle_partitions), **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The table `name` under a data directory; a file or a folder of files."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session. One is set only where the session names none, and only on one
    machine: on a cluster a folder of the driver's machine isn't the executors'.

    What this session leaves there goes when the driver ends.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors reach")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), f"tarn-checkpoints-{os.getuid()}"))
    known = sc.getCheckpointDir()
    if sc.applicationId not in _swept:
        _swept.add(sc.applicationId)
        delete_at_end(spark, known)  # Spark makes a folder of its own for each session
    return known


_swept: set[str] = set()


def delete_at_end(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)


def cut(df: DataFrame) -> DataFrame:
    """`df` with its lineage cut by a reliable checkpoint in the shared folder.

    The files live on storage all executors reach, so a lost executor costs nothing but a read.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a session: they import functions by name, and
    a cluster's nodes needn't have it installed. Spark's file server hands it out."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="tarn-")) / f"{package.name}-{sc.applicationId}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)


def shipped(df: DataFrame) -> DataFrame:
    """`df`, ready for a function of this package to run over it in Python workers."""
    ship(df.sparkSession)
    return df


def spread(df: DataFrame) -> DataFrame:
    """shipped(df) in as many partitions as there are cores at least, for stages that work hard on
    each row.

    A table of few files would otherwise keep most cores idle; a large one is left as it is.
    """
    ship(df.sparkSession)
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def stored(df: DataFrame) -> DataFrame:
    """`df` read back from parquet files in the shared folder: lineage is cut, and columns are
    compressed and pruned, which a checkpoint's aren't. The files go when the driver ends."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tarn-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
