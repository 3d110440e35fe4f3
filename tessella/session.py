"""Session, table access and lineage cuts shared by every operator."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "tessella", cpus: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings tests and benchmarks use."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables, read lazily; column pruning and filters reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Where it is unset, a local session uses a folder of its own; a cluster is refused, since its executors could not read what others wrote."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = os.path.join(tempfile.gettempdir(), f"tessella-{os.getuid()}")
    return base.rstrip("/")


def _remove(jvm: object, conf: object, path: str, owner: int) -> None:
    if os.getpid() == owner:
        with contextlib.suppress(Exception):  # the JVM may have gone before
            at = jvm.org.apache.hadoop.fs.Path(path)  # type: ignore[attr-defined]
            at.getFileSystem(conf).delete(at, True)


_staged: set[str] = set()


def stage_dir(spark: SparkSession) -> str:
    """The folder of this application's staged tables; it goes when the driver's process ends."""
    sc = spark.sparkContext
    path = f"{shared_dir(spark)}/{sc.applicationId}"
    if path not in _staged:
        _staged.add(path)
        atexit.register(_remove, sc._jvm, sc._jsc.hadoopConfiguration(), path, os.getpid())  # noqa: SLF001
    return path


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Cut lineage: write df as a table in the shared folder and read it back.

    The files survive the loss of executors, and later reads prune columns.
    """
    spark = df.sparkSession
    path = f"{stage_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessella_path = path  # type: ignore[attr-defined]
    return out


def unstage(df: DataFrame) -> None:
    """Remove the table of a staged df that nothing will read again."""
    path = getattr(df, "_tessella_path", None)
    if path:
        sc = df.sparkSession.sparkContext
        _remove(sc._jvm, sc._jsc.hadoopConfiguration(), path, os.getpid())  # noqa: SLF001
