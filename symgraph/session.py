"""Session defaults and the shared staging folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "symgraph") -> SparkSession:
    """A local session for tests and benches; a cluster passes its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_OWN: dict[str, str] = {}


def staging_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local session that names none gets one of its own, a cluster must name one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = _OWN.setdefault("dir", "") or tempfile.mkdtemp(prefix="symgraph-")
        _OWN["dir"] = root
    return root.rstrip("/")


def drop_staged(spark: SparkSession, path: str) -> None:
    """Delete a staged table by the file system that holds it."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _drop_at_exit(spark: SparkSession, path: str) -> None:
    try:
        drop_staged(spark, path)
    except Exception:  # the session may be gone already; the folder is the cluster's to clear
        return


def staged_with_path(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write a table to the shared staging folder and read it again: lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{staging_root(spark)}/staged/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_drop_at_exit, spark, path)
    return spark.read.schema(df.schema).parquet(path), path


def staged(df: DataFrame, name: str) -> DataFrame:
    return staged_with_path(df, name)[0]
