"""Where a job keeps what it must not lose: tables in the cluster's shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``).

    Only a local session without that setting, as in tests, gets a folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    if found.startswith("/"):
        found = f"file://{found}"
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, codec: str | None = None) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet in the shared folder and read it back: the lineage ends there. ``codec`` is for large ones."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path), path


def free_names(columns: list[str], *names: str) -> list[str]:
    """``names`` with as many underscores as it takes to differ from all ``columns``, in any case of letters."""
    taken = {c.lower() for c in columns}
    return [next(n + "_" * i for i in range(len(taken) + 1) if (n + "_" * i).lower() not in taken) for n in names]


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def swap_path(spark: SparkSession, new: str, path: str) -> None:
    """``new`` takes the place of ``path`` by renames on their file system; what was there is kept until it has."""
    jvm = spark.sparkContext._jvm
    to, fresh, before = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, new, f"{path}.before"))
    fs = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(to):
        fs.delete(before, True)
        if not fs.rename(to, before):
            raise OSError(f"cannot set {path} aside")
    if not fs.rename(fresh, to):
        raise OSError(f"cannot put {new} in place of {path}; the former table is {path}.before")
    fs.delete(before, True)


def recover_path(spark: SparkSession, path: str) -> None:
    """Ends a swap that was cut off between its two renames: the former table comes back."""
    jvm = spark.sparkContext._jvm
    to, before = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.before"))
    fs = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(to) and fs.exists(before) and not fs.rename(before, to):
        raise OSError(f"cannot bring {path}.before back")


def local_session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidemark")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("TIDEMARK_DRIVER_MEMORY", "8g"))
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
