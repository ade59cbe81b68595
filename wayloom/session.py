"""Session helpers shared by all jobs."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "wayloom") -> SparkSession:
    """A single-machine session for tests and benches; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def find_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, whatever their folder is.

    Clusters whose executors don't see that path get the package by ``--py-files``.
    """
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH")) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only where everything runs on one machine, as in tests, one is made if the session names none.
    """
    find_package(spark)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage: write ``df`` to the shared checkpoint folder and read it from there.

    A checkpoint keeps its plan's estimate of sizes, which multiplies with every join; many rounds need ``written``.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def arrow_batches(spark: SparkSession, mb: int = 4) -> None:
    """Bound each Arrow batch by bytes, so that long texts don't pile up in a Python worker.

    It is a setting of the session, which stays; results don't depend on it.
    """
    find_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))


_written: dict[str, list[str]] = {}


def written(df: DataFrame, name: str = "table", keep: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """Cut lineage by a Parquet table in the shared folder; compressed, unlike a checkpoint.

    ``by`` names columns whose values are folders, so that readers skip those that they don't ask for.
    ``release`` removes it, but for such as are to be kept.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path, partitionBy=list(by))
    if not keep:
        _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    # with its schema, no file is opened for it, and folders may be missing where there is no row
    return spark.read.schema(df.schema).parquet(path)


def standing(spark: SparkSession) -> int:
    """How many tables were written on the way and not removed yet."""
    return len(_written.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, since: int = 0, last: int = 0) -> int:
    """Remove the tables that were written on the way, once what was returned has been read; gives their number.

    ``since`` (of ``standing``) leaves older ones, ``last`` as many of the newest.
    """
    sc = spark.sparkContext
    paths = _written.get(sc.applicationId, [])
    gone = paths[since : len(paths) - last]
    _written[sc.applicationId] = [*paths[:since], *paths[len(paths) - last :]]
    for path in gone:
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
    return len(gone)
