"""Session helpers: a sane local builder for tests, and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, shuffle_partitions: int | None = None, app: str = "docassay") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("DOCASSAY_DRIVER_MEMORY", "6g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


#: Folder of local sessions that name none, and the tables cut so far with their sessions.
_OWN: list[str] = []
_CUT: list[tuple[SparkSession, str]] = []


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names.

    Only a local session without the setting (a test) gets a temporary folder; on a cluster its absence is an error,
    as a machine's own folder would be lost with the machine.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="docassay-ck-"))
    return _OWN[0]


def path_of(spark: SparkSession, folder: str) -> tuple:
    """(file system, path) of a folder, whatever store it is on."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, folder: str) -> bool:
    store, path = path_of(spark, folder)
    return store.exists(path)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a table in the shared folder: computed once, readable whichever executors are lost.

    The table stays while the session may read it; ``clear`` or the end of the program deletes it.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/docassay-{uuid.uuid4().hex}"
    _CUT.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def clear() -> None:
    """Delete all tables that ``cut`` wrote."""
    while _CUT:
        spark, folder = _CUT.pop()
        try:
            store, path = path_of(spark, folder)
            store.delete(path, True)
        except Exception:  # noqa: BLE001, S112  the session has ended; nothing reads the table any more
            continue
