"""Session settings and the shared folder that lineage cuts are written to."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "siteweave") -> SparkSession:
    """A session for tests and the bench; on a cluster the job brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        # The JVM does not compile methods above this size; Spark then splits them instead.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    A session of one process may fall back to a temporary folder: there every task
    sees it. On a cluster, a local one included, a machine-local path would be
    lost together with its executor, so the setting must be there.
    """
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="siteweave-checkpoint-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Writes the rows as a table in the shared folder and reads them back.

    The table survives the loss of any executor. Unlike a checkpoint of the
    plan's RDD it computes the rows once, and the next plan knows their size.
    It is removed when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


#: Rows for each task of work that costs far more than the rows' bytes tell.
SPREAD_ROWS = 10_000


def spread(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of which there are ``rows``, dealt over tasks by number: a small file of many rows is read in one task."""
    return df.repartition(max(1, -(-rows // SPREAD_ROWS)))
