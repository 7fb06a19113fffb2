"""Session, table and checkpoint helpers shared by every operator."""

from __future__ import annotations

import tempfile
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a dimension table may be broadcast; beyond it joins shuffle.
SMALL_ROWS = 10_000


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("peakloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on whatever file system the path names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the cluster names; a local session without one gets a temporary folder, a cluster an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and sc.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="peakloom-checkpoint-"))


#: The setting below is the session's: one checkpoint is planned at a time.
_planning = threading.Lock()


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and read it from there: cuts lineage, survives lost executors.

    The checkpointed plan must carry no constraints: Catalyst can't rewrite them in a later union with itself.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    name = "spark.sql.constraintPropagation.enabled"
    with _planning:
        before = spark.conf.get(name, "true")
        spark.conf.set(name, "false")
        try:
            return df.select("*").checkpoint(eager=True)
        finally:
            spark.conf.set(name, before)


def small(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most max_rows rows, else df as it is (the join then shuffles)."""
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, *columns: str, factor: int = 4) -> DataFrame:
    """df over factor times the usual partitions, by number: adaptive execution would merge few small rows that are costly to work on."""
    return df.repartition(factor * shuffle_width(df.sparkSession), *columns)
