"""Session, shared working folder and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 1_000_000  # of narrow rows; callers with wide rows pass fewer

_LOCAL_FOLDERS: dict[str, str] = {}


def build_session(cores: int | str = "*", app_name: str = "permlens", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_folder(spark: SparkSession) -> str:
    """The shared folder for written intermediate tables: the one the session names in spark.checkpoint.dir. Only a local session, where
    driver and executors are one machine, gets a folder of its own when the setting is missing."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if configured:
        return f"{configured.rstrip('/')}/permlens-{context.applicationId}"
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if context.applicationId not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="permlens-")
    return _LOCAL_FOLDERS[context.applicationId]


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes a table once to the shared folder and reads it back: cuts the lineage, survives the loss of any executor, and gives the
    optimizer real sizes for its join choices."""
    return df.sparkSession.read.schema(df.schema).parquet(write_table(df, name))


def write_table(df: DataFrame, name: str) -> str:
    path = f"{work_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    return path


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only for a table counted to be small; otherwise the table unchanged, which the optimizer then shuffles. The count
    reads at most max_rows + 1 rows."""
    return F.broadcast(df) if is_small(df, max_rows) else df


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    return df.limit(max_rows + 1).count() <= max_rows
