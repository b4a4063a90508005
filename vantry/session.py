"""Session defaults and the shared folder for written stage tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("vantry")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach, taken from ``spark.checkpoint.dir``.

    Where it is unset, a local master takes a folder beside its warehouse; on a
    cluster the setting is required, as a default folder need not be shared.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        folder = f"{warehouse}-checkpoints"
        context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared checkpoint folder, without their lineage."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """The same rows as compressed columns in the shared folder, so that readers take only the columns they name.

    For wide tables: a checkpoint holds whole rows, not compressed. Files do not keep the partitions of the frame.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/vantry/{spark.sparkContext.applicationId}/written/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


class TableStore:
    """Stage tables written once as parquet and read back many times.

    Writing (rather than caching) cuts lineage, keeps column pruning and filter
    pushdown for the readers, and survives the loss of executors.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self._count = 0
        self.root = f"{shared_folder(spark)}/vantry/{spark.sparkContext.applicationId}/{name}"

    def fresh(self, name: str) -> str:
        """A table name not used before in this store."""
        self._count += 1
        return f"{name}_{self._count}"

    def put(self, name: str, df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
        path = f"{self.root}/{name}"
        writer = df.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path).select(*df.columns)

    def put_parts(self, name: str, column: str, parts: dict[str, DataFrame]) -> DataFrame:
        """Frames whose ``column`` holds their key, each written to the folder of that key.

        Writing one frame with ``partition_by`` would sort all rows of a task by the column first.
        """
        for value, df in parts.items():
            self.put(f"{name}/{column}={value}", df.drop(column))
        df = next(iter(parts.values()))
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}").select(*df.columns)
