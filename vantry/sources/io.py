"""Readers and writers for the formats the pipeline accepts."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

# --- fixed values: keys under which a JSON document may hold its records -------
RECORD_KEYS = ["data", "records", "events", "logs", "iam_logs"]


def text_schema(columns: list[str]) -> T.StructType:
    """All-text schema; raw files are read without type inference."""
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    return spark.read.schema(text_schema(columns)).option("header", True).option("escape", '"').csv(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines, an array, an object that wraps an array, or one object.

    A line that ends with an opening bracket is no whole record, so the text spans
    lines; else every line is read on its own, which stays splittable. A wrapping
    object shows in the schema. No text reaches the driver.
    """
    open_ended = spark.read.text(path).where(F.rtrim("value").rlike(r"[\[{]$"))
    df = spark.read.option("multiLine", not open_ended.isEmpty()).json(path)
    for key in RECORD_KEYS:
        if key in df.columns and isinstance(df.schema[key].dataType, T.ArrayType):
            return df.select(F.inline(key))
    return df


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Reader chosen by file suffix."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix == "csv":
        if columns:
            return read_csv(spark, path, columns)
        return spark.read.option("header", True).csv(path)
    if suffix in ("json", "jsonl"):
        return read_json(spark, path)
    if suffix == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"no reader for {path}")


def read_sources(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    """The four raw sources as lazy frames, headers standardised."""
    return {name: standard_headers(read_table(spark, path)) for name, path in paths.items()}


def standard_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().lower().replace(" ", "_") for c in df.columns])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """Nested rows as JSON lines."""
    df.write.mode("overwrite").json(path)


def load_table(spark: SparkSession, folder: str, names: list[str], schema: T.StructType) -> DataFrame:
    """First table of ``names`` that exists in a folder, else an empty frame."""
    for name in names:
        try:
            return spark.read.schema(schema).parquet(f"{folder}/{name}")
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
    return spark.createDataFrame([], schema)


def as_map(df: DataFrame, key: str) -> DataFrame:
    """(key, value) rows where value is the whole record as JSON text."""
    return df.select(F.col(key).alias("key"), F.to_json(F.struct("*")).alias("value"))
