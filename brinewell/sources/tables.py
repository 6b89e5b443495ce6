"""Readers: Parquet tables, CSV observations, JSON articles, all with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

OBSERVATION_CSV = T.StructType(
    [
        T.StructField("Date", T.StringType()),
        T.StructField("Measurement", T.DoubleType()),
        T.StructField("Unit", T.StringType()),
        T.StructField("Sampling Method", T.StringType()),
        T.StructField("Density Class", T.StringType()),
        T.StructField("Oceans", T.StringType()),
        T.StructField("Regions", T.StringType()),
        T.StructField("Longitude", T.DoubleType()),
        T.StructField("Latitude", T.DoubleType()),
        T.StructField("x", T.DoubleType()),
        T.StructField("y", T.DoubleType()),
    ]
)
ARTICLE_JSON = T.StructType(
    [T.StructField("title", T.StringType()), T.StructField("date", T.StringType()), T.StructField("content", T.StringType())]
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_observation_csv(spark: SparkSession, path: str, schema: T.StructType = OBSERVATION_CSV) -> DataFrame:
    """Observation CSV with header. Unparsable cells become null; columns follow the schema's order."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "PERMISSIVE").csv(path)


def read_article_json(spark: SparkSession, path: str, first: int = 1) -> DataFrame:
    """Top-level JSON array of articles with 1-based ``seq_num``; absent fields are null.

    Ordinals follow (file, position in file): each array is one record of a
    multi-line scan, so a file's rows keep their order; file offsets come from a
    count per file, never from a single sorted task.
    """
    raw = spark.read.option("multiLine", True).schema(ARTICLE_JSON).json(path)
    tagged = raw.select("title", "date", "content", F.col("_metadata.file_path").alias("_f"), F.monotonically_increasing_id().alias("_m"))
    per_file = tagged.groupBy("_f").agg(F.min("_m").alias("_m0"), F.count(F.lit(1)).alias("_n"))
    # one row per file: a window over files, not over articles
    from pyspark.sql import Window

    base = per_file.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_f").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return tagged.join(base, "_f").select((F.col("_m") - F.col("_m0") + F.col("_before") + F.lit(first)).alias("seq_num"), "title", "date", "content")


def save_index(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write an index table (vectors with their payload) as Parquet; ``append`` adds documents."""
    if mode not in ("overwrite", "append", "errorifexists"):
        raise ValueError(f"mode {mode!r}")
    df.write.mode(mode).parquet(path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
