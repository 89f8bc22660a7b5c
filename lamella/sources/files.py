"""Readers and writers of CSV, JSON, Parquet and text, with explicit schemas; discovery of files by name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and a given schema; rows that do not fit keep their text in ``_corrupt``."""
    return spark.read.schema(f"{schema}, _corrupt string").option("header", True).option("columnNameOfCorruptRecord", "_corrupt").csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of an append-only log; lines that cannot be read are left out, as the log may end in half a line."""
    rows = spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.where("_corrupt IS NULL").drop("_corrupt")


def clean_number(c: Column, digits: int = 10) -> Column:
    """For JSON: NaN and infinity become null, denormal numbers 0, others keep so many significant digits."""
    size = F.floor(F.log10(F.abs(c)))
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - size)
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(None)).when(F.abs(c) < 2.3e-308, 0.0).otherwise(F.rint(c * scale) / scale)


def write_json(df: DataFrame, path: str) -> None:
    df.select([clean_number(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]).write.mode("overwrite").json(path)


def write_partitioned(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Parquet by key; a partition's rows go to one task, and the committer marks the folder when all is written."""
    df.repartition(*keys).write.mode("overwrite").partitionBy(*keys).parquet(path)


def narrow_arrays(spark: SparkSession, path: str, array: str, most: int) -> DataFrame:
    """Rows whose array has at most so many values; the width is checked before anything else is read."""
    return spark.read.parquet(path).where(F.size(array) <= most)


def discover(spark: SparkSession, path: str, pattern: str, names: Sequence[str]) -> DataFrame:
    """Keys held in file names: one row a distinct set of the pattern's groups. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    return files.where(F.col("path").rlike(pattern)).select(*[F.regexp_extract("path", pattern, i + 1).alias(n) for i, n in enumerate(names)]).distinct()


def from_positions(df: DataFrame, key: str, index: str) -> DataFrame:
    """Text from an inverted abstract, a map of words to their positions."""
    w = df.select(key, F.explode(index).alias("word", "at")).select(key, "word", F.explode("at").alias("at"))
    return w.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda e: e["word"]), " ").alias("text"))


def publish(df: DataFrame, path: str) -> None:
    """Write, then check that the commit marker stands; readers that wait for the marker never see half a table."""
    df.write.mode("overwrite").parquet(path)
    jvm = df.sparkSession._jvm
    marker = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not marker.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).exists(marker):
        raise RuntimeError(f"{path} was not committed")
