"""Parquet tables of one directory."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of ``folder``: a file or a directory of Parquet."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def until_middle(df: DataFrame, time: str) -> DataFrame:
    """The rows of the first half of the table's span of time; those without a time count as first. Two numbers go to the driver."""
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    least, most = df.agg(F.min(micros), F.max(micros)).first()
    return df if least is None else df.where(F.col(time).isNull() | (micros <= least + (most - least) // 2))
