"""Small helpers: tables, ASCII lower case, written intermediate tables."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casetrail.session import removed, scratch  # noqa: F401


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, nothing else touched. Plain ASCII takes the fast built-in function."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet below the cluster's spark.checkpoint.dir and go on from the copy.

    Cuts the lineage: nothing is worked out twice, and a lost executor loses nothing of it. The
    folder lies in the application's own checkpoint folder and goes with it.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
