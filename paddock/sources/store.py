"""Tables by period: written with dynamic partition overwrite, read pruned.

Each period is a folder. Writing rows of some periods replaces these folders
and leaves the others; a filter on the period (``plans.metrics.chrono_split``)
reads the folders it names only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def write_periods(df: DataFrame, path: str, *period: str) -> None:
    """Replace the periods (``season``, or folders by the given columns) that ``df`` has rows of. Rows of a period go to as many tasks as the shuffle
    has, so a large period is no single file."""
    period = period or ("season",)
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(8))
    df.repartition(*period, salt).write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
        .partitionBy(*period).parquet(path)


def read_periods(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table, with the columns and types of ``schema`` (the period would else be guessed from folder names)."""
    return spark.read.schema(schema).parquet(path).select(*schema.names)
