"""Source tables, and results as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A Parquet table; with a schema given no file is opened to find one."""
    return spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)


def as_tsv(df: DataFrame) -> DataFrame:
    """One column `line`: the values with tabs between; tabs, line ends and backslashes inside are escaped, null is \\N."""
    cells = []
    for c in df.columns:
        text = F.col(c).cast("string")
        for a, b in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
            text = F.replace(text, F.lit(a), F.lit(b))
        cells.append(F.coalesce(text, F.lit("\\N")))
    return df.select(F.concat_ws("\t", *cells).alias("line"))


def as_json(df: DataFrame) -> DataFrame:
    """One column `line`: each row as JSON."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("line"))
