"""Sources: a directory of text files, a text column of a table."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import WHITE_SPACE


def text_directory(spark: SparkSession, path: str) -> DataFrame:
    """task (file name) and value (line) of the files directly in a directory.

    Sub-directories and names that begin with _ or . are not read; line ends are \\n, \\r\\n and \\r. A path that doesn't
    exist, or holds no file, is a ValueError.
    """
    try:
        lines = spark.read.text(path)
    except AnalysisException as e:
        raise ValueError(f"no input directory {path}") from e
    if not lines.inputFiles():
        raise ValueError(f"no files in {path}")
    return lines.select(F.col("_metadata.file_name").alias("task"), "value")


def text_column(table: DataFrame, task: str, text: str) -> DataFrame:
    """A table's rows as tasks: task and value."""
    return table.select(F.col(task).alias("task"), F.col(text).alias("value"))


def items(source: DataFrame, *keep: str) -> DataFrame:
    """The words of a source, one row each, with the columns to keep. Null and blank texts give no rows."""
    return source.select(*keep, F.explode(F.split("value", WHITE_SPACE, -1)).alias("item")).where("item <> ''")
