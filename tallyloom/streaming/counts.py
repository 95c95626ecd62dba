"""The keyed aggregate of an application over a stream of texts, kept up to date by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.apps import Application
from ..sources.text import items


def text_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Lines of the files that arrive in a directory: value."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)


def running(app: Application, lines: DataFrame) -> DataFrame:
    """key and value so far, for output modes update and complete. The application needs a native aggregate."""
    if app.reduce is None:
        raise ValueError(f"{app.name} has no native aggregate")
    return app.reduced(app.pairs(items(lines)))
