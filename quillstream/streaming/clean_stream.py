"""Line cleaning as a stream, for files too large for one row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.operators import clean


def read_lines(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of (line) of text files arriving in a folder."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path).select(F.regexp_replace("value", "\r\\z", "").alias("line"))


def clean_lines_stream(lines: DataFrame, rules: list[clean.Rule], line: str = "line", skip_blocks: bool = False) -> DataFrame:
    """lines sanitized, without those that a line pattern matches, with replacements applied. Stateless.

    A stream has no look-ahead over lines, so rules with blocks of several lines raise ValueError unless ``skip_blocks`` says
    that these may stay; runs of empty lines stay too. Use ``clean.clean_text`` where a whole text fits a row.
    """
    blocks = [r for r in rules if r.kind == "block"]
    long = [r.label for r in blocks if "\n" in r.find]
    if long and not skip_blocks:
        raise ValueError(f"blocks of several lines cannot be removed from a stream of lines: {long}")
    df = clean.sanitize(lines, line, line)
    df = reduce(lambda d, r: clean.fixpoint(d, line, r.find), [r for r in blocks if "\n" not in r.find], df)
    patterns = [r for r in rules if r.kind == "line"]
    if patterns:
        df = df.where(~reduce(lambda a, b: a | b, [F.rlike(line, F.lit(r.find)) for r in patterns]))
    df = clean.apply_replacements(df.withColumn("_lines", F.array(line)), "_lines", rules)
    return df.withColumn(line, F.get("_lines", F.lit(0))).drop("_lines")


def write_lines(df: DataFrame, path: str, checkpoint: str, line: str = "line"):
    """Start writing cleaned lines as text; the checkpoint makes every line arrive exactly once."""
    return df.select(F.col(line).alias("value")).writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

