"""Plain text files, rules and progress files as DataFrames, and text sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.functions import text as T


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole UTF-8 files; malformed bytes become U+FFFD."""
    return spark.read.format("binaryFile").load(path).select("path", T.decoded(F.col("content")).alias("text"))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line) of files too large for one row; CR LF ends a line like LF."""
    return spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "\r\\z", "").alias("line"))


def rules_text(spark: SparkSession, path: str) -> str:
    """A rules file's JSON text, read through Spark so that any store it reaches will do."""
    return spark.read.text(path, wholetext=True).first()["value"]


def hidden_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of files whose names begin with a dot, which Spark's file sources pass over.

    For the few small progress files that translators leave: the driver lists and reads them through Hadoop's file system.
    """
    jvm, where = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    rows = []
    for status in fs.globStatus(where) or []:
        if status.isFile():
            stream = fs.open(status.getPath())
            try:
                rows.append((status.getPath().toString(), bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")))
            finally:
                stream.close()
    return spark.createDataFrame(rows, "path string, text string")


def progress_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, json) of progress files, hidden or not."""
    hidden = path.rstrip("/").rpartition("/")[2].startswith(".")
    return (hidden_texts if hidden else whole_texts)(spark, path).withColumnRenamed("text", "json")


def write_texts(df: DataFrame, path: str, text: str = "text") -> None:
    """One text file per partition, a row a line block; order the rows before if it matters."""
    df.select(F.col(text).alias("value")).write.mode("overwrite").text(path)


def source_kind(path: Column) -> Column:
    """``pdf``, ``epub`` or null by a path's extension, whatever its case."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]*)\z", 1))
    return F.when(ext.isin("pdf", "epub"), ext)
