"""Translation progress records: parsing, statistics, partial and final texts, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values.
FAILED = "[TRANSLATION FAILED]"
SCHEMA = "totalChunks int, completedChunks int, translated array<string>"


def parse_progress(json: Column, strict: bool = False) -> Column:
    """The record of a JSON text; bad JSON gives null, or an error if strict."""
    return F.from_json(json, SCHEMA, {"mode": "FAILFAST" if strict else "PERMISSIVE"})


def done_chunks(record: Column) -> Column:
    return F.filter(F.coalesce(record["translated"], F.array().cast("array<string>")), lambda c: c.isNotNull())


def partial_text(record: Column) -> Column:
    """The translated chunks so far; null where there is nothing to compile."""
    return F.when(F.size(record["translated"]) > 0, F.array_join(done_chunks(record), "\n\n"))


def final_text(record: Column) -> Column:
    """All chunks in place, untranslated ones empty."""
    return F.array_join(record["translated"], "\n\n", "")


def progress_stats(df: DataFrame, record: str = "record") -> DataFrame:
    """df's other columns with total, completed, done, failed and pct (one decimal, as text)."""
    r = F.col(record)
    done = done_chunks(r)
    total = F.coalesce(r["totalChunks"], F.when(r["translated"].isNotNull(), F.size(r["translated"])), F.lit(0))
    df = df.withColumns({"total": total, "completed": F.coalesce(r["completedChunks"], F.lit(0)), "done": F.size(done), "failed": F.size(F.filter(done, lambda c: F.startswith(c, F.lit(FAILED))))})
    pct = F.when(F.col("total") > 0, F.round(F.col("done") / F.col("total") * 100, 1)).otherwise(F.lit(0.0))
    return df.withColumn("pct", F.format_string("%.1f", pct)).drop(record)


def partial_name(path: Column) -> Column:
    """Where the partial text of a progress file goes."""
    folder, base = F.regexp_extract(path, r"(?s)^(.*/)?([^/]*)\z", 1), F.regexp_extract(path, r"(?s)^(.*/)?([^/]*)\z", 2)
    base = F.regexp_replace(base, r"(?<=.)\.json\z", "")
    base = F.regexp_replace(F.regexp_replace(F.regexp_replace(base, r"^\.", ""), r"_translate_progress\z", ""), r"_ai_[A-Z]+_progress\z", "")
    return F.concat(folder, base, F.lit("_partial.txt"))


def with_suffix(path: Column, suffix: str) -> Column:
    """path with a suffix before its extension; a path without one gets it at the end."""
    return F.concat(F.regexp_replace(path, r"(?<=[^/])\.[^./]*\z", ""), F.lit(suffix), F.regexp_extract(path, r"(?<=[^/])(\.[^./]*)\z", 1))


def backoff_ms(attempt: Column, kind: str) -> Column:
    """Waiting time before the next attempt: ``web`` doubles from 3 s up to 120 s, ``llm`` adds 2 s up to 30 s, ``scrape`` adds 1 s."""
    if kind == "web":
        return F.least(F.lit(3000) * F.pow(F.lit(2.0), attempt - 1), F.lit(120_000.0)).cast("long")
    if kind == "llm":
        return F.least(F.lit(2000) * attempt, F.lit(30_000)).cast("long")
    return (F.lit(1000) * attempt).cast("long")
