"""Numbered web chapters: the number range, batches, and a fetcher with retries in the tasks."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The default range, batch size, number of tries and pause in seconds.
FIRST, LAST, BATCH, TRIES, PAUSE = 1, 384, 5, 3, 3.0


def chapter_numbers(spark: SparkSession, first: int = FIRST, last: int = LAST, batch: int = BATCH) -> DataFrame:
    """(n, batch_no) of the chapters first..last."""
    return spark.range(first, last + 1).select(F.col("id").cast("int").alias("n"), F.floor((F.col("id") - first) / batch).cast("int").alias("batch_no"))


def fetch_chapters(numbers: DataFrame, make: Callable[[], Callable[[int], str]], tries: int = TRIES, wait: Callable[[int], float] = lambda attempt: 1.0 * attempt, concurrency: int = BATCH) -> DataFrame:
    """numbers with html, null where all tries failed. ``make`` builds the fetcher in the task; ``concurrency`` tasks fetch at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fetch = make()

        def one(n: int) -> str | None:
            for attempt in range(1, tries + 1):
                try:
                    return fetch(n)
                except Exception:
                    if attempt < tries:
                        time.sleep(wait(attempt))
            return None

        for pdf in batches:
            yield pdf.assign(html=[one(int(n)) for n in pdf["n"]])

    schema = ", ".join(f"`{n}` {t}" for n, t in numbers.dtypes) + ", html string"
    return numbers.repartition(concurrency).mapInPandas(run, schema)


def http_fetcher(base: str, timeout: float = 30.0) -> Callable[[], Callable[[int], str]]:
    """A fetcher of ``base``/n over HTTP."""

    def make():
        from urllib.request import urlopen

        def fetch(n: int) -> str:
            with urlopen(f"{base}/{n}", timeout=timeout) as r:
                return r.read().decode("utf-8", "replace")

        return fetch

    return make
