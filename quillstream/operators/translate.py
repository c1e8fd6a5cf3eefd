"""Pluggable chunk translation with retries, failure marks and resumption."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from urllib.request import Request, urlopen

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.operators import chunk as C
from quillstream.operators.progress import FAILED

Translator = Callable[[str], str]
#: Chunks that are Python objects at once.
PIECE = 256


def prompt(language: str) -> str:
    """The system prompt of the language-model translator."""
    return f"Translate the user's text into {language}. Return the translation only and keep its line breaks and markers."


def translate_chunks(chunks: DataFrame, make: Callable[[], Translator], retries: int = 3, wait: Callable[[int], float] = lambda attempt: 0.0, marks: str = C.STRUCTURAL_WEB, pause: float = 0.0) -> DataFrame:
    """chunks(doc_id, chunk_idx, chunk) with chunk_hash, translated and status (passed, done or failed).

    Structural and blank chunks pass unchanged. ``make`` builds the translator in the worker; a chunk that fails ``retries``
    times comes back behind the failure mark. ``wait`` gives the seconds before the next attempt, ``pause`` those between chunks.
    """
    marked = chunks.withColumns({"chunk_hash": F.sha2("chunk", 256), "passes": C.is_structural(F.col("chunk"), marks) | C.is_blank(F.col("chunk"))})

    names = [n for n in marked.columns if n != "passes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        translator = make()

        def one(text: str, passes: bool) -> tuple[str, str]:
            if passes:
                return text, "passed"
            for attempt in range(1, retries + 1):
                try:
                    return translator(text), "done"
                except Exception:
                    if attempt < retries:
                        time.sleep(wait(attempt))
                finally:
                    time.sleep(pause)
            return f"{FAILED}\n{text}", "failed"

        for part in (b.slice(k, PIECE) for b in batches for k in range(0, b.num_rows, PIECE)):
            found = [one(t, p) for t, p in zip(part.column("chunk").to_pylist(), part.column("passes").to_pylist())]
            made = [pa.array([x[i] for x in found], part.column("chunk").type) for i in range(2)]
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *made], names=[*names, "translated", "status"])

    schema = ", ".join(f"`{n}` {t}" for n, t in marked.select(*names).dtypes) + ", translated string, status string"
    return marked.mapInArrow(run, schema)


def pending(chunks: DataFrame, finished: DataFrame) -> DataFrame:
    """chunks whose (doc_id, chunk_idx, content) has not been translated yet; a changed chunk is translated anew."""
    hashed = chunks.withColumn("chunk_hash", F.sha2("chunk", 256))
    return hashed.join(finished.where("status <> 'failed'").select("doc_id", "chunk_idx", "chunk_hash"), ["doc_id", "chunk_idx", "chunk_hash"], "left_anti").select(*chunks.columns)


def assemble(translated: DataFrame) -> DataFrame:
    """(doc_id, text, n_failed): chunks joined by an empty line in order, missing ones empty."""
    per = translated.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_idx", "translated"))).alias("p"), F.sum((F.startswith("translated", F.lit(FAILED))).cast("int")).alias("n_failed"))
    return per.select("doc_id", F.array_join(F.transform("p", lambda x: x["translated"]), "\n\n", "").alias("text"), "n_failed")


def translate_resumably(chunks: DataFrame, path: str, make: Callable[[], Translator], **options) -> DataFrame:
    """Translate what the Parquet table at ``path`` does not hold yet, add it there, and return the rows of ``chunks``' contents.

    The table is the progress record: a run that ends early leaves whole finished tasks' rows, and the next one goes on from them.
    """
    spark = chunks.sparkSession
    try:
        finished = spark.read.parquet(path)
    except AnalysisException:
        finished = None
    todo = chunks if finished is None else pending(chunks, finished)
    translate_chunks(todo, make, **options).write.mode("append").parquet(path)
    wanted = chunks.withColumn("chunk_hash", F.sha2("chunk", 256)).select("doc_id", "chunk_idx", "chunk_hash")
    best = spark.read.parquet(path).join(wanted, ["doc_id", "chunk_idx", "chunk_hash"]).groupBy("doc_id", "chunk_idx").agg(F.max_by(F.struct("chunk", "translated", "status"), F.col("status") != "failed").alias("r"))
    return best.select("doc_id", "chunk_idx", "r.*")


def default_model(names: list[str]) -> str | None:
    """The first model that a server offers; null if it offers none."""
    return names[0] if names else None


def server_models(endpoint: str, timeout: float = 30.0) -> list[str]:
    """Names of the models that a chat-completions server offers; raises OSError if it cannot be reached."""
    with urlopen(f"{endpoint}/models", timeout=timeout) as r:
        return [m["id"] for m in json.load(r).get("data", [])]


def chat_translator(endpoint: str, model: str | None, language: str, temperature: float = 0.2, timeout: float = 600.0) -> Callable[[], Translator]:
    """A translator by a chat-completions server."""

    def make() -> Translator:
        def run(text: str) -> str:
            messages = [{"role": "system", "content": prompt(language)}, {"role": "user", "content": text}]
            body = json.dumps({"model": model, "messages": messages, "temperature": temperature, "stream": False}).encode()
            with urlopen(Request(f"{endpoint}/chat/completions", body, {"Content-Type": "application/json"}), timeout=timeout) as r:
                answer = json.load(r)["choices"][0]["message"]["content"].strip()
            if not answer:
                raise ValueError("empty answer")
            return answer

        return run

    return make
