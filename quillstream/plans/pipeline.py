"""The chain from HTML chapters to cleaned, chunked, translated and classified text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.functions import text as T
from quillstream.operators import book, chunk, clean, html_text, structure, translate
from quillstream.sources import epub


def pipeline(pages: DataFrame, key: str, rules: list[clean.Rule] | None = None, translator: Callable | None = None, limit: int = chunk.LLM_LIMIT, entities: Callable = T.decode_entities) -> DataFrame:
    """(key, text) of pages(key, html): converted (entities decoded by ``entities``), cleaned if rules are given, translated if a translator is."""
    df = html_text.html_to_text(pages.select(key, "html"), entities=entities).select(key, "text")
    if rules is not None:
        df = clean.clean_text(df, rules)
    if translator is not None:
        chunks = chunk.exploded(df.withColumnRenamed(key, "doc_id"), chunk.llm_chunks(F.col("text"), limit), "doc_id")
        df = translate.assemble(translate.translate_chunks(chunks, translator)).select(F.col("doc_id").alias(key), "text")
    return df


def layout(df: DataFrame, key: str) -> DataFrame:
    """(key, line_no, type, text, rendered, style columns) of a pipeline's texts."""
    return structure.styled(structure.rendered(structure.classify_lines(df, "text", key), key))


def convert_books(spark: SparkSession, path: str, day: str, rules: list[clean.Rule] | None = None, translator: Callable | None = None, sections: bool = True, limit: int = chunk.LLM_LIMIT) -> DataFrame:
    """(book_id, text) of the readable archives below path: header and chapters, then cleaning and translation if asked for."""
    books = epub.archives(spark, path)
    found = epub.packages(books).where("error IS NULL")
    order = book.reading_order(epub.spine(found), epub.manifest(found))
    texts = html_text.html_to_text(book.chapters(order, epub.zip_entries(books, chapters_only=True)))
    whole = book.book_texts(texts, header=sections).join(found.select("book_id", "title", "author"), "book_id")
    head = book.header_text(F.col("title"), F.col("author"), F.regexp_extract("book_id", "[^/]*$", 0), day)
    df = whole.select("book_id", F.concat(head, "text").alias("text"))
    if rules is not None:
        df = clean.clean_text(df, rules)
    if translator is not None:
        chunks = chunk.exploded(df.withColumnRenamed("book_id", "doc_id"), chunk.llm_chunks(F.col("text"), limit), "doc_id")
        df = translate.assemble(translate.translate_chunks(chunks, translator, marks=chunk.STRUCTURAL_LLM)).select(F.col("doc_id").alias("book_id"), "text")
    return df
