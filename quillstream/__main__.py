"""Command line: books to text, cleaning, chunked translation, partial texts and layout, over files or whole folders."""

from __future__ import annotations

import argparse
import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.operators import book, chunk, clean, progress, translate
from quillstream.plans import pipeline
from quillstream.sources import texts


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quillstream", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("to-text", help="EPUB archives below a folder to texts (Parquet: book_id, text)")
    p.add_argument("--no-chapters", action="store_true", help="leave chapter headings out")
    p.add_argument("--clean", action="store_true", help="clean the texts with the rules")
    c = sub.add_parser("clean", help="text files to cleaned texts (Parquet: path, text); prints counts per rule")
    for q in (p, c):
        q.add_argument("--rules", help="rules file (JSON); default: the built-in rules")
    t = sub.add_parser("translate", help="text files to translations by a chat-completions server (Parquet: path, text)")
    t.add_argument("--to", default="ES", help="language code")
    t.add_argument("--endpoint", default="http://localhost:1234/v1")
    t.add_argument("--model", help="default: the server's first model")
    t.add_argument("--chunk", type=int, default=chunk.LLM_LIMIT, help="most characters of a chunk")
    t.add_argument("--retries", type=int, default=3)
    t.add_argument("--progress", required=True, help="folder of the progress table; a later run goes on from it")
    r = sub.add_parser("partial", help="progress files to partial texts (Parquet: path, text); prints statistics")
    y = sub.add_parser("layout", help="text files to typed and styled lines (Parquet)")
    for q in (p, c, t, r, y):
        q.add_argument("input")
        q.add_argument("output")
    return top


def rules_of(spark: SparkSession, path: str | None) -> list[clean.Rule]:
    return clean.compile_rules(texts.rules_text(spark, path) if path else clean.DEFAULT_RULES)


def run(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """The result of a command, after printing what it reports."""
    if args.command == "to-text":
        day = datetime.datetime.now(datetime.UTC).date().isoformat()
        return pipeline.convert_books(spark, args.input, day, rules_of(spark, args.rules) if args.clean else None, sections=not args.no_chapters)
    if args.command == "partial":
        records = texts.progress_files(spark, args.input).select("path", progress.parse_progress(F.col("json"), strict=True).alias("record"))
        progress.progress_stats(records).show(truncate=False)
        return records.select(progress.partial_name(F.col("path")).alias("path"), progress.partial_text(F.col("record")).alias("text"))
    files = texts.whole_texts(spark, args.input)
    if args.command == "clean":
        rules = rules_of(spark, args.rules)
        clean.rule_counts(files, rules).where("count > 0").orderBy("ord").show(truncate=False)
        done = clean.clean_text(files, rules)
        clean.size_report(files, done).show()
        return done.withColumn("path", progress.with_suffix(F.col("path"), "_cleaned"))
    if args.command == "layout":
        return pipeline.layout(files, "path")
    model = args.model or translate.default_model(translate.server_models(args.endpoint))
    name = book.LANGUAGES.get(args.to.upper(), args.to)
    pieces = chunk.exploded(files.withColumnRenamed("path", "doc_id"), chunk.llm_chunks(F.col("text"), args.chunk), "doc_id")
    wait = lambda attempt: min(2.0 * attempt, 30.0)
    done = translate.translate_resumably(pieces, args.progress, translate.chat_translator(args.endpoint, model, name), retries=args.retries, wait=wait, marks=chunk.STRUCTURAL_LLM)
    return translate.assemble(done).select(progress.with_suffix(F.col("doc_id"), f"_{args.to.upper()}_by_ia").alias("path"), "text", "n_failed")


def main() -> None:
    args = parser().parse_args()
    spark = SparkSession.builder.appName("quillstream").getOrCreate()
    run(spark, args).write.mode("overwrite").parquet(args.output)


if __name__ == "__main__":
    main()
