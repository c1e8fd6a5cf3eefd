"""EPUB archives as tables: zip entries, manifest, spine and metadata, from Spark's binary file source.

An archive is opened in the task that read it; nothing is collected and one archive is in memory at a time.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRIES = "book_id string, path string, content binary"
PACKAGE = "book_id string, error string, title string, author string, manifest array<struct<item_idx:int,id:string,href:string,media_type:string>>, spine array<struct<spine_idx:int,idref:string>>"


def archives(spark: SparkSession, path: str) -> DataFrame:
    """(book_id, content) of the archives below path; book_id is the file's path."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("book_id"), "content")


def _entries(chapters_only: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for book, content in zip(pdf["book_id"], pdf["content"]):
                try:
                    wanted = reading_paths(parse_package(content)) if chapters_only else None
                    archive = zipfile.ZipFile(io.BytesIO(content))
                except (ValueError, ElementTree.ParseError, zipfile.BadZipFile):
                    continue  # packages() tells what is wrong with it
                with archive as z:
                    for name in dict.fromkeys(z.namelist()):
                        if not name.endswith("/") and (wanted is None or name in wanted):
                            yield pd.DataFrame({"book_id": [book], "path": [name], "content": [z.read(name)]})

    return run


def zip_entries(books: DataFrame, chapters_only: bool = False) -> DataFrame:
    """One row per file of each readable archive; of those alone that the reading order names, if ``chapters_only`` is set."""
    return books.mapInPandas(_entries(chapters_only), ENTRIES)


def reading_paths(package: dict) -> set[str]:
    """Paths of the items that the reading order names."""
    of_id = {i: href for _, i, href, _ in package["manifest"]}
    return {of_id[ref] for _, ref in package["spine"] if ref in of_id}


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _all(node, name: str) -> list:
    return [x for x in node.iter() if _local(x.tag) == name]


def parse_package(content: bytes) -> dict:
    """Title, author, manifest and spine of an archive. Raises ValueError naming what is missing."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        if "META-INF/container.xml" not in names:
            raise ValueError("no META-INF/container.xml")
        roots = [x.get("full-path") for x in _all(ElementTree.fromstring(z.read("META-INF/container.xml")), "rootfile")]
        if not roots or not roots[0]:
            raise ValueError("no rootfile")
        if roots[0] not in names:
            raise ValueError(f"no package file {roots[0]}")
        package, folder = ElementTree.fromstring(z.read(roots[0])), posixpath.dirname(roots[0])
    text = lambda name: next(("".join(x.itertext()).strip() for x in _all(package, name)), "")
    place = lambda href: posixpath.normpath(posixpath.join(folder, href)).lstrip("./") if href else href
    manifest = [(i, x.get("id"), place(x.get("href")), x.get("media-type")) for m in _all(package, "manifest") for i, x in enumerate(_all(m, "item"))]
    spine = [(i, x.get("idref")) for s in _all(package, "spine") for i, x in enumerate(_all(s, "itemref"))]
    return {"title": text("title"), "author": text("creator"), "manifest": manifest, "spine": spine}


def _packages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for book, content in zip(pdf["book_id"], pdf["content"]):
            row = {"book_id": book, "error": None, "title": None, "author": None, "manifest": [], "spine": []}
            try:
                found = parse_package(content)
                row |= {"title": found["title"], "author": found["author"]}
                row["manifest"] = [dict(zip(("item_idx", "id", "href", "media_type"), m)) for m in found["manifest"]]
                row["spine"] = [dict(zip(("spine_idx", "idref"), s)) for s in found["spine"]]
            except (ValueError, ElementTree.ParseError, zipfile.BadZipFile) as e:
                row["error"] = str(e)
            yield pd.DataFrame([row])


def packages(books: DataFrame) -> DataFrame:
    """One row per archive with its metadata, or with the error that keeps it from being read."""
    return books.mapInPandas(_packages, PACKAGE)


def manifest(found: DataFrame) -> DataFrame:
    return found.select("book_id", F.inline("manifest"))


def spine(found: DataFrame) -> DataFrame:
    return found.select("book_id", F.inline("spine"))
