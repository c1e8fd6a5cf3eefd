"""Books: reading order, paths and media types, inlined assets, assembled texts and reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.functions import text as T

#: Media types by extension.
MEDIA_TYPES = {
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "svg": "image/svg+xml", "webp": "image/webp", "bmp": "image/bmp", "tif": "image/tiff", "tiff": "image/tiff",
    "css": "text/css", "ttf": "font/ttf", "otf": "font/otf", "woff": "font/woff", "woff2": "font/woff2",
}
DEFAULT_MEDIA_TYPE = "application/octet-stream"
#: Names of target languages.
LANGUAGES = {"ES": "Spanish", "EN": "English", "FR": "French", "DE": "German", "IT": "Italian", "PT": "Portuguese", "JA": "Japanese", "KO": "Korean", "ZH": "Chinese", "RU": "Russian", "AR": "Arabic"}
#: Asset references in chapters and style sheets, the reference in the first group.
REFERENCES = {
    "css": r"""(?i)<link[^>]+rel=["']stylesheet["'][^>]*href=["']([^"']+)["'][^>]*/?>""",
    "img": r"""(?i)<img[^>]+src=["']([^"']+)["'][^>]*/?>""",
    "svg": r"""(?i)xlink:href=["']([^"']+)["']""",
    "url": r"""(?i)url\(["']?(?!data:)([^"')]+)["']?\)""",
}

STYLE_LINK = r"""(?i)<link[^>]+rel=["']stylesheet["'][^>]*/?>"""


def lookup(table: dict[str, str], key: Column, default: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), default)


def media_type(path: Column) -> Column:
    """Media type by the extension of the last path part."""
    return lookup(MEDIA_TYPES, F.lower(F.regexp_extract(path, r"[^/]\.([^./]*)\z", 1)), F.lit(DEFAULT_MEDIA_TYPE))


def language_name(code: Column) -> Column:
    """The name of a language code in any case, or else the code."""
    return lookup(LANGUAGES, F.upper(code), code)


def resolve_href(base: Column, href: Column) -> Column:
    """href from base's folder, with . and .. resolved; going up from the top stays there."""
    parts = F.split(F.concat(F.when(F.contains(base, F.lit("/")), F.regexp_replace(base, r"[^/]*\z", "")).otherwise(F.lit("")), href), "/", -1)
    up = lambda a: F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))
    step = lambda a, p: F.when(p == "..", up(a)).when((p == ".") | (p == ""), a).otherwise(F.concat(a, F.array(p)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def reading_order(spine: DataFrame, manifest: DataFrame) -> DataFrame:
    """(book_id, spine_idx, chapter_no, id, href, media_type): spine items that the manifest knows, numbered in order.

    Of manifest items with one id the last counts; spine items of unknown ids are dropped before numbering.
    """
    last = manifest.where(F.col("id").isNotNull() & F.col("href").isNotNull()).groupBy("book_id", "id").agg(F.max_by(F.struct("href", "media_type"), "item_idx").alias("m")).select("book_id", "id", "m.*")
    found = spine.join(last, (spine.book_id == last.book_id) & (spine.idref == last.id)).select(spine.book_id, "spine_idx", last.id, "href", "media_type")
    return found.withColumn("chapter_no", F.row_number().over(Window.partitionBy("book_id").orderBy("spine_idx"))).select("book_id", "spine_idx", "chapter_no", "id", "href", "media_type")


def chapters(order: DataFrame, entries: DataFrame) -> DataFrame:
    """order with each chapter's html; unreadable chapters go, numbers stay.

    Bytes are decoded after the join, so entries that are no text (images, fonts) are never looked into.
    """
    files = entries.select(F.col("book_id").alias("_book"), "path", F.col("content").alias("_content"))
    found = order.join(files, (order.book_id == files._book) & (order.href == files.path))
    return T.once(found, html=T.decoded(F.col("_content"))).drop("_book", "path", "_content")


def style_sheets(manifest: DataFrame) -> DataFrame:
    """The manifest's style sheets."""
    return manifest.where("media_type = 'text/css'")


def asset_refs(df: DataFrame, key: str, base: str, html: str = "html") -> DataFrame:
    """(key, kind, ref_no, ref, path): what a chapter refers to, without inline data and fragments."""
    of_kind = lambda kind: lambda r: F.struct(F.lit(kind).alias("kind"), r.alias("ref"))
    refs = [F.transform(F.regexp_extract_all(F.col(html), F.lit(p), 1), of_kind(kind)) for kind, p in REFERENCES.items()]
    out = df.select(key, F.col(base).alias("_base"), F.posexplode(F.concat(*refs)).alias("_n", "_r")).select(key, "_base", "_n", "_r.*")
    out = out.where(~F.startswith("ref", F.lit("data:")) & ~((F.col("kind") == "svg") & F.startswith("ref", F.lit("#"))))
    number = F.row_number().over(Window.partitionBy(key, "kind").orderBy("_n"))
    return out.select(key, "kind", number.alias("ref_no"), "ref", resolve_href(F.col("_base"), F.col("ref")).alias("path"))


def _quoted_swap(t: Column, x: Column) -> Column:
    """t with a quoted reference replaced by its value, in either kind of quotes."""
    for mark in ('"', "'"):
        m = F.lit(mark)
        t = F.replace(t, F.concat(m, x["ref"], m), F.concat(m, x["value"], m))
    return t


def _ordered(values: DataFrame, key: str, name: str) -> DataFrame:
    return values.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("kind", "ref_no", "ref", "value"))).alias(name))


def inline_assets(chapter: DataFrame, entries: DataFrame, sheets: DataFrame | None = None) -> DataFrame:
    """chapter(book_id, chapter_no, href, html) with images as data URIs, style sheet links removed and their style inlined.

    ``sheets`` (book_id, item_idx, href) are style sheets of the whole book, which come before the linked ones. References inside styles
    are resolved from the book's first sheet, or else from the chapter. References without an entry stay as they are. Assets come by
    joins on (book, path), and one ordered aggregate a chapter.
    """
    files = entries.select("book_id", "path", "content")
    uri = F.concat(F.lit("data:"), media_type(F.col("path")), F.lit(";base64,"), F.translate(F.base64("content"), "\r\n", ""))  # Spark cuts base64 into lines
    keyed = chapter.withColumn("_key", F.struct("book_id", "chapter_no"))
    refs = asset_refs(keyed, "_key", "href").where("kind IN ('css', 'img', 'svg')")
    found = refs.withColumn("book_id", F.col("_key.book_id")).join(files, ["book_id", "path"])
    value = F.when(F.col("kind") == "css", T.decoded(F.col("content"))).otherwise(uri)
    joined = keyed.join(_ordered(found.withColumn("value", value), "_key", "_a"), "_key", "left")
    joined = joined.withColumn("_base", F.col("href")).withColumn("_common", F.lit(""))
    if sheets is not None:
        own = sheets.join(files.withColumnRenamed("path", "href"), ["book_id", "href"])
        order = F.array_sort(F.collect_list(F.struct("item_idx", "href", T.decoded(F.col("content")).alias("css"))))
        whole = own.groupBy("book_id").agg(order.alias("s")).select("book_id", F.get("s", F.lit(0))["href"].alias("_first"), F.array_join(F.transform("s", lambda x: F.concat(x["css"], F.lit("\n"))), "").alias("_sheets"))
        joined = joined.join(whole, "book_id", "left").withColumns({"_base": F.coalesce("_first", "href"), "_common": F.coalesce("_sheets", F.lit(""))}).drop("_first", "_sheets")
    linked = F.array_join(F.transform(F.filter("_a", lambda x: x["kind"] == "css"), lambda x: F.concat(x["value"], F.lit("\n"))), "")
    joined = T.once(joined, _css=F.concat("_common", F.coalesce(linked, F.lit(""))))
    in_css = asset_refs(joined, "_key", "_base", "_css").where("kind = 'url'").withColumn("book_id", F.col("_key.book_id")).join(files, ["book_id", "path"])
    joined = joined.join(_ordered(in_css.withColumn("value", uri), "_key", "_u"), "_key", "left")

    none = lambda c: F.coalesce(c, F.filter(F.array(F.struct(F.lit("").alias("kind"), F.lit(0).alias("ref_no"), F.lit("").alias("ref"), F.lit("").alias("value"))), lambda x: F.lit(False)))

    def in_url(t: Column, x: Column) -> Column:
        whole = F.concat(F.lit('url("'), x["value"], F.lit('")'))
        for before, after in (('url("', '")'), ("url('", "')"), ("url(", ")")):
            t = F.replace(t, F.concat(F.lit(before), x["ref"], F.lit(after)), whole)
        return t

    swapped = F.aggregate(none(F.filter("_a", lambda x: x["kind"] != "css")), F.col("html"), _quoted_swap)
    bare = F.regexp_replace(swapped, STYLE_LINK, "")
    style = F.concat(F.lit("<style>"), F.aggregate(none(F.col("_u")), F.col("_css"), in_url), F.lit("</style>"))
    joined = T.once(joined, _bare=bare, _style=style)
    at = F.instr("_bare", F.lit("</head>"))
    placed = F.when(at > 0, F.concat(F.substring("_bare", F.lit(1), at - 1), "_style", F.substring("_bare", at, F.length("_bare")))).otherwise(F.concat("_style", "_bare"))
    return joined.withColumn("html", placed).select(*chapter.columns)


def header_text(title: Column, author: Column, source: Column, day: str) -> Column:
    """The head of a text file: rules, title, author if known, source and day."""
    rule = F.lit("=" * 60)
    titled = F.concat(F.lit("  "), F.coalesce(F.nullif(title, F.lit("")), F.lit("(Untitled)")))
    lines = F.array(rule, titled, F.concat(F.lit("  by "), F.nullif(author, F.lit(""))), rule, F.concat(F.lit("  Converted from "), source, F.lit(f" on {day}")), rule, F.lit("\n\n"))
    return F.array_join(lines, "\n")


def chapter_section(number: Column, text: Column, header: bool = True) -> Column:
    rule = "\u2550" * 60
    head = F.concat(F.lit(f"\n\n{rule}\n  Chapter "), number, F.lit(f":\n{rule}\n")) if header else F.lit("")
    return F.concat(head, F.lit("\n\n"), text, F.lit("\n"))


def page_section(number: Column, text: Column, header: bool = True) -> Column:
    rule = "\u2500" * 40
    head = F.concat(F.lit(f"\n\n{rule}\n  Page "), number, F.lit(f"\n{rule}\n")) if header else F.lit("")
    return F.concat(head, F.lit("\n\n"), text, F.lit("\n"))


def book_texts(sections: DataFrame, key: str = "book_id", number: str = "chapter_no", text: str = "text", header: bool = True, section: Callable[[Column, Column, bool], Column] = chapter_section) -> DataFrame:
    """(key, n_sections, n_chars, text): sections of at least two characters, in order of their numbers, as ``section`` writes them (chapters or pages)."""
    # Past the generator no filter is pushed, so the text is made once.
    once = T.once(sections.select(key, F.col(number).alias("n"), F.col(text).alias("_t")), t=F.col("_t"), c=T.utf16_length(F.col("_t")))
    kept = once.where("c >= 2").select(key, "n", "c", section(F.col("n"), F.col("t"), header).alias("s"))
    grouped = kept.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("n", "s"))).alias("p"), F.sum("c").cast("long").alias("n_chars"))
    return grouped.select(key, F.size("p").alias("n_sections"), "n_chars", F.array_join(F.transform("p", lambda x: x["s"]), "").alias("text"))


def batches(df: DataFrame, size: int, order: str, *key: str) -> DataFrame:
    """df with batch_no: consecutive rows by ``order`` in groups of ``size``; the last one may be smaller."""
    return df.withColumn("batch_no", F.floor((F.row_number().over(Window.partitionBy(*key).orderBy(order)) - 1) / size).cast("int"))


def size_label(n_bytes: Column) -> Column:
    """MB with two decimals above 1,048,576 bytes, else whole KB."""
    return F.when(n_bytes > 1_048_576, F.concat(F.format_string("%.2f", n_bytes / 1_048_576), F.lit(" MB"))).otherwise(F.concat(F.format_string("%.0f", n_bytes / 1024), F.lit(" KB")))
