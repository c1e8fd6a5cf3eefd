"""Golden cases of the document operators."""

import http.server
import base64
import io
import json
import threading
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillstream import __main__ as cli
from quillstream.functions import text as T
from quillstream.operators import book, chunk, clean, html_text, pdf_text, progress, structure, translate
from quillstream.plans import pipeline
from quillstream.sources import epub, texts, web
from quillstream.streaming import clean_stream

EQ = "=" * 60
RULES = clean.compile_rules(clean.DEFAULT_RULES)


def one(spark, values, make):
    """make(column) over a list of texts."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.out for r in df.select("i", make(F.col("v")).alias("out")).orderBy("i").collect()]


def framed(spark, values, make):
    """make(df with column v) over a list of texts; its column out."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.out for r in make(df).orderBy("i").select("out").collect()]


HTML = [
    ("<html><head><title>T</title></head><body><h1>a &amp; b</h1><p>x<br/>y</p></body></html>", f"{EQ}\nA & B\n{EQ}\n\nx\ny"),
    ("<h1>caf&eacute;</h1>", f"{EQ}\nCAF&EACUTE;\n{EQ}"),
    ("<ul><li>a</li><li>b</li></ul>", "• a\n• b"),
    ("<table><tr><td>1</td><td>2</td></tr><tr><th>x</th></tr></table>", "1 | 2\nx"),
    ('<img src="a" alt="cat">', "[Image: cat]"), ('<img alt="">', "[Image]"), ("<img>", "[Image]"),
    ("<!-- <b>x</b> -->", "x -->"), ("<b>a</b><i>b</i>", "ab"), ("<h2>q</h2>z", "-" * 40 + "\nq\n" + "-" * 40 + "\n\nz"), ("<h3> t </h3>", "### t"),
    ("<h4>a</h5>b", "a\n\nb"), ("a<hr/>b", "a\n" + "─" * 40 + "\nb"), ("<script>x</script><style >y</style>k", "k"), ("a\n\n\n\n\n\nb", "a\n\n\nb"), (None, None), ("", ""), ("<pre>c</pre>", "c"),
    ("<h1>straße</h1>", f"{EQ}\nSTRASSE\n{EQ}"),
]


def test_html_to_text(spark):
    got = framed(spark, [h for h, _ in HTML], lambda df: html_text.html_to_text(df, "v", "out"))
    assert got == [t for _, t in HTML]


def test_entities(spark):
    texts = ["&amp;&lt;&#65;&#x42;&Eacute;", "a &amp", "&ampx; &ampamp; &copy 1 &#65 &AMP", "&amp;copy;", "&MIDDOT; &none; &;", None]
    assert one(spark, texts, T.decode_entities) == ["&<ABÉ", "a &", "&x; &amp; © 1 A &", "&copy;", "&MIDDOT; &none; &;", None]
    assert one(spark, texts, T.decode_closed_entities) == ["&<ABÉ", *texts[1:3], "&copy;", *texts[4:]]


def test_titles(spark):
    pages = ["<title> A &amp; B </title>", "<title></title><h2>x</h2>", "<p>none</p>", "<H3 class='q'>h<b>i</b></H3>", None]
    assert framed(spark, pages, lambda df: html_text.chapter_title(df, "v", "out")) == ["A & B", "x", None, "hi", None]


def test_scrape_clean(spark):
    got = one(spark, ["&amp;lt;b&amp;gt;", "&#128512;", "a<br>b</p>c<sent x>d</sent>", "x(adsbygoogle = 1);y", "a\n\n\n\nb&nbsp;", "&#65;&#66;"], html_text.scrape_clean)
    assert got == ["<b>", "", "a\nb\ncd", "xy", "a\n\nb", "AB"]
    pages = ["<div id='showReading'>one<br>two</div>", "<div id=\"chaptercontent\"> </div>", "<p>none</p>"]
    assert framed(spark, pages, lambda df: html_text.scraped_chapters(df, "v", out="out")) == ["one\ntwo", None, None]


def test_sanitize(spark):
    got = framed(spark, ["é", "x́", "a\xa0b", "a​b", "a\x07b\tc", "─█★k", None], lambda df: clean.sanitize(df, "v", "out"))
    assert got == ["é", "x", "a b", "ab", "ab\tc", "k", None]


BLOCK = clean.DEFAULT_RULES["blocks"][0]["text"]
CLEAN = [
    ("ps: hi", ""), ("Astronomía Astronomía flotanteflotante", ""), ("a   b", "a b"), ("A" + BLOCK + "B", "AB"), ("a\n\n\n\n\n\nb", "a\n\n\nb"), ("• item", ""), ("keep\n  PD: x\nthis", "keep\nthis"),
    ("¡GRACIAS ~\nok", "ok"), ("please write a long REVIEW", ""), (None, None), ("", ""), ("INFÓRMENOS no", "INFÓRMENOS no"),
    ("¡INFÓRMENOS si encuentra algÚn error para que podamos solucionarlo lo antes posible!", ""),
]


def test_clean(spark):
    assert framed(spark, [a for a, _ in CLEAN], lambda df: clean.clean_text(df, RULES, "v", "out")) == [b for _, b in CLEAN]


def test_rule_counts(spark):
    df = spark.createDataFrame([("ps: a\nps: b\nx  y  z",), ("Astronomía Astronomía flotanteflotante",), (BLOCK + BLOCK,)], "text string")
    got = {r.label: r["count"] for r in clean.rule_counts(df, RULES).collect()}
    assert (got["PS: lines"], got["Double spaces"], got["Astronomía flotante"], got["Novelupdate rating request"], got["Ko-fi promotions"]) == (2, 2, 2, 2, 0)
    assert {r.label: r["count"] for r in clean.sanitize_counts(spark.createDataFrame([("a\xa0​​b",)], "text string")).collect()}["Zero-width / formatting chars"] == 2


def test_user_rules(spark):
    rules = clean.compile_rules(json.dumps({"_comment": "x", "linePatterns": [{"pattern": "^end$"}], "replacements": [{"find": "(a)(b)?", "replaceWith": "[$1$$$&]", "regex": True, "flags": "i"}, {"find": "x.y", "regex": True}, {"find": "aa", "replaceWith": "a!!"}]}))
    assert [r.label for r in rules] == ["^end$", "(a)(b)?", "x.y", "aa"] and rules[1].groups == 2
    with pytest.raises(ValueError):
        clean.compile_rules({"replacements": [{"find": "a", "replaceWith": "ba"}]})
    with pytest.raises(ValueError):
        clean.compile_rules({"linePatterns": [{"pattern": "a", "flags": "y"}]})
    assert framed(spark, ["end\nend \nab ab\nx-yz"], lambda df: clean.clean_text(df, rules[:3], "v", "out")) == ["end \n[a$ab] ab\nz"]
    fixed = lambda find: lambda df: clean.fixpoint(df.withColumn("out", F.col("v")), "out", find)
    assert framed(spark, ["aaab", "b", None], fixed("aa")) == ["ab", "b", None]
    assert framed(spark, ["a" * 5, "a" * 1000 + "b" * 1000 + "!"], fixed("ab")) == ["aaaaa", "!"]


def literal_witness(line, find, into):
    n = 0
    while find in line:
        line, n = line.replace(find, into, 1), n + 1
    return line, n


LITERALS = [("--", "-"), ("teh", "the"), ("ab", ""), ("aba", "b"), ("xx", "yy"), ("(())", "")]


@pytest.mark.parametrize("find,into", LITERALS)
def test_literals(spark, find, into):
    """Literals that overlap themselves, keep the length or nest deeply, with their counts, against a plain loop."""
    lines = ["-" * 9, "a -- b --- c", "teh tteh teteh", "ababababa", "xxxxx", "a" * 1000 + "b" * 1000, "(" * 40 + ")" * 40, "", "plain"]
    rules = clean.compile_rules({"replacements": [{"label": "l", "find": find, "replaceWith": into}]})
    want = [literal_witness(x, find, into) for x in lines]
    assert framed(spark, ["\n".join(lines), None], lambda df: clean.clean_text(df, rules, "v", "out")) == ["\n".join(x for x, _ in want), None]
    df = spark.createDataFrame([("\n".join(lines),), (None,)], "text string")
    assert [r["count"] for r in clean.rule_counts(df, rules).collect()] == [sum(n for _, n in want)]


def test_settle_in_pieces():
    """More texts than a piece holds, in a slice, with nulls: against the plain loop."""
    texts = [None if i % 7 == 3 else "-" * (i % 9) + "x" for i in range(3 * clean.PIECE)]
    after, n = clean._settle(pa.array(texts, pa.string()).slice(5), "--", "-")
    want = [(None, 0) if t is None else literal_witness(t, "--", "-") for t in texts[5:]]
    assert list(zip(after.to_pylist(), n.tolist())) == want


def test_sanitize_without_python(spark):
    df = clean.sanitize(spark.createDataFrame([("e\u0301",)], "v string"), "v", "out")
    assert "Python" not in df._jdf.queryExecution().toString() and df.first().out == "\u00e9"


def test_translate_in_arrow_pieces(spark):
    chunks = spark.range(3 * translate.PIECE).select(F.col("id").alias("doc_id"), F.lit(0).alias("chunk_idx"), F.concat(F.lit("a"), "id").alias("chunk")).coalesce(1)
    got = translate.translate_chunks(chunks, lambda: str.upper)
    assert "MapInArrow" in got._jdf.queryExecution().toString()
    assert [r.translated for r in got.orderBy("doc_id").collect()] == [f"A{i}" for i in range(3 * translate.PIECE)]


def test_java_pattern(spark):
    cases = [("^=+$", "====\r", False), ("^=+$", "====", True), (r"^\s+$", "﻿ ", True), ("a.b", "a\u0085b", True), ("a.b", "a b", False), ("[a[]", "[", True), ("[&&x]", "&", True)]
    for pattern, text, want in cases:
        assert one(spark, [text], lambda c, p=pattern: F.rlike(c, F.lit(T.java_pattern(p)))) == [want], pattern


def test_chunks(spark):
    assert one(spark, ["Hi. yo", "aa", None, ""], lambda c: chunk.llm_chunks(c, 3)) == [["Hi."], ["aa"], None, []]
    assert one(spark, ["aa\n\nbb\n\ncccccc"], lambda c: chunk.llm_chunks(c, 10)) == [["aa\n\nbb", "cccccc"]]
    assert one(spark, ["One. Two! Three? four"], lambda c: chunk.web_chunks(c, 9)) == [["One.", "Two!", "Three?"]]
    assert one(spark, ["One. Two! Three? four"], lambda c: chunk.web_chunks(c, 9, lossless=True)) == [["One.", "Two!", "Three?", "four"]]
    assert one(spark, ["😀"], T.utf16_length) == [2]
    assert one(spark, ["=== ─#", "══", " ", "x"], chunk.is_structural) == [True, False, True, False]
    assert one(spark, ["══"], lambda c: chunk.is_structural(c, chunk.STRUCTURAL_LLM)) == [True]


def kinds(spark, text):
    df = structure.classify_lines(spark.createDataFrame([(1, text)], "k int, text string"), "text", "k")
    return [(r.type, r.text) for r in df.orderBy("line_no").collect()]


def test_classify(spark):
    assert kinds(spark, f"{EQ}\n T\n{EQ}") == [("separator", ""), ("h1", "T"), ("separator", "")]
    assert kinds(spark, "----------\nx \n----------") == [("separator", ""), ("h2", "x"), ("separator", "")]
    assert kinds(spark, "----------") == [("separator", "")]
    assert kinds(spark, f"- a\n-5 a\n{'═' * 60}\n### x\n[Image: c]\n \t\nbody ") == [("bullet", "a"), ("body", "-5 a"), ("body", "═" * 60), ("h3", "x"), ("image-placeholder", "[Image: c]"), ("empty", ""), ("body", "body ")]
    assert kinds(spark, "==========\r\nx\n==========\r")[1] == ("body", "x")


def test_empty_runs_and_titles(spark):
    df = structure.classify_lines(spark.createDataFrame([(1, "a\n\n\n----------\n\nb\n\n")], "k int, text string"), "text", "k")
    got = [r.rendered for r in structure.styled(structure.rendered(df, "k")).orderBy("line_no").collect()]
    assert got == [True, True, True, False, False, True, True, True]
    titles = one(spark, ["\n====\n  Title " + "x" * 200, "==\n--", "\n" * 10 + "late"], lambda c: structure.doc_title(c, F.lit("file")))
    assert titles == ["Title " + "x" * 94, "file", "file"]


def test_pdf_items(spark):
    def page(*items):
        rows = [(1, 0, i, *x) for i, x in enumerate(items)]
        df = spark.createDataFrame(rows, "doc_id int, page int, item_idx int, str string, x double, y double, width double, has_eol boolean")
        return pdf_text.page_texts(df).first().text

    assert page(("Hello", 0.0, 700.0, 30.0, False), ("world", 35.0, 700.0, 20.0, False)) == "Hello world"
    assert page(("Hello", 0.0, 700.0, 30.0, False), ("world", 35.0, 690.0, 20.0, False)) == "Hello\nworld"
    assert page(("a ", 0.0, 700.0, 10.0, False), ("", 10.0, 700.0, 0.0, False), ("b", 30.0, 700.0, None, True), (None, 0.0, 0.0, 0.0, True), ("c", 90.0, 100.0, 1.0, False)) == "a b\nc"


def test_progress(spark):
    df = spark.createDataFrame([('{"totalChunks":3,"completedChunks":2,"translated":["x",null,"z"],"k":1}',), ("bad",), ('{"translated":[]}',), ('{"translated":["[TRANSLATION FAILED]\\nq"]}',)], "json string")
    df = df.select(progress.parse_progress(F.col("json")).alias("record"))
    r = F.col("record")
    assert [tuple(x) for x in df.select(progress.partial_text(r), progress.final_text(r)).collect()] == [("x\n\nz", "x\n\n\n\nz"), (None, None), (None, ""), ("[TRANSLATION FAILED]\nq",) * 2]
    stats = [(x.total, x.completed, x.done, x.failed, x.pct) for x in progress.progress_stats(df).collect()]
    assert stats == [(3, 2, 2, 0, "66.7"), (0, 0, 0, 0, "0.0"), (0, 0, 0, 0, "0.0"), (1, 0, 1, 1, "100.0")]
    assert one(spark, ["d/.b_translate_progress.json", ".b_ai_ES_progress.json", "x.json"], progress.partial_name) == ["d/b_partial.txt", "b_partial.txt", "x_partial.txt"]
    assert one(spark, ["a/b.txt", "a.d/b", "b.c.txt"], lambda c: progress.with_suffix(c, "_cleaned")) == ["a/b_cleaned.txt", "a.d/b_cleaned", "b.c_cleaned.txt"]


def test_paths(spark):
    df = spark.createDataFrame([("OEBPS/content.opf", "../img/a.png"), ("c.opf", "a.html"), ("a/b.opf", "../../x"), ("a/b", "./c/../d")], "b string, h string")
    assert [r[0] for r in df.select(book.resolve_href(F.col("b"), F.col("h"))).collect()] == ["img/a.png", "a.html", "x", "a/d"]
    assert one(spark, ["A.TIF", "x.bin", "noext", "a.b/c"], book.media_type) == ["image/tiff", "application/octet-stream", "application/octet-stream", "application/octet-stream"]
    assert one(spark, ["a.PDF", "b.epub", "c.txt"], texts.source_kind) == ["pdf", "epub", None]
    assert one(spark, ["500", "1048577"], lambda c: book.size_label(c.cast("long"))) == ["0 KB", "1.00 MB"]


def test_languages(spark):
    assert one(spark, ["es", "ZH", "xx"], book.language_name) == ["Spanish", "Chinese", "xx"]


def test_header(spark):
    assert one(spark, ["T"], lambda c: book.header_text(c, F.lit(None).cast("string"), F.lit("b.epub"), "2024-01-01")) == [f"{EQ}\n  T\n{EQ}\n  Converted from b.epub on 2024-01-01\n{EQ}\n\n\n"]
    assert one(spark, [None], lambda c: book.header_text(c, F.lit("A"), F.lit("s"), "d"))[0].startswith(f"{EQ}\n  (Untitled)\n  by A\n")


def archive(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


OPF = """<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>Book</dc:title><dc:creator>Ann</dc:creator></metadata>
<manifest><item id="a" href="old.xhtml" media-type="application/xhtml+xml"/><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/><item id="b" href="b.xhtml" media-type="application/xhtml+xml"/><item id="m" href="missing.xhtml" media-type="application/xhtml+xml"/><item id="s" href="s.css" media-type="text/css"/></manifest>
<spine><itemref idref="a"/><itemref idref="m"/><itemref idref="zz"/><itemref idref="b"/></spine></package>"""
CONTAINER = '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/c.opf"/></rootfiles></container>'


def test_epub(spark, tmp_path):
    good = archive({"META-INF/container.xml": CONTAINER, "OEBPS/c.opf": OPF, "OEBPS/a.xhtml": '<html><head><link rel="stylesheet" href="s.css"/></head><h1>One</h1><img src="i.png"></html>', "OEBPS/b.xhtml": "<p>Two words</p>", "OEBPS/s.css": "p{}b{background:url(i.png)}", "OEBPS/i.png": b"\x01\x02"})
    (tmp_path / "good.epub").write_bytes(good)
    (tmp_path / "bad.epub").write_bytes(archive({"x": "y"}))
    books = epub.archives(spark, str(tmp_path))
    found = epub.packages(books)
    assert sorted(((r.title, r.author, r.error) for r in found.collect()), key=str) == sorted([("Book", "Ann", None), (None, None, "no META-INF/container.xml")], key=str)
    order = book.reading_order(epub.spine(found), epub.manifest(found))
    assert [(r.chapter_no, r.href) for r in order.orderBy("chapter_no").collect()] == [(1, "OEBPS/a.xhtml"), (2, "OEBPS/missing.xhtml"), (3, "OEBPS/b.xhtml")]
    entries = epub.zip_entries(books)
    chapters = book.chapters(order, entries)
    inlined = {r.chapter_no: r.html for r in book.inline_assets(chapters, entries).collect()}
    assert 'src="data:image/png;base64,AQI="' in inlined[1] and '<style>p{}b{background:url("data:image/png;base64,AQI=")}\n</style></head>' in inlined[1] and "<link" not in inlined[1]
    assert inlined[3] == "<style></style><p>Two words</p>"
    styled = {r.chapter_no: r.html for r in book.inline_assets(chapters, entries, book.style_sheets(epub.manifest(found))).collect()}
    assert styled[3] == '<style>p{}b{background:url("data:image/png;base64,AQI=")}\n</style><p>Two words</p>'
    whole = pipeline.convert_books(spark, str(tmp_path), "2024-01-01").collect()
    assert len(whole) == 1 and whole[0].text.startswith(f"{EQ}\n  Book\n  by Ann\n{EQ}\n  Converted from good.epub on 2024-01-01\n")
    assert pipeline.convert_books(spark, str(tmp_path), "d", RULES, lambda: str.lower, sections=False).first().text.endswith("two words")
    text = book.book_texts(html_text.html_to_text(chapters)).first()
    assert text.n_sections == 2 and "Chapter 3:" in text.text and text.text.index("ONE") < text.text.index("Two words")
    assert book.style_sheets(epub.manifest(found)).count() == 1


def test_epub_binary_entries(spark, tmp_path):
    """Images that are no UTF-8 and a chapter with a Latin-1 byte."""
    png = bytes.fromhex("89504e470d0a1a0a0000000d49484452") + bytes(range(256))
    files = {"META-INF/container.xml": CONTAINER, "OEBPS/c.opf": OPF, "OEBPS/a.xhtml": '<h1>One</h1><img src="i.png">', "OEBPS/b.xhtml": b"<p>caf\xe9 au lait</p>", "OEBPS/s.css": b"b{} /* \xe9 */", "OEBPS/i.png": png, "OEBPS/f.woff": png}
    (tmp_path / "good.epub").write_bytes(archive(files))
    (tmp_path / "bad.epub").write_bytes(b"no archive")
    whole = pipeline.convert_books(spark, str(tmp_path), "2024-01-01").collect()
    assert len(whole) == 1 and "caf\ufffd au lait" in whole[0].text
    books = epub.archives(spark, str(tmp_path))
    assert {r.path for r in epub.zip_entries(books, chapters_only=True).collect()} == {"OEBPS/a.xhtml", "OEBPS/b.xhtml"}
    found = epub.packages(books).where("error IS NULL")
    order = book.reading_order(epub.spine(found), epub.manifest(found))
    entries = epub.zip_entries(books)
    inlined = {r.chapter_no: r.html for r in book.inline_assets(book.chapters(order, entries), entries, book.style_sheets(epub.manifest(found))).collect()}
    assert base64.b64encode(png).decode() in inlined[1] and "b{} /* \ufffd */" in inlined[3]


def test_page_sections(spark):
    df = spark.createDataFrame([(1, 2, "second"), (1, 1, "first page"), (1, 3, "x")], "book_id int, page int, text string")
    got = book.book_texts(df, number="page", section=book.page_section).first()
    rule = "\u2500" * 40
    assert (got.n_sections, got.n_chars) == (2, 16) and got.text.startswith(f"\n\n{rule}\n  Page 1\n{rule}\n\n\nfirst page\n")


def test_batches(spark):
    df = spark.range(45).withColumn("k", F.lit(1))
    assert [r["count"] for r in book.batches(df, 20, "id", "k").groupBy("batch_no").count().orderBy("batch_no").collect()] == [20, 20, 5]


def flaky():
    seen = {}

    def run(text):
        seen[text] = seen.get(text, 0) + 1
        if text == "never" or (text == "once" and seen[text] == 1):
            raise RuntimeError
        return text.upper()

    return run


def test_translate_and_resume(spark):
    chunks = spark.createDataFrame([(1, 0, "a"), (1, 1, "===="), (1, 2, "never"), (1, 3, "once")], "doc_id long, chunk_idx int, chunk string")
    got = translate.translate_chunks(chunks, flaky, retries=2).cache()
    assert [(r.translated, r.status) for r in got.orderBy("chunk_idx").collect()] == [("A", "done"), ("====", "passed"), (progress.FAILED + "\nnever", "failed"), ("ONCE", "done")]
    assert tuple(translate.assemble(got).first()) == (1, f"A\n\n====\n\n{progress.FAILED}\nnever\n\nONCE", 1)
    changed = spark.createDataFrame([(1, 0, "a"), (1, 1, "new"), (1, 2, "never")], "doc_id long, chunk_idx int, chunk string")
    assert sorted(r.chunk for r in translate.pending(changed, got).collect()) == ["never", "new"]


def test_resume_on_disk(spark, tmp_path):
    chunks = spark.createDataFrame([(1, 0, "a"), (1, 1, "never")], "doc_id long, chunk_idx int, chunk string")
    path = str(tmp_path / "done")
    assert sorted(r.status for r in translate.translate_resumably(chunks, path, flaky, retries=1).collect()) == ["done", "failed"]
    again = translate.translate_resumably(chunks, path, lambda: str.title, retries=1).orderBy("chunk_idx").collect()
    assert [(r.translated, r.status) for r in again] == [("A", "done"), ("Never", "done")]


def test_web(spark):
    numbers = web.chapter_numbers(spark, 1, 12)
    assert [r.n for r in numbers.where("batch_no = 2").orderBy("n").collect()] == [11, 12] and web.chapter_numbers(spark).count() == 384

    def make():
        def fetch(n):
            if n == 2:
                raise OSError
            return f"<div id='showReading'>c{n}</div>"

        return fetch

    got = html_text.scraped_chapters(web.fetch_chapters(numbers.where("n < 4"), make, wait=lambda a: 0.0))
    assert {r.n: r.text for r in got.collect()} == {1: "c1", 2: None, 3: "c3"}


def test_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.txt").write_text("keep  this\r\nps: gone\nx​y\n")
    with pytest.raises(ValueError, match="several lines"):
        clean_stream.clean_lines_stream(clean_stream.read_lines(spark, str(source)), RULES)
    stream = clean_stream.clean_lines_stream(clean_stream.read_lines(spark, str(source)), RULES, skip_blocks=True)
    query = clean_stream.write_lines(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["keep this", "xy"]


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("é\r\nb\n".encode())
    (tmp_path / "rules.json").write_text(json.dumps(clean.DEFAULT_RULES))
    assert texts.whole_texts(spark, str(tmp_path / "a.txt")).first().text == "é\r\nb\n"
    assert [r.line for r in texts.text_lines(spark, str(tmp_path / "a.txt")).collect()] == ["é", "b"]
    assert clean.compile_rules(texts.rules_text(spark, str(tmp_path / "rules.json"))) == RULES
    texts.write_texts(spark.createDataFrame([("q",)], "text string"), str(tmp_path / "o"))
    assert spark.read.text(str(tmp_path / "o")).first().value == "q"


def test_pipeline(spark):
    pages = spark.createDataFrame([(1, "<h1>t</h1><ul><li>gone</li></ul><p>a  b</p>"), (2, None)], "page_id long, html string")
    got = {r.page_id: r.text for r in pipeline.pipeline(pages, "page_id", RULES).collect()}
    assert got == {1: f"{EQ}\nT\n{EQ}\n\n\na b", 2: None}
    shouted = pipeline.pipeline(pages.where("page_id = 1"), "page_id", RULES, lambda: str.lower).first().text
    assert shouted == f"{EQ}\nt\n{EQ}\n\na b"
    assert pipeline.layout(spark.createDataFrame([(1, "a")], "k int, text string"), "k").first().type == "body"


def test_command_line(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("# x\nps: gone\nkeep  it")
    args = cli.parser().parse_args(["clean", str(tmp_path / "in"), str(tmp_path / "out")])
    got = cli.run(spark, args).first()
    assert got.path.endswith("in/a_cleaned.txt") and got.text == "# x\nkeep it"
    assert cli.run(spark, cli.parser().parse_args(["layout", str(tmp_path / "in"), "o"])).count() == 3
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / ".b_translate_progress.json").write_text('{"translated":["a",null]}')
    got = cli.run(spark, cli.parser().parse_args(["partial", str(tmp_path / "p" / ".b_translate_progress.json"), "o"])).first()
    assert got.path.endswith("p/b_partial.txt") and got.text == "a"


def test_chat_translator(spark):
    class Handler(http.server.BaseHTTPRequestHandler):
        def answer(self, body):
            data = json.dumps(body).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self):
            self.answer({"data": [{"id": "m1"}, {"id": "m2"}]})

        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            self.answer({"choices": [{"message": {"content": f" {asked['model']}:{asked['messages'][1]['content']} "}}]})

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/v1"
    model = translate.default_model(translate.server_models(url))
    chunks = spark.createDataFrame([(1, 0, "hola")], "doc_id long, chunk_idx int, chunk string")
    assert translate.translate_chunks(chunks, translate.chat_translator(url, model, "English")).first().translated == "m1:hola"
    server.shutdown()
