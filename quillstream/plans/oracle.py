"""DuckDB SQL of the registered queries, written apart from the Spark expressions."""

from __future__ import annotations

from quillstream.operators import book, clean

#: Noise added to every document by its id, so that the cleaning operators have something to clean: (modulus, remainder, text).
OVERLAY = [
    (2, 0, "\nSupport me on patreon.com/x"),
    (3, 0, "\nps: note"),
    (5, 0, "\nThank you ~"),
    (7, 0, "\n  • item"),
    (11, 0, "\nnon\xa0breaking zero​width bell\u0007 é x́  double   spaces"),
    (13, 0, "\n" + "═" * 12 + "★"),
    (17, 0, "\nbefore " + clean.DEFAULT_RULES["blocks"][0]["text"] + " after"),
    (19, 0, "\nAstronomía Astronomía flotanteflotante"),
    (23, 0, "\n\n\n\n\n\nfar"),
    (6, 1, "\n" + "=" * 12 + "\nBoxed Title\n" + "=" * 12 + "\n" + "-" * 12 + "\n Second \n" + "-" * 12),
    (9, 2, "\n###  Third\n[Image: cat]\n──────────\n　- dash\n \n\n\n\n\t\nend"),
]

WS = "\t\n\x0b\x0c\r \xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　﻿"
CLS = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def trim(x: str) -> str:
    return f"trim({x}, {q(WS)})"


def rep(x: str, pattern: str, into: str) -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(into)}, 'g')"


def chain(x: str, *steps: tuple[str, str]) -> str:
    for pattern, into in steps:
        x = rep(x, pattern, into)
    return x


def calls(x: str, pattern: str, made: str) -> str:
    """x with matches replaced by the SQL expression ``made`` of their first group m."""
    found = f"list_transform(regexp_extract_all({x}, {q(pattern)}, 1), lambda m: {made})"
    return f"list_reduce(list_transform(list_zip(string_split_regex({x}, {q(pattern)}), {found}), lambda z: z[1] || coalesce(z[2], '')), lambda a, b: a || b)"


def staged(source: str, key: str, column: str, steps: list[str]) -> str:
    """Nested selects, each computing t from the t before."""
    sql = f"SELECT {key}, {column} AS t FROM {source}"
    for s in steps:
        sql = f"SELECT {key}, {s} AS t FROM ({sql})"
    return sql


NOISY = "noisy AS (SELECT doc_id, text || " + " || ".join(f"CASE WHEN doc_id % {m} = {r} THEN {q(t)} ELSE '' END" for m, r, t in OVERLAY) + " AS text FROM documents)"

_strip = trim(rep("m", "<[^>]*>", ""))
_upper = f"upper(replace({_strip}, 'ß', 'ss'))"
_blocks = "p|div|blockquote|section|article|aside|figure|figcaption"
_cells = f"array_to_string(list_transform(regexp_extract_all(m, {q('(?is)<t[dh][^>]*>(.*?)</t[dh]>')}, 1), lambda c: {trim(rep('c', '<[^>]*>', ''))}), ' | ') || {q(chr(10))}"


def _boxed(rule: str, inner: str) -> str:
    return f"{q(chr(10) + rule + chr(10))} || {inner} || {q(chr(10) + rule + chr(10) * 2)}"


def entities(x: str) -> str:
    for a, b in (("&quot;", '"'), ("&QUOT;", '"'), ("&copy;", "©"), ("&COPY;", "©"), ("&middot;", "·"), ("&AMP;", "&"), ("&amp;", "&")):
        x = f"replace({x}, {q(a)}, {q(b)})"
    return x


_tidy = trim(chain("t", ("[ \\t]+", " "), (" *\\n *", "\n"), ("\\n{4,}", "\n\n\n")))
HTML_STEPS = [
    chain("t", ("(?is)<head[\\s>].*?</head>", ""), ("(?is)<script[\\s>].*?</script>", ""), ("(?is)<style[\\s>].*?</style>", "")),
    calls("t", "(?is)<h1[^>]*>(.*?)</h1>", _boxed("=" * 60, _upper)),
    calls("t", "(?is)<h2[^>]*>(.*?)</h2>", _boxed("-" * 40, _strip)),
    calls("t", "(?is)<h3[^>]*>(.*?)</h3>", f"{q(chr(10) + '### ')} || {_strip} || {q(chr(10) * 2)}"),
    calls("t", "(?is)<h[4-6][^>]*>(.*?)</h[4-6]>", f"{q(chr(10))} || {_strip} || {q(chr(10) * 2)}"),
    chain("t", ("(?i)<hr[^>]*/?>", "\n" + "─" * 40 + "\n"), ("(?i)<br\\s*/?>", "\n"), (f"(?i)</({_blocks})>", "\n\n"), (f"(?i)<({_blocks})[^>]*>", "")),
    calls("t", "(?is)<li[^>]*>(.*?)</li>", f"'  • ' || {_strip} || {q(chr(10))}"),
    chain("t", ("(?i)</(ul|ol)>", "\n"), ("(?i)<(ul|ol)[^>]*>", "\n")),
    calls("t", "(?is)<tr[^>]*>(.*?)</tr>", _cells),
    chain("t", ("(?i)<img[^>]*alt=[\"'][\"'][^>]*/?>", "[Image]"), ("(?i)<img[^>]*alt=[\"']([^\"']*)[\"'][^>]*/?>", "[Image: \\1]"), ("(?i)<img[^>]*/?>", "[Image]"), ("<[^>]*>", "")),
    entities("t"),
    _tidy,
]
HTML_TEXT = staged("pages", "page_id", "html", HTML_STEPS)

_SANITIZE = [
    "[\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{202F}\\x{205F}\\x{3000}]", "[\\x{200B}-\\x{200F}\\x{2028}\\x{2029}\\x{2060}-\\x{206F}\\x{FEFF}]", "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x{7F}-\\x{9F}]",
    "[\\x{0300}-\\x{036F}\\x{1AB0}-\\x{1AFF}\\x{1DC0}-\\x{1DFF}\\x{20D0}-\\x{20FF}\\x{FE20}-\\x{FE2F}]", "[\\x{2500}-\\x{25FF}]", "[\\x{2600}-\\x{27BF}]",
]
_INTO = [" ", "", "", "", "", ""]


def sanitized(x: str, upto: int = 6) -> str:
    return chain(f"nfc_normalize({x})", *zip(_SANITIZE[:upto], _INTO[:upto]))


_BLOCK, _ASTRO = clean.DEFAULT_RULES["blocks"][0]["text"], "Astronomía flotante"


def fixed(x: str, find: str) -> str:
    """x with find removed eight times over."""
    for _ in range(8):
        x = f"replace({x}, {q(find)}, '')"
    return x


_LINES = [
    "(?i)rate this novel at Novelupdate", "(?i)Please report us if you find any errors so we can fix it asap!", "(?i)¡Infórmenos si encuentra algún error para que podamos solucionarlo lo antes posible!",
    "(?i)patreon\\.com", "(?i)ko-fi\\.com", "(?i)support me (on|at|by)", "(?i)join (my|our|the) discord", "(?i)please (leave|give|write)[^\\n\\r\\x{2028}\\x{2029}]*review",
    f"^[{CLS}]*•", f"(?i)^[{CLS}]*Thank you[{CLS}]*~", f"(?i)^[{CLS}]*PS:", f"(?i)^[{CLS}]*¡Gracias[{CLS}]*~", f"(?i)^[{CLS}]*PD:",
]
_first = "CASE " + " ".join(f"WHEN regexp_matches(l, {q(p)}) THEN {k}" for k, p in enumerate(_LINES)) + " ELSE -1 END"
CLEANED = f"""sane AS (SELECT doc_id, {sanitized('text')} AS t FROM noisy),
blocked AS (SELECT doc_id, t AS before, {fixed('t', _BLOCK)} AS t FROM sane),
lined AS (SELECT doc_id, before, t, list_transform(string_split(t, {q(chr(10))}), lambda l: {{'l': l, 'k': {_first}}}) AS ls FROM blocked),
kept AS (SELECT doc_id, ls, list_transform(list_filter(ls, lambda x: x.k = -1), lambda x: x.l) AS keep FROM lined),
cleaned AS (SELECT doc_id, regexp_replace(array_to_string(list_transform(keep, lambda l: regexp_replace({fixed('l', _ASTRO)}, '  +', ' ', 'g')), {q(chr(10))}), '\\n{{4,}}', {q(chr(10) * 3)}, 'g') AS text FROM kept)"""


def _chunked(source: str, limit: int, slack: int, web: bool) -> str:
    """(doc_id, chunks) by a fold over structs (k, s, done, cur)."""
    sent = "CASE WHEN len(regexp_extract_all(p, '[^.!?]+[.!?]+[" + CLS + "]*')) > 0 THEN regexp_extract_all(p, '[^.!?]+[.!?]+[" + CLS + "]*') ELSE [p] END"
    if web:
        sent = f"list_filter(list_transform({sent}, lambda s: {trim('s')}), lambda s: s <> '')"
    token = lambda k, s: f"{{'k': {k}, 's': {s}, 'done': CAST([] AS VARCHAR[]), 'cur': ''}}"
    tokens = f"flatten(list_transform(string_split_regex(text, '\\n\\n+'), lambda p: CASE WHEN length(p) > {limit} THEN list_concat([{token(q('f'), q(''))}], list_transform({sent}, lambda s: {token(q('s'), 's')})) ELSE [{token(q('p'), 'p')}] END))"
    pushed = f"CASE WHEN {trim('a.cur')} <> '' THEN list_append(a.done, {trim('a.cur')}) ELSE a.done END"
    piece = f"CASE WHEN b.k = 's' THEN {'b.s' if web else trim('b.s')} ELSE b.s END"
    over = f"length(a.cur) + length(b.s) + CASE WHEN b.k = 's' THEN {slack} ELSE 2 END > {limit}"
    step = f"""{{'k': '', 's': '', 'done': CASE WHEN b.k = 'f' OR {over} THEN {pushed} ELSE a.done END,
      'cur': CASE WHEN b.k = 'f' THEN CASE WHEN {trim('a.cur')} <> '' THEN '' ELSE a.cur END WHEN {over} THEN {piece}
             ELSE a.cur || CASE WHEN a.cur = '' THEN '' WHEN b.k = 's' THEN ' ' ELSE {q(chr(10) * 2)} END || {piece} END}}"""
    return f"""(SELECT doc_id, CASE WHEN {trim('a.cur')} <> '' THEN list_append(a.done, {trim('a.cur')}) ELSE a.done END AS chunks
      FROM (SELECT doc_id, list_reduce(list_prepend({token(q(''), q(''))}, {tokens}), lambda a, b: {step}) AS a FROM {source}))"""


#: Texts with paragraphs: line ends of even documents are doubled.
PARAGRAPHS = f"paragraphs AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN replace(text, {q(chr(10))}, {q(chr(10) * 2)}) ELSE text END AS text FROM documents)"
WEB, LLM = _chunked("paragraphs", 4500, 2, True), _chunked("paragraphs", 4000, 0, False)


def _exploded(chunks: str) -> str:
    return f"SELECT doc_id, CAST(i - 1 AS INTEGER) AS chunk_idx, chunks[i] AS chunk FROM (SELECT doc_id, chunks, unnest(range(1, len(chunks) + 1)) AS i FROM {chunks})"


_marks = lambda m: q(f"^[{m}{CLS}-]+$")
#: Short lines, among them separators, as chunks to classify.
LINE_CHUNKS = f"line_chunks AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS chunk_idx, ls[i] AS chunk FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, {q(chr(10))}) AS ls FROM noisy)))"

_c = CLS
TYPED = f"""typed AS (SELECT doc_id, line_no, line, CASE
    WHEN regexp_matches(prev, '^={{10,}}$') AND regexp_matches(next, '^={{10,}}$') THEN 'h1'
    WHEN regexp_matches(prev, '^-{{10,}}$') AND regexp_matches(next, '^-{{10,}}$') THEN 'h2'
    WHEN regexp_matches(line, '^###[{_c}]+') THEN 'h3'
    WHEN regexp_matches(line, '^[=─-]{{10,}}$') THEN 'separator'
    WHEN regexp_matches(line, '^[{_c}]*[•·▪▸►-][{_c}]+') THEN 'bullet'
    WHEN regexp_matches({trim('line')}, '^\\[Image[^\\n\\r\\x{{2028}}\\x{{2029}}]*\\]$') THEN 'image-placeholder'
    WHEN {trim('line')} = '' THEN 'empty' ELSE 'body' END AS type
  FROM (SELECT doc_id, chunk_idx AS line_no, chunk AS line,
    coalesce(lag(chunk) OVER w, '') AS prev, coalesce(lead(chunk) OVER w, '') AS next FROM line_chunks WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_idx)))"""
_typed_text = f"""CASE type WHEN 'h3' THEN {trim(f"regexp_replace(line, '^###[{_c}]+', '')")} WHEN 'bullet' THEN {trim(f"regexp_replace(line, '^[{_c}]*[•·▪▸►-][{_c}]+', '')")}
  WHEN 'separator' THEN '' WHEN 'empty' THEN '' WHEN 'body' THEN line ELSE {trim('line')} END"""

#: One positioned item per word of every document.
ITEMS = f"""items AS (SELECT doc_id, 0 AS page, i AS item_idx, CASE WHEN i % 23 = 5 THEN NULL WHEN i % 29 = 3 THEN '' WHEN i % 31 = 7 THEN ws[i + 1] || ' ' ELSE ws[i + 1] END AS str,
    CAST(i % 10 * 50 AS DOUBLE) AS x, CAST(700 - 12 * (i // 10) AS DOUBLE) AS y, CAST(CASE WHEN i % 3 = 0 THEN 50 ELSE 40 END AS DOUBLE) AS width, i % 17 = 0 AS has_eol
  FROM (SELECT doc_id, ws, CAST(unnest(range(0, len(ws))) AS INTEGER) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[^ \\n]+') AS ws FROM documents)))"""
PDF = f"""WITH {ITEMS}, seen AS (SELECT *, lag(y) OVER w AS py, lag(x + width) OVER w AS pend, coalesce(lag(has_eol) OVER w, true) AS peol FROM items WHERE str IS NOT NULL WINDOW w AS (PARTITION BY doc_id ORDER BY item_idx)),
 broken AS (SELECT *, NOT peol AND abs(py - y) > 1 AS brk FROM seen),
 tails AS (SELECT *, CASE WHEN has_eol THEN 'n' WHEN str <> '' THEN right(str, 1) WHEN brk THEN 'n' END AS tail FROM broken),
 led AS (SELECT *, CASE WHEN brk THEN {q(chr(10))} WHEN NOT peol AND x - pend > 1 AND str <> '' AND left(str, 1) <> ' ' AND coalesce(last_value(tail IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY item_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') <> ' ' THEN ' ' ELSE '' END AS lead_in FROM tails),
 joined AS (SELECT doc_id, page, string_agg(lead_in || str || CASE WHEN has_eol THEN {q(chr(10))} ELSE '' END, '' ORDER BY item_idx) AS t FROM led GROUP BY ALL)
SELECT doc_id, page, {_tidy} AS text FROM joined"""

#: Progress records: every third chunk is missing, every fifth failed.
RECORDS = f"""records AS (SELECT doc_id, list_transform(chunks, lambda c, i: CASE WHEN (doc_id + i - 1) % 3 = 1 THEN NULL WHEN (doc_id + i - 1) % 5 = 2 THEN {q('[TRANSLATION FAILED]' + chr(10))} || c ELSE c END) AS translated FROM {LLM} WHERE len(chunks) > 0)"""

_manifest = """manifest AS (SELECT 'b' || (page_id % 7) AS book_id, CAST(page_id AS INTEGER) AS item_idx, 'i' || (page_id // 2) AS id, 'text/c' || page_id || '.xhtml' AS href, 'application/xhtml+xml' AS media_type FROM pages),
 spine AS (SELECT 'b' || (page_id % 7) AS book_id, CAST(page_id AS INTEGER) AS spine_idx, CASE WHEN page_id % 11 = 0 THEN 'none' ELSE 'i' || (page_id // 2) END AS idref FROM pages)"""
_names = "names AS (SELECT page_id, 'dir/.' || CASE page_id % 3 WHEN 0 THEN 'book_' || page_id || '_translate_progress.json' WHEN 1 THEN 'b_ai_ES_progress.json' ELSE 'n.' || page_id || '.txt' END AS path FROM pages)"
_hrefs = "hrefs AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'OEBPS/content.opf' WHEN 1 THEN 'c.opf' WHEN 2 THEN 'a/b/c.opf' ELSE 'x/y' END AS base, CASE page_id % 5 WHEN 0 THEN '../img/' || page_id || '.png' WHEN 1 THEN 'a.html' WHEN 2 THEN '../../x//y/.' WHEN 3 THEN './t/../u.css' ELSE '..' END AS href FROM pages)"


def resolved(base: str, href: str) -> str:
    whole = f"CASE WHEN contains({base}, '/') THEN regexp_replace({base}, '[^/]*$', '') ELSE '' END || {href}"
    return f"array_to_string(list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform(string_split({whole}, '/'), lambda p: [p])), lambda a, b: CASE WHEN b[1] = '..' THEN a[1:len(a) - 1] WHEN b[1] IN ('.', '') THEN a ELSE list_concat(a, b) END), '/')"


def mime(path: str) -> str:
    cases = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in book.MEDIA_TYPES.items())
    return f"CASE lower(regexp_extract({path}, '[^/]\\.([^./]*)$', 1)) {cases} ELSE 'application/octet-stream' END"


#: Chapters that refer to assets in every way.
ASSET_HTML = "'<link rel=\"stylesheet\" href=\"../css/s' || (page_id % 3) || '.css\"><img alt=\"x\" src=\"img/p' || page_id || '.PNG\"><img src=\"data:image/png;base64,AA\"><use xlink:href=\"#frag\"/><image xlink:href=\"../svg/a.svg\"/><img src=''q.gif''/><p style=\"background:url(bg/' || page_id || '.jpg)\">'"
_assets = f"chapters AS (SELECT page_id, 'OEBPS/text/ch' || page_id || '.xhtml' AS href, {ASSET_HTML} AS html FROM pages)"
_kinds = [("css", "(?i)<link[^>]+rel=[\"']stylesheet[\"'][^>]*href=[\"']([^\"']+)[\"'][^>]*/?>"), ("img", "(?i)<img[^>]+src=[\"']([^\"']+)[\"'][^>]*/?>"), ("svg", "(?i)xlink:href=[\"']([^\"']+)[\"']"), ("url", "(?i)url\\([\"']?([^\"')]+)[\"']?\\)")]
_refs = " UNION ALL ".join(f"SELECT page_id, href, '{k}' AS kind, unnest(range(1, len(r) + 1)) AS n, unnest(r) AS ref FROM (SELECT page_id, href, regexp_extract_all(html, {q(p)}, 1) AS r FROM chapters)" for k, p in _kinds)
_article = "(?is)<article[^>]*>(.*?)</article>"
_scrape = [("(?i)<br\\s*/?>", "\n"), ("(?i)</p>", "\n"), ("(?i)<sent[^>]*>", ""), ("(?i)</sent>", ""), ("<[^>]+>", ""), ("(?i)&nbsp;", " "), ("(?i)&amp;", "&"), ("(?i)&lt;", "<"), ("(?i)&gt;", ">"), ("(?i)&quot;", '"'), ("(?s)\\(adsbygoogle.*?\\);", ""), ("\\n{3,}", "\n\n")]
_sizes = "count(*) AS n_chunks, CAST(max(length(chunk)) AS INTEGER) AS longest, CAST(sum(length(chunk)) AS BIGINT) AS n_chars"
_rule_labels = [clean.DEFAULT_RULES["blocks"][0]["label"], *(p["label"] for p in clean.DEFAULT_RULES["linePatterns"]), *(r["label"] for r in clean.DEFAULT_RULES["replacements"])]
_rule_counts = [f"(SELECT sum((length(before) - length(t)) // {len(_BLOCK)}) FROM lined)"]
_rule_counts += [f"(SELECT sum(len(list_filter(ls, lambda x: x.k = {k}))) FROM kept)" for k in range(len(_LINES))]
_rule_counts += [
    f"(SELECT sum((length(l) - length({fixed('l', _ASTRO)})) // {len(_ASTRO)}) FROM (SELECT unnest(keep) AS l FROM kept))",
    f"(SELECT sum(len(regexp_extract_all({fixed('l', _ASTRO)}, '  +'))) FROM (SELECT unnest(keep) AS l FROM kept))",
]

ORACLE_SQL = {
    "html_to_text": f"SELECT page_id, t AS text, length(t) AS n_chars FROM ({HTML_TEXT})",
    "page_titles": f"SELECT page_id, coalesce(nullif({trim(entities(rep('regexp_extract(html, ' + q('(?is)<title[^>]*>(.*?)</title>') + ', 1)', '<[^>]*>', '')))}, ''), nullif({trim(entities(rep('regexp_extract(html, ' + q('(?is)<h[1-3][^>]*>(.*?)</h[1-3]>') + ', 1)', '<[^>]*>', '')))}, '')) AS title FROM pages",
    "asset_refs": f"WITH {_assets}, refs AS ({_refs}), live AS (SELECT *, row_number() OVER (PARTITION BY page_id, kind ORDER BY n) AS ref_no FROM refs WHERE NOT starts_with(ref, 'data:') AND NOT (kind = 'svg' AND starts_with(ref, '#'))) SELECT page_id, kind, CAST(ref_no AS INTEGER) AS ref_no, ref, {resolved('href', 'ref')} AS path FROM live",
    "resolve_href": f"WITH {_hrefs} SELECT page_id, {resolved('base', 'href')} AS path FROM hrefs",
    "mime_lookup": f"WITH {_hrefs} SELECT page_id, {mime('href')} AS media_type, {mime('upper(href)')} AS upper_type FROM hrefs",
    "scrape_clean": f"SELECT page_id, nullif({trim('t')}, '') AS text FROM (SELECT page_id, {chain('regexp_extract_all(html, ' + q(_article) + ', 1)[1]', *_scrape)} AS t FROM pages)",
    "sanitize": f"WITH {NOISY} SELECT doc_id, {sanitized('text')} AS text FROM noisy",
    "sanitize_stats": f"WITH {NOISY} " + " UNION ALL ".join(f"SELECT {q(label)} AS label, {k} AS ord, CAST(sum(len(regexp_extract_all({sanitized('text', k)}, {q(_SANITIZE[k])}))) AS BIGINT) AS count FROM noisy" for k, (label, *_) in enumerate(clean.SANITIZE_PASSES)),
    "remove_blocks": f"WITH {NOISY} SELECT doc_id, {fixed('text', _BLOCK)} AS text FROM noisy",
    "clean_lines": f"WITH {NOISY}, {CLEANED} SELECT doc_id, CAST(len(ls) AS INTEGER) AS n_lines, CAST(len(keep) AS INTEGER) AS n_kept, array_to_string(keep, {q(chr(10))}) AS kept FROM kept",
    "clean_text": f"WITH {NOISY}, {CLEANED} SELECT doc_id, text FROM cleaned",
    "clean_stats": f"WITH {NOISY}, {CLEANED} " + " UNION ALL ".join(f"SELECT {q(label)} AS label, {k} AS ord, CAST({c} AS BIGINT) AS count" for k, (label, c) in enumerate(zip(_rule_labels, _rule_counts))),
    "size_report": f"WITH {NOISY}, {CLEANED}, s AS (SELECT CAST((SELECT sum(strlen(text)) FROM noisy) AS BIGINT) AS bytes_before, CAST((SELECT sum(strlen(text)) FROM cleaned) AS BIGINT) AS bytes_after) SELECT bytes_before, bytes_after, bytes_before - bytes_after AS bytes_removed, round((bytes_before - bytes_after) * 100.0::DOUBLE / bytes_before, 2) AS removed_pct FROM s",
    "chunk_web": f"WITH {PARAGRAPHS} {_exploded(WEB)}",
    "chunk_llm": f"WITH {PARAGRAPHS} {_exploded(LLM)}",
    "chunk_stats": f"WITH {PARAGRAPHS} SELECT doc_id, {_sizes} FROM ({_exploded(LLM)}) GROUP BY doc_id",
    "chunk_conversations": f"WITH threads AS (SELECT conv_id AS doc_id, string_agg(role || ': ' || text, {q(chr(10) * 2)} ORDER BY turn) AS text FROM conversations GROUP BY conv_id), paragraphs AS (SELECT * FROM threads) SELECT doc_id AS conv_id, chunk_idx, chunk FROM ({_exploded(LLM)})",
    "structural_chunks": f"WITH {NOISY}, {LINE_CHUNKS} SELECT doc_id, chunk_idx, regexp_matches(chunk, {_marks('=─#')}) AS web, regexp_matches(chunk, {_marks('=─#═')}) AS llm, {trim('chunk')} = '' AS blank FROM line_chunks",
    "sentence_split": f"WITH parts AS (SELECT doc_id, regexp_extract_all(text, '[^.!?]+[.!?]+[{CLS}]*') AS s, text FROM documents), filled AS (SELECT doc_id, CASE WHEN len(s) > 0 THEN s ELSE [text] END AS s FROM parts) SELECT doc_id, CAST(i - 1 AS INTEGER) AS sentence_no, {trim('s[i]')} AS sentence FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM filled)",
    "classify_lines": f"WITH {NOISY}, {LINE_CHUNKS}, {TYPED} SELECT doc_id, line_no, type, {_typed_text} AS text FROM typed",
    "line_type_counts": f"WITH {NOISY}, {LINE_CHUNKS}, {TYPED} SELECT type, count(*) AS n FROM typed GROUP BY type",
    "empty_run_cap": f"WITH {NOISY}, {LINE_CHUNKS}, {TYPED}, runs AS (SELECT *, sum(CASE WHEN type IN ('empty', 'separator') THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM typed), nth AS (SELECT *, sum(CASE WHEN type = 'empty' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, run ORDER BY line_no) AS k FROM runs) SELECT doc_id, line_no, type <> 'separator' AND (type <> 'empty' OR k <= 2) AS rendered FROM nth",
    "doc_title": f"WITH {NOISY}, ls AS (SELECT doc_id, list_filter(list_transform(string_split(text, {q(chr(10))})[1:10], lambda l: {trim('l')}), lambda l: l <> '' AND NOT regexp_matches(l, {q(f'^[=─#{CLS}-]*$')})) AS g FROM noisy) SELECT doc_id, coalesce(left(g[1], 100), 'doc' || doc_id) AS title FROM ls",
    "pdf_lines": PDF,
    "progress_compact": f"WITH {PARAGRAPHS}, {RECORDS} SELECT doc_id, array_to_string(list_filter(translated, lambda c: c IS NOT NULL), {q(chr(10) * 2)}) AS partial, array_to_string(list_transform(translated, lambda c: coalesce(c, '')), {q(chr(10) * 2)}) AS final FROM records",
    "progress_stats": f"WITH {PARAGRAPHS}, {RECORDS}, n AS (SELECT doc_id, len(translated) AS total, len(list_filter(translated, lambda c: c IS NOT NULL)) AS done, len(list_filter(translated, lambda c: c IS NOT NULL AND starts_with(c, '[TRANSLATION FAILED]'))) AS failed FROM records) SELECT doc_id, CAST(total AS INTEGER) AS total, CAST(total // 2 AS INTEGER) AS completed, CAST(done AS INTEGER) AS done, CAST(failed AS INTEGER) AS failed, printf('%.1f', round(done / total * 100, 1)) AS pct FROM n",
    "spine_manifest_join": f"WITH {_manifest}, last AS (SELECT book_id, id, arg_max(href, item_idx) AS href FROM manifest GROUP BY book_id, id) SELECT s.book_id, s.spine_idx, CAST(row_number() OVER (PARTITION BY s.book_id ORDER BY s.spine_idx) AS INTEGER) AS chapter_no, l.href FROM spine s JOIN last l ON s.book_id = l.book_id AND s.idref = l.id",
    "path_names": f"WITH {_names} SELECT page_id, regexp_extract(path, '^(.*/)?', 0) || regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_extract(path, '[^/]*$'), '\\.json$', ''), '^\\.', ''), '_translate_progress$', ''), '_ai_[A-Z]+_progress$', '') || '_partial.txt' AS partial, regexp_replace(path, '(\\.[^./]*)$', '_cleaned\\1') AS cleaned FROM names",
    "backoff_schedule": "SELECT CAST(a AS INTEGER) AS attempt, CAST(least(3000 * power(2, a - 1), 120000) AS BIGINT) AS web_ms, CAST(least(2000 * a, 30000) AS BIGINT) AS llm_ms, CAST(1000 * a AS BIGINT) AS scrape_ms FROM range(1, 21) t(a)",
    "batch_assign": "SELECT page_id, CAST((row_number() OVER (PARTITION BY page_id % 4 ORDER BY page_id) - 1) // 20 AS INTEGER) AS batch_no FROM pages",
    "language_names": "SELECT lang, count(*) AS n, CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German' WHEN 'es' THEN 'Spanish' ELSE lang END AS language FROM documents GROUP BY lang",
    "book_report": f"WITH h AS ({HTML_TEXT}), k AS (SELECT page_id % 7 AS book_id, page_id AS n, t FROM h WHERE length(t) >= 2), b AS (SELECT book_id, count(*) AS n_sections, CAST(sum(length(t)) AS BIGINT) AS n_chars, string_agg({q(chr(10) * 2 + chr(0x2550) * 60 + chr(10) + '  Chapter ')} || n || {q(':' + chr(10) + chr(0x2550) * 60 + chr(10))} || {q(chr(10) * 2)} || t || {q(chr(10))}, '' ORDER BY n) AS text FROM k GROUP BY book_id) SELECT book_id, CAST(n_sections AS INTEGER) AS n_sections, n_chars, {q('=' * 60 + chr(10) + '  Book ')} || book_id || {q(chr(10) + '=' * 60 + chr(10) + '  Converted from b on 2024-01-01' + chr(10) + '=' * 60 + chr(10) + chr(10) * 2)} || text AS text FROM b",
    "user_rules": f"""WITH s AS (SELECT doc_id, {sanitized("replace(text, chr(10), ' ---- teh' || chr(10))")} AS t FROM documents) SELECT doc_id, regexp_replace(replace(regexp_replace(t, '-{{2,}}', '-', 'g'), 'teh', 'the'), {q("\\n{4,}")}, {q(chr(10) * 3)}, 'g') AS text FROM s""",
    "epub_chapters": f"""WITH archived AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN html || chr(65533) ELSE html END AS html FROM pages)
      SELECT 'b' || (page_id // 20) AS book_id, CAST(row_number() OVER (PARTITION BY page_id // 20 ORDER BY page_id) AS INTEGER) AS chapter_no, 'OEBPS/t/' || page_id || '.xhtml' AS href, t AS text FROM ({staged("archived", "page_id", "html", HTML_STEPS)})""",
    "pipeline_text": f"WITH noisy AS (SELECT page_id AS doc_id, t AS text FROM ({HTML_TEXT})), {CLEANED} SELECT doc_id AS page_id, text FROM cleaned",
    "translate_stub": f"WITH {PARAGRAPHS} SELECT doc_id, array_to_string(list_transform(chunks, lambda c: CASE WHEN length(c) % 7 = 0 THEN {q('[TRANSLATION FAILED]' + chr(10))} || c ELSE upper(replace(c, 'ß', 'ss')) END), {q(chr(10) * 2)}) AS text, CAST(len(list_filter(chunks, lambda c: length(c) % 7 = 0)) AS BIGINT) AS n_failed FROM {LLM} WHERE len(chunks) > 0",
}
