"""The training-data operators against brute force, exact round trips and the tokenizers library."""

import base64
import hashlib
import re
import unicodedata
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillstream.llm import bpe, components, decontaminate, license_scan, license_texts, near_dedup, quality, registry, substring_dedup, textvec, token_output, topk, url_filter, warc

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, n long, s_words string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def real(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


ODD = {
    -1: None, -2: "", -3: " \n\t ", -4: "one", -5: "one two", -6: "one two", -7: "One TWO\x0bthree", -8: "x " * 70, -9: "x " * 90,
    -10: "é" * 3000 + " " + "y", -11: " ".join(f"w{i}" for i in range(5000)), -12: " ".join(f"w{i}" for i in range(20, 5000)),
    -13: "a b " * 40, -14: "a b " * 41 + "c", -15: "z " * 49 + "q", -16: "z " * 50, -17: "z " * 49 + "q",
}


@pytest.fixture(scope="module")
def mixed(spark, real):
    """Real and odd texts, with columns whose names the operators use themselves."""
    rows = real | ODD
    return rows, spark.createDataFrame([(i, t, "en", 1, "x") for i, t in rows.items()], SCHEMA).repartition(3)


def near_brute(rows, width, percent):
    sets = {}
    for i, t in rows.items():
        w = words(lower(t))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    parent = {i: i for i in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = {}
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(i)
    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in where[x] if j < i).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (i, len(sets[i]), root(i), root(i) == i) for i in rows}


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_near_duplicates(mixed, width, percent):
    rows, df = mixed
    got = {r.doc_id: tuple(r) for r in near_dedup.near_duplicates(df, width, percent).collect()}
    assert got == near_brute(rows, width, percent)


def test_near_duplicates_large_group(spark):
    """A group of near copies around a base that is not the smallest id: copies link to the base, seldom to each other."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(160)]
    rows = {500: " ".join(base)}
    for i in range(150):
        copy = list(base)
        for k in rng.choice(160, 4, replace=False):
            copy[k] = f"n{i}-{k}"
        rows[i] = " ".join(copy)
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {r.doc_id: tuple(r) for r in near_dedup.near_duplicates(df, 3, 85).collect()}
    assert got == near_brute(rows, 3, 85)


def complements(length):
    """Two words of two letters each, complementary, that polynomials modulo a power of two cannot tell apart."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(length))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_near_duplicates_words_that_polynomials_confuse(spark):
    x, y = complements(1024)
    rows = {1: f"{x} u v", 2: f"{y} u v", 3: f"{x} u v"}
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    assert {r.doc_id: tuple(r) for r in near_dedup.near_duplicates(df, 3, 85).collect()} == near_brute(rows, 3, 85)


def test_near_duplicates_repeated_ids(spark):
    """Of rows that repeat an id one stands for the document; every row comes back with its own set size."""
    long = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(5, long), (5, "one two three four"), (5, "one two three four"), (2, long), (None, long), (None, None)], "doc_id long, text string")
    got = sorted((tuple(r) for r in near_dedup.near_duplicates(df, 3, 85).collect()), key=str)
    of_5 = {c for i, _, c, _ in got if i == 5}
    assert len(of_5) == 1 and of_5 <= {2, 5}
    assert [(i, n) for i, n, _, _ in got] == [(2, 38), (5, 2), (5, 2), (5, 38), (None, 0), (None, 38)]
    assert all(c is None and k for i, _, c, k in got if i is None)


def test_near_duplicates_equal_small_sets(spark):
    """Sets too small to differ link by equality, also where the word sequences are not equal."""
    rows = {1: "a b a b a b a", 2: "b a b a b a b", 3: "a b a", 4: "a b", 5: "A  B", 6: "a b a b"}
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {r.doc_id: tuple(r) for r in near_dedup.near_duplicates(df, 3, 85).collect()}
    assert got == near_brute(rows, 3, 85) and got[2][2] == 1 and got[5][2] == 4


def test_near_duplicates_recall_at_the_threshold():
    """Pairs at the threshold share a key as often as the tables promise, whatever the threshold."""
    import pyarrow as pa

    rng = np.random.default_rng(9)
    for percent in (80, 85):
        tables = near_dedup.tables_for(percent)
        assert near_dedup.missed_share(tables, percent) <= near_dedup.MISSED < near_dedup.missed_share(tables - 1, percent)
        n, texts = 200, []
        for k in range(600):  # two sets of n shingles of one word with the threshold's similarity
            common = -(-2 * n * percent // (100 + percent))
            words_ = [f"{k}-{i}" for i in range(2 * n - common)]
            texts += [" ".join(words_[:n]), " ".join(words_[n - common :])]
        met = 0
        for _, _, w in textvec.text_groups(pa.array(texts)):
            _, s, of = near_dedup.shingles(w, 1)
            m = near_dedup.minhashes(s, of, tables).reshape(len(of) - 1, 2, tables, near_dedup.BAND_ROWS)
            same = (m[0::2] == m[1::2]).all(axis=3)
            met += int((same[:, 0].any(axis=1) & same[:, 1].any(axis=1)).sum())
        assert met >= 595, (percent, met)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5), (103, 101)], "a long, b long")
    got = {r.id: r.comp for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 103: 100}


def substring_brute(rows, window=50):
    texts = {i: words(t) for i, t in rows.items()}
    first = {}
    for i, w in texts.items():
        for p in range(len(w) - window + 1):
            k = tuple(w[p : p + window])
            first[k] = min(first.get(k, i), i)
    out = {}
    for i, w in texts.items():
        keep = [True] * len(w)
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < i:
                keep[p : p + window] = [False] * window
        left = [x for x, k in zip(w, keep) if k]
        out[i] = (i, len(w), len(w) - len(left), hashlib.sha256(" ".join(left).encode()).hexdigest())
    return out


def test_substring_dedup(mixed):
    rows, df = mixed
    found, _ = substring_dedup.remove_repeats(df)
    got = {r.doc_id: (r.doc_id, r.n_words, r.n_removed, bytes(r.kept_sha256).hex()) for r in found.collect()}
    assert got == substring_brute(rows)


def test_substring_dedup_small_alphabets(spark):
    """Periodic texts and few words: long runs, many equal windows, matches that begin and end anywhere."""
    rng = np.random.default_rng(5)
    rows = {i: " ".join(rng.choice(["a", "b", "c"][: 1 + i % 3], 60 + i)) for i in range(24)}
    rows |= {30 + i: " ".join(["p", "q", "r"][: 1 + i % 3] * (30 + i)) for i in range(12)}
    long = [f"t{k}" for k in rng.integers(0, 40, 400)]
    rows |= {60 + i: " ".join([f"u{i}", *long[a : a + n], f"v{i}"]) for i, (a, n) in enumerate(zip(rng.integers(0, 300, 30), rng.integers(45, 100, 30)))}
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    found, kept = substring_dedup.remove_repeats(df)
    got = {r.doc_id: (r.doc_id, r.n_words, r.n_removed, bytes(r.kept_sha256).hex()) for r in found.collect()}
    assert got == substring_brute(rows)
    for r in kept.collect():
        assert hashlib.sha256(r.kept_text.encode()).hexdigest() == got[r.doc_id][3]


def test_substring_dedup_words_that_polynomials_confuse(spark):
    x, y = complements(1024)
    tail = " ".join(f"t{i}" for i in range(49))
    rows = {1: f"{x} {tail}", 2: f"{y} {tail}", 3: f"{x} {tail}"}
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    found, _ = substring_dedup.remove_repeats(df)
    assert {r.doc_id: r.n_removed for r in found.collect()} == {1: 0, 2: 0, 3: 50}


def test_substring_dedup_repeated_ids(spark):
    """Documents of one id do not remove each other's words; rows without an id stay whole and remove nothing."""
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    df = spark.createDataFrame([(3, a), (3, b), (3, b), (4, f"{b} end"), (None, a), (None, a), (2, f"x {a}")], "doc_id long, text string")
    found, kept = substring_dedup.remove_repeats(df)
    assert sorted(((r.doc_id, r.n_words, r.n_removed) for r in found.collect()), key=str) == [(2, 61, 0), (3, 60, 0), (3, 60, 0), (3, 60, 60), (4, 61, 60), (None, 60, 0), (None, 60, 0)]
    assert {(r.doc_id, r.kept_text) for r in kept.collect()} == {(3, ""), (4, "end")}


def test_word_hashes_follow_words():
    import pyarrow as pa

    texts = ["Ab c\x0bd  ab", "", None, "é ab\nD"]
    seen = {}
    for _, _, w in textvec.text_groups(pa.array(texts), lower=True):
        raw = w.data.tobytes()
        for a, b, h in zip(w.starts, w.ends, w.hashes().tolist()):
            assert seen.setdefault(raw[a:b], h) == h
        assert np.diff(w.of).tolist() == [len(words(t)) for t in texts]
    assert len(set(seen.values())) == len(seen) == 4


TOKEN_TEXTS = [
    "", None, "a  <|endoftext|>  b", "x<|endoftext|>", "  lead", "trail  \n\n", "tab\t\tx   y\u0085z", "don't we'll 'S", "\x1c\x1d a\x1fb", "é ́x İ ΑΣ ΣΣ",
    "\U0001f600 ‍ 漢字 <|startoftext|> <|ENDOFTEXT|>", " ", "\n", "a" * 5000, "<<<|endoftext|>>", "a \n <|endoftext|> \n b", "same", "same", "nul\x00 \x00\n\x00 \x00\x00\n", "\n\n\x00\n",
]


@pytest.fixture(scope="module")
def token_rows(spark, real):
    rows = real | {10**6 + i: t for i, t in enumerate(TOKEN_TEXTS)}
    path = str(spark.conf.get("spark.checkpoint.dir")) + "/token-in"
    spark.createDataFrame([(i, t, "x") for i, t in rows.items()], "doc_id long, text string, ids string").repartition(3).write.parquet(path + "/documents.parquet")
    return rows, path


def test_bpe(spark, token_rows):
    rows, path = token_rows
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for i, x in rows.items():
        ids = t.encode(x or "", add_special_tokens=False).ids
        want[i] = (i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert {r.doc_id: tuple(r) for r in bpe.op3_bpe(spark, path).collect()} == want
    docs = spark.read.parquet(path + "/documents.parquet")
    small = bpe.decode(bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"), block_bytes=2000), public_tokenizers.path("byte_bpe_50k.json"))
    assert {r.doc_id: r.decoded for r in small.collect()} == {i: x or "" for i, x in rows.items()}


def test_token_output(spark, token_rows):
    rows, path = token_rows
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, start = {}, 0
    for i, x in sorted(rows.items()):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        want[i] = (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r.doc_id: tuple(r) for r in token_output.op9_token_output(spark, path).collect()} == want


def test_chunks_encode_like_whole_texts():
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rng = np.random.default_rng(4)
    parts = ["a", "B", "é", "É", "ß", "İ", "Σ", "J", "\u030c", " ", " ", "\n", "\t", ".", ",", "!", "'s", "'", "*", "1", "<|", "|>", "ENDOFTEXT", "÷", "ŉ", "...", "\x1c", "\xa0", "漢", "<|endoftext|>"]
    for _ in range(3000):
        text = "".join(rng.choice(parts, rng.integers(1, 12)))
        ids = [i for c in token_output.chunks_of(text) for i in t.encode(c, add_special_tokens=False).ids]
        assert ids == t.encode(text, add_special_tokens=False).ids, text


def test_value_coding():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1001):
        v = (rng.integers(0, 2**32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
        assert np.array_equal(token_output.unpack_values(*token_output.pack_values(v), n), v)


def license_brute(text, notices):
    """(base starts, base labels, all labels, score), with every start of every template tried."""
    band, w = license_scan.BAND, re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    stands = lambda p, i: i >= 0 and w[i : i + len(p)] == p
    places = {label: [i for i in range(len(w)) if stands(split(p), i)] for label, p in license_texts.BASE_PHRASES.items()}
    base = {label for label, at in places.items() if at}
    labels, score = set(base), 1.0 if base else 0.0
    for label, (text_of, phrases) in notices.items():
        t = split(text_of)
        keys = [(next(i for i in range(len(t)) if t[i : i + len(k)] == k), k) for k in map(split, phrases)]
        if not all(" ".join(k) in " ".join(w) for _, k in keys):
            continue
        for s in range(-len(t), len(w)):
            if any(stands(k, s + at) for at, k in keys) and all(any(stands(k, s + at + d) for d in range(-band, band + 1)) for at, k in keys):
                share = sum(x in w[max(0, s + k - band) : max(0, s + k + band + 1)] for k, x in enumerate(t)) / len(t)
                if share >= license_scan.MIN_SHARE:
                    labels.add(label)
                    score = max(score, share)
    return sorted(i for at in places.values() for i in at), base, labels, score


def test_license_scan(spark, real):
    texts = {label: text for label, (text, _) in license_texts.TEXTS.items()}
    mit = texts["mit-text"].split()
    lines = {
        -1: None, -2: "", -3: "Released under the MIT License. mit-license MIT\nlicense", -4: "GNU General Public License v3", -5: "general public public license",
        -6: "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", -7: "cafémit license", -8: "mit license " * 3000,
        -9: "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted",
        -10: " ".join(mit[:40] + ["some", "added", "words"] + mit[40:90] + mit[92:]), -11: " ".join(mit[:60]), -12: " ".join(mit[20:] + mit[:20]),
        -13: " ".join(["before"] * 7 + mit * 3), -14: texts["bsd-3-text"].replace("the copyright holder nor", "Example Organisation nor"),
        -15: "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    } | {-100 - i: "x y " * i + t for i, t in enumerate(texts.values())}
    rows = real | lines
    df = spark.createDataFrame([(i, t, "x") for i, t in rows.items()], "doc_id long, text string, labels string")
    got = {r.doc_id: r for r in license_scan.scan_licenses(df).collect()}
    for i, t in rows.items():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        at, base, labels, score = license_brute(t, license_texts.NOTICES)
        assert tuple(got[i]) == (i, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score)
    assert got[-6].labels == "mit-grant" and got[-3].labels == "mit" and got[-2].score == 0 and got[-9].labels == "isc" and got[-15].labels == "gpl,gpl-notice"
    assert got[-10].labels == got[-13].labels == "mit-grant,mit-text" and got[-11].labels == "mit-grant" and got[-14].labels == "bsd,bsd-3-text"
    for i, label in enumerate(texts):
        assert label in got[-100 - i].labels.split(",") and got[-100 - i].score == 1


def url_rows(spark):
    return spark.createDataFrame(
        [(1, "http://a.bad.example.org:80/x", "2024-02-01"), (2, "https://u:p@BAD.example.org./", "2024-03-01"), (3, "https://notbad.example.org/", "2024-02-01"), (4, None, "2024-02-01"), (5, "nonsense", "2024-02-01"), (6, "http://bad.example.org", None), (7, "http://bad.example.org", "2024-02-10"), (7, "http://bad.example.org", "2024-02-10")],
        "page_id long, url string, d string",
    ).selectExpr("page_id", "url", "cast(d as date) fetched_on", "'x' lists", "'y' host", "1 key", "2 `a.b`", "3 _host", "'z' list_name")


def test_url_filter(spark):
    changes = url_filter.list_changes(spark, [("l", "bad.example.org", "2024-01-15", "add"), ("l", "bad.example.org", "2024-01-15", "add"), ("l", "bad.example.org", "2024-02-10", "remove"), ("l", "bad.example.org", "2024-02-20", "add"), ("l", "bad.example.org", "2024-02-20", "remove"), ("m", "example.org", "2024-02-01", "add")])
    got = sorted((r.page_id, r.lists, r.n_lists, r.allowed) for r in url_filter.filter_captures(url_rows(spark), changes).collect())
    kept = url_filter.filter_captures(url_rows(spark), changes, prefix="judged_")
    assert kept.columns == ["page_id", "url", "fetched_on", "lists", "host", "key", "a.b", "_host", "list_name", "judged_host", "judged_n_lists", "judged_lists", "judged_allowed"]
    assert {(r.lists, r.host) for r in kept.collect()} == {("x", "y")}
    assert got == [(1, "l,m", 2, False), (2, "m", 1, False), (3, "m", 1, False), (4, "", 0, True), (5, "", 0, True), (6, "", 0, True), (7, "m", 1, False), (7, "m", 1, False)]
    assert {r.allowed for r in url_filter.filter_captures(url_rows(spark), url_filter.list_changes(spark, [])).collect()} == {True}


def test_url_filter_list_files(spark, tmp_path):
    (tmp_path / "l.csv").write_text("list_name,key,changed_on,action\nl,org,2024-01-15,add\nl,bad,not a day,add\n")
    got = {r.page_id: r.allowed for r in url_filter.filter_captures(url_rows(spark), url_filter.read_changes(spark, str(tmp_path))).collect()}
    assert got == {1: False, 2: False, 3: False, 4: True, 5: True, 6: True, 7: False}


def test_topk_many_blocks_and_large_values(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.integers(-(2**25), 2**25, 5).tolist()) for i in range(300)] + [(1000, [2**62, 0, 0, 0, 0]), (1001, [1, 1, 0, 0, 0])]
    df = spark.createDataFrame(rows, "id long, v array<long>").repartition(5)
    got = [tuple(r) for r in topk.top_k(df.where("id = 1001"), df, 4, block_rows=20, query_rows=1, blocks_per_task=2).collect()]
    assert [r for r in got if r[0] == 1001][0] == (1001, 1, 1000, 2**62)
    plain = df.where("id < 300")
    got = sorted(tuple(r) for r in topk.top_k(plain.where("id % 20 = 0"), plain, 4, block_rows=20, query_rows=4, blocks_per_task=2).collect())
    want = []
    for q, v in rows[:300:20]:
        best = sorted((-sum(a * b for a, b in zip(v, c)), i) for i, c in rows[:300] if i != q)[:4]
        want += [(q, k + 1, i, -x) for k, (x, i) in enumerate(best)]
    assert got == want
    with pytest.raises(Exception, match="beyond 64 bits"):
        topk.top_k(df.where("id = 0"), spark.createDataFrame([(5, [2**62, 2**62])], "id long, v array<long>").unionAll(df), 4).collect()


def test_topk(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.choice([0.0, 0.0, -0.3, 0.51, 2.0], 7)]) for i in range(0, 210, 3)]
    rows += [(20, None), (40, [nan, 1.0]), (41, [inf]), (42, [None, 1.0]), (None, [1.0]), (80, []), (100, [1.0, 2.0]), (7, [1e6] * 7), (7, [1e6] * 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    vectors = topk.integer_vectors(df, "vec_id", "embedding", 64)
    got = sorted(tuple(r) for r in topk.top_k(vectors.where("id % 20 = 0"), vectors, 20, block_rows=9, query_rows=2).collect())
    ok = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, v in {i: v for i, v in reversed(ok) if i % 20 == 0}.items():
        scores = sorted((-sum(a * b for a, b in zip(v, c)), i) for i, c in ok if i != q)[:20]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    assert got == sorted(want)


def test_warc(spark, tmp_path):
    rows = [(1, "http://a/", "same"), (2, "http://b/", "same"), (3, None, None), (4, "u", ""), (5, "x\ny", "hé"), (5, "x", "hé"), (6, "u", "z" * 100_000)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, sha256 string")
    path = str(tmp_path / "archive")
    warc.write_archive(df, path)
    assert spark.read.parquet(path + "/payloads").count() == 4
    records = warc.read_archive(spark, path)
    assert sorted((r.page_id, bytes(r.payload).decode()) for r in records.collect()) == sorted((i, h or "") for i, _, h in rows)
    whole = [bytes(r.record) for r in warc.record_bytes(records).where("page_id = 6").collect()]
    parsed = {(r.page_id, r.record_type): (r.payload_bytes, r.payload_digest, r.refers_to) for r in warc.parse_records(warc.record_bytes(records)).collect()}
    digest = lambda h: base64.b32encode(hashlib.sha1(h).digest()).decode()
    assert parsed[3, "revisit"] == (0, digest(b""), 4) and parsed[5, "revisit"] == (3, digest("hé".encode()), 5) and parsed[6, "response"][0] == 100_000
    with pytest.raises(Exception, match="record and payload differ"):
        warc.parse_records(warc.record_bytes(records.withColumn("payload", F.lit(b"other")))).collect()
    assert whole[0].startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and whole[0].endswith(b"z\r\n\r\n") and b"\r\n\r\nzz" in whole[0]
    kinds = Counter((r.page_id, r.kind) for r in records.select("page_id", warc.header_field("WARC-Type").alias("kind")).collect())
    assert kinds == {(1, "revisit"): 1, (2, "response"): 1, (3, "revisit"): 1, (4, "response"): 1, (5, "response"): 1, (5, "revisit"): 1, (6, "response"): 1}


def test_warc_query(spark):
    pages = {r.page_id: r.html.encode() for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    last = {h: i for i, h in sorted(pages.items())}
    for r in warc.op10_warc(spark, SF).collect():
        h = pages[r.page_id]
        kind = ("response", None) if last[h] == r.page_id else ("revisit", last[h])
        assert tuple(r)[1:] == (len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), *kind)


def test_decontaminate(spark, real):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id) for r in decontaminate.op8_decontaminate(spark, SF).collect()}
    assert got == {(i, j) for i, x in real.items() for j, y in items.items() if y in x}


def test_decontaminate_slots(spark):
    items = spark.createDataFrame(
        [(1, "John Smith has 12 apples and gives 5 apples to Mary Jones every single day of the week.", "x"), (2, "Too short.", "x"), (None, "a b c d e f g h i", "x"), (3, None, "x"), (4, "Five small words stand here", "x")],
        "item_id long, text string, canon string",
    )
    docs = spark.createDataFrame(
        [
            (1, "foo. Peter Black has 7 apples and gives 3 apples to Anna White every single day of the week. bar"),
            (2, "So. He has 7 apples and gives 7 apples to nobody at all; too short."),
            (3, "unrelated words only here and nothing else to see in this text at all"),
            (4, None), (5, ""), (None, "Five small words stand here"), (6, "then five small words stand here now"), (6, "then five small words stand here now"),
            (7, "X. John Smith has 12 apples and gives 5 apples to Mary Jones every single day of the week."),
        ],
        "doc_id long, text string",
    )
    got = {(r.doc_id, r.item_id): r.kind for r in decontaminate.contaminated(docs, items).collect()}
    # "Too short." has fewer tokens than a template needs: it counts where all its words stand.
    assert got == {(1, 1): "reparameterised", (7, 1): "exact", (6, 4): "exact", (2, 2): "exact"}
    item = spark.createDataFrame([(1, "From 3 boxes we take 3 balls and put them into the 3 bags there.")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "From 4 boxes we take 4 balls and put them into the 4 bags there."), (2, "From 4 boxes we take 5 balls and put them into the 6 bags there.")], "doc_id long, text string")
    assert [r.doc_id for r in decontaminate.contaminated(docs, item).collect()] == [1]


def test_decontaminate_exact_window_beside_a_changed_one(spark):
    items = spark.createDataFrame(
        [(1, "From 3 boxes we take 3 balls and put them into the 3 bags there."), (2, "the quick red foxes run over all those very lazy dogs near the old river bank where Anna lives with many other good people")],
        "item_id long, text string",
    )
    docs = spark.createDataFrame(
        [(1, "From 4 boxes we take 3 balls and put them into the 3 bags there."), (2, "lazy dogs near the old river bank where Peter lives"), (3, "From 4 boxes we take 5 balls and put 3 into the 6 bags there.")], "doc_id long, text string"
    )
    got = {(r.doc_id, r.item_id): (r.kind, r.n_windows) for r in decontaminate.contaminated(docs, items).collect()}
    # The changed number stands in two of the eight windows: the other six are word for word the item's.
    assert got == {(1, 1): ("exact", 6), (2, 2): ("exact", 1)}


def test_decontaminate_replacements_of_other_lengths(spark):
    items = spark.createDataFrame([(1, "John Smith has 12 apples and gives 5 apples to Mary Jones every single day of the week.")], "item_id long, text string")
    docs = spark.createDataFrame(
        [
            (1, "Peter has 7 apples and gives 3 apples to Anna every single day of the week."),
            (2, "So Anna Maria White has 7 apples and gives 3 apples to Peter Paul Black every single day of the week."),
            (3, "Peter has 7 ft 3 in apples and then gives 3 apples to Anna every single day of the week."),
            (4, "Peter has 7 apples."),
        ],
        "doc_id long, text string",
    )
    got = {r.doc_id: r.kind for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {1: "reparameterised", 2: "reparameterised"}
    # An inserted word shifts the offset: neither side of it is half of the item.
    text = "John has {} apples and gives {} apples to Mary on {} mornings of the week while {}all {} of us wait for {} more boxes with {} ripe red pears"
    items = spark.createDataFrame([(1, text.format(12, 5, 2, "", 10, 8, 15))], "item_id long, text string")
    docs = spark.createDataFrame([(1, text.format(7, 3, 4, "then ", 9, 6, 11)), (2, text.format(7, 3, 4, "then with some of the others ", 9, 6, 11))], "doc_id long, text string")
    assert [(r.doc_id, r.kind, r.n_windows, r.item_windows) for r in decontaminate.contaminated(docs, items).collect()] == [(1, "reparameterised", 17, 24)]


def test_decontaminate_capitals(spark):
    items = spark.createDataFrame(
        [(1, "Five small words stand here"), (2, "John has 12 apples and 5 pears"), (3, "yesterday John bought some 12 apples and pears there")], "item_id long, text string"
    )
    docs = spark.createDataFrame(
        [
            (1, "then Five small words stand here now"), (2, "He said FIVE small\nWords stand HERE now"), (3, "then Peter has 9 apples and 4 pears"), (4, "Oh. Peter has 9 apples and 4 pears"),
            (5, "so it was yesterday. Peter bought some 9 apples and pears there"), (6, "then nobody has 9 apples and 4 pears"),
        ],
        "doc_id long, text string",
    )
    got = {(r.doc_id, r.item_id): r.kind for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {(1, 1): "exact", (2, 1): "exact", (3, 2): "reparameterised", (4, 2): "reparameterised", (5, 3): "reparameterised"}


RENAMED = [
    "{a} has {n} {t}. {a} gives {m} {t} to {b}. How many {t} does {a} have now?",
    "{a} drives {n} {u} and {b} drives {m} {u} more. How far do they drive in all?",
    "A shop sells {t} for {n} dollars each. {a} buys {m} of them and pays with a note of {k} dollars. How much change does {a} get back?",
    "If {a} reads {n} pages a day and {b} reads {m} pages a day, after how many days have they read {k} pages together?",
    "{a} is {n} years old. {b} is {m} years older than {a}. In {k} years, how old will {b} be?",
    "There are {n} {t} in a box. {a} takes {m} {t} out, and then {b} puts {k} {t} back. How many {t} are in the box at the end?",
]


def test_decontaminate_recall_of_renamed_copies(spark):
    """Items with other names, some of two words, and other numbers, inside other text; texts of the same fillers are left alone."""
    rng = np.random.default_rng(11)
    names = ["Tom", "Ann", "Sam", "Eve", "Peter", "Maria", "Lucas", "Nina", "Mary Jones", "John Smith"]

    def fill(shape, t, u):
        a, b = rng.choice(names, 2, replace=False)
        n, m, k = rng.choice(np.arange(2, 99), 3, replace=False).tolist()
        return shape.format(a=a, b=b, n=n, m=m, k=k, t=t, u=u)

    other = "the weather was fine and nobody had much to say about it so they all went home early that day".split()
    items, docs = [], []
    for i in range(60):
        shape, t, u = RENAMED[i % 6], ["apples", "books", "coins"][rng.integers(3)], ["km", "miles"][rng.integers(2)]
        items.append((i, fill(shape, t, u)))
        docs.append((i, f"{' '.join(rng.choice(other, 12))}. {fill(shape, t, u)} {' '.join(rng.choice(other, 12))}"))
        docs.append((1000 + i, " ".join(rng.choice(other, 40))))
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert sum((i, i) in got for i in range(60)) >= 57
    assert not any(d >= 1000 for d, _ in got)


def test_decontaminate_short_items_and_long_texts(spark):
    items = spark.createDataFrame([(1, "Name the capital."), (2, "Why?")], "item_id long, text string")
    filler = "word " * 200_000
    docs = spark.createDataFrame([(1, f"{filler} please NAME the capital now"), (2, "the capital"), (3, "but why not"), (4, filler)], "doc_id long, text string")
    assert {(r.doc_id, r.item_id, r.kind) for r in decontaminate.contaminated(docs, items).collect()} == {(1, 1, "exact"), (3, 2, "exact")}


def test_quality(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = quality.op7_quality(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([p == y for p, y in held]) > 0.9 > np.mean([y for _, y in held])


def test_quality_statistics_and_compiled_score(spark, real):
    """Statistics against Python's, and the compiled column against numpy's rules and weights."""
    texts = list(real.values())[:60] + [None, "", "!!! | a  a\n14CharactersLong1 \u00c9T\u00c9 x#$ b b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    x = {r.doc_id: [r[f"f_{f}"] for f in quality.FEATURES] for r in quality.features(df).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        w = re.findall(r"[^ \t\n\x0b\f\r]+", t)
        doubles = len(re.findall(r"(?<![^ \t\n\x0b\f\r])([^ \t\n\x0b\f\r]+)[ \t\n\x0b\f\r]+\1(?![^ \t\n\x0b\f\r])", t))
        of_words = [t.count("\n"), sum(c in ".,;:?" for c in t), t.count("!"), t.count("|"), sum(c in "#$%&*@^~_=+<>{}[]\\/" for c in t), doubles, sum(len(v) >= 14 for v in w)]
        line, stop, shout, bar, symbol, double, long = [n / len(w) if w else 0 for n in of_words]
        capital, digit = [sum(f(c) for c in t) / len(t) if t else 0 for f in (lambda c: unicodedata.category(c) == "Lu", lambda c: c in "0123456789")]
        assert x[i] == pytest.approx([len(w), len(t) / len(w) if w else 0, line, capital, digit, stop, shout, bar, symbol, double, long]), t
    rng = np.random.default_rng(3)
    m = np.array([x[i] for i in range(len(texts))])
    y = (m[:, 0] > np.median(m[:, 0])).astype(float)
    y[rng.integers(0, len(y), 6)] = 1
    b, rules = quality.fit(m, y, 0.01)
    assert rules
    want = 1 / (1 + np.exp(-(b + quality.holds([r for r, _ in rules], m) @ np.array([w for _, w in rules]))))
    got = {r.doc_id: r.s for r in quality.features(df).withColumn("s", quality.compiled(b, rules)).collect()}
    assert [got[i] for i in range(len(texts))] == pytest.approx(want.tolist())


def test_quality_edges(spark):
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in [(1, None), (2, ""), (3, "x" * 50_000), (4, "a b"), (4, "a b"), (None, "q")]], "doc_id long, text string, s_words string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in quality.score(docs, none).collect()] == [0.5] * 6
    one = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 1, 0), (None, 0, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    assert all(r.score > 0.5 for r in quality.score(docs, one).collect())
    assert quality.keep_good(docs, one).columns == docs.columns


def test_empty_tables(spark, tmp_path):
    path = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(path + "/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(path + "/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(path + "/benchmark.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(path + "/embeddings.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(path + "/pages.parquet")
    for name, query in registry.QUERIES.items():
        assert query(spark, path).collect() == [], name


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = registry.QUERIES[name](spark, SF)
    result = con.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert Counter(map(tuple, df.select(*columns).collect())) == Counter(result.fetchall())
