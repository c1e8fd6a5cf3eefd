"""Repeated-substring removal by recompression.

Every document is parsed by rounds of locally consistent renaming: a round names maximal runs of a
word, the following rounds name adjacent pairs whose left symbol falls in one half of a random split of all
symbols and whose right one falls in the other. A name is a fingerprint of what it stands for, so
equal substrings get equal interior symbols in every document and partition without a shuffle per round.

Each symbol carries its context: the words that decided that it exists. A window of WINDOW words is
represented by the longest symbol (ties: largest name) whose context lies inside the window. That is a function of the
window's words alone, so equal windows always have equal representatives. Representatives that occur in
one document only need no further look; of the others' windows the words themselves are digested (BLAKE2b, 128 bits), and
every word under a window whose digest also starts in a document with a smaller id is removed. Names only choose what is looked at, so
that names which collide cost time and change no result. Nothing is sampled
or capped: a window without a longer symbol is represented by one of its words.

Defined results: null, empty and wordless texts have no words and keep the digest of the empty text; texts
shorter than a window stay whole; rows that repeat a doc_id are documents of equal rank and do not remove
each other's words; rows with a null doc_id stay whole and remove nothing. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstream.llm import shared, textvec

WINDOW = 50
PAIR_ROUNDS = 8
LONGEST_SYMBOL = 40
_U = np.uint64
_NAME_BITS = _U(58)


def _offer(best: list[np.ndarray], rank: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
    """Offer rank to all window starts low..high (inclusive), as two overlapping power-of-two stretches."""
    some = high >= low
    rank, low, high = rank[some], low[some], high[some]
    k = np.frexp((high - low + 1).astype(np.float64))[1] - 1
    for level in range(len(best)):
        here = k == level
        if here.any():
            np.maximum.at(best[level], low[here], rank[here])
            np.maximum.at(best[level], high[here] - (1 << level) + 1, rank[here])


def representatives(h: np.ndarray, of: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts of all windows, the rank of each one's representative symbol): length in the top bits, then name."""
    n, counts = len(h), np.diff(of)
    levels = max(1, int(window).bit_length())
    best = [np.zeros(n, _U) for _ in range(levels)]
    doc = np.repeat(np.arange(len(counts)), counts)
    lo, hi = np.repeat(of[:-1], counts), np.repeat(of[1:], counts)
    starts = np.flatnonzero(np.arange(n) + window <= hi)

    name, st = h, np.arange(n)
    # Runs: a symbol is a run, or stays single, because of the words on both sides of it.
    if n:
        fresh = np.ones(n, bool)
        fresh[1:] = (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])
        st = np.flatnonzero(fresh)
        en = np.append(st[1:], n)
        length = (en - st).astype(_U)
        name = np.where(length > 1, textvec.mix(name[st] * _U(3) + length), name[st])
        cl, cr = st - 1, en + 1
        runs = (length > 1) & (cr - cl <= window)
        _rank_and_offer(best, name[runs], st[runs], en[runs], cl[runs], cr[runs], lo, hi, window)
    for r in range(PAIR_ROUNDS):
        if len(st) < 2:
            break
        left = (textvec.mix(name + _U(r * 2 + 1)) & _U(1)) == 0
        next_same = np.zeros(len(st), bool)
        next_same[:-1] = doc[st[1:]] == doc[st[:-1]]
        joins = np.zeros(len(st), bool)
        joins[:-1] = left[:-1] & ~left[1:] & next_same[:-1] & (en[1:] - st[:-1] <= LONGEST_SYMBOL)
        joined = np.zeros(len(st), bool)
        joined[1:] = joins[:-1]
        # An unjoined left symbol depends on its successor, an unjoined right one on its predecessor.
        after = np.append(cr[1:], 0)
        after = np.where(next_same, after, hi[st] + 1)
        before = np.insert(cl[:-1], 0, 0)
        before = np.where(np.insert(next_same[:-1], 0, False), before, lo[st] - 1)
        new_cr = np.where(left, np.maximum(cr, after), cr)
        new_cl = np.where(left, cl, np.minimum(cl, before))
        at = np.flatnonzero(joins)
        made = textvec.mix(name[at] * _U(0x9E3779B97F4A7C15) + textvec.mix(name[at + 1]) + _U(r))
        name, en_new = name.copy(), en.copy()
        name[at], en_new[at] = made, en[at + 1]
        new_cl[at], new_cr[at] = np.minimum(cl[at], cl[at + 1]), np.maximum(cr[at], cr[at + 1])
        _rank_and_offer(best, made, st[at], en_new[at], new_cl[at], new_cr[at], lo, hi, window)
        keep = ~joined
        name, st, en, cl, cr = name[keep], st[keep], en_new[keep], new_cl[keep], new_cr[keep]
    for level in range(levels - 1, 0, -1):
        half = 1 << (level - 1)
        np.maximum(best[level - 1], best[level], out=best[level - 1])
        np.maximum(best[level - 1][half:], best[level][:-half], out=best[level - 1][half:])
    # Single words, each its own context: a sliding maximum by doubling.
    word = (h >> _U(6)) | (_U(1) << _NAME_BITS)
    width = 1
    while 2 * width <= window:
        word = np.maximum(word, np.append(word[width:], np.zeros(min(width, len(word)), _U))[: len(word)])
        width *= 2
    return starts, np.maximum(np.maximum(best[0][starts], word[starts]), word[starts + window - width] if len(starts) else word[starts])


def _rank_and_offer(best, name, st, en, cl, cr, lo, hi, window) -> None:
    rank = ((en - st).astype(_U) << _NAME_BITS) | (name >> _U(6))
    _offer(best, rank, np.maximum(cr - window, lo[st]), np.where(cl < lo[st], -1, np.minimum(cl, np.where(cr > hi[st], -1, hi[st] - window))))


def window_digests(words: textvec.Words, starts: np.ndarray, window: int) -> np.ndarray:
    """(windows x 2) 128 bits of the BLAKE2b digest of each window's words."""
    raw, at = words.joined()
    view = memoryview(raw)
    found = b"".join([hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(at[starts].tolist(), at[starts + window].tolist())])
    return np.frombuffer(found, "<i8").reshape(-1, 2)


PARSED = "doc_id long, text_sha binary, n_words long, words_sha256 binary, symbols array<long>"


def _parser(window: int):
    def parse(batches):
        for batch in batches:
            for a, b, words in textvec.text_groups(batch.column(2)):
                starts, rank = representatives(words.hashes(), words.of, window)
                doc = words.doc[starts]
                new = np.ones(len(rank), bool)
                new[1:] = (rank[1:] != rank[:-1]) | (doc[1:] != doc[:-1])
                rank, doc = rank[new], doc[new]
                of = np.searchsorted(doc, np.arange(b - a + 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(np.diff(words.of)), pa.array(words.digests(), pa.binary()), pa.ListArray.from_arrays(pa.array(of, pa.int32()), pa.array(rank.view(np.int64)))],
                    names=["doc_id", "text_sha", "n_words", "words_sha256", "symbols"],
                )

    return parse


def _window_lister(window: int):
    """mapInArrow function over (doc_id, part, text, symbols): the windows whose representative is among symbols."""

    def windows(batches):
        for batch in batches:
            lists = batch.column(3)
            for a, b, words in textvec.text_groups(batch.column(2)):
                starts, rank = representatives(words.hashes(), words.of, window)
                of = np.searchsorted(starts, words.of)
                wanted = np.zeros(len(starts), bool)
                for i in range(b - a):
                    mine = np.asarray(lists[a + i].values.to_numpy(zero_copy_only=False)).view(_U) if lists[a + i].is_valid else np.zeros(0, _U)
                    wanted[of[i] : of[i + 1]] = np.isin(rank[of[i] : of[i + 1]], mine)
                starts = starts[wanted]
                doc = words.doc[starts]
                part = batch.column(1).to_numpy()[a + doc].astype(np.int64)
                found = window_digests(words, starts, window)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(a + doc)), pa.array(part << 32 | (starts - words.of[doc])), pa.array(np.ascontiguousarray(found[:, 0])), pa.array(np.ascontiguousarray(found[:, 1]))],
                    names=["doc_id", "spot", "d1", "d2"],
                )

    return windows


def _remover(window: int):
    """mapInArrow function over (doc_id, part, text, at array<int>): what is left of the text."""

    def remove(batches):
        for batch in batches:
            n, digests, kept_texts = [], [], []
            for text, at in zip(batch.column(2).to_pylist(), batch.column(3)):
                words = (text or "").encode().split()
                cover = np.zeros(len(words) + 1, np.int64)
                at = at.values.to_numpy(zero_copy_only=False)
                np.add.at(cover, at, 1)
                np.add.at(cover, at + window, -1)
                keep = np.cumsum(cover[:-1]) == 0
                left = b" ".join(compress(words, keep))
                n.append(len(words) - int(keep.sum()))
                kept_texts.append(left.decode())
                digests.append(hashlib.sha256(left).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(kept_texts, pa.string())], names=["doc_id", "part", "n_removed", "kept_sha256", "kept_text"])

    return remove


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(one row per row of docs, what is left of changed documents).

    The first: doc_id, text_sha (SHA-256), n_words, n_removed, kept_sha256 (binary), changed. The second: doc_id, text_sha,
    kept_text of the documents that lose some words but not as whole copies (whose kept text is empty).

    Copies of a whole word sequence are settled by its digest; only the copy with the smallest doc_id is parsed further. What
    is joined to rows that one passage or text may have many of is staged first, so that Spark can split the join.
    """
    spark = docs.sparkSession
    docs = shared.documents(docs).select("doc_id", F.unhex(F.sha2("text", 256)).alias("text_sha"), "text")
    parsed = shared.staged(docs.mapInArrow(_parser(window), PARSED), "repeat-symbols")
    known = parsed.where("doc_id IS NOT NULL").select("doc_id", "text_sha", "n_words", "words_sha256")
    originals = shared.staged(known.groupBy("words_sha256").agg(F.min("doc_id").alias("first_id")), "repeat-originals")
    order = Window.partitionBy("doc_id").orderBy("text_sha")
    base = shared.staged(
        parsed.select("doc_id", "text_sha", "n_words", "words_sha256").join(originals, "words_sha256", "left").withColumn("part", F.dense_rank().over(order)), "repeat-base"
    )
    first = base.where(F.col("doc_id") == F.col("first_id")).select("doc_id", "text_sha", "part").distinct()

    symbols = parsed.where("doc_id IS NOT NULL").join(first, ["doc_id", "text_sha"]).select("doc_id", "part", F.explode(F.array_distinct("symbols")).alias("symbol"))
    repeated = shared.staged(symbols.groupBy("symbol").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("symbol"), "repeat-shared")
    # Rows of symbols are many, so they carry no digest; it comes back with one join a document.
    suspects = symbols.join(repeated, "symbol").groupBy("doc_id", "part").agg(F.collect_list("symbol").alias("symbols")).join(first, ["doc_id", "part"])
    texts = shared.staged(docs.join(suspects, ["doc_id", "text_sha"]).select("doc_id", "part", "text", "symbols"), "repeat-texts")
    shared.remove(spark, parsed, originals, repeated)

    windows = texts.mapInArrow(_window_lister(window), "doc_id long, spot long, d1 long, d2 long")
    least = windows.groupBy("d1", "d2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("d1", "d2", "low")
    least = shared.staged(least, "repeat-windows")
    hits = windows.join(least, ["d1", "d2"]).where("doc_id > low").select("doc_id", F.expr("cast(shiftright(spot, 32) as int)").alias("part"), F.expr("cast(spot & 4294967295 as int)").alias("at"))
    spots = hits.groupBy("doc_id", "part").agg(F.collect_set("at").alias("at"))
    left = texts.select("doc_id", "part", "text").join(spots, ["doc_id", "part"]).mapInArrow(_remover(window), "doc_id long, part int, n_removed long, kept_sha256 binary, kept_text string")
    left = shared.staged(left.dropDuplicates(["doc_id", "part"]), "repeat-left")
    shared.remove(spark, texts, least)

    copy = F.coalesce((F.col("doc_id") > F.col("first_id")) & (F.col("n_words") >= window), F.lit(False))
    short = base.withColumn("is_copy", copy)
    joined = short.join(left.select("doc_id", "part", "n_removed", F.col("kept_sha256").alias("left_sha256")), ["doc_id", "part"], "left")
    rows = joined.select(
        "doc_id",
        "text_sha",
        F.col("n_words"),
        F.when(F.col("is_copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("is_copy"), F.unhex(F.sha2(F.lit(b""), 256))).otherwise(F.coalesce("left_sha256", "words_sha256")).alias("kept_sha256"),
    ).withColumn("changed", F.col("n_removed") > 0)
    kept = left.join(base.select("doc_id", "part", "text_sha").distinct(), ["doc_id", "part"]).select("doc_id", "text_sha", "kept_text")
    return rows, kept


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of every document without windows of 50 words that start in an earlier one."""
    rows, _ = remove_repeats(shared.table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.lower(F.hex("kept_sha256")).alias("kept_sha256"))


OP2_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS p, w FROM w),
keyed AS (SELECT doc_id, p, array_to_string(w[p : p + 49], ' ') AS k FROM windows),
firsts AS (SELECT k, min(doc_id) AS f FROM keyed GROUP BY k HAVING min(doc_id) < max(doc_id)),
hits AS (SELECT doc_id, p FROM keyed JOIN firsts USING (k) WHERE doc_id > f),
covered AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS pos FROM hits),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS word FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS t FROM words ANTI JOIN covered USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
