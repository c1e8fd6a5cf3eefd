"""MinHash near-duplicate detection with tensored banding.

Two small collections of band hashes are computed per document, each band over BAND_ROWS minhashes;
the table keys are all pairs (i-th hash of the first collection, j-th of the second). TABLES**2 keys of
2 * BAND_ROWS rows cost 2 * TABLES * BAND_ROWS minhashes: about a square root of what independent tables
would need. Hashes only propose candidates; every link is confirmed on the full sets of word shingles, word for word.

No bucket is capped and none emits all its pairs:
1. documents of equal word sequences (by SHA-256) are one class, represented by its smallest id;
2. the members of a bucket are compared with two centres, its smallest id and its best-connected one;
3. members of a bucket that still lie in different components are compared in blocks of about BLOCK_MEMBERS documents, all
   full sets of a block with all of another by matrix products; the pairs of blocks are dealt out by both numbers, and a
   pair yields no more links than it takes to connect its components.
Components of the verified links are the result. A linked pair is missed only if it shares no key and no other links connect
it: 1 - (1 - (1 - s**BAND_ROWS)**TABLES)**2 of pairs at similarity s, which is under 3 in 10,000 at 0.85. The number of tables follows from the
threshold, so that this holds at other thresholds too.

Defined results: null or empty texts and texts without words have an empty set and link with nothing; a text of fewer
words than a shingle has its whole word sequence as its one shingle; each input row yields a result row;
of rows that repeat a doc_id with different texts one, the same in every run, stands for the document in
all comparisons; rows with a null doc_id are returned with null component_id and kept = true. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.llm import shared, textvec
from quillstream.llm.components import components

BAND_ROWS, MISSED = 2, 3e-4
MOST_TABLES = 32
MEMBERS = 128
BLOCK_MEMBERS, BLOCK_BYTES, COLUMNS = 256, 8 << 20, 4096

_rng = np.random.default_rng(20240117)
_FLIP = _rng.integers(0, 2**64, 2 * MOST_TABLES * BAND_ROWS, np.uint64)
_STEP = _rng.integers(0, 2**64, 2 * MOST_TABLES * BAND_ROWS, np.uint64) | np.uint64(1)
_PLACE = _rng.integers(0, 2**64, 64, np.uint64) | np.uint64(1)


def missed_share(tables: int, percent: int) -> float:
    """The share of pairs at the threshold that have no key in common."""
    return 1 - (1 - (1 - (percent / 100) ** BAND_ROWS) ** tables) ** 2


def tables_for(percent: int) -> int:
    """The fewest tables a side that miss at most MISSED of the pairs at the threshold; MOST_TABLES below about 0.4."""
    return next((t for t in range(1, MOST_TABLES) if missed_share(t, percent) <= MISSED), MOST_TABLES)


def shingles(words: textvec.Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers, fingerprints) of the distinct shingles of each document in a group, and where documents begin.

    Within the group equal numbers mean equal shingles, word for word; fingerprints are the same in every group.
    """
    word, h, counts = words.numbers(), words.hashes(), np.diff(words.of)
    n, distinct = len(word), int(words.numbers().max(initial=0)) + 1
    number, s = word.copy(), h * _PLACE[0]
    for k in range(1, min(width, n)):
        number[: n - k] = pd.factorize(number[: n - k] * distinct + word[k:])[0]
        s[: n - k] += h[k:] * _PLACE[k]
    whole = np.arange(n) + width <= np.repeat(words.of[1:], counts)
    sequences: dict[tuple, int] = {}
    for d in np.flatnonzero((counts > 0) & (counts < width)):  # its words are fewer than a shingle's: one shingle of them all, marked by their number
        a, b = words.of[d], words.of[d + 1]
        number[a] = n + sequences.setdefault(tuple(word[a:b].tolist()), len(sequences))
        s[a] = (h[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
        whole[a] = True
    span = n + len(sequences) + 1
    key, first = np.unique(words.doc[whole] * span + number[whole], return_index=True)
    return key % span, textvec.mix(s[whole])[first], np.searchsorted(key, np.arange(len(counts) + 1) * span)


def minhashes(s: np.ndarray, of: np.ndarray, tables: int) -> np.ndarray:
    """(documents x hashes) smallest values of the documents' shingles."""
    n = 2 * tables * BAND_ROWS
    return np.stack([textvec.by_doc(np.minimum, (s ^ flip) * step, of, 0) for flip, step in zip(_FLIP[:n], _STEP[:n])], axis=1)


SIGNATURE_SCHEMA = "doc_id long, text_sha binary, n long, words_sha binary, sum long, left array<long>, right array<long>"


def _signer(width: int, tables: int):
    def sign(batches):
        for batch in batches:
            ids, hashes = batch.column(0), batch.column(1)
            for a, b, words in textvec.text_groups(batch.column(2), lower=True):
                _, s, of = shingles(words, width)
                m = minhashes(s, of, tables)
                bands = np.zeros((b - a, 2 * tables), np.uint64)
                for k in range(BAND_ROWS):
                    bands = textvec.mix(bands * np.uint64(3) + m[:, k::BAND_ROWS])
                total = textvec.by_doc(np.add, textvec.mix(s), of, 0)
                lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * tables, pa.int32()), pa.array(np.ascontiguousarray(x).ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), hashes.slice(a, b - a), pa.array(np.diff(of)), pa.array(words.digests(), pa.binary()), pa.array(total.view(np.int64)), lists(bands[:, :tables]), lists(bands[:, tables:])],
                    names=["doc_id", "text_sha", "n", "words_sha", "sum", "left", "right"],
                )

    return sign


def _sha(text: str) -> Column:
    return F.unhex(F.sha2(text, 256))


def signatures(docs: DataFrame, width: int, tables: int) -> DataFrame:
    """Per row of docs(doc_id, text): digests of the text and of its words, set size n, the sum of the set's fingerprints and band hashes."""
    return docs.select("doc_id", _sha("text").alias("text_sha"), "text").mapInArrow(_signer(width, tables), SIGNATURE_SCHEMA)


def _linked(sizes_a, sizes_b, common, percent: int):
    return 100 * common >= percent * (sizes_a + sizes_b - common)


def _verifier(width: int, percent: int):
    """mapInArrow function over rows (block, is_centre, id, text), sorted by block with the centre first.

    Rows are taken together up to about two megabytes of text, whatever blocks they belong to, and compared shingle by shingle.
    """

    def links(ids, centres, texts):
        number, _, of = shingles(textvec.words_of(pa.array(texts, pa.large_string()), lower=True), width)
        size, doc, centre = np.diff(of), np.repeat(np.arange(len(texts)), np.diff(of)), np.array(centres)
        span = int(number.max(initial=0)) + 1
        keys, member = doc * span + number, centre[doc] >= 0
        wanted = centre[doc[member]] * span + number[member]
        at = np.searchsorted(keys, wanted)
        hit = keys[np.minimum(at, max(0, len(keys) - 1))] == wanted
        common = np.bincount(doc[member][hit], minlength=len(texts))
        good = np.flatnonzero((centre >= 0) & (size > 0) & _linked(size, size[centre], common, percent))
        return pa.RecordBatch.from_arrays([pa.array([ids[i] for i in good], pa.int64()), pa.array([ids[centres[i]] for i in good], pa.int64())], names=["a", "b"])

    def verify(batches):
        ids, centres, texts, held = [], [], [], 0
        centre, at = (None, None, None), -1
        for batch in batches:
            names = batch.schema.names
            for block, is_centre, i, text in zip(*(batch.column(names.index(c)).to_pylist() for c in ("block", "is_centre", "id", "text"))):
                if is_centre:
                    centre, at = (block, i, text), -1
                    continue
                if centre[0] != block:
                    raise ValueError("a block of candidates came without its centre")
                if at < 0:
                    at = len(ids)
                    ids.append(centre[1])
                    centres.append(-1)
                    texts.append(centre[2])
                    held += len(centre[2])
                ids.append(i)
                centres.append(at)
                texts.append(text)
                held += len(text)
                if held > textvec.GROUP_BYTES:
                    yield links(ids, centres, texts)
                    ids, centres, texts, held, at = [], [], [], 0, -1
        if ids:
            yield links(ids, centres, texts)

    return verify


def verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Of distinct pairs (id, centre) those whose full sets are similar enough, as edges (a, b).

    Members of a centre are dealt over blocks of about MEMBERS, each with its own copy of the centre's text.
    """
    # Staged, so that Spark can split the join at a centre with many members.
    per = shared.staged(pairs.groupBy("centre").agg(F.count("*").alias("members")), "near-centres")
    dealt = pairs.join(per, "centre").select(
        "id", "centre", F.pmod(F.xxhash64("id"), F.ceil(F.col("members") / MEMBERS)).alias("salt")
    )
    block = F.struct("centre", "salt")
    rows = dealt.select(block.alias("block"), F.lit(False).alias("is_centre"), "id").unionAll(
        dealt.select("centre", "salt").distinct().select(block.alias("block"), F.lit(True).alias("is_centre"), F.col("centre").alias("id"))
    )
    with_text = rows.join(texts, "id").select(F.xxhash64("block").alias("part"), F.concat_ws("-", "block.centre", "block.salt").alias("block"), "is_centre", "id", "text")
    sorted_rows = with_text.repartition("part").sortWithinPartitions("part", "block", F.desc("is_centre"))
    edges = sorted_rows.select("block", "is_centre", "id", "text").mapInArrow(_verifier(width, percent), "a long, b long")
    edges = shared.staged(edges, "near-edges")
    shared.remove(pairs.sparkSession, per)
    return edges


PACKED = "u long, block long, ids binary, comps binary, lengths binary, texts binary"


def _block_packer(batches):
    """mapInPandas function over rows (u, chunk, id, comp, text) sorted by u and chunk: packed blocks of a chunk, cut by bytes too."""
    import zstandard

    held, rows, size, piece = None, [], 0, 0

    def flush():
        ids, comps, texts = zip(*rows)
        raw = [t.encode() for t in texts]
        number = lambda values: np.array(values, np.int64).tobytes()
        return pd.DataFrame({"u": [held[0]], "block": [held[1] << 20 | piece], "ids": [number(ids)], "comps": [number(comps)], "lengths": [number([len(t) for t in raw])], "texts": [zstandard.compress(b"".join(raw), 3)]})

    for pdf in batches:
        for u, chunk, i, comp, text in zip(pdf["u"], pdf["chunk"], pdf["id"], pdf["comp"], pdf["text"]):
            if held != (u, chunk) or size > BLOCK_BYTES:
                if rows:
                    yield flush()
                piece = piece + 1 if held == (u, chunk) else 0
                held, rows, size = (u, chunk), [], 0
            rows.append((i, comp, text))
            size += len(text)
    if rows:
        yield flush()


def common_of_blocks(raw: list[bytes], lengths: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set sizes of the first block, those of the second, sizes of all intersections between them)."""
    bounds = np.concatenate([[0], np.cumsum(np.concatenate(lengths))]).astype(np.int64)
    texts = pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.tobytes()), pa.py_buffer(b"".join(raw)))
    number, _, of = shingles(textvec.words_of(texts, lower=True), width)
    n = len(lengths[0])
    s, t = number[: of[n]], number[of[n] :]
    return np.diff(of[: n + 1]), np.diff(of[n:]), common_counts(s, of[: n + 1], t, of[n:] - of[n])


def common_counts(s: np.ndarray, of: np.ndarray, t: np.ndarray, to: np.ndarray) -> np.ndarray:
    """(documents of s x documents of t) sizes of the intersections of their sets, by products of 0/1 matrices over shared shingles."""
    both = np.intersect1d(s, t)
    out = np.zeros((len(of) - 1, len(to) - 1), np.float32)

    def places(values, bounds):
        at = np.minimum(np.searchsorted(both, values), max(0, len(both) - 1))
        hit = both[at] == values if len(both) else np.zeros(len(values), bool)
        return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[hit], at[hit]

    (si, sj), (ti, tj) = places(s, of), places(t, to)
    for low in range(0, len(both), COLUMNS):
        a, b = np.zeros((out.shape[0], COLUMNS), np.float32), np.zeros((out.shape[1], COLUMNS), np.float32)
        m, n = (sj >= low) & (sj < low + COLUMNS), (tj >= low) & (tj < low + COLUMNS)
        a[si[m], sj[m] - low], b[ti[n], tj[n] - low] = 1, 1
        out += a @ b.T
    return out.astype(np.int64)


def _block_linker(width: int, percent: int):
    """mapInPandas function over packed blocks (low, high, ...), the two of a pair one after the other: links between components, as few as connect them."""
    import zstandard

    def pair(x, y):
        if len(set(np.frombuffer(x["comps"] + y["comps"], np.int64).tolist())) == 1:
            return pd.DataFrame({"a": [], "b": []}).astype("int64")
        blocks = [(np.frombuffer(r["ids"], np.int64), np.frombuffer(r["comps"], np.int64), np.frombuffer(r["lengths"], np.int64), zstandard.decompress(r["texts"])) for r in (x, y)]
        (ids_i, comps_i, _, _), (ids_j, comps_j, _, _) = blocks
        m, n, common = common_of_blocks([b[3] for b in blocks], [b[2] for b in blocks], width)
        parent: dict[int, int] = {}

        def root(c):
            while parent.get(c, c) != c:
                c = parent[c]
            return c

        out = []
        for a, b in zip(*(z.tolist() for z in np.nonzero(_linked(m[:, None], n[None, :], common, percent) & (comps_i[:, None] != comps_j[None, :])))):
            p, q = root(int(comps_i[a])), root(int(comps_j[b]))
            if p != q:
                parent[max(p, q)] = min(p, q)
                out.append((ids_i[a], ids_j[b]))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    def link(batches):
        first = None
        for pdf in batches:
            for r in pdf.to_dict("records"):
                if r["low"] == r["high"]:
                    yield pair(r, r)
                elif first is None:
                    first = r
                else:
                    if (first["u"], first["low"], first["high"]) != (r["u"], r["low"], r["high"]):
                        raise ValueError("a pair of blocks came apart")
                    yield pair(first, r)
                    first = None

    return link


def paired_blocks(packed: DataFrame) -> DataFrame:
    """Packed blocks once for each block of their union, dealt by (u, low, high) so that the two of a pair follow each other."""
    numbers = packed.groupBy("u").agg(F.array_sort(F.collect_list("block")).alias("all"))  # one number for about BLOCK_MEMBERS documents
    each = packed.join(numbers, "u").withColumn("other", F.explode("all"))
    ends = each.select("u", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), *[c for c in packed.columns if c != "u"])
    return ends.repartition("u", "low", "high").sortWithinPartitions("u", "low", "high", "block")


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Links join documents whose sets of ``shingle_words``-word shingles have 100 * |A and B| >= percent * |A or B|.
    """
    spark, docs = docs.sparkSession, shared.documents(docs)
    sigs = shared.staged(signatures(docs, shingle_words, tables_for(percent)), "near-signatures")
    whole = F.struct("text_sha", "n", "words_sha", "sum", "left", "right")
    known = sigs.where("doc_id IS NOT NULL AND n > 0").groupBy("doc_id").agg(F.min_by(whole, "text_sha").alias("r")).select("doc_id", "r.*")
    classes = known.groupBy("words_sha").agg(F.min_by(F.struct("doc_id", "text_sha", "n", "sum", "left", "right"), "doc_id").alias("r"))
    classes = shared.staged(classes.select("words_sha", F.col("r.doc_id").alias("id"), "r.text_sha", "r.n", "r.sum", "r.left", "r.right"), "near-classes")

    # Sets too small to differ and still reach the threshold link by equality alone: they have one key, of the whole set.
    least_n = next(n for n in range(1, 1000) if 100 * n >= percent * (n + 1))
    crossed = F.flatten(F.transform("left", lambda x, i: F.transform("right", lambda y, j: F.xxhash64(i, j, x, y))))
    keys = classes.select(F.explode(F.when(F.col("n") < least_n, F.array(F.xxhash64("n", "sum"))).otherwise(crossed)).alias("key"), "id", "n")
    sizes = keys.groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct("id", "n")).alias("first")).where("size > 1")
    # What is joined to rows that one key may have many of is staged first, so that Spark can split the join.
    sizes = shared.staged(sizes, "near-sizes")
    buckets = shared.staged(keys.join(sizes, "key"), "near-buckets")

    degree = buckets.groupBy("id").agg(F.sum("size").alias("degree"))
    busiest = buckets.join(degree, "id").groupBy("key").agg(F.max_by(F.struct("id", "n"), F.struct("degree", -F.col("id"))).alias("hub"))
    busiest = shared.staged(busiest, "near-hubs")
    centred = shared.staged(buckets.join(busiest, "key").select("key", "id", "n", "first", "hub"), "near-centred")
    shared.remove(spark, buckets, sizes, busiest)
    # Set sizes bound the similarity: what cannot reach the threshold needs no comparison.
    pairs = centred.select("id", "n", F.explode(F.array("first", "hub")).alias("c")).where("id <> c.id").where(100 * F.least("n", "c.n") >= percent * F.greatest("n", "c.n"))
    pairs = shared.staged(pairs.select("id", F.col("c.id").alias("centre")).distinct(), "near-pairs")
    # Copies of a row need no second text: one partial aggregate each, on ids that share a key.
    wanted = classes.select("id", "text_sha").join(centred.select("id").distinct(), "id", "left_semi")
    named = docs.select(F.col("doc_id").alias("id"), _sha("text").alias("text_sha"), "text")
    texts = shared.staged(named.join(wanted, ["id", "text_sha"], "left_semi").groupBy("id").agg(F.first("text").alias("text")), "near-texts")
    edges = verified(pairs, texts, shingle_words, percent)
    comp = shared.staged(components(edges, "near-stars"), "near-components")

    # Members, other than the centres, whose bucket still spans components: compare sets across them.
    open_rows = centred.where("id <> first.id AND id <> hub.id").join(comp, "id", "left").select("key", "id", F.coalesce("comp", "id").alias("comp"))
    split = open_rows.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
    spanning = shared.staged(open_rows.join(split, "key").select("id", "comp", "low").distinct(), "near-spanning")
    if not spanning.isEmpty():
        union = components(spanning.select(F.col("comp").alias("a"), F.col("low").alias("b")), "near-unions").select(F.col("id").alias("comp"), F.col("comp").alias("u"))
        members = spanning.select("id", "comp").distinct().join(union, "comp").join(texts, "id")
        count = members.groupBy("u").agg(F.ceil(F.count("*") / BLOCK_MEMBERS).alias("chunks"))
        chunked = members.join(count, "u").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")))
        packed = chunked.repartition("u", "chunk").sortWithinPartitions("u", "chunk").select("u", "chunk", "id", "comp", "text")
        packed = shared.staged(packed.mapInPandas(_block_packer, PACKED), "near-blocks")
        more = shared.staged(paired_blocks(packed).mapInPandas(_block_linker(shingle_words, percent), "a long, b long"), "near-more-edges")
        comp = shared.staged(components(comp.select(F.col("id").alias("a"), F.col("comp").alias("b")).unionAll(more), "near-final"), "near-components")
        shared.remove(spark, packed)

    shared.remove(spark, centred, pairs, texts)
    of_class = shared.staged(classes.join(comp, "id", "left").select("words_sha", F.coalesce("comp", "id").alias("component_id")), "near-classes")
    # Of rows that repeat a doc_id the one that stood for the document decides; its words' digest leads to the class.
    of_doc = known.select("doc_id", "words_sha").join(of_class, "words_sha").select("doc_id", "component_id")
    linked = sigs.select("doc_id", "n").join(of_doc, "doc_id", "left").withColumn(
        "component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    )
    return linked.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: three-word shingles, similarity of 85 in 100."""
    return near_duplicates(shared.table(spark, sf_dir, "documents"), shingle_words=3, percent=85)


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) BETWEEN 1 AND 2 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM common JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
reach(id, seen) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.id, l.y FROM reach r JOIN (SELECT x, y FROM links UNION ALL SELECT y, x FROM links) l ON l.x = r.seen)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id, d.doc_id = r.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT id, min(seen) AS component_id FROM reach GROUP BY id) r ON r.id = d.doc_id
"""
