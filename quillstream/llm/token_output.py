"""Token files: frequency-ranked ids in a byte-aligned variable-length code with separate control bytes.

An id is written as its rank by corpus frequency, so that the frequent ones take one byte. Values take one to four
little-endian bytes in the data stream; two bits of the control stream hold each length, four to a byte. Decoding looks
a control byte up in a table of four lengths and gathers the data bytes.

``write_tokens`` makes three tables below a path: ``ranks`` (rank, id), ``shards`` (part, shard, doc_ids, lengths, control,
data; part and shard ascend with doc_id) and ``parts`` (part, tokens). ``read_tokens`` decodes them.

Defined results: a null text is empty; every document ends with the end id, so an empty one has one id; rows
ascend by doc_id, null first, and rows that repeat a doc_id follow each other in the order of their ids; an
empty table gives empty files.
"""

from __future__ import annotations

import re
import zlib
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstream.llm import shared
from quillstream.llm.bpe import tokenizer
from quillstream.llm.textvec import row_groups

SHARD_TOKENS = 1 << 20
CACHED_CHUNKS = 1_400_000
LENGTHS = np.array([[1 + (c >> s & 3) for s in (0, 2, 4, 6)] for c in range(256)], np.uint8)


def pack_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit values."""
    v = np.ascontiguousarray(values, "<u4")
    code = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    padded = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    padded[: len(v)] = code
    control = padded.reshape(-1, 4) @ np.array([1, 4, 16, 64], np.uint8)
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4) <= code[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def unpack_values(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values of pack_values."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    starts = np.cumsum(lengths, dtype=np.int64) - lengths
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)])
    out = raw[starts].astype(np.uint32)
    for more in (1, 2, 3):
        long = np.flatnonzero(lengths > more)
        if len(long):
            out[long] |= raw[starts[long] + more].astype(np.uint32) << np.uint32(8 * more)
    return out


def id_type(path: str) -> str:
    """The numpy type of ids on their way to the files: two bytes where the vocabulary allows."""
    return "<u2" if max(tokenizer(path).get_vocab(with_added_tokens=True).values(), default=0) < 1 << 16 else "<u4"


#: What simple lower-casing and splitting must not touch: all but Latin characters without combining marks, and the dotted capital I.
_NOT_PLAIN = re.compile("[^\x00-\u012f\u0131-\u024f]")
#: Punctuation between a letter and a space.
_AFTER_LETTER = re.compile("[.,;:!?](?<=[a-z\xdf-\xf6\xf8-\u024f].)[.,;:!?]*(?= |\\Z)")


_caches: dict[str, dict[str, bytes]] = {}


def chunks_of(text: str) -> list[str]:
    """Parts of a text that the vocabulary encodes one by one.

    Its words never hold white space, so spaces separate parts that do not depend on each other; in plain Latin texts capitals are
    lower-cased, as the vocabulary does, and punctuation is cut from a letter before it, where it begins a word of its own anyway.
    """
    text = text.replace("\n", " ")
    if "<|" not in text and not _NOT_PLAIN.search(text):
        text = _AFTER_LETTER.sub(" \\g<0>", text.lower())
    return text.split(" ")


def _tokenizing(path: str, end_id: int):
    """mapInArrow function: ids of whole texts. A bounded cache of chunks, kept between a process's tasks, answers most of a text."""

    def run(batches):
        kind = id_type(path)
        width, code = (2, "H") if kind == "<u2" else (4, "I")
        encode_batch, cache, last = tokenizer(path).encode_batch_fast, _caches.setdefault(path, {}), np.array([end_id], kind).tobytes()
        for batch in (b.slice(a, z - a) for b in batches for a, z in row_groups(b.column(1))):
            texts = [chunks_of(t or "") for t in batch.column(1).to_pylist()]
            if len(cache) > CACHED_CHUNKS:
                cache.clear()
            missing = list(set(chain.from_iterable(texts)).difference(cache))
            for a in range(0, len(missing), 20_000):
                part = missing[a : a + 20_000]
                cache.update(zip(part, (array(code, e.ids).tobytes() for e in encode_batch(part, add_special_tokens=False))))
            ids = [b"".join(map(cache.__getitem__, chunks)) + last for chunks in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(i) // width for i in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return run


def tokenize(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """(doc_id, n_tokens, ids): the library's ids of whole texts and the end id, as little-endian integers of id_type(path)."""
    return shared.documents(docs).mapInArrow(_tokenizing(path, end_id), "doc_id long, n_tokens long, ids binary")


def _counting(kind: str):
    """mapInArrow function: how often a partition has each id."""

    def count(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            # The values of a binary column lie one after the other in its data buffer.
            ids = batch.column(0).cast(pa.large_binary())
            ends = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset : ids.offset + len(ids) + 1]
            raw = ids.buffers()[2]
            one = np.bincount(np.frombuffer(raw, np.uint8)[ends[0] : ends[-1]].view(kind)) if raw is not None and len(ids) else total[:0]
            if len(one) > len(total):
                total, one = one.astype(np.int64), total
            total[: len(one)] += one
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pa.array(total[some])], names=["id", "n"])

    return count


def _sharder(rank_of: np.ndarray, kind: str):
    """mapInArrow function over rows sorted by doc_id: packed shards of the task's part."""

    def run(batches):
        from pyspark import TaskContext

        part, shard, width = TaskContext.get().partitionId(), 0, np.dtype(kind).itemsize
        docs, ids, n = [], [], 0

        def flush():
            values = rank_of[np.frombuffer(b"".join(ids), kind)]
            control, data = pack_values(values)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int64()), pa.array([shard], pa.int64()), pa.array([docs], pa.list_(pa.int64())), pa.array([[len(i) // width for i in ids]], pa.list_(pa.int64())), pa.array([control], pa.binary()), pa.array([data], pa.binary())],
                names=["part", "shard", "doc_ids", "lengths", "control", "data"],
            )

        for batch in batches:
            for doc_id, one in zip(batch.column(0).to_pylist(), batch.column(1)):
                docs.append(doc_id)
                ids.append(one.as_py())
                n += len(ids[-1]) // width
                if n >= SHARD_TOKENS:
                    yield flush()
                    docs, ids, n, shard = [], [], 0, shard + 1
        if docs:
            yield flush()

    return run


def write_tokens(docs: DataFrame, out: str, path: str, end_id: int = 1) -> None:
    """Tokenize docs and write the token files below ``out``."""
    spark, kind = docs.sparkSession, id_type(path)
    tokens = shared.staged(tokenize(docs, path, end_id), "tokens")
    counts = tokens.select("ids").mapInArrow(_counting(kind), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    ranked = [r[0] for r in counts.orderBy(F.desc("n"), "id").collect()]  # as many rows as the vocabulary at most
    spark.createDataFrame([(i, v) for i, v in enumerate(ranked)], "rank long, id long").coalesce(1).write.parquet(f"{out}/ranks")
    rank_of = np.zeros(max(ranked, default=0) + 1, np.uint32)
    rank_of[np.array(ranked, np.int64)] = np.arange(len(ranked), dtype=np.uint32)
    placed = tokens.select("doc_id", "ids").repartitionByRange("doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids")
    placed.mapInArrow(_sharder(rank_of, kind), "part long, shard long, doc_ids array<long>, lengths array<long>, control binary, data binary").write.parquet(f"{out}/shards")
    sizes = spark.read.parquet(f"{out}/shards").select("part", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    sizes.groupBy("part").agg(F.sum("n").alias("tokens")).coalesce(1).write.parquet(f"{out}/parts")


def _unsharder(id_of: np.ndarray):
    def run(batches):
        for batch in batches:
            for begin, docs, lengths, control, data in zip(*(batch.column(i) for i in range(5))):
                docs, lengths = docs.as_py(), np.array(lengths.as_py(), np.int64)
                total = int(lengths.sum())
                ids = id_of[unpack_values(control.as_py(), data.as_py(), total)].astype("<u4")
                raw, ends = memoryview(ids.tobytes()), np.cumsum(lengths)
                starts = ends - lengths
                parts = [raw[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64()), pa.array(starts + begin.as_py()), pa.array(lengths), pa.array([zlib.crc32(p) for p in parts], pa.int64()), pa.array([bytes(p) for p in parts], pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                )

    return run


def read_tokens(spark: SparkSession, out: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document in the files of ``out``."""
    ids = [r[0] for r in spark.read.parquet(f"{out}/ranks").orderBy("rank").select("id").collect()]
    parts = spark.read.parquet(f"{out}/parts").orderBy("part").collect()  # one row per shuffle partition
    begins, total = [], 0
    for r in parts:
        begins.append((r["part"], total))
        total += r["tokens"]
    shards = spark.read.parquet(f"{out}/shards")
    sizes = shards.select("part", "shard", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    before = F.sum("n").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    first = spark.createDataFrame(begins, "part long, begin long")
    placed = sizes.withColumn("before", F.coalesce(before, F.lit(0))).join(F.broadcast(first), "part").select("part", "shard", (F.col("begin") + F.col("before")).alias("begin"))
    rows = shards.join(placed, ["part", "shard"]).select("begin", "doc_ids", "lengths", "control", "data")
    return rows.mapInArrow(_unsharder(np.array(ids, np.uint32)), "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents' ids, end id 1 after each, and list what the files hold."""
    import public_tokenizers

    out = shared.work_dir(spark, "token-files")
    write_tokens(shared.table(spark, sf_dir, "documents"), out, public_tokenizers.path("word_bpe_49k.json"), 1)
    return read_tokens(spark, out).select("doc_id", "start", "n_tokens", "ids_crc32")
