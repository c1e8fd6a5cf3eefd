"""Byte-level BPE over a table of distinct words.

Texts are split into words at places where the tokenizer's own splitting can never join characters: before a
space that precedes a non-space, and around white space and added special tokens. Each distinct word of the corpus is
encoded once; its ids come back by block and position:

1. a block is the documents of one task up to BLOCK_BYTES of text. It numbers its distinct words and asks for their ids by
   bucket, a hash of the word, in one packed row per bucket; its documents become word numbers, packed too;
2. the rows of a bucket meet; each distinct word among them is encoded once and every asking block gets its words' ids;
3. the ids of a block's words and its documents meet, and the documents' ids are gathered by word number and position.

Every step streams over sorted rows, so memory holds one block's words, or one bucket's distinct words and ASKING rows of it, and
a word that every block asks for costs each block once, however often it occurs. Step 1's two outputs are computed from one scan
each; blocks are named by a digest of their words, and ids that do not fit a block's words raise an error. Decoding joins ids to the
id-to-piece table, which is as large as the vocabulary.

Defined results: a null text is empty and has no ids; text inside which an added token is spelled out gets that
token's id, as the tokenizers library does; repeated rows stay repeated; a null doc_id is kept. An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections import defaultdict
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.llm import shared

BLOCK_BYTES, OUT_BYTES, PACK_WORDS, BUCKETS_PER_PARTITION = 8 << 20, 4 << 20, 1 << 16, 16
#: Rows of a bucket that are answered together.
ASKING = 64
#: White space as the tokenizer's pattern has it.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WORD = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
#: Between packed words. A word never holds white space after another character, so this stands in none.
SEPARATOR = "\x00\n\x00"
_tokenizers: dict = {}


def tokenizer(path: str):
    """The tokenizer of a file, loaded once per process, without truncation and padding."""
    if path not in _tokenizers:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _tokenizers[path] = t
    return _tokenizers[path]


def special_tokens(path: str) -> list[str]:
    return [t.content for t in tokenizer(path).get_added_tokens_decoder().values()]


def words_of(text: str, special: re.Pattern | None) -> list[str]:
    """The text cut into words whose encodings, one after the other, are the text's encoding."""
    if special is None or not special.search(text):
        return _WORD.findall(text)
    return list(chain.from_iterable([part] if i % 2 else _WORD.findall(part) for i, part in enumerate(special.split(text))))


def _special_pattern(path: str) -> re.Pattern | None:
    names = special_tokens(path)
    return re.compile("(" + "|".join(re.escape(n) for n in sorted(names, key=len, reverse=True)) + ")") if names else None


def _blocks(batches, path: str, block_bytes: int):
    """Yields (its words in order of first use, [(doc_id, word numbers)]) of each block of a task's rows."""
    special = _special_pattern(path)
    filled = 0
    numbers, docs = defaultdict(count().__next__), []
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            words = words_of(text.as_py() or "", special)
            docs.append((doc_id, np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words))))
            filled += sum(map(len, words)) + 16
            if filled >= block_bytes:
                yield list(numbers), docs
                filled = 0
                numbers, docs = defaultdict(count().__next__), []
    if docs:
        yield list(numbers), docs


def _digest(words: list[str]) -> tuple[int, bytes]:
    """A block's id and a longer digest to check it by: both follow from its words, so blocks with the same words are one."""
    found = hashlib.blake2b(SEPARATOR.join(words).encode(), digest_size=24).digest()
    return int.from_bytes(found[:8], "little", signed=True), found[8:]


def _bucket_order(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the words by bucket, then by word; the bucket of each). A bucket is a hash of the word."""
    bucket = np.fromiter((zlib.crc32(w.encode()) % buckets for w in words), np.int64, len(words))
    by_word = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
    order = by_word[np.argsort(bucket[by_word], kind="stable")]
    return order, bucket[order]


def _requester(path: str, block_bytes: int, buckets: int):
    """mapInArrow function: for each block and bucket, the bucket's words of that block, packed in order."""
    import zstandard

    def ask(batches):
        for words, _ in _blocks(batches, path, block_bytes):
            block, _ = _digest(words)
            order, bucket = _bucket_order(words, buckets)
            cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])).tolist() + [len(order)] if len(order) else [0]
            packs = [zstandard.compress(SEPARATOR.join([words[i] for i in order[a:b].tolist()]).encode(), 3) for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]]), pa.array(np.full(len(packs), block, np.int64)), pa.array(packs, pa.binary())], names=["bucket", "block", "words"])

    return ask


def _planes(numbers: np.ndarray) -> bytes:
    """Little-endian unsigned 32-bit integers, one byte place after the other: the high places hardly take room."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length or several, behind their lengths."""
    import zstandard

    head = np.array([len(arrays), *map(len, arrays)], "<u4").tobytes()
    return head + zstandard.compress(b"".join(map(_planes, arrays)), 3)


def _unpack(packed: bytes) -> list[np.ndarray]:
    import zstandard

    n = int.from_bytes(packed[:4], "little")
    sizes = np.frombuffer(packed, "<u4", n, 4).tolist()
    raw, out, at = zstandard.decompress(packed[4 + 4 * n :]), [], 0
    for size in sizes:
        out.append(_from_planes(raw[at : at + 4 * size]))
        at += 4 * size
    return out


MEETING = "block long, kind int, bucket long, doc_ids array<long>, check binary, payload binary"


def _meeting(block, kind, buckets, doc_ids, check, payloads):
    n = len(payloads)
    return pa.RecordBatch.from_arrays(
        [pa.array(block if isinstance(block, list) else [block] * n, pa.int64()), pa.array([kind] * n, pa.int32()), pa.array(buckets, pa.int64()), pa.array(doc_ids, pa.list_(pa.int64())), pa.array([check] * n, pa.binary()), pa.array(payloads, pa.binary())],
        names=["block", "kind", "bucket", "doc_ids", "check", "payload"],
    )


def _sender(path: str, block_bytes: int, buckets: int):
    """mapInArrow function: a block's word order (kind 1) and its documents as word numbers (kind 2), PACK_WORDS at a time."""

    def send(batches):
        for words, docs in _blocks(batches, path, block_bytes):
            block, check = _digest(words)
            yield _meeting(block, 1, [0], [None], check, [_pack(_bucket_order(words, buckets)[0])])
            ids, numbers, held = [], [], 0
            for k, (doc_id, one) in enumerate(docs):
                ids.append(doc_id)
                numbers.append(one)
                held += len(one)
                if held >= PACK_WORDS or k == len(docs) - 1:
                    yield _meeting(block, 2, [k], [ids], check, [_pack(np.array(list(map(len, numbers))), np.concatenate(numbers))])
                    ids, numbers, held = [], [], 0

    return send


def _encoder(path: str):
    """mapInArrow function over rows (bucket, block, words) sorted by bucket: each distinct word of a bucket is encoded once."""
    import zstandard

    def answers(rows, known: dict[str, bytes]):
        """Packed ids (kind 0) for each block that asked; known: the ids of the bucket's words so far, extended by new ones."""
        asked = [(block, zstandard.decompress(packed).decode().split(SEPARATOR)) for _, block, packed in rows]
        new = list(dict.fromkeys(w for _, words in asked for w in words if w not in known))
        known.update(zip(new, (array("I", e.ids).tobytes() for e in tokenizer(path).encode_batch_fast(new, add_special_tokens=False))))
        payloads = []
        for _, words in asked:
            found = [known[w] for w in words]
            payloads.append(_pack(np.fromiter(map(len, found), np.int64, len(found)) // 4, np.frombuffer(b"".join(found), "<u4")))
        return _meeting([block for block, _ in asked], 0, [rows[0][0]] * len(asked), [None] * len(asked), None, payloads)

    def encode(batches):
        rows, known = [], {}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if rows and (rows[0][0] != row[0] or len(rows) == ASKING):
                    yield answers(rows, known)
                    known = known if rows[0][0] == row[0] else {}
                    rows = []
                rows.append(row)
        if rows:
            yield answers(rows, known)

    return encode


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[start : start + length] of each stretch, one after the other."""
    total = int(lengths.sum())
    return values[np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(total)]


def _assembler(batches):
    """mapInArrow function over rows sorted by block, kind and bucket: ids of a block's words, their order, its documents."""

    def batch_of(out):
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([len(x[1]) // 4 for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], names=["doc_id", "n_tokens", "ids"])

    block, last_bucket, answers, table, check = None, None, [], None, None
    for batch in batches:
        out, held = [], 0
        for b, kind, bucket, doc_ids, own_check, payload in zip(*batch.columns[:6]):
            b, kind, bucket = b.as_py(), kind.as_py(), bucket.as_py()
            if b != block:
                block, last_bucket, answers, table, check = b, None, [], None, None
            if kind == 0:
                if bucket != last_bucket:  # blocks of the same words ask, and are answered, more than once
                    answers.append(_unpack(payload.as_py()))
                last_bucket = bucket
                continue
            if kind == 1:
                if table is None:
                    (order,) = _unpack(payload.as_py())
                    lengths = np.concatenate([x[0] for x in answers]).astype(np.int64) if answers else np.zeros(0, np.int64)
                    if len(lengths) != len(order):
                        raise ValueError(f"block {block} has {len(order)} words and got ids of {len(lengths)}")
                    size, start = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
                    size[order], start[order] = lengths, np.cumsum(lengths) - lengths
                    table, check, answers = (np.concatenate([x[1] for x in answers]) if answers else np.zeros(0, np.uint32), start, size), own_check.as_py(), []
                continue
            if own_check.as_py() != check:
                raise ValueError(f"block {block} was computed from different rows")
            lengths, numbers = _unpack(payload.as_py())
            ids = gather(table[0], table[1][numbers], table[2][numbers]).astype("<u4")
            # Where documents end, in ids: sums of their words' lengths.
            ends = np.concatenate([[0], np.cumsum(table[2][numbers])])[np.cumsum(lengths.astype(np.int64))] * 4
            raw, begin = ids.tobytes(), 0
            for doc_id, end in zip(doc_ids.as_py(), ends.tolist()):
                out.append((doc_id, raw[begin:end]))
                begin = end
            held += len(raw)
            if held > OUT_BYTES:
                yield batch_of(out)
                out, held = [], 0
        if out:
            yield batch_of(out)


ENCODED = "doc_id long, n_tokens long, ids binary"


def _met(docs: DataFrame, path: str, block_bytes: int) -> DataFrame:
    """Ids of blocks' words, the words' order and the blocks' documents, sorted to be assembled."""
    docs = shared.documents(docs)
    buckets = BUCKETS_PER_PARTITION * max(4, docs.rdd.getNumPartitions())
    asked = docs.mapInArrow(_requester(path, block_bytes, buckets), "bucket long, block long, words binary")
    answered = asked.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_encoder(path), MEETING)
    sent = docs.mapInArrow(_sender(path, block_bytes, buckets), MEETING)
    return answered.unionAll(sent).repartition("block").sortWithinPartitions("block", "kind", "bucket")


def encode(docs: DataFrame, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_tokens, ids) of docs(doc_id, text); ids are little-endian unsigned 32-bit integers.

    docs must be a table or file scan, whose partitions are the same when they are read again. The number of buckets follows
    the number of partitions, so a bucket's distinct words stay as many as the input grows.
    """
    return _met(docs, path, block_bytes).mapInArrow(_assembler, ENCODED)


def id_to_piece(path: str) -> list[bytes]:
    """The bytes of every id; ids without a piece are empty."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
    vocabulary = tokenizer(path).get_vocab(with_added_tokens=True)
    added = set(special_tokens(path))
    pieces = [b""] * (max(vocabulary.values(), default=-1) + 1)
    for piece, i in vocabulary.items():
        pieces[i] = piece.encode() if piece in added else bytes(byte_of[c] for c in piece)
    return pieces


def _decoder(path: str):
    def decode_ids(batches):
        pieces = id_to_piece(path)
        for batch in batches:
            texts = [b"".join(map(pieces.__getitem__, np.frombuffer(ids.as_py(), "<u4").tolist())).decode("utf-8", "replace") for ids in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return decode_ids


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encode()'s rows with the decoded text, special tokens included."""
    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(_decoder(path), ENCODED + ", decoded string")


def encode_and_decode(docs: DataFrame, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """decode(encode(docs)) with both steps in one Python worker, one after the other on batches of about OUT_BYTES."""
    unpieced = _decoder(path)
    return _met(docs, path, block_bytes).mapInArrow(lambda batches: unpieced(_assembler(batches)), ENCODED + ", decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256) of docs."""
    both = encode_and_decode(docs, path)
    return both.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document with the byte-level vocabulary of 50,257 ids."""
    import public_tokenizers

    return digests(shared.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")).drop("ids")
