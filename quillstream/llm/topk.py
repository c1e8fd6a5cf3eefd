"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors are turned into integers floor(scale * x). Candidates are packed into blocks that hold, for
every term (dimension), the postings of the rows whose weight there is not zero; a query row is a
sparse list of its non-zero terms. For every block, each term's weighted postings are scattered into
dense score arrays of the queries; the block's best k come out by partition selection, and a second
shuffle merges the blocks' lists. Every query meets every candidate; nothing is approximated.

Defined results: vectors that are null, or hold a null or non-finite component, take no part, nor do
rows with a null id; a missing trailing component counts as zero; an empty vector scores 0; a query
never meets rows of its own id; repeated rows all take part as candidates, and a repeated query id
is searched once, with the row whose components come first in order. Components beyond 64 bits are held at their
bounds, scores are exact whatever their size, and a score beyond 64 bits raises OverflowError.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstream.llm import shared

BLOCK_ROWS = 4096
QUERY_ROWS = 2048
#: Candidate blocks that meet one query block in one task.
BLOCKS_PER_TASK = 8


def integer_vectors(table: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id long, v array<long>) of the rows that take part."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return table.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & finite).select(
        F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x * F.lit(float(scale))).cast("long")).alias("v")
    )


def _packer(rows: int):
    """mapInPandas function over (no, id, v), sorted by no: packs vectors of one number into blocks of at most ``rows`` rows."""

    def pack(batches):
        held, ids, vecs = None, [], []

        def flush():
            wide = max((len(v) for v in vecs), default=0)
            dense = np.zeros((len(vecs), wide), np.int64)
            for i, v in enumerate(vecs):
                dense[i, : len(v)] = v
            small = np.int16 if not dense.size or (dense.max() < 2**15 and dense.min() >= -(2**15)) else np.int64
            return pd.DataFrame({"no": [held], "width": [wide], "item": [dense.astype(small).itemsize], "ids": [np.asarray(ids, np.int64).tobytes()], "weights": [dense.astype(small).tobytes()]})

        for pdf in batches:
            for no, i, v in zip(pdf["no"], pdf["id"], pdf["v"]):
                if ids and (no != held or len(ids) == rows):
                    yield flush()
                    ids, vecs = [], []
                held = no
                ids.append(i)
                vecs.append(v)
        if ids:
            yield flush()

    return pack


def _unpack(row) -> tuple[np.ndarray, np.ndarray]:
    weights = np.frombuffer(row["weights"], np.int16 if row["item"] == 2 else np.int64)
    ids = np.frombuffer(row["ids"], np.int64)
    return ids, weights.reshape(len(ids), row["width"])


def accumulate(queries: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Integer scores (queries x block rows), one term at a time from that term's postings."""
    terms = min(queries.shape[1], block.shape[1])
    size = lambda x: max(float(x.max(initial=0)), -float(x.min(initial=0)))
    bound = size(queries) * size(block) * max(1, terms)
    kind = np.int32 if bound < 2**31 else np.int64 if bound < 2**62 else object
    if kind is object:  # Python's integers: slow, and exact
        scores = queries[:, :terms].astype(object) @ block[:, :terms].astype(object).T if terms else np.zeros((len(queries), len(block)), object)
        if any(not -(2**63) <= x < 2**63 for x in scores.ravel()):
            raise OverflowError("a score is beyond 64 bits")
        return scores.astype(np.int64)
    scores = np.zeros((len(queries), len(block)), kind)
    for t in range(terms):
        asking, posted = np.flatnonzero(queries[:, t]), np.flatnonzero(block[:, t])
        if not len(asking) or not len(posted):
            continue
        weights = block[:, t].astype(kind) if 2 * len(posted) > len(block) else None
        if weights is not None:  # most rows are posted: the scatter is a whole line
            for q in asking:
                scores[q] += queries[q, t] * weights
        else:
            w = block[posted, t].astype(kind)
            for q in asking:
                scores[q, posted] += queries[q, t] * w
    return scores


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id, best first."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        above, level = np.flatnonzero(scores > edge), np.flatnonzero(scores == edge)
        level = level[np.argsort(ids[level], kind="stable")[: k - len(above)]]
        chosen = np.concatenate([above, level])
    else:
        chosen = np.arange(len(scores))
    return chosen[np.lexsort((ids[chosen], -scores[chosen].astype(np.int64)))]


def _searcher(k: int):
    """mapInPandas function over rows that pair a query block with a candidate block."""

    def search(batches):
        for pdf in batches:
            for row in pdf.to_dict("records"):
                q_ids, queries = _unpack({n[2:]: v for n, v in row.items() if n.startswith("q_")})
                c_ids, block = _unpack({n[2:]: v for n, v in row.items() if n.startswith("c_")})
                order = np.argsort(c_ids, kind="stable")
                found_q, found_i, found_s = [], [], []
                for at in range(0, len(q_ids), 64):
                    scores = accumulate(queries[at : at + 64].astype(np.int64), block)
                    for i, q in enumerate(q_ids[at : at + 64]):
                        line, ids = scores[i], c_ids
                        own = order[np.searchsorted(c_ids, q, "left", sorter=order) : np.searchsorted(c_ids, q, "right", sorter=order)]
                        if len(own):
                            keep = np.ones(len(ids), bool)
                            keep[own] = False
                            line, ids = line[keep], ids[keep]
                        top = best_of(line, ids, k)
                        found_q.append(np.full(len(top), q))
                        found_i.append(ids[top])
                        found_s.append(line[top].astype(np.int64))
                if found_q:
                    yield pd.DataFrame({"query_id": np.concatenate(found_q), "vec_id": np.concatenate(found_i), "score": np.concatenate(found_s)})

    return search


_BLOCK = "no long, width int, item int, ids binary, weights binary"


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 20, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS, blocks_per_task: int = BLOCKS_PER_TASK) -> DataFrame:
    """(query_id, rank, vec_id, score) for queries and candidates of (id long, v array<long>).

    Queries are dealt by a hash of their id into about one block per ``query_rows``, candidates are packed where they lie. Pairs of
    blocks are dealt over both: the key is (query block, share of the candidates), with as many shares as keep about
    ``blocks_per_task`` candidate blocks under a key. So memory is bounded by one block of each, no task gets all
    candidates, and the work grows as queries x candidates, which exhaustive search is. Blocks are packed: a query block
    is copied once a share, a candidate block once a query block.
    """
    one = queries.groupBy("id").agg(F.min("v").alias("v"))
    n_blocks = max(1, math.ceil(one.count() / query_rows))
    shares = max(1, math.ceil(candidates.count() / (block_rows * blocks_per_task)))
    numbered = one.select(F.pmod(F.xxhash64("id"), F.lit(n_blocks)).alias("no"), "id", "v").repartition("no").sortWithinPartitions("no")
    packed = shared.staged(numbered.mapInPandas(_packer(query_rows), _BLOCK), "topk-queries")
    cand = candidates.select(F.lit(0).cast("long").alias("no"), "id", "v").mapInPandas(_packer(block_rows), _BLOCK).withColumn("share", F.pmod(F.xxhash64("ids"), F.lit(shares)))
    sides = lambda side: [F.col(c).alias(f"{side}_{c}") for c in ("width", "item", "ids", "weights")]
    q = packed.select(F.col("no").alias("block_no"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))).alias("share"), *sides("q"))
    c = cand.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("block_no"), "share", *sides("c"))
    part = c.join(q, ["block_no", "share"]).drop("block_no", "share").mapInPandas(_searcher(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return part.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all rows for every row whose vec_id is divisible by 20."""
    vectors = integer_vectors(shared.table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 64)
    return top_k(vectors.where("id % 20 = 0"), vectors, 20)


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
