"""Text quality by a sparse rule ensemble.

Statistics of a text are Spark expressions. Shallow trees, each grown on a resample of the labelled rows, propose
rules: the conjunctions along their paths. A lasso-penalised logistic model over the rules keeps few of them, and
those are compiled into one Spark column expression, so that scoring runs inside the scan's stage.

Training sees at most MAX_TRAIN labelled rows, those with the smallest hash of their id (a documented bound, the same for
any corpus size); each tree sees RESAMPLE of them, drawn with repetition. Scoring covers every row. Labels, language, source and ids are never inputs of a score.

Defined results: null and empty texts have all-zero statistics and a score like any other; without labelled rows of both
kinds every score is the share of label 1 among them, or 0.5 if there are none; a doc_id with several labels counts once, as 1 if at
least half of them are; repeated rows repeat.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.llm import shared

MAX_TRAIN, RESAMPLE = 20_000, 2000
TREES, DEPTH, CUTS, PENALTY = 60, 3, 16, 0.002


def statistics(text: Column) -> dict[str, Column]:
    """Counts that the features are ratios of."""
    t = F.coalesce(text, F.lit(""))
    count = lambda pattern: F.regexp_count(t, F.lit(pattern)).cast("double")
    return {
        "chars": F.length(t).cast("double"),
        "words": count(r"\S+"),
        "lines": count(r"\n"),
        "capitals": count(r"\p{Lu}"),
        "digits": count(r"\d"),
        "stops": count(r"[.,;:?]"),
        "shouts": count("!"),
        "bars": count(r"\|"),
        "symbols": count(r"[#$%&*@^~_=+<>{}\[\]\\/]"),
        "doubles": count(r"(?<!\S)(\S++)\s++\1(?!\S)"),
        "long_words": count(r"\S{14,}"),
    }


FEATURES = ["words", "word_length", "line_share", "capital_share", "digit_share", "stop_share", "shout_share", "bar_share", "symbol_share", "double_share", "long_share"]


def features(df: DataFrame, text: str = "text") -> DataFrame:
    """df with its FEATURES as columns prefixed by f_.

    The counts come out of a generator, past which no filter or projection is pushed: each is computed once a row.
    """
    counted = df.select("*", F.inline(F.array(F.struct(*[v.alias(f"s_{k}") for k, v in statistics(F.col(text)).items()]))))
    per = lambda a, b: F.when(F.col(f"s_{b}") > 0, F.col(f"s_{a}") / F.col(f"s_{b}")).otherwise(F.lit(0.0))
    made = {
        "words": F.col("s_words"),
        "word_length": per("chars", "words"),
        "line_share": per("lines", "words"),
        "capital_share": per("capitals", "chars"),
        "digit_share": per("digits", "chars"),
        "stop_share": per("stops", "words"),
        "shout_share": per("shouts", "words"),
        "bar_share": per("bars", "words"),
        "symbol_share": per("symbols", "words"),
        "double_share": per("doubles", "words"),
        "long_share": per("long_words", "words"),
    }
    return counted.withColumns({f"f_{k}": made[k] for k in FEATURES}).drop(*[c for c in counted.columns if c.startswith("s_")])


Rule = tuple[tuple[int, bool, float], ...]  # (feature, greater, threshold) of each condition


def _grow(x: np.ndarray, y: np.ndarray, cuts: list[np.ndarray], rows: np.ndarray, depth: int, rng, path: Rule, out: set[Rule]) -> None:
    """Split rows where the label's variance falls most, over a random half of the features."""
    if path:
        out.add(path)
    if depth == 0 or len(rows) < 20 or y[rows].min() == y[rows].max():
        return
    best = (1e-9, None)
    mine = y[rows]
    spread = mine.var() * len(rows)
    for f in rng.permutation(x.shape[1])[: max(1, x.shape[1] // 2)]:
        for c in cuts[f]:
            up = x[rows, f] > c
            n = int(up.sum())
            if 5 <= n <= len(rows) - 5:
                gain = spread - mine[up].var() * n - mine[~up].var() * (len(rows) - n)
                if gain > best[0]:
                    best = (gain, (int(f), float(c), up))
    if best[1] is not None:
        f, c, up = best[1]
        _grow(x, y, cuts, rows[up], depth - 1, rng, path + ((f, True, c),), out)
        _grow(x, y, cuts, rows[~up], depth - 1, rng, path + ((f, False, c),), out)


def propose_rules(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 7) -> list[Rule]:
    """Distinct tree paths, in a fixed order."""
    rng = np.random.default_rng(seed)
    spaced = lambda v: np.unique(np.quantile(v, np.linspace(0.02, 0.98, CUTS))) if len(v) else v
    # Most texts have none of what some features count, so the rest get cut points of their own.
    cuts = [np.unique(np.concatenate([spaced(v), spaced(v[v > 0])])) for v in x.T]
    found: set[Rule] = set()
    for _ in range(trees):
        rows = rng.integers(0, len(y), min(len(y), RESAMPLE))
        _grow(x, y, cuts, rows, depth, rng, (), found)
    return sorted({_tightest(r) for r in found})


def _tightest(rule: Rule) -> Rule:
    """The rule with one lower and one upper bound a feature at most, in order."""
    bounds: dict[tuple[int, bool], float] = {}
    for f, greater, c in rule:
        held = bounds.get((f, greater), c)
        bounds[f, greater] = max(held, c) if greater else min(held, c)
    return tuple((f, greater, c) for (f, greater), c in sorted(bounds.items()))


def holds(rules: list[Rule], x: np.ndarray) -> np.ndarray:
    """(rows x rules) where a rule holds."""
    out = np.ones((len(x), len(rules)), bool)
    for k, rule in enumerate(rules):
        for f, greater, c in rule:
            out[:, k] &= (x[:, f] > c) == greater
    return out


def _squared_norm(z: np.ndarray, rounds: int = 50) -> float:
    """An upper estimate of the squared spectral norm of z with a column of ones, by power iteration: no copy of z is made."""
    v, found = np.ones(z.shape[1] + 1), 1.0
    for _ in range(rounds):
        u = z @ v[1:].astype(z.dtype) + z.dtype.type(v[0])
        v = np.append(u.sum(), z.T @ u).astype(np.float64)
        found = float(np.linalg.norm(v))
        v /= max(found, 1e-12)
    return 1.05 * found


def fit_lasso(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """(intercept, weights) of logistic regression with an L1 penalty, by accelerated proximal gradient steps."""
    n, k = z.shape
    rate = 4 * n / max(_squared_norm(z), 1e-9)
    b, w, b2, w2, t = 0.0, np.zeros(k), 0.0, np.zeros(k), 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(b2 + z @ w2.astype(z.dtype), -30, 30)))
        nb, g = b2 - rate * (p - y).mean(), w2 - rate * (z.T @ (p - y).astype(z.dtype)) / n
        nw = np.sign(g) * np.maximum(np.abs(g) - rate * penalty, 0)
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        b2, w2 = nb + (t - 1) / nt * (nb - b), nw + (t - 1) / nt * (nw - w)
        b, w, t = nb, nw, nt
    return b, w


def fit(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY) -> tuple[float, list[tuple[Rule, float]]]:
    """(intercept, the rules that keep a weight). Rules that hold for the same rows count once; the matrix takes four bytes a row and rule."""
    if not len(y) or y.min() == y.max():
        share = min(max(float(y.mean()) if len(y) else 0.5, 1e-6), 1 - 1e-6)
        return float(np.log(share / (1 - share))), []
    rules = propose_rules(x, y)
    z, kept, seen = holds(rules, x), [], set()
    for k in range(len(rules)):
        key = np.packbits(z[:, k]).tobytes()
        if 0 < z[:, k].mean() < 1 and key not in seen:
            seen.add(key)
            kept.append(k)
    b, w = fit_lasso(z[:, kept].astype(np.float32), y, penalty)
    return float(b), [(rules[k], float(v)) for k, v in zip(kept, w) if abs(v) > 1e-6]


def compiled(intercept: float, rules: list[tuple[Rule, float]]) -> Column:
    """The score between 0 and 1 as a Column over f_ columns."""
    total = F.lit(intercept)
    for rule, weight in rules:
        tests = [(F.col(f"f_{FEATURES[f]}") > c) if greater else (F.col(f"f_{FEATURES[f]}") <= c) for f, greater, c in rule]
        total = total + reduce(and_, tests).cast("double") * F.lit(weight)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAIN) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most ``limit`` labelled rows outside the held-out fold."""
    named = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (fold(F.col("doc_id")) != 1))
    one = named.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("double").alias("y"))
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)  # 16 bytes each: at most 320 KB
    rows = features(docs.join(F.broadcast(chosen), "doc_id"))
    # Of rows that repeat a doc_id the one whose statistics come first in order; at most ``limit`` rows come to the driver.
    got = rows.groupBy("doc_id").agg(F.first("y").alias("y"), F.min(F.struct(*[f"f_{f}" for f in FEATURES])).alias("x")).orderBy("doc_id").collect()
    return np.array([tuple(r["x"]) for r in got]).reshape(len(got), len(FEATURES)), np.array([r["y"] for r in got])


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; rows of remainder 1 are held out."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 3


def score(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAIN) -> DataFrame:
    """docs(doc_id, text) with held_out, score and predicted; the text is not returned."""
    docs = shared.documents(docs)
    intercept, rules = fit(*training_rows(docs, labels, limit))
    scored = features(docs).withColumn("score", compiled(intercept, rules))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return score(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "labels"))


def keep_good(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAIN) -> DataFrame:
    """The rows of docs, with all their columns, whose score is at least 0.5."""
    intercept, rules = fit(*training_rows(shared.documents(docs), labels, limit))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").cast("string").alias("text"))
    return features(packed).where(compiled(intercept, rules) >= 0.5).select("row.*")
