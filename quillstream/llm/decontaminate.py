"""Benchmark decontamination by template canonicalisation.

Windows of WINDOW tokens (whole items where these are shorter) of documents and benchmark items are hash-joined, in three
shapes. In the first, a token is its lower-case word without surrounding punctuation: a document that shares one such window
with an item is contaminated, an ``exact`` leak, whatever stands beside that window. In the other two, numbers, names and
units are typed placeholders: one for each token, or one for each run of names or of numbers and their units, so that a
replacement may have another number of tokens. A document is a ``reparameterised`` leak of an item if RENAMED_SHARE of the item's
windows match at one alignment and the slot values are consistent, each item value always standing for the same document
value. An alignment is one offset, or all offsets at most NEAR from one, of one reading of the document and one of the item.

A window with fewer than MIN_LITERALS literals says little, so it counts only if its slot values are equal too. A name is
a capitalised token; one that begins a sentence may also be another word, so texts are read both ways, with all of these as
names and with all as words. A unit is a unit word after a number.

Before the join a bitmap of fixed size over the item windows' hashes drops document windows that match none; it lets
some others through, which the join removes, and never drops a match. Defined results: null and empty texts and ids have no windows; items with
fewer than MIN_LITERALS tokens match where all their words stand, and have no templates; repeated rows give one pair; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.llm import shared, textvec

WINDOW, MIN_LITERALS, RENAMED_SHARE = 8, 4, 0.5
NEAR = 2
BITS = 24
CACHED_WORDS = 250_000

#: Unit words, recognised after a number.
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t ton tons lb lbs oz ml l liter liters litre litres ms s sec second seconds min minute minutes h hour hours day days week weeks month months year years "
    "hz khz mhz ghz b kb mb gb tb v volt volts w kw watt watts j kj cal kcal k c f degree degrees percent % usd eur gbp dollar dollars euro euros cent cents pound pounds km/h mph m/s".split()
)
_NUMBER = re.compile(r"[$€£]?[+-]?\d+(?:[.,:/-]\d+)*(%?)\Z")
_STRIP = "\"'()[]{}<>.,;:!?…«»“”‘’„¿¡*_`"
NUMBER, NAME, UNIT = 1, 2, 3
_ENDS, _IS_NUMBER, _IS_UNIT = 1, 2, 4
#: Shapes of windows: the words themselves, one place per token, or one per run of names or of numbers and their units.
WORDS, TOKENS, RUNS = 0, 1, 2
#: The ways a text is read: a shape, and whether a capitalised token that begins a sentence is a name.
READINGS = ((WORDS, False), (TOKENS, False), (TOKENS, True), (RUNS, False), (RUNS, True))


class Lexicon(dict):
    """raw token -> row of the code table; grows as tokens are met."""

    def __init__(self):
        self.literal, self.middle, self.first, self.flags, self.core = [], [], [], [], []
        self.table = (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.uint8))

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(literal, middle, first, flags) as arrays, extended by what is new since the last call."""
        have = len(self.table[0])
        if have < len(self.core):
            new = zip(self.table, (self.literal, self.middle, self.first, self.flags))
            self.table = tuple(np.concatenate([old, np.array(more[have:], old.dtype)]) for old, more in new)
        return self.table

    def __missing__(self, raw: str) -> int:
        core = raw.strip(_STRIP) or raw
        flags = _ENDS if raw.rstrip("\"')]}»”’")[-1:] in (".", "!", "?", ":", ";") else 0
        literal = (int.from_bytes(hashlib.blake2b(core.lower().encode(), digest_size=8).digest(), "little") | 4) & (2**63 - 1)
        if _NUMBER.match(core):
            middle = first = NUMBER
            flags |= _IS_NUMBER
        else:
            first = literal
            middle = NAME if core[0].isupper() and len(core) > 1 else literal
            flags |= _IS_UNIT if core.lower() in UNITS else 0
        self.literal.append(literal)
        self.middle.append(middle)
        self.first.append(first)
        self.flags.append(flags)
        self.core.append(core.lower() if middle != NAME else core)
        self[raw] = at = len(self.core) - 1
        return at


class Reading(NamedTuple):
    shape: int
    named: bool
    codes: np.ndarray  # of the places
    at: np.ndarray  # the token with which each place begins; one more for the end
    of: np.ndarray  # the place with which each text begins; one more for the end


def readings(texts: list[str], lexicon: Lexicon) -> tuple[np.ndarray, list[Reading]]:
    """(lexicon rows of the tokens of texts, their READINGS)."""
    rows, of = [], [0]
    for text in texts:
        # A line end also ends a sentence.
        found = [lexicon[t] for line in text.split("\n") for t in (*line.split(), "\n")]
        rows.append(np.array(found, np.int64))
        of.append(of[-1] + len(found))
    row = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    of = np.array(of)
    is_break = row == lexicon["\n"]
    literal, middle, first, flags = (table[row] for table in lexicon.arrays())
    begins = np.ones(len(row), bool)
    begins[1:] = ((flags[:-1] & _ENDS) > 0) | is_break[:-1]
    begins[of[:-1][of[:-1] < len(row)]] = True
    after_number = np.zeros(len(row), bool)
    after_number[1:] = (flags[:-1] & _IS_NUMBER) > 0
    is_unit = after_number & ((flags & _IS_UNIT) > 0)
    keep = ~is_break
    coded = {named: np.where(is_unit, np.uint64(UNIT), codes)[keep] for named, codes in ((False, np.where(begins, first, middle)), (True, middle))}
    of = np.concatenate([[0], np.cumsum(keep)])[of]
    row, begins = row[keep], begins[keep]
    out = []
    for shape, named in READINGS:
        codes, at, where = literal[keep] if shape == WORDS else coded[named], np.arange(len(row) + 1), of
        if shape == RUNS:
            kind = np.where(codes == UNIT, np.uint64(NUMBER), codes)
            starts = np.ones(len(row), bool)
            starts[1:] = (kind[1:] != kind[:-1]) | (kind[1:] > UNIT) | begins[1:]
            at = np.append(np.flatnonzero(starts), len(row))
            codes, where = kind[at[:-1]], np.searchsorted(at, of)
        out.append(Reading(shape, named, codes, at, where))
    return row, out


def window_hashes(reading: Reading, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts of windows inside one text, their hashes)."""
    codes, of = reading.codes, reading.of
    n = len(codes)
    if n < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    starts = np.flatnonzero(np.arange(n) + width <= np.repeat(of[1:], np.diff(of)))
    mixed = textvec.mix(codes + np.uint64(width + 16 * reading.shape))
    total = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        total = total * np.uint64(0x9E3779B97F4A7C15) + mixed[k : n - width + 1 + k]
    return starts, textvec.mix(total[starts])


def _rows(ids, starts, hashes, width, reading, row, lexicon):
    """One Arrow batch of window rows."""
    core = lexicon.core
    owner = np.searchsorted(reading.of, starts, "right") - 1
    literals, slots, canon = [], [], []
    for s in starts.tolist():
        c, t = reading.codes[s : s + width].tolist(), reading.at[s : s + width + 1].tolist()
        r = row[t[0] : t[-1]].tolist()
        runs = [r[a - t[0] : b - t[0]] for a, b in zip(t, t[1:])]
        literals.append(sum(x > UNIT for x in c))
        slots.append("\x1f".join(" ".join(f"{x}{core[y]}" for y in run) for x, run in zip(c, runs) if x <= UNIT))
        canon.append(" ".join(f"<{x}>" if x <= UNIT else core[run[0]].lower() for x, run in zip(c, runs)))
    n = len(canon)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([ids[o] for o in owner], pa.int64()), pa.array([reading.shape] * n, pa.int32()), pa.array([reading.named] * n, pa.bool_()), pa.array(starts - reading.of[owner], pa.int64()),
            pa.array(hashes.view(np.int64)), pa.array(literals, pa.int32()), pa.array(slots, pa.string()), pa.array(canon, pa.string()),
        ],
        names=["id", "shape", "named", "at", "hash", "literals", "slots", "canon"],
    )


WINDOWS = "id long, shape int, named boolean, at long, hash long, literals int, slots string, canon string"


def _item_windows(window: int):
    def run(batches):
        for batch in batches:
            lexicon = Lexicon()
            ids = batch.column(0).to_pylist()
            row, read = readings([t or "" for t in batch.column(1).to_pylist()], lexicon)
            for reading in read:
                for width in range(1 if reading.shape == WORDS else MIN_LITERALS, window + 1):
                    starts, hashes = window_hashes(reading, width)
                    owner = np.searchsorted(reading.of, starts, "right") - 1
                    mine = np.minimum(np.diff(reading.of)[owner], window) == width
                    yield _rows(ids, starts[mine], hashes[mine], width, reading, row, lexicon)

    return run


def _places(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each hash: its upper and its lower BITS bits."""
    return hashes >> np.uint64(64 - BITS), hashes & np.uint64((1 << BITS) - 1)


def _bitmap(batches):
    """One partial bitmap over the hashes of a partition."""
    bits = np.zeros(1 << BITS, bool)
    for batch in batches:
        for at in _places(batch.column(0).to_numpy().view(np.uint64)):
            bits[at] = True
    yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["bits"])


_lexicons: list[Lexicon] = []


def _kept_lexicon() -> Lexicon:
    """The process's lexicon, started anew when it has grown past its bound."""
    if not _lexicons or len(_lexicons[0]) > CACHED_WORDS:
        _lexicons[:] = [Lexicon()]
    return _lexicons[0]


def _doc_windows(packed: bytes, widths: dict[int, list[int]]):
    """widths: the widths of the items' windows by shape."""

    def run(batches):
        bits = np.unpackbits(np.frombuffer(packed, np.uint8)).view(bool)
        for batch in batches:
            for a, b in textvec.row_groups(batch.column(1)):
                lexicon = _kept_lexicon()
                part = batch.slice(a, b - a)
                ids = part.column(0).to_pylist()
                row, read = readings([t or "" for t in part.column(1).to_pylist()], lexicon)
                for reading in read:
                    for width in widths.get(reading.shape, []):
                        starts, hashes = window_hashes(reading, width)
                        for k in (0, 1):
                            hit = bits[_places(hashes)[k]]
                            starts, hashes = starts[hit], hashes[hit]
                        if len(starts):
                            yield _rows(ids, starts, hashes, width, reading, row, lexicon)

    return run


def _by_token(run):
    """A pair of runs as pairs of their tokens, if they have equally many."""
    item, doc = F.split(run["item"], " "), F.split(run["doc"], " ")
    return F.when(F.size(item) == F.size(doc), F.arrays_zip(item.alias("item"), doc.alias("doc"))).otherwise(F.array(F.struct(run["item"].alias("item"), run["doc"].alias("doc"))))


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Pairs (doc_id, item_id, kind, n_windows, item_windows, share) of documents that contain an item or a part of it.

    n_windows counts the exact windows of an exact pair and all matched ones of a reparameterised pair. Exact alignments go
    before others; of several the one with most windows counts. share is n_windows / item_windows.
    """
    items = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    made = shared.staged(items.mapInArrow(_item_windows(window), WINDOWS), "leak-items")
    of_item = made.groupBy("id", "shape", "named").agg(F.countDistinct("at").alias("item_windows"))
    widths: dict[int, list[int]] = {}  # 1 to WINDOW
    for shape, width in made.select("shape", F.size(F.split("canon", " "))).distinct().collect():
        widths.setdefault(shape, []).append(width)
    parts = made.select("hash").distinct().coalesce(4).mapInArrow(_bitmap, "bits binary").collect()  # 4 bitmaps of 2 MB at most
    packed = np.zeros((1 << BITS) // 8, np.uint8)
    for r in parts:
        packed |= np.frombuffer(r["bits"], np.uint8)
    docs = shared.documents(docs).where("doc_id IS NOT NULL")
    found = docs.mapInArrow(_doc_windows(packed.tobytes(), widths), WINDOWS)
    f, i = found.alias("f"), made.alias("i")
    same = (F.col("f.hash") == F.col("i.hash")) & (F.col("f.shape") == F.col("i.shape")) & (F.col("f.canon") == F.col("i.canon"))
    told = (F.col("f.literals") >= MIN_LITERALS) | (F.col("f.slots") == F.col("i.slots"))
    slots = lambda c: F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.split(c, "\x1f"))
    zipped = F.arrays_zip(slots("i.slots").alias("item"), slots("f.slots").alias("doc"))
    hits = f.join(i, same & told).select(
        F.col("f.id").alias("doc_id"),
        F.col("i.id").alias("item_id"),
        F.col("i.shape").alias("shape"),
        F.col("i.named").alias("named"),
        F.col("f.named").alias("doc_named"),
        (F.col("f.at") - F.col("i.at")).alias("offset"),
        F.col("i.at").alias("at"),
        F.flatten(F.transform(zipped, _by_token)).alias("pairs"),
        (F.col("f.slots") == F.col("i.slots")).alias("exact"),
    )
    # Every window counts at its own offset, and at each offset near it for passages with words put in or left out.
    bands = [F.struct(F.lit(0).alias("near"), F.col("offset").alias("middle")), *(F.struct(F.lit(NEAR).alias("near"), (F.col("offset") + k).alias("middle")) for k in range(-NEAR, NEAR + 1))]
    spread = hits.withColumn("band", F.explode(F.array(*bands)))
    aligned = spread.groupBy("doc_id", "item_id", "shape", "named", "doc_named", "band").agg(
        F.size(F.collect_set("at")).cast("long").alias("n_matched"), F.size(F.collect_set(F.when(F.col("exact"), F.col("at")))).cast("long").alias("n_exact"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs")
    )
    item_values = F.array_distinct(F.transform("pairs", lambda p: p["item"]))
    exact = F.col("n_exact") > 0
    sized = aligned.withColumn("n_windows", F.when(exact, F.col("n_exact")).otherwise(F.col("n_matched"))).join(of_item.withColumnRenamed("id", "item_id"), ["item_id", "shape", "named"])
    consistent = F.size("pairs") == F.size(item_values)
    enough = exact | (consistent & (F.col("n_matched") >= RENAMED_SHARE * F.col("item_windows")))
    kind = F.when(exact, "exact").otherwise("reparameterised")
    best = sized.where(enough).groupBy("doc_id", "item_id").agg(F.max(F.struct(exact.alias("exact"), "n_windows", kind.alias("kind"), "item_windows")).alias("s"))
    return best.select(
        "doc_id", "item_id", F.col("s.kind").alias("kind"), F.col("s.n_windows").alias("n_windows"), F.col("s.item_windows").alias("item_windows"), (F.col("s.n_windows") / F.col("s.item_windows")).alias("share")
    )


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item or a window of one, with the item."""
    return contaminated(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "benchmark"))
