"""License scan with a positional index of rare template words.

A template is a licence's name, notice or whole text with mandatory key phrases; the phrases' words form a small positional
index: word -> (phrase, position). Corpus document frequencies rank these words by IDF. In a file only the places of each
phrase's rarest words are looked up; subtracting positions in the phrase from positions in the file turns each posting into a
start, and the starts of the rarest words are intersected. What is left is verified word for word. The places of a template's key
phrases are intersected in turn, by their positions in the template.

A base phrase counts wherever all its words stand. A template counts at a start where one key phrase stands exactly in its
place, all others within BAND words of theirs, and at least MIN_SHARE of the template's words within BAND words of theirs, so that
inserted, missing and replaced words do not hide it. IDF decides what is looked up first, never what is found.

Words are runs of ASCII letters, digits and non-ASCII characters, ASCII letters lower-cased. Defined results: null and empty texts
have no words, null first_word and last_word, empty labels and score 0; repeated rows repeat; extra columns are ignored.
The score is the largest share of a labelled template's words found in place; 1 for base phrases.
"""

from __future__ import annotations

import math
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.llm import shared
from quillstream.llm.license_texts import BASE_PHRASES, NOTICES

MIN_SHARE = 0.8
BAND = 8
LOOKED_UP = 3

_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The words of a whole text, as UTF-8 bytes."""
    return (text or "").encode().translate(_WORD_BYTES).split()


def key_places(template: list[bytes], keys: list[str]) -> list[tuple[int, tuple[bytes, ...]]]:
    """(position, words) of each key phrase's first place in its template."""
    found = []
    for key in keys:
        k = tuple(words_of(key))
        at = next((i for i in range(len(template) - len(k) + 1) if tuple(template[i : i + len(k)]) == k), None)
        if not k or at is None:
            raise ValueError(f"a template lacks its key phrase: {key}")
        found.append((at, k))
    return found


class TemplateIndex:
    """Postings of the key phrases' words and the words' corpus IDF."""

    def __init__(self, base: dict[str, str], notices: dict[str, tuple[str, list[str]]], frequency: dict[bytes, int], documents: int):
        idf = lambda w: math.log((1 + documents) / (1 + frequency.get(w, 0)))
        self.base = [(label, tuple(words_of(phrase))) for label, phrase in sorted(base.items())]
        self.templates = []
        for label, (text, keys) in sorted(notices.items()):
            template, at = words_of(text), {}
            for k, w in enumerate(template):
                at.setdefault(w, []).append(k)
            self.templates.append((label, template, at, key_places(template, keys)))
        phrases = {p for _, p in self.base} | {p for _, _, _, keys in self.templates for _, p in keys}
        self.rarest = {p: [(w, [i for i, x in enumerate(p) if x == w]) for w in sorted(set(p), key=lambda w: (-idf(w), w))[:LOOKED_UP]] for p in sorted(phrases)}
        self.words = frozenset(w for p in phrases for w in p)
        self.looked_up = frozenset(w for looked in self.rarest.values() for w, _ in looked)

    def phrase_places(self, words: list[bytes]) -> dict[tuple[bytes, ...], list[int]]:
        """The starts of each phrase that stands in a file: the rarest words' postings intersected, then verified word for word."""
        here = self.looked_up.intersection(words)
        possible = [(p, looked) for p, looked in self.rarest.items() if all(w in here for w, _ in looked)]
        if not possible:
            return {}
        postings: dict[bytes, list[int]] = {w: [] for _, looked in possible for w, _ in looked}
        for i, w in enumerate(words):
            if w in postings:
                postings[w].append(i)
        found = {}
        for p, looked in possible:
            starts = set.intersection(*({i - k for i in postings[w] for k in at} for w, at in looked))
            real = sorted(s for s in starts if s >= 0 and tuple(words[s : s + len(p)]) == p)
            if real:
                found[p] = real
        return found

    def scan(self, words: list[bytes]) -> tuple[list[int], set[str], set[str], float]:
        """(starts of base places, base labels, all labels, score) of a file's words."""
        places = self.phrase_places(words)
        base_starts = [s for _, p in self.base for s in places.get(p, [])]
        base = {label for label, p in self.base if p in places}
        labels, score = set(base), 1.0 if base else 0.0
        for label, template, at, keys in self.templates if places else []:
            if not all(p in places for _, p in keys):
                continue
            starts = [[s - k for s in places[p]] for k, p in keys]
            for s in sorted(set().union(*starts)):
                if all(_near(of_key, s) for of_key in starts):
                    share = _in_place(words, s, len(template), at) / len(template)
                    if share >= MIN_SHARE:
                        labels.add(label)
                        score = max(score, share)
        return base_starts, base, labels, score


def _near(ordered: list[int], s: int) -> bool:
    """Whether a value lies at most BAND from s."""
    i = bisect_left(ordered, s - BAND)
    return i < len(ordered) and ordered[i] <= s + BAND


def _in_place(words: list[bytes], s: int, n: int, at: dict[bytes, list[int]]) -> int:
    """How many of a template's n words stand at most BAND from their places after start s."""
    found = set()
    for i in range(max(0, s - BAND), min(len(words), s + n + BAND)):
        found.update(k for k in at.get(words[i], ()) if abs(i - s - k) <= BAND)
    return len(found)


def _counter(vocabulary: frozenset[bytes]):
    def count(batches):
        seen, total = dict.fromkeys(vocabulary, 0), 0
        for batch in batches:
            for text in batch.column(0):
                total += 1
                for w in vocabulary.intersection(words_of(text.as_py())):
                    seen[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array([b"", *seen], pa.binary()), pa.array([total, *seen.values()], pa.int64())], names=["word", "n"])

    return count


def _scanner(index: TemplateIndex):
    def scan(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1):
                words = words_of(text.as_py())
                starts, base, labels, score = index.scan(words)
                rows.append((len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score))
            cols = list(zip(*rows)) or [[]] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return scan


def scan_licenses(docs: DataFrame, base: dict[str, str] = BASE_PHRASES, notices: dict[str, tuple[str, list[str]]] = NOTICES) -> DataFrame:
    """One row per row of docs(doc_id, text). Collects one frequency per template word, whatever the corpus."""
    docs = shared.documents(docs)
    bare = TemplateIndex(base, notices, {}, 0)
    counted = docs.select("text").mapInArrow(_counter(bare.words), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    frequency = {bytes(r["word"]): r["n"] for r in counted}
    index = TemplateIndex(base, notices, frequency, frequency.get(b"", 0))
    return docs.mapInArrow(_scanner(index), "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def _sql(base: dict[str, str], notices: dict[str, tuple[str, list[str]]]) -> str:
    """The same rows in SQL: all places of all phrases, and all words of the templates, without an index."""
    listed = lambda words: "[" + ", ".join(f"'{w.decode()}'" for w in words) + "]"
    templates = {label: (words_of(text), key_places(words_of(text), keys)) for label, (text, keys) in notices.items()}
    phrases = ", ".join(f"('{label}', {listed(words_of(p))})" for label, p in base.items())
    keys = ", ".join(f"('{label}', {i}, {len(found)}, {at}, {listed(p)})" for label, (_, found) in templates.items() for i, (at, p) in enumerate(found))
    texts = ", ".join(f"('{label}', {listed(words)})" for label, (words, _) in templates.items())
    return rf"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
base(label, phrase) AS (VALUES {phrases}),
keys(label, key, n_keys, place_in, phrase) AS (VALUES {keys}),
texts(label, t) AS (VALUES {texts}),
template AS (SELECT label, len(t) AS n, unnest(range(len(t))) AS k, unnest(t) AS word FROM texts),
vocabulary AS (SELECT word FROM template UNION SELECT unnest(phrase) FROM base),
place AS (SELECT doc_id, p, word FROM (SELECT doc_id, unnest(range(len(w))) AS p, unnest(w) AS word FROM w) JOIN vocabulary USING (word)),
base_places AS (SELECT doc_id, label, p FROM place JOIN base ON word = phrase[1] JOIN w USING (doc_id) WHERE w[p + 1 : p + len(phrase)] = phrase),
key_starts AS (
  SELECT DISTINCT doc_id, label, key, n_keys, p - place_in AS s FROM place JOIN keys ON word = phrase[1] JOIN w USING (doc_id) WHERE w[p + 1 : p + len(phrase)] = phrase),
starts AS (
  SELECT a.doc_id, a.label, a.s FROM (SELECT DISTINCT doc_id, label, n_keys, s FROM key_starts) a JOIN key_starts b ON a.doc_id = b.doc_id AND a.label = b.label AND abs(a.s - b.s) <= {BAND}
  GROUP BY a.doc_id, a.label, a.s, a.n_keys HAVING count(DISTINCT b.key) = a.n_keys),
shares AS (
  SELECT s.doc_id, s.label, count(DISTINCT t.k) / t.n AS share FROM starts s JOIN place p ON p.doc_id = s.doc_id JOIN template t ON t.label = s.label AND t.word = p.word AND abs(p.p - s.s - t.k) <= {BAND}
  GROUP BY s.doc_id, s.label, s.s, t.n HAVING count(DISTINCT t.k) / t.n >= {MIN_SHARE}),
b AS (SELECT doc_id, count(*) AS n, min(p) AS low, max(p) AS high, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM base_places GROUP BY doc_id),
every AS (SELECT doc_id, label, 1.0::DOUBLE AS share FROM base_places UNION ALL SELECT doc_id, label, share FROM shares),
e AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM every GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(b.n, 0) AS n_base, CAST(b.low AS BIGINT) AS first_word, CAST(b.high AS BIGINT) AS last_word,
  coalesce(b.labels, '') AS base_labels, coalesce(e.labels, '') AS labels, coalesce(e.score, 0.0)::DOUBLE AS score
FROM w LEFT JOIN b ON b.doc_id = w.doc_id LEFT JOIN e ON e.doc_id = w.doc_id
"""


OP4_SQL = _sql(BASE_PHRASES, NOTICES)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License places and labels of every document."""
    return scan_licenses(shared.table(spark, sf_dir, "documents"))
