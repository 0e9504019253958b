"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, votes weighted by nearness.

The space is spanned by all terms of the examples (words, and prefixes of four and five letters), clean and toxic ones alike.
A term's weight is (1 + log of its count) times its idf among all documents times FLOOR + phi, phi being how far its
presence goes with the label among the examples, either way (the correlation of the two). A logistic curve over the votes,
fitted on the examples themselves, each judged by the others, makes scores probabilities.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK, map_texts, ship

#: At most so many labelled rows of either class are examples (by hash of their id); bounds the index.
EXAMPLES = 1500
NEIGHBOURS = 30
BLOCK = 128
#: Terms in at least one of so many examples are common: their lists have no gaps, and a peak for each block.
COMMON = 16
FLOOR = 0.1
#: A vote weighs cosine / (NEARNESS - cosine).
NEARNESS = 1.1
#: Examples of at least this cosine are taken as copies when an example is judged by the others.
COPY = 0.999
#: Keeps the curve's log-odds finite.
EDGE = 0.01
#: Words whose terms a task keeps for lookup.
HELD = 200_000
#: Texts whose cosines are computed together.
TOGETHER = 64
WORDS = re.compile(r"[^\W\d_]+")
#: Characters up to U+00FF: blanks for those that are in no word.
LETTERS = bytes(i if WORDS.match(chr(i)) else 32 for i in range(256))


def terms(word: str) -> tuple[str, ...]:
    """A word and its prefixes of five and four letters."""
    return (word, "5" + word[:5], "4" + word[:4]) if len(word) > 4 else (word,)


def words(text: str | None) -> list[str]:
    """What WORDS finds in the text in lower case; without its search where no character is beyond U+00FF."""
    text = (text or "").lower()
    try:
        return text.encode("latin-1").translate(LETTERS).decode("latin-1").split()
    except UnicodeEncodeError:
        return WORDS.findall(text)


def bag(text: str | None) -> Counter:
    out: Counter = Counter()
    for word, n in Counter(words(text)).items():
        for t in terms(word):
            out[t] += n
    return out


class Terms(dict):
    """Rows of words in a table of their terms' numbers in a vocabulary; looks up what it has not seen. Row 0: no such term.
    Words that are no terms themselves share the row of their first five letters."""

    def __init__(self, vocabulary: dict[str, int]) -> None:
        super().__init__()
        self.vocabulary = vocabulary
        self._blank(HELD)
        self.starts: dict[str, int] = {}
        self.last = np.zeros(len(vocabulary), np.int32)

    def __missing__(self, word: str) -> int:
        # a vocabulary of whole bags has no term without the shorter ones
        if (k := self.vocabulary.get(word)) is not None:
            row = self._row((k,) if len(word) <= 4 else (self.vocabulary["4" + word[:4]], self.vocabulary["5" + word[:5]], k))
        elif len(word) <= 4:
            row = 0
        elif (row := self.starts.get(start := word[:5])) is None:
            found = [k for t in ("4" + start[:4], "5" + start) if (k := self.vocabulary.get(t)) is not None]
            self.starts[start] = row = self._row(found) if found else 0
        self[word] = row
        return row

    def _blank(self, words: int) -> None:
        """An empty table for so many words."""
        self.table, self.rows = np.full((words + 1, 3), -1, np.int32), 0
        self.cells = memoryview(self.table.reshape(-1))  # numpy is slow to set a few

    def _row(self, found: Sequence[int]) -> int:
        self.rows += 1
        for i, k in enumerate(found, 3 * self.rows):
            self.cells[i] = k
        return self.rows

    def _terms(self, found: Iterable[str], n: int) -> np.ndarray:
        """Of n different words, each a row of its terms' numbers; -1 where there is none."""
        if len(self) + n > HELD:
            self.clear()
            self.starts.clear()
            self._blank(max(n, HELD))  # a text of more different words than HELD has a table of its own
        rows = np.fromiter(map(self.__getitem__, found), np.int64, n)
        return self.table[rows]

    def different(self, text: str | None) -> np.ndarray:
        """Numbers of a text's terms, each once."""
        found = set(words(text))
        at = self._terms(found, len(found)).ravel()
        at = at[at >= 0]
        self.last[at] = here = np.arange(len(at), dtype=np.int32)
        return at[self.last[at] == here]

    def bag(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of a text's terms, ascending, and their counts."""
        found = Counter(words(text))
        at = self._terms(found, len(found))
        known = at >= 0
        counts = np.repeat(np.fromiter(found.values(), np.float64, len(found)), known.sum(axis=1))
        at, which = np.unique(at[known], return_inverse=True)
        return at.astype(np.int64), np.bincount(which, counts, len(at)).astype(np.float64)


class Index(NamedTuple):
    vocabulary: dict[str, int]
    weights: np.ndarray  #: of a term, before its count
    pointers: np.ndarray  #: where a term's postings begin; one more for the end
    places: np.ndarray  #: of postings: example
    values: np.ndarray  #: of postings: its weight in the example's vector
    row: np.ndarray  #: of a common term: its row below; else -1, and only such terms have postings
    lists: np.ndarray  #: (common term, block, place in it): weights, without gaps
    peaks: np.ndarray  #: (common term, block): the largest weight in the block
    labels: np.ndarray
    votes: np.ndarray  #: of an example, so that classes weigh as among all labels
    ids: list
    prior: float  #: share of toxic rows among those labelled
    curve: tuple[float, float]


def vector(at: np.ndarray, counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weights of terms in a text's vector, of length 1."""
    w = (1 + np.log(counts)) * weights[at]
    norm = np.sqrt((w * w).sum())
    return w / norm if norm else w


def vocabulary_of(bags: Iterable[Iterable[str]]) -> dict[str, int]:
    return {t: i for i, t in enumerate(sorted({t for b in bags for t in b}))}


def build(rows: list[tuple], vocabulary: dict[str, int], frequency: np.ndarray, texts: int, toxic: int, clean: int) -> Index:
    """rows: (doc_id, text, label) of the examples; frequency: of all texts, those with each term; toxic and clean: numbers
    of labelled rows that the examples stand for."""
    known = Terms(vocabulary)
    bags = [known.bag(t) for _, t, _ in rows]
    y = np.array([r[2] for r in rows], dtype=np.int64)
    n1, n = int(y.sum()), len(y)
    n0 = n - n1
    a1, a0 = np.zeros(len(vocabulary)), np.zeros(len(vocabulary))
    for (at, _), label in zip(bags, y, strict=True):
        (a1 if label else a0)[at] += 1
    spread = np.sqrt(n1 * n0 * (a1 + a0) * np.maximum(1, n - a1 - a0))
    phi = np.abs(a1 * (n0 - a0) - a0 * (n1 - a1)) / np.maximum(spread, 1e-9)
    weights = np.log(1 + texts / np.maximum(1, frequency)) * (FLOOR + phi)
    vectors = [vector(at, counts, weights) for at, counts in bags]
    # like with like makes tighter peaks: by label, then by the term that weighs most
    order = sorted(range(n), key=lambda i: (int(y[i]), int(bags[i][0][np.argmax(vectors[i])]) if len(vectors[i]) else -1, i))
    blocks = max(1, -(-n // BLOCK))
    term = np.concatenate([bags[i][0] for i in order] or [np.zeros(0, np.int64)])
    place = np.repeat(np.arange(n), [len(vectors[i]) for i in order]).astype(np.int32)
    value = np.concatenate([vectors[i] for i in order] or [np.zeros(0)])
    common = np.flatnonzero((a1 + a0) * COMMON >= max(1, n))
    row = np.full(len(vocabulary), -1, np.int32)
    row[common] = np.arange(len(common))
    many = row[term] >= 0
    lists = np.zeros((len(common), blocks * BLOCK), np.float32)
    lists[row[term[many]], place[many]] = value[many]
    lists = lists.reshape(len(common), blocks, BLOCK)
    term, place, value = term[~many], place[~many], value[~many]
    by_term = np.argsort(term, kind="stable")
    pointers = np.searchsorted(term[by_term], np.arange(len(vocabulary) + 1))
    votes = np.where(y == 1, toxic / max(1, n1), clean / max(1, n0))[order]
    prior = toxic / max(1, toxic + clean)
    index = Index(vocabulary, weights, pointers, place[by_term], value[by_term], row, lists, lists.max(axis=2), y[order], votes / votes.max(initial=1e-9), [rows[i][0] for i in order], prior, (0.0, 1.0))
    judged = [vote(index, found) for found in all_nearest(index, [(bags[i][0], vectors[i]) for i in order], without=range(n))]
    return index._replace(curve=curve(np.array(judged), index.labels, index.votes, prior))


def cosines(index: Index, texts: list[tuple[np.ndarray, np.ndarray]], k: int) -> np.ndarray:
    """Of texts, given by their terms and weights, and the examples; those that can't be among a text's k largest may be 0.

    Postings of rarer terms come first. What they give and the most that common terms can add within a block bound the
    block's cosines; common terms are added only in blocks whose bound reaches the k-th largest cosine so far. k 0: in all.
    """
    blocks, n = index.lists.shape[1], len(index.labels)
    text = np.repeat(np.arange(len(texts)), [len(at) for at, _ in texts])
    at, w = np.concatenate([at for at, _ in texts]), np.concatenate([w for _, w in texts])
    rows = index.row[at]
    few, many = np.flatnonzero(rows < 0), np.flatnonzero(rows >= 0)
    lo, size = index.pointers[at[few]], index.pointers[at[few] + 1] - index.pointers[at[few]]
    ends = np.cumsum(size)
    which = np.arange(ends[-1] if len(ends) else 0) + np.repeat(lo - (ends - size), size)
    where = np.repeat(text[few] * (blocks * BLOCK), size) + index.places[which]
    out = np.bincount(where, index.values[which] * np.repeat(w[few], size), len(texts) * blocks * BLOCK).astype(np.float64, copy=False).reshape(len(texts), blocks, BLOCK)
    if len(many):
        x = np.zeros((len(texts), len(index.lists)), np.float32)
        x[text[many], rows[many]] = w[many]
        least = np.partition(out.reshape(len(texts), -1)[:, :n], n - k, axis=1)[:, n - k] if 0 < k <= n else np.zeros(len(texts))
        alive = out.max(axis=2) + x @ index.peaks >= least[:, None] - 1e-5
        for b in range(blocks):
            who = np.flatnonzero(alive[:, b])
            out[who, b] += x[who] @ index.lists[:, b]
        out[~alive] = 0.0  # nothing reaches the k-th
    return out.reshape(len(texts), -1)[:, :n]


def all_nearest(index: Index, texts: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS, without: Sequence[int] | None = None) -> Iterator[list[tuple[int, float]]]:
    """Of each text, given by its terms and weights, the k examples of the largest cosine above 0, ties to the lower place.
    Without an example each: and without what is as near as a copy."""
    for lo in range(0, len(texts), TOGETHER):
        for i, found in enumerate(cosines(index, texts[lo : lo + TOGETHER], k if without is None else 0), lo):
            if without is not None:
                found[found >= COPY] = 0.0
                found[without[i]] = 0.0
            best = np.argpartition(-found, min(2 * k, len(found) - 1))[: 2 * k] if len(found) > 4 * k else np.arange(len(found))
            if len(best) and len(best) < len(found) and (edge := found[best].min()) > 0 and np.count_nonzero(found >= edge) > len(best):
                best = np.flatnonzero(found >= edge)
            best = best[np.lexsort((best, -found[best]))][:k]
            yield [(j, c) for j, c in zip(best.tolist(), found[best].tolist(), strict=True) if c > 0]


def nearest(index: Index, at: np.ndarray, w: np.ndarray, k: int = NEIGHBOURS) -> list[tuple[int, float]]:
    """Of one text."""
    return next(all_nearest(index, [(at, w)], k))


def vote(index: Index, found: list[tuple[int, float]]) -> float:
    """Share of toxic votes; each weighs its cosine over its distance. Without neighbours the share among labelled rows."""
    if not found:
        return index.prior
    at, cos = (np.array(x) for x in zip(*found, strict=True))
    w = index.votes[at] * cos / (NEARNESS - np.minimum(cos, 1.0))
    total = w.sum()
    return float((w * index.labels[at]).sum() / total) if total else index.prior


def curve(judged: np.ndarray, y: np.ndarray, weights: np.ndarray, prior: float) -> tuple[float, float]:
    """Intercept and slope of a logistic curve over the log-odds of votes, by Newton's method with a small ridge."""
    b = np.array([0.0, 1.0])
    if not 0 < y.sum() < len(y):
        return 0.0, 1.0
    x = np.stack([np.ones(len(judged)), log_odds(judged)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (weights * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (weights * (p - y)) + 1e-3 * (b - [0, 1]))
        b = b - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return float(b[0]), float(max(b[1], 0.0))


def log_odds(share: np.ndarray | float) -> np.ndarray:
    return np.log((share + EDGE) / (1 + EDGE - share))


def calibrated(index: Index, found: list[tuple[int, float]]) -> float:
    """The probability of label 1; without neighbours the share among labelled rows."""
    if not found:
        return float(index.prior)
    a, b = index.curve
    return float(1 / (1 + np.exp(-np.clip(a + b * log_odds(vote(index, found)), -30, 30))))


def frequencies(docs: DataFrame, vocabulary: dict[str, int]) -> tuple[np.ndarray, int]:
    """Of all texts, how many have each term, and how many there are."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(vocabulary)  # terms of at most 2 * EXAMPLES texts
    schema = pa.schema([("term", pa.int32()), ("n", pa.int64())])

    def count(batches):
        known, sums, texts = Terms(shared.value), np.zeros(len(shared.value) + 1, np.int64), 0
        for batch in batches:
            for lo in range(0, batch.num_rows, CHUNK):
                for t in batch.column(0).slice(lo, CHUNK).to_pylist():
                    sums[known.different(t)] += 1
                    texts += 1
        sums[-1] = texts
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(sums[at])], schema=schema)

    found = docs.select("text").mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(vocabulary) + 1, np.int64)
    out[found.column("term").to_numpy()] = found.column("n").to_numpy()
    return out[:-1], int(out[-1])


def examples(docs: DataFrame, labels: DataFrame) -> tuple[list[tuple], int, int]:
    """(doc_id, text, label) of the examples, by doc_id, and the numbers of toxic and clean labelled rows to learn from.

    Rows whose crc32(doc_id) mod 5 is 0, null labels and null ids are none. Repeated labels count once, toxic if one is.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = [r for y in (0, 1) for r in known.where(F.col("toxic") == y).orderBy(*order).limit(EXAMPLES).collect()]
    chosen = docs.sparkSession.createDataFrame([(r.doc_id, int(r.toxic)) for r in ids], "doc_id long, toxic int")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).orderBy("doc_id").collect()  # at most 2 * EXAMPLES
    return [(r.doc_id, r.text, r.toxic) for r in rows], counts.get(1, 0), counts.get(0, 0)


def learn(docs: DataFrame, labels: DataFrame) -> Index:
    rows, toxic, clean = examples(docs, labels)
    vocabulary = vocabulary_of(bag(t) for _, t, _ in rows)
    return build(rows, vocabulary, *frequencies(docs, vocabulary), toxic, clean)


def score(docs: DataFrame, index: Index) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence (id:label:cosine of the three nearest examples).

    Texts without a term of the space, null and empty ones too, score the share of toxic rows among those labelled (0
    without any). Of equally near examples the one earlier in the index counts. Repeated rows score alike, rows without doc_id
    are not held out; an empty table gives none. Columns beside doc_id and text are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(index)  # terms and postings of at most 2 * EXAMPLES texts
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))
    cache: dict[int, Terms] = {}

    def run(ids, held, texts):
        model = shared.value
        known = cache.setdefault(0, Terms(model.vocabulary))
        cols = [ids, held, [], [], []]
        bags = [known.bag(t) for t in texts]
        for found in all_nearest(model, [(at, vector(at, counts, model.weights)) for at, counts in bags]):
            s = calibrated(model, found)
            cols[2].append(s)
            cols[3].append(int(s >= 0.5))
            cols[4].append(",".join(f"{model.ids[i]}:{model.labels[i]}:{c:.3f}" for i, c in found[:3]))
        return cols

    return map_texts(docs.select("doc_id", held.alias("held_out"), "text"), ("doc_id", "held_out", "text"), run, "doc_id long, held_out boolean, score double, predicted int, evidence string")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, learn(docs, labels))
