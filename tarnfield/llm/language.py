"""Language identification as mixture inference: EM over byte trigrams, languages chosen by penalised likelihood."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK, map_texts, ship

#: Trigrams are counted in so many hashed cells a language; bounds the model whatever the corpus.
CELLS = 1 << 14
STEPS = 15
NO_LETTERS = re.compile(r"[\W\d_]+")


def only_letters(text: str) -> str:
    """The text in lower case, a blank for whatever stands between letters. Numbers that are no digits, such as ½ and Ⅷ, are
    in \\w with the letters and go first."""
    low = text.lower()
    if not low.isascii() and (numbers := [c for c in set(low) if c.isalnum() and not c.isalpha()]):
        low = low.translate(dict.fromkeys(map(ord, numbers), " "))
    return NO_LETTERS.sub(" ", low).strip()


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Cells and counts of the byte trigrams of a text's letters; empty without letters."""
    clean = only_letters(text or "")
    if not clean:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    b = np.frombuffer(f" {clean} ".encode(), np.uint8).astype(np.uint32)
    cells = ((b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA6B)) ^ (b[2:] * np.uint32(0xC2B2AE35))) >> np.uint32(7)
    counts = np.bincount(cells & np.uint32(CELLS - 1), minlength=CELLS)
    found = np.flatnonzero(counts)
    return found, counts[found]


def held_out() -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages by name, and log-probabilities (cell, language) counted over all training texts."""
    ship(docs.sparkSession)
    schema = pa.schema([("lang", pa.string()), ("cell", pa.int32()), ("n", pa.int64())])

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                for text, lang in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    cells, n = grams(text)
                    sums.setdefault(lang, np.zeros(CELLS, np.int64))[cells] += n
        for lang, n in sums.items():
            cells = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(cells)), pa.array(cells, pa.int32()), pa.array(n[cells])], schema=schema)

    known = docs.where((F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2) & F.col("lang").isNotNull())
    rows = known.select("text", "lang").mapInArrow(count, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow().to_pydict()
    langs = sorted(set(rows["lang"]))
    counts = np.zeros((CELLS, len(langs)))
    index = {x: i for i, x in enumerate(langs)}
    counts[rows["cell"], [index[x] for x in rows["lang"]]] = rows["n"]
    return langs, np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * CELLS)).astype(np.float32)


def mixture(probs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, float]:
    """EM: proportions of the columns of probs, and the log-likelihood."""
    share, n = np.full(probs.shape[1], 1 / probs.shape[1]), counts.sum()
    for _ in range(STEPS):
        new = share * (probs.T @ (counts / (probs @ share))) / n
        done = np.abs(new - share).max() < 1e-3
        share = new
        if done:
            break
    return share, float(counts @ np.log(probs @ share))


def infer(model: np.ndarray, cells: np.ndarray, counts: np.ndarray) -> tuple[list[int], np.ndarray, float]:
    """Languages chosen, the largest share first, their shares, and the posterior of the first among single ones.

    Languages join in the order of their shares in the full mixture, as long as the likelihood gains more than
    4 log n + n / 50 for one more (trigrams overlap, so their likelihood counts each letter three times).
    """
    logs = model[cells].astype(np.float64)
    logs -= logs.max(axis=1, keepdims=True)
    probs = np.exp(logs)
    n = counts.sum()
    share, _ = mixture(probs, counts)
    single = counts @ logs
    order = np.argsort(-share, kind="stable")
    chosen, best = [int(np.argmax(single))], float(single.max())
    shares = np.ones(1)
    for k in order:
        if k in chosen:
            continue
        s, fit = mixture(probs[:, [*chosen, k]], counts)
        if fit - best <= 4 * np.log(n + 1) + n / 50:
            break
        chosen, shares, best = [*chosen, int(k)], s, fit
    post = np.exp((single - single.max()) / 3)
    by = np.argsort(-shares, kind="stable")
    return [chosen[i] for i in by], shares[by], float(1 / post.sum()) if len(chosen) == 1 else 1.0


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """doc_id, held_out, lang_pred, score, languages (name:percent, comma-joined).

    Texts that are null or have no letter, and all texts when nothing was learned: und, score 0, no languages. score is the
    share of lang_pred in the mixture times its posterior. Rows without doc_id are neither learned from nor held out. Of
    languages of equal share the first by name comes first. Repeated rows get the same; an empty table gives none, and
    as training table teaches none. Columns beside doc_id and text (training: and lang) are not read.
    """
    langs, logs = model
    shared = docs.sparkSession.sparkContext.broadcast((langs, logs))  # at most CELLS numbers a language

    def run(ids, held, texts):
        names, table = shared.value
        cols = [ids, held, [], [], []]
        for t in texts:
            cells, counts = grams(t)
            if not len(cells) or not names:
                best = ("und", 0.0, "")
            else:
                who, shares, sure = infer(table, cells, counts)
                best = (names[who[0]], min(1.0, float(shares[0]) * sure), ",".join(f"{names[i]}:{round(100 * s)}" for i, s in zip(who, shares, strict=True)))
            for c, x in zip(cols[2:], best, strict=True):
                c.append(x)
        return cols

    return map_texts(docs.select("doc_id", held_out().alias("held_out"), "text"), ("doc_id", "held_out", "text"), run, "doc_id long, held_out boolean, lang_pred string, score double, languages string")


def digest(docs: DataFrame) -> DataFrame:
    return identify(docs, train(docs))
