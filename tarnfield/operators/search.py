"""Query operators: leaves, combinators, ranking, sorting, vectors, fusion."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import wildcard_regex
from ..functions.words import MARGIN, expansion_score, fuzziness, osa, weighted
from . import index

PATTERN_TERMS = 128  #: terms a pattern stands for, the most frequent first; part of a pattern's meaning
RRF_K, RRF_DEPTH = 10, 100
DENSITY_ROWS = 256  #: documents whose places are Python objects at once
# Documents from which on a typed word is trusted, how far a correction leads to be sure; a word in up to
# TYPO_MAX documents is likely a typo of one in TYPO_RATIO times as many.
TRUSTED, DOMINANCE, CONTEXT_TERMS, CONTEXT_DOMINANCE = 20, 20, 8, 3
TYPO_MAX, TYPO_RATIO = 500, 20


def match(tokens: DataFrame, words: list[str], mode: str = "or", bounds: tuple[int, int] = index.WEIGHT) -> DataFrame:
    """doc_id, score, matched: any word (or, wand), every word in some field (and), every word in one field (best)."""
    words = list(dict.fromkeys(words))
    hits = index.scored(index.postings(tokens, words), index.stats(tokens), bounds)
    if mode == "best":
        hits = hits.groupBy("doc_id", "field").agg(F.sum("score").alias("score"), F.count("*").alias("n")).where(F.col("n") == len(words))
        return hits.groupBy("doc_id").agg(F.sum("score").alias("score"), F.max("n").alias("matched"))
    out = hits.groupBy("doc_id").agg(F.sum("score").alias("score"), F.countDistinct("term").alias("matched"))
    return out.where(F.col("matched") == len(words)) if mode == "and" else out


def coverage(tokens: DataFrame, words: list[str]) -> DataFrame:
    """doc_id, base, coverage, score: the base times the squared share of the words' idf that the document has."""
    hits = index.scored(index.postings(tokens, list(dict.fromkeys(words))), index.stats(tokens))
    total = hits.select("term", "idf").distinct().agg(F.sum("idf").alias("total"))
    out = hits.groupBy("doc_id").agg(F.sum("score").alias("base"), F.sum("idf").alias("held")).crossJoin(F.broadcast(total))  # one row
    return out.select("doc_id", "base", (F.col("held") / F.col("total")).alias("coverage")).withColumn("score", F.col("base") * F.col("coverage") * F.col("coverage"))


def phrase(tokens: DataFrame, words: list[str]) -> DataFrame:
    """doc_id, places: words one after another, matched by equal start less offset within the row."""
    n = len(words)
    here = F.transform("tokens", lambda x, i: F.array_join(F.slice("tokens", i + 1, n), "\x00") == "\x00".join(words))
    df = tokens.where(F.arrays_overlap("tokens", F.array(F.lit(words[0])))).withColumn("places", F.size(F.filter(here, lambda x: x)))
    return df.where("places > 0").groupBy("doc_id").agg(F.sum("places").alias("places"))


def pattern_terms(dictionary: DataFrame, condition: Column) -> DataFrame:
    return dictionary.where(condition).orderBy(F.desc("df"), "term").limit(PATTERN_TERMS)


def prefix(tokens: DataFrame, start: str) -> DataFrame:
    return _pattern(tokens, F.col("term").startswith(start))


def wildcard(tokens: DataFrame, pattern: str) -> DataFrame:
    return _pattern(tokens, F.col("term").rlike(wildcard_regex(pattern)))


def _pattern(tokens: DataFrame, condition: Column) -> DataFrame:
    """doc_id, score: the terms as one, whose frequency is that of their union."""
    chosen = [r.term for r in pattern_terms(index.terms(tokens), condition).select("term").collect()]
    hits = index.postings(tokens, chosen or [""]).groupBy("doc_id", "field", "len").agg(F.sum("tf").alias("tf")).withColumn("term", F.lit("*"))
    return index.scored(hits, index.stats(tokens)).groupBy("doc_id").agg(F.sum("score").alias("score"))


def fuzzy_terms(dictionary: DataFrame, word: str, edits: int | None = None, lock: int = 0) -> DataFrame:
    """term, df, edits, distance, rank_score of the dictionary's terms within so many edits of a word.

    The JVM's bounded Levenshtein keeps what may be within (a swap costs it two), Arrow batches settle the rest.
    """
    k = fuzziness(word) if edits is None else edits
    near = dictionary.where((F.abs(F.length("term") - len(word)) <= k) & F.col("term").startswith(word[:lock]) & (F.levenshtein(F.col("term"), F.lit(word), 2 * k) >= 0))

    def settle(batches):
        for pdf in batches:
            pdf["edits"] = [osa(word, t) for t in pdf["term"]]
            pdf = pdf[pdf["edits"] <= k].copy()
            pdf["distance"] = [weighted(word, t) for t in pdf["term"]]
            pdf["rank_score"] = [expansion_score(d, x) for d, x in zip(pdf["df"], pdf["distance"], strict=True)]
            yield pdf

    return near.select("term", "df").mapInPandas(settle, "term string, df long, edits int, distance double, rank_score double")


def selected(near: DataFrame, word: str, limit: int = 50) -> DataFrame:
    """Of fuzzy_terms, the word itself if it is there, and the best corrections within MARGIN of the best of them; best
    first, ties to the lower term. A dictionary's terms near one word are few, so the window is over little."""
    best = F.max(F.when(F.col("term") != word, F.col("rank_score"))).over(W.partitionBy())
    own = F.col("term") == word
    place = F.row_number().over(W.orderBy(F.desc(own), F.desc("rank_score"), "term"))
    kept = near.withColumn("_best", best).where(own | (F.col("rank_score") >= F.col("_best") - MARGIN))
    return kept.withColumn("_place", place).where(F.col("_place") <= limit).drop("_best", "_place").orderBy(F.desc("rank_score"), "term")


def confident(best: dict, near: list[dict]) -> bool:
    """Whether no other term as near as the best correction is nearly as frequent."""
    return all(best["df"] >= DOMINANCE * x["df"] for x in near if x["term"] != best["term"] and x["edits"] <= best["edits"])


def did_you_mean(dictionary: DataFrame, word: str, trusted: int = TRUSTED) -> DataFrame:
    """term, df, edits, distance, rank_score: the word itself if it is frequent enough to be trusted, else selected corrections."""
    near = fuzzy_terms(dictionary, word)
    known = F.max(F.when(F.col("term") == word, F.col("df"))).over(W.partitionBy())
    near = near.withColumn("_known", F.coalesce(known, F.lit(0)))
    return selected(near.where((F.col("_known") < trusted) | (F.col("term") == word)).drop("_known"), word)


def synonyms(tokens: DataFrame, forms: dict[str, float]) -> DataFrame:
    """doc_id, score: a document takes its best form; a form's rarity is at most that of the first, typed one."""
    typed = next(iter(forms))
    hits = index.postings(tokens, list(forms))
    df = hits.groupBy("field", "term").agg(F.count("*").alias("df"))
    own = df.where(F.col("term") == typed).select("field", F.col("df").alias("typed_df"))
    df = df.join(own, "field", "left").select("field", "term", F.greatest("df", F.coalesce("typed_df", F.lit(0))).alias("df"))
    s = hits.join(F.broadcast(df), ["field", "term"]).join(F.broadcast(index.stats(tokens)), "field")  # a row per form and field
    share = F.element_at(F.create_map(*(F.lit(x) for kv in forms.items() for x in kv)), F.col("term"))
    tf = F.col("tf")
    gain = tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * F.col("len") / (F.col("total_len") / F.col("doc_count"))))
    s = s.withColumn("score", share * index.weight(tf) * index.idf(F.col("doc_count"), F.col("df")) * gain)
    return s.groupBy("doc_id", "field").agg(F.max("score").alias("score")).groupBy("doc_id").agg(F.sum("score").alias("score"))


def same_element(array: str, condition) -> Column:
    """True if one element of an array of structs holds all conditions."""
    return F.exists(array, condition)


def density(tokens: DataFrame, words: list[str]) -> DataFrame:
    """doc_id, density: words held over the shortest window with one of each, less if not in typed order, times their share.

    Python gets the places of the words only, each with the word's number, and looks at a few documents at once.
    """
    words = list(dict.fromkeys(words))
    n = len(words)

    def best(batches):
        for b in batches:
            for lo in range(0, b.num_rows, DENSITY_ROWS):
                part = b.slice(lo, DENSITY_ROWS)
                out = []
                for at in part.column(1).to_pylist():
                    held = len({x % (n + 1) for x in at})
                    last: dict[int, int] = {}
                    top = 0.0
                    for i, k in (divmod(x, n + 1) for x in at):
                        last[k] = i
                        if len(last) == held > 1:
                            span = i - min(last.values()) + 1
                            order = [last[k] for k in sorted(last)]
                            ordered = all(a < b for a, b in zip(order, order[1:], strict=False))
                            top = max(top, min(1.0, held / span) * (1.0 if ordered else 0.8))
                    out.append(top * held / n if held > 1 else None)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.float64())], names=["doc_id", "density"])

    places = F.transform("tokens", lambda x, i: i * F.lit(n + 1) + F.array_position(F.array(*map(F.lit, words)), x))
    held = tokens.where(F.arrays_overlap("tokens", F.array(*map(F.lit, words)))).select("doc_id", F.filter(places, lambda x: x % (n + 1) != 0).alias("at"))
    return held.mapInArrow(best, "doc_id long, density double").where("density IS NOT NULL").groupBy("doc_id").agg(F.max("density").alias("density"))


def blend(hits: DataFrame, field: str, ratio: float = 40.0) -> DataFrame:
    """hits (doc_id, score, field) of one tier, with rank: the midpoint of 1, the tier's place, and of the share of the best
    score, and the field between its bounds (1 if these are equal, 0 if it is missing)."""
    bounds = hits.agg(F.min(field).alias("lo"), F.max(field).alias("hi"), F.max("score").alias("top"))
    df = hits.crossJoin(F.broadcast(bounds))  # one row
    norm = F.when(F.col("hi") > F.col("lo"), (F.col(field) - F.col("lo")) / (F.col("hi") - F.col("lo"))).when(F.col(field).isNotNull(), 1.0)
    return df.select("doc_id", ((1 + F.col("score") / F.col("top")) / 2 * (100 - ratio) + F.coalesce(norm, F.lit(0.0)) * ratio).alias("rank"))


def nearest(vectors: DataFrame, key: str, column: str, query: list[float], k: int) -> DataFrame:
    """key, cosine of the k nearest; the dot product stays in the JVM and top-k needs no full sort."""
    q = F.array(*(F.lit(float(x)) for x in query))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    col = F.col(column)
    return vectors.select(key, (dot(col, q) / F.sqrt(dot(col, col) * dot(q, q))).alias("cosine")).orderBy(F.desc("cosine"), key).limit(k)


def fuse(lists: list[DataFrame], key: str = "doc_id") -> DataFrame:
    """Reciprocal ranks of lists (key, score) of at most RRF_DEPTH rows each, added; the best is 1."""
    parts = []
    for hits in lists:
        top = hits.select(key, "score").orderBy(F.desc("score"), key).limit(RRF_DEPTH)
        rank = F.row_number().over(W.orderBy(F.desc("score"), key))
        parts.append(top.select(key, (1.0 / (RRF_K + rank)).alias("part")))
    all_parts = parts[0]
    for p in parts[1:]:
        all_parts = all_parts.unionByName(p)
    fused = all_parts.groupBy(key).agg(F.sum("part").alias("part"))
    return fused.crossJoin(F.broadcast(fused.agg(F.max("part").alias("best")))).select(key, (F.col("part") / F.col("best")).alias("score"))
