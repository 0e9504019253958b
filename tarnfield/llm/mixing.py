"""Mixing sources to target weights along a time-varying curriculum, in DataFrame functions only.

Each source has a weight and a schedule, a linear ramp 1 + tilt·(2t - 1) over training time t in [0, 1]. Its integral is the
source's cumulative demand for tokens; inverting it at the words a source has given so far yields a document's position in
training. Documents of a source follow each other by MD5 of their id, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import DOCUMENTS, n_words, stash

MAX_REPEATS = 3
WEIGHTS = (1, 2, 3)
#: Ramp of the schedule by weight: light sources early, heavy ones late.
TILTS = {1: -0.5, 2: 0.0, 3: 0.5}
#: Leading hex digits of the MD5 that part a source into ranges for its running sum: 4096 tasks for a hot source.
DIGITS = 3


def targets(sizes: DataFrame) -> DataFrame:
    """(source, size) to one row per source: weight, tilt, source_size, target.

    Targets share the whole size by weight and stop at three times their source's size; what is over is shared again
    among the others. Sources sorted by cap over weight are capped up to the first whose share fits, so one pass over
    running sums finds the fixed point. All sizes 0: targets 0. One row per source, so the window is over a small table.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    by_cap = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = W.partitionBy()
    kind = F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS))) + 1
    df = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), kind).cast("bigint"))
    df = df.withColumn("cap", F.col("source_size") * MAX_REPEATS).withColumn("total", F.sum("source_size").over(everything))
    before = by_cap.rowsBetween(W.unboundedPreceding, -1)
    rest = by_cap.rowsBetween(0, W.unboundedFollowing)
    df = df.withColumn("_c", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("_w", F.sum("weight").over(rest))
    df = df.withColumn("capped", F.col("cap") * F.col("_w") < (F.col("total") - F.col("_c")) * F.col("weight"))
    df = df.withColumn("_cc", F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0))).withColumn("_ww", F.coalesce(F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything), F.lit(1)))
    share = (F.col("weight") * (F.col("total") - F.col("_cc"))).cast("double") / F.col("_ww").cast("double")
    tilt = F.element_at(F.array(*(F.lit(TILTS[w]) for w in WEIGHTS)), F.col("weight").cast("int"))
    return df.select("source", "weight", tilt.alias("tilt"), "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def position(share: Column, tilt: Column) -> Column:
    """The time at which a ramp has given this share of its integral."""
    b = 1 - tilt
    return F.when(tilt == 0, share).otherwise((F.sqrt(b * b + 4 * tilt * share) - b) / (2 * tilt))


def plan(docs: DataFrame, whole: bool = False) -> DataFrame:
    """docs (doc_id, source, size and any more columns) with source_size, target, full passes, rest (words of one more
    pass) and cum, the words of the source before this row.

    The pass that reaches the target is cut there: a document gives its leading words, so a source takes its target to the
    word. With whole, the last pass ends at the document in whose middle the target lies or before.
    """
    sources = stash(targets(docs.select("source", "size")), "targets")
    df = docs.withColumn("_key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).withColumn("_md5", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).withColumn("_part", F.substring("_md5", 1, DIGITS))
    parts = df.groupBy("_key", "_part").agg(F.sum("size").alias("_size"))
    parts = parts.select("_key", "_part", (F.sum("_size").over(W.partitionBy("_key").orderBy("_part")) - F.col("_size")).alias("_start"))
    inner = W.partitionBy("_key", "_part").orderBy("_md5", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    df = df.withColumn("_cum", F.sum("size").over(inner) - F.col("size")).join(parts, ["_key", "_part"]).withColumn("cum", F.col("_cum") + F.col("_start"))
    known = sources.select(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("_key"), "tilt", "source_size", "target")
    df = df.join(known, "_key")
    words = F.floor(F.col("target") + 0.5).cast("bigint")
    size = F.col("source_size")
    df = df.withColumn("full", F.when(size > 0, F.floor(words / size)).otherwise(0).cast("bigint"))
    over = words - F.col("full") * size - F.col("cum")
    rest = F.when(2 * over >= F.col("size"), F.col("size")).otherwise(F.lit(0)) if whole else F.least(F.col("size"), F.greatest(F.lit(0), over))
    return df.withColumn("rest", rest.cast("bigint")).drop("_key", "_part", "_md5", "_cum", "_start")


def sized(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), *more)


def digest(docs: DataFrame) -> DataFrame:
    """One row per row of docs, range-sorted by position: doc_id, size, source_size, target, taken, then copies (passes begun)
    and position (of its first copy, in [0, 1]; null if none).

    Null and blank texts have size 0 and take nothing; a source of such texts has target 0. Null sources are a source of
    their own, the last. Repeated rows count one by one; an empty table gives none; other columns are not read.
    """
    df = plan(stash(sized(docs), "sizes"))
    taken = F.col("full") * F.col("size") + F.col("rest")
    copies = F.when(F.col("size") > 0, F.col("full") + F.when(F.col("rest") > 0, 1).otherwise(0)).otherwise(0)
    share = F.col("cum").cast("double") / F.col("target")
    df = df.withColumn("taken", taken).withColumn("copies", copies.cast("bigint"))
    df = df.withColumn("position", F.when(F.col("copies") > 0, position(share, F.col("tilt"))))
    return df.select("doc_id", "size", "source_size", "target", "taken", "copies", "position").orderBy("position", "doc_id")


def curriculum(docs: DataFrame) -> DataFrame:
    """The columns of documents with a row for each copy, whole documents, range-sorted by copy's position.

    Documents without words (null, empty, blank texts) go, as do those that their source's target leaves out. Null sources are
    a source of their own, the last; repeated rows count one by one; equal positions are in order of doc_id, nulls first.
    An empty table gives none; columns beside those of documents are dropped.
    """
    df = plan(sized(docs, "text", "lang", "n_chars"), whole=True)
    passes = F.col("full") + F.when((F.col("rest") > 0), 1).otherwise(0)
    df = df.where((F.col("size") > 0) & (passes > 0)).withColumn("_copy", F.explode(F.sequence(F.lit(0), (passes - 1).cast("int"))))
    share = (F.col("cum") + F.col("_copy") * F.col("source_size")).cast("double") / F.col("target")
    df = df.withColumn("_at", position(F.least(share, F.lit(1.0)), F.col("tilt")))
    return df.orderBy("_at", "doc_id", "_copy").select(*DOCUMENTS)


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source),
c AS (SELECT *, source_size * 3 AS cap, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM s),
k AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c, sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w FROM c),
m AS (SELECT *, cap * w < (total - c) * weight AS capped FROM k),
t AS (SELECT source, source_size, CASE weight WHEN 1 THEN -0.5::DOUBLE WHEN 2 THEN 0::DOUBLE ELSE 0.5::DOUBLE END AS tilt, CASE WHEN capped THEN cap::DOUBLE ELSE
    (weight * (total - coalesce(sum(cap) FILTER (capped) OVER (), 0)))::DOUBLE / (coalesce(sum(weight) FILTER (NOT capped) OVER (), 1))::DOUBLE END AS target FROM m),
e AS (SELECT d.*, source_size, target, tilt, CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS cum FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
f AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS words, CASE WHEN source_size > 0 THEN CAST(floor(target + 0.5) AS BIGINT) // source_size ELSE 0 END AS passes FROM e),
g AS (SELECT *, least(size, greatest(0, words - passes * source_size - cum)) AS rest FROM f),
z AS (SELECT *, CASE WHEN size > 0 THEN passes + (rest > 0)::INT ELSE 0 END AS copies FROM g)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(passes * size + rest AS BIGINT) AS taken, CAST(copies AS BIGINT) AS copies,
    CASE WHEN copies > 0 THEN CASE WHEN tilt = 0 THEN cum::DOUBLE / target ELSE (sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * (cum::DOUBLE / target)) - (1 - tilt)) / (2 * tilt) END END AS position FROM z
"""
