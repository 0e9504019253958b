"""Writes as set operations between stored rows and a batch: what is stored after, and what failed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.words import patch_json


def _pick(batch: DataFrame, key: str, order: str, last: bool) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc(order) if last else F.asc(order)))
    return batch.withColumn("_n", rank)


def insert(stored: DataFrame, batch: DataFrame, key: str, order: str) -> tuple[DataFrame, DataFrame]:
    """New ids are added, the first of each in the batch; the rest fail as duplicates."""
    marked = _pick(batch, key, order, last=False).join(stored.select(key, F.lit(1).alias("_known")), key, "left")
    fresh = F.col("_known").isNull() & (F.col("_n") == 1)
    columns = stored.columns
    return stored.unionByName(marked.where(fresh).select(columns)), marked.where(~fresh).select(key, order)


def upsert(stored: DataFrame, batch: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each id in the batch replaces the stored one or is added."""
    new = _pick(batch, key, order, last=True).where("_n = 1").select(stored.columns)
    return stored.join(new.select(key), key, "left_anti").select(stored.columns).unionByName(new)


def replace(stored: DataFrame, batch: DataFrame, key: str, order: str) -> tuple[DataFrame, DataFrame]:
    """As upsert for ids that are stored; others fail."""
    known = batch.join(stored.select(key), key, "left_semi")
    return upsert(stored, known, key, order), batch.join(stored.select(key), key, "left_anti").select(key).distinct()


def delete(stored: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows left, and ids that failed: unknown ones, and repeats."""
    counted = ids.groupBy(key).agg(F.count("*").alias("n"))
    failed = counted.join(stored.select(key, F.lit(1).alias("_known")), key, "left").where(F.col("_known").isNull() | (F.col("n") > 1)).select(key)
    return stored.join(counted, key, "left_anti"), failed


def patch(stored: DataFrame, patches: DataFrame, key: str, column: str) -> DataFrame:
    """JSON documents after merge patches (key, patch); ids without one stay as they are."""

    def run(batches):
        for pdf in batches:
            pdf[column] = [patch_json(s, p) if p is not None else s for s, p in zip(pdf[column], pdf["patch"], strict=True)]
            yield pdf[[key, column]]

    df = stored.select(key, column).join(patches.select(key, "patch"), key, "left")
    return df.mapInPandas(run, f"{key} {dict(stored.dtypes)[key]}, {column} string")


def retrieve(stored: DataFrame, ids: DataFrame, key: str, order: str) -> DataFrame:
    """Rows in the order asked for, found false where there is none."""
    return ids.join(stored.withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False))).orderBy(order)
