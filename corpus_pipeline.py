"""From raw documents to packed training sequences: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnfield.llm import mixing, packing, quality, secrets, simhash
from tarnfield.llm.common import documents, stash

#: Each function takes (spark, docs, sf_dir); all but the last return the columns of documents.
STAGES = [
    ("quality", lambda spark, docs, sf_dir: quality.stage(docs)),
    ("near_duplicates", lambda spark, docs, sf_dir: simhash.stage(docs)),
    ("secrets", lambda spark, docs, sf_dir: secrets.stage(docs)),
    ("mixing", lambda spark, docs, sf_dir: mixing.curriculum(docs)),
    ("packing", lambda spark, docs, sf_dir: packing.packed(docs, in_order=True)),
]

#: Fingerprints, checksums and best-fit have no SQL form here; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What packing.packed returns of the documents that the other stages keep: a row for each piece of each copy, with its
    bin and its position in training order.

    The stages say what they do with nulls, ties, repeated rows and long texts; an empty table gives no row.
    """
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
