"""The queries opN_<name> over whole tables, and SQL twins of those that SQL can express."""

from __future__ import annotations

from . import language, licenses, lm, media, mixing, packing, quality, secrets, simhash, toxicity
from .common import documents

QUERIES = {
    "op1_secret_scan": lambda spark, d: secrets.scan(documents(spark, d)),
    "op2_quality_rules": lambda spark, d: quality.digest(documents(spark, d)),
    "op3_simhash": lambda spark, d: simhash.digest(documents(spark, d)),
    "op4_license_scan": lambda spark, d: licenses.scan(documents(spark, d)),
    "op5_language_id": lambda spark, d: language.digest(documents(spark, d)),
    "op6_toxicity": lambda spark, d: toxicity.digest(documents(spark, d), spark.read.parquet(f"{d}/labels.parquet")),
    "op7_lm_scoring": lambda spark, d: lm.digest(documents(spark, d)),
    "op8_media": lambda spark, d: media.digest(documents(spark, d)),
    "op9_mixing": lambda spark, d: mixing.digest(documents(spark, d)),
    "op10_packing": lambda spark, d: packing.packed(documents(spark, d)),
}

SQL = {"op2_quality_rules": quality.SQL, "op9_mixing": mixing.SQL}
