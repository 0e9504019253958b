"""What the operators of this subpackage share: words, shared folders, Arrow maps."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable
from pathlib import Path

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: White space that parts words, as a character class body for Java and RE2.
WS = r"\x20\x09-\x0D"
WS_CHARS = " \t\n\x0b\x0c\r"
DOCUMENTS = ("doc_id", "text", "lang", "source", "n_chars")
#: Rows handled at once inside a Python task; bounds its memory, never the result.
CHUNK = 1000
#: Bytes of freed memory that a Python worker keeps.
KEPT = 1 << 26

_made: list[str] = []
_written: list[str] = []


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package when the driver runs from another folder; a task has one core, so numpy has one
    thread in it (more would wait for each other). Workers keep up to KEPT bytes of freed memory: arrays that come and go with
    each step would else be given back to the system and faulted in again page by page."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    env.setdefault("OPENBLAS_NUM_THREADS", "1")
    env.setdefault("MALLOC_TRIM_THRESHOLD_", str(KEPT))
    env.setdefault("MALLOC_MMAP_THRESHOLD_", str(KEPT // 2))
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own in local mode only."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    _made.append(own := tempfile.mkdtemp(prefix="tarnfield-"))
    sc.setCheckpointDir(f"file://{own}")
    return f"file://{own}"


@atexit.register
def _clean() -> None:
    for path in _made:
        shutil.rmtree(path, ignore_errors=True)
    clear()


def clear() -> None:
    """Deletes the intermediate tables that this process has written; what reads them can't be computed again."""
    while _written:
        path = _written.pop()
        with contextlib.suppress(OSError, ValueError, pa.ArrowException):  # gone with its folder, or a store that only Spark reaches
            system, where = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
            system.delete_dir(where)


def new_folder(spark: SparkSession, tag: str) -> str:
    """A folder for intermediate data in the shared one; deleted by clear(), or when this process ends."""
    _written.append(path := f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}")
    return path


def stash(df: DataFrame, tag: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: computed once, and safe from lost executors."""
    spark = df.sparkSession
    df.write.option("compression", "zstd").parquet(path := new_folder(spark, tag))
    return spark.read.schema(df.schema).parquet(path)


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(WS_CHARS))


def n_words(text: Column) -> Column:
    """Number of words as bigint; null and blank texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{WS}]+")), F.lit(0)).cast("bigint")


def map_texts(df: DataFrame, columns: Iterable[str], fn: Callable, schema: str, chunk: int = CHUNK) -> DataFrame:
    """fn(lists of the columns' values) gives lists or Arrow arrays of the output's columns; runs over Arrow batches, chunk rows at once."""
    ship(df.sparkSession)
    kind: StructType = _parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                part = batch.slice(at, chunk)
                out = fn(*(c.to_pylist() for c in part.columns))
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(out, arrow, strict=True)], schema=arrow)

    return df.select(*columns).mapInArrow(run, kind)
