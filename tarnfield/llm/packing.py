"""Best-fit packing under conflicts: bins ordered by residual, each with bitmaps of sources and duplicate clusters."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from .common import WS, n_words, ship, stash, trimmed

CAPACITY = 2048
#: Documents that one task packs; tasks are filled by hash, so none grows with a source or a cluster.
GROUP = 20_000


class Packer:
    """Open bins by residual, each with bitmaps of the sources that are closed in it (one that fills half a bin is) and of the
    duplicate clusters in it (a cluster is in a bin at most once).

    Each residual keeps its bins by their bitmap of sources. Bitmaps over residuals say where bins are, where those of a
    bitmap are and where several bitmaps are, so the successor of a size that suits a source is found in words of bits
    instead of bin by bin. (Where there is room left, at most one source fills half, so a bitmap has at most one bit.)
    """

    def __init__(self, capacity: int = CAPACITY) -> None:
        self.capacity = capacity
        self.free: list[int] = []
        self.used: list[dict[int, int]] = []
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.at: dict[int, dict[int, dict[int, None]]] = {}
        self.any, self.several, self.of = 0, 0, Counter()

    def _mark(self, r: int) -> None:
        kinds, bit = self.at[r], 1 << r
        self.any = self.any | bit if kinds else self.any & ~bit
        self.several = self.several | bit if len(kinds) > 1 else self.several & ~bit

    def _out(self, b: int) -> None:
        r, k = self.free[b], self.sources[b]
        del self.at[r][k][b]
        if not self.at[r][k]:
            del self.at[r][k]
            self.of[k] &= ~(1 << r)
        self._mark(r)

    def _in(self, b: int) -> None:
        r, k = self.free[b], self.sources[b]
        if r:
            self.at.setdefault(r, {}).setdefault(k, {})[b] = None
            self.of[k] |= 1 << r
            self._mark(r)

    def candidates(self, size: int, source: int, cluster: int) -> Iterator[int]:
        """Compatible bins, tightest first; valid while only documents of this size, source and cluster are put."""
        r = size
        while mask := (self.several | self.any & ~self.of[source]) >> r:
            r += (mask & -mask).bit_length() - 1
            for kind, bins in list(self.at[r].items()):
                if not kind & source:
                    yield from (b for b in list(bins) if not self.clusters[b] & cluster)
            r += 1

    def put(self, b: int | None, size: int, source: int, cluster: int) -> tuple[int, int]:
        """Puts a document in a bin, a new one for None: bin and offset."""
        if b is None:
            b = len(self.free)
            self.free.append(self.capacity)
            self.used.append({})
            self.sources.append(0)
            self.clusters.append(0)
        else:
            self._out(b)
        at = self.capacity - self.free[b]
        self.free[b] -= size
        self.clusters[b] |= cluster
        self.used[b][source] = words = self.used[b].get(source, 0) + size
        if 2 * words >= self.capacity:
            self.sources[b] |= source
        self._in(b)
        return b, at


def pack(rows: list[tuple], capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """Bin and offset of each row (size, source, cluster); rows sorted by size, the largest first, equal ones together."""
    many = {c: 1 << i for i, c in enumerate(c for c, n in Counter(r[2] for r in rows).items() if n > 1)}
    ids: dict = {}
    packer, out, last, found = Packer(capacity), [], None, iter(())
    for row in rows:
        size, source, cluster = row[0], 1 << ids.setdefault(row[1], len(ids)), many.get(row[2], 0)
        if (size, source, cluster) != last or not cluster:
            last, found = (size, source, cluster), packer.candidates(size, source, cluster)
        out.append(packer.put(next(found, None), size, source, cluster))
    return out


def _split(table: pa.Table, capacity: int) -> tuple[list[tuple], list[tuple]]:
    """Rows (size, cluster, source, doc_id, piece, at) that fill a bin, and the tails, as they are packed."""
    whole, tails = [], []
    for doc_id, source, cluster, size, at in zip(*(table.column(c).to_pylist() for c in ("doc_id", "source", "cluster", "size", "at")), strict=True):
        whole += [(capacity, cluster, source, doc_id, k, at) for k in range(size // capacity)]
        if size % capacity:
            tails.append((size % capacity, cluster, source, doc_id, size // capacity, at))
    tails.sort(key=lambda r: (-r[0], r[1], r[2] is None, r[2] or "", r[3] is None, r[3] or 0, r[5]))
    return whole, tails


def _place(docs: DataFrame) -> list[Column]:
    """File and row of each row, or partition and row where the table is not read from Parquet."""
    try:
        docs.select("_metadata.file_path", "_metadata.row_index").schema
        return [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")]
    except AnalysisException:
        here = F.monotonically_increasing_id()
        return [F.format_string("part-%d", F.shiftright(here, 33)).alias("_file"), here.bitwiseAND((1 << 33) - 1).alias("_row")]


def _ordered(df: DataFrame) -> tuple[DataFrame, Column]:
    """df, which has file and row of each document, with at, the row's number in the order of the table, and the
    group of GROUP rows in a line."""
    files = df.groupBy("_file").agg(F.max("_row").alias("n"))  # a row a file
    part = F.coalesce(F.regexp_extract("_file", r"part-(\d+)", 1).try_cast("bigint"), F.lit(0))
    before = F.sum(F.col("n") + 1).over(W.orderBy(part, "_file").rowsBetween(W.unboundedPreceding, -1))
    df = df.join(files.select("_file", F.coalesce(before, F.lit(0)).alias("_start")), "_file")
    return df.withColumn("at", F.col("_start") + F.col("_row")), F.floor(F.col("at") / GROUP)


def packed(docs: DataFrame, capacity: int = CAPACITY, in_order: bool = False) -> DataFrame:
    """doc_id, source, piece, n_words, bin_id, bin_offset: every word of every document in one place.

    Texts longer than a bin fill bins of their own; their tails are packed with the others. Null and blank texts have one
    row with 0 words and no bin. The cluster of a document is its text, letters in lower case and white space as one blank;
    copies, also repeated rows, never share a bin. Null sources are a source; rows without doc_id are spread by text. An
    empty table gives none; columns beside doc_id, source and text are not read.

    Best fit looks at the bins of a group of documents, about GROUP of them: by hash, or, in_order, GROUP rows in a line
    of a table that is stored sorted (file by file; else by partition). Then bins are numbered by the first of their
    documents in that order, so that reading bins by number follows it, and position is the document's place in it.
    """
    text = F.coalesce("text", F.lit(""))
    cluster = F.xxhash64(F.lower(F.regexp_replace(trimmed(text), f"[{WS}]+", " ")))
    columns = ["doc_id", "source", cluster.alias("cluster"), n_words(F.col("text")).alias("size")]
    if in_order:
        columns += _place(docs)
    df = stash(docs.select(*columns), "sizes")
    ship(df.sparkSession)
    if in_order:
        df, key = _ordered(df)
    else:
        groups = max(1, -(-df.count() // GROUP))
        df, key = df.withColumn("at", F.lit(0).cast("bigint")), F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.col("cluster"))), F.lit(groups))
    schema = "doc_id long, source string, piece long, n_words long, bin_id long, bin_offset long" + ", position long" * in_order
    kind = to_arrow_schema(_parse_datatype_string(schema))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        whole, tails = _split(table, capacity)
        found = pack([(size, source, cluster) for size, cluster, source, *_ in tails], capacity)
        opened = 1 + max((b for b, _ in found), default=-1)
        found += [(opened + i, 0) for i in range(len(whole))]
        rows = tails + whole
        if in_order:
            first: dict[int, int] = {}
            for (b, _), r in zip(found, rows, strict=True):
                first[b] = min(r[5], first.get(b, r[5]))
            number = {b: i for i, b in enumerate(sorted(first, key=lambda b: (first[b], b)))}
            found = [(number[b], x) for b, x in found]
        base = key[0].as_py() << 32
        out = [[r[3] for r in rows], [r[2] for r in rows], [r[4] for r in rows], [r[0] for r in rows], [base | b for b, _ in found], [x for _, x in found], [r[5] for r in rows]]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(out, kind, strict=False)], schema=kind)

    long = lambda x, name: F.lit(x).cast("bigint").alias(name)
    none = df.where("size = 0").select("doc_id", "source", long(0, "piece"), F.col("size").alias("n_words"), long(None, "bin_id"), long(None, "bin_offset"), *([F.col("at").alias("position")] if in_order else []))
    some = df.where("size > 0").withColumn("_group", key.cast("bigint")).groupBy("_group").applyInArrow(run, schema)
    return some.unionByName(none)
