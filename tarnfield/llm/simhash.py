"""Near-duplicates by SimHash and anchor points of a covering code.

Fingerprints of 64 bits are cut into blocks; with at most r differing bits, some block differs in at most t (r // blocks).
Within a block the leading bits are covered by a perfect Hamming code of radius 1, the others by themselves. Each fingerprint
is replicated to every anchor (codeword) that a fingerprint within t bits may have as its own: those within covering radius
plus t. So each linked pair meets at an anchor, where whole fingerprints are compared.

op3's fingerprints are of 4-word shingles and link at 4 bits, as its contract says. Copies with 5-word shingles in common
to 0.8 differ in 3 to 14 bits of such fingerprints, which no covering code reaches with few replicas. The stage of the
pipeline therefore meets by fingerprints of single words (of which such copies share some 98 %) at 5 bits, which takes as
many replicas as 4, and settles each pair at its anchor by 128 bits of SimHash over 5-word shingles that travel along.
"""

from __future__ import annotations

from collections import Counter
from functools import cache
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import DOCUMENTS, map_texts, ship, stash

SHINGLE = 4
SEED = 42
THRESHOLD = 4
#: Above so many distinct fingerprints, two blocks of 32 bits (2^27 anchors each) instead of three (2^17 and more):
#: more copies of each, fewer at an anchor. Both are exact.
TWO_BLOCKS_FROM = 50_000_000
#: Groups at an anchor up to this size are compared pair by pair in bulk, larger ones by a search from unlinked ones,
#: and over WHOLE in pieces. All are exact.
BULK, WHOLE = 64, 4096
#: The pipeline's stage: shingles, bits of the words' SimHash, and bits of the 128 of the shingles' that may differ.
NEAR_SHINGLE, NEAR_RADIUS, NEAR_LIMIT = 5, 5, 24
WEIGHT_UNIT = 256
MIX = np.uint64(0x9E3779B97F4A7C15)


def _majority(hashes: np.ndarray, weights: np.ndarray | None = None) -> int:
    """The bits that are set in over half of the hashes' weight, as an unsigned number."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        bits = np.unpackbits(hashes[at : at + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        votes += bits.sum(axis=0, dtype=np.int64) if weights is None else weights[at : at + 4096] @ bits
    total = len(hashes) if weights is None else int(weights.sum())
    return int.from_bytes(np.packbits(votes * 2 > total).tobytes(), "big")


def _hashes(words: list[bytes], width: int) -> np.ndarray:
    """XXH64 of every run of so many words, joined by blanks; of all words if there are fewer."""
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: 1 - width].tolist(), ends[width - 1 :].tolist(), strict=True)
    return np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in spans], dtype=np.uint64)


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def fingerprint(text: str | None) -> int:
    """SimHash of the 4-word shingles, repeats included; 0 without words. Unsigned."""
    words = _words(text)
    return _majority(_hashes(words, SHINGLE)) if words else 0


def near_print(text: str | None) -> tuple[int, int, int]:
    """SimHash of the words, each by the root of its count, and 128 bits of it over the distinct 5-word shingles. Zeros
    without words."""
    words = _words(text)
    if not words:
        return 0, 0, 0
    counts = Counter(words)
    weights = np.array([round(WEIGHT_UNIT * n**0.5) for n in counts.values()], dtype=np.int64)
    shingles = np.unique(_hashes(words, NEAR_SHINGLE))
    other = (shingles ^ (shingles >> np.uint64(31))) * MIX
    other = (other ^ (other >> np.uint64(29))) * MIX
    singles = np.array([xxh64_intdigest(w, SEED) for w in counts], dtype=np.uint64)
    return _majority(singles, weights), _majority(shingles), _majority(other ^ (other >> np.uint64(32)))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint as signed 64 bits."""
    return map_texts(docs, ("doc_id", "text"), lambda ids, texts: [ids, [_signed(fingerprint(t)) for t in texts]], "doc_id long, fp long")


def near_prints(docs: DataFrame) -> DataFrame:
    """doc_id, fp, c1, c2: the parts of near_print as signed 64 bits."""
    run = lambda ids, texts: [ids, *([_signed(x) for x in c] for c in zip(*map(near_print, texts), strict=True))] if ids else [[], [], [], []]
    return map_texts(docs, ("doc_id", "text"), run, "doc_id long, fp long, c1 long, c2 long")


@cache
def layout(blocks: int, radius: int = THRESHOLD) -> list[tuple[int, int, int, list[np.ndarray]]]:
    """Of each block: first bit, width, width of the Hamming part, and by syndrome the masks that lead to its anchors."""
    t, m = radius // blocks, 4 if blocks == 3 else 5
    part = (1 << m) - 1
    out, at = [], 0
    for k in range(blocks):
        width = 64 // blocks + (k < 64 % blocks)
        flips = [(len(c), sum(1 << i for i in c)) for n in range(t + 1) for c in combinations(range(width - part), n)]
        masks: list[list[int]] = [[] for _ in range(part + 1)]
        for n in range(t + 2):
            for c in combinations(range(1, part + 1), n):
                syndrome, error = 0, 0
                for i in c:
                    syndrome ^= i
                    error |= 1 << (i - 1)
                masks[syndrome] += [error | flip << part for e, flip in flips if max(0, n - 1) + e <= t]
        out.append((at, width, part, [np.array(x, dtype=np.uint64) for x in masks]))
        at += width
    return out


def syndromes(values: np.ndarray, part: int) -> np.ndarray:
    out = np.zeros(len(values), np.uint64)
    for i in range(part):
        out ^= ((values >> np.uint64(i)) & np.uint64(1)) * np.uint64(i + 1)
    return out.astype(np.int64)


def anchors(fps: np.ndarray, blocks: int, radius: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, index of the fingerprint) of every anchor that each fingerprint is replicated to."""
    keys, who = [], []
    for k, (at, width, part, masks) in enumerate(layout(blocks, radius)):
        value = (fps >> np.uint64(at)) & np.uint64((1 << width) - 1)
        syndrome = syndromes(value & np.uint64((1 << part) - 1), part)
        for s in np.unique(syndrome):
            rows = np.flatnonzero(syndrome == s)
            keys.append(((value[rows, None] ^ masks[s][None, :]) | np.uint64(k << width)).ravel())
            who.append(np.repeat(rows, len(masks[s])))
    return np.concatenate(keys), np.concatenate(who)


class Prints(NamedTuple):
    """Columns of what is compared: fingerprints, checks that must be near too, and a number for each."""

    fps: np.ndarray
    ids: np.ndarray
    checks: tuple[np.ndarray, ...] = ()

    def take(self, at) -> Prints:
        return Prints(self.fps[at], self.ids[at], tuple(c[at] for c in self.checks))

    def near(self, other: Prints, radius: int, limit: int) -> np.ndarray:
        """Whether each is linked to the other's at its place (or the only one)."""
        out = np.bitwise_count(self.fps ^ other.fps) <= radius
        if self.checks:
            far = sum(np.bitwise_count(a ^ b).astype(np.int64) for a, b in zip(self.checks, other.checks, strict=True))
            out &= far <= limit
        return out


def _stars(group: Prints, radius: int, limit: int) -> list[tuple[int, int]]:
    """A tree for each component of a group: each step compares one with those not yet linked."""
    out, rest = [], np.arange(len(group.fps))
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            at = front.pop()
            near = group.take(rest).near(group.take([at]), radius, limit)
            if near.any():
                out += [(int(group.ids[at]), int(x)) for x in group.ids[rest[near]]]
                front.extend(rest[near])
                rest = rest[~near]
    return out


def _search(group: Prints, radius: int, limit: int) -> list[tuple[int, int]]:
    """Links that join a large group's components. Very large ones are cut by the value of each of radius + 1 pieces of the
    fingerprint, in one of which a linked pair agrees."""
    if len(group.fps) <= WHOLE:
        return _stars(group, radius, limit)
    out, cuts = [], np.linspace(0, 64, radius + 2).astype(int)
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        piece = (group.fps >> np.uint64(lo)) & np.uint64((1 << int(hi - lo)) - 1)
        order = np.argsort(piece, kind="stable")
        for run in np.split(order, np.flatnonzero(np.diff(piece[order])) + 1):
            if len(run) > 1:
                out += _stars(group.take(run), radius, limit)
    return out


def links(keys: np.ndarray, rows: Prints, radius: int = THRESHOLD, limit: int = 0) -> list[tuple[int, int]]:
    """Links that join what the linked pairs within each run of equal keys join; no more than one for each number."""
    cuts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
    sizes = np.diff(cuts)
    ids, number = np.unique(rows.ids, return_inverse=True)
    root = np.arange(len(ids))
    found: list[tuple[int, int]] = []
    for i in np.flatnonzero(sizes > BULK):
        found += _search(rows.take(cuts[i] + np.unique(rows.ids[cuts[i] : cuts[i + 1]], return_index=True)[1]), radius, limit)
    if found:
        root = _joined(root, *(np.searchsorted(ids, np.array(x, ids.dtype)) for x in zip(*found, strict=True)))
    small = np.repeat(sizes <= BULK, sizes)
    keys, rows, number = keys[small], rows.take(small), number[small]
    at = np.arange(len(keys))
    for k in range(1, BULK):  # pairs are joined at once: kept, those of groups of copies would be many times the rows
        at = at[: np.searchsorted(at, len(keys) - k)]
        at = at[keys[at] == keys[at + k]]
        if not len(at):
            break
        apart = at[root[number[at]] != root[number[at + k]]]
        near = apart[rows.take(apart).near(rows.take(apart + k), radius, limit)]
        root = _joined(root, number[near], number[near + k])
    moved = np.flatnonzero(root != np.arange(len(ids)))
    return list(zip(ids[moved].tolist(), ids[root[moved]].tolist(), strict=True))


def _joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least number of each number's component, after a and b at the same place are joined."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up


def linked(distinct: DataFrame, blocks: int = 3, radius: int = THRESHOLD, checks: tuple[str, ...] = (), limit: int = 0) -> DataFrame:
    """Links u, v between the numbers (column id) of distinct fingerprints fp, enough to join what is linked: at most radius
    bits of fp and limit bits of the checks together differ."""
    ship(distinct.sparkSession)
    names = ["anchor", "fp", "id", *checks]

    def replicate(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 20_000):
                columns = [c[lo : lo + 20_000].to_numpy(zero_copy_only=False) for c in batch.columns]
                keys, who = anchors(columns[0].view(np.uint64), blocks, radius)
                for at in range(0, len(keys), 200_000):
                    here = who[at : at + 200_000]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys[at : at + 200_000].view(np.int64), *(c[here] for c in columns))], names=names)

    def compare(batches):
        held: list[list[np.ndarray]] = []
        rows = 0
        kind = pa.schema([("u", pa.int64()), ("v", pa.int64())])

        def told(parts):
            keys, fps, ids, *more = (np.concatenate(x) for x in zip(*parts, strict=True))
            found = links(keys, Prints(fps.view(np.uint64), ids, tuple(c.view(np.uint64) for c in more)), radius, limit) if len(keys) else []
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], schema=kind)

        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            keys = columns[0]
            rows += len(keys)
            start = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # of the last anchor, which may go on
            if rows >= 200_000 and (start or held and held[-1][0][-1] != keys[-1]):
                yield told([*held, [c[:start] for c in columns]])
                held, rows = [], len(keys) - start
                columns = [c[start:] for c in columns]
            if len(columns[0]):
                held.append(columns)
        if held:
            yield told(held)

    spread = distinct.select("fp", "id", *checks).mapInArrow(replicate, ", ".join(f"{n} long" for n in names))
    return spread.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(compare, "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root of every node of edges u, v: alternating large and small stars until nothing moves.

    Each round is written to the shared folder; rounds grow as the logarithm of the longest chain.
    """
    edges = stash(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links")
    measure = lambda e: e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    before = measure(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # minima are written out, so that both sides of a join are plain shuffles, which adaptive execution splits at a hub
        least = stash(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stash(large, "links")
        least = stash(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = stash(small, "links")
        now = measure(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _blocks(distinct: DataFrame) -> int:
    return 2 if distinct.count() > TWO_BLOCKS_FROM else 3


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, fp (signed), component_id, the smallest doc_id reachable over links.

    Null, empty and blank texts have fingerprint 0, and link as any other. Rows without doc_id have the class of their
    fingerprint (null if none of it has a doc_id). Repeated rows share a class; an empty table gives none. Only doc_id and
    text are read. A fingerprint that many rows share goes through comparison once.
    """
    prints = stash(fingerprints(docs), "fingerprints")
    distinct = stash(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = stash(components(linked(distinct.withColumn("id", F.col("fp")), _blocks(distinct))), "roots")
    members = distinct.join(roots, distinct.fp == roots.node).select("fp", "root", "first")
    classes = members.join(members.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "component_id")
    known = distinct.join(classes, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    known = stash(known, "classes")  # as a scan, so that adaptive execution may split a hot fingerprint in the last join
    return prints.join(known, "fp").select("doc_id", "fp", "component_id")


def digest(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id and root, the smallest doc_id of its class, of the documents that are not the first of their class.

    Classes are components of links: at most NEAR_RADIUS bits of the words' SimHash and NEAR_LIMIT of 128 bits of that
    of 5-word shingles differ. (Shingle sets of similarity 0.8 differ in 19 bits on average, deviation 4.) Rows without
    doc_id are in no class. Null, empty and blank texts are copies of each other. Repeated rows are one document; an id
    whose rows have different texts is a copy only if all of them are.
    """
    prints = stash(near_prints(docs.where("doc_id IS NOT NULL")), "fingerprints")
    firsts = prints.groupBy("fp", "c1", "c2").agg(F.min("doc_id").alias("id"))
    distinct = stash(firsts, "distinct")
    roots = stash(components(linked(distinct, _blocks(distinct), NEAR_RADIUS, ("c1", "c2"), NEAR_LIMIT)), "roots")
    joined = stash(distinct.join(roots, distinct.id == roots.node, "left").select("fp", "c1", "c2", F.coalesce("root", "id").alias("root")), "classes")
    return prints.join(joined, ["fp", "c1", "c2"]).groupBy("doc_id").agg(F.min("root").alias("root"), F.bool_and(F.col("doc_id") != F.col("root")).alias("_copy")).where("_copy").drop("_copy")


def stage(docs: DataFrame) -> DataFrame:
    """The document with the smallest doc_id of each class of near_copies, one row of it (the least by its other columns);
    rows without doc_id stay. Null and empty texts are a class. An empty table gives none; columns beside those of
    documents are dropped."""
    docs = docs.select(*DOCUMENTS)
    first = docs.where("doc_id IS NOT NULL").join(near_copies(docs).select("doc_id"), "doc_id", "left_anti")
    best = first.groupBy("doc_id").agg(F.min(F.struct(*DOCUMENTS[1:])).alias("_d"))
    return best.select("doc_id", "_d.*").select(*DOCUMENTS).unionByName(docs.where("doc_id IS NULL"))
