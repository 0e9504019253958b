"""JSON documents under a policy: reading, checking, and the rows that the index keeps of them."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.analysis import PLAIN, Analyzer
from ..functions.words import millis
from ..schema import NUMERIC, Field, Policy

#: kind: post (term, positions, spans), len (len), exact (term), name (term, level), num (num).
INDEX_SCHEMA = "key string, row string, term string, level int, positions array<int>, spans array<int>, len int, num double, kind string, field string"
ARROW = pa.schema([(name, {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "array<int>": pa.list_(pa.int32())}[kind]) for name, kind in (x.split(" ") for x in INDEX_SCHEMA.split(", "))])
CHUNK_DOCS, CHUNK_BYTES = 4096, 4 << 20  #: of documents analyzed at once in a task
SHORT = 100  #: characters of a value that is analyzed once for all documents of a chunk


def from_text(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """One document a line, or with whole one document or array of documents a file: column source."""
    df = spark.read.text(path, wholetext=whole).where("trim(value) <> ''").select(F.col("value").alias("source"))
    if not whole:
        return df
    items = F.from_json("source", "array<string>")
    return df.select(F.explode(F.when(F.ltrim("source").startswith("["), items).otherwise(F.array("source"))).alias("source"))


def from_objects(spark: SparkSession, documents: Iterable[object]) -> DataFrame:
    return spark.createDataFrame([(d if isinstance(d, str) else json.dumps(d, ensure_ascii=False),) for d in documents], "source string")


def walk(fields: Iterable[Field], value: dict, row: tuple[int, ...] = ()) -> Iterator[tuple[Field, object, tuple[int, ...]]]:
    """(leaf, its value, indices in the arrays around it); raises for a value of the wrong shape."""
    for f in fields:
        x = value.get(f.name)
        if x is None:
            continue
        if f.repeated and not isinstance(x, list):
            raise Wrong(f, "array", x)
        if f.kind != "struct":
            yield f, x, row
        else:
            for i, item in enumerate(x if f.repeated else [x]):
                if item is None:
                    continue
                if not isinstance(item, dict):
                    raise Wrong(f, "object", item)
                yield from walk(f.parts, item, (*row, i) if f.repeated else row)


class Wrong(ValueError):
    def __init__(self, f: Field, expected: str, got: object) -> None:
        super().__init__(json.dumps({"error": "InvalidField", "field": f.path, "expected": expected, "got": type(got).__name__}))


def number(f: Field, x: object) -> float | None:
    """A leaf as it is filtered and sorted by; None if it isn't of the field's kind."""
    if f.kind == "bool":
        return float(x) if isinstance(x, bool) else None
    if isinstance(x, bool):
        return None
    if f.kind == "date":
        at = millis(str(x), f.format) if isinstance(x, str) or isinstance(x, int) and f.format == "epoch-millis" else None
        return None if at is None else float(at)
    return float(x) if isinstance(x, int) or f.kind == "float" and isinstance(x, float) else None


def check(policy: Policy, source: str) -> tuple[str | None, str | None]:
    """(id, error as JSON) of a document."""
    try:
        doc = json.loads(source)
    except (ValueError, RecursionError):
        return None, json.dumps({"error": "InvalidJson"})
    if not isinstance(doc, dict):
        return None, json.dumps({"error": "InvalidJson"})
    found = None
    try:
        for f, x, _ in walk(policy.fields, doc):
            for item in x if f.repeated else [x]:
                if f.kind in ("text", "id", "id_auto"):
                    if not isinstance(item, str):
                        raise Wrong(f, f.kind, item)
                elif f.kind != "none" and number(f, item) is None:
                    raise Wrong(f, f.kind, item)
            if f.kind in ("id", "id_auto"):
                found = x
    except Wrong as e:
        return found, str(e)
    if policy.id_field.kind == "id" and not found:
        return None, json.dumps({"error": "MissingId", "field": policy.id_field.path})
    return found, None


def checked(raw: DataFrame, policy: Policy) -> DataFrame:
    """ordinal, key, source, error of documents (column source); ids that the engine gives are drawn here, so write the
    result before it is read twice."""
    kind = pa.schema([("source", pa.string()), ("key", pa.string()), ("error", pa.string())])

    def run(batches):
        for b in batches:
            texts = b.column(0).to_pylist()
            found = [check(policy, t) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), pa.array([k for k, _ in found], pa.string()), pa.array([e for _, e in found], pa.string())], schema=kind)

    df = raw.select("source").mapInArrow(run, "source string, key string, error string")
    key = F.coalesce("key", F.uuid()) if policy.id_field.kind == "id_auto" else F.col("key")
    return df.select(F.monotonically_increasing_id().alias("ordinal"), key.alias("key"), "source", "error")


def index_rows(docs: DataFrame, policy: Policy) -> DataFrame:
    """What the index keeps of documents (key, source), a row for each term, length, whole value, name key and number."""

    def run(batches):
        for b in batches:
            for part in chunks(b):
                yield from index_batches(policy, part.column(0).to_pylist(), part.column(1).to_pylist())

    return docs.select("key", "source").mapInArrow(run, INDEX_SCHEMA)


def chunks(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch of documents (key, source) in pieces of CHUNK_DOCS and CHUNK_BYTES at most; a longer document is alone."""
    lo = total = 0
    for hi, n in enumerate(pc.binary_length(b.column(1)).to_pylist()):
        if hi > lo and (hi - lo >= CHUNK_DOCS or total + n > CHUNK_BYTES):
            yield b.slice(lo, hi - lo)
            lo, total = hi, 0
        total += n
    if b.num_rows:
        yield b.slice(lo)


def index_batches(policy: Policy, keys: list[str], sources: list[str]) -> Iterator[pa.RecordBatch]:
    """index_rows of a few documents: a batch for each kind and field, in the order that the index is sorted by."""
    order = sorted(range(len(keys)), key=keys.__getitem__)
    docs = [json.loads(sources[i]) for i in order]
    names = pa.array([keys[i] for i in order], pa.string())
    made = [x for f, at, rows, values in gathered(policy, names.to_pylist(), docs) for x in _columns(policy, f, at, rows, values)]
    for kind, path, at, columns in sorted(made, key=lambda x: x[:2]):
        given = {"key": names.take(pa.array(at)), "kind": pa.repeat(kind, len(at)), "field": pa.repeat(path, len(at))} | columns
        yield pa.RecordBatch.from_arrays([given[f.name] if f.name in given else pa.nulls(len(at), f.type) for f in ARROW], schema=ARROW)


def gathered(policy: Policy, keys: list[str], docs: list[dict]) -> Iterator[tuple[Field, np.ndarray, pa.Array, list]]:
    """(leaf, places of its documents, their rows, values) of each leaf; the id's values are the keys."""
    yield policy.id_field, np.arange(len(docs)), pa.repeat("", len(docs)), keys
    for top in policy.fields:
        found: dict[str, tuple[Field, list[int], list[str], list]] = {}
        if top.kind != "struct":
            values = [d.get(top.name) for d in docs]
            at = [i for i, x in enumerate(values) if x is not None]
            found[top.path] = top, at, [""] * len(at), [values[i] for i in at]
        else:
            for i, d in enumerate(docs):
                for f, x, row in walk((top,), d):
                    _, at, rows, values = found.setdefault(f.path, (f, [], [], []))
                    at.append(i)
                    rows.append(".".join(map(str, row)))
                    values.append(x)
        yield from ((f, np.array(at), pa.array(rows, pa.string()), values) for path, (f, at, rows, values) in found.items() if at and path != policy.id_field.path)


def _columns(policy: Policy, f: Field, at: np.ndarray, rows: pa.Array, values: list) -> Iterator[tuple[str, str, np.ndarray, dict[str, pa.Array]]]:
    """(kind, path, places of documents, the other columns) of what the index keeps of a leaf, sorted by term and document."""

    def put(kind: str, own: np.ndarray, **columns: pa.Array):
        return kind, f.path, at[own], {"row": rows.take(pa.array(own))} | columns

    items = [x for v in values for x in v] if f.repeated else values
    of = np.repeat(np.arange(len(values)), [len(v) for v in values]) if f.repeated else np.arange(len(values))
    if f.kind in NUMERIC:
        yield put("num", of, num=pa.array([number(f, x) for x in items], pa.float64()))
    if f.kind not in ("text", "id", "id_auto"):
        return
    if f.exact:
        terms = [x.strip().lower() for x in items]
        order = sorted(range(len(items)), key=terms.__getitem__)
        yield put("exact", of[order], term=pa.array([terms[i] for i in order], pa.string()))
    analyzer = policy.analyzer_of(f)
    if f.exact and f.kind == "text":
        known: dict[str, list] = {}
        named = sorted((term, i, level) for i, x in zip(of.tolist(), items, strict=True) for term, level in (known.get(x) or known.setdefault(x, analyzer.name_keys(x))))
        if named:
            terms, own, levels = zip(*named, strict=True)
            yield put("name", np.array(own), term=pa.array(terms, pa.string()), level=pa.array(levels, pa.int32()))
    if f.searchable:
        yield from _postings(analyzer, f, values, put)


class Vocabulary(dict):
    """Numbers of words by the terms that an analyzer makes of them, -1 for words it drops."""

    def __init__(self, analyzer: Analyzer) -> None:
        self.analyzer, self.ids = analyzer, {}

    def __missing__(self, word: str) -> int:
        term = self.analyzer.term(word)
        self[word] = n = -1 if term is None else self.ids.setdefault(term, len(self.ids))
        return n


def _postings(analyzer: Analyzer, f: Field, values: list, put) -> Iterator[tuple]:
    """Terms with their positions, and lengths. Words of plain tokenizers are looked up, short repeated values analyzed once."""
    n = len(values)
    if analyzer.tokenizer in PLAIN and not f.repeated:
        known, ids, counts = Vocabulary(analyzer), [], []
        for v in values:
            words = PLAIN[analyzer.tokenizer].findall(analyzer.filtered(v))
            ids += map(known.__getitem__, words)
            counts.append(len(words))
        terms, ids, counts = known.ids, np.array(ids, np.int64), np.array(counts)
        own = np.repeat(np.arange(n), counts)
        places = np.arange(len(ids)) - np.repeat(np.cumsum(counts) - counts, counts)
        own, places, ids = own[ids >= 0], places[ids >= 0], ids[ids >= 0]
        spans, sizes = np.ones(len(ids), np.int32), np.bincount(own, minlength=n)
    else:
        terms, kept, parts = {}, {}, []
        for v in values:
            part = None if f.repeated else kept.get(v)
            if part is None:
                at = {(t.term, t.pos): t.span for t in (analyzer.flat(v) if f.repeated else analyzer.tokens(v))}
                part = [terms.setdefault(t, len(terms)) for t, _ in at], [p for _, p in at], list(at.values()), len({p for _, p in at})
                if not f.repeated and len(v) <= SHORT:
                    kept[v] = part
            parts.append(part)
        ids, places, spans = (np.array([x for p in parts for x in p[i]], np.int64) for i in range(3))
        own, sizes = np.repeat(np.arange(n), [len(p[0]) for p in parts]), np.array([p[3] for p in parts])
    if not len(ids):
        return
    ordered = sorted(terms)
    rank = np.empty(len(ordered), np.int64)
    rank[[terms[t] for t in ordered]] = np.arange(len(ordered))
    code = rank[ids] * n + own
    order = np.argsort(code, kind="stable")
    code = code[order]
    first = np.flatnonzero(np.diff(code, prepend=-1))
    offsets = pa.array(np.append(first, len(code)).astype(np.int32))
    group, own = np.divmod(code[first], n)
    lists = {name: pa.ListArray.from_arrays(offsets, pa.array(x[order].astype(np.int32))) for name, x in (("positions", places), ("spans", spans))}
    yield put("post", own, term=pa.array(ordered, pa.string()).take(pa.array(group)), len=pa.array(sizes[own].astype(np.int32)), **lists)
    some = np.flatnonzero(sizes)
    yield put("len", some, len=pa.array(sizes[some].astype(np.int32)))
