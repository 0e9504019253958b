"""A database of documents under a policy: segments of Parquet, written once, and manifests that say which of them count.

A write adds a segment: its documents, their index rows by kind and field, and the keys whose earlier rows it ends. Readers
take a manifest and leave out rows that a later segment ended, so nothing stored is rewritten before compaction.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.analysis import Analyzer
from .functions.highlights import Options, fragments, spans
from .functions.synonyms import Dictionary
from .functions.text import wildcard_regex
from .functions.words import MARGIN, patch_json
from .operators import search as operators
from .plans.parse import Node, analyzed, blank, leaves, parse
from .plans.search import Tables, cascade, filtered, forms, limits, ordered, ranked, weight_of
from .schema import NUMERIC, Policy, PolicyError
from .sources.json_documents import INDEX_SCHEMA, checked, from_objects, index_rows

DOCS = "key string, source string"
TERMS = "field string, term string, rows long, df long"
MAX_PAGE = 1000
#: Bytes of documents, before compression, that lie together and are indexed by one task, and of the file that it reads: what a
#: task sorts is bounded, however many documents a segment has.
BLOCK, SPLIT = 8 << 20, 4 << 20


class Database:
    """Writes return a DataFrame (key, error) of what failed. One writer at a time; readers see whole versions."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.fs, self.root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        self.root = self.root.rstrip("/")
        self._load()

    # Files

    @classmethod
    def create(cls, spark: SparkSession, folder: str, policy: dict, dictionary: str = "") -> Database:
        Policy.parse(policy)
        Dictionary.parse(dictionary)
        system, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        system.create_dir(root, recursive=True)
        if any(re.match(r"manifest-\d+", f.base_name) for f in system.get_file_info(fs.FileSelector(root))):
            raise FileExistsError(folder)
        with system.open_output_stream(f"{root.rstrip('/')}/manifest-00000000.json") as out:
            out.write(json.dumps({"version": 0, "policy": policy, "dictionary": dictionary, "segments": []}).encode())
        return cls(spark, folder)

    def versions(self) -> list[int]:
        return sorted(int(m[1]) for f in self.fs.get_file_info(fs.FileSelector(self.root)) if (m := re.fullmatch(r"manifest-(\d+)\.json", f.base_name)))

    def _load(self, version: int | None = None) -> None:
        version = max(self.versions()) if version is None else version
        with self.fs.open_input_stream(f"{self.root}/manifest-{version:08d}.json") as f:
            self.manifest = json.loads(f.read())
        self.policy, self.dictionary = Policy.parse(self.manifest["policy"]), Dictionary.parse(self.manifest["dictionary"])
        self.tables = Tables(self._index, self.policy, *self._counted())

    def _commit(self, **changes: object) -> None:
        made = self.manifest | changes | {"version": max(self.versions()) + 1}
        with self.fs.open_output_stream(f"{self.root}/manifest-{made['version']:08d}.json") as out:
            out.write(json.dumps(made).encode())
        self._load(made["version"])

    def _path(self, segment: dict, part: str) -> str:
        return f"{self.folder}/{segment['name']}/{part}"

    def drop(self) -> None:
        self.fs.delete_dir(self.root)

    def rename(self, folder: str) -> Database:
        self.fs.move(self.root, fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")[1])
        return Database(self.spark, folder)

    def clear(self) -> None:
        self._commit(segments=[])

    def set_policy(self, policy: dict) -> str:
        """Holds for what is written from now on; the rest needs reindex()."""
        Policy.parse(policy)
        changed = policy != self.manifest["policy"]
        self._commit(policy=policy)
        return "policy changed; reindex required to apply to existing documents" if changed else "policy unchanged"

    def set_dictionary(self, text: str) -> None:
        Dictionary.parse(text)
        self._commit(dictionary=text)

    def backup(self, folder: str) -> int:
        """Copies files that the folder hasn't, then the manifest: full at first, later what is new. The version saved."""
        system, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        root = root.rstrip("/")
        system.create_dir(root, recursive=True)
        for s in self.manifest["segments"]:
            if system.get_file_info(f"{root}/{s['name']}/_done").type == fs.FileType.NotFound:
                system.create_dir(f"{root}/{s['name']}", recursive=True)
                fs.copy_files(f"{self.root}/{s['name']}", f"{root}/{s['name']}", source_filesystem=self.fs, destination_filesystem=system)
                with system.open_output_stream(f"{root}/{s['name']}/_done") as out:
                    out.write(b"")
        with system.open_output_stream(f"{root}/manifest-{self.manifest['version']:08d}.json") as out:
            out.write(json.dumps(self.manifest).encode())
        return self.manifest["version"]

    @classmethod
    def restore(cls, spark: SparkSession, backup: str, folder: str, version: int | None = None) -> Database:
        saved = cls(spark, backup)
        saved._load(version)
        cls.create(spark, folder, saved.manifest["policy"], saved.manifest["dictionary"])
        out = cls(spark, folder)
        for s in saved.manifest["segments"]:
            fs.copy_files(f"{saved.root}/{s['name']}", f"{out.root}/{s['name']}", source_filesystem=saved.fs, destination_filesystem=out.fs)
        out._commit(segments=saved.manifest["segments"])
        return out

    # Reading

    def _live(self, part: str, schema: str, where=lambda df: df) -> DataFrame:
        """Rows of all segments, with seq, but those whose key a later segment ended."""
        segments = [s for s in self.manifest["segments"] if s["rows"]]
        if not segments:
            return self.spark.createDataFrame([], f"{schema}, seq int")
        df = reduce(DataFrame.unionByName, (where(self.spark.read.schema(schema).parquet(self._path(s, part))).withColumn("seq", F.lit(s["seq"])) for s in segments))
        ends = [self.spark.read.schema("key string").parquet(self._path(s, "ended")).withColumn("until", F.lit(s["seq"])) for s in self.manifest["segments"] if s["ended"]]
        if not ends:
            return df
        ended = reduce(DataFrame.unionByName, ends).groupBy("key").agg(F.max("until").alias("until")).withColumnRenamed("key", "_key")
        return df.join(ended, (F.col("key") == F.col("_key")) & (F.col("seq") < F.col("until")), "left_anti")

    def _counted(self) -> tuple[dict[str, tuple[int, int]] | None, DataFrame | None]:
        """Totals by field and the dictionary, as segments counted them; None when rows have ended since, or there are none."""
        segments = [s for s in self.manifest["segments"] if s["rows"]]
        if not segments or any(s["ended"] for s in self.manifest["segments"]) or any("totals" not in s for s in segments):
            return None, None
        totals: dict[str, tuple[int, int]] = {}
        for s in segments:
            for path, (n, total) in s["totals"].items():
                a, b = totals.get(path, (0, 0))
                totals[path] = (a + n, b + total)
        return totals, reduce(DataFrame.unionByName, (self.spark.read.schema(TERMS).parquet(self._path(s, "terms")) for s in segments))

    def documents(self) -> DataFrame:
        """key, source of every document stored."""
        return self._live("docs", DOCS).drop("seq")

    def _index(self, kind: str) -> DataFrame:
        return self._live("index", INDEX_SCHEMA, lambda df: df.where(F.col("kind") == kind)).drop("seq")

    # Writing

    def _raw(self, docs: DataFrame | Iterable[object]) -> DataFrame:
        return docs if isinstance(docs, DataFrame) else from_objects(self.spark, docs)

    def _stage(self, docs: DataFrame | Iterable[object]) -> tuple[str, DataFrame]:
        """A new segment's name, and ordinal, key, source, error, known (is stored) of a batch, written once."""
        name = f"segment-{uuid.uuid4().hex}"
        path = f"{self.folder}/{name}/batch"
        checked(self._raw(docs), self.policy).write.parquet(path)
        batch = self.spark.read.parquet(path)
        return name, batch.join(self.documents().select("key", F.lit(True).alias("known")), "key", "left").withColumn("known", F.coalesce("known", F.lit(False)))

    def _add(self, name: str, docs: DataFrame, ended: DataFrame | None) -> None:
        seq = 1 + max((s["seq"] for s in self.manifest["segments"]), default=0)
        segment = {"name": name, "seq": seq, "rows": 0, "ended": False}
        self._write_docs(docs.select("key", "source"), self._path(segment, "docs"))
        stored = self.spark.read.schema(DOCS).parquet(self._path(segment, "docs"))
        segment["rows"] = stored.count()
        if segment["rows"]:
            self._write_index(stored, self._path(segment, "index"))
            segment["totals"] = self._count(segment)
        if ended is not None:
            ended.select("key").distinct().write.parquet(self._path(segment, "ended"))
            segment["ended"] = bool(self.spark.read.schema("key string").parquet(self._path(segment, "ended")).limit(1).count())
        self._commit(segments=[*self.manifest["segments"], segment])

    @staticmethod
    def _write_docs(docs: DataFrame, path: str) -> None:
        docs.write.option("parquet.block.size", BLOCK).parquet(path)

    def _write_index(self, docs: DataFrame, path: str) -> None:
        conf, name = self.spark.conf, "spark.sql.files.maxPartitionBytes"
        before = conf.get(name)
        conf.set(name, f"{min(SPLIT, _bytes(before))}b")
        try:
            index_rows(docs, self.policy).sortWithinPartitions("kind", "field", "term", "key").write.partitionBy("kind", "field").parquet(path)
        finally:
            conf.set(name, before)

    def _count(self, segment: dict) -> dict[str, tuple[int, int]]:
        """Writes a segment's dictionary, sorted by term; documents and words of each of its fields."""
        index = self.spark.read.schema(INDEX_SCHEMA).parquet(self._path(segment, "index"))
        posts, nested = index.where("kind = 'post'"), [f.path for f in self.policy.leaves() if f.arrays]
        # outside arrays a document has one row for a term, so there is nothing to tell apart
        terms = posts.where(~F.col("field").isin(*nested)).groupBy("field", "term").agg(F.count("*").alias("rows")).withColumn("df", F.col("rows"))
        if nested:
            terms = terms.unionByName(posts.where(F.col("field").isin(*nested)).groupBy("field", "term").agg(F.count("*").alias("rows"), F.count_distinct("key").alias("df")))
        terms.repartitionByRange("field", "term").sortWithinPartitions("field", "term").write.parquet(self._path(segment, "terms"))
        totals = index.where("kind = 'len'").groupBy("field").agg(F.count("*").alias("n"), F.sum("len").alias("total"))
        return {r.field: (r.n, r.total) for r in totals.collect()}  # a row a field

    @staticmethod
    def _nth(batch: DataFrame, last: bool) -> DataFrame:
        return batch.withColumn("n", F.row_number().over(W.partitionBy("key", F.isnull("error")).orderBy(F.desc("ordinal") if last else F.asc("ordinal"))))

    @staticmethod
    def _failed(batch: DataFrame, condition, error: str) -> DataFrame:
        bad = batch.where("error IS NOT NULL").select("ordinal", "key", "error")
        return bad.unionByName(batch.where(F.col("error").isNull() & condition).select("ordinal", "key", F.lit(json.dumps({"error": error})).alias("error"))).orderBy("ordinal")

    def insert(self, docs: DataFrame | Iterable[object]) -> DataFrame:
        """Ids that are stored, or came before in the batch, fail."""
        name, batch = self._stage(docs)
        batch = self._nth(batch, last=False)
        twice = F.col("known") | (F.col("n") > 1)
        failures = self._keep(name, self._failed(batch, twice, "DuplicatePrimaryId"))
        self._add(name, batch.where(F.col("error").isNull() & ~twice), None)
        return failures

    def upsert(self, docs: DataFrame | Iterable[object]) -> DataFrame:
        """The last document of each id in the batch counts from now on."""
        name, batch = self._stage(docs)
        failures = self._keep(name, self._failed(batch, F.lit(False), ""))
        new = self._nth(batch, last=True).where("error IS NULL AND n = 1")
        self._add(name, new, new.where("known"))
        return failures

    def replace(self, docs: DataFrame | Iterable[object]) -> DataFrame:
        """As upsert, for ids that are stored; others fail."""
        name, batch = self._stage(docs)
        failures = self._keep(name, self._failed(batch, ~F.col("known"), "NotFound"))
        new = self._nth(batch, last=True).where("error IS NULL AND n = 1 AND known")
        self._add(name, new, new)
        return failures

    def partial_replace(self, patches: Iterable[dict]) -> DataFrame:
        """Merge patches by id, the id being part of each; several for one id apply in order."""
        path = self.policy.id_field.path
        given = self.spark.createDataFrame([(i, str(p.get(path) or ""), json.dumps(p, ensure_ascii=False)) for i, p in enumerate(patches)], "ordinal long, key string, patch string")
        many = given.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("ordinal", "patch"))).alias("patches"))  # patches come from the driver
        found = self.documents().join(F.broadcast(many), "key")

        def run(batches):
            for b in batches:
                made = []
                for source, todo in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    for p in todo:
                        source = patch_json(source, p["patch"])
                    made.append(source)
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], names=["source"])

        missing = given.join(self.documents().select("key"), "key", "left_anti").select("ordinal", "key", F.lit(json.dumps({"error": "NotFound"})).alias("error"))
        lost = missing.collect()
        failures = self.replace(found.select("source", "patches").mapInArrow(run, "source string"))
        return failures.unionByName(self.spark.createDataFrame(lost, "ordinal long, key string, error string"))

    def delete(self, ids: Iterable[str]) -> DataFrame:
        """Unknown ids fail, and all but the first of repeated ones."""
        given = self.spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "ordinal long, key string")
        marked = given.join(self.documents().select("key", F.lit(True).alias("known")), "key", "left").withColumns({"known": F.coalesce("known", F.lit(False)), "error": F.lit(None).cast("string")})
        marked = self._nth(marked, last=False)
        name = f"segment-{uuid.uuid4().hex}"
        failures = self._keep(name, self._failed(marked, ~F.col("known") | (F.col("n") > 1), "NotFound"))
        self._add(name, self.spark.createDataFrame([], DOCS), marked.where("known"))
        return failures

    def _keep(self, name: str, failures: DataFrame) -> DataFrame:
        """Failures are written with the segment: they would look different once it counts."""
        failures.write.parquet(f"{self.folder}/{name}/failed")
        return self.spark.read.schema("ordinal long, key string, error string").parquet(f"{self.folder}/{name}/failed")

    def compact(self, sort: bool = True) -> None:
        """All live rows in one segment; index rows range-sorted by term, so that scans skip row groups."""
        name = f"segment-{uuid.uuid4().hex}"
        seq = 1 + max((s["seq"] for s in self.manifest["segments"]), default=0)
        segment = {"name": name, "seq": seq, "rows": 0, "ended": False}
        self._write_docs(self.documents(), self._path(segment, "docs"))
        segment["rows"] = self.spark.read.parquet(self._path(segment, "docs")).count()
        if segment["rows"]:
            rows = self._live("index", INDEX_SCHEMA).drop("seq")
            rows = rows.repartitionByRange("kind", "field", "term", "key") if sort else rows
            rows.sortWithinPartitions("kind", "field", "term", "key").write.partitionBy("kind", "field").parquet(self._path(segment, "index"))
            segment["totals"] = self._count(segment)
        self._commit(segments=[segment])

    def reindex(self) -> None:
        """Analyzes all documents anew under the policy; readers keep the old version until it is done."""
        docs, kept = self.documents(), self.manifest["segments"]
        self.manifest = self.manifest | {"segments": []}
        try:
            self._add(f"segment-{uuid.uuid4().hex}", docs, None)
        except Exception:
            self.manifest = self.manifest | {"segments": kept}
            raise

    # Asking

    def retrieve(self, ids: list[str], return_fields: dict | None = None) -> DataFrame:
        """ordinal, key, document (null if not found), in the order asked for."""
        wanted = self.spark.createDataFrame(list(enumerate(ids)), "ordinal int, key string")
        found = self._projected(self.documents().join(F.broadcast(wanted.select("key").distinct()), "key", "left_semi"), return_fields)  # ids come from the driver
        return wanted.join(found.select("key", "document"), "key", "left").select("ordinal", "key", "document").orderBy("ordinal")

    def _projected(self, docs: DataFrame, return_fields: dict | None) -> DataFrame:
        hidden = {f.path for f in self.policy.leaves() if not f.listed}
        asked = return_fields or {}
        for path in asked:
            self.policy.find(path)
        if not hidden and not asked:
            return docs.withColumn("document", F.col("source"))
        some = any(asked.values())

        def shown(path: str) -> bool | None:
            """By the nearest path above that was named; None if only something below may show."""
            here = path
            while here:
                if here in asked:
                    return asked[here]
                here = here.rpartition("/")[0]
            if any(p.startswith(path + "/") and asked[p] for p in asked):
                return None
            return not some and path not in hidden

        def cut(value: object, path: str) -> object:
            if isinstance(value, list):
                return [cut(v, path) for v in value]
            if not isinstance(value, dict):
                return value
            out = {}
            for k, v in value.items():
                p = f"{path}/{k}" if path else k
                show = shown(p)
                if show is not False:
                    out[k] = cut(v, p)
            return out

        return _mapped(docs, "document", lambda source: json.dumps(cut(json.loads(source), ""), ensure_ascii=False))

    def keys(self, filters: dict | None = None) -> DataFrame:
        """key of every document that fits all filters; of every one without any."""
        found = filtered(self.tables, filters)
        return self.documents().select("key") if found is None else found

    def bounds(self, path: str) -> DataFrame:
        """lo and hi of a number, date (milliseconds) or boolean over all documents; null without values."""
        f = self.policy.find(path)
        if f.kind not in NUMERIC:
            raise PolicyError(f"{path} is no number")
        return limits(self.tables, f)

    def _tree(self, query: object, analyzer: Analyzer, wildcards: bool) -> Node | None:
        if isinstance(query, str) and (typed := self.dictionary.expand(query.split(), analyzer)):
            return analyzed(typed[0] if len(typed) == 1 else Node("WAND", children=tuple(typed)), analyzer)
        return analyzed(parse(query, "WAND", wildcards), analyzer)

    def _groups(self, request: dict) -> list[tuple[list, Node]]:
        """Searched fields with one analyzer each, and the query in its terms."""
        by: dict[Analyzer, list] = {}
        for f in self.policy.searched(request.get("search_fields")):
            by.setdefault(self.policy.analyzer_of(f), []).append(f)
        made = ((fields, self._tree(request["query"], a, request.get("wildcard_enabled", True))) for a, fields in by.items())
        return [(fields, node) for fields, node in made if node is not None]

    def search(self, request: dict) -> DataFrame:
        """rank, key, tier, score, document, and highlights (JSON by field) if asked for; a page in its order."""
        limit, offset = int(request.get("docs", 10)), int(request.get("offset", 0))
        if not 0 <= limit <= MAX_PAGE or offset < 0:
            raise PolicyError(f"docs is at most {MAX_PAGE}, offset 0 or more")
        allowed = filtered(self.tables, request.get("filters"))
        groups: list = []
        if blank(request.get("query")):
            found = self.documents().select("key", F.lit(2).alias("tier"), F.lit(0).alias("level"), F.lit(0.0).alias("score"))
        else:
            groups = self._groups(request)
            text = request["query"] if isinstance(request["query"], str) else ""
            order, mode = cascade(request.get("cascade")), request.get("match_mode", "crossfields")
            done = [ranked(self.tables, fields, node, mode, text, order) for fields, node in groups]
            # a typed word is in no field, or likely a typo: its corrections stand in
            if text and "fuzzy" in order and done and all(unknown for _, unknown in done):
                groups = [(fields, _fuzzy(node)) for fields, node in groups]
                done = [ranked(self.tables, fields, node, mode, text, order) for fields, node in groups]
            parts = [df for df, _ in done if df is not None]
            empty = self.spark.createDataFrame([], "key string, tier int, level int, score double")
            found = reduce(DataFrame.unionByName, parts) if parts else empty
            if len(parts) > 1:
                found = found.groupBy("key").agg(F.min(F.struct("tier", "level")).alias("t"), F.sum("score").alias("score")).select("key", "t.tier", "t.level", "score")
        if allowed is not None:
            found = found.join(allowed, "key", "left_semi")
        found, order = ordered(self.tables, found, request.get("sort"))
        page = found.orderBy(*order).offset(offset).limit(limit)
        page = page.withColumn("rank", F.row_number().over(W.orderBy(*order)) + offset)  # a page, at most MAX_PAGE rows
        page = self.documents().join(F.broadcast(page), "key")
        if request.get("highlight"):
            page = self._highlighted(page, request, groups)
        columns = ["rank", "key", "tier", "score", "document", *(["highlights"] if request.get("highlight") else [])]
        return self._projected(page, request.get("return_fields")).select(*columns).orderBy("rank")

    def _highlighted(self, page: DataFrame, request: dict, groups: list) -> DataFrame:
        asked: dict[str, dict] = request["highlight"]["fields"]
        texts = {f.path: f for fields, _ in groups for f in fields if f.kind == "text"}
        for path in asked:
            if path not in ("*", "$auto") and path not in texts:
                if self.policy.find(path).kind != "text":
                    raise PolicyError(f"cannot highlight '{path}': only text fields support highlighting")
                raise PolicyError(f"cannot highlight '{path}': it is not a searched field")
        rest = asked.get("$auto", asked.get("*"))
        plan = []
        for fields, node in groups:
            weights: dict[str, float] = {}
            phrases = []
            for leaf in (x for c in leaves(node) for x in (c.children if c.op == "synonym" else (c,))):
                words = [leaf.value] if leaf.op == "term" else [w for w, _ in leaf.steps]
                if leaf.op in ("prefix", "wildcard", "fuzzy"):
                    words = [r.term for r in self._terms(fields, leaf)]
                for w in words:
                    n = {(0, r.field): r.n for r in self.tables.of("post", fields).where(F.col("term") == w).groupBy("field").agg(F.count("*").alias("n")).collect()}
                    weights[w] = weight_of(self.tables, n, 0) or 1.0
                if leaf.op == "phrase":
                    phrases.append(leaf.steps)
            for f in fields:
                spec = asked.get(f.path, rest)
                if f.path in texts and spec is not None:
                    o = Options(**{k: tuple(v) if isinstance(v, list) else v for k, v in spec.items()})
                    plan.append((f, self.policy.analyzer_of(f), weights if not phrases or len(leaves(node)) > 1 else {}, phrases, o))
        explicit = list(asked)
        by_weight = "$auto" in asked

        def values(doc: object, names: list[str]) -> list[str]:
            if isinstance(doc, list):
                return [x for d in doc for x in values(d, names)]
            if not names:
                return [doc] if isinstance(doc, str) else []
            return values(doc.get(names[0]), names[1:]) if isinstance(doc, dict) else []

        def made(source: str) -> str:
            doc, out = json.loads(source), []
            for f, analyzer, weights, phrases, o in plan:
                pieces, top = [], 0.0
                for v in values(doc, f.path.split("/")):
                    places = spans(v, analyzer, weights, phrases)
                    top = max([top, *(w for *_, w in places)])
                    pieces += fragments(v, places, o)
                if pieces:
                    place = explicit.index(f.path) if f.path in explicit else len(explicit)
                    out.append(((place, -top if by_weight else 0.0, f.path), f.path, pieces[: o.number_of_fragments]))
            return json.dumps({path: pieces for _, path, pieces in sorted(out, key=lambda x: x[0])}, ensure_ascii=False)

        return _mapped(page, "highlights", made)

    def _terms(self, fields: list, leaf: Node) -> list:
        if leaf.op == "fuzzy":
            return operators.selected(operators.fuzzy_terms(self.tables.dictionary(fields), leaf.value), leaf.value).collect()
        condition = F.col("term").startswith(leaf.value) if leaf.op == "prefix" else F.col("term").rlike(wildcard_regex(leaf.value))
        return operators.pattern_terms(self.tables.dictionary(fields), condition).collect()

    def did_you_mean(self, text: str, search_fields: list[str] | None = None, size: int = 3) -> dict:
        """original, corrected, confident, and words: each corrected word with its suggestions, best first.

        A word in TRUSTED documents is right. An unknown word among known ones is what is found in most documents with all of
        these; any other correction is sure if no term as near is nearly as frequent.
        """
        fields = [f for f in self.policy.searched(search_fields) if f.kind == "text"]
        terms, made = self.tables.dictionary(fields), {}
        pieces = [(piece, next(iter(self.policy.default.query_tokens(piece)), None)) for piece in text.split()]
        near = {t.term: [r.asDict() for r in operators.fuzzy_terms(terms, t.term).collect()] for _, t in pieces if t}  # terms near a word
        context = sorted(w for w, found in near.items() if any(x["term"] == w for x in found))
        for w, found in near.items():
            if any(x["term"] == w and x["df"] >= operators.TRUSTED for x in found):
                continue
            best = best_of(found, w, max(size, operators.CONTEXT_TERMS))
            sure = bool(best) and best[0]["term"] != w and operators.confident(best[0], found)
            if best and context and w not in context:
                together = self._together([x["term"] for x in best], context, fields)
                best.sort(key=lambda x: (-together.get(x["term"], 0), x["edits"], -x["df"]))
                first, second = ([together.get(x["term"], 0) for x in best] + [0])[:2]
                sure = first >= operators.CONTEXT_DOMINANCE * second if first else sure
            if best and best[0]["term"] != w:
                made[w] = ([x["term"] for x in best[:size]], sure)
        changed = [(t.term, *made[t.term]) for _, t in pieces if t and t.term in made]
        words = [made[t.term][0][0] if t and t.term in made else piece for piece, t in pieces]
        return {"original": text, "corrected": " ".join(words) if changed else text, "confident": bool(changed) and all(sure for *_, sure in changed), "words": [{"word": w, "suggestions": some} for w, some, _ in changed]}

    def _together(self, terms: list[str], context: list[str], fields: list) -> dict[str, int]:
        """Documents that have a term and every word of the context, by term."""
        posts = self.tables.of("post", fields).select("key", "term")
        around = posts.where(F.col("term").isin(*context)).groupBy("key").agg(F.count_distinct("term").alias("n")).where(F.col("n") == len(context))
        found = posts.where(F.col("term").isin(*terms)).join(around, "key", "left_semi")
        return {r.term: r.n for r in found.groupBy("term").agg(F.count_distinct("key").alias("n")).collect()}

    def suggest(self, text: str, search_fields: list[str] | None = None) -> list[tuple[str, str]]:
        """(word, correction) of each word that did_you_mean corrects."""
        return [(x["word"], x["suggestions"][0]) for x in self.did_you_mean(text, search_fields)["words"]]

    def info_words(self, words: list[str], search_fields: list[str] | None = None) -> DataFrame:
        """word, occurrences, documents, by each field's analyzer."""
        parts = []
        for f in self.policy.searched(search_fields):
            for w in words:
                for token in self.policy.analyzer_of(f).query_tokens(w):
                    parts += [df.select(F.lit(w).alias("word"), "key", F.size("positions").alias("tf")) for df, *_ in forms(self.tables, [f], Node("term", token.term))]
        if not parts:
            return self.spark.createDataFrame([], "word string, occurrences long, documents long")
        return reduce(DataFrame.unionByName, parts).groupBy("word").agg(F.sum("tf").alias("occurrences"), F.countDistinct("key").alias("documents"))

    def all_fields(self) -> DataFrame:
        """path, kind, documents: declared fields, and paths found in documents that the policy doesn't name (none)."""

        def run(batches):
            for b in batches:
                out: list[str] = []
                for source in b.column(0).to_pylist():
                    found: set[str] = set()
                    todo: list[tuple[str, object]] = [("", json.loads(source))]
                    while todo:
                        path, v = todo.pop()
                        if isinstance(v, dict):
                            todo += [(f"{path}/{k}" if path else k, x) for k, x in v.items()]
                        elif isinstance(v, list) and any(isinstance(x, dict) for x in v):
                            todo += [(path, x) for x in v]
                        else:
                            found.add(path)
                    out += found
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["path"])

        seen = self.documents().select("source").mapInArrow(run, "path string").groupBy("path").agg(F.count("*").alias("documents"))
        declared = self.spark.createDataFrame([(f.path, f.kind) for f in self.policy.leaves()], "path string, kind string")
        return declared.join(seen, "path", "full_outer").select("path", F.coalesce("kind", F.lit("none")).alias("kind"), F.coalesce("documents", F.lit(0)).alias("documents"))

    def analyze(self, path: str, value: str) -> DataFrame:
        """term, pos, span, start, end of a value under a field's analyzer."""
        f = self.policy.find(path)
        if f.kind != "text":
            raise PolicyError(f"{path} is not text")
        return self.spark.createDataFrame([tuple(t) for t in self.policy.analyzer_of(f).tokens(value)], "term string, pos int, span int, start int, end int")

    def status(self) -> dict[str, int]:
        size = sum(f.size for s in self.manifest["segments"] for f in self.fs.get_file_info(fs.FileSelector(f"{self.root}/{s['name']}", recursive=True)) if f.is_file)
        return {"version": self.manifest["version"], "segments": len(self.manifest["segments"]), "documents": self.documents().count(), "terms": self._index("post").select("field", "term").distinct().count(), "bytes": size}


def _bytes(text: str) -> int:
    """A size as Spark's settings have it: 134217728b, 16m."""
    number, unit = re.fullmatch(r"(\d+)([kmgtp]?)b?", text.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def best_of(near: list[dict], word: str, limit: int) -> list[dict]:
    """As operators.selected, of rows at hand."""
    others = sorted((x for x in near if x["term"] != word), key=lambda x: (-x["rank_score"], x["term"]))
    kept = [x for x in near if x["term"] == word] + [x for x in others if x["rank_score"] >= others[0]["rank_score"] - MARGIN]
    return sorted(kept[:limit], key=lambda x: (-x["rank_score"], x["term"]))


def _fuzzy(node: Node) -> Node:
    if node.op == "term":
        return Node("fuzzy", node.value)
    return Node(node.op, node.value, tuple(map(_fuzzy, node.children)), node.steps, node.options, node.weights) if node.op in ("AND", "OR", "WAND") else node


def _mapped(df: DataFrame, column: str, fn) -> DataFrame:
    """df with a text column made from each row's source; the other columns pass through."""
    at = df.columns.index("source")

    def run(batches):
        for b in batches:
            made = pa.array([fn(x) for x in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, made], names=[*b.schema.names, column])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(column, T.StringType())]))
