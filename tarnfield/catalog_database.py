"""Queries that run through a database: tables become JSON documents under a policy, indexed and searched."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .database import Database
from .operators import index, search

_made: list[str] = []


@atexit.register
def _clean() -> None:
    for path in _made:
        shutil.rmtree(path, ignore_errors=True)


def _folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share; one of our own in local mode only."""
    sc = spark.sparkContext
    shared = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not shared:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _made.append(shared := tempfile.mkdtemp(prefix="tarnfield-"))
    return f"{shared.rstrip('/')}/database-{uuid.uuid4().hex}"


def _stored(spark: SparkSession, policy: dict, rows: DataFrame) -> Database:
    db = Database.create(spark, _folder(spark), policy)
    db.insert(rows.select(F.to_json(F.struct("*")).alias("source")))
    return db


_kept: dict[tuple[str, str, str], Database] = {}


def kept(spark: SparkSession, d: str, name: str, policy: dict, rows: Callable[[], DataFrame]) -> Database:
    """A database of a table's rows, built once in an application and searched by all its queries."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _kept:
        _kept[key] = _stored(spark, policy, rows())
    return _kept[key]


def register(query, table, texts, parts, rounded, bm25_sql, tokens: str, part_tokens: str) -> None:
    """Adds this module's queries to the catalog, whose helpers it is given."""

    @query(bm25_sql(["with"], "SELECT CAST(doc_id AS VARCHAR) AS key, round(sum(score), 6) AS score FROM s GROUP BY doc_id ORDER BY round(sum(score), 9) DESC, CAST(doc_id AS VARCHAR) LIMIT 10"))
    def database_search_top10(spark, d):
        db = writings(spark, d)
        return rounded(db.search({"query": "with", "search_fields": ["text"]}).select("key", "score"), "score")

    @query("SELECT CAST(o_orderkey AS VARCHAR) AS key FROM orders WHERE o_totalprice >= 1000 AND o_totalprice <= 90000 AND lower(trim(o_orderpriority)) = '1-urgent' ORDER BY o_totalprice DESC, CAST(o_orderkey AS VARCHAR) LIMIT 100")
    def database_filters_orders(spark, d):
        db = orders(spark, d)
        request = {"filters": {"price": "1000..90000", "priority": {"exact": "1-URGENT"}}, "sort": {"mode": "strict", "price": {"order": "desc"}}, "docs": 100}
        return db.search(request).select("key")

    @query("SELECT CAST(conv_id AS VARCHAR) AS key FROM conversations WHERE role = 'assistant' AND turn >= 2 GROUP BY conv_id ORDER BY CAST(conv_id AS VARCHAR) LIMIT 500")
    def database_same_element(spark, d):
        policy = {"document": {"id": "id", "turns": [{"turn": "int", "role": {"$type": "text", "$exact": True}}]}}
        turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role")).alias("turns"))  # a document each, as long as its conversation
        db = _stored(spark, policy, turns.select(F.col("conv_id").cast("string").alias("id"), "turns"))
        return db.search({"filters": {"turns": {"same_element": {"role": {"exact": "assistant"}, "turn": ">=2"}}}, "docs": 500}).select("key")

    words = ["this", "and", "with"]

    @query(bm25_sql(words, "SELECT doc_id, round(sum(score), 6) AS score, count(DISTINCT term) AS matched FROM s GROUP BY doc_id").replace("least(75, tf)", "least(90, tf + 9)"))
    def bm25_weighted(spark, d):
        return rounded(search.match(texts(spark, d), words, bounds=(10, 90)), "score")

    @query(bm25_sql(["red", "economy"], "SELECT doc_id, round(sum(top), 6) AS score FROM (SELECT doc_id, field, max(score) AS top FROM s GROUP BY doc_id, field) GROUP BY doc_id", f"tok AS ({part_tokens})"))
    def best_per_field(spark, d):
        hits = index.scored(index.postings(parts(spark, d), ["red", "economy"]), index.stats(parts(spark, d)))
        top = hits.groupBy("doc_id", "field").agg(F.max("score").alias("top"))
        return rounded(top.groupBy("doc_id").agg(F.sum("top").alias("score")), "score")

    @query(f"WITH {tokens} SELECT term, count(DISTINCT doc_id) AS df FROM tok WHERE starts_with(term, 'wi') GROUP BY term ORDER BY df DESC, term LIMIT 128")
    def prefix_dictionary(spark, d):
        return search.pattern_terms(index.terms(texts(spark, d)), F.col("term").startswith("wi")).select("term", "df")

    def orders(spark, d):
        policy = {"document": {"id": "id", "price": "float", "customer": "int", "day": "date", "priority": {"$type": "text", "$exact": True}}}
        return kept(spark, d, "orders", policy, lambda: table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_totalprice").alias("price"), F.col("o_custkey").alias("customer"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.col("o_orderpriority").alias("priority")))

    def products(spark, d):
        policy = {"analyzers": {"$default": {"tokenizer": "standard"}, "whole": {"tokenizer": "keyword"}}, "document": {"id": "id", "name": "text", "brand": {"$type": "text", "$analyzer": "whole"}, "kind": "text"}}
        return kept(spark, d, "part", policy, lambda: table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("kind")))

    def customers(spark, d):
        policy = {"document": {"id": "id", "name": {"$type": "text", "$exact": True}, "nation": "int", "balance": "float", "segment": {"$type": "text", "$list": False}}}
        return kept(spark, d, "customer", policy, lambda: table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")))

    def events(spark, d):
        policy = {"document": {"id": "id", "user": "int", "type": {"$type": "text", "$exact": True}, "props": {"k": "int"}}}
        return kept(spark, d, "events", policy, lambda: table(spark, d, "events").select(F.col("event_id").cast("string").alias("id"), F.col("user_id").alias("user"), F.col("event_type").alias("type"), F.from_json("props", "k bigint").alias("props"), F.when(F.col("value") > 50, F.col("value")).alias("high")))

    def writings(spark, d):
        policy = {"analyzers": {"$default": {"tokenizer": "standard", "max_length": 1_000_000}}, "document": {"id": "id", "text": "text", "lang": {"$type": "text", "$exact": True}, "size": "int"}}
        return kept(spark, d, "documents", policy, lambda: table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "text", "lang", F.col("n_chars").alias("size")))

    @query("SELECT CAST(o_orderkey AS VARCHAR) AS key FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000 AND o_custkey >= 100")
    def filter_range_orders(spark, d):
        return orders(spark, d).keys({"price": "1000..50000", "customer": ">=100"})

    @query("SELECT CAST(o_orderkey AS VARCHAR) AS key FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'")
    def filter_date_orders(spark, d):
        return orders(spark, d).keys({"day": "1996-01-01..1996-12-31"})

    @query(r"SELECT CAST(p_partkey AS VARCHAR) AS key FROM part WHERE regexp_matches(lower(p_name), '(^|[^\p{L}\p{N}])re')")
    def filter_prefix_part(spark, d):
        return products(spark, d).keys({"name": "re*"})

    @query("SELECT CAST(p_partkey AS VARCHAR) AS key FROM part WHERE regexp_matches(lower(p_brand), '^br.nd#[1-5]')")
    def filter_wildcard_part(spark, d):
        return products(spark, d).keys({"brand": "br?nd#[1-5]*"})

    @query(r"SELECT CAST(p_partkey AS VARCHAR) AS key FROM part WHERE len(list_intersect(regexp_extract_all(lower(p_name), '[\p{L}\p{N}]+'), ['red', 'small'])) > 0 AND list_contains(regexp_extract_all(lower(p_type), '[\p{L}\p{N}]+'), 'economy')")
    def filter_tree_part(spark, d):
        return products(spark, d).keys({"name": {"OR": "red small"}, "kind": {"term": "economy"}})

    @query("SELECT CAST(c_custkey AS VARCHAR) AS key FROM customer WHERE lower(trim(c_name)) = 'customer#000000007'")
    def exact_match_customer(spark, d):
        return customers(spark, d).keys({"name": {"exact": " CUSTOMER#000000007"}})

    @query("SELECT CAST(doc_id AS VARCHAR) AS key FROM labels WHERE toxic = 1 AND quality = 1")
    def filter_bool_labels(spark, d):
        rows = lambda: table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("id"), (F.col("toxic") == 1).alias("toxic"), (F.col("quality") == 1).alias("good"))
        return kept(spark, d, "labels", {"document": {"id": "id", "toxic": "bool", "good": "bool"}}, rows).keys({"toxic": True, "good": True})

    @query("SELECT CAST(event_id AS VARCHAR) AS key FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) BETWEEN 10 AND 20")
    def filter_json_path(spark, d):
        return events(spark, d).keys({"props/k": "10..20"})

    @query("SELECT CAST(c_custkey AS VARCHAR) AS key FROM customer WHERE c_nationkey BETWEEN 3 AND 9 AND c_acctbal > 5000")
    def filter_semi_join(spark, d):
        return customers(spark, d).keys({"nation": "3..9", "balance": ">5000"})

    @query("SELECT CAST(doc_id AS VARCHAR) AS key, 0.0::DOUBLE AS score, CAST(row_number() OVER (ORDER BY CAST(doc_id AS VARCHAR)) AS INT) AS rank FROM documents ORDER BY 1 LIMIT 10")
    def match_all_first10(spark, d):
        return writings(spark, d).search({}).select("key", "score", "rank")

    @query("SELECT CAST(c_custkey AS VARCHAR) AS key, CAST(row_number() OVER (ORDER BY c_nationkey, c_acctbal DESC, CAST(c_custkey AS VARCHAR)) AS INT) AS rank FROM customer ORDER BY rank LIMIT 50")
    def strict_sort_two_fields(spark, d):
        return customers(spark, d).search({"docs": 50, "sort": {"mode": "strict", "nation": {"order": "asc"}, "balance": {"order": "desc"}}}).select("key", "rank")

    @query("SELECT CAST(c_custkey AS VARCHAR) AS key FROM customer ORDER BY c_acctbal DESC, CAST(c_custkey AS VARCHAR) LIMIT 20 OFFSET 40")
    def offset_page(spark, d):
        return customers(spark, d).search({"docs": 20, "offset": 40, "sort": {"mode": "strict", "balance": {"order": "desc"}}}).select("key")

    @query("SELECT CAST(c_custkey AS VARCHAR) AS key, CAST(c_nationkey AS VARCHAR) AS nation, 1 AS fields FROM customer ORDER BY 1 LIMIT 1000")
    def return_fields_projection(spark, d):
        page = customers(spark, d).search({"docs": 1000, "return_fields": {"nation": True}})
        return page.select("key", F.get_json_object("document", "$.nation").alias("nation"), F.size(F.json_object_keys("document")).alias("fields"))

    @query("SELECT CAST(c_custkey AS VARCHAR) AS key, 4 AS fields FROM customer ORDER BY 1 LIMIT 1000")
    def hidden_fields_projection(spark, d):
        return customers(spark, d).search({"docs": 1000}).select("key", F.size(F.json_object_keys("document")).alias("fields"))

    @query("SELECT min(o_totalprice)::DOUBLE AS lo, max(o_totalprice)::DOUBLE AS hi FROM orders")
    def numeric_bounds(spark, d):
        return orders(spark, d).bounds("price")

    @query("SELECT * FROM (VALUES ('id', 'id', (SELECT count(*) FROM events)), ('user', 'int', (SELECT count(user_id) FROM events)), ('type', 'text', (SELECT count(event_type) FROM events)), ('props/k', 'int', (SELECT count(*) FROM events WHERE json_extract(props, '$.k') IS NOT NULL)), ('high', 'none', (SELECT count(*) FROM events WHERE value > 50))) v(path, kind, documents)")
    def all_fields_events(spark, d):
        return events(spark, d).all_fields()

    @query(f"WITH {tokens} SELECT term AS word, CAST(count(*) AS BIGINT) AS occurrences, count(DISTINCT doc_id) AS documents FROM tok WHERE term IN ('this', 'with') GROUP BY term")
    def database_info_words(spark, d):
        return writings(spark, d).info_words(["this", "with"], ["text"])

    @query(f"WITH {tokens} SELECT CAST(a.doc_id AS VARCHAR) AS key FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the' GROUP BY a.doc_id")
    def database_phrase(spark, d):
        return writings(spark, d).keys({"text": {"phrase": "of the"}})

    @query("WITH s AS (SELECT user_id AS id, event_id, event_type FROM events WHERE event_type = 'view' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1), u AS (SELECT user_id AS id, event_id, event_type FROM events WHERE event_type = 'click' AND value > 60 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1), gone AS (SELECT user_id AS id FROM events WHERE event_type = 'error' AND value > 90) SELECT CAST(coalesce(u.id, s.id) AS VARCHAR) AS key, coalesce(u.event_id, s.event_id) AS event, coalesce(u.event_type, s.event_type) AS type FROM s FULL JOIN u ON s.id = u.id WHERE coalesce(u.id, s.id) NOT IN (SELECT id FROM gone)")
    def database_insert_upsert_delete(spark, d):
        """Views are inserted (the first of a user counts), clicks replace them (the last counts), users with errors go."""
        e = table(spark, d, "events")
        made = lambda df: df.orderBy("event_id").coalesce(1).select(F.to_json(F.struct(F.col("user_id").cast("string").alias("id"), F.col("event_id").alias("event"), F.col("event_type").alias("type"))).alias("source"))
        db = Database.create(spark, _folder(spark), {"document": {"id": "id", "event": "int", "type": "text"}})
        db.insert(made(e.where("event_type = 'view'")))
        db.upsert(made(e.where("event_type = 'click' AND value > 60")))
        db.delete([str(r.user_id) for r in e.where("event_type = 'error' AND value > 90").select("user_id").distinct().collect()])
        db.compact()
        return db.documents().select("key", F.get_json_object("source", "$.event").cast("bigint").alias("event"), F.get_json_object("source", "$.type").alias("type"))
