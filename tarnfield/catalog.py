"""Queries registered for the engine's own operators, with SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import catalog_database
from .functions import text as A
from .operators import index, search, writes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return put


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def texts(spark: SparkSession, d: str) -> DataFrame:
    return index.analyzed(table(spark, d, "documents"), "doc_id", ["text"])


def parts(spark: SparkSession, d: str) -> DataFrame:
    return index.analyzed(table(spark, d, "part"), "p_partkey", ["p_name", "p_brand", "p_type"])


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


TOKENS = r"""tok AS (SELECT doc_id, 'text' AS field, unnest(x) AS term, generate_subscripts(x, 1) AS pos, len(x) AS dl FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS x FROM documents))"""
PART_TOKENS = " UNION ALL ".join(rf"SELECT p_partkey AS doc_id, '{f}' AS field, unnest(regexp_extract_all(lower({f}), '[\p{{L}}\p{{N}}]+')) AS term, len(regexp_extract_all(lower({f}), '[\p{{L}}\p{{N}}]+')) AS dl FROM part" for f in ("p_name", "p_brand", "p_type"))


def bm25_sql(words: list[str], tail: str, tokens: str = TOKENS, term: str = "term") -> str:
    """Common table expressions up to s (doc_id, field, term, idf, score), then tail."""
    where = " OR ".join(f"term = '{w}'" for w in words) if term == "term" else term
    name = "term" if term == "term" else "'*'"
    return f"""WITH {tokens},
dl AS (SELECT DISTINCT doc_id, field, dl FROM tok), st AS (SELECT field, count(*) AS n, sum(dl) AS total FROM dl GROUP BY field),
p AS (SELECT doc_id, field, {name} AS term, count(*) AS tf, any_value(dl) AS dl FROM tok WHERE {where} GROUP BY doc_id, field, 3),
df AS (SELECT field, term, count(*) AS df FROM p GROUP BY field, term),
s AS (SELECT doc_id, field, term, ln((n - df + 0.5) / (df + 0.5) + 1) AS idf, least(75, tf) * ln((n - df + 0.5) / (df + 0.5) + 1) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / (total / n)))) AS score FROM p JOIN df USING (field, term) JOIN st USING (field))
{tail}"""


WORDS = ["this", "and", "with"]


@query(bm25_sql(WORDS, "SELECT doc_id, round(sum(score), 6) AS score FROM s GROUP BY doc_id ORDER BY sum(score) DESC, doc_id LIMIT 10"))
def bm25_or_topk(spark, d):
    return rounded(search.match(texts(spark, d), WORDS).orderBy(F.desc("score"), "doc_id").limit(10).select("doc_id", "score"), "score")


@query(bm25_sql(WORDS, "SELECT doc_id, round(sum(score), 6) AS score, count(DISTINCT term) AS matched FROM s GROUP BY doc_id"))
def bm25_wand_all(spark, d):
    return rounded(search.match(texts(spark, d), WORDS), "score")


@query(bm25_sql(WORDS, "SELECT doc_id, round(sum(score), 6) AS score, count(DISTINCT term) AS matched FROM s GROUP BY doc_id HAVING count(DISTINCT term) = 3"))
def bm25_and(spark, d):
    return rounded(search.match(texts(spark, d), WORDS, "and"), "score")


@query(bm25_sql(WORDS, ", i AS (SELECT sum(idf) AS total FROM (SELECT DISTINCT term, idf FROM s)) SELECT doc_id, round(sum(score), 6) AS base, round(sum(idf) / any_value(total), 6) AS coverage, round(sum(score) * (sum(idf) / any_value(total)) * (sum(idf) / any_value(total)), 6) AS score FROM s, i GROUP BY doc_id"))
def coverage_score(spark, d):
    return rounded(search.coverage(texts(spark, d), WORDS), "base", "coverage", "score")


@query(bm25_sql(["red", "economy"], "SELECT doc_id, round(sum(score), 6) AS score, count(DISTINCT term) AS matched FROM s GROUP BY doc_id HAVING count(DISTINCT term) = 2", f"tok AS ({PART_TOKENS})"))
def cross_fields_and(spark, d):
    return rounded(search.match(parts(spark, d), ["red", "economy"], "and"), "score")


@query(bm25_sql(["red", "widget"], "SELECT doc_id, round(sum(x), 6) AS score, CAST(max(n) AS BIGINT) AS matched FROM (SELECT doc_id, field, sum(score) AS x, count(*) AS n FROM s GROUP BY doc_id, field HAVING count(*) = 2) GROUP BY doc_id", f"tok AS ({PART_TOKENS})"))
def best_fields_and(spark, d):
    return rounded(search.match(parts(spark, d), ["red", "widget"], "best"), "score")


@query(f"WITH {TOKENS} SELECT a.doc_id, CAST(count(*) AS BIGINT) AS places FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the' GROUP BY a.doc_id")
def phrase_two_words(spark, d):
    return search.phrase(texts(spark, d), ["of", "the"])


PATTERN = "term IN (SELECT term FROM (SELECT term, count(DISTINCT doc_id) AS n FROM tok WHERE {} GROUP BY term ORDER BY n DESC, term LIMIT 128))"


@query(bm25_sql([], "SELECT doc_id, round(sum(score), 6) AS score FROM s GROUP BY doc_id", term=PATTERN.format("starts_with(term, 'wi')")))
def prefix_top_terms(spark, d):
    return rounded(search.prefix(texts(spark, d), "wi"), "score")


@query(bm25_sql([], "SELECT doc_id, round(sum(score), 6) AS score FROM s GROUP BY doc_id", term=PATTERN.format("regexp_matches(term, '^th.[es].*$')")))
def wildcard_terms(spark, d):
    return rounded(search.wildcard(texts(spark, d), "th?[es]*"), "score")


SYN = {"this": 1.0, "that": 1.0, "these": 0.7}


@query(f"""WITH {TOKENS}, st AS (SELECT count(*) AS n, sum(dl) AS total FROM (SELECT DISTINCT doc_id, dl FROM tok)),
p AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM tok WHERE term IN ('this', 'that', 'these') GROUP BY doc_id, term),
o AS (SELECT term, count(*) AS own FROM p GROUP BY term), df AS (SELECT term, greatest(own, coalesce((SELECT own FROM o WHERE term = 'this'), 0)) AS df FROM o)
SELECT doc_id, round(max(CASE term WHEN 'these' THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END * least(75, tf) * ln((n - df + 0.5) / (df + 0.5) + 1) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / (total / n))))), 6) AS score FROM p JOIN df USING (term), st GROUP BY doc_id""")
def synonym_best_form(spark, d):
    return rounded(search.synonyms(texts(spark, d), SYN), "score")


@query(f"WITH {TOKENS} SELECT term, count(*) AS occurrences, count(DISTINCT doc_id) AS docs FROM tok WHERE term IN ('this', 'and', 'with') GROUP BY term")
def info_words(spark, d):
    return index.postings(texts(spark, d), WORDS).groupBy("term").agg(F.sum("tf").cast("bigint").alias("occurrences"), F.countDistinct("doc_id").alias("docs"))


@query(f"WITH {TOKENS} SELECT field, count(DISTINCT doc_id) AS doc_count, CAST(count(*) AS BIGINT) AS total_len FROM tok GROUP BY field")
def field_stats(spark, d):
    return index.stats(texts(spark, d))


@query(f"WITH {TOKENS} SELECT field, term, count(DISTINCT doc_id) AS df, CAST(count(*) AS BIGINT) AS occurrences FROM tok GROUP BY field, term")
def term_dictionary(spark, d):
    return index.terms(texts(spark, d))


@query(r"SELECT doc_id, array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), ' ') AS tokens FROM documents")
def analyze_standard(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(A.standard(F.col("text")), " ").alias("tokens"))


@query(r"SELECT doc_id, array_to_string(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> ''), ' ') AS tokens FROM documents")
def analyze_whitespace(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(A.whitespace(F.col("text")), " ").alias("tokens"))


@query("SELECT p_partkey, lower(p_name) AS token FROM part")
def analyze_keyword(spark, d):
    return table(spark, d, "part").select("p_partkey", F.explode(A.keyword(F.col("p_name"))).alias("token"))


@query(r"SELECT doc_id, len(list_filter(list_filter(x, lambda t: NOT t IN ('the', 'of', 'de')), lambda t: length(t) <= 12 AND (length(t) >= 3 OR regexp_matches(t, '^[0-9]+$')))) AS n FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS x FROM documents)")
def token_filters(spark, d):
    tokens = A.length_filter(A.stop_filter(A.standard(F.col("text")), ["the", "of", "de"]), 3, 12)
    return table(spark, d, "documents").select("doc_id", F.size(tokens).cast("bigint").alias("n"))


@query("SELECT page_id, regexp_replace(regexp_replace(html, '<[^>]*>', '  ', 'g'), '(?s)<[^>]*$', ' ') AS plain FROM pages")
def html_strip_pages(spark, d):
    return table(spark, d, "pages").select("page_id", A.html_strip(F.col("html")).alias("plain"))


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(text, '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '[#*_`~>]', '', 'g'), ' ') AS plain FROM documents")
def markdown_strip_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", A.markdown_strip(F.col("text")).alias("plain"))


@query(bm25_sql(WORDS, ", h AS (SELECT doc_id, sum(score) AS score FROM s GROUP BY doc_id), g AS (SELECT doc_id, score, ln(1 + n_chars) AS v FROM h JOIN documents USING (doc_id)), b AS (SELECT min(v) AS lo, max(v) AS hi, max(score) AS top FROM g) SELECT doc_id, round((1 + score / top) / 2 * 60 + coalesce((v - lo) / (hi - lo), 0) * 40, 6) AS rank FROM g, b"))
def blend_sort_log1p(spark, d):
    lengths = table(spark, d, "documents").select("doc_id", F.log1p("n_chars").alias("v"))
    return rounded(search.blend(search.match(texts(spark, d), WORDS).join(lengths, "doc_id"), "v"), "rank")


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 40 AND l_returnflag = 'R')")
def same_element_order_lines(spark, d):
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_quantity", "l_returnflag")).alias("lines"))  # an order has a few lines
    nested = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return nested.where(search.same_element("lines", lambda e: (e.l_quantity > 40) & (e.l_returnflag == "R"))).select("o_orderkey")


DOT = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE))"
NORM = "sqrt(list_sum(list_transform({0}.embedding, lambda x: x::DOUBLE * x::DOUBLE)))"
COSINE = f"{DOT} / ({NORM.format('a')} * {NORM.format('b')})"


def _vector(spark, d):
    return table(spark, d, "embeddings").orderBy("vec_id").first()["embedding"]


@query(f"SELECT a.vec_id, round({COSINE}, 6) AS cosine FROM embeddings a, (SELECT * FROM embeddings ORDER BY vec_id LIMIT 1) b ORDER BY {COSINE} DESC, a.vec_id LIMIT 20")
def knn_exact(spark, d):
    return rounded(search.nearest(table(spark, d, "embeddings"), "vec_id", "embedding", _vector(spark, d), 20), "cosine")


@query(f"SELECT a.vec_id, round({COSINE}, 6) AS cosine FROM embeddings a, (SELECT * FROM embeddings ORDER BY vec_id LIMIT 1) b WHERE a.label = 1 ORDER BY {COSINE} DESC, a.vec_id LIMIT 20")
def knn_filtered_label(spark, d):
    return rounded(search.nearest(table(spark, d, "embeddings").where("label = 1"), "vec_id", "embedding", _vector(spark, d), 20), "cosine")


@query("""WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM documents QUALIFY r <= 100), b AS (SELECT doc_id, row_number() OVER (ORDER BY -n_chars % 97 DESC, doc_id) AS r FROM documents QUALIFY r <= 100),
u AS (SELECT doc_id, sum(1.0::DOUBLE / (10 + r)) AS part FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY doc_id) SELECT doc_id, round(part / (SELECT max(part) FROM u), 6) AS score FROM u""")
def rrf_fuse(spark, d):
    docs = table(spark, d, "documents")
    lists = [docs.select("doc_id", F.col("n_chars").alias("score")), docs.select("doc_id", (-F.col("n_chars") % 97).alias("score"))]
    return rounded(search.fuse(lists), "score")


def _events(spark, d):
    return table(spark, d, "events").select("user_id", "event_id", "event_type", "value")


@query("SELECT CAST(i.id AS BIGINT) AS p_partkey, i.ord, p_name, p_name IS NOT NULL AS found FROM (VALUES (5, 0), (-1, 1), (3, 2), (5, 3)) i(id, ord) LEFT JOIN part ON p_partkey = i.id")
def lookup_not_found(spark, d):
    ids = spark.createDataFrame([(5, 0), (-1, 1), (3, 2), (5, 3)], "p_partkey long, ord int")
    return writes.retrieve(table(spark, d, "part").select("p_partkey", "p_name"), ids, "p_partkey", "ord")


STORED = "FROM events WHERE event_type = 'view' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1"
BATCH = "FROM events WHERE event_type <> 'view' AND value > 20"


def _stored(spark, d):
    """The last view of each user; the other events, a batch, clash with it."""
    newest = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("event_id")))
    return _events(spark, d).where("event_type = 'view'").withColumn("n", newest).where("n = 1").drop("n")


def _batch(spark, d):
    return _events(spark, d).where("event_type <> 'view' AND value > 20")


@query(f"WITH s AS (SELECT user_id, event_id, event_type, value {STORED}), b AS (SELECT user_id, event_id, event_type, value {BATCH} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) SELECT * FROM b UNION ALL SELECT * FROM s WHERE user_id NOT IN (SELECT user_id FROM b)")
def upsert_latest_wins(spark, d):
    return writes.upsert(_stored(spark, d), _batch(spark, d), "user_id", "event_id")


@query(f"WITH s AS (SELECT user_id {STORED}), b AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n {BATCH}) SELECT user_id, event_id FROM b WHERE n > 1 OR user_id IN (SELECT user_id FROM s)")
def insert_duplicate_failures(spark, d):
    return writes.insert(_stored(spark, d), _batch(spark, d), "user_id", "event_id")[1]


DEAR = "SELECT o_custkey AS c_custkey FROM orders WHERE o_totalprice > 400000"


def _dear(spark, d):
    return table(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))


@query(f"SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN ({DEAR})")
def delete_left(spark, d):
    return writes.delete(table(spark, d, "customer").select("c_custkey", "c_name"), _dear(spark, d), "c_custkey")[0]


@query(f"SELECT c_custkey FROM ({DEAR}) GROUP BY c_custkey HAVING count(*) > 1 OR c_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20)")
def delete_failures(spark, d):
    return writes.delete(table(spark, d, "customer").where("c_nationkey < 20").select("c_custkey", "c_name"), _dear(spark, d), "c_custkey")[1]


def _replaced(spark, d):
    stored = table(spark, d, "customer").where("c_nationkey < 12").select("c_custkey", F.lit(-1).cast("bigint").alias("o_orderkey"), F.lit(0.0).alias("o_totalprice"))
    batch = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    return writes.replace(stored, batch, "c_custkey", "o_orderkey")


@query("SELECT c_custkey, coalesce(o_orderkey, -1) AS o_orderkey, coalesce(o_totalprice, 0) AS o_totalprice FROM customer LEFT JOIN (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1) ON o_custkey = c_custkey WHERE c_nationkey < 12")
def replace_stored(spark, d):
    return _replaced(spark, d)[0]


@query("SELECT DISTINCT o_custkey AS c_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12)")
def replace_not_found(spark, d):
    return _replaced(spark, d)[1]


@query("SELECT event_id, CASE WHEN event_type <> 'view' THEN CAST(json_extract(props, '$.k') AS BIGINT) ELSE -1 END AS k, CASE WHEN event_type = 'view' THEN 'patch' ELSE '' END AS by FROM events")
def partial_replace_props(spark, d):
    e = table(spark, d, "events")
    patches = e.where("event_type = 'view'").select("event_id", F.lit('{"k": null, "seen": {"by": "patch"}}').alias("patch"))
    out = writes.patch(e.select("event_id", "props"), patches, "event_id", "props")
    return out.select("event_id", F.coalesce(F.get_json_object("props", "$.k").cast("bigint"), F.lit(-1)).alias("k"), F.coalesce(F.get_json_object("props", "$.seen.by"), F.lit("")).alias("by"))


@query(f"WITH {TOKENS} SELECT term, count(DISTINCT doc_id) AS df, CAST(damerau_levenshtein(term, 'with') AS INT) AS edits FROM tok WHERE damerau_levenshtein(term, 'with') <= 1 GROUP BY term")
def fuzzy_terms(spark, d):
    return search.fuzzy_terms(index.terms(texts(spark, d)), "with").select("term", "df", "edits")


@query()
def fuzzy_ranked(spark, d):
    return rounded(search.selected(search.fuzzy_terms(index.terms(texts(spark, d)), "wiht"), "wiht"), "distance", "rank_score")


@query()
def did_you_mean(spark, d):
    return rounded(search.did_you_mean(index.terms(texts(spark, d)), "wiht"), "distance", "rank_score")


@query()
def proximity_density(spark, d):
    return rounded(search.density(texts(spark, d), WORDS), "density")


catalog_database.register(query, table, texts, parts, rounded, bm25_sql, TOKENS, PART_TOKENS)
