"""Quality rules, line first: lines that break a rule go, then documents that lose too much text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import DOCUMENTS, WS, WS_CHARS, trimmed

SYMBOLS = "#*$%&|<>"
BOILERPLATE = ("all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "enable javascript", "lorem ipsum", "skip to content", "subscribe to our newsletter")
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MAX_LOST_PERCENT = 50


def _count(line: Column, chars: str) -> Column:
    return F.length(line) - F.length(F.translate(line, chars, ""))


def _times(line: Column, piece: str) -> Column:
    return (F.length(line) - F.length(F.replace(line, F.lit(piece), F.lit("")))) / len(piece)


def _any(text: Column, pieces: tuple[str, ...] | list[str] | str) -> Column:
    out = text.contains(pieces[0])
    for x in pieces[1:]:
        out = out | text.contains(x)
    return out


def gates(text: Column) -> list[Column]:
    """Whether each rule can fail a line at all; asked once a text, so that most texts skip most rules."""
    return [text.contains("!! "), text.contains("|"), _any(F.lower(text), BOILERPLATE)]


def line_fails(line: Column, symbols: Column, shouts: Column, barred: Column, boilerplate: Column) -> Column:
    """A line breaks the punctuation rules (a tenth of it symbols; a third of its blanks after '!!'; under four words
    and no closing mark), the navigation rule (three bars or more, one to every four blanks) or has a boilerplate phrase.
    The other arguments say whether the text has anything that the rule is about."""
    bare = trimmed(line)
    out = bare.rlike("^[^ ]*(?: [^ ]*){0,2}$") & ~bare.rlike("[\\p{L}\\p{N}][.!?:;,…\"')\\]»”]+$")
    out = out | (symbols & (_count(line, SYMBOLS.replace("|", "")) * 10 > F.length(line)))
    out = out | (shouts & (_times(line, "!! ") >= 3) & (_times(line, "!! ") * 3 > _times(line, " ")))
    out = out | (barred & (_times(line, "|") >= 3) & (_times(line, "|") * 4 > _times(line, " ")))
    return out | (boilerplate & _any(F.lower(line), BOILERPLATE))


def quality(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: doc_id, the counts, base_failed, kept, then lines, lines_removed, lost_percent and
    clean_text (the text without failing lines; null if text is null), and the columns named in keep.

    Null, empty and blank texts have no words: all counts 0, base_failed. Repeated rows are judged each by itself; an empty
    table gives none. Columns beside doc_id, text and keep are not read. Windows are compared by 64-bit hash within a
    text: two different windows of a text of n words are taken as equal with a chance of n²/2^65.
    """
    carried = [F.col(c).alias(f"_k_{i}") for i, c in enumerate(keep)]
    odd = _any(F.col("_trim"), ["\t", "\x0b", "\x0c", "\r", "  ", "\n\n", " \n", "\n "])
    words = F.when(odd, F.split("_trim", f"[{WS}]+")).otherwise(F.split(F.replace("_trim", F.lit("\n"), F.lit(" ")), " "))
    df = docs.select("doc_id", F.col("text").alias("_raw"), F.coalesce("text", F.lit("")).alias("_text"), *carried)
    df = df.withColumn("_trim", F.btrim("_text", F.lit(WS_CHARS)))
    df = df.withColumn("_words", F.when(F.col("_trim") == "", F.array().cast("array<string>")).otherwise(words))
    df = df.withColumn("_lines", F.split("_text", "\n", -1))
    df = df.withColumn("n_words", F.size("_words").cast("bigint")).withColumn("word_chars", F.length(F.array_join("_words", "")).cast("bigint"))
    # A window found twice holds five runs of four words found before; texts without them need no windows.
    df = df.withColumn("_two", F.expr("zip_with(_words, slice(_words, 2, greatest(size(_words), 1)), (x, y) -> xxhash64(x, y))"))
    df = df.withColumn("_four", F.expr("zip_with(_two, slice(_two, 3, greatest(size(_two), 1)), (x, y) -> x ^ shiftleft(y, 1))")).drop("_two")
    df = df.withColumn("_again", F.expr("size(_four) - size(array_distinct(_four)) >= 5")).drop("_four")
    hashes = f"CASE WHEN _again AND n_words >= {WINDOW} THEN transform(sequence(1, CAST(n_words AS int) - {WINDOW - 1}), i -> xxhash64(slice(_words, i, {WINDOW}))) END"
    df = df.withColumn("_h", F.expr(hashes)).drop("_words", "_trim")
    pairs = F.expr("CASE WHEN size(array_distinct(_h)) < size(_h) THEN array_sort(transform(_h, (x, i) -> struct(x AS h, i AS i))) END")
    df = df.withColumn("_s", pairs).drop("_h")
    df = df.withColumn("_p", F.expr("array_sort(filter(transform(_s, (e, j) -> CASE WHEN e.h = get(_s, j - 1).h OR e.h = get(_s, j + 1).h THEN e.i END), x -> x IS NOT NULL))")).drop("_s")
    covered = F.expr(f"coalesce(aggregate(_p, struct(0 AS n, -{WINDOW} AS last), (a, x) -> struct(a.n + least({WINDOW}, x - a.last) AS n, x AS last), a -> a.n), 0)")
    df = df.withColumn("n_repeat_words", covered.cast("bigint")).drop("_p")
    df = df.withColumn("n_symbols", F.when(_any(F.col("_text"), SYMBOLS), F.regexp_count("_text", F.lit(f"[{SYMBOLS}]"))).otherwise(0).cast("bigint"))
    df = df.withColumns({f"_g{i}": g for i, g in enumerate([F.col("n_symbols") > 0, *gates(F.col("_text"))])})
    fails = lambda x: line_fails(x, *(F.col(f"_g{i}") for i in range(4)))
    df = df.withColumn("_full", F.filter("_lines", lambda x: x.rlike(f"[^{WS}]")))
    df = df.withColumn("_good", F.filter("_full", lambda x: ~fails(x)))
    df = df.withColumn("n_dup_lines", (F.size("_full") - F.size(F.array_distinct("_full"))).cast("bigint"))
    df = df.withColumn("_all", F.length(F.array_join("_full", ""))).withColumn("_left", F.length(F.array_join("_good", "")))
    df = df.withColumn("lines", F.size("_full").cast("bigint")).withColumn("lines_removed", (F.size("_full") - F.size("_good")).cast("bigint"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    lost = F.col("_all") - F.col("_left")
    clean = F.when(F.col("lines_removed") == 0, F.col("_raw")).otherwise(F.array_join(F.filter("_lines", lambda x: ~x.rlike(f"[^{WS}]") | ~fails(x)), "\n"))
    out = [
        F.col("doc_id"), *map(F.col, ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), failed.alias("base_failed"),
        (~failed & (100 * lost <= MAX_LOST_PERCENT * F.col("_all"))).alias("kept"), F.col("lines"), F.col("lines_removed"),
        F.when(F.col("_all") == 0, F.lit(0)).otherwise(F.floor(100 * lost / F.col("_all"))).cast("bigint").alias("lost_percent"),
        clean.alias("clean_text"), *(F.col(f"_k_{i}").alias(c) for i, c in enumerate(keep)),
    ]
    # A generator, as a filter on the result would else be pushed through all these projections, doubling at each.
    return df.select(F.inline(F.array(F.struct(*out))))


def digest(docs: DataFrame) -> DataFrame:
    return quality(docs).drop("clean_text")


def stage(docs: DataFrame) -> DataFrame:
    """The documents kept, without their failing lines; n_chars follows the text.

    Null, empty and blank texts have too few words and go. Rows without doc_id, lang or source are judged by their text;
    repeated rows one by one. An empty table gives none; columns beside those of documents are dropped.
    """
    df = quality(docs, keep=("lang", "source")).where("kept")
    return df.select("doc_id", F.col("clean_text").alias("text"), "lang", "source", F.length("clean_text").cast("bigint").alias("n_chars")).select(*DOCUMENTS)


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^{WS}]+') AS ws FROM d),
g AS (SELECT r, len(ws) AS n, list_sum([length(x) for x in ws]) AS c, [array_to_string(ws[i:i+{WINDOW - 1}], ' ') for i in range(1, len(ws) - {WINDOW - 2})] AS g FROM w),
e AS (SELECT r, unnest(g) AS k, generate_subscripts(g, 1) AS i FROM g),
p AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS m FROM e) WHERE m > 1),
q AS (SELECT r, sum(least({WINDOW}, i - prev)) AS rep FROM (SELECT r, i, coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), i - {WINDOW}) AS prev FROM p) GROUP BY r),
l AS (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d),
m AS (SELECT r, x, length(x) - length(replace(x, ' ', '')) AS blanks, (length(x) - length(replace(x, '!! ', ''))) / 3 AS shout, length(x) - length(replace(x, '|', '')) AS bars, trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM l WHERE regexp_matches(x, '[^{WS}]')),
f AS (SELECT r, x, (length(x) - length(regexp_replace(x, '[#*$%&<>]', '', 'g'))) * 10 > length(x)
    OR (shout >= 3 AND shout * 3 > blanks) OR (length(bare) - length(replace(bare, ' ', '')) < 3 AND NOT regexp_matches(bare, '[\p{{L}}\p{{N}}][.!?:;,…"''\)\]»”]+$'))
    OR (bars >= 3 AND bars * 4 > blanks) OR {" OR ".join(f"contains(lower(x), '{p}')" for p in BOILERPLATE)} AS bad FROM m),
v AS (SELECT r, count(*) AS lines, count(*) - count(DISTINCT x) AS dup, count(*) FILTER (bad) AS gone, sum(length(x)) AS total, coalesce(sum(length(x)) FILTER (bad), 0) AS lost FROM f GROUP BY r),
z AS (SELECT doc_id, n AS n_words, coalesce(c, 0) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup, 0) AS n_dup_lines, coalesce(rep, 0) AS n_repeat_words, coalesce(lines, 0) AS lines, coalesce(gone, 0) AS lines_removed, coalesce(total, 0) AS total, coalesce(lost, 0) AS lost
    FROM d JOIN g USING (r) LEFT JOIN q USING (r) LEFT JOIN v USING (r))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
    n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
    NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AND 100 * lost <= {MAX_LOST_PERCENT} * total AS kept,
    CAST(lines AS BIGINT) AS lines, CAST(lines_removed AS BIGINT) AS lines_removed, CAST(CASE WHEN total = 0 THEN 0 ELSE floor(100 * lost / total) END AS BIGINT) AS lost_percent FROM z
"""
