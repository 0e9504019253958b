"""The engine's own operators against their SQL twins, brute force and golden cases."""

import functools
import json
import math
import os
import random
import re
from collections import Counter

import duckdb
import pytest

from tarnfield import catalog
from tarnfield.functions import words
from tarnfield.functions.text import wildcard_regex
from tarnfield.operators import search, writes

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_twin(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    want = duck.execute(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda df: sorted(tuple(map(str, r)) for r in df[sorted(df.columns)].itertuples(index=False))
    assert key(got) == key(want)


def tokens_of(duck):
    return {i: re.findall(r"[^\W_]+", t.lower()) for i, t in duck.execute("SELECT doc_id, text FROM documents").fetchall()}


def slow_near(duck, word):
    """(term, df, edits, distance, rank_score) of the terms near a word."""
    df = Counter(t for found in tokens_of(duck).values() for t in set(found))
    near = [(t, n, _osa(word, t)) for t, n in df.items() if abs(len(t) - len(word)) <= 2 and _osa(word, t) <= words.fuzziness(word)]
    return [(t, n, e, slow_weighted(word, t), math.log10(n) - 2 * slow_weighted(word, t)) for t, n, e in near]


@pytest.mark.parametrize("name", ["fuzzy_ranked", "did_you_mean"])
def test_corrections(spark, duck, name):
    near = slow_near(duck, "wiht")
    best = max((x[4] for x in near if x[0] != "wiht"), default=0)
    want = sorted((t, n, e, round(d, 6), round(s, 6)) for t, n, e, d, s in near if t == "wiht" or s >= best - 1.5)
    got = catalog.QUERIES[name](spark, SF).collect()
    assert want and sorted(map(tuple, got)) == want
    assert [(-r.rank_score, r.term) for r in got] == sorted((-r.rank_score, r.term) for r in got)


def test_frequent_words_are_trusted(spark):
    terms = spark.createDataFrame([("field", 30), ("fields", 900), ("fild", 3)], "term string, df long")
    pick = lambda w: [r.term for r in search.did_you_mean(terms, w).collect()]
    assert pick("field") == ["field"] and pick("fild") == ["fild", "field"] and pick("zzzzz") == []


def test_proximity_density(spark, duck):
    def slow(found):
        at = [(i, catalog.WORDS.index(t)) for i, t in enumerate(found) if t in catalog.WORDS]
        held, top = {k for _, k in at}, 0.0
        if len(held) < 2:
            return None
        for i, (end, _) in enumerate(at):
            last = {k: p for p, k in at[: i + 1]}
            if set(last) == held:
                order = [last[k] for k in sorted(held)]
                top = max(top, min(1.0, len(held) / (end - min(order) + 1)) * (1.0 if order == sorted(order) else 0.8))
        return round(top * len(held) / len(catalog.WORDS), 6)

    want = {i: x for i, found in tokens_of(duck).items() if (x := slow(found)) is not None}
    assert want and {r.doc_id: r.density for r in catalog.QUERIES["proximity_density"](spark, SF).collect()} == pytest.approx(want)


def test_density_sends_places_only(spark, monkeypatch):
    """Python gets little of a long text, however many words it has."""
    tokens = spark.range(50).selectExpr("id AS doc_id", "concat(array('this', 'and', 'b', 'with'), array_repeat('other', 5000), array('with')) AS tokens")
    sent = []
    for name in ("mapInArrow", "mapInPandas"):
        monkeypatch.setattr(type(tokens), name, lambda self, *a, f=getattr(type(tokens), name), **k: (sent.append(self), f(self, *a, **k))[1])
    assert {tuple(r) for r in search.density(tokens, ["this", "and", "with"]).collect()} == {(i, 0.75) for i in range(50)}
    (given,) = sent
    assert given.selectExpr("max(length(to_json(struct(*)))) AS n").first().n < 200


def test_every_query_has_a_twin_or_a_test():
    assert set(catalog.QUERIES) - set(catalog.SQL) == {"fuzzy_ranked", "did_you_mean", "proximity_density"}


def _osa(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_osa():
    rng = random.Random(3)
    some = ["".join(rng.choices("abc", k=rng.randrange(6))) for _ in range(40)]
    assert all(words.osa(a, b) == _osa(a, b) for a in some for b in some)
    assert words.osa("ca", "abc") == 3 and words.osa("form", "from") == 1


def slow_weighted(a, b):
    """The least price over all ways to change a into b, from the rules."""
    rows = [("qwertyuiop", 0.0), ("asdfghjkl", 0.25), ("zxcvbnm", 0.75)]
    at = {k: (i + shift, y) for y, (row, shift) in enumerate(rows) for i, k in enumerate(row)}

    def change(x, y, first):
        alike = {x, y} in [{"c", "k"}, {"c", "s"}, {"k", "q"}, {"s", "z"}, {"v", "w"}, {"g", "j"}]
        if x == y:
            return 0.0
        near = x in at and y in at and ((at[x][1] == at[y][1] and abs(at[x][0] - at[y][0]) == 1) or (abs(at[x][1] - at[y][1]) == 1 and abs(at[x][0] - at[y][0]) < 1))
        return (0.6 if alike or near or {x, y} <= set("aeiouy") else 1.0) + (1.0 if first and not alike else 0.0)

    letter = lambda i, n: (0.7 if i == n - 1 else 1.0) + (1.0 if i == 0 else 0.0)

    @functools.cache
    def go(i, j):
        out = [0.0] if (i, j) == (len(a), len(b)) else []
        if i < len(a):
            out.append(letter(i, len(a)) + go(i + 1, j))
        if j < len(b):
            out.append(letter(j, len(b)) + go(i, j + 1))
        if i < len(a) and j < len(b):
            out.append(change(a[i], b[j], i == j == 0) + go(i + 1, j + 1))
        if i + 1 < len(a) and j + 1 < len(b) and a[i] == b[j + 1] and a[i + 1] == b[j] and a[i] != b[j]:
            out.append(0.5 + go(i + 2, j + 2))
        return min(out)

    return go(0, 0)


@pytest.mark.parametrize(("typed", "term", "price"), [("cent", "sent", 0.6), ("very", "wery", 0.6), ("bat", "bqt", 0.6), ("form", "from", 0.5), ("bank", "tank", 2.0), ("car", "cars", 0.7), ("cars", "car", 0.7), ("same", "same", 0.0), ("a", "", 1.7), ("word", "wird", 0.6), ("word", "wxrd", 1.0), ("night", "nihgt", 0.5)])
def test_weighted(typed, term, price):
    assert words.weighted(typed, term) == pytest.approx(price)


def test_weighted_against_brute_force():
    rng = random.Random(5)
    some = ["".join(rng.choices("acksqwvy", k=rng.randrange(7))) for _ in range(40)]
    assert all(words.weighted(a, b) == pytest.approx(slow_weighted(a, b)) for a in some for b in some)


def test_words():
    assert words.fold("Straße café Łódź") == "Strasse cafe Lodz"
    assert [words.fuzziness(w) for w in ("ab", "abcd", "abcde", "abcdefghij", "12345")] == [0, 1, 2, 3, 0]
    assert words.roman(1994) == "MCMXCIV"


def test_dates():
    assert words.millis("2024-01-02", "YYYY-MM-DD") == 1704153600000
    assert words.millis("2024-01-02 02:00:00", "YYYY-MM-DD HH:mm:ss+02:00") == 1704153600000
    assert words.millis("1704153600000", "epoch-millis") == 1704153600000
    assert words.millis("24-01-02", "YYYY-MM-DD") is None and words.millis("2024-13-02", "YYYY-MM-DD") is None


def test_merge_patch():
    assert json.loads(words.patch_json('{"a": {"b": 1, "c": 2}, "d": 3}', '{"a": {"b": null, "e": [1]}, "d": {"f": null}}')) == {"a": {"c": 2, "e": [1]}, "d": {}}


def test_wildcards():
    assert re.fullmatch(wildcard_regex("a?c*[xy]"), "abcdefx") and not re.fullmatch(wildcard_regex("a.c"), "abc")


def test_writes(spark):
    stored = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "id long, v string, at int")
    batch = spark.createDataFrame([(2, "c", 1), (3, "d", 1), (3, "e", 2)], "id long, v string, at int")
    rows = lambda df: sorted(map(tuple, df.collect()))
    kept, failed = writes.insert(stored, batch, "id", "at")
    assert rows(kept) == [(1, "a", 0), (2, "b", 0), (3, "d", 1)] and rows(failed) == [(2, 1), (3, 2)]
    assert rows(writes.upsert(stored, batch, "id", "at")) == [(1, "a", 0), (2, "c", 1), (3, "e", 2)]
    kept, failed = writes.replace(stored, batch, "id", "at")
    assert rows(kept) == [(1, "a", 0), (2, "c", 1)] and rows(failed) == [(3,)]
    kept, failed = writes.delete(stored, spark.createDataFrame([(2,), (9,), (9,)], "id long"), "id")
    assert rows(kept) == [(1, "a", 0)] and rows(failed) == [(9,)]


def test_ingest(spark, tmp_path):
    from tarnfield.streaming.ingest import compact, ingest

    schema = "id long, v string, at int"
    args = (spark, f"{tmp_path}/in", schema, f"{tmp_path}/table", "id", "at", f"{tmp_path}/log")
    rows = lambda df: sorted(map(tuple, df.collect()))
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/in")
    assert rows(ingest(*args)) == []
    spark.createDataFrame([(1, "a", 0), (2, "b", 0), (2, "older", -1)], schema).write.mode("append").parquet(f"{tmp_path}/in")
    assert rows(ingest(*args)) == [(1, "a", 0), (2, "b", 0)]
    spark.createDataFrame([(2, "c", 1), (3, "d", 1)], schema).write.mode("append").parquet(f"{tmp_path}/in")
    want = [(1, "a", 0), (2, "c", 1), (3, "d", 1)]
    assert rows(ingest(*args)) == want
    assert rows(ingest(*args)) == want  # nothing new
    compact(spark, schema, f"{tmp_path}/table", "id")
    assert rows(ingest(*args)) == want and len([x for x in os.listdir(f"{tmp_path}/table") if x.startswith("batch=")]) == 1
    spark.createDataFrame([(1, "z", 5)], schema).write.mode("append").parquet(f"{tmp_path}/in")
    assert rows(ingest(*args)) == [(1, "z", 5), *want[1:]]
