"""Corrections, likely typos, tiers of the cascade and stored counts, on a small database with known frequencies."""

import pytest

from tarnfield.database import Database
from tarnfield.plans.parse import Node
from tarnfield.plans.search import Tables, cascade, hits, likely_typo
from tarnfield.schema import PolicyError

POLICY = {"analyzers": {"$default": {"tokenizer": "standard"}}, "document": {"id": "id", "name": {"$type": "text", "$exact": True}, "text": "text"}}
#: 60 documents on barley, one on a "barly" farm; brewing words that go with each correction.
DOCS = (
    [{"id": f"b{i:02}", "name": f"Lot {i}", "text": "barley malt kettle" if i % 2 else "barley stout"} for i in range(60)]
    + [{"id": "farm", "name": "Barly", "text": "barly farm"}, {"id": "kilt", "name": "Kilts", "text": "kettles boil"}, {"id": "oat", "name": "Oat porridge", "text": "oat porridge with honey and milk"}]
    + [{"id": f"o{i}", "name": f"Bowl {i}", "text": t} for i, t in enumerate(["honey and oat porridge", "porridge with milk", "oat honey", "milk", "with honey porridge oat"])]
)


@pytest.fixture(scope="module")
def db(spark, tmp_path_factory):
    out = Database.create(spark, f"{tmp_path_factory.mktemp('db')}/brews", POLICY)
    assert out.insert(DOCS).count() == 0
    return out


def keys(db, **request):
    return [r.key for r in db.search({"docs": 100, **request}).collect()]


def test_stored_counts_are_those_of_the_postings(db):
    fields = db.policy.searched(["text"])
    plain = Tables(db._index, db.policy)
    assert db.tables.stored is not None and db.tables.stats == plain.stats
    rows = lambda t: {(r.term, r.df) for r in t.dictionary(fields).collect()}
    assert rows(db.tables) == rows(plain)
    clauses = [Node("term", "barley"), Node("prefix", "ket"), Node("fuzzy", "barly"), Node("term", "nothing")]
    (a, df), (b, want) = hits(db.tables, fields, clauses), hits(plain, fields, clauses)
    score = lambda found: {(r.key, r.clause): round(r.score, 9) for r in found.collect()}
    assert df == want and score(a) == score(b)


def test_counts_after_rows_have_ended(spark, tmp_path):
    db = Database.create(spark, f"{tmp_path}/w", POLICY)
    db.insert(DOCS[:6])
    db.delete(["b00"])
    assert db.tables.stored is None and {r.term: r.df for r in db.tables.dictionary(db.policy.searched(["text"])).collect()}["barley"] == 5
    db.compact()
    assert db.tables.stored is not None and db.tables.stats["text"][0] == 5


def test_likely_typos(db):
    fields = db.policy.searched(["text"])
    assert likely_typo(db.tables, fields, "barly", 1) == 60
    assert likely_typo(db.tables, fields, "kettles", 1) == 30 and likely_typo(db.tables, fields, "oat", 4) is None
    assert likely_typo(db.tables, fields, "barley", 60) is None and likely_typo(db.tables, fields, "absent", 0) is None
    found = keys(db, query="barly", search_fields=["text"])
    assert "farm" in found and len(found) == 61  # a known word, but likely a typo: its correction is searched for too
    assert keys(db, query="barly", search_fields=["text"], cascade={"name": 1, "all": 2}) == ["farm"]


def test_corrections_in_context(db):
    got = db.did_you_mean("barlley stout", ["text"])
    assert got["corrected"] == "barley stout" and got["confident"] and got["words"] == [{"word": "barlley", "suggestions": ["barley"]}]
    assert db.did_you_mean("barley stout", ["text"]) == {"original": "barley stout", "corrected": "barley stout", "confident": False, "words": []}
    assert db._together(["barley", "barly", "malt"], ["farm"], db.policy.searched(["text"])) == {"barly": 1}
    assert db.did_you_mean("milkk porridge", ["text"])["corrected"] == "milk porridge"
    assert db.suggest("barlley", ["text"]) == [("barlley", "barley")]


@pytest.mark.parametrize(("tiers", "want"), [
    (None, {"oat", "o0", "o1", "o2", "o4"}), ({"any": 1}, {"oat", "o0", "o1", "o2", "o4"}), ({"all": 1}, {"oat", "o0", "o4"}), ({"phrase": 1}, {"oat", "o0"}),
    ({"all_but_one": 1}, {"oat", "o0", "o2", "o4"}), ({"all": 1, "phrase": 2}, {"oat", "o0", "o4"}),
])
def test_sources_of_relevance(db, tiers, want):
    text = "oat porridge" if tiers is None or "all_but_one" not in tiers else "oat honey porridge"
    request = {"query": text, "search_fields": ["text"]} | ({"cascade": tiers} if tiers else {})
    assert set(keys(db, **request)) == want


def test_minimum_coverage(db):
    """With all_but_one on, all admits documents that hold 0.7 of the query's weight."""
    some = keys(db, query="oat honey barley", search_fields=["text"], cascade={"all": 1, "all_but_one": 2})
    assert set(some) == {"oat", "o0", "o2", "o4"}  # oat and honey are rare, barley is not
    assert keys(db, query="oat honey barley", search_fields=["text"], cascade={"all": 1}) == []


def test_order_of_tiers(db):
    first = lambda order: keys(db, query="oat porridge", search_fields=["name", "text"], cascade=order)
    assert first({"name": 1, "any": 2})[0] == "oat"
    tiers = {r.key: r.tier for r in db.search({"query": "oat porridge", "search_fields": ["name", "text"], "cascade": {"any": 1, "name": 2}}).collect()}
    assert set(tiers.values()) == {0}
    assert cascade(None) == ["name", "exact", "phrase", "fuzzy", "all", "all_but_one", "any"] and cascade({"any": 2, "name": 5}) == ["any", "name"]
    for bad in ({"odd": 1}, {"any": 1, "all": 1}):
        with pytest.raises(PolicyError):
            db.search({"query": "oat", "cascade": bad})


def test_blend_of_tiers_and_scores(db):
    """The midpoint of a hit's place among the tiers and its share of its tier's best score, and the field's share."""
    from tarnfield.plans.search import ordered

    spark = db.spark
    found = spark.createDataFrame([("x", 0, 0, 8.0), ("y", 2, 0, 4.0), ("z", 2, 0, 1.0), ("w", 1, 1, 3.0)], "key string, tier int, level int, score double")
    policy = {"document": {"id": "id", "n": "int", "same": "int"}}
    import tempfile

    with tempfile.TemporaryDirectory() as d:
        other = Database.create(spark, f"{d}/n", policy)
        other.insert([{"id": "x", "n": 0, "same": 5}, {"id": "y", "n": 10, "same": 5}, {"id": "z", "n": 5}])
        out, order = ordered(other.tables, found, {"n": {"ratio": 20}})
        assert {r.key: round(r.rank, 6) for r in out.collect()} == {"x": 80.0, "w": 60.0, "y": 40 + 20, "z": 10 + 10}
        assert [r.key for r in out.orderBy(*order).collect()] == ["x", "w", "y", "z"]
        out, _ = ordered(other.tables, found, {"same": {"ratio": 10, "order": "asc"}})
        assert {r.key: round(r.rank, 6) for r in out.collect()} == {"x": 100.0, "w": 67.5, "y": 55.0, "z": 11.25}
