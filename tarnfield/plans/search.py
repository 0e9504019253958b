"""Trees to DataFrame plans: postings of each leaf, BM25, combination by key, tiers, filters, sorting.

A query's words and fields are few, so document frequencies (a row for each leaf, form and field) come to the driver and go
back as a small table. Postings are cut by kind, field and term at the scan and shuffled once, by key.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import wildcard_regex
from ..functions.words import fuzziness
from ..operators import index, search
from ..schema import Field, Policy, PolicyError
from .parse import COMBINATORS, Node, analyzed, bounds, leaves, parse

MAX_EXPANSIONS = 50
NAME_RUN_WORDS = 32
DEFAULT_RATIO = 40.0
# Kinds of tiers in their default order; the share of a query's weight that stands for all words when some
# may be missing; words up to which one may be.
TIERS = ("name", "exact", "phrase", "fuzzy", "all", "all_but_one", "any")
MIN_COVERAGE = 0.7
MAX_ALL_BUT_ONE = 7


class Form(NamedTuple):
    """Hits of a leaf or of one of its forms, what its score is worth, and its term if it has just one."""

    hits: DataFrame
    worth: float
    term: str | None = None


class Tables:
    """Live rows of an index by kind, and its field statistics, read once.

    totals (documents and words by field) and stored (field, term, rows, df) are what segments counted when they were written;
    they are None while deleted rows are among them, and then counts come from the postings.
    """

    def __init__(self, read, policy: Policy, totals: dict[str, tuple[int, int]] | None = None, stored: DataFrame | None = None) -> None:
        self.read, self.policy, self.stored = read, policy, stored
        self._stats = totals

    def of(self, kind: str, fields: list[Field] | None = None) -> DataFrame:
        df = self.read(kind)
        return df if fields is None else df.where(F.col("field").isin(*(f.path for f in fields)))

    @property
    def stats(self) -> dict[str, tuple[int, int]]:
        if self._stats is None:
            self._stats = {r.field: (r.n, r.total) for r in self.of("len").groupBy("field").agg(F.count("*").alias("n"), F.sum("len").alias("total")).collect()}  # a row a field
        return self._stats

    def counts(self, fields: list[Field], terms: set[str]) -> dict[tuple[str, str], int] | None:
        """Postings by field and term, from what segments counted; None if that can't be said without reading them."""
        if self.stored is None or not terms:
            return None if self.stored is None else {}
        here = self.stored.where(F.col("field").isin(*(f.path for f in fields)) & F.col("term").isin(*terms))
        return {(r.field, r.term): r.rows for r in here.groupBy("field", "term").agg(F.sum("rows").alias("rows")).collect()}  # a row for each asked

    def dictionary(self, fields: list[Field]) -> DataFrame:
        """term, df: documents with a term in one of the fields."""
        if self.stored is not None and len(fields) == 1:
            return self.stored.where(F.col("field") == fields[0].path).groupBy("term").agg(F.sum("df").alias("df"))
        return self.of("post", fields).groupBy("term").agg(F.countDistinct("key").alias("df"))


def postings(t: Tables, fields: list[Field], condition: Column) -> DataFrame:
    return t.of("post", fields).where(condition).select("key", "field", "row", "term", "positions", "spans", "len")


def expansions(t: Tables, fields: list[Field], node: Node) -> list[tuple[str, int]]:
    """(term, edits): the typed word if it is known, and the corrections near the best one, best first."""
    o = node.options
    k = o.get("fuzziness", "auto")
    near = search.fuzzy_terms(t.dictionary(fields), node.value, None if k == "auto" else int(k), int(o.get("prefix_length", 0)))
    return [(r.term, r.edits) for r in search.selected(near, node.value, int(o.get("max_expansions", MAX_EXPANSIONS))).collect()]


def chain(df: DataFrame, steps: tuple[tuple[str, int], ...]) -> DataFrame:
    """key, field, row, len, positions of a phrase: each word starts where the one before ends, past its gap."""
    by = {term: None for term, _ in steps}
    df = df.groupBy("key", "field", "row", "len").agg(F.map_from_entries(F.collect_list(F.struct("term", F.arrays_zip("positions", "spans")))).alias("at"))  # as many rows as the phrase has words
    df = df.where(F.size("at") == len(by))
    reach = F.transform(F.element_at("at", steps[0][0]), lambda x: F.struct(x.positions.alias("first"), (x.positions + x.spans).alias("next")))
    for term, gap in steps[1:]:
        reach = _step(reach, F.element_at("at", term), gap)
    return df.withColumn("positions", F.array_distinct(F.transform(reach, lambda x: x["first"]))).where(F.size("positions") > 0).drop("at")


def _step(reach: Column, places: Column, gap: int) -> Column:
    """Starts and next positions of what goes on at one of the places."""
    fitting = lambda x: F.filter(places, lambda y: y.positions == x.next + gap)
    return F.flatten(F.transform(reach, lambda x: F.transform(fitting(x), lambda y: F.struct(x["first"].alias("first"), (y.positions + y.spans).alias("next")))))


def forms(t: Tables, fields: list[Field], leaf: Node) -> list[Form]:
    """Hits (key, field, row, positions, len) of each form of a leaf."""
    plain = ("key", "field", "row", "positions", "len")
    if leaf.op == "term":
        return [Form(postings(t, fields, F.col("term") == leaf.value).select(*plain), 1.0, leaf.value)]
    if leaf.op in ("prefix", "wildcard"):
        condition = F.col("term").startswith(leaf.value) if leaf.op == "prefix" else F.col("term").rlike(wildcard_regex(leaf.value))
        chosen = [r.term for r in search.pattern_terms(t.dictionary(fields), condition).collect()]
        df = postings(t, fields, F.col("term").isin(*chosen) if chosen else F.lit(False))
        return [Form(df.groupBy("key", "field", "row", "len").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("positions")))).alias("positions")).select(*plain), 1.0)]
    if leaf.op == "phrase":
        return [Form(chain(postings(t, fields, F.col("term").isin(*{w for w, _ in leaf.steps})), leaf.steps).select(*plain), 1.0)]
    if leaf.op == "exact":
        df = t.of("exact", fields).where(F.col("term") == leaf.value)
        return [Form(df.select("key", "field", "row", F.array(F.lit(0)).alias("positions"), F.lit(1).alias("len")), 1.0)]
    if leaf.op == "fuzzy":
        return [Form(postings(t, fields, F.col("term") == w).select(*plain), 1 / (1 + edits), w) for w, edits in expansions(t, fields, leaf)]
    if leaf.op == "synonym":
        return [form._replace(worth=w * form.worth) for c, w in zip(leaf.children, leaf.weights, strict=True) for part in leaves(c)[:1] for form in forms(t, fields, part)]
    raise PolicyError(f"{leaf.op} is for filters")


def hits(t: Tables, fields: list[Field], clauses: list[Node]) -> tuple[DataFrame | None, dict[tuple[int, str], int]]:
    """(key, field, clause, score, positions), and the documents that each clause has in each field."""
    made = {(i, j): form for i, leaf in enumerate(clauses) for j, form in enumerate(forms(t, fields, leaf))}
    if not made:
        return None, {}
    marked = {ij: form.hits.withColumns({"clause": F.lit(ij[0]), "form": F.lit(ij[1])}) for ij, form in made.items()}
    found = reduce(DataFrame.unionByName, marked.values())
    worths = [(i, j, form.worth) for (i, j), form in made.items()]
    # what segments counted says how many postings a term has; other forms are run once for their number
    known = t.counts(fields, {form.term for form in made.values() if form.term is not None})
    own = {} if known is None else {(i, j, f.path): n for (i, j), form in made.items() if form.term is not None for f in fields if (n := known.get((f.path, form.term)))}
    if rest := [marked[ij] for ij, form in made.items() if known is None or form.term is None]:
        counted = reduce(DataFrame.unionByName, rest).groupBy("clause", "form", "field").agg(F.count("*").alias("n"))
        own |= {(r.clause, r.form, r.field): r.n for r in counted.collect()}
    rows, weights = [], {f.path: f.weight for f in fields}
    df: dict[tuple[int, str], int] = {}
    for (i, j, path), n in own.items():
        if clauses[i].op == "fuzzy":
            n = max(m for (a, _, p), m in own.items() if (a, p) == (i, path))
        elif clauses[i].op == "synonym":
            n = max(n, own.get((i, 0, path), 0))
        df[i, path] = max(n, df.get((i, path), 0))
        docs, total = t.stats.get(path, (n, n))
        worth = next(w for a, b, w in worths if (a, b) == (i, j))
        rows.append((i, j, path, n, max(docs, n), float(total) / max(1, docs), worth, *weights[path]))
    spark = found.sparkSession
    known = spark.createDataFrame(rows, "clause int, form int, field string, df long, docs long, avg double, worth double, low int, high int")
    s = found.join(F.broadcast(known), ["clause", "form", "field"])  # a row for each leaf, form and field
    tf = F.size("positions")
    gain = tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * F.col("len") / F.greatest("avg", F.lit(1e-9))))
    score = F.col("worth") * F.least(F.col("high"), F.col("low") + tf - 1) * index.idf(F.col("docs"), F.col("df")) * gain
    best = s.withColumn("score", score).groupBy("key", "field", "row", "clause").agg(F.max("score").alias("score"), F.max_by("positions", "score").alias("positions"))
    return best, df


def weight_of(t: Tables, df: dict[tuple[int, str], int], clause: int) -> float:
    """A clause's rarity, in the field that most documents have."""
    import math

    mine = [(t.stats.get(p, (n, n))[0], n) for (c, p), n in df.items() if c == clause]
    if not mine:
        return 0.0
    docs, n = max(mine)
    return math.log((docs - n + 0.5) / (n + 0.5) + 1)


def matched(node: Node, clauses: list[Node], seen: list[int]) -> tuple[Column, Column]:
    """Whether a tree holds, and its score, over the columns c0, c1 ... of its leaves in order."""
    if node.op not in COMBINATORS:
        c = F.col(f"c{len(seen)}")
        seen.append(1)
        return c.isNotNull(), F.coalesce(c, F.lit(0.0))
    parts = [matched(c, clauses, seen) for c in node.children]
    holds = reduce(lambda a, b: a & b if node.op == "AND" else a | b, (h for h, _ in parts))
    return holds, F.when(holds, reduce(lambda a, b: a + b, (s for _, s in parts))).otherwise(0.0)


def density(rows: DataFrame, n: int) -> DataFrame:
    """key, density of rows (key, at: array of clause and positions) of one field each; n clauses in typed order."""
    kind = pa.schema([("key", pa.string()), ("density", pa.float64())])

    def run(batches):
        for b in (whole.slice(lo, search.DENSITY_ROWS) for whole in batches for lo in range(0, whole.num_rows, search.DENSITY_ROWS)):
            keys, out = b.column(0).to_pylist(), []
            for at in b.column(1).to_pylist():
                places = sorted((p, x["clause"]) for x in at for p in x["positions"])
                held, last, top = {c for _, c in places}, {}, 0.0
                for p, c in places:
                    last[c] = p
                    if len(last) == len(held) > 1:
                        order = [last[k] for k in sorted(last)]
                        top = max(top, min(1.0, len(held) / (p - min(order) + 1)) * (1.0 if order == sorted(order) else 0.8))
                out.append(top * len(held) / n)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(out, pa.float64())], schema=kind)

    return rows.select("key", "at").mapInArrow(run, "key string, density double")


def likely_typo(t: Tables, fields: list[Field], word: str, own: int) -> int | None:
    """Documents with the likely correction of a known word: it is rare, and a word near it is far more frequent."""
    texts = max((n for n, _ in t.stats.values()), default=0)
    if not 0 < own <= search.TYPO_MAX or texts < own * search.TYPO_RATIO or not fuzziness(word):
        return None
    best = search.fuzzy_terms(t.dictionary(fields), word).where(F.col("term") != word).agg(F.max("df")).first()[0]
    return best if best is not None and best >= own * search.TYPO_RATIO else None


def cascade(spec: dict[str, int] | None) -> list[str]:
    """Kinds of tiers in their order, the lowest rank first; a kind left out is off, and none given means the default."""
    if not spec:
        return list(TIERS)
    if unknown := set(spec) - set(TIERS):
        raise PolicyError(f"cascade: no tier {sorted(unknown)[0]}")
    if len(set(spec.values())) < len(spec):
        raise PolicyError("cascade: a rank is given twice")
    return sorted(spec, key=lambda k: spec[k])


def admitted(order: list[str], clauses: list[Node], coverage: Column, held: Column, phrase: Column) -> Column:
    """Whether a document comes from one of the sources of relevance that are on.

    any: it has a word; all: every word, or, with all_but_one for three words or more, MIN_COVERAGE of their weight;
    all_but_one alone: every word but one; phrase: the words in order. (Stand-ins of fuzzy are clauses as others are.)
    """
    n = len(clauses)
    partial = "all_but_one" in order and 3 <= n <= MAX_ALL_BUT_ONE
    out = F.lit("any" in order and n > 1)
    if "all" in order or "fuzzy" in order:
        out = out | (held >= n) | ((coverage >= MIN_COVERAGE) if partial and "all" in order else F.lit(False))
    if partial and "all" not in order:
        out = out | (held >= n - 1)
    return out | phrase if "phrase" in order and n > 1 else out


def ranked(t: Tables, fields: list[Field], node: Node, mode: str = "crossfields", text: str = "", order: list[str] | None = None) -> tuple[DataFrame | None, bool]:
    """(key, tier, level, score) of what a tree finds in fields with one analyzer, and whether a typed word is unknown or
    likely a typo.

    Score: the sum of BM25, times the squared share of clause weights held, times 1 + density / 2, times 1 + 1.5 of the
    largest share of the query that is a name. Tiers are places in the order of the cascade: the query is a whole name, it
    is an exact value, or anything else (the first source of relevance). Typed text only meets the sources that are on.
    """
    order = order or list(TIERS)
    clauses = leaves(node)
    found, df = hits(t, fields, clauses)
    typos = {}
    for i, c in enumerate(clauses):
        if text and c.op == "term" and (own := max((n for (k, _), n in df.items() if k == i), default=0)) and (better := likely_typo(t, fields, c.value, own)):
            typos[i] = better
    unknown = bool(typos) or any(c.op == "term" and not any(k == i for k, _ in df) for i, c in enumerate(clauses))
    if found is None:
        return None, unknown
    columns = [F.sum(F.when(F.col("clause") == i, F.col("score"))).alias(f"c{i}") for i in range(len(clauses))]
    holds, total = matched(node, clauses, [])
    if mode == "bestfields":
        wide = found.groupBy("key", "field").agg(*columns).where(holds).select("key", total.alias("s"), *(F.col(f"c{i}") for i in range(len(clauses))))
        wide = wide.groupBy("key").agg(F.sum("s").alias("base"), *(F.max(f"c{i}").alias(f"c{i}") for i in range(len(clauses))))
    else:
        wide = found.groupBy("key").agg(*columns).where(holds).withColumn("base", total)
    # a likely typo weighs as its correction would, or it would hold most of the query's weight by being rare
    weights = [weight_of(t, {k: max(n, typos.get(i, 0)) for k, n in df.items()}, i) for i in range(len(clauses))]
    rarest = max([w for w in weights if w], default=1.0)
    weights = [w or rarest for w in weights]
    held = reduce(lambda a, b: a + b, (F.when(F.col(f"c{i}").isNotNull(), w).otherwise(0.0) for i, w in enumerate(weights)))
    mask = reduce(lambda a, b: a + b, (F.col(f"c{i}").isNotNull().cast("int") for i in range(len(clauses))))
    out = wide.select("key", "base", (held / sum(weights)).alias("coverage"), mask.alias("held"))
    in_order = F.lit(False)
    if text and "phrase" in order and "any" not in order and len(clauses) > 1 and all(c.op == "term" for c in clauses):
        steps = tuple((c.value, 0) for c in clauses)
        together = reduce(DataFrame.unionByName, (form.hits for form in forms(t, fields, Node("phrase", text, steps=steps)))).select("key", F.lit(True).alias("in_order")).distinct()
        out, in_order = out.join(together, "key", "left"), F.coalesce("in_order", F.lit(False))
    score = F.col("base") * F.col("coverage") * F.col("coverage")
    if len(clauses) > 1:
        near = density(found.groupBy("key", "field").agg(F.collect_list(F.struct("clause", "positions")).alias("at")), len(clauses))
        out = out.join(near.groupBy("key").agg(F.max("density").alias("density")), "key", "left")
        score = score * (1 + 0.5 * F.coalesce("density", F.lit(0.0)))
    named = [f for f in fields if f.exact and f.kind == "text"]
    rest = min((i for i, k in enumerate(order) if k not in ("name", "exact")), default=len(TIERS))
    tier, level = F.lit(rest), F.lit(0)
    if text and named and {"name", "exact"} & set(order):
        analyzer = t.policy.analyzer_of(named[0])
        words = text.split()
        whole = analyzer.name_key(text)
        runs: dict[str, float] = {}
        if len(words) <= NAME_RUN_WORDS and len(weights) == len(words):
            for a in range(len(words)):
                for b in range(a + 1, min(len(words), a + 12) + 1):
                    if (k := analyzer.name_key(" ".join(words[a:b]))) is not None:
                        runs[k] = max(runs.get(k, 0.0), sum(weights[a:b]) / sum(weights))
        wanted = {**runs, **({whole: 1.0} if whole else {})}
        if wanted:
            share = F.element_at(F.create_map(*(F.lit(x) for kv in wanted.items() for x in kv)), F.col("term"))
            exact = t.of("exact", named).where(F.col("term") == text.strip().lower()).select("key", F.lit(1).alias("is_exact")).distinct()
            names = t.of("name", named).where(F.col("term").isin(*wanted)).groupBy("key").agg(F.max(share).alias("share"), F.min(F.when(F.col("term") == (whole or ""), F.col("level"))).alias("level"))
            out = out.join(names, "key", "left").join(exact, "key", "left")
            score = score * (1 + 1.5 * F.coalesce("share", F.lit(0.0)))
            places = [(F.col("level").isNotNull(), "name"), (F.col("is_exact") == 1, "exact")]
            tier = F.least(F.lit(rest), *(F.when(holds, order.index(k)) for holds, k in places if k in order))
            level = F.coalesce("level", F.lit(0))
    score = F.when(F.isnan(score), 0.0).otherwise(score)
    if text:
        out = out.where((tier < rest) | admitted(order, clauses, F.col("coverage"), F.col("held"), in_order))
    return out.select("key", tier.alias("tier"), level.alias("level"), score.alias("score")), unknown


# Filters


def rows_of(t: Tables, f: Field, spec: object) -> DataFrame:
    """(key, row) of the array elements, or of documents, whose field fits a filter."""
    if isinstance(spec, dict) and set(spec) == {"same_element"}:
        return same_element(t, f, spec["same_element"])
    if f.kind == "struct":
        raise PolicyError(f"{f.path}: a struct takes same_element only")
    if f.kind in ("int", "float", "date", "bool"):
        return t.of("num", [f]).where(_number(f, spec)).select("key", "row")
    node = parse(spec, default="AND")
    if node.op == "all":
        return t.of("len", [f]).select("key", "row")
    if any(x.op == "exact" for x in leaves(node)) and not f.exact:
        raise PolicyError(f"{f.path} has no exact index")
    if any(x.op != "exact" for x in leaves(node)) and not f.searchable:
        raise PolicyError(f"{f.path} is not searchable")
    made = analyzed(node, t.policy.analyzer_of(f))
    if made is None:
        return t.of("len", [f]).where(F.lit(False)).select("key", "row")
    parts = [df.select("key", "row").withColumn("clause", F.lit(i)) for i, leaf in enumerate(leaves(made)) for df, *_ in forms(t, [f], leaf)]
    if not parts:
        return t.of("len", [f]).where(F.lit(False)).select("key", "row")
    many = reduce(DataFrame.unionByName, parts)
    wide = many.groupBy("key", "row").agg(*(F.max(F.when(F.col("clause") == i, 1.0)).alias(f"c{i}") for i in range(len(leaves(made)))))
    return wide.where(matched(made, leaves(made), [])[0]).select("key", "row")


def _number(f: Field, spec: object) -> Column:
    if f.kind == "bool":
        if not isinstance(spec, bool):
            raise PolicyError(f"{f.path}: true or false")
        return F.col("num") == float(spec)
    if isinstance(spec, dict):
        if set(spec) != {"range"}:
            raise PolicyError(f"{f.path}: a number, a range or an object with range")
        spec = spec["range"]
    if isinstance(spec, bool) or not isinstance(spec, (int, float, str)):
        raise PolicyError(f"{f.path}: no {f.kind} {spec!r}")
    low, high, with_low, with_high = bounds(str(spec), f)
    out = F.lit(True)
    if low is not None:
        out = out & (F.col("num") >= low if with_low else F.col("num") > low)
    if high is not None:
        out = out & (F.col("num") <= high if with_high else F.col("num") < high)
    return out


def same_element(t: Tables, f: Field, clauses: dict) -> DataFrame:
    """(key, row) of the elements of an array of structs that fit all clauses; deeper rows count for the element around."""
    if f.kind != "struct" or not f.repeated or not clauses:
        raise PolicyError(f"{f.path}: same_element is for arrays of structs")
    depth = len(f.arrays) + 1
    out = None
    for name, spec in clauses.items():
        found = rows_of(t, t.policy.find(f"{f.path}/{name}"), spec).select("key", F.substring_index("row", ".", depth).alias("row")).distinct()
        out = found if out is None else out.join(found, ["key", "row"], "left_semi")
    return out


def filtered(t: Tables, filters: dict) -> DataFrame | None:
    """Keys that fit all filters; None without any."""
    out = None
    for path, spec in (filters or {}).items():
        keys = rows_of(t, t.policy.find(path), spec).select("key").distinct()
        out = keys if out is None else out.join(keys, "key", "left_semi")
    return out


# Sorting


def sort_spec(policy: Policy, sort: dict) -> tuple[str, list[tuple[Field, bool, float, str]]]:
    """Mode, and (field, descending, ratio, modifier) in order."""
    sort = dict(sort)
    mode = sort.pop("mode", "blend")
    fields = sort.pop("fields", None) if isinstance(sort.get("fields"), dict) and not sort.get("fields", {}).get("order") else None
    fields = fields or sort
    if mode not in ("blend", "strict") or not fields:
        raise PolicyError("sort has a mode, blend or strict, and fields")
    out = []
    default = DEFAULT_RATIO if len(fields) == 1 else 100.0 / (len(fields) + 1)
    for path, o in fields.items():
        f = policy.find(path)
        if f.kind not in ("int", "float", "date", "bool"):
            raise PolicyError(f"{path}: only numbers, dates and booleans sort")
        if o.get("order", "desc") not in ("asc", "desc") or o.get("modifier", "none") not in ("none", "log1p", "sqrt"):
            raise PolicyError(f"{path}: unknown order or modifier")
        out.append((f, o.get("order", "desc") == "desc", float(o.get("ratio", default)), o.get("modifier", "none")))
    if mode == "blend" and sum(r for *_, r, _ in out) > 100:
        raise PolicyError("ratios add up to 100 at most")
    return mode, out


def limits(t: Tables, f: Field) -> DataFrame:
    """lo and hi of a field over all documents."""
    return t.of("num", [f]).agg(F.min("num").alias("lo"), F.max("num").alias("hi"))


def ordered(t: Tables, found: DataFrame, sort: dict | None) -> tuple[DataFrame, list[Column]]:
    """found (key, tier, level, score) with what it is sorted by, and the order; ties go to the lower key."""
    relevance = [F.asc("tier"), F.asc("level"), F.desc("score"), F.asc("key")]
    if not sort:
        return found, relevance
    mode, fields = sort_spec(t.policy, sort)
    apply = {"none": lambda c: c, "log1p": F.log1p, "sqrt": F.sqrt}
    order, total = [], F.lit(0.0)
    for i, (f, descending, ratio, modifier) in enumerate(fields):
        values = t.of("num", [f])
        if modifier != "none" or mode == "blend":
            lo, hi = limits(t, f).first()
            if lo is not None and (modifier == "log1p" and lo <= -1 or modifier == "sqrt" and lo < 0):
                raise PolicyError(f"{f.path}: values too small for {modifier}")
        pick = (F.max if descending else F.min)(apply[modifier](F.col("num"))).alias(f"v{i}")
        found = found.join(values.groupBy("key").agg(pick), "key", "left")
        v = F.col(f"v{i}")
        order.append(F.desc_nulls_last(v) if descending else F.asc_nulls_last(v))
        if mode == "blend" and lo is not None:
            a, b = (x[0] for x in (found.sparkSession.range(1).select(apply[modifier](F.lit(float(y)))).first() for y in (lo, hi)))
            norm = (v - a) / (b - a) if b > a else None
            part = F.lit(1.0) if norm is None else norm if descending else 1 - norm
            total = total + F.when(v.isNull(), 0.0).otherwise(part) * ratio
    if mode == "strict":
        return found, [F.asc("tier"), *order, *relevance[2:]]
    return found.withColumn("rank", relevance_of(found) * (100 - sum(r for *_, r, _ in fields)) + total), [F.desc("rank"), F.asc("key")]


def relevance_of(found: DataFrame) -> Column:
    """Midpoint of a document's place among the tiers that are present, the first 1 and the last 0, and of its share of the
    best score in its tier."""
    tiers = found.groupBy("tier", "level").agg(F.max("score").alias("best")).orderBy("tier", "level").collect()  # a row a tier
    place, share = F.lit(0.0), F.lit(0.0)
    for i, r in enumerate(tiers):
        here = (F.col("tier") == r.tier) & (F.col("level") == r.level)
        place = F.when(here, 1.0 - i / max(1, len(tiers) - 1)).otherwise(place)
        share = F.when(here, F.col("score") / r.best if r.best and r.best > 0 else F.lit(0.0)).otherwise(share)
    return (place + share) / 2
