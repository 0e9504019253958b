"""License scans: ordered signatures behind a keyword prefilter, overlaps resolved by priority and containment."""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import cache
from re import _parser
from re._constants import LITERAL
from typing import NamedTuple

import ahocorasick
from pyspark.sql import DataFrame

from .common import map_texts
from .license_rules import RULES

BASE = {b"mit license": "mit", b"apache license": "apache", b"general public license": "gpl"}
#: Bytes that part words become blanks, A-Z lower case.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: What parts words may be of any length. A run of over EDGES characters counts by its first and last half, so that no
#: signature is longer than its expression says; no expression has more than half of EDGES such characters in a row.
SEPARATOR, EDGES = "[^a-z0-9.]", 8
LONG_RUN = re.compile(f"{SEPARATOR}{{{EDGES + 1},}}")
GAP = f"{SEPARATOR}{{1,{EDGES}}}"


class Rule(NamedTuple):
    priority: int
    label: str
    keyword: str
    pattern: re.Pattern
    sure: float
    reach: int  #: the longest match
    needs: tuple[str, ...]  #: pieces that every match holds


class Hit(NamedTuple):
    start: int
    end: int
    priority: int
    label: str
    sure: float


@cache
def rules() -> list[Rule]:
    """Identifiers and addresses are surer than names, names surer than bare mentions of rights."""
    out: list[Rule] = []
    for line in RULES.strip().splitlines():
        label, *signatures = line.split(" | ")
        for s in signatures:
            keyword, pattern = s.split(" => ")
            exact = any(c in keyword for c in "./-") or keyword[-1].isdigit()
            body = pattern.replace("@?", f"(?:{GAP})?").replace("@", GAP)
            body = whole_words(body.strip())
            out.append(Rule(len(out), label.strip(), keyword.strip(), re.compile(body), 1.0 if exact else 0.9, _parser.parse(body).getwidth()[1], needs(body)))
    return out


def needs(expression: str) -> tuple[str, ...]:
    """Literal pieces of three letters or more that stand in every match."""
    pieces, here = [], ""
    for op, x in [*_parser.parse(expression), (None, None)]:
        if op is LITERAL:
            here += chr(x)
        else:
            pieces, here = [*pieces, here], ""
    return tuple(p for p in pieces if len(p) > 2)


def whole_words(body: str) -> str:
    """An expression that starts no match inside a word; said after its first letters where it can be, as a search for
    letters is fast."""
    if m := re.match(r"(\\b)?([a-z0-9]{2,})(?![?*{+a-z0-9])", body):
        return rf"{m[2]}(?<!{chr(92) + 'w' if m[1] else '[a-z0-9]'}{m[2]}){body[m.end() :]}"
    return rf"(?<![a-z0-9]){body}"


@cache
def automaton() -> ahocorasick.Automaton:
    by: dict[str, list[int]] = {}
    for i, r in enumerate(rules()):
        by.setdefault(r.keyword, []).append(i)
    out = ahocorasick.Automaton()
    for k, which in by.items():
        out.add_word(k, tuple(which))
    out.make_automaton()
    return out


def suppress(hits: list[Hit]) -> list[Hit]:
    """Of hits, those not inside another of the same or an earlier rule's priority; of equal ones the first rule's; by start.

    From left to right, longer ones first: what can contain a hit comes before it, and is held only until its end.
    """
    kept: list[Hit] = []
    around: list[Hit] = []
    for h in sorted(set(hits), key=lambda h: (h.start, -h.end, h.priority)):
        around = [k for k in around if k.end > h.start]
        if not any(h.end <= k.end and (k.priority <= h.priority or k.label == h.label) for k in around):
            around.append(h)
            kept.append(h)
    return kept


def squeezed(low: str) -> tuple[str, list[int], list[int]]:
    """A text with its long runs of separators cut to EDGES, where each cut is in it, and what all cuts up to it took."""
    half = EDGES // 2
    out, at, gone, cuts, lost = [], 0, 0, [], []
    for m in LONG_RUN.finditer(low):
        a, b = m.start() + half, m.end() - half
        out.append(low[at:a])
        cuts.append(a - gone)
        gone += b - a
        lost.append(gone)
        at = b
    return "".join([*out, low[at:]]), cuts, lost


def stretches(ends: list[int], reach: int) -> list[tuple[int, int]]:
    """What lies within reach of ascending places, joined where it overlaps."""
    breaks = [i for i in range(1, len(ends)) if ends[i] - ends[i - 1] > 2 * reach]
    return [(max(0, ends[i] - reach), ends[j - 1] + reach + 1) for i, j in zip([0, *breaks], [*breaks, len(ends)], strict=True)]


def detect(text: str | None) -> list[Hit]:
    """Signatures found in a whole text, overlaps resolved; offsets in code points.

    A rule is tried on the stretches that its longest match can take around its keywords, joined where they overlap, so
    time grows with the text however many keywords it has.
    """
    if not text:
        return []
    low = text.encode().lower().decode()
    if next(automaton().iter(low), None) is None:
        return []
    low, cuts, lost = squeezed(low)
    near: dict[tuple[int, ...], list[int]] = {}  # ends of each keyword, by its rules
    for end, which in automaton().iter(low):
        near.setdefault(which, []).append(end)
    has: dict[str, bool] = {}
    hits: list[Hit] = []
    for which, ends in near.items():
        for rule in map(rules().__getitem__, which):
            for w in rule.needs:
                if w not in has:
                    has[w] = w in low
            if all(has[w] for w in rule.needs):
                for lo, hi in stretches(ends, rule.reach + len(rule.keyword)):
                    hits += [Hit(m.start(), m.end(), rule.priority, rule.label, rule.sure) for m in rule.pattern.finditer(low, lo, hi)]
    if not cuts:
        return suppress(hits)
    place = lambda x: x + lost[k - 1] if (k := bisect_right(cuts, x)) else x
    return [h._replace(start=place(h.start), end=place(h.end - 1) + 1) for h in suppress(hits)]


def base(text: str | None) -> tuple[int, list[int], list[str]]:
    """Number of words, word index of every place of a base phrase, and the phrases' labels."""
    words = (text or "").encode().translate(TABLE).split()
    places: list[int] = []
    labels = []
    if b"license" in words:
        joined = b" " + b" ".join(words) + b" "
        for phrase, label in BASE.items():
            at, last, n = joined.find(b" " + phrase + b" "), 0, 0
            if at >= 0:
                labels.append(label)
            while at >= 0:
                n += joined.count(b" ", last, at)
                places.append(n)
                last, at = at, joined.find(b" " + phrase + b" ", at + 1)
    return len(words), places, labels


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections (label:start:end, joined by commas).

    Null and empty texts have no words and no labels; score is 0 without labels, else that of the surest one (a base
    phrase alone 0.8). Rows are scanned one by one, repeated ones too; an empty table gives none.
    """

    def run(ids, texts):
        cols = [ids, [], [], [], [], [], [], [], []]
        for t in texts:
            n, places, labels = base(t)
            hits = detect(t)
            sure = max([h.sure for h in hits] + [0.8] * bool(labels), default=0.0)
            row = (n, len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted({*labels, *(h.label for h in hits)})), sure, ",".join(f"{h.label}:{h.start}:{h.end}" for h in hits))
            for c, x in zip(cols[1:], row, strict=True):
                c.append(x)
        return cols

    return map_texts(docs, ("doc_id", "text"), run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections string")
