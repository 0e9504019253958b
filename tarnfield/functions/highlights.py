"""Fragments of a hit's texts with the matched words in tags; runs on the rows of a page only."""

from __future__ import annotations

import re
from dataclasses import dataclass

from .analysis import Analyzer

#: A sentence ends after . ! ? and closing marks before white space and no small letter; not inside U.S. or 3.14.
SENTENCE = re.compile(r"(?<!\b[A-Z])(?<!\.\.)[.!?]+[\"')\]»”]*\s+(?=[^a-zà-ÿ\s])|\n\s*\n\s*")


@dataclass(frozen=True)
class Options:
    fragment_size: int = 150  #: bytes
    number_of_fragments: int = 3
    pre_tags: tuple[str, ...] = ("<em>",)
    post_tags: tuple[str, ...] = ("</em>",)
    sentence: bool = False


def spans(text: str, analyzer: Analyzer, weights: dict[str, float], phrases: list[tuple[tuple[str, int], ...]] = ()) -> list[tuple[int, int, float]]:
    """Places of weighted terms, and of phrases as one place each, overlapping ones merged and their weights added."""
    found = []
    tokens = analyzer.tokens(text)
    for t in tokens:
        if t.term in weights:
            found.append((t.start, t.end, weights[t.term]))
    at: dict[tuple[str, int], object] = {(t.term, t.pos): t for t in tokens}
    for steps in phrases:
        for t in tokens:
            if t.term == steps[0][0]:
                last, total = t, weights.get(t.term, 1.0)
                for term, gap in steps[1:]:
                    last = at.get((term, last.pos + last.span + gap))
                    if last is None:
                        break
                    total += weights.get(term, 1.0)
                else:
                    found.append((t.start, last.end, total))
    merged: list[tuple[int, int, float]] = []
    for a, b, w in sorted(found):
        if merged and a < merged[-1][1]:
            x, y, v = merged[-1]
            merged[-1] = (x, max(y, b), max(v, w) if (a, b) == (x, y) else v + w)
        else:
            merged.append((a, b, w))
    return merged


def _cut(text: str, start: int, size: int) -> int:
    """The end of a window of at most so many bytes from start, at the end of a word; a longer word stays whole."""
    end = start
    for m in re.compile(r"\s*\S+").finditer(text, start):
        if len(text[start : m.end()].encode()) > size and end > start:
            break
        end = m.end()
    return end


def windows(text: str, places: list[tuple[int, int, float]], o: Options) -> list[tuple[int, int]]:
    if o.sentence:
        cuts = [0, *(m.end() for m in SENTENCE.finditer(text)), len(text)]
        whole = [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if any(a <= p < b for p, _, _ in places)]
        return [(a, b if len(text[a:b].rstrip().encode()) <= o.fragment_size else _cut(text, a, o.fragment_size)) for a, b in whole]
    if len(text.encode()) <= o.fragment_size:
        return [(0, len(text))] if places else []
    out: list[tuple[int, int]] = []
    for a, b, _ in places:
        if out and b <= out[-1][1]:
            continue
        low = out[-1][1] if out else 0
        room = max(0, (o.fragment_size - len(text[a:b].encode())) // 3)
        start = max(low, a - room)
        if 0 < start < a and not text[start - 1].isspace():
            start = next((m.end() for m in re.compile(r"\s+").finditer(text, start, a)), a)
        out.append((start, max(b, _cut(text, start, o.fragment_size))))
    return out


def fragments(text: str, places: list[tuple[int, int, float]], o: Options = Options()) -> list[str]:
    """The best windows, the heaviest first, ties by place; close matches count half as much again."""
    if not places or not o.number_of_fragments:
        return []
    scored = []
    for a, b in windows(text, places, o):
        inside = [p for p in places if a <= p[0] and p[1] <= b]
        if not inside:
            continue
        covered = sum(y - x for x, y, _ in inside)
        closeness = covered / max(1, inside[-1][1] - inside[0][0]) if len(inside) > 1 else 0.0
        scored.append((-sum(w for *_, w in inside) * (1 + 0.5 * closeness), a, b, inside))
    out = []
    for _, a, b, inside in sorted(scored, key=lambda x: x[:2])[: o.number_of_fragments]:
        piece, at = "", a
        for x, y, _ in inside:
            piece += text[at:x] + o.pre_tags[0] + text[x:y] + o.post_tags[0]
            at = y
        out.append((piece + text[at:b]).strip())
    return out
