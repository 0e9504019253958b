"""Dictionaries: groups of forms that find each other, one-way groups, Roman numerals."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field

from ..plans.parse import Node, word
from .analysis import Analyzer
from .words import roman

MAX_WORDS = 8
LOOSE = 0.7  #: weight of a form that spells out another
#: Numerals that are words or other short forms more often.
DENIED = ("MIX", "DIX", "LIV", "CIV", "DIV", "DC", "CD", "MD", "MC", "CC", "CL", "CV", "XL", "LI", "DI", "MI", "MM")


class DictionaryError(ValueError):
    """A dictionary that can't be read; says where."""


@dataclass
class Dictionary:
    """Forms with a capital count only as typed, unless ~ stands before; others in any case."""

    groups: list[tuple[list[str], bool]] = field(default_factory=list)  #: forms, and whether only the first asks for the others
    roman: bool = False
    low: int = 2
    high: int = 3999
    least: int = 2
    denied: tuple[str, ...] = DENIED

    @classmethod
    def parse(cls, text: str) -> Dictionary:
        try:
            spec = tomllib.loads(text)
        except tomllib.TOMLDecodeError as e:
            raise DictionaryError(str(e)) from e
        out = cls()
        for section in ("acronyms", "formulas", "synonyms", "one_way"):
            for i, forms in enumerate(spec.get(section, {}).get("groups", []), 1):
                if not isinstance(forms, list) or len(forms) < 2 or not all(isinstance(x, str) and x.strip("~ ") for x in forms):
                    raise DictionaryError(f"{section}, group {i}: a group is two forms or more")
                if any(len(x.split()) > MAX_WORDS for x in forms):
                    raise DictionaryError(f"{section}, group {i}: a form has at most {MAX_WORDS} words")
                out.groups.append((forms, section == "one_way"))
        if r := spec.get("roman"):
            out.roman, out.low, out.high, out.least = r.get("enabled", True), r.get("min_value", 2), r.get("max_value", 3999), r.get("min_len", 2)
            out.denied = tuple(r.get("denylist", DENIED))
        return out

    def __add__(self, other: Dictionary) -> Dictionary:
        return Dictionary([*self.groups, *other.groups], self.roman or other.roman, self.low, self.high, self.least, self.denied)

    def numeral(self, word: str) -> str | None:
        """The number of a capital numeral, or the numeral of a number."""
        if not self.roman:
            return None
        if word.isascii() and word.isdigit() and self.low <= int(word) <= self.high:
            out = roman(int(word))
            return out if len(out) >= self.least and out not in self.denied else None
        if len(word) >= self.least and word not in self.denied and set(word) <= set("IVXLCDM"):
            return next((str(n) for n in range(self.low, self.high + 1) if roman(n) == word), None)
        return None

    def expand(self, words: list[str], analyzer: Analyzer) -> list[Node] | None:
        """Typed words with the longest groups found in them as synonym nodes; None if there are none."""
        key = lambda text: tuple(t.term for t in analyzer.query_tokens(text))
        table: dict[tuple[str, ...], list[tuple[str, list[str]]]] = {}
        for forms, one_way in self.groups:
            for f in forms[:1] if one_way else forms:
                table.setdefault(key(f.removeprefix("~")), []).append((f, [x for x in forms if x != f]))
        out, at, found = [], 0, False
        while at < len(words):
            for n in range(min(MAX_WORDS, len(words) - at), 0, -1):
                typed = " ".join(words[at : at + n])
                others = [x for f, rest in table.get(key(typed), []) if f.startswith("~") or f == f.lower() or f == typed for x in rest]
                if n == 1 and (number := self.numeral(typed)):
                    others.append("~" + number)
                if others:
                    forms = [_form(typed, n)]
                    weights = [1.0]
                    for x in dict.fromkeys(others):
                        bare = x.removeprefix("~")
                        forms.append(Node("exact", bare.lower()) if x == bare and bare != bare.lower() and len(bare.split()) == 1 else _form(bare, len(bare.split())))
                        weights.append(1.0 if x == "~" + (self.numeral(typed) or "") or len(bare.split()) == n or n == 1 and typed.isupper() else LOOSE)
                    out.append(Node("synonym", children=tuple(forms), weights=tuple(weights)))
                    at += n
                    found = True
                    break
            else:
                out.append(word(words[at]))
                at += 1
        return out if found else None


def _form(text: str, words: int) -> Node:
    return Node("term" if words == 1 else "phrase", text)
