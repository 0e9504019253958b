"""Named analyzers: character filters, a tokenizer with positions and spans, token filters.

Runs on the driver for queries and in Arrow batches for documents. Columns that need no spans or stems use functions.text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from typing import NamedTuple

import regex

from .stem import LANGUAGES, STEMMERS
from .words import fold

TOKENIZERS = ("word_delimiter", "keyword", "whitespace", "standard", "url", "code", "filepath")
#: Boundaries inside a code word: camelCase, the last capital of a run, letter against other.
CODE = regex.compile(r"(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})|(?<=\p{L})(?=\P{L})|(?<=\P{L})(?=\p{L})")
#: Marks that a query loses beside ASCII ones.
MARKS = ((0xA1, 0xBF), (0x2010, 0x2027), (0x2030, 0x205E), (0x3000, 0x303F))
GAP = 10  #: positions between elements of a flat array
PLAIN = {"standard": re.compile(r"[^\W_]+"), "whitespace": re.compile(r"\S+"), "keyword": re.compile(r"(?s).+")}  #: tokenizers whose tokens have a position each
MAX_NAME_WORDS, MAX_NAME_BYTES = 12, 200
OPTIONS = {"tokenizer", "stemming", "lowercase", "ascii_folding", "stopwords", "min_length", "max_length", "preserve_original", "literal_symbols", "char_filters"}


class Token(NamedTuple):
    term: str
    pos: int
    span: int  #: positions covered
    start: int  #: code points, end exclusive
    end: int


@dataclass(frozen=True)
class Analyzer:
    tokenizer: str = "word_delimiter"
    stemming: str | None = None
    lowercase: bool = True
    ascii_folding: bool = False
    stopwords: tuple[str, ...] = ()
    min_length: int = 1
    max_length: int = 40
    preserve_original: bool = True
    literal_symbols: tuple[str, ...] = ("_",)
    char_filters: tuple[tuple[str, str, str], ...] = ()

    @classmethod
    def parse(cls, options: dict) -> Analyzer:
        if unknown := set(options) - OPTIONS:
            raise ValueError(f"unknown option {sorted(unknown)[0]}")
        filters = []
        for f in options.get("char_filters", ()):
            (name, x), *more = f.items()
            if more or name not in ("html_strip", "markdown_strip", "pattern_replace"):
                raise ValueError(f"unknown filter {name}")
            if name == "pattern_replace":
                re.compile(x["pattern"])
            filters.append((name, x.get("pattern", ""), x.get("replacement", "")))
        made = {k: tuple(v or ()) if k in ("stopwords", "literal_symbols") else v for k, v in options.items()} | {"char_filters": tuple(filters)}
        out = cls(**made)
        if out.tokenizer not in TOKENIZERS:
            raise ValueError(f"unknown tokenizer {out.tokenizer}")
        if out.stemming is not None and out.stemming not in STEMMERS:
            raise ValueError(f"no stemmer for {out.stemming} yet" if out.stemming in LANGUAGES else f"unknown language {out.stemming}")
        if out.min_length > out.max_length:
            raise ValueError("min_length over max_length")
        return out

    @cached_property
    def _word(self) -> re.Pattern:
        return re.compile(rf"(?:[^\W_]|[{re.escape(''.join(self.literal_symbols))}])+" if self.literal_symbols else r"[^\W_]+")

    def filtered(self, text: str) -> str:
        for name, pattern, replacement in self.char_filters:
            if name == "html_strip":
                text = re.sub(r"<[^>]*$", " ", re.sub(r"<[^>]*>", "  ", text))
            elif name == "markdown_strip":
                text = re.sub(r"[#*_`~>]", "", re.sub(r"\[([^\]]*)\]\([^)]*\)", r"\1", text)).strip()
            else:
                text = re.sub(pattern, replacement, text)
        return text

    def _raw(self, text: str) -> Iterator[Token]:
        kind, at = self.tokenizer, 0
        if kind in PLAIN:
            for i, m in enumerate(PLAIN[kind].finditer(text)):
                yield Token(m[0], i, 1, m.start(), m.end())
        else:
            for m in re.finditer(r"\S+", text):
                chunk, lo = m[0], m.start()
                parts = [(p[0], lo + p.start(), lo + p.end()) for p in self._word.finditer(chunk)]
                if kind == "code":
                    parts = [x for p in parts for x in _pieces(*p)]
                shown = parts if len(parts) > 1 or not self.preserve_original or kind in ("url", "filepath") else []
                n = max(1, len(shown))
                if self.preserve_original:
                    yield Token(chunk, at, n, lo, m.end())
                if kind == "url":
                    host = re.match(r"(?:[^:/?#]*://)?(?:[^/?#]*@)?(?:[wW]{3}\.)?([^/?#@]+)", chunk)
                    if host and host[1] != chunk:
                        yield Token(host[1], at, n, lo + host.start(1), lo + host.end(1))
                elif kind != "filepath" and parts and (joined := "".join(p for p, _, _ in parts)) != chunk:
                    yield Token(joined, at, n, parts[0][1], parts[-1][2])
                for i, (p, a, b) in enumerate(shown):
                    yield Token(p, at + i, 1, a, b)
                at += n

    def tokens(self, text: str | None) -> list[Token]:
        """Tokens of a value after its character filters; dropped ones leave their position empty."""
        return [t._replace(term=term) for t in self._raw(self.filtered(text or "")) if (term := self.term(t.term)) is not None]

    def term(self, word: str) -> str | None:
        """What the token filters make of a token; None if they drop it."""
        if len(word) > self.max_length or len(word) < self.min_length and not word.isdigit():
            return None
        word = word.lower() if self.lowercase else word
        word = fold(word) if self.ascii_folding else word
        if word in self.stopwords:
            return None
        return STEMMERS[self.stemming](word) if self.stemming else word

    def query_tokens(self, text: str) -> list[Token]:
        """As tokens, without marks that are not part of words: spider-man is asked for as spiderman."""
        plain = "".join(c for c in self.filtered(text) if c.isalnum() or c.isspace() or c in self.literal_symbols or not (c < "\x80" or any(a <= ord(c) <= b for a, b in MARKS)))
        return Analyzer.tokens(self._bare, plain)

    @cached_property
    def _bare(self) -> Analyzer:
        return Analyzer(**{k: getattr(self, k) for k in OPTIONS - {"char_filters"}})

    def flat(self, values: list[str]) -> list[Token]:
        """Tokens of an array of texts in one space of positions, elements a gap apart."""
        out, base = [], 0
        for v in values:
            found = self.tokens(v)
            out += [t._replace(pos=t.pos + base) for t in found]
            base = max((t.pos + t.span for t in out), default=base) + GAP
        return out

    def name_key(self, text: str) -> str | None:
        """Analyzed words joined by blanks; a dropped word is _, but for an article in front. None for long names."""
        words: dict[int, str] = {}
        for t in self.tokens(text):
            if t.span == 1:
                words.setdefault(t.pos, t.term)
        if not words or len(words) > MAX_NAME_WORDS:
            return None
        article = text.split()[0].lower() in ("the", "a", "an")
        first = min(words)
        at = first if first == 1 and article else 0
        out = []
        for pos in sorted(words):
            out += ["_"] * (pos > at) + [words[pos]]
            at = pos + 1
        return " ".join(out)

    def name_keys(self, value: str) -> list[tuple[str, int]]:
        """(key, level): the whole value at level 0; without a bracket at its end or what follows a comma at level 1."""
        value = value.strip()
        if len(value.encode()) > MAX_NAME_BYTES or (whole := self.name_key(value)) is None:
            return []
        heads = [m[1] for p in (r"(.*\S)\s+\([^(]*\)$", r"([^,]*[^,\s])\s*, ") if (m := re.match(p, value, re.DOTALL))]
        found = dict.fromkeys(k for h in heads if (k := self.name_key(h)))
        return [(whole, 0), *((k, 1) for k in found if k != whole)]


def _pieces(text: str, start: int, end: int) -> list[tuple[str, int, int]]:
    cuts = [0, *(m.start() for m in CODE.finditer(text)), len(text)]
    return [(text[a:b], start + a, start + b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
