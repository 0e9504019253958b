"""Secret scans: keywords by Aho-Corasick, anchored expressions at their hits only, then embedded checksums."""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import DOCUMENTS, map_texts

KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "pem", "account_key")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
GITHUB = re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
NPM = re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
JWT = re.compile(r"(eyJ[A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{4,})\.([A-Za-z0-9_-]{8,})")
JWT_RUN = re.compile(r"[A-Za-z0-9_-]+")
JWT_TAIL = re.compile(r"\.[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{8,}")
PEM = re.compile(r"-----BEGIN ([A-Z ]{0,20}PRIVATE KEY)-----([A-Za-z0-9+/=\s]+)-----END \1-----")
ACCOUNT = re.compile(r"AccountKey=([A-Za-z0-9+/]{86}==)")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KEYWORDS = dict.fromkeys(WORDS, "assign") | {"akia": "access", "npm_": "npm", "eyj": "jwt", "-----begin": "pem", "accountkey=": "account_key"} | {f"gh{c}_": "github" for c in "pousr"}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
PLACEHOLDER = "[secret]"


class Span(NamedTuple):
    start: int
    order: int
    end: int
    secret: int  #: where the secret itself begins

    @property
    def kind(self) -> str:
        return KINDS[self.order]

    def __str__(self) -> str:
        return f"{self.kind}:{self.start}:{self.end}"


@cache
def automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        out.add_word(word, (len(word), kind))
    out.make_automaton()
    return out


def base62_crc(body: str) -> str:
    n, out = zlib.crc32(body.encode()), ""
    while n:
        n, k = divmod(n, 62)
        out = BASE62[k] + out
    return out.rjust(6, "0")


def _decoded(text: str, alphabet: bytes | None = None) -> bytes | None:
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), altchars=alphabet, validate=True)
    except (binascii.Error, ValueError):
        return None


def _checked(m: re.Match) -> bool:
    return base62_crc(m[1]) == m[2]


def _jwt(m: re.Match) -> bool:
    try:
        head = json.loads(_decoded(m[1], b"-_") or b"")
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and "alg" in head


def _der(m: re.Match) -> bool:
    """The length in the outer sequence's header is that of the key."""
    raw = _decoded("".join(m[2].split()))
    if not raw or len(raw) < 4 or raw[0] != 0x30:
        return False
    if raw[1] < 0x80:
        return len(raw) == 2 + raw[1]
    n = raw[1] & 0x7F
    return 0 < n <= 4 and len(raw) == 2 + n + int.from_bytes(raw[2 : 2 + n], "big")


RULES = {
    "assign": (ASSIGN, 2, lambda m: len(m[2]) >= 12),
    "access": (ACCESS, 0, lambda m: len(m[0]) >= 18),
    "github": (GITHUB, 0, _checked),
    "npm": (NPM, 0, _checked),
    "jwt": (JWT, 0, _jwt),
    "pem": (PEM, 2, _der),
    "account_key": (ACCOUNT, 1, lambda m: len(_decoded(m[1]) or b"") == 64),
}


def _jwt_starts(text: str, starts: list[int]) -> Iterator[int]:
    """Starts whose run of letters is followed by two more parts; a run is gone through once, however many starts it holds."""
    end, whole = 0, False
    for at in starts:
        if at >= end:
            end = m.end() if (m := JWT_RUN.match(text, at)) else at + 1
            whole = JWT_TAIL.match(text, end) is not None
        if whole:
            yield at


def find(text: str | None) -> list[Span]:
    """All spans of a text by start, then kind; ends exclusive, in code points. Of each kind leftmost and not overlapping."""
    if not text:
        return []
    hits: dict[str, list[int]] = {}
    for end, (n, kind) in automaton().iter(text.encode().lower().decode()):
        hits.setdefault(kind, []).append(end + 1 - n)
    out = [Span(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    for kind, starts in hits.items():
        pattern, group, holds = RULES[kind]
        order, done = KINDS.index(kind), 0
        starts = sorted(set(starts))
        for at in _jwt_starts(text, starts) if kind == "jwt" else starts:
            if at >= done and (m := pattern.match(text, at)):
                done = m.end()
                if holds(m):
                    out.append(Span(at, order, done, m.start(group)))
    return sorted(out)


def redact(text: str | None, spans: list[Span]) -> str | None:
    """The text with a placeholder for each secret; what names it stays."""
    if not spans:
        return text
    out, at = [], 0
    for a, b in sorted((s.secret, s.end) for s in spans):
        if a >= at:
            out += [text[at:a], PLACEHOLDER]
        at = max(at, b)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, redacted: bool = False) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_verified (spans whose checksum or structure holds), then text,
    redacted, if asked for.

    Null and empty texts have no spans. Each row is scanned by itself, repeated ones too; an empty table gives none.
    Columns beside doc_id and text are not read.
    """

    def run(ids, texts):
        cols = [ids, [], [], [], [], [], [], []]
        for t in texts:
            spans = find(t)
            base = [s for s in spans if s.order < 3]
            for k in range(3):
                cols[1 + k].append(sum(s.order == k for s in base))
            cols[4].append(hashlib.sha256(",".join(map(str, base)).encode()).hexdigest())
            cols[5].append(",".join(map(str, spans)))
            cols[6].append(len(spans) - len(base))
            cols[7].append(redact(t, spans) if redacted else None)
        return cols if redacted else cols[:7]

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_verified long"
    return map_texts(docs, ("doc_id", "text"), run, schema + ", text string" * redacted)


def stage(docs: DataFrame) -> DataFrame:
    """All documents, secrets replaced; n_chars follows the text.

    Null and empty texts stay as they are (n_chars null, 0), as do rows without doc_id; repeated rows are handled one by one,
    an empty table gives none, columns beside those of documents are dropped.
    """
    run = lambda ids, texts, langs, sources: [ids, [redact(t, find(t)) for t in texts], langs, sources]
    df = map_texts(docs, DOCUMENTS[:4], run, "doc_id long, text string, lang string, source string")
    return df.withColumn("n_chars", F.length("text").cast("bigint")).select(*DOCUMENTS)
