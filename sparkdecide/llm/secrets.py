"""Secret scans: an Aho-Corasick prefilter, regular expressions anchored at its hits, checksums.

One automaton finds every place of a text where a secret could begin: the keywords of
assignments (in either case), prefixes of keys and tokens, and each four hexadecimal digits.
Only there an expression is matched, anchored at the hit; the text between hits is never
given to one. Per kind, matches are leftmost and don't overlap: a match that is too short
is dropped, but what it covers stays covered. Tokens that end in a checksum (GRAMMARS with
``crc``) are spans only if the checksum holds: the CRC-32 of the thirty characters before
it, in six digits of base 62.

Kinds, in the order that breaks ties: assign, access, hex, then the tokens repo_token
(prefixes ghp_, gho_, ghu_, ghs_, ghr_) and package_token (npm_). Letters in either case are
those of ASCII.

Defined results: a null or empty text has no spans. Rows are independent, whatever
other columns they have; repeated rows give equal spans; an empty table gives an empty table.
A text is scanned whole, in one task; its bytes, their lower case and a copy for the automaton
are held at once, four times its size with the text itself.
"""

from __future__ import annotations

import itertools
import re
import zlib
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Grammar:
    """A kind of secret: what it begins with (lower case), its expression, the least size of the group that is judged."""

    kind: str
    begins: tuple[str, ...]
    pattern: re.Pattern[bytes]
    group: int = 0
    least: int = 0
    crc: bool = False


#: Every four lower-case hexadecimal digits: the first four of a run are one of them.
HEX4 = tuple(map("".join, itertools.product("0123456789abcdef", repeat=4)))
_TOKEN = rb"[A-Za-z0-9]{36}\b"
GRAMMARS = (
    Grammar("assign", ("password", "passwd", "secret", "token", "apikey", "api_key"), re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I), 2, 8),
    Grammar("access", ("akia",), re.compile(rb"AKIA[A-Z0-9]+"), 0, 16),
    Grammar("hex", HEX4, re.compile(rb"(?<![0-9a-f])[0-9a-f]+"), 0, 32),
    Grammar("repo_token", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile(rb"gh[pousr]_" + _TOKEN), crc=True),
    Grammar("package_token", ("npm_",), re.compile(rb"npm_" + _TOKEN), crc=True),
)
KINDS = tuple(g.kind for g in GRAMMARS)
SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
SPANS_DDL = "array<struct<kind:string,start:bigint,end:bigint>>"


def checksum(body: bytes) -> bytes:
    """CRC-32 in six digits of base 62."""
    n, out = zlib.crc32(body), b""
    for _ in range(6):
        n, digit = divmod(n, 62)
        out = BASE62[digit : digit + 1] + out
    return out


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    """Keywords of all grammars; a hit gives the keyword's length and the number of its grammar."""
    out = ahocorasick.Automaton()
    for k, g in enumerate(GRAMMARS):
        for word in g.begins:
            out.add_word(word, (len(word), k))
    out.make_automaton()
    return out


def scan(data: bytes) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of each span in bytes, in that order."""
    spans: list[tuple[int, int, int]] = []
    free = [0] * len(GRAMMARS)
    # no keyword holds another one or ends inside one of its kind, so hits of a kind come in the order of their starts
    for end, (size, k) in automaton().iter(data.lower().decode("latin-1")):
        start = end + 1 - size
        if start < free[k]:
            continue
        g = GRAMMARS[k]
        if m := g.pattern.match(data, start):
            free[k] = m.end()
            if m.end(g.group) - m.start(g.group) >= g.least and (not g.crc or checksum(m[0][-36:-6]) == m[0][-6:]):
                spans.append((start, k, m.end()))
    return sorted(spans)


def found(text: str) -> list[dict]:
    """kind, start, end of each span of a text, in code points; by start, then kind, then end."""
    data = text.encode("utf-8", "surrogatepass")
    spans = scan(data)
    if not spans or len(data) == len(text):
        return [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans]
    begins = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)  # code points begun up to each byte
    return [{"kind": KINDS[k], "start": int(begins[s]) - 1, "end": int(begins[e - 1])} for s, k, e in spans]


def spans(text: Column) -> Column:
    """The spans of each text of a column: kind, start, end."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([found(t) if t else [] for t in texts.to_pylist()], pa.list_(SPAN))

    return F.arrow_udf(run, SPANS_DDL)(text)


def told(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
