r"""BPE encoding and decoding, equal to what the tokenizers library gives for whole texts.

A text is split where its tokenizer splits it anyway: white space, and ends of words
and of runs of punctuation. What such a unit encodes to is remembered, so frequent
words are encoded once a worker. Text that stays unsplit for long is encoded by tree
concatenation: leaves are encoded on their own, and at each join a window that grows
on both sides is encoded again until its outer tokens agree with both halves. A
sequence of tokens is the encoding of its text if each two neighbours are the encoding
of theirs, so agreeing outer tokens make the join exact. Documents above
``split_chars`` are cut into pieces that separate tasks encode; the cuts inside words
are joined in the same way.

Defined results: a null text is an empty text and encodes to an empty list; null ids
decode to null. Special tokens in a text are recognised, as the library does. Rows are
independent, except that pieces of long documents meet again by a row number.
"""

from __future__ import annotations

import json
import os
import re
from bisect import bisect_left
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize
from .texts import bounded_batches, unused

#: Characters with the Unicode property White_Space.
SPACE = "\t-\r \x85\xa0  -     　"
#: Letters whose lower case is one letter (all but U+0130 in this range).
_LETTER = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u02af"
_MARK = "!-&(-/:-@\\[-`{-~"
#: A word before a mark, space or the end; marks before a word, space or the end; else all up to a space.
_INNER = f"[{_LETTER}]++(?=[{_MARK}{SPACE}]|\\Z)|[{_MARK}]++(?=[A-Za-z0-9{SPACE}]|\\Z)|[^{SPACE}]+"
#: Units without the spaces; a unit with one space before it, and runs of space as byte-level tokenizers split them.
UNITS = {"word": re.compile(_INNER), "byte": re.compile(f" ?(?:{_INNER})|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")}
LONG, LEAF = 64, 32
#: Units that a worker remembers, some 160 bytes each; several workers share an executor.
REMEMBERED = 200_000


def join(left: list[int], right: list[int], text_of: Callable[[list[int]], str], encode: Callable[[str, bool], list[int]], end: bool) -> list[int]:
    """Tokens of two encoded neighbours as one. ``end``: the right one ends the unsplit text.

    encode(text, end) gives tokens of a stretch of the unsplit text.
    """
    if not left or not right:
        return left + right
    i = j = 1
    while True:
        whole = end and j == len(right)
        window = encode(text_of(left[-i:] + right[:j]), whole)
        agree_left = i == len(left) or window[0] == left[-i]
        agree_right = j == len(right) or window[-1] == right[j - 1]
        if agree_left and agree_right:
            return left[:-i] + window + right[j:]
        if not agree_left:
            i = min(2 * i, len(left))
        if not agree_right:
            j = min(2 * j, len(right))


def tree(text: str, end: bool, text_of: Callable[[list[int]], str], encode: Callable[[str, bool], list[int]]) -> list[int]:
    """Tokens of a long unsplit text: leaves on their own, then joins in pairs, level by level."""
    n = max(1, -(-len(text) // LEAF))
    parts = [encode(text[k * LEAF : (k + 1) * LEAF], end and k == n - 1) for k in range(n)]
    while len(parts) > 1:
        paired = [join(parts[k], parts[k + 1], text_of, encode, end and k + 2 == len(parts)) for k in range(0, len(parts) - 1, 2)]
        parts = paired + parts[len(paired) * 2 :]
    return parts[0]


def byte_characters() -> list[str]:
    """The printable character that byte-level models use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    at = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(other)}
    return [at[b] for b in range(256)]


class Remembered(dict):
    """Ids of a unit, as bytes; a unit that isn't there is encoded."""

    def __init__(self, encode: Callable[[str], bytes]):
        super().__init__()
        self.encode = encode

    def __missing__(self, unit: str) -> bytes:
        out = self.encode(unit)
        if len(unit) <= LONG:
            self[unit] = out
        return out


class Encoder:
    """Encodes and decodes with one tokenizer file; one object a worker."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.path, self.remembered = path, remembered
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kind = "word" if spec["model"].get("end_of_word_suffix") else "byte"
        self.units, self.suffix = UNITS[kind], spec["model"].get("end_of_word_suffix") or ""
        self.one = re.compile(f" ?(?:[{_LETTER}]+|[{_MARK}]+)" if kind == "byte" else f"[{_LETTER}]+|[{_MARK}]+")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.marker = os.path.commonprefix(list(self.special))
        self.seen = Remembered(self.unit)
        self._open = None

    def encode_stretch(self, text: str, end: bool) -> list[int]:
        """Tokens of a stretch of one pre-token, in the model's own alphabet."""
        if end or not self.suffix:
            return [t.id for t in self.model.tokenize(text)]
        if self._open is None:  # the same merges without the mark of a word's end
            from tokenizers.models import BPE

            with open(self.path, encoding="utf-8") as f:
                model = json.load(f)["model"]
            self._open = BPE(model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]])
        return [t.id for t in self._open.tokenize(text)]

    def text_of(self, ids: list[int]) -> str:
        return "".join(self.model.id_to_token(k).removesuffix(self.suffix) if self.suffix else self.model.id_to_token(k) for k in ids)

    def pretokens(self, text: str) -> list[str]:
        t = self.tokenizer
        return [p for p, _ in t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(text) if t.normalizer else text)]

    def long_unit(self, unit: str, open_end: bool = False) -> list[list[int]]:
        """Tokens of each pre-token; ``open_end``: the last goes on in the next piece."""
        tokens = self.pretokens(unit)
        out = []
        for k, p in enumerate(tokens):
            end = not (open_end and k == len(tokens) - 1)
            out.append(tree(p, end, self.text_of, self.encode_stretch) if len(p) > LEAF else self.encode_stretch(p, end))
        return out

    def unit(self, unit: str) -> bytes:
        """Ids of a unit. A word or a run of marks is one pre-token, which the library's model takes as it is."""
        if len(unit) > LONG:
            ids = [i for p in self.long_unit(unit) for i in p]
        elif self.one.fullmatch(unit):
            text = unit.lower() if self.suffix else unit
            ids = [t.id for t in self.model.tokenize(text.translate(_BYTES) if text.isascii() else "".join(map(_CHARACTERS.__getitem__, text.encode())))]
        else:
            ids = self.tokenizer.encode(unit, add_special_tokens=False).ids
        return np.array(ids, np.uint32).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as unsigned 32-bit integers in a row."""
        if len(self.seen) > self.remembered:
            self.seen.clear()
        get, find, out = self.seen.__getitem__, self.units.findall, []
        for t in texts:
            if self.at_special and self.marker in t:
                parts = self.at_special.split(t)
                out.append(b"".join(np.uint32(self.special[p]).tobytes() if k % 2 else b"".join(map(get, find(p))) for k, p in enumerate(parts)))
            else:
                out.append(b"".join(map(get, find(t))))
        return out

    @property
    def strings(self) -> list[str | None]:
        """Token string by id."""
        if not hasattr(self, "_strings"):
            t = self.tokenizer
            self._strings = [t.id_to_token(k) for k in range(t.get_vocab_size(with_added_tokens=True))]
        return self._strings

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        if self.tokenizer.decoder is None:  # then the library puts single spaces between the tokens
            s = self.strings
            return [" ".join([s[k] for k in row.tolist()]) for row in ids]
        return self.tokenizer.decode_batch([row.tolist() for row in ids], skip_special_tokens=False)


_CHARACTERS = byte_characters()
_BYTES = {b: _CHARACTERS[b] for b in range(128)}


@lru_cache(maxsize=2)
def encoder(path: str, remembered: int = REMEMBERED) -> Encoder:
    return Encoder(path, remembered)


def _some(texts: list[str], most: int = 2_000_000):
    i = total = 0
    for j, t in enumerate(texts):
        if j > i and total + len(t) > most:
            yield i, j
            i, total = j, 0
        total += len(t)
    if i < len(texts):
        yield i, len(texts)


def _list_array(rows: list[bytes]) -> pa.Array:
    ends = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) // 4 for r in rows], out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(rows), np.int32)))


def _ids(texts: pa.Array, path: str) -> pa.Array:
    values = [t or "" for t in texts.to_pylist()]
    e, out = encoder(path), []
    for i, j in _some(values):
        out += e.encode(values[i:j])
    return _list_array(out)


def encoded(text: Column, path: str) -> Column:
    """array<int> of a text's ids."""
    return F.arrow_udf(lambda texts: _ids(texts, path), "array<int>")(text)


def decoded(ids: Column, path: str) -> Column:
    """Text of a row's ids, special tokens included."""

    def decode(rows: pa.Array) -> pa.Array:
        e = encoder(path)
        if rows.null_count == 0:
            ends, flat = rows.offsets.to_numpy(), rows.values.to_numpy()
            return pa.array(e.decode([flat[ends[k] : ends[k + 1]] for k in range(len(rows))]), pa.string())
        return pa.array([None if r is None else e.decode([np.array(r, np.int64)])[0] for r in rows.to_pylist()], pa.string())

    return F.arrow_udf(decode, "string")(ids)


PIECES = "array<struct<at:int,piece:string,glued:boolean>>"
#: Letters that compose with no letter after them and whose lower case doesn't depend on others.
_PLAIN = "A-Za-z\u0410-\u044f\u05d0-\u05ea\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fff\uac00-\ud7a3"
#: Between the third and the fourth of four letters a word goes on, whatever stands before them.
_WORDS = re.compile(f"[{_PLAIN}]{{4}}")
_SPACES, _RUNS = re.compile(f"[{SPACE}]"), re.compile(f"[{SPACE}]+")
_SPACE_SET = frozenset(c for c in map(chr, range(0x3001)) if _RUNS.match(c))


def pieces_of(text: str, most: int, at_special: re.Pattern | None = None) -> list[tuple[int, str, bool]]:
    """Pieces of about ``most`` characters: cut where white space begins or, in text without any, between two letters of a word
    outside special tokens; such a piece is glued to the next. White space that is longer than that is cut before its last
    character. Text with none of these stays whole."""
    out, at = [], 0
    specials = [m.span() for m in at_special.finditer(text)] if at_special else []
    begins = [i for i, _ in specials]

    def free(c: int) -> bool:
        k = bisect_left(begins, c) - 1
        return k < 0 or specials[k][1] <= c

    def space_cut(start: int, end: int, last: bool) -> int | None:
        """Where the last (or first) white space met from start to end begins, or what cuts one that began at the piece's begin."""
        runs = _RUNS.finditer(text, start, end)
        found = next(runs, None)
        for found in runs if last else ():  # noqa: B007
            pass
        if found is None:
            return None
        cut = found.start()
        while cut > at and text[cut - 1] in _SPACE_SET:
            cut -= 1
        if cut > at:
            return cut
        end = _RUNS.match(text, found.start()).end()
        k = bisect_left(begins, end)
        end -= not (k < len(begins) and begins[k] == end)  # before a special token white space is whole
        return end if at < end < len(text) - 1 else None

    while len(text) - at > most:
        cut, glued = space_cut(at + most // 2, at + most, True), False
        if cut is None:
            inside = (m.start() + 3 for m in _WORDS.finditer(text, at + most // 2))
            cut, glued = next((c for c in inside if free(c)), None), True
            space = space_cut(at + most // 2, len(text) if cut is None else cut, False)
            if cut is None and space is None:
                break
            if space is not None:
                cut, glued = space, False
        out.append((len(out), text[at:cut], glued))
        at = cut
    return [*out, (len(out), text[at:], False)]


class Piece:
    """Ids of a stretch of text, those of its first and last pre-token where they go on outside it, and whether it is one pre-token."""

    def __init__(self, ids: list[int], first: int, last: int, single: bool, glued: bool):
        self.ids, self.first, self.last, self.single, self.glued = ids, first, last, single, glued

    def then(self, other: Piece, e: Encoder) -> Piece:
        if not self.glued:
            return Piece(self.ids + other.ids, self.first, other.last, False, other.glued)
        before, after = self.ids[: len(self.ids) - self.last], other.ids[other.first :]
        met = join(self.ids[len(before) :], other.ids[: other.first], e.text_of, e.encode_stretch, not (other.glued and other.single))
        first = len(met) if self.single else self.first
        last = len(met) if other.single else other.last
        return Piece(before + met + after, first, last, self.single and other.single, other.glued)


def concatenated(pieces: list[Piece], e: Encoder) -> Piece:
    """Pieces in order as one, joined in pairs, level by level."""
    while len(pieces) > 1:
        paired = [pieces[k].then(pieces[k + 1], e) for k in range(0, len(pieces) - 1, 2)]
        pieces = paired + pieces[len(paired) * 2 :]
    return pieces[0]


BOTH_DDL = "struct<ids:array<int>,text:string>"


def _both(ids: pa.ListArray, path: str) -> pa.StructArray:
    """Ids and what they decode to, in the worker that has them."""
    ends, flat, e, texts = ids.offsets.to_numpy(), ids.values.to_numpy(), encoder(path), []
    for k in range(0, len(ids), 100):
        texts += e.decode([flat[ends[i] : ends[i + 1]] for i in range(k, min(k + 100, len(ids)))])
    return pa.StructArray.from_arrays([ids, pa.array(texts, pa.string())], names=["ids", "text"])


def encode(df: DataFrame, path: str, text_col: str = "text", out_col: str = "ids", split_chars: int = 1 << 16, decoded_col: str | None = None) -> DataFrame:
    """``df``, the ids of its texts in ``out_col`` and, if named, the text they decode to in ``decoded_col``.

    Texts above ``split_chars`` are cut into pieces that separate tasks encode.
    """
    row, both = unused(df, "row"), unused(df, "both")
    text = F.coalesce(F.col(text_col), F.lit(""))
    bounded_batches(df.sparkSession)
    is_long = F.length(text) > split_chars
    result = lambda ids: _both(ids, path) if decoded_col else ids
    kind = BOTH_DDL if decoded_col else "array<int>"
    short = df.filter(~is_long).withColumn(both, F.arrow_udf(lambda texts: result(_ids(texts, path)), kind)(F.col(text_col)))

    def cut(texts: pa.Array) -> pa.Array:
        return pa.array([[{"at": a, "piece": p, "glued": g} for a, p, g in pieces_of(t, split_chars // 4, encoder(path).at_special)] for t in texts.to_pylist()], pa.list_(pa.struct([("at", pa.int32()), ("piece", pa.string()), ("glued", pa.bool_())])))

    def encode_piece(piece: pa.Array, glued: pa.Array, after: pa.Array) -> pa.Array:
        e, rows = encoder(path), []
        for p, g, a in zip(piece.to_pylist(), glued.to_pylist(), after.to_pylist(), strict=True):
            if not (g or a):
                rows.append({"ids": np.frombuffer(e.encode([p])[0], np.int32), "first": 0, "last": 0, "single": False})
                continue
            spaces, specials = [m.start() for m in _SPACES.finditer(p)], [m.span() for m in e.at_special.finditer(p)] if e.at_special else []
            head = min([*spaces, *(i for i, _ in specials)], default=len(p)) if a else 0
            tail = max([*spaces, *(j for _, j in specials)], default=0) if g else len(p)
            if head > tail:
                one = e.long_unit(p, g)
                rows.append({"ids": [i for t in one for i in t], "first": len(one[0]), "last": len(one[-1]), "single": len(one) == 1})
                continue
            one, two = (e.long_unit(p[:head]) if a else []), (e.long_unit(p[tail:], True) if g else [])
            middle = np.frombuffer(e.encode([p[head:tail]])[0], np.int32).tolist()
            ids = [i for t in one for i in t] + middle + [i for t in two for i in t]
            rows.append({"ids": ids, "first": len(one[0]) if one else 0, "last": len(two[-1]) if two else 0, "single": False})
        return pa.array(rows, pa.struct([("ids", pa.list_(pa.int32())), ("first", pa.int32()), ("last", pa.int32()), ("single", pa.bool_())]))

    def concatenate(parts: pa.Array) -> pa.Array:
        e, out = encoder(path), []
        for row in parts.to_pylist():
            whole = concatenated([Piece(p["ids"], p["first"], p["last"], p["single"], p["glued"]) for p in row], e)
            out.append(np.array(whole.ids, np.int32).tobytes())
        return result(_list_array(out))

    long = df.filter(is_long).withColumn(row, F.monotonically_increasing_id())
    long = materialize(long, "long")
    parts = long.select(F.col(row).alias("row"), F.explode(F.arrow_udf(cut, PIECES)(F.col(text_col))).alias("p")).select("row", "p.*")
    after = F.coalesce(F.lag("glued").over(Window.partitionBy("row").orderBy("at")), F.lit(False))
    parts = parts.withColumn("after", after).repartition(F.xxhash64("row", "at"))
    done = parts.select("row", "at", "glued", F.arrow_udf(encode_piece, "struct<ids:array<int>,first:int,last:int,single:boolean>")("piece", "glued", "after").alias("e"))
    whole = done.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", "glued", "e.ids", "e.first", "e.last", "e.single"))).alias("parts"))
    whole = whole.select(F.col("row").alias(row), F.arrow_udf(concatenate, kind)("parts").alias(both))
    done_all = short.unionByName(long.join(whole.hint("merge"), row).drop(row))
    kept = [c for c in df.columns if c.lower() not in (out_col.lower(), (decoded_col or out_col).lower())]
    if decoded_col:
        return done_all.select(*kept, F.col(f"{both}.ids").alias(out_col), F.col(f"{both}.text").alias(decoded_col))
    return done_all.select(*kept, F.col(both).alias(out_col))
