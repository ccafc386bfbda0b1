"""Benchmark decontamination by template canonicalisation.

Texts become templates: numbers, capitalised names and units after numbers are replaced
by typed placeholders, all other words are lower-cased. A numeral with separators or
decimals, a compound number word and a run of names are one placeholder each. Windows of
SIZE template tokens (an item with fewer is one window) are hash-joined between documents
and benchmark items. Matches of one document and item are put together, of one alignment
and of alignments near each other, and the values in their slots are compared: a value of
the item must stand for the same value of the document wherever it occurs. Enough matching
windows, or enough of the item's tokens covered by them, with consistent slots are a leak,
verbatim if all slots have the item's values and re-parameterised if not.

Each window is taken in two forms: with placeholders for names, and with names as
lower-case words, which finds copies in other case. Items that have no window in these
forms (short ones, and those of numbers mostly) are taken literally: windows of their
lower-cased tokens, numbers as they are. Items in a script without spaces, and those
without any token, are taken as windows of RUN bytes (a shorter one is one window) of
the text in lower case without white space. Literal windows have no slots. A very short
item so matches wherever it stands.

Only windows whose hash is in a bitmap of the benchmark's hashes leave the scan. The
bitmap has a fixed size, so it is sent to all tasks whatever the benchmark's size. Items'
windows are broadcast up to BROADCAST bytes; everything else is joined by sorting, as Spark
goes by the bytes of a file, and rows that repeat take many times those in memory.

Defined results: null texts and texts of white space match nothing; every other item
has a window.
Repeated documents are found each; null ids match as ids of their own. An empty
document or benchmark table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joins import merged
from ..storage import materialize
from .texts import bounded_batches, chunks, encoded, joined, mixed, powers

SIZE, LEAST = 10, 5
#: Bytes of a window of the last form.
RUN = 30
#: Forms: names as placeholders, names as words, literal tokens, bytes.
NAMES, LOWER, LITERAL, BYTES = range(4)
#: Least part of an item's tokens that matching windows cover, where they are fewer than the share asked for.
COVERED = 0.8
#: Least share of a window's tokens that are words and not placeholders.
WORDS = 0.4
BITS = 23
#: Bytes of the rows of the items' windows up to which these are broadcast, and those that a row has in the table that is sent, without its slots.
BROADCAST, ROW = 16 << 20, 170
# Number words, and units that may follow a number.
NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion trillion dozen".split()
SCALES = "hundred thousand million billion trillion dozen".split()
AND = ["and"]
UNITS = "mm millimeter millimeters millimetre millimetres cm centimeter centimeters centimetre centimetres m meter meters metre metres km kilometer kilometers kilometre kilometres inch inches foot feet ft yard yards yd mile miles mi mg milligram milligrams g gram grams kg kilogram kilograms oz ounce ounces lb lbs pound pounds ton tons tonne tonnes ml milliliter milliliters millilitre millilitres l liter liters litre litres pint pints quart quarts cup cups gallon gallons s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years decade decades century centuries dollar dollars cent cents euro euros penny pennies percent degree degrees celsius fahrenheit mph kmh kph acre acres hectare hectares watt watts volt volts byte bytes kb mb gb".split()

_BYTE = np.random.default_rng(909).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0xA0761D6478BD642F
_INVERSE = pow(_BASE, -1, 1 << 64)
_CLASS, _LOWER = np.zeros(256, np.int8), np.arange(256, dtype=np.uint8)
_CLASS[48:58] = 1
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 2
_LOWER[65:91] += 32
#: Scripts that are written without spaces between words.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
NUMBER, NAME, UNIT = (np.uint64(k) for k in (1, 2, 3))


class Template:
    """Tokens of some texts in each form (bytes, in the last): bytes, begins, ends, the text each is in, and its
    code, a placeholder or a word's hash."""

    def __init__(self, texts: list[bytes], by_bytes: bool = True):
        self.bytes, self.starts = joined(texts, b"", b" ")
        b = self.bytes
        kind = _CLASS[b]
        edge = np.concatenate([[True], kind[1:] != kind[:-1]])
        at = np.flatnonzero(edge)
        end = np.append(at[1:], len(b))
        token = kind[at] > 0
        begin, end = at[token], end[token]
        first = kind[begin]
        total = np.zeros(len(b) + 1, np.uint64)
        self.low = low = _LOWER[b]
        latin = (b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E) & (b[1:] != 0x97)
        low[1:][latin] += 32
        np.cumsum(_BYTE[low] * powers(len(b), _BASE), out=total[1:])
        code = mixed((total[end] - total[begin]) * powers(len(b) + 1, _INVERSE)[begin])
        head = b[begin]
        second = b[np.minimum(begin + 1, len(b) - 1)]
        # an upper-case letter of ASCII or of Latin-1, whose first byte in UTF-8 is 0xC3
        name = (first == 2) & (((head >= 65) & (head <= 90)) | ((head == 0xC3) & (second >= 0x80) & (second <= 0x9E)))
        literal = code.copy(), begin, end
        spelt, digits, scale, joint = _among(code, NUMBERS), first == 1, _among(code, SCALES), _among(code, AND)
        text = every = np.searchsorted(self.starts, begin, side="right") - 1
        # what stands between a token and the one before it
        ink = np.concatenate([[0], np.cumsum(~_SPACE[b])])
        gap, sign = begin[1:] - end[:-1], b[np.minimum(end[:-1], len(b) - 1)]
        same = text[1:] == text[:-1]
        near = same & ((ink[begin[1:]] == ink[end[:-1]]) | ((gap == 1) & (sign == 45)))
        part = same & digits[1:] & digits[:-1] & (gap == 1) & ((sign == 46) | ((sign == 44) & (end[1:] - begin[1:] == 3)))
        word = near & spelt[1:] & (spelt[:-1] | (digits[:-1] & scale[1:]))
        follows = np.zeros(len(begin), bool)
        follows[1:] = part | word
        both = near[:-1] & near[1:] & scale[:-2] & joint[1:-1] & spelt[2:]  # "hundred and five"
        follows[1:-1] |= both
        follows[2:] |= both
        number = digits | spelt | (follows & joint)
        begin, end, (code, number, name, text) = _run(follows, begin, end, code, number, name, text)
        unit = _among(code, UNITS)
        unit[1:] &= number[:-1] & (text[1:] == text[:-1])
        unit[:1] = False
        code[number] = NUMBER
        code[unit] = UNIT
        name &= ~number & ~unit
        follows = np.zeros(len(begin), bool)
        follows[1:] = name[1:] & name[:-1] & (text[1:] == text[:-1])
        follows[1:] &= (ink[begin[1:]] == ink[end[:-1]]) | ((begin[1:] - end[:-1] == 1) & (b[np.minimum(end[:-1], len(b) - 1)] == 45))
        first_form = _run(follows, begin, end, np.where(name, NAME, code), text)
        dark = np.flatnonzero(~_SPACE[b]) if by_bytes else np.zeros(0, np.int64)
        self.begins, self.ends = [first_form[0], begin, literal[1], dark], [first_form[1], end, literal[2], dark + 1]
        self.codes = [first_form[2][0], code, literal[0], _BYTE[low[dark]]]
        self.texts = [first_form[2][1], text, every, np.searchsorted(self.starts, dark, side="right") - 1]
        self.words = [c > UNIT if form < LITERAL else np.ones(len(c), bool) for form, c in enumerate(self.codes)]

    def windows(self, size: int, form: int) -> tuple[np.ndarray, np.ndarray]:
        """First tokens and hashes of the windows of ``size`` tokens that lie in one text and have words enough."""
        code, word, text = self.codes[form], self.words[form], self.texts[form]
        n = len(code)
        if n < size:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(mixed(code + np.uint64(0x9E37)) * powers(n, _BASE), out=total[1:])
        h = mixed((total[size:] - total[:-size]) * powers(n - size + 1, _INVERSE) + np.uint64(4 * size + form))
        words = np.concatenate([[0], np.cumsum(word)])
        good = (text[size - 1 :] == text[: n - size + 1]) & (words[size:] - words[:-size] >= WORDS * size)
        at = np.flatnonzero(good)
        return at, h[at]

    def slots(self, at: int, size: int, form: int) -> list[str]:
        """Values in the placeholders of a window, in order, each with its kind."""
        out = []
        for k in range(at, at + size):
            if not self.words[form][k]:
                value = self.bytes[self.begins[form][k] : self.ends[form][k]].tobytes().decode("utf-8", "replace").lower()
                out.append(f"{int(self.codes[form][k])}:{' '.join(value.split())}")
        return out


def _run(follows: np.ndarray, begin: np.ndarray, end: np.ndarray, *columns: np.ndarray) -> tuple:
    """Begins, ends and columns of the tokens, each with those that follow it as one, with the first one's columns."""
    at = np.flatnonzero(~follows)
    last = np.append(at[1:], len(follows)) - 1 if len(at) else at
    return begin[at], end[last], tuple(c[at] for c in columns)


def _hashes(words: list[str]) -> np.ndarray:
    out = []
    for w in words:
        b = np.frombuffer(w.encode(), np.uint8)
        out.append(mixed((_BYTE[b] * powers(len(b), _BASE)).sum(keepdims=True))[0])
    return np.sort(np.array(out, np.uint64))


_KNOWN: dict[int, np.ndarray] = {}


def _among(code: np.ndarray, words: list[str]) -> np.ndarray:
    if id(words) not in _KNOWN:
        _KNOWN[id(words)] = _hashes(words)
    known = _KNOWN[id(words)]
    return known[np.minimum(np.searchsorted(known, code), len(known) - 1)] == code


WINDOW_DDL = "id bigint, row bigint, form int, at int, size int, hash bigint, slots array<string>, tokens int"


def _all_sizes() -> list[tuple[int, int]]:
    template = [(size, form) for form in (NAMES, LOWER) for size in range(LEAST, SIZE + 1)]
    return template + [(size, LITERAL) for size in range(1, SIZE + 1)] + [(size, BYTES) for size in range(1, RUN + 1)]


def _window_rows(sizes: list[tuple[int, int]] | None, bitmap: bytes | None):
    """Windows of documents (of ``sizes`` and forms, if the bitmap has their hash) or of items (sizes None: SIZE, or all of a short one)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(bitmap, np.uint8)).view(bool) if bitmap is not None else None
        for b in batches:
            texts, ids, rows = encoded(b["text"]), b["id"].to_pylist(), b["row"].to_pylist()
            for i, j in chunks(texts):
                t = Template(texts[i:j], bits is None or any(form == BYTES for _, form in sizes))
                counts = [np.bincount(x, minlength=j - i) for x in t.texts]
                out: dict[str, list] = {k: [] for k in ("id", "row", "form", "at", "size", "hash", "slots", "tokens")}
                firsts = [np.searchsorted(x, np.arange(j - i)) for x in t.texts]
                seen = np.zeros((4, j - i), bool)  # items that have a window in this form or an earlier one
                unspaced = np.array([bool(_UNSPACED.search(x.decode("utf-8", "replace"))) for x in texts[i:j]]) if bits is None else None
                for size, form in sizes if sizes is not None else _all_sizes():
                    at, h = t.windows(size, form)
                    text, count, first = t.texts[form], counts[form], firsts[form]
                    if bits is not None:
                        hit = bits[(h >> np.uint64(64 - BITS)).astype(np.int64)]
                    else:
                        most = RUN if form == BYTES else SIZE
                        hit = (count[text[at]] == size) | (size == most) & (count[text[at]] > most)
                        if form == LITERAL:
                            hit &= ~seen[LOWER][text[at]]
                        elif form == BYTES:
                            hit &= (unspaced | ~seen[LITERAL])[text[at]]
                        for k in range(form, 4):
                            seen[k][text[at[hit]]] = True
                    for p, x in zip(at[hit].tolist(), h[hit].view(np.int64).tolist(), strict=True):
                        k = int(text[p])
                        out["id"].append(ids[i + k])
                        out["row"].append(rows[i + k])
                        out["form"].append(form)
                        out["at"].append(p - int(first[k]))
                        out["size"].append(size)
                        out["hash"].append(x)
                        out["slots"].append(t.slots(p, size, form) if form < LITERAL else [])
                        out["tokens"].append(int(count[k]))
                if out["id"]:
                    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(v, ty) for v, ty in zip(out.values(), types, strict=True)], names=list(out))

    return run


def leaks(documents: DataFrame, benchmark: DataFrame, share: float = 0.5, consistent: float = 0.9, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, doc_id, item_id, matched, share, slots, changed, kind: the leaks found.

    share: least part of an item's windows that one alignment matches, or several near each
    other do. consistent: least part of its slots that agree with the most frequent reading of their value. ``row``
    is the document's place in the scan.
    """
    bounded_batches(documents.sparkSession)
    items = benchmark.select(F.col("item_id").cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), "text")
    known = materialize(items.mapInArrow(_window_rows(None, None), WINDOW_DDL), "templates")
    bits = np.zeros(1 << BITS, bool)
    places = known.select(F.shiftrightunsigned("hash", 64 - BITS).alias("bit")).distinct().toArrow()["bit"]  # 2**BITS long integers at most
    bits[places.to_numpy()] = True
    held = known.groupBy("size", "form").agg(F.sum(ROW + 16 * F.size("slots") + F.octet_length(F.concat_ws("", "slots"))).alias("bytes")).collect()  # those of _all_sizes at most
    sizes, small = sorted((r["size"], r["form"]) for r in held), sum(r["bytes"] for r in held) <= BROADCAST
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    found = docs.mapInArrow(_window_rows(sizes, np.packbits(bits).tobytes()), WINDOW_DDL)
    per_item = known.groupBy("row", "form").agg(F.count("*").alias("windows"))
    how = "broadcast" if small else "merge"
    i = known.join(per_item.hint(how), ["row", "form"]).select(F.col("id").alias("item_id"), F.col("row").alias("item"), F.col("at").alias("item_at"), "form", "hash", F.col("slots").alias("item_slots"), "windows", "size", "tokens")
    d = found.select(F.col("id").alias("doc_id"), "row", "at", "hash", "slots")
    pairs = d.join(i.hint(how), "hash").filter(F.size("slots") == F.size("item_slots"))
    pairs = pairs.withColumn("shift", F.col("at") - F.col("item_at"))
    both = ["row", "doc_id", "item_id", "item", "form"]
    pairs = materialize(pairs.select(*both, "shift", "item_at", "windows", "size", "tokens", "slots", "item_slots"), "matches")
    # alignments belong together if no more lies between them than the item is long
    shifts = pairs.select("row", "item", "form", "shift", "tokens").distinct()
    in_order = Window.partitionBy("row", "item", "form").orderBy("shift")
    cut = F.coalesce(F.col("shift") - F.lag("shift").over(in_order) > F.greatest("tokens", F.lit(SIZE)), F.lit(False)).cast("int")
    chains = shifts.withColumn("cut", cut).withColumn("chain", F.sum("cut").over(in_order))
    several = chains.groupBy("row", "item", "form", "chain").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    runs = merged(chains, several, ["row", "item", "form", "chain"]).select("row", "item", "form", "shift", F.col("chain").cast("long").alias("run"))
    chained = merged(pairs, runs, ["row", "item", "form", "shift"])
    side = [*both, "single", "run"]
    pairs = pairs.withColumns({"single": F.lit(True), "run": F.col("shift").cast("long")}).unionByName(chained.withColumn("single", F.lit(False)))
    whole = pairs.groupBy(*side).agg(F.array_sort(F.collect_set("item_at")).alias("a"), F.first("windows").alias("windows"), F.first("size").alias("size"), F.first("tokens").alias("tokens"))
    covered = F.expr("size + aggregate(zip_with(slice(a, 2, size(a)), slice(a, 1, size(a) - 1), (y, x) -> y - x), 0, (s, g) -> s + least(g, size))")
    whole = whole.select(*side, F.size("a").cast("long").alias("matched"), "windows", (covered / F.col("tokens")).alias("covered"))
    slot = pairs.select(*side, F.explode(F.arrays_zip("item_slots", "slots")).alias("s")).select(*side, F.col("s.item_slots").alias("said"), F.col("s.slots").alias("reads"))
    reading = slot.groupBy(*side, "said", "reads").agg(F.count("*").alias("n"))
    by_value = reading.groupBy(*side, "said").agg(F.sum("n").alias("n"), F.max("n").alias("usual"), F.sum(F.when(F.col("said") != F.col("reads"), F.col("n")).otherwise(0)).alias("changed"))
    by_pair = by_value.groupBy(*side).agg(F.sum("n").alias("slots"), F.sum("usual").alias("usual"), F.sum("changed").alias("changed"))
    judged = merged(whole, by_pair.drop("doc_id", "item_id"), ["row", "item", "form", "single", "run"], "left").fillna(0, ["slots", "usual", "changed"])
    leak = ((F.col("matched") >= share * F.col("windows")) | (F.col("covered") >= COVERED)) & (F.col("usual") >= consistent * F.col("slots"))
    most = F.struct((F.col("matched") / F.col("windows")).alias("share"), "matched", "windows", "single", "slots", F.negate("changed").alias("same"))
    best = judged.filter(leak).groupBy("row", "doc_id", "item_id", "item").agg(F.max(most).alias("b"))
    return best.select(
        "row", "doc_id", "item_id", F.col("b.matched").alias("matched"), F.col("b.share").alias("share"), F.col("b.slots").alias("slots"),
        (-F.col("b.same")).alias("changed"), F.when(F.col("b.same") == 0, "verbatim").otherwise("re-parameterised").alias("kind"),
    )
