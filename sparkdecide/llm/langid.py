"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is lower-cased and everything but letters becomes a space. Its byte n-grams
that don't run across a word's end are hashed into a table of embeddings; their
mean goes through a linear softmax. Embeddings and softmax are trained by
stochastic gradient descent in numpy on a bounded sample of labelled texts. A
temperature fitted on texts kept out of the training makes the scores
probabilities, and a document is rejected if its score is below a threshold that
comes from the same texts.

Defined results: null texts and texts without a letter are ``und`` with score 0 and
rejected. Rows are independent: repeated rows give equal values. Other columns
pass through. An empty table gives an empty table: fitted on one, the model knows no language,
and every text is ``und`` with score 0 and rejected. Rows without any labelled text raise
ValueError when fitting. Texts above
``max_bytes`` are not in the sample that is learned from; their languages are predicted.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .samples import sampled
from .texts import chunks, joined

NGRAMS = (3, 4, 5)
BITS, DIMENSIONS = 16, 16
_FACTORS = np.random.default_rng(11).integers(1 << 30, 1 << 32, 8, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_LETTERS = np.full(256, 32, np.uint8)
for _k in (*range(97, 123), *range(128, 256)):
    _LETTERS[_k] = _k

RESULT = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])
RESULT_DDL = "struct<lang_pred:string,score:double,rejected:boolean>"


def subwords(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each n-gram (0: none here) in rows by n, and where each text begins."""
    raw, starts = joined([t.lower().encode("utf-8", "surrogatepass") for t in texts], b" ", b" ")
    b = np.concatenate([_LETTERS[raw], np.full(max(NGRAMS), 32, np.uint8)])
    letter = b != 32
    wide = b.astype(np.uint32)
    out = np.zeros((len(NGRAMS), len(raw)), np.int32)
    n = len(raw)
    for row, size in enumerate(NGRAMS):
        h = wide[:n] * _FACTORS[0] + np.uint32(size)
        for k in range(1, size):
            h += wide[k : k + n] * _FACTORS[k]
        inside = letter[1 : 1 + n].copy()
        for k in range(2, size - 1):
            inside &= letter[k : k + n]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h >>= np.uint32(32 - BITS)
        np.multiply(h + np.uint32(1), inside, out=out[row], casting="unsafe")
    return out, starts


@dataclass
class Model:
    langs: list[str]
    #: The softmax's share of each bucket: embeddings @ weights; row 0 is of no n-gram.
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, texts: list[str]) -> np.ndarray:
        ids, starts = subwords(texts)
        total = np.zeros((len(texts), len(self.langs)), np.float64)
        count = np.zeros(len(texts))
        for row in ids:
            total += np.add.reduceat(self.table[row], starts[:-1], axis=0)
            count += np.add.reduceat(row != 0, starts[:-1], dtype=np.int64)
        return total / np.maximum(count, 1)[:, None] + self.bias

    def probabilities(self, texts: list[str]) -> np.ndarray:
        return softmax(self.logits(texts) / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def train(texts: list[str], langs: list[str], *, epochs: int = 8, batch: int = 32, rate: float = 0.5, per_text: int = 400, max_false_reject: float = 0.002, seed: int = 7) -> Model:
    """Fit on four fifths of the texts; the others set temperature and threshold.

    per_text: n-grams drawn from the whole text at each step. The threshold lets
    ``max_false_reject`` of the other texts fall below it, and is 0.5 at most.
    """
    if not texts:
        raise ValueError("no labelled texts to learn from")
    rng = np.random.default_rng(seed)
    names = sorted(set(langs))
    y = np.array([names.index(v) for v in langs])
    grams = []
    for t in texts:
        ids = subwords([t])[0].ravel()
        grams.append(ids[ids != 0])
    held = np.arange(len(texts)) % 5 == 4
    fit = np.flatnonzero(~held & np.array([len(g) > 0 for g in grams]))
    e = np.zeros(((1 << BITS) + 1, DIMENSIONS), np.float32)
    w = rng.normal(0, 1, (DIMENSIONS, len(names))).astype(np.float32)
    bias = np.zeros(len(names), np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        order = rng.permutation(fit)
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            drawn = [rng.choice(grams[i], per_text) for i in some]
            ids = np.concatenate(drawn)
            mean = e[ids].reshape(len(some), per_text, -1).mean(axis=1)
            g = softmax(mean @ w + bias)
            g[np.arange(len(some)), y[some]] -= 1
            ge = g @ w.T
            w -= step / len(some) * (mean.T @ g)
            bias -= step / len(some) * g.sum(axis=0) * 0.1
            np.subtract.at(e, ids, np.repeat(ge * (step * 20 / per_text), per_text, axis=0))
    e[0] = 0
    model = Model(names, (e @ w).astype(np.float32), bias)
    rest = np.flatnonzero(held) if held.any() else fit
    logits = np.concatenate([model.logits([texts[i]]) for i in rest])
    grid = np.geomspace(0.2, 5, 40)
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(rest)), y[rest]], 1e-12)).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    top = softmax(logits / model.temperature)
    right = top.argmax(axis=1) == y[rest]
    if right.any():
        model.threshold = float(min(0.5, np.quantile(top.max(axis=1)[right], max_false_reject)))
    return model


def fit(labelled: DataFrame, *, per_lang: int = 700, max_bytes: int = 1 << 17, seed: int = 1) -> Model:
    """Train on a bounded sample of rows of doc_id, text, lang: about ``per_lang`` of each language, whole texts of
    ``max_bytes`` at most."""
    known = labelled.filter(F.col("lang").isNotNull() & (F.octet_length("text") <= max_bytes)).select("doc_id", "text", "lang")
    rows = sampled(known, "lang", per_lang, seed).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id", "text").collect()
    if not rows:
        if not labelled.isEmpty():
            raise ValueError("no labelled texts to learn languages from")
        return Model([], np.zeros((1, 1), np.float32), np.zeros(0))
    return train([r.text for r in rows], [r.lang for r in rows])


def prediction(text: Column, model: Model) -> Column:
    """struct(lang_pred, score, rejected) of a text."""

    def predict(texts: pa.Array) -> pa.Array:
        values = [t if t and any(map(str.isalpha, t)) else "" for t in texts.to_pylist()]
        lang, score = ["und"] * len(values), np.zeros(len(values))
        some = [i for i, v in enumerate(values) if v] if model.langs else []
        raw = [values[i].encode("utf-8", "surrogatepass") for i in some]
        for i, j in chunks(raw):
            p = model.probabilities([values[k] for k in some[i:j]])
            for k, row in zip(some[i:j], p, strict=True):
                lang[k], score[k] = model.langs[int(row.argmax())], float(row.max())
        no = [v == "" or not model.langs or s < model.threshold for v, s in zip(values, score, strict=True)]
        return pa.StructArray.from_arrays([pa.array(lang), pa.array(score), pa.array(no)], fields=list(RESULT))

    return F.arrow_udf(predict, RESULT_DDL)(text)
