"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it. Learned
filters over embedded bytes run through each chunk and are max-pooled; the mean
and the maximum of the chunks' pooled values go through one logistic unit to one
probability. Training is plain back-propagation with Adam on a bounded sample of
labelled texts.

Defined results: null and empty texts score as a chunk of padding. Rows are
independent: repeated rows give equal scores. Other columns pass through. An empty
table gives an empty table. Where only one label is known, every score is its share, and
0.5 where none is. Texts above ``max_bytes`` are not in the sample that is learned from;
they are scored whole like all others.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .samples import sampled
from .texts import encoded

CHUNK, STEP = 256, 192
EMBED, FILTERS, SPAN, STRIDE = 8, 16, 6, 2
POSITIONS = (CHUNK - SPAN) // STRIDE + 1
#: Chunks that go through the filters together; their windows fit a processor's cache.
_TOGETHER = 48


def cut(data: bytes) -> np.ndarray:
    """Chunks of CHUNK bytes, STEP apart, as rows; the last is padded with 0."""
    n = max(1, -(-(len(data) - (CHUNK - STEP)) // STEP))
    whole = np.frombuffer(data.ljust((n - 1) * STEP + CHUNK, b"\0"), np.uint8)
    return np.lib.stride_tricks.sliding_window_view(whole, CHUNK)[::STEP]


@dataclass
class Model:
    embed: np.ndarray
    kernel: np.ndarray
    offset: np.ndarray
    weight: np.ndarray
    bias: float

    def windows(self, rows: np.ndarray) -> np.ndarray:
        x = self.embed[rows].reshape(len(rows), CHUNK * EMBED)
        return np.lib.stride_tricks.sliding_window_view(x, SPAN * EMBED, axis=1)[:, :: STRIDE * EMBED].reshape(-1, SPAN * EMBED)

    def pooled(self, rows: np.ndarray) -> np.ndarray:
        out = np.empty((len(rows), FILTERS), np.float32)
        for i in range(0, len(rows), _TOGETHER):
            some = rows[i : i + _TOGETHER]
            out[i : i + _TOGETHER] = (self.windows(some) @ self.kernel).reshape(len(some), POSITIONS, FILTERS).max(axis=1)
        return np.maximum(out + self.offset, 0)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        out = np.empty(len(texts))
        i = 0
        while i < len(texts):  # some hundred chunks at once
            parts, n = [], 0
            while i + len(parts) < len(texts) and (n < 400 or not parts):
                parts.append(cut(texts[i + len(parts)]))
                n += len(parts[-1])
            starts = np.cumsum([0] + [len(p) for p in parts])
            p = self.pooled(np.concatenate(parts))
            mean = np.add.reduceat(p, starts[:-1], axis=0) / np.diff(starts)[:, None]
            x = np.concatenate([mean, np.maximum.reduceat(p, starts[:-1], axis=0)], axis=1)
            out[i : i + len(parts)] = 1 / (1 + np.exp(-np.clip(x @ self.weight + self.bias, -40, 40)))
            i += len(parts)
        return out


def train(texts: list[bytes], labels: list[int], *, prior: float | None = None, epochs: int = 8, batch: int = 32, rate: float = 0.01, per_text: int = 8, seed: int = 5) -> Model:
    """``per_text``: chunks drawn from all of a text at each step. ``prior``: the share of
    label 1 among all rows, where the sample's share differs."""
    y_all = np.array(labels, np.float32)
    if not 0 < y_all.mean() < 1:
        raise ValueError("both labels are needed")
    rng = np.random.default_rng(seed)
    m = Model(
        rng.normal(0, 0.5, (256, EMBED)).astype(np.float32), rng.normal(0, (SPAN * EMBED) ** -0.5, (SPAN * EMBED, FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32), np.zeros(2 * FILTERS, np.float32), 0.0,
    )
    names = ("embed", "kernel", "offset", "weight")
    moment = {k: [np.zeros_like(getattr(m, k)), np.zeros_like(getattr(m, k))] for k in names}
    pieces, t = [cut(x) for x in texts], 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            rows = [pieces[i] if len(pieces[i]) <= per_text else pieces[i][rng.choice(len(pieces[i]), per_text, replace=False)] for i in some]
            starts = np.cumsum([0] + [len(r) for r in rows])
            flat, size = np.concatenate(rows), np.diff(starts)
            win = m.windows(flat)
            conv = (win @ m.kernel).reshape(len(flat), POSITIONS, FILTERS)
            best = conv.argmax(axis=1)
            pool = np.maximum(np.take_along_axis(conv, best[:, None], 1)[:, 0] + m.offset, 0)
            doc = np.repeat(np.arange(len(some)), size)
            top = np.maximum.reduceat(pool, starts[:-1], axis=0)
            x = np.concatenate([np.add.reduceat(pool, starts[:-1], axis=0) / size[:, None], top], axis=1)
            p = 1 / (1 + np.exp(-np.clip(x @ m.weight + m.bias, -40, 40)))
            g = ((p - y_all[some]) / len(some)).astype(np.float32)
            gx = g[:, None] * m.weight
            gpool = (gx[:, :FILTERS] / size[:, None])[doc]
            is_top = pool == top[doc]
            gpool = (gpool + np.where(is_top, gx[:, FILTERS:][doc], 0)) * (pool > 0)
            chunk = np.repeat(np.arange(len(flat)), FILTERS)
            at_win = chunk * POSITIONS + best.ravel()
            taken, gp = win[at_win], gpool.ravel()
            column = np.tile(np.arange(FILTERS), len(flat))
            gk = np.zeros((FILTERS, SPAN * EMBED), np.float32)
            np.add.at(gk, column, taken * gp[:, None])
            ge = np.zeros_like(m.embed)
            first = best.ravel() * STRIDE
            bytes_at = flat[chunk[:, None], first[:, None] + np.arange(SPAN)]
            np.add.at(ge, bytes_at.ravel(), (m.kernel.T[column] * gp[:, None]).reshape(-1, EMBED))
            grads = {"embed": ge, "kernel": gk.T, "offset": gpool.sum(axis=0), "weight": x.T @ g + 1e-4 * m.weight}
            t += 1
            step = rate * (1 - 0.9 * epoch / epochs)
            for k in names:
                a, b = moment[k]
                a += 0.1 * (grads[k] - a)
                b += 0.001 * (grads[k] ** 2 - b)
                setattr(m, k, (getattr(m, k) - step * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)).astype(np.float32))
            m.bias -= step * float(g.sum()) * 10
    if prior is not None:
        share = float(np.clip(y_all.mean(), 1e-3, 1 - 1e-3))
        prior = float(np.clip(prior, 1e-3, 1 - 1e-3))
        m.bias += float(np.log(prior / (1 - prior)) - np.log(share / (1 - share)))
    return m


@dataclass
class Constant:
    """The model where only one label, or none, is known: its share, or one half."""

    share: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return np.full(len(texts), self.share)


def fit(documents: DataFrame, labels: DataFrame, *, per_label: int = 500, max_bytes: int = 1 << 17, seed: int = 3) -> Model | Constant:
    """Train on a bounded sample: about ``per_label`` whole texts of each label, of ``max_bytes`` at most.

    documents: doc_id, text. labels: doc_id, quality (0 or 1); of several labels of one document the lowest counts.
    """
    known = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    counts = {r[0]: r[1] for r in known.groupBy("quality").count().collect()}
    total = sum(counts.values())
    some = sampled(known, "quality", per_label, seed)  # some thousand ids at most, by per_label
    short = documents.filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= max_bytes)
    rows = short.select("doc_id", "text").join(F.broadcast(some), "doc_id").orderBy("doc_id", "text").collect()
    data = [(r.text or "").encode("utf-8", "surrogatepass") for r in rows]
    if len({r.quality for r in rows}) < 2:
        return Constant(counts.get(1, 0) / total if total else 0.5)
    return train(data, [r.quality for r in rows], prior=counts.get(1, 0) / total)


def score(text: Column, model: Model | Constant) -> Column:
    """Probability of label 1."""

    def scores(texts: pa.Array) -> pa.Array:
        return pa.array(model.scores(encoded(texts)), pa.float64())

    return F.arrow_udf(scores, "double")(text)
