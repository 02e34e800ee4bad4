"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Every passage of the whole text becomes a vector of measures of its
characters, words and repeats, which a hidden layer encodes; gated attention (Ilse, Tomczak and Welling 2018), learned
from document labels only, weighs the encoded passages, and the weighted sum is scored.

Learning takes at most SAMPLE[value] labelled documents of each label value (see labelled.sample); the model is a few
hundred numbers. Defined results: null and empty texts are one passage of nothing and get its score; equal texts have
equal scores; an empty table gives an empty result; without labels of both values every score is 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gemello.llm.labelled import held_out, sample
from gemello.llm.text import appended, flat, hashes, lower, mix, release, words

PASSAGE = 48
SAMPLE = {0: 1500, 1: 2000}
HIDDEN, GATE = 16, 8
EPOCHS, RATE, DECAY = 150, 0.03, 1e-3
SEED = 11

_KIND = np.zeros((6, 256), bool)
_KIND[0, 65:91] = True  # upper case
_KIND[1, 97:123] = True
_KIND[1, 0x80:] = True
_KIND[2, 48:58] = True
_KIND[3, list(b"#*$%&|<>@^~_=+{}[]\\")] = True
_KIND[4, list(b"!?")] = True
_KIND[5, list(b".,;:'\"()-/")] = True
MEASURES = 14


def passages(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The measures of all passages, and each text's offsets in them; a text without words has one passage."""
    data, offsets = flat(col)
    starts, ends, at = words(data, offsets)
    n_words = np.diff(at)
    doc = np.repeat(np.arange(len(n_words)), n_words)
    count = np.maximum(1, -(-n_words // PASSAGE))
    bag = np.append(0, np.cumsum(count))
    own = bag[doc] + (np.arange(len(doc)) - at[doc]) // PASSAGE
    n = int(bag[-1])
    size = np.bincount(own, minlength=n).astype(float)
    some = np.maximum(size, 1)
    x = np.zeros((n, MEASURES))
    length = (ends - starts).astype(float)
    chars = np.maximum(np.bincount(own, length, n), 1)
    for i in range(6):
        upto = np.append(0, np.cumsum(_KIND[i][data]))
        x[:, i] = np.bincount(own, upto[ends] - upto[starts], n) / chars
        if i in (3, 4):
            x[:, 3 + i] = np.bincount(own, upto[ends] > upto[starts], n) / some
    x[:, 8] = chars / some / 10
    h = hashes(lower(data), starts, ends)
    _, first = np.unique(h ^ mix(own.astype(np.uint64)), return_index=True)
    x[:, 9] = 1 - np.bincount(own[first], minlength=n) / some
    _, first = np.unique(h ^ mix(doc.astype(np.uint64) + np.uint64(1 << 40)), return_index=True)
    x[:, 10] = 1 - np.bincount(own[first], minlength=n) / some
    if len(h) > 1:
        same = np.append(False, (h[1:] == h[:-1]) & (doc[1:] == doc[:-1]))
        x[:, 11] = np.bincount(own, same, n) / some
    x[:, 12] = np.log1p(size) / 4
    x[:, 13] = size == 0
    x[size == 0, 8:12] = 0
    return x, bag


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def encoded(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def score(self, x: np.ndarray, bag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document scores and the attention of each passage."""
        return _forward(self.weights, self.encoded(x), bag)[:2]


def _forward(w: dict[str, np.ndarray], x: np.ndarray, bag: np.ndarray):
    h = np.maximum(x @ w["encode"] + w["encode0"], 0)
    t = np.tanh(h @ w["tanh"] + w["tanh0"])
    g = 1 / (1 + np.exp(-(h @ w["gate"] + w["gate0"])))
    e = np.exp(np.clip((t * g) @ w["attend"], -20, 20))
    total = np.repeat(np.add.reduceat(e, bag[:-1]), np.diff(bag)) if len(e) else e
    a = e / total
    z = np.add.reduceat(a[:, None] * h, bag[:-1], axis=0) if len(e) else np.zeros((0, h.shape[1]))
    p = 1 / (1 + np.exp(-np.clip(z @ w["out"] + w["out0"], -30, 30)))
    return p, a, h, t, g, z


def fitted(texts: list[str], labels: list[int]) -> Model | None:
    """A model of documents with labels 0 and 1, by full-batch Adam; both values weigh the same."""
    y = np.array(labels, float)
    if len(set(labels)) < 2:
        return None
    parts = [passages(pa.array(texts[i : i + 128], pa.string())) for i in range(0, len(texts), 128)]
    x = np.concatenate([p[0] for p in parts])
    bag = np.cumsum(np.concatenate([[0], *[np.diff(p[1]) for p in parts]]))
    model = Model(x.mean(0), x.std(0) + 1e-3, {})
    x = model.encoded(x)
    rng = np.random.default_rng(SEED)
    shape = {"encode": (MEASURES, HIDDEN), "encode0": (HIDDEN,), "tanh": (HIDDEN, GATE), "tanh0": (GATE,), "gate": (HIDDEN, GATE), "gate0": (GATE,), "attend": (GATE,), "out": (HIDDEN,), "out0": ()}
    w = {k: rng.normal(0, 0.3, s) if not k.endswith("0") else np.zeros(s) for k, s in shape.items()}
    m1, m2 = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    share = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    sizes = np.diff(bag)
    for step in range(1, EPOCHS + 1):
        p, a, h, t, g, z = _forward(w, x, bag)
        d = (p - y) * share
        dz = d[:, None] * w["out"]
        far = np.repeat(dz, sizes, axis=0)
        da = (far * h).sum(1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, bag[:-1]), sizes))
        dtg = de[:, None] * w["attend"]
        dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
        dh = (a[:, None] * far + dt @ w["tanh"].T + dg @ w["gate"].T) * (h > 0)
        grad = {"out": z.T @ d, "out0": d.sum(), "attend": (t * g).T @ de, "tanh": h.T @ dt, "tanh0": dt.sum(0), "gate": h.T @ dg, "gate0": dg.sum(0), "encode": x.T @ dh, "encode0": dh.sum(0)}
        for k in w:
            full = grad[k] + (DECAY * w[k] if not k.endswith("0") else 0)
            m1[k] = 0.9 * m1[k] + 0.1 * full
            m2[k] = 0.999 * m2[k] + 0.001 * full * full
            w[k] = w[k] - RATE * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    model.weights = w
    return model


def learned(documents: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0) -> Model | None:
    model = fitted(*sample(documents, labels, "quality", modulus, remainder, SAMPLE))
    release()
    return model


def scored(documents: DataFrame, model: Model | None, keep: list[str] | None = None) -> DataFrame:
    """documents[keep] with score, the probability of label 1, and the passage that weighs most."""

    def work(cols: list[pa.Array]) -> list:
        x, bag = passages(cols[0])
        if model is None:
            return [np.full(len(bag) - 1, 0.5), np.zeros(len(bag) - 1, np.int64)]
        p, a = model.score(x, bag)
        order = np.lexsort((-a, np.repeat(np.arange(len(bag) - 1), np.diff(bag))))
        return [p, order[bag[:-1]] - bag[:-1]]

    return appended(documents, ["text"], [T.StructField("score", T.DoubleType()), T.StructField("top_passage", T.LongType())], work, keep)


def classified(documents: DataFrame, labels: DataFrame, least: float = 0.3, modulus: int = 5, remainder: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= least) and top_passage."""
    out = scored(documents, learned(documents, labels, modulus, remainder), ["doc_id"])
    return out.select("doc_id", held_out(modulus, remainder).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"), "top_passage")
