"""Quality classifier: gated-attention multiple-instance learning.

A document is a bag of passages of PASSAGE words. Each passage is described by its words, hashed to
LEXICAL buckets, and by MARKS (shares of letter case, marks, repeated and distinct words, lengths), all
of them counted over the whole text. A passage is encoded (the buckets' embeddings are learned with the rest), gated attention gives
it a weight in its document, and the weighted sum of encodings is scored. Only
documents have labels; the attention learns which passages carry them.

Training takes labelled documents in the order of their ids' hashes, with all their passages: at most SAMPLE
of each label and at most SAMPLE_PASSAGES passages of each label, so that what comes to the driver is bounded (numbers, no texts).
Scoring covers every passage of every document.

Null and empty texts are one passage without words. Very long texts are read whole. Ties in the order of training rows go by id. Labels that contradict each
other on one doc_id, and null labels, are not learned from. With no labels of
one kind every score is the share of label 1 (0.5 without any). Repeated rows get
equal scores; a null doc_id is scored. Extra columns are ignored; `accepted` keeps them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fold, give_back, joined, slices, span_hashes, text_batches, written

PASSAGE = 48
SAMPLE = 1_500
#: Passages of documents of one label that training takes; the last document that begins within is taken whole.
SAMPLE_PASSAGES = 30_000
LEXICAL = 64
#: Characters of texts that are worked on at once.
SLICE = 400_000
HIDDEN = 12
ID = "label_id"
EPOCHS = 200
DECAY = 1e-3
#: A document is accepted from this score on.
ACCEPT = 0.3

_UPPER, _LOWER, _DIGIT, _STOP, _SHOUT, _SIGN, _PIPE, _OTHER, _SPACE = range(9)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[: ord(" ") + 1] = _SPACE
_KIND[65:91], _KIND[97:123], _KIND[128:], _KIND[48:58] = _UPPER, _LOWER, _LOWER, _DIGIT
for _marks, _kind in ((".,;:'\"-?()", _STOP), ("!", _SHOUT), ("#$%&*@^~+=<>\\/", _SIGN), ("|", _PIPE)):
    _KIND[[ord(c) for c in _marks]] = _kind
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
MARKS = ("upper", "digit", "stop", "shout", "sign", "pipe", "other", "mean_word", "distinct", "again", "all_upper", "log_words", "empty")
FEATURES = len(MARKS) + LEXICAL


def passages(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of all texts, and the text of each."""
    data, at = joined(texts)
    kind = _KIND[data]
    solid = kind != _SPACE
    edge = np.flatnonzero(np.diff(np.concatenate([[0], solid.view(np.int8), [0]])))
    starts, ends = edge[::2], edge[1::2]
    of = np.searchsorted(at, starts, "right") - 1
    n = np.bincount(of, minlength=len(texts))
    first = np.cumsum(n) - n
    bags = np.maximum(1, -(-n // PASSAGE))
    base = np.cumsum(bags) - bags
    who = np.repeat(np.arange(len(texts)), bags)
    out = np.zeros((len(who), FEATURES), np.float32)
    if not len(starts):
        out[:, len(MARKS) - 1] = 1
        return out, who
    mine = base[of] + (np.arange(len(of)) - first[of]) // PASSAGE
    words = np.bincount(mine, minlength=len(who))
    length = (ends - starts).astype(np.float64)
    chars = np.maximum(np.bincount(mine, length, minlength=len(who)), 1)
    for column, k in enumerate((_UPPER, _DIGIT, _STOP, _SHOUT, _SIGN, _PIPE, _OTHER)):
        run = np.concatenate([[0], np.cumsum(kind == k, dtype=np.int64)])
        own = run[ends] - run[starts]
        out[:, column] = np.bincount(mine, own, minlength=len(who)) / chars
        if k == _UPPER:
            loud = (own >= 2) & (own * 2 > length)
    names = span_hashes(data, starts, ends)
    with np.errstate(over="ignore"):
        pairs = np.unique(names ^ (mine.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
    some = np.maximum(words, 1)
    out[:, 7] = chars / some / 10
    out[:, 8] = np.bincount(mine[pairs], minlength=len(who)) / some
    again = np.concatenate([[False], (names[1:] == names[:-1]) & (mine[1:] == mine[:-1])])
    out[:, 9] = np.bincount(mine, again, minlength=len(who)) / some
    out[:, 10] = np.bincount(mine, loud, minlength=len(who)) / some
    out[:, 11] = np.log1p(words) / 4
    out[:, 12] = words == 0
    # Words without their capitals, hashed.
    folded = _FOLD[data]
    bucket = (span_hashes(folded, starts, ends) >> np.uint64(40)) % np.uint64(LEXICAL)
    held = np.bincount(mine * LEXICAL + bucket.astype(np.int64), minlength=len(who) * LEXICAL).reshape(-1, LEXICAL)
    out[:, len(MARKS) :] = np.sqrt(held / some[:, None])
    return out, who


class Attention:
    """Encoder, gated attention and scorer, in numpy; fitted by Adam on all bags at once."""

    def __init__(self, features: int, hidden: int = HIDDEN, seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        init = lambda *s: r.normal(0, 1 / np.sqrt(s[0]), s)
        self.p = {"W": init(features, hidden), "b": np.zeros(hidden), "V": init(hidden, hidden), "U": init(hidden, hidden), "a": init(hidden), "c": init(hidden), "d": np.zeros(1)}
        self.mean, self.scale = np.zeros(features), np.ones(features)

    def _forward(self, x: np.ndarray, first: np.ndarray, who: np.ndarray) -> dict:
        p = self.p
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * g) @ p["a"]
        e = np.exp(e - np.maximum.reduceat(e, first)[who])
        w = e / np.add.reduceat(e, first)[who]
        z = np.add.reduceat(w[:, None] * h, first)
        return {"h": h, "t": t, "g": g, "w": w, "z": z, "y": 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -40, 40)))}

    def scores(self, features: np.ndarray, who: np.ndarray) -> np.ndarray:
        """Scores of bags 0, 1, ...; who: the bag of each passage, in order."""
        first = np.flatnonzero(np.diff(who, prepend=-1))
        return self._forward((features - self.mean) / self.scale, first, who)["y"]

    def gradient(self, x: np.ndarray, first: np.ndarray, who: np.ndarray, label: np.ndarray, weight: np.ndarray) -> dict:
        """Of the weighted log loss, by parameter."""
        p, f = self.p, self._forward(x, first, who)
        dy = (f["y"] - label) * weight
        dz = dy[:, None] * p["c"]
        dh = f["w"][:, None] * dz[who]
        dw = (f["h"] * dz[who]).sum(1)
        de = f["w"] * (dw - np.add.reduceat(f["w"] * dw, first)[who])
        dt, dg = de[:, None] * p["a"] * f["g"] * (1 - f["t"] ** 2), de[:, None] * p["a"] * f["t"] * f["g"] * (1 - f["g"])
        dh = (dh + dt @ p["V"].T + dg @ p["U"].T) * (1 - f["h"] ** 2)
        return {"W": x.T @ dh, "b": dh.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "a": (f["t"] * f["g"]).T @ de, "c": f["z"].T @ dy, "d": dy.sum(keepdims=True)}

    def fit(self, features: np.ndarray, who: np.ndarray, label: np.ndarray, epochs: int = EPOCHS) -> "Attention":
        self.mean, self.scale = features.mean(0), features.std(0) + 1e-3
        x = (features - self.mean) / self.scale
        first = np.flatnonzero(np.diff(who, prepend=-1))
        # Both labels weigh the same in total.
        weight = np.where(label == 1, 0.5 / max(label.sum(), 1), 0.5 / max((1 - label).sum(), 1))
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(p) for k, p in self.p.items()}
        for step in range(1, epochs + 1):
            p, grad = self.p, self.gradient(x, first, who, label, weight)
            for k in p:
                g = grad[k] + DECAY * p[k]
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                p[k] -= 0.03 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self


class Constant:
    def __init__(self, value: float) -> None:
        self.value = value

    def scores(self, features: np.ndarray, who: np.ndarray) -> np.ndarray:
        return np.full(int(who[-1]) + 1 if len(who) else 0, self.value)


def training_ids(labels: DataFrame, column: str, sample: int) -> DataFrame:
    """doc_id, label of at most `sample` rows of each label, of least hash, none held out."""
    rows = labels.filter(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1) & (fold(F.col("doc_id")) != 0))
    rows = rows.groupBy("doc_id").agg(F.min(column).alias("label"), F.max(column).alias("most")).filter("label = most").select("doc_id", "label")
    first = [rows.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (0, 1)]
    return first[0].unionByName(first[1])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Attention | Constant:
    text_batches(docs.sparkSession)
    ids = training_ids(labels, "quality", sample).select(F.col("doc_id").cast("long").alias(ID), "label")

    def describe(batches):
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            for first, last in slices(texts, SLICE):
                x, who = passages(texts[first:last])
                ends = np.cumsum(np.bincount(who, minlength=last - first)) * FEATURES
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(x.reshape(-1)))
                yield pa.record_batch([b.column(ID).slice(first, last - first), b.column("label").slice(first, last - first), lists], names=["id", "label", "x"])
            give_back()

    # At most 2 * sample ids: bounded, so they are broadcast.
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col(ID)).select(ID, "label", "text").mapInArrow(describe, "id long, label int, x array<float>")
    rows = written(rows, "quality-bags")
    mine = Window.partitionBy("label").orderBy(F.xxhash64("id"), "id", F.xxhash64("x"))
    before = F.sum(F.size("x") / FEATURES).over(mine.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("before", before).filter(F.coalesce("before", F.lit(0)) < SAMPLE_PASSAGES).select("label", "x").toArrow()
    label = rows.column("label").to_numpy()
    if len(set(label)) < 2:
        return Constant(float(label.mean()) if len(label) else 0.5)
    x = [np.asarray(f, np.float32).reshape(-1, FEATURES) for f in rows.column("x").to_numpy()]
    # The order in which rows arrive must not matter.
    order = sorted(range(len(x)), key=lambda i: (label[i], x[i].tobytes()))
    who = np.repeat(np.arange(len(x)), [len(x[i]) for i in order])
    return Attention(FEATURES).fit(np.concatenate([x[i] for i in order]).astype(np.float64), who, label[order].astype(np.float64))


def score(text: Column, model: Attention | Constant) -> Column:
    @F.pandas_udf("double")
    def scored(column: pd.Series) -> pd.Series:
        texts = [t or "" for t in column]
        parts = [model.scores(*passages(texts[a:b])) for a, b in slices(texts, SLICE)]
        give_back()
        return pd.Series(np.concatenate([np.zeros(0), *parts]).astype(float))

    return scored(text)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    rows = docs.select("doc_id", (F.coalesce(fold(F.col("doc_id")), F.lit(0)) == 0).alias("held_out"), score(F.col("text"), train(docs, labels)).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier accepts; all columns stay."""
    return docs.filter(score(F.col("text"), train(docs, labels)) >= ACCEPT)
