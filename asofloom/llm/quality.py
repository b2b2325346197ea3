"""Operator 8: a quality classifier of naive Bayes features under a linear support vector machine.

Indicators of n-grams (words, word pairs, surface shapes and pairs of shapes) are scaled by the class log-count ratio; a linear hinge-loss
model is then fitted by dual coordinate descent.
"""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import bare, byte_slices, labelled_sample, raw_tokens

#: Labelled documents of each label that the model is fitted on, at most.
FIT_DOCS = 2500
HASH_BITS, SMOOTHING, COST, PASSES = 20, 1.0, 1.0, 12
HELD_OUT = 0.2

RESULT = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("keep", T.BooleanType())])
_LETTERS = re.compile(r"[^\W\d_]+")
_DIGITS = re.compile(r"\d+")


def shape(token):
    """What a token looks like: its letters as x, X or Xx, digits as 0, other signs as they are."""
    letters = lambda m: "X" if m[0].isupper() else "x" if m[0].islower() else "Xx"
    return _DIGITS.sub("0", _LETTERS.sub(letters, token))


def mix(a, b):
    x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + np.uint64(0xC2B2AE3D27D4EB4F))
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def features(texts):
    """(row of each feature, feature): the distinct hashed n-grams of each text, ordered by row."""
    codes, offsets, raw = raw_tokens(texts)
    empty = pc.index(raw, "").as_py()
    if empty >= 0:  # what stands before leading and after trailing white space is no token
        keep = codes != empty
        codes, offsets = codes[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]
    n = len(offsets) - 1
    row = np.repeat(np.arange(n), np.diff(offsets))
    kinds = []
    for salt, units in ((1, bare(raw).to_pylist()), (2, map(shape, raw.to_pylist()))):
        own = np.fromiter((xxhash.xxh3_64_intdigest(u, salt) for u in units), np.uint64, len(raw))[codes] if len(codes) else np.zeros(0, np.uint64)
        pair = row[1:] == row[:-1]
        kinds += [(row, own), (row[1:][pair], mix(own[:-1], own[1:])[pair])]
    rows = np.concatenate([k[0] for k in kinds]).astype(np.uint64)
    hashed = np.concatenate([k[1] for k in kinds]) >> np.uint64(64 - HASH_BITS)
    key = np.unique((rows << np.uint64(HASH_BITS)) | hashed)
    return (key >> np.uint64(HASH_BITS)).astype(np.int64), (key & np.uint64((1 << HASH_BITS) - 1)).astype(np.int64)


def dual_descent(indptr, feature, values, y, cost, passes, seed=3):
    """Weights of the L1-loss linear SVM, one dual variable at a time."""
    rng = np.random.default_rng(seed)
    w, alpha = np.zeros(1 << HASH_BITS), np.zeros(len(y))
    square = np.array([float((values[indptr[i] : indptr[i + 1]] ** 2).sum()) for i in range(len(y))])
    for _ in range(passes):
        worst = 0.0
        for i in rng.permutation(len(y)):
            if square[i] == 0:
                continue
            s, e = indptr[i], indptr[i + 1]
            f, v = feature[s:e], values[s:e]
            g = y[i] * float(w[f] @ v) - 1
            new = min(max(alpha[i] - g / square[i], 0.0), cost[i])
            if new != alpha[i]:
                w[f] += (new - alpha[i]) * y[i] * v
                worst = max(worst, abs(new - alpha[i]) * square[i])
                alpha[i] = new
        if worst < 1e-3:
            break
    return w


def fit(rows, seed=3):
    """Weights and threshold from (text, label) rows, label 1 for good. None without both labels."""
    order = np.random.default_rng(seed).permutation(len(rows))
    rows = [rows[i] for i in order]
    label = np.array([int(r[1]) for r in rows])
    if len(set(label.tolist())) < 2:
        return None
    row, feature = [], []
    texts = pa.array([r[0] for r in rows], pa.string())
    for a, b in byte_slices(texts):
        r, f = features(texts.slice(a, b - a))
        row.append(r + a)
        feature.append(f)
    row, feature = np.concatenate(row), np.concatenate(feature)
    indptr = np.searchsorted(row, np.arange(len(rows) + 1))
    held = np.arange(len(rows)) < HELD_OUT * len(rows)
    if len(set(label[~held].tolist())) < 2:
        held[:] = False
    of = label[row]
    train = ~held[row]
    p = SMOOTHING + np.bincount(feature[train & (of == 1)], minlength=1 << HASH_BITS)
    q = SMOOTHING + np.bincount(feature[train & (of == 0)], minlength=1 << HASH_BITS)
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    ratio[p + q <= 2 * SMOOTHING] = 0  # unseen in training: tells nothing
    size = np.maximum(np.diff(indptr), 1)
    values = ratio[feature] / np.sqrt(size)[row]
    y = np.where(label == 1, 1.0, -1.0)
    cost = np.where(held, 0.0, COST * len(rows) / (2 * np.where(label == 1, max(1, (label == 1).sum()), max(1, (label == 0).sum()))))
    w = dual_descent(indptr, feature, values, y, cost, PASSES) * ratio
    scores = np.bincount(row, weights=w[feature], minlength=len(rows)) / np.sqrt(size)
    at = held if held.any() and len(set(label[held].tolist())) == 2 else ~held
    s, g = scores[at], label[at]
    cuts = np.unique(np.concatenate([[s.min() - 1], s, [s.max() + 1]]))
    mids = (cuts[1:] + cuts[:-1]) / 2
    good = ((s[None] >= mids[:, None]) == (g[None] == 1)).mean(1)
    best = np.flatnonzero(good >= good.max() - 1e-12)
    cut = float(mids[best[np.argmax((cuts[1:] - cuts[:-1])[best])]])
    nonzero = np.flatnonzero(w)
    return {"feature": nonzero, "weight": w[nonzero].astype(np.float32), "cut": cut}


def scorer(spark, model):
    """An Arrow function from a text column to a struct (score, keep)."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf(RESULT)
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        w = np.zeros(1 << HASH_BITS, np.float32)
        if m:
            w[m["feature"]] = m["weight"]
        for texts in batches:
            out, there = np.zeros(len(texts)), np.zeros(len(texts), bool)
            for a, b in byte_slices(texts):
                row, feature = features(texts.slice(a, b - a))
                size = np.bincount(row, minlength=b - a)
                there[a:b] = size > 0
                out[a:b] = np.bincount(row, weights=w[feature], minlength=b - a) / np.sqrt(np.maximum(size, 1))
            out = np.round(out - m["cut"], 6) if m else out
            yield pa.StructArray.from_arrays([pa.array(np.where(there, out, 0.0)), pa.array(there & (out >= 0))], names=["score", "keep"])

    return score


def fit_on(docs, labels, fit_docs=FIT_DOCS, id_col="doc_id", text_col="text", label_col="quality"):
    """The model of a bounded sample of the labelled documents; labels that contradict each other count as bad."""
    known = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y"))
    return fit(labelled_sample(docs, id_col, text_col, fit_docs, labels=known, contradiction=F.min))


def quality(df, model, id_col="doc_id", text_col="text"):
    """Rows (doc_id, score, keep), one for each input row, repeated rows included; keep is score >= 0, the score being over the threshold.

    A null or empty text has score 0 and isn't kept. Whole texts are scored. If the labels have one kind only, every text with a token is
    kept. Other columns are neither read nor returned.
    """
    r = scorer(df.sparkSession, model)(F.col(text_col))
    return df.select(F.col(id_col).alias("doc_id"), r.alias("r")).select("doc_id", "r.score", "r.keep")
