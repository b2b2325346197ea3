"""Operator 5: a convolutional text classifier over hashed word embeddings, trained in numpy, with thresholds by language.

A word's vector is the sum of rows of a hashed table: two for the word itself, one for each of its first 3 to 8 letters, so that unseen
words of a known stem have a meaning. Filters of several widths slide over the word vectors; each filter's largest
response over the text (max pooling, rectified) enters a logistic output. As a convolution is linear before the pooling, a distinct
word's responses are computed once and gathered for its positions.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import byte_slices, labelled_sample, words

#: Labelled documents of each (language, label) that the model is fitted and calibrated on, at most.
FIT_DOCS = 600
BUCKETS, DIM, WIDTHS, FILTERS, EPOCHS, RATE, DECAY = 1 << 18, 16, (1, 2, 3), 12, 14, 0.02, 1e-3
#: Lengths of the leading letters that have rows of their own.
STEMS = (3, 4, 5, 6, 7, 8)
#: Share of the sample held out to calibrate the thresholds.
HELD_OUT = 0.25
#: Labelled rows of a language, of each kind, below which it takes the common threshold.
MIN_CALIBRATION = 8

RESULT = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("toxic", T.BooleanType())])


#: An odd factor and its inverse modulo 2 ** 64, for hashes of substrings from one running sum.
FACTOR = 0x9E3779B97F4A7C15
INVERSE = pow(FACTOR, -1, 1 << 64)


def powers(base, n):
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def mixed(h, salt):
    h = (h ^ np.uint64(salt * 0xC2B2AE3D27D4EB4F & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def buckets_of(vocabulary):
    """The rows of the hashed table of each word of an Arrow array: two of the word, one of each stem; BUCKETS where there is none.

    Hashes of words and of their first letters are differences of one running sum over all bytes.
    """
    n = len(vocabulary)
    offsets = np.frombuffer(vocabulary.buffers()[1], np.int32)[vocabulary.offset : vocabulary.offset + n + 1].astype(np.int64)
    data = np.frombuffer(vocabulary.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(FACTOR, len(data)), out=sums[1:])
    back = powers(INVERSE, len(data) + 1)[offsets[:-1]]
    part = lambda end: (sums[end] - sums[offsets[:-1]]) * back
    letters = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # where characters begin
    first = np.searchsorted(letters, offsets)
    size = np.diff(first)
    out = np.full((n, 2 + len(STEMS)), BUCKETS, np.int64)
    whole = mixed(part(offsets[1:]), 0)
    for k, h in enumerate((whole, mixed(whole, 1))):
        out[:, k] = np.where(size > 0, (h % np.uint64(BUCKETS)).astype(np.int64), BUCKETS)
    for k, stem in enumerate(STEMS, 2):
        end = letters[np.minimum(first[:-1] + stem, first[1:])]
        out[:, k] = np.where(size >= stem, (mixed(part(end), stem) % np.uint64(BUCKETS)).astype(np.int64), BUCKETS)
    return out


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def spread(codes, offsets):
    """(codes with padding after each of the texts, so that no filter reaches into the next; start and end of each). No text is empty."""
    gap, n = max(WIDTHS) - 1, len(offsets) - 1
    size = np.diff(offsets)
    start = offsets[:-1] + gap * np.arange(n)
    padded = np.zeros(len(codes) + gap * n, np.intp)
    padded[np.arange(len(codes)) + gap * np.repeat(np.arange(n), size)] = codes
    return padded, start, start + size


def convolved(vectors, filters, padded):
    """Responses of the filters of one width at every position; a distinct word's part is computed once."""
    r = (vectors @ filters[0]).take(padded, axis=0)
    for j in range(1, len(filters)):
        r[:-j] += (vectors @ filters[j]).take(padded[j:], axis=0)
    return r


class Adam:
    def __init__(self, x):
        self.m, self.v, self.t = np.zeros_like(x), np.zeros_like(x), 0

    def step(self, x, g, rate):
        self.t += 1
        self.m += 0.1 * (g - self.m)
        self.v += 0.001 * (g * g - self.v)
        x -= rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def fit(rows, seed=5):
    """A model from (text, language, toxic) rows. Deterministic. Without both labels the model marks nothing."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    rows = [rows[i] for i in order]
    y = np.array([int(r[2]) for r in rows], np.float32)
    if len(set(y.tolist())) < 2:
        return None
    codes, offsets, vocabulary = words(pa.array([r[0] for r in rows], pa.string()))
    # code 0, the empty word, is padding; so are the stems that a word is too short for
    parts = buckets_of(vocabulary)
    used, local = np.unique(parts, return_inverse=True)  # only rows that the sample touches are trained
    local = local.reshape(parts.shape)
    held = np.arange(len(rows)) < HELD_OUT * len(rows)
    docs = [codes[offsets[i] : offsets[i + 1]] for i in range(len(rows))]
    emb = rng.normal(0, 0.05, (len(used), DIM)).astype(np.float32)
    nothing, met = np.flatnonzero(used == BUCKETS), np.zeros(len(used), bool)
    emb[nothing] = 0
    model = {"filters": [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS], "bias": [np.zeros(FILTERS, np.float32) for _ in WIDTHS], "out": rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32), "c": np.zeros(1, np.float32)}
    params = [emb, *model["filters"], *model["bias"], model["out"], model["c"]]
    adam = [Adam(p) for p in params]
    train = np.array([i for i in range(len(rows)) if not held[i] and len(docs[i])])
    balance = np.where(y == 1, 0.5 / max(y[train].mean(), 1e-3), 0.5 / max(1 - y[train].mean(), 1e-3))
    for epoch in range(EPOCHS):
        rng.shuffle(train)
        rate = RATE * (1 - epoch / EPOCHS) + 1e-3
        for start in range(0, len(train), 64):
            batch = train[start : start + 64]
            vocab, inverse = np.unique(np.concatenate([docs[i] for i in batch]), return_inverse=True)
            if vocab[0] != 0:
                vocab, inverse = np.concatenate([[0], vocab]), inverse + 1
            rows_of = local[vocab]
            vectors = sum(emb[rows_of[:, k]] for k in range(rows_of.shape[1]))
            vectors[0] = 0
            grads = [np.zeros_like(p) for p in params[1:]]
            gv = np.zeros_like(vectors)
            padded, begin, end = spread(inverse, np.concatenate([[0], np.cumsum([len(docs[i]) for i in batch])]))
            rs = [convolved(vectors, f, padded) for f in model["filters"]]
            where = np.array([np.concatenate([s + r[s:e].argmax(axis=0) for r in rs]) for s, e in zip(begin, end, strict=True)])
            z = np.concatenate([np.take_along_axis(r, w, axis=0) for r, w in zip(rs, np.split(where, len(WIDTHS), axis=1), strict=True)], axis=1) + np.concatenate(model["bias"])
            keep = (rng.random(z.shape) > 0.2) / 0.8  # dropout: no single filter decides
            act = np.maximum(z, 0) * keep
            d = (sigmoid(act @ model["out"] + model["c"][0]) - y[batch]) * balance[batch] / len(batch)
            grads[-2] += d @ act
            grads[-1] += d.sum()
            dz = d[:, None] * model["out"] * keep * (z > 0)
            for k, width in enumerate(WIDTHS):
                g, at = dz[:, k * FILTERS : (k + 1) * FILTERS], where[:, k * FILTERS : (k + 1) * FILTERS]
                grads[len(WIDTHS) + k] += g.sum(axis=0)
                for j in range(width):
                    w = padded[at + j]
                    grads[k][j] += np.einsum("bfd,bf->df", vectors[w], g)
                    np.add.at(gv, w, g[:, :, None] * model["filters"][k][j].T)
            gv[0] = 0
            moving = np.flatnonzero(np.abs(gv).sum(1) > 0)
            e, back = np.unique(rows_of[moving], return_inverse=True)
            back, ge = back.reshape(len(moving), -1), np.zeros((len(e), DIM), np.float32)
            for k in range(back.shape[1]):
                np.add.at(ge, back[:, k], gv[moving])
            a0 = adam[0]
            a0.m[e] += 0.1 * (ge - a0.m[e])
            a0.v[e] += 0.05 * (ge**2 - a0.v[e])
            emb[e] -= rate * a0.m[e] / (np.sqrt(a0.v[e]) + 1e-4)
            # rows without gradient shrink to 0 as well, so that words that tell nothing add nothing
            met[:] = False
            met[rows_of] = True
            emb[met] *= 1 - 20 * rate * DECAY
            emb[nothing] = 0
            for x, g, own in zip(params[1:], grads, adam[1:], strict=True):
                own.step(x, g + DECAY * x * (x.ndim > 1), rate)
    model["used"], model["emb"] = used[used < BUCKETS], emb[used < BUCKETS]
    scorer = Scorer(model | {"thresholds": {}, "common": 0.5})
    p = scorer.scores(pa.array([r[0] for r, h in zip(rows, held, strict=True) if h], pa.string()))
    langs, yy = np.array([r[1] for r in rows])[held], y[held]
    model["common"] = threshold(p, yy)
    model["thresholds"] = {x: threshold(p[langs == x], yy[langs == x]) for x in sorted(set(langs.tolist())) if min((yy[langs == x] == v).sum() for v in (0, 1)) >= MIN_CALIBRATION}
    return model


def threshold(p, y):
    """The middle of the widest run of cuts with the most hits, hits counted alike for both labels."""
    if not len(p) or y.min() == y.max():
        return 0.5
    cuts = np.unique(np.concatenate([[0.0], p, [1.0]]))
    mids = (cuts[1:] + cuts[:-1]) / 2
    marked = p[None, :] >= mids[:, None]
    good = (marked & (y == 1)).sum(1) / (y == 1).sum() + (~marked & (y == 0)).sum(1) / (y == 0).sum()
    best = np.flatnonzero(good >= good.max() - 1e-12)
    return float(mids[best[np.argmax((cuts[1:] - cuts[:-1])[best])]])


class Scorer:
    """Scores batches. A bucket that training never met adds nothing."""

    def __init__(self, model):
        self.model = model
        self.place = np.full(BUCKETS + 1, len(model["used"]), np.int32)
        self.place[model["used"]] = np.arange(len(model["used"]))
        self.emb = np.concatenate([model["emb"], np.zeros((1, DIM), np.float32)])

    def vectors(self, vocabulary):
        rows, out = self.place[buckets_of(vocabulary)], np.zeros((len(vocabulary), DIM), np.float32)
        for k in range(rows.shape[1]):
            out += self.emb[rows[:, k]]
        return out

    def scores(self, texts):
        """The probability of each text; 0 for those without words. A distinct word's responses are computed once a step."""
        out = np.zeros(len(texts))
        for a, b in byte_slices(texts):
            codes, offsets, vocabulary = words(texts.slice(a, b - a))
            size = np.diff(offsets)
            full = np.flatnonzero(size)
            if not len(full):
                continue
            padded, start, end = spread(codes, np.append(offsets[:-1][full], offsets[-1]))
            ends = np.stack([start, end], axis=1).ravel()
            vectors = self.vectors(vocabulary)
            total = np.zeros(len(full))
            for k, filters in enumerate(self.model["filters"]):
                z = np.maximum.reduceat(convolved(vectors, filters, padded), ends, axis=0)[::2] + self.model["bias"][k]
                total += np.maximum(z, 0) @ self.model["out"][k * FILTERS : (k + 1) * FILTERS]
            out[a + full] = sigmoid(total + self.model["c"][0])
        return out


def marker(spark, model):
    """An Arrow function from (text, language) to a struct (score, toxic)."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf(RESULT)
    def mark(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        m = shared.value
        scorer = Scorer(m) if m else None
        for texts, langs in batches:
            p = scorer.scores(texts) if m else np.zeros(len(texts))
            cut = np.array([m["thresholds"].get(x, m["common"]) if m else 2.0 for x in langs.to_pylist()])
            yield pa.StructArray.from_arrays([pa.array(np.round(p, 6)), pa.array((p >= cut) & (p > 0))], names=["score", "toxic"])

    return mark


def fit_on(docs, labels, fit_docs=FIT_DOCS, id_col="doc_id", text_col="text", lang_col="lang", label_col="toxic"):
    """The model of a bounded sample of the labelled documents; labels that contradict each other count as toxic."""
    known = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y"))
    return fit(labelled_sample(docs, id_col, text_col, fit_docs, own=lang_col, labels=known))


def toxicity(df, model, id_col="doc_id", text_col="text", lang_col="lang"):
    """Rows (doc_id, score, toxic), one for each input row, repeated rows included.

    toxic is true where the score reaches the language's calibrated threshold; an unknown or null language has the common one. A null or
    empty text, or one without words, has score 0 and isn't toxic. Whole texts are scored. Other columns are neither read nor returned.
    """
    r = marker(df.sparkSession, model)(F.col(text_col), F.col(lang_col))
    return df.select(F.col(id_col).alias("doc_id"), r.alias("r")).select("doc_id", "r.score", "r.toxic")
