"""Operator 3: language identification by word-first backoff.

A word known from training scores by its log frequency in each language. An unseen word falls back to its character n-grams, from the
longest down, and takes the mean score of the first length of which any n-gram is known. A text's score is the mean over its words.
"""

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import byte_slices, labelled_sample, segment_sum, words

#: Labelled documents of each language that the model is fitted on, at most.
FIT_DOCS = 2000
#: Longest character n-gram.
N_MAX = 5
#: Occurrences in the sample that a word or n-gram needs to be known.
MIN_COUNT = 2
#: Score (log10) of a unit that one language lacks and another has.
PENALTY = -7.0
#: A text is rejected if fewer than this share of its words is scored at all, or the two best languages are closer than MIN_MARGIN.
MIN_KNOWN, MIN_MARGIN = 0.5, 0.02
UNDETERMINED = "und"
CACHE_WORDS = 60_000

RESULT = T.StructType([T.StructField("lang", T.StringType()), T.StructField("margin", T.DoubleType()), T.StructField("known", T.DoubleType())])


def grams(word, n):
    padded = f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def table(counts, langs, min_count):
    """Unit -> row, and the matrix of log10 frequencies of rows by language."""
    total = [max(1, sum(counts[x].values())) for x in langs]
    joint = Counter()
    for x in langs:
        joint.update(counts[x])
    known = sorted(u for u, c in joint.items() if c >= min_count)
    scores = np.full((len(known), len(langs)), PENALTY, np.float32)
    for j, x in enumerate(langs):
        own = counts[x]
        for i, u in enumerate(known):
            if c := own.get(u):
                scores[i, j] = max(PENALTY, np.log10(c / total[j]))
    return {u: i for i, u in enumerate(known)}, scores


def fit(rows, n_max=N_MAX, min_count=MIN_COUNT):
    """A model from (text, language) rows: languages, then a table for words and one for each n-gram length."""
    by_lang = {}
    for text, lang in rows:
        codes, _, vocabulary = words(pa.array([text], pa.string()))
        n = np.bincount(codes, minlength=len(vocabulary)).tolist()
        by_lang.setdefault(lang, Counter()).update({w: c for w, c in zip(vocabulary.to_pylist(), n, strict=True) if c})
    langs = sorted(by_lang)
    tables = {0: table(by_lang, langs, min_count)}
    for n in range(1, n_max + 1):
        counts = {x: Counter() for x in langs}
        for x in langs:
            for w, c in by_lang[x].items():
                for g in grams(w, n):
                    counts[x][g] += c
        tables[n] = table(counts, langs, min_count)
    return {"langs": langs, "n_max": n_max, "tables": tables}


def score_word(model, word):
    """Scores of a word by language, or None if nothing in it is known."""
    index, scores = model["tables"][0]
    if (i := index.get(word)) is not None:
        return scores[i]
    for n in range(min(model["n_max"], len(word) + 2), 0, -1):
        index, scores = model["tables"][n]
        hits = [i for g in grams(word, n) if (i := index.get(g)) is not None and g != " "]
        if hits:
            return scores[hits].mean(axis=0)
    return None


class Scorer:
    """Scores batches, keeping the scores of the words it has met."""

    def __init__(self, model):
        self.model = model
        self.clear()

    def clear(self):
        self.index = {}
        self.rows = np.zeros((1024, len(self.model["langs"]) + 1), np.float32)

    def word_rows(self, vocabulary):
        if len(self.index) > CACHE_WORDS:
            self.clear()
        index, at = self.index, np.empty(len(vocabulary), np.int64)
        for k, w in enumerate(vocabulary.to_pylist()):
            i = index.get(w)
            if i is None:
                i = index[w] = len(index)
                if i >= len(self.rows):
                    self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
                s = score_word(self.model, w) if w else None
                if s is not None:
                    self.rows[i, :-1] = s
                    self.rows[i, -1] = 1
            at[k] = i
        return self.rows[at]

    def __call__(self, texts):
        """Best language (index), margin and known share of each text."""
        codes, offsets, vocabulary = words(texts)
        sums = segment_sum(self.word_rows(vocabulary)[codes], offsets)
        known, n = sums[:, -1], np.maximum(np.diff(offsets), 1)
        mean = sums[:, :-1] / np.maximum(known, 1)[:, None]
        order = np.sort(mean, axis=1)
        margin = order[:, -1] - order[:, -2] if mean.shape[1] > 1 else np.full(len(mean), -PENALTY)
        return mean.argmax(axis=1), np.where(known > 0, margin, 0.0), known / n


def identifier(spark, model, min_known=MIN_KNOWN, min_margin=MIN_MARGIN):
    """An Arrow function from a text column to a struct (lang, margin, known)."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf(RESULT)
    def identify(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(shared.value) if shared.value["langs"] else None
        names = np.array([*shared.value["langs"], UNDETERMINED], dtype=object)
        for texts in batches:
            best, margin, known = np.full(len(texts), -1), np.zeros(len(texts)), np.zeros(len(texts))
            for a, b in byte_slices(texts):
                if scorer:
                    best[a:b], margin[a:b], known[a:b] = scorer(texts.slice(a, b - a))
            best[(known < min_known) | (known == 0) | (margin < min_margin)] = -1
            yield pa.StructArray.from_arrays([pa.array(names[best], pa.string()), pa.array(np.round(margin, 4)), pa.array(np.round(known, 4))], names=["lang", "margin", "known"])

    return identify


def fit_on(docs, fit_docs=FIT_DOCS, id_col="doc_id", text_col="text", lang_col="lang"):
    """The model of the bounded labelled sample of ``docs``."""
    return fit(labelled_sample(docs, id_col, text_col, fit_docs, own=lang_col))


def identify(df, model, id_col="doc_id", text_col="text"):
    """Rows (doc_id, lang, margin, known), one for each input row, repeated rows included.

    lang is "und" where the text is null, empty, without letters or digits, mostly of unknown characters, or tied between languages (the
    margin in log10 per word is below MIN_MARGIN). Other columns are neither read nor returned. Whole texts are scored, however long.
    """
    r = identifier(df.sparkSession, model)(F.col(text_col))
    return df.select(F.col(id_col).alias("doc_id"), r.alias("r")).select("doc_id", "r.lang", "r.margin", "r.known")
