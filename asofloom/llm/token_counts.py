"""Operator 1: token counts by batch encoding in Arrow functions that return lengths only."""

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import byte_slices, worker_cache

#: The public pre-tokenisation pattern of the 50k byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts above this many characters are encoded in pieces.
PIECE_CHARS = 1 << 16


def pieces(text, limit=PIECE_CHARS):
    """Cuts a text where no token of PATTERN can reach across: before white space that follows a visible character.

    A stretch without such a place is kept whole, so lengths always add up to that of the whole text.
    """
    start, n = 0, len(text)
    while n - start > limit:
        cut = start + limit
        while cut > start + 1 and not (text[cut].isspace() and not text[cut - 1].isspace()):
            cut -= 1
        if cut <= start + 1:  # nothing before the limit; the next safe place after it
            cut = start + limit
            while cut < n and not (text[cut].isspace() and not text[cut - 1].isspace()):
                cut += 1
        yield text[start:cut]
        start = cut
    yield text[start:]


def encoding(ranks_path):
    cache = worker_cache("tokenizers")
    if ranks_path not in cache:
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        cache[ranks_path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return cache[ranks_path]


def token_counter(ranks_path):
    """An Arrow function from a text column to token counts (int64; null for null, 0 for the empty text)."""

    @F.arrow_udf(T.LongType())
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = encoding(ranks_path)
        for texts in batches:
            out = np.zeros(len(texts), np.int64)
            for a, b in byte_slices(texts):
                rows, parts = [], []
                for i, text in enumerate(texts.slice(a, b - a).to_pylist(), a):
                    if text:
                        for p in pieces(text) if len(text) > PIECE_CHARS else (text,):
                            rows.append(i)
                            parts.append(p)
                sizes = [len(own.encode_to_numpy(p, disallowed_special=())) for p in parts]
                np.add.at(out, np.asarray(rows, np.int64), np.asarray(sizes, np.int64))
            yield pa.array(out, mask=texts.is_null().to_numpy(zero_copy_only=False))

    return count


def token_counts(df, ranks_path, id_col="doc_id", text_col="text"):
    """Rows (doc_id, n_tokens), one for each input row, repeated rows included.

    A null text has a null count, an empty one 0. A null id is kept. Other columns are neither read nor returned, so their names can't
    clash. An empty table gives an empty result. Very long texts are cut at safe places only: the count is that of the whole text.
    """
    return df.select(F.col(id_col).alias("doc_id"), token_counter(ranks_path)(F.col(text_col)).alias("n_tokens"))
