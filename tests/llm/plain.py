"""Plain versions of the corpus operators: a document, a word, a pair at a time."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash

from asofloom.llm import decontam, langid, quality, simhash, toxicity

MASK = (1 << 64) - 1


def words(text):
    return [w for t in (text or "").split() if (w := re.sub(r"[\W_]", "", t.lower()))]


# ---- language identification


def grams(word, n):
    return [x for k in range(len(word) + 3 - n) if len(x := f" {word} "[k : k + n]) == n]


def language_model(rows):
    """Log frequencies {(unit length or 0 for words, unit): {language: score}} of (text, language) rows."""
    counts = defaultdict(Counter)
    for text, lang in rows:
        for w in words(text):
            counts[0, w][lang] += 1
            for n in range(1, langid.N_MAX + 1):
                for g in grams(w, n):
                    counts[n, g][lang] += 1
    total = Counter()
    for (n, _), c in counts.items():
        for lang, k in c.items():
            total[n, lang] += k
    langs = sorted({lang for _, lang in rows})
    known = {u: c for u, c in counts.items() if sum(c.values()) >= langid.MIN_COUNT}
    return langs, {(n, u): [max(langid.PENALTY, math.log10(c[x] / total[n, x])) if c[x] else langid.PENALTY for x in langs] for (n, u), c in known.items()}


def language(model, text):
    """(language, margin, known share) of a text."""
    langs, table = model
    own, found = words(text), []
    for w in own:
        s = table.get((0, w))
        for n in range(langid.N_MAX, 0, -1):
            if s is None:
                hits = [table[n, g] for g in grams(w, n) if (n, g) in table and g != " "]
                s = [sum(h[k] for h in hits) / len(hits) for k in range(len(langs))] if hits else None
        if s is not None:
            found.append(s)
    if not found:
        return "und", 0.0, 0.0
    mean = [sum(s[k] for s in found) / len(found) for k in range(len(langs))]
    order, known = sorted(mean), len(found) / len(own)
    margin = order[-1] - order[-2]
    return "und" if known < langid.MIN_KNOWN or margin < langid.MIN_MARGIN else langs[mean.index(max(mean))], margin, known


# ---- toxicity


def bucket(word, salt):
    h = sum((b + 1) * pow(toxicity.FACTOR, k, 1 << 64) for k, b in enumerate(word.encode())) & MASK
    return mixed(h, salt)


def mixed(h, salt):
    h = ((h ^ (salt * 0xC2B2AE3D27D4EB4F & MASK)) * 0xBF58476D1CE4E5B9) & MASK
    h = ((h ^ (h >> 31)) * 0x94D049BB133111EB) & MASK
    return h ^ (h >> 29)


def word_vector(model, word):
    cache = model.setdefault("by_word", {})
    if word in cache:
        return cache[word]
    first = bucket(word, 0)
    rows = [first, mixed(first, 1), *(bucket(word[:n], n) for n in toxicity.STEMS if len(word) >= n)]
    if "by_bucket" not in model:
        model["by_bucket"] = {int(b): model["emb"][i] for i, b in enumerate(model["used"])}
    place = model["by_bucket"]
    cache[word] = sum((place[r % toxicity.BUCKETS] for r in rows if r % toxicity.BUCKETS in place), np.zeros(toxicity.DIM))
    return cache[word]


def toxic_score(model, text):
    """The probability of one text: each filter at each place, its largest response, the output layer."""
    vectors = [word_vector(model, w) for w in words(text)]
    if not vectors:
        return 0.0
    z, nothing = float(model["c"][0]), np.zeros(toxicity.DIM)
    for k, filters in enumerate(model["filters"]):
        most = np.full(toxicity.FILTERS, -np.inf)
        for i in range(len(vectors)):
            most = np.maximum(most, sum((vectors[i + j] if i + j < len(vectors) else nothing) @ filters[j] for j in range(len(filters))))
        z += float(np.maximum(0, most + model["bias"][k]) @ model["out"][k * toxicity.FILTERS : (k + 1) * toxicity.FILTERS])
    return 1 / (1 + math.exp(-z))


# ---- quality


def quality_features(text):
    def mix(a, b):
        x = (a * 0x9E3779B97F4A7C15 & MASK) ^ (b + 0xC2B2AE3D27D4EB4F & MASK)
        x = ((x ^ (x >> 29)) * 0xBF58476D1CE4E5B9) & MASK
        return x ^ (x >> 32)

    tokens, found = (text or "").split(), set()
    for salt, units in ((1, [re.sub(r"[\W_]", "", t.lower()) for t in tokens]), (2, [quality.shape(t) for t in tokens])):
        h = [xxhash.xxh3_64_intdigest(u, salt) for u in units]
        found |= {*h, *(mix(a, b) for a, b in zip(h, h[1:], strict=False))} if h else set()
    return {h >> (64 - quality.HASH_BITS) for h in found}


def quality_score(model, text):
    if "by_feature" not in model:
        model["by_feature"] = dict(zip(model["feature"].tolist(), model["weight"].tolist(), strict=True))
    own = quality_features(text)
    return sum(model["by_feature"].get(f, 0.0) for f in own) / math.sqrt(len(own)) - model["cut"] if own else None


# ---- near duplicates


def signature(text):
    """The 128 bits of a text as a number, None without words."""
    total = [0] * 128
    for w, c in Counter(words(text)).items():
        digest = int.from_bytes(xxhash.xxh3_128_digest(w), "big")
        for k in range(128):
            total[k] += round(16 * math.sqrt(c)) * (1 if digest >> (127 - k) & 1 else -1)
    return sum(1 << (127 - k) for k, t in enumerate(total) if t > 0) if words(text) else None


def groups(texts):
    """{id: smallest id of its group} by comparing all pairs."""
    sign = {i: signature(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(i for i in texts if sign[i] is not None)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if (sign[i] ^ sign[j]).bit_count() <= simhash.RADIUS:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in texts}


# ---- decontamination


def runs(text, n=decontam.NGRAM):
    w = re.sub(r"[\W_]+", " ", (text or "").lower()).split()
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def leaks(text, benchmark):
    """Whether a text holds a run of an item."""
    w = re.sub(r"[\W_]+", " ", (text or "").lower()).split()
    return any(tuple(w[k : k + len(g)]) == g for g in benchmark for k in range(len(w) - len(g) + 1)) if len(w) < 50 else not benchmark.isdisjoint(tuple(w[k : k + n]) for n in {len(g) for g in benchmark} for k in range(len(w) - n + 1))
