"""Bridges over texts. All but the two that need an outside model are built-in expressions or vectorised Arrow functions."""

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..boundary import q
from ..functions.aggregations import nz
from ..sources.scratch import written
from .base import Bridge

LEXICONS = {
    "en": {"good": 1, "great": 1, "excellent": 1, "happy": 1, "love": 1, "best": 1, "nice": 0.6, "helpful": 0.8, "clean": 0.6, "thanks": 0.5, "bad": -1, "terrible": -1, "awful": -1, "sad": -0.8, "hate": -1, "worst": -1, "poor": -0.7, "dirty": -0.8, "broken": -0.7, "angry": -0.9},
    "es": {"bueno": 1, "buena": 1, "excelente": 1, "feliz": 1, "mejor": 0.8, "gracias": 0.5, "limpio": 0.6, "amable": 0.8, "malo": -1, "mala": -1, "terrible": -1, "triste": -0.8, "peor": -0.9, "sucio": -0.8, "roto": -0.7, "odio": -1},
}
LEXICONS["xx"] = LEXICONS["en"] | LEXICONS["es"]

#: Frequent function words, as many for each language; of equal counts the language named first wins.
PROFILES = {
    "es": "el los las del y con para por una su al lo se como pero este esta muy cuando entre".split(),
    "en": "the of and to is that it was for on are with they be at this have from not by".split(),
    "pt": "os um uma do da no na em não com mais como mas ao dos das pelo pela são você".split(),
    "fr": "le les des du et un une est que qui dans pour pas sur avec ce il au sont plus".split(),
}


def word_list(x):
    """The words of a text in lower case; none for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit(r"(\p{L}+)"), F.lit(1))


class Sentiment(Bridge):
    """The mean valence of the words that a lexicon has; null without any."""

    def __init__(self, pk, text, language="es", lexicon=None, name="sentiment", value="sentiment"):
        if lexicon is None and language not in LEXICONS:
            raise ValueError(f"no lexicon for {language!r}: there are {', '.join(sorted(LEXICONS))}")
        self.pk, self.text, self.lexicon, self.name, self.value = pk, text, LEXICONS[language] if lexicon is None else dict(lexicon), name, value
        self.values = {value: "numeric"}

    def compute(self, rows, fit_rows):
        table = F.create_map(*[F.lit(y) for w, v in sorted(self.lexicon.items()) for y in (w, float(v))])
        hits = F.filter(F.transform(word_list(q(self.text)), lambda w: F.try_element_at(table, w)), lambda v: v.isNotNull())
        total = F.aggregate("__h", F.lit(0.0), lambda a, v: a + v)
        return rows.select(q(self.pk), hits.alias("__h")).select(q(self.pk), (total / nz(F.size("__h").cast("double"))).alias(self.value))


_EN_GROUPS = re.compile(r"[aeiouy]+")
_ES = "aeiouáéíóúü"


def syllables_en(word):
    """Groups of vowels, less a final e that isn't sounded."""
    n = len(_EN_GROUPS.findall(word))
    return max(1, n - (n > 1 and word.endswith("e") and not word.endswith("le")))


def syllables_es(word):
    """Vowel groups; two strong vowels, or a stressed weak one, part."""
    n, before = 0, ""
    for ch in word:
        if ch in _ES and (before not in _ES or not before or ch in "íú" or ch in "aeoáéó" and before in "aeoáéóíú"):
            n += 1
        before = ch
    return max(1, n)


class Readability(Bridge):
    """How easy a text is to read, more being easier: Flesch for en, Fernandez-Huerta for es; null without words."""

    def __init__(self, pk, text, language="es", name="readability", value="readability"):
        if language not in ("en", "es"):
            raise ValueError(f"no index for {language!r}")
        self.pk, self.text, self.language, self.name, self.value = pk, text, language, name, value
        self.values = {value: "numeric"}

    def compute(self, rows, fit_rows):
        english = self.language == "en"
        count = syllables_en if english else syllables_es

        @F.arrow_udf(T.LongType())
        def syllables(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            known = {}
            for lists in batches:
                flat = lists.flatten().dictionary_encode()
                own = []
                for w in flat.dictionary.to_pylist():
                    if w not in known:
                        if len(known) > 200_000:
                            known.clear()
                        known[w] = count(w)
                    own.append(known[w])
                per = np.asarray(own, np.int64)[flat.indices.to_numpy(zero_copy_only=False)] if own else np.zeros(0, np.int64)
                total = np.concatenate([[0], np.cumsum(per)])
                at = lists.offsets.to_numpy().astype(np.int64)
                at = at - at[0]
                yield pa.array(total[at[1:]] - total[at[:-1]])

        d = rows.select(q(self.pk), q(self.text).alias("__t"), word_list(q(self.text)).alias("__w"))
        n = nz(F.size("__w").cast("double"))
        # sentences are stretches between marks that hold more than white space, at least one
        parts = F.greatest(F.lit(1), F.size(F.filter(F.split(F.coalesce("__t", F.lit("")), "[.!?]+"), lambda s: F.trim(s) != "")))
        per_word, length = syllables(F.col("__w")) / n, n / parts
        score = 206.835 - 1.015 * length - 84.6 * per_word if english else 206.84 - 60.0 * per_word - 1.02 * length
        return d.select(q(self.pk), score.alias(self.value))


class LanguageId(Bridge):
    """The language of whose function words a text has most; null if it has none."""

    def __init__(self, pk, text, languages=("es", "en", "pt", "fr"), name="language_id", value="language"):
        unknown = [x for x in languages if x not in PROFILES]
        if unknown:
            raise ValueError(f"no profile for {unknown}")
        self.pk, self.text, self.languages, self.name, self.value = pk, text, list(languages), name, value
        self.values = {value: "categorical"}

    def compute(self, rows, fit_rows):
        d = rows.select(q(self.pk), word_list(q(self.text)).alias("__w"))
        hits = lambda words: F.size(F.filter("__w", lambda w: w.isin(words)))
        d = d.select(q(self.pk), *(hits(PROFILES[x]).alias(f"__{x}") for x in self.languages))
        best = F.greatest(*(F.col(f"__{x}") for x in self.languages), F.lit(0))
        out = F.coalesce(*(F.when((F.col(f"__{x}") == best) & (best > 0), F.lit(x)) for x in self.languages))
        return d.select(q(self.pk), out.alias(self.value))


class NERCounts(Bridge):
    """Named entities by kind, by a spaCy model where one is installed, or by what ``model`` makes on each executor if it is a function.

    A model has pipe(texts), which gives documents whose ``ents`` have a ``label_``. Null texts count as empty.
    """

    KINDS = {"persons": ("PERSON", "PER"), "orgs": ("ORG",), "locations": ("GPE", "LOC"), "money": ("MONEY",), "dates": ("DATE",)}
    values = dict.fromkeys(KINDS, "numeric")

    def __init__(self, pk, text, model="en_core_web_sm", name="ner_counts", model_vintage=None):
        self.pk, self.text, self.model, self.name, self.model_vintage = pk, text, model, name, model_vintage

    def compute(self, rows, fit_rows):
        model, kinds = self.model, self.KINDS
        if not callable(model):
            import spacy  # noqa: F401 - fails here, not on the executors, where it isn't installed

        @F.arrow_udf(T.StructType([T.StructField(k, T.LongType()) for k in kinds]))
        def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            if callable(model):
                nlp = model()
            else:
                import spacy

                nlp = spacy.load(model)
            for texts in batches:
                found = [[e.label_ for e in doc.ents] for doc in nlp.pipe(t or "" for t in texts.to_pylist())]
                yield pa.StructArray.from_arrays([pa.array([sum(x in names for x in f) for f in found]) for names in kinds.values()], names=list(kinds))

        return rows.select(q(self.pk), count(q(self.text)).alias("__c")).select(q(self.pk), "__c.*")


class SentenceEmbedding(Bridge):
    """Unit vectors of texts, by a sentence-transformers model where one is installed, or by what ``model`` makes on each executor if it is a
    function: something with encode(texts, normalize_embeddings=True). Null texts count as empty.
    """

    values = {"embedding": "vector"}

    def __init__(self, pk, text, model="all-MiniLM-L6-v2", name="sentence_embedding", model_vintage=None):
        self.pk, self.text, self.model, self.name, self.model_vintage = pk, text, model, name, model_vintage

    def compute(self, rows, fit_rows):
        model = self.model
        if not callable(model):
            import sentence_transformers  # noqa: F401

        @F.arrow_udf(T.ArrayType(T.FloatType()))
        def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            if callable(model):
                m = model()
            else:
                from sentence_transformers import SentenceTransformer

                m = SentenceTransformer(model)
            for texts in batches:
                yield pa.array(list(m.encode([t or "" for t in texts.to_pylist()], normalize_embeddings=True)), pa.list_(pa.float32()))

        return rows.select(q(self.pk), embed(q(self.text)).alias("embedding"))


class TfidfTopicShare(Bridge):
    """A text's loading on the first singular vector of the fitted texts' tf-idf matrix.

    Rows are of unit length, idf is smoothed. The vector comes from a locally optimal conjugate gradient iteration: the best vector of the
    span of the last one, its residual and the last step. It ends when the residual is below ``tolerance`` of the eigenvalue, or after
    ``rounds`` where these are given; its largest component is positive, which fixes the sign. ArithmeticError if MAX_ROUNDS don't suffice.

    The driver holds the vectors, of a number for each term, and sends one out in each round; documents stay where they are. Beyond
    ``MAX_TERMS`` terms the vectors are tables too, and each round is joins of (document, term, weight) rows.
    """

    MAX_ROUNDS, MAX_TERMS = 1000, 4_000_000

    values = {"tfidf_topic_share": "numeric"}
    STOP = frozenset("the of and to in a is that it for on was with as be at by this not but are from or have an they which you were all there when he she his her we our i me my your its their will would can could if so no do did has had been than then them these those who what".split())

    def __init__(self, pk, text, rounds=None, tolerance=1e-9, name="tfidf_topic_share"):
        self.pk, self.text, self.rounds, self.tolerance, self.name = pk, text, rounds, tolerance, name

    def _terms(self, rows):
        w = F.filter(word_list(q(self.text)), lambda t: (F.length(t) > 1) & ~t.isin(sorted(self.STOP)))
        return rows.select(q(self.pk).alias("d"), F.explode(w).alias("t")).groupBy("d", "t").agg(F.count("*").alias("n"))

    def _weights(self, terms, idf):
        w = terms.join(idf, "t").withColumn("w", F.col("n") * F.col("idf"))
        norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("d")))
        return w.select("d", "t", (F.col("w") / norm).alias("w"))

    def compute(self, rows, fit_rows):
        fit = written(self._terms(fit_rows))
        n = fit_rows.count()
        idf = written(fit.groupBy("t").agg(F.count("*").alias("df")).select("t", (F.ln(F.lit(1.0 + n) / (1 + F.col("df"))) + 1).alias("idf")))
        size = idf.count()
        if size <= self.MAX_TERMS:
            return self._shares(rows, rows is fit_rows, fit, idf, size)
        a = written(self._weights(fit, idf))
        v = self._first_vector(a, idf.select("t")).select("t", F.col("x").alias("v"))
        own = a if rows is fit_rows else self._weights(self._terms(rows), idf)
        share = own.join(v, "t").groupBy("d").agg(F.sum(F.col("w") * F.col("v")).alias("x"))
        return self._joined(rows, share)

    def _joined(self, rows, share):
        return rows.select(q(self.pk)).join(share.withColumnRenamed("d", "__d"), q(self.pk) == F.col("__d"), "left").select(q(self.pk), F.coalesce("x", F.lit(0.0)).alias("tfidf_topic_share"))

    def _shares(self, rows, fitted, fit, idf, size):
        numbered = written(idf.withColumn("m", F.monotonically_increasing_id()))
        part = F.shiftright("m", 33).cast("int")
        sizes = dict(map(tuple, numbered.groupBy(part).count().collect()))
        starts = np.cumsum([0, *(sizes.get(k, 0) for k in range(max(sizes, default=0)))]).tolist()
        numbered = numbered.select("t", "idf", (F.element_at(F.array(*map(F.lit, starts)), part + 1) + F.col("m").bitwiseAND(F.lit((1 << 33) - 1))).cast("int").alias("i"))

        def documents(terms):
            w = terms.join(numbered, "t").withColumn("w", F.col("n") * F.col("idf"))
            d = w.groupBy("d").agg(F.collect_list(F.struct("i", "w")).alias("x"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
            return d.select("d", F.col("x.i").alias("i"), F.transform("x.w", lambda w: w / F.col("norm")).alias("w"))

        own = docs = written(documents(fit))
        v = self._first_dense_vector(docs, size)
        if not fitted:
            own = documents(self._terms(rows))
        shared = own.sparkSession.sparkContext.broadcast(v)

        def share(batches: Iterator[pa.RecordBatch]):
            for batch in batches:
                at, i, w = flat(batch)
                yield pa.RecordBatch.from_arrays([batch.column("d"), pa.array(np.bincount(at, w * shared.value[i], batch.num_rows))], names=["d", "x"])

        return self._joined(rows, own.mapInArrow(share, f"d {own.schema['d'].dataType.simpleString()}, x double"))

    def _first_dense_vector(self, docs, size):
        context = docs.sparkSession.sparkContext

        def image(x):
            shared = context.broadcast(x)

            def product(batches: Iterator[pa.RecordBatch]):
                x, y = shared.value, np.zeros(size)
                for batch in batches:
                    at, i, w = flat(batch)
                    u = np.bincount(at, w * x[i], batch.num_rows)
                    np.add.at(y, i, w * u[at])
                found = np.flatnonzero(y)
                for s in range(0, len(found), 100_000):
                    k = found[s : s + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(y[k])], names=["i", "y"])

            got = docs.mapInArrow(product, "i int, y double").groupBy("i").agg(F.sum("y").alias("y")).toArrow()
            shared.destroy()
            y = np.zeros(size)
            y[got["i"].to_numpy()] = got["y"].to_numpy()
            return y

        x = np.full(size, 1.0 / max(size, 1) ** 0.5)
        bx, p, bp = image(x), np.zeros(size), np.zeros(size)
        value = float(x @ bx)
        for _ in range(self.rounds or self.MAX_ROUNDS):
            if not value:
                return x
            r = bx - value * x
            length = float(np.sqrt(r @ r))
            if length <= self.tolerance * value:
                return x
            r /= length
            span, images = np.stack([x, r, p]), np.stack([bx, image(r), bp])
            value, c, step = best_of(span @ span.T, span @ images.T)
            p, bp = c[1] * span[1] + c[2] * p, c[1] * images[1] + c[2] * bp
            x, bx, p, bp = c[0] * x + p, c[0] * bx + bp, p / step, bp / step
        if self.rounds is None:
            raise ArithmeticError(f"no first singular vector after {self.MAX_ROUNDS} rounds")
        return x

    def _first_vector(self, a, terms):
        def image(of, name):
            u = a.join(of.select("t", F.col(name).alias("__x")), "t").groupBy("d").agg(F.sum(F.col("w") * F.col("__x")).alias("__u"))
            return a.join(u, "d").groupBy("t").agg(F.sum(F.col("w") * F.col("__u")).alias(f"b{name}"))

        n = terms.count()
        x = terms.withColumn("x", F.lit(1.0 / max(n, 1) ** 0.5))
        now = written(x.join(image(x, "x"), "t").select("t", "x", "bx", F.lit(0.0).alias("p"), F.lit(0.0).alias("bp")))
        value = now.agg(F.sum(F.col("x") * F.col("bx"))).first()[0]
        for _ in range(self.rounds or self.MAX_ROUNDS):
            if not value:
                return now
            rest = F.col("bx") - value * F.col("x")
            size = now.agg(F.sqrt(F.sum(rest * rest))).first()[0]
            if size <= self.tolerance * value:
                return now
            w = now.withColumn("r", rest / size)  # of the last round's table, which goes with this one's
            w = written(w.join(image(w, "r"), "t"), instead=now)
            names = ("x", "r", "p")
            pairs = [(i, j) for i in range(3) for j in range(i + 1)]
            sums = w.agg(*(F.sum(F.col(names[i]) * F.col(names[j])).alias(f"g{i}{j}") for i, j in pairs), *(F.sum(F.col(names[i]) * F.col(f"b{names[j]}")).alias(f"h{i}{j}") for i, j in pairs)).first()
            gram, held = np.zeros((3, 3)), np.zeros((3, 3))
            for i, j in pairs:
                gram[i, j] = gram[j, i] = sums[f"g{i}{j}"]
                held[i, j] = held[j, i] = sums[f"h{i}{j}"]
            value, c, step = best_of(gram, held)
            p, bp = c[1] * F.col("r") + c[2] * F.col("p"), c[1] * F.col("br") + c[2] * F.col("bp")
            now = written(w.select("t", (c[0] * F.col("x") + p).alias("x"), (c[0] * F.col("bx") + bp).alias("bx"), (p / step).alias("p"), (bp / step).alias("bp")), instead=w)
        if self.rounds is None:
            raise ArithmeticError(f"no first singular vector after {self.MAX_ROUNDS} rounds")
        return now


def flat(batch):
    """The row, the number of the term and the weight of each entry of a batch of documents."""
    i, w = batch.column("i"), batch.column("w")
    size = pc.list_value_length(i).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(size)), size), i.flatten().to_numpy(zero_copy_only=False), w.flatten().to_numpy(zero_copy_only=False)


def best_of(gram, held):
    """(the largest eigenvalue in a span of three vectors, the eigenvector's coefficients, the length of the step from the first), from the products of the vectors with each other and with their images."""
    held = (held + held.T) / 2
    length, axes = np.linalg.eigh(gram)
    basis = (axes / np.sqrt(np.maximum(length, 1e-300)))[:, length > 1e-12]
    values, vectors = np.linalg.eigh(basis.T @ held @ basis)
    c = basis @ vectors[:, -1]
    c = (c if c[0] > 0 else -c).tolist()
    step = np.sqrt(max(c[1] ** 2 * gram[1, 1] + 2 * c[1] * c[2] * gram[1, 2] + c[2] ** 2 * gram[2, 2], 1e-300)).item()
    return float(values[-1]), c, step


class NearDuplicateEdges:
    """Edges (src, dst, ts) between texts whose sets of word shingles have a Jaccard similarity of at least ``threshold``.

    src is the earlier text, ts the later one's time: only then the likeness could be known. Texts of equal sets are one class, named by its
    earliest text. Classes are compared by prefix filtering, which finds every pair: two sets that are alike share one of the first shingles of
    each, in whatever order all shingles have. The order is from rare to frequent, by counts in a sample of up to ``SAMPLE`` classes.
    """

    SAMPLE, BUCKETS = 20_000, 1 << 22

    def __init__(self, pk, text, ts, threshold=0.8, shingle=3, name="near_duplicate_edges"):
        self.pk, self.text, self.ts, self.threshold, self.shingle, self.name = pk, text, ts, threshold, shingle, name

    def compute(self, rows):
        """All edges, copies included: as many as the square of a class."""
        d, reps = self._classes(rows)
        own = d.select("key", "id", "ts")
        same = own.alias("x").join(own.alias("y"), "key").where("x.id < y.id").select(*self._ends(F.col("x.id"), F.col("y.id"), F.col("x.ts"), F.col("y.ts")))
        links = self._links(reps).select("ka", "kb")
        far = links.join(own.select(F.col("key").alias("ka"), F.col("id").alias("a"), F.col("ts").alias("ta")), "ka").join(own.select(F.col("key").alias("kb"), F.col("id").alias("b"), F.col("ts").alias("tb")), "kb")
        swap = F.col("a") > F.col("b")
        far = far.select(*(F.when(swap, F.col(y)).otherwise(F.col(x)).alias(n) for x, y, n in (("a", "b", "a"), ("b", "a", "b"), ("ta", "tb", "ta"), ("tb", "ta", "tb"))))
        return same.unionByName(far.select(*self._ends(*map(F.col, ("a", "b", "ta", "tb")))))

    def condensed(self, rows):
        """(src, dst, ts, same): edges between the earliest texts of classes, and, as ``same``, from these to the other texts of their class."""
        d, reps = self._classes(rows)
        links = self._links(reps).select(*self._ends(*map(F.col, ("a", "b", "ta", "tb"))), F.lit(False).alias("same"))
        members = d.select("key", "id", "ts").join(reps.select("key", F.col("id").alias("src")), "key").where("id <> src")
        return links.unionByName(members.select("src", F.col("id").alias("dst"), "ts", F.lit(True).alias("same")))

    @staticmethod
    def _ends(a, b, ta, tb):
        swap = ta > tb
        return F.when(swap, b).otherwise(a).alias("src"), F.when(swap, a).otherwise(b).alias("dst"), F.greatest(ta, tb).alias("ts")

    def _classes(self, rows):
        """(texts as id, ts and the key of their set; classes as key, earliest id, its ts and the sorted set g), both written."""
        k = self.shingle

        @F.arrow_udf(T.StructType([T.StructField("key", T.BinaryType()), T.StructField("g", T.ArrayType(T.LongType()))]))
        def sets(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for lists in batches:
                keys, grams = [], []
                for one in lists:
                    w = one.values.to_numpy(zero_copy_only=False).view(np.uint64)
                    if not len(w):
                        keys.append(None)
                        grams.append(None)
                        continue
                    n = min(k, len(w))
                    h = np.full(len(w) - n + 1, n, np.uint64)
                    for i in range(n):
                        h = (h ^ w[i : len(w) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
                        h ^= h >> np.uint64(29)
                    g = np.unique(h)
                    keys.append(hashlib.blake2b(g.tobytes(), digest_size=16).digest())
                    grams.append(g.view(np.int64))
                yield pa.StructArray.from_arrays([pa.array(keys, pa.binary()), pa.array(grams, pa.list_(pa.int64()))], names=["key", "g"])

        words = rows.select(q(self.pk).alias("id"), q(self.ts).alias("ts"), F.transform(word_list(q(self.text)), lambda w: F.xxhash64(w)).alias("w"))
        d = written(words.select("id", "ts", sets("w").alias("s")).select("id", "ts", "s.*").where("key is not null"))
        reps = d.groupBy("key").agg(F.min(F.struct("ts", "id")).alias("one"), F.first("g").alias("g"))
        return d, written(reps.select("key", "one.id", "one.ts", "g"))

    def _links(self, reps):
        """Pairs of classes (ka, kb, a, b, ta, tb) that are alike, a being the smaller id."""
        limit, buckets = self.threshold, self.BUCKETS
        part = reps.where(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < int(1e6 * min(1.0, self.SAMPLE / max(reps.count(), 1))) + 1)
        often = part.select(F.explode("g").alias("g")).groupBy(F.pmod("g", F.lit(buckets)).alias("g")).agg(F.count("*").alias("n")).where("n > 1").toArrow()
        counts = np.zeros(buckets, np.int32)
        counts[often["g"].to_numpy()] = often["n"].to_numpy()
        shared = reps.sparkSession.sparkContext.broadcast(counts)

        def prefixes(batches: Iterator[pa.RecordBatch]):
            known = shared.value
            for batch in batches:
                at, grams, sizes, places = [], [], [], []
                for i, one in enumerate(batch.column("g")):
                    g = one.values.to_numpy(zero_copy_only=False)
                    n = len(g)
                    first = g[np.lexsort((g, known[g % buckets]))[: n - math.ceil(limit * n - 1e-9) + 1]]
                    at.append(np.full(len(first), i))
                    grams.append(first)
                    sizes.append(np.full(len(first), n))
                    places.append(np.arange(len(first)))
                    if i + 1 == batch.num_rows or sum(map(len, at[-64:])) > 100_000:
                        yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(np.concatenate(at))), *(pa.array(np.concatenate(x).astype(np.int64)) for x in (grams, sizes, places))], names=["key", "gram", "n", "p"])
                        at, grams, sizes, places = [], [], [], []

        keyed = reps.select("key", "g").mapInArrow(prefixes, "key binary, gram long, n long, p long")
        x, y = (keyed.select("gram", *(F.col(c).alias(f"{c}{s}") for c in ("key", "n", "p"))) for s in "ab")
        sum_, left = F.col("na") + F.col("nb"), F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
        pairs = x.join(y, "gram").where((F.col("keya") < F.col("keyb")) & (F.least("na", "nb") >= limit * F.greatest("na", "nb") - 1e-6) & (left >= limit / (1 + limit) * sum_ - 1e-6)).select(F.col("keya").alias("ka"), F.col("keyb").alias("kb")).distinct()

        @F.arrow_udf(T.LongType())
        def common(a: pa.Array, b: pa.Array) -> pa.Array:
            at = lambda v: v.values.to_numpy(zero_copy_only=False)
            return pa.array([len(np.intersect1d(at(s), at(t), assume_unique=True)) for s, t in zip(a, b, strict=True)], pa.int64())

        left, right = (reps.select(F.col("key").alias(f"k{c}"), F.col("id").alias(c), F.col("ts").alias(f"t{c}"), F.col("g").alias(f"g{c}")) for c in "ab")
        both = pairs.join(left, "ka").join(right, "kb").select("ka", "kb", "a", "b", "ta", "tb", (F.size("ga") + F.size("gb")).alias("n"), common("ga", "gb").alias("c"))
        alike = both.where(F.col("c") / (F.col("n") - F.col("c")) >= limit)
        swap = F.col("a") > F.col("b")
        return alike.select(*(F.when(swap, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in (("ka", "kb"), ("kb", "ka"), ("a", "b"), ("b", "a"), ("ta", "tb"), ("tb", "ta"))))


class CoMentionEdges:
    """Edges (src, dst, ts) between all names that a text mentions together; names are runs of capitalised words."""

    PATTERN = r"(\p{Lu}[\p{L}\p{N}_]+(?:\s+\p{Lu}[\p{L}\p{N}_]+)*)"

    def __init__(self, text, ts, pattern=None, name="co_mention_edges"):
        self.text, self.ts, self.pattern, self.name = text, ts, pattern or self.PATTERN, name

    def compute(self, rows):
        found = F.sort_array(F.array_distinct(F.regexp_extract_all(F.coalesce(q(self.text), F.lit("")), F.lit(self.pattern), F.lit(1))))
        d = rows.select(found.alias("m"), q(self.ts).alias("ts")).where(F.size("m") > 1)
        first = d.select("m", "ts", F.posexplode("m").alias("i", "src"))
        return first.select("src", F.explode(F.slice("m", F.col("i") + 2, F.size("m"))).alias("dst"), "ts")
