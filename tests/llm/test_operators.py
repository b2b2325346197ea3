"""The ten operators on small fixtures: brute force, round trips, held-out accuracy, and the edge cases all of them share."""

import collections
import html.parser
import re
import time

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from asofloom.llm import decontam, html_extract, langid, packing, quality, queries, sharding, simhash, token_counts, topk, toxicity
from tests.conftest import SF, rows_of

from . import plain

RANKS = f"{queries.TOKENIZERS}/{queries.RANKS}"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.mark.parametrize("name", queries.SQL)
def test_sql(spark, duck, name):
    assert rows_of(queries.QUERIES[name](spark, SF)) == rows_of(duck.sql(queries.SQL[name]))


# ---- 1


def test_token_counts_are_those_of_whole_texts(spark, docs, odd):
    own = token_counts.encoding(RANKS)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs, RANKS).collect()}
    assert got == {i: len(own.encode_ordinary(t)) for i, t in texts.items()}
    rows = collections.Counter((r["doc_id"], r["n_tokens"]) for r in token_counts.token_counts(odd, RANKS).collect())
    assert rows[(1, None)] == 1 and rows[(2, 0)] == 1 and rows[(4, 6)] == 2 and rows[(6, len(own.encode_ordinary("the of and word " * 60_000)))] == 1
    assert rows[(None, len(own.encode_ordinary("no id here")))] == 1 and rows[(8, len(own.encode_ordinary("x" * 300_000)))] == 1 and token_counts.token_counts(odd.where("false"), RANKS).count() == 0
    text = "words and   spaces\n\n in " * 20
    assert "".join(token_counts.pieces(text, 50)) == text
    assert sum(len(own.encode_ordinary(p)) for p in token_counts.pieces(text, 50)) == len(own.encode_ordinary(text))


# ---- 2


def test_shards_with_nulls_and_repeats(odd):
    rows = sorted((r["doc_id"] or 0, r["start_byte"], r["n_bytes"], r["shard"]) for r in sharding.shards(odd, 4, range_rows=3).collect())
    assert len(rows) == 10 and sum(r[2] for r in rows) == max(r[1] + r[2] for r in rows)
    run = 0
    for _, start, size, _ in sorted(rows, key=lambda r: (r[0], r[1])):
        assert start == run
        run += size
    assert [r[3] for r in sorted(rows, key=lambda r: (r[0], r[1]))] == sorted(r[3] for r in rows)
    assert sharding.shards(odd.where("false")).count() == 0


# ---- 3


def test_language_held_out(spark, docs):
    train, test = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    got = langid.identify(test, langid.fit_on(train)).join(test.select("doc_id", F.col("lang").alias("truth")), "doc_id").collect()
    assert np.mean([r["lang"] == r["truth"] for r in got]) > 0.95


def test_language_is_that_of_plain_scoring(spark, docs):
    """Model and scores anew, a word at a time; the sample is the whole table here."""
    rows = docs.collect()
    model = plain.language_model([(r["text"], r["lang"]) for r in rows if r["text"] is not None and r["lang"] is not None])
    got = {r["doc_id"]: r for r in langid.identify(docs, langid.fit_on(docs)).collect()}
    for r in rows:
        lang, margin, known = plain.language(model, r["text"])
        g = got[r["doc_id"]]
        assert abs(g["margin"] - margin) < 1e-3 and abs(g["known"] - known) < 1e-4 and (g["lang"] == lang or abs(margin - langid.MIN_MARGIN) < 1e-4)


def test_language_backs_off_to_shorter_grams():
    m = langid.fit([("aaa aaa bbb bbb", "x"), ("ccc ccc ddd ddd", "y")])
    assert langid.score_word(m, "aaa")[0] > langid.score_word(m, "aaa")[1]
    assert langid.score_word(m, "aab")[0] > langid.score_word(m, "aab")[1] and langid.score_word(m, "qqq") is None


def test_language_edge_cases(odd, docs):
    got = {r["doc_id"]: r["lang"] for r in langid.identify(odd, langid.fit_on(docs)).collect()}
    assert {got[i] for i in (1, 2, 3, 7)} == {"und"} and got[6] == "en"
    assert {r["lang"] for r in langid.identify(odd, langid.fit([])).collect()} == {"und"}


# ---- 4


def check_packs(rows, lengths, window):
    packs, pieces = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        packs[r["pack_id"]] += r["length"]
        pieces[r["doc_id"]].append((r["start"], r["length"]))
    assert max(packs.values(), default=0) <= window and len({(r["pack_id"], r["slot"]) for r in rows}) == len(rows)
    assert {i: sum(n for _, n in p) for i, p in pieces.items()} == {i: n for i, n in lengths.items() if n}
    return packs


def test_packing(spark, docs, odd):
    rows = packing.pack(docs, window=512, grid=64).collect()
    lengths = {r["doc_id"]: -(-len(r["text"].encode()) // 4) for r in docs.collect()}
    packs = check_packs(rows, lengths, 512)
    assert len(packs) <= 1.1 * sum(lengths.values()) / 512 + 1
    assert packing.pack(odd.where("false")).count() == 0


def packed_by_hand(lengths, window, grid):
    """The pieces of (id, length) rows taken one after the other by the repeats of the recipe's patterns."""
    pieces = sorted(((-1 if i is None else i), s, min(window, n - s)) for i, n in lengths for s in range(0, n or 0, window))
    queues, out, pack = collections.defaultdict(collections.deque), [], 0
    for p in pieces:
        queues[-(-p[2] * grid // window)].append(p)
    for sizes, times in packing.recipe([len(queues[s]) for s in range(grid + 1)], grid):
        assert 0 < sum(sizes) <= grid
        for _ in range(times):
            out += [(*queues[s].popleft(), pack, slot) for slot, s in enumerate(sizes)]
            pack += 1
    assert not any(queues.values())
    return sorted(out)


def test_packing_is_that_of_plain_queues(spark, docs, odd):
    """Nulls, empty and very long texts, repeated rows and clashing columns as well; several ranges, whatever the partitioning."""
    for df, window, grid in ((docs, 512, 64), (odd, 2048, 128), (odd.repartition(5), 64, 16)):
        odds = df.withColumns({c: F.lit("clash") for c in ("size", "rank", "p", "n", "base", "length", "lo")})
        lengths = [(r["doc_id"], -(-len((r["text"] or "").encode()) // 4)) for r in df.collect()]
        got = sorted((-1 if r["doc_id"] is None else r["doc_id"], *r[1:]) for r in packing.pack(odds, window=window, grid=grid, range_rows=50).collect())
        assert got == packed_by_hand(lengths, window, grid)


def test_nnls_is_the_best_of_all_supports():
    rng = np.random.default_rng(2)
    for _ in range(20):
        a, y = rng.random((5, 6)), rng.normal(0, 1, 5)
        best = np.linalg.norm(y)
        for mask in range(1, 64):
            p = [j for j in range(6) if mask >> j & 1]
            x = np.linalg.lstsq(a[:, p], y, rcond=None)[0]
            if (x >= 0).all():
                best = min(best, np.linalg.norm(a[:, p] @ x - y))
        assert np.linalg.norm(a @ packing.nnls(a, y) - y) == pytest.approx(best, abs=1e-8)


def test_nnls_solves_what_has_a_solution():
    rng = np.random.default_rng(1)
    a, x = rng.random((12, 20)), np.zeros(20)
    x[[2, 7, 11]] = 3, 1, 2
    got = packing.nnls(a, a @ x)
    assert (got >= 0).all() and np.abs(a @ got - a @ x).max() < 1e-6


# ---- 5


def test_toxicity_held_out_and_stems(spark):
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abdeilmnorst"), 5)) for _ in range(400)]
    ends = ["ab", "ol", "en", "ur", "is", "om"]
    text = lambda bad: " ".join([*rng.choice(words, 30), *(["vexul" + rng.choice(ends) + rng.choice(ends)] * bad)])
    rows = [(text(i % 3 == 0), "en", int(i % 3 == 0)) for i in range(600)]
    model = toxicity.fit(rows[:450])
    p = toxicity.Scorer(model).scores(pa.array([r[0] for r in rows[450:]]))
    y = np.array([r[2] for r in rows[450:]])
    cut = model["thresholds"].get("en", model["common"])
    assert np.mean((p >= cut)[y == 1]) > 0.9 and np.mean((p >= cut)[y == 0]) < 0.05


def test_toxicity_is_that_of_plain_convolution(docs, labels):
    model = toxicity.fit_on(docs.where("doc_id % 2 = 0"), labels)
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, model).collect()}
    for r in docs.collect():
        assert got[r["doc_id"]]["score"] == pytest.approx(plain.toxic_score(model, r["text"]), abs=1e-4)


def test_toxicity_held_out_on_labels():
    """Fitted on even ids of the largest tables, judged on odd ones: words that the sample lacks must be known by their stems."""
    docs, labels = (pq.read_table(f"/root/testdata/sf0.1/{t}.parquet").to_pydict() for t in ("documents", "labels"))
    toxic = dict(zip(labels["doc_id"], labels["toxic"], strict=True))
    rows = [(t, x, int(toxic[i]), i) for i, t, x in zip(docs["doc_id"], docs["text"], docs["lang"], strict=True) if i in toxic and t]
    model = toxicity.fit([r[:3] for r in rows if r[3] % 2 == 0])
    rest = [r for r in rows if r[3] % 2]
    marked = toxicity.Scorer(model).scores(pa.array([r[0] for r in rest])) >= np.array([model["thresholds"].get(r[1], model["common"]) for r in rest])
    y = np.array([r[2] for r in rest])
    assert marked[y == 1].mean() > 0.85 and marked[y == 0].mean() < 0.05


def test_toxicity_edge_cases(odd, docs, labels):
    model = toxicity.fit_on(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.toxicity(odd, model).collect()}
    assert all(got[i]["score"] == 0 and not got[i]["toxic"] for i in (1, 2, 3, 7))
    every = toxicity.toxicity(odd.withColumn("lang", F.lit(None).cast("string")), model).collect()  # the common threshold
    assert len(every) == 10 and all(r["toxic"] == (r["score"] >= model["common"] and r["score"] > 0) for r in every)
    assert len({r[1:] for r in every if r["doc_id"] == 4}) == 1 and sum(r["doc_id"] == 4 for r in every) == 2
    assert toxicity.toxicity(odd.where("false"), model).count() == 0
    assert not any(r["toxic"] for r in toxicity.toxicity(odd, toxicity.fit([])).collect())


# ---- 6


def nearest_by_brute_force(v, k, every=1):
    want = []
    for i in range(0, len(v), every):
        d = np.sqrt(((v - v[i]) ** 2).sum(1))
        order = sorted((d[j], j) for j in range(len(v)) if j != i)[:k]
        want += [(i, r + 1, j, round(dist, 6)) for r, (dist, j) in enumerate(order)]
    return want


def test_top_k_with_ties_nulls_and_repeats(spark):
    rng = np.random.default_rng(3)
    v = rng.integers(0, 3, (300, 4)).astype(float)
    v[100:220] = v[100]  # a hot group of equal vectors
    v[5] = -0.0
    rows = [(i, x.tolist(), 1) for i, x in enumerate(v)]
    bad = [(0, [9.0] * 4, 1), (None, [1.0] * 4, 1), (900, None, 1), (901, [1.0], 1), (902, [float("nan")] * 4, 1), (903, [None] * 4, 1), (904, [], 1)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, rank int")
    got = sorted(tuple(r) for r in topk.top_k(df, 5, every=1, cell_rows=40, range_rows=20).collect())
    assert got == sorted(nearest_by_brute_force(v, 5))
    several = sorted(tuple(r) for r in topk.top_k(df, 5, every=3, cell_rows=40, block_bytes=500).collect())
    assert several == sorted(nearest_by_brute_force(v, 5, 3))
    assert topk.top_k(df.where("vec_id = 5"), every=5).count() == 0 and topk.top_k(df.where("false")).count() == 0
    with pytest.raises(TypeError):
        topk.top_k(df.withColumn("vec_id", F.lit("a")))


def test_top_k_where_bounds_prune(spark):
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.normal(c, 0.1, (100, 3)) for c in rng.normal(0, 1000, (12, 3))])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id int, embedding array<double>")
    assert sorted(tuple(r) for r in topk.top_k(df, 7, every=4, cell_rows=30).collect()) == sorted(nearest_by_brute_force(v, 7, 4))


# ---- 7


def test_decontamination_is_that_of_plain_search(spark):
    rng = np.random.default_rng(4)
    vocab = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(vocab, n))) for i, n in enumerate((9, 12, 6, 30, 3))] + [(9, None), (None, "w1 w2 w3 w4 w5 w6 w7 w8"), (10, "")]
    docs = [(i, " ".join(rng.choice(vocab, 80))) for i in range(30)]
    docs += [(100, f"Start, {items[0][1].upper()}! end"), (101, items[2][1]), (102, "x " * 70_000 + items[3][1]), (103, None), (104, ""), (100, items[1][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("hits", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    norm = lambda t: " " + re.sub(r"[^\w]+|_", " ", (t or "").lower()).strip() + " "
    want = collections.Counter()
    for d, t in docs:
        hits = collections.Counter()
        for i, it in items:
            w = norm(it).split()
            if i is None or len(w) < decontam.MIN_WORDS:
                continue
            for g in {" " + " ".join(w[k : k + 8]) + " " for k in range(max(1, len(w) - 7))}:
                hits[i] += len(re.findall(f"(?={re.escape(g)})", norm(t)))
        want.update((d, i, n) for i, n in hits.items() if n)
    got = collections.Counter(tuple(r) for r in decontam.contamination(df, bench).collect())
    assert got == want
    assert collections.Counter(tuple(r) for r in decontam.contamination(df, bench, pass_bytes=200).collect()) == want
    kept = {r["doc_id"] for r in decontam.decontaminate(df, bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _, _ in want} and {103, 104} <= kept
    assert decontam.contamination(df, bench.where("false")).count() == 0


def test_short_and_unspaced_items_are_sought(spark):
    long = "今天天气很好我们一起去公园散步然后回家吃饭"
    items = [(1, "Yes."), (2, "42"), (3, "a b"), (4, "red blue"), (5, long), (6, "ภาษาไทย"), (7, "?!"), (8, "東京"), (9, "one two three four")]
    docs = [(1, "yes, YES; yesterday a-b"), (2, "x 42 y 420"), (3, "red, blue red"), (4, f"他说{long}真好"), (5, "นี่คือภาษาไทยครับ"), (6, "夏の東京は暑い"), (7, "zero one two three four five"), (8, "yesno"), (9, f"今天天气很好我们，{long[8:12]}"), (10, "one two three")]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["hits"] for r in decontam.contamination(df, bench).collect()}
    assert got == {(1, 1): 2, (1, 3): 1, (2, 2): 1, (3, 4): 1, (4, 5): len(long) - 7, (5, 6): 1, (6, 8): 1, (7, 9): 1, (9, 5): 5}
    assert {r["doc_id"] for r in decontam.decontaminate(df, bench).collect()} == {8, 10}


def test_decontamination_edge_cases(spark, odd):
    long = "x" * 70_000
    bench = spark.createDataFrame([(1, long), (1, "a b"), (1, long), (2, f"{long} {long} y"), (3, "a b")], "item_id int, text string")
    docs = spark.createDataFrame([(1, f"{long} {long} Y!"), (2, f"{long}x a-B"), (None, long), (None, long)], "doc_id long, text string")
    got = collections.Counter((r["doc_id"], r["item_id"], r["hits"]) for r in decontam.contamination(docs, bench).collect())
    assert got == {(1, 1, 2): 1, (1, 2, 1): 1, (2, 1, 1): 1, (2, 3, 1): 1, (None, 1, 1): 2}
    assert decontam.contamination(docs, bench, pass_bytes=300_000).count() == 6
    assert sorted((r["item_id"], r["hits"]) for r in decontam.contamination(docs, bench, min_words=3).collect()) == [(2, 1)]
    only = spark.createDataFrame([(1, long)], "item_id long, text string")
    assert decontam.contamination(docs, only).count() == 3 and decontam.decontaminate(docs, only).count() == 1
    assert decontam.decontaminate(odd, bench).count() == odd.count() and decontam.decontaminate(odd, bench).columns == odd.columns
    for nothing in (bench.where("false"), spark.createDataFrame([(1, None), (2, "?!"), (None, "the")], "item_id long, text string")):
        assert decontam.contamination(odd, nothing).count() == 0 and decontam.decontaminate(odd, nothing).count() == odd.count()
    assert decontam.contamination(odd.where("false"), bench).count() == 0 and decontam.decontaminate(odd.where("false"), bench).count() == 0
    with pytest.raises(TypeError):
        decontam.contamination(docs, bench.withColumn("item_id", F.lit("a")))


# ---- 8


def test_quality_held_out(spark, docs, labels):
    model = quality.fit_on(docs.where("doc_id % 2 = 0"), labels)
    got = quality.quality(docs.where("doc_id % 2 = 1"), model).join(labels, "doc_id").collect()
    assert np.mean([r["keep"] == (r["quality"] == 1) for r in got]) > 0.85


def test_quality_is_that_of_plain_features(docs, labels):
    model = quality.fit_on(docs, labels)
    got = {r["doc_id"]: r for r in quality.quality(docs, model).collect()}
    for r in docs.collect():
        score = plain.quality_score(model, r["text"])
        assert got[r["doc_id"]]["score"] == pytest.approx(score or 0.0, abs=1e-4)
        assert got[r["doc_id"]]["keep"] == (score is not None and got[r["doc_id"]]["score"] >= 0)


def test_dual_descent_finds_the_least_hinge_loss():
    rng = np.random.default_rng(6)
    x, cost = rng.normal(0, 1, (60, 5)), np.full(60, 0.7)
    y = np.where(x @ np.array([1, -2, 0.5, 0, 1]) + rng.normal(0, 1, 60) > 0, 1.0, -1.0)
    w = quality.dual_descent(np.arange(0, 301, 5), np.tile(np.arange(5), 60), x.ravel(), y, cost, 2000)[:5]
    loss = lambda v: v @ v / 2 + (cost * np.maximum(0, 1 - y * (x @ v))).sum()
    assert all(loss(w) <= loss(w + d) + 1e-4 for s in (0.01, 0.1, 1) for d in rng.normal(0, s, (300, 5)))


def test_quality_edge_cases(odd, docs, labels):
    got = {r["doc_id"]: r for r in quality.quality(odd, quality.fit_on(docs, labels)).collect()}
    assert all(got[i]["score"] == 0 and not got[i]["keep"] for i in (1, 2, 3))
    assert quality.fit([]) is None and quality.quality(odd, None).count() == 10
    assert {r["doc_id"]: r["keep"] for r in quality.quality(odd, None).collect()} == {i: i not in (1, 2, 3) for i in (None, *range(1, 9))}  # ties at 0
    twice = [r[1:] for r in quality.quality(odd, quality.fit_on(docs.union(docs), labels.union(labels))).collect() if r["doc_id"] == 4]
    assert len(twice) == 2 and twice[0] == twice[1] and tuple(twice[0]) == tuple(got[4][1:])
    assert quality.quality(odd.where("false"), None).count() == 0


# ---- 9


def test_covering_masks_cover():
    masks = np.array([[(m >> i) & 1 for i in range(128)] for m in simhash.covering_masks()], bool)
    rng = np.random.default_rng(2)
    for _ in range(300):
        differing = rng.choice(128, simhash.RADIUS, replace=False)
        assert (~masks[:, differing].any(axis=1)).any()


def test_groups_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(5)
    texts = {}
    for g in range(25):
        w = [f"t{x}" for x in rng.integers(0, 3000, 120)]
        for c in range(rng.integers(1, 5)):
            own = w[:]
            for _ in range(c * 3):
                own[rng.integers(120)] = f"n{rng.integers(9999)}"
            texts[len(texts)] = " ".join(own)
    texts |= {1000 + i: "many copies of one text " * 5 for i in range(60)}
    sig = simhash.signatures(pa.array(list(texts.values())))[1]
    d = np.bitwise_count(sig[:, None, 0] ^ sig[None, :, 0]).astype(int) + np.bitwise_count(sig[:, None, 1] ^ sig[None, :, 1])
    ids, root = list(texts), {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in zip(*np.nonzero(d <= simhash.RADIUS), strict=True):
        a, b = sorted((find(ids[i]), find(ids[j])))
        root[b] = a
    got = {r["doc_id"]: r["group_id"] for r in simhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == {i: find(i) for i in texts}


def test_number_of_blocks_changes_no_result(spark, docs):
    every = [sorted(tuple(r) for r in simhash.near_duplicates(docs, blocks=b).collect()) for b in (2, 3, 4)]
    assert every[0] == every[1] == every[2]
    assert simhash.best_blocks(10_000) == simhash.best_blocks(100_000_000) == 3 and simhash.best_blocks(10**11) == 2
    assert simhash.best_blocks(10**11, radius=0) == 1 and all(sum(r + 1 for r in simhash.block_radii(15, b)) == 16 for b in (1, 2, 3))


def test_duplicates_edge_cases(spark, odd):
    got = {r["doc_id"]: r["group_id"] for r in simhash.near_duplicates(odd).collect()}
    assert got[4] == got[5] == 4 and all(got[i] == i for i in (1, 2, 3, 7)) and None not in got
    kept = sorted(r["doc_id"] or 0 for r in simhash.deduplicate(odd).collect())
    assert kept == [0, 1, 2, 3, 4, 6, 7, 8]
    assert simhash.near_duplicates(odd.where("false")).count() == 0 and simhash.deduplicate(odd.where("false")).count() == 0


def test_of_rows_that_repeat_an_id_always_the_same_one_stays(spark):
    texts = [None, "", "some words of a text", "other words of it here", "other words of it here", "and a third text again"]
    rows = [(1, texts[k % 6], None if k % 5 == 0 else f"s{k % 7}") for k in range(60)] + [(2, None, f"s{k}") for k in range(9)] + [(None, "x", "s")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = [sorted(map(str, simhash.deduplicate(d).collect())) for d in (df.coalesce(1), df.repartition(5), df.orderBy(F.desc("source")).repartition(3, "source"))]
    assert kept[0] == kept[1] == kept[2] and len(kept[0]) == 4
    texts = sorted({t for t in texts if t}, key=lambda t: tuple(simhash.signatures(pa.array([t]))[1][0].view(np.int64).tolist()))
    assert {r["text"] for r in simhash.deduplicate(df).where("doc_id = 1").collect()} == {texts[0]}


# ---- 10


def test_html_rules():
    good = "The house of the people and the story that they were told in a long way is for all of us to be there with them, as it was. " * 3
    page = f"<html lang=en><head><title>x</title></head><body><nav><a href=1>Home</a></nav><h1>Title</h1><p>{good}</p><p>Short one.</p><p>{good}</p><p><a href=2>{good}</a></p><script>{good}</script><footer>{good}</footer><p>&copy; 2020 {good}"
    text, blocks, n = html_extract.extract_page(page)
    assert text.split("\n") == ["Title", good.strip(), "Short one.", good.strip()] and n == 4 and blocks > n
    assert html_extract.second_pass(["short", "good", "near", "bad", "short"]) == ["bad", "good", "good", "bad", "bad"]
    assert html_extract.extract_page("") == ("", 0, 0) and html_extract.extract_page("<p>a < b")[1] == 1


def test_html_head_without_end_tag():
    good = "The house of the people and the story that they were told in a long way is for all of us to be there with them, as it was. " * 3
    head = "<title>The <body> of a title <!-- x</title>\n<meta name=a content='<p>'><link href=b><style>p {}</style><script>'</head>'</script><!-- <p> -->"
    whole = html_extract.extract_page(f"<html lang=en><head>{head}</head><body><p>{good}</p><p>{good}</p>")
    assert whole == (f"{good.strip()}\n{good.strip()}", 2, 2)
    for body in (f"<body><p>{good}</p>", f"<p>{good}</p>", f"{good}", f"<div>{good}</div>", f"<header></header>{good}<p>"):
        assert html_extract.extract_page(f"<html lang=en><head>{head}{body}<p>{good}</p>") == whole
        assert html_extract.extract_page(f"<html lang=en><HEAD profile=x>{head}{body}<p>{good}</p><script>'</head>'</script>") == whole
    assert html_extract.extract_page(f"<html lang=en><head><title>t<body><p>{good}</p><p>{good}") == whole


def test_html_language_after_a_long_comment():
    text = "Haus und Garten der Leute " * 10
    page = f"<!-- <html lang=de> {'x' * 5000} --><html lang=fr><body><p>{text}</p>"
    assert html_extract.extract_page(page) == html_extract.extract_page(f"<html lang=fr><body><p>{text}</p>") != html_extract.extract_page(f"<body><p>{text}</p>")


class Plain(html.parser.HTMLParser):
    """Blocks of a page by the standard library's parser: (text, characters in links, heading, furniture)."""

    def __init__(self):
        super().__init__()
        self.out, self.text, self.linked, self.inside, self.language = [], "", 0, [], None

    def flush(self):
        text = " ".join(self.text.split())
        if text:
            self.out.append((text, min(self.linked, len(text)), any(t in html_extract.HEADINGS for t in self.inside), any(t in html_extract.FURNITURE for t in self.inside)))
        self.text, self.linked = "", 0

    def handle_starttag(self, tag, attrs):
        if tag == "html":
            self.language = dict(attrs).get("lang")
        if tag in html_extract.BLOCK_TAGS:
            self.flush()
        if tag not in ("br", "hr", "meta", "link", "img", "input"):
            self.inside.append(tag)

    def handle_endtag(self, tag):
        if tag in html_extract.BLOCK_TAGS:
            self.flush()
        if tag in self.inside:
            del self.inside[len(self.inside) - 1 - self.inside[::-1].index(tag) :]

    def handle_data(self, data):
        if not any(t in ("script", "style", "head", "noscript", "template", "svg") for t in self.inside):
            self.text += data
            if "a" in self.inside:
                self.linked += len(" ".join(data.split()))


def page_by_brute_force(page):
    """The rules block by block: each ambiguous block looks for its own neighbours."""
    parser = Plain()
    parser.feed(page)
    parser.close()
    parser.flush()
    stop = set(html_extract.STOP_WORDS.get(parser.language, " ".join(html_extract.STOP_WORDS.values())).split())

    def label(text, linked, heading, furniture):
        if furniture or linked / len(text) > 0.2 or "©" in text:
            return "bad"
        if len(text) < 70:
            return "bad" if linked else "short"
        tokens = re.findall(r"[^\W\d_]+", text.lower())
        share = sum(t in stop for t in tokens) / max(1, len(tokens))
        return ("good" if len(text) > 200 else "near") if share >= 0.18 else "near" if share >= 0.12 else "bad"

    first = [label(*b) for b in parser.out]
    decided = lambda order: next((first[j] for j in order if first[j] in ("good", "bad")), "bad")
    final = []
    for i, x in enumerate(first):
        before, after = decided(range(i - 1, -1, -1)), decided(range(i + 1, len(first)))
        if x == "near":
            x = "good" if "good" in (before, after) else "bad"
        elif x == "short" and before == after:
            x = before
        elif x == "short":
            toward = range(i + 1, len(first)) if after == "bad" else range(i - 1, -1, -1)
            x = "good" if next((first[j] for j in toward if first[j] != "short"), None) == "near" else "bad"
        final.append(x)
    for i in range(len(first) - 2, -1, -1):
        _, linked, heading, furniture = parser.out[i]
        if heading and not linked and not furniture and final[i + 1] == "good":
            final[i] = "good"
    good = [b[0] for b, x in zip(parser.out, final, strict=True) if x == "good"]
    return "\n".join(good), len(first), len(good)


def test_html_is_that_of_a_plain_parser(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: (r["text"], r["blocks"], r["good"]) for r in html_extract.extract(pages).collect()}
    assert got == {r["page_id"]: page_by_brute_force(r["html"]) for r in pages.collect()} and any(g[2] for g in got.values())


def test_html_left_open_takes_no_longer(spark):
    broken = ["<p " + 'a="b" ' * 10_000, "<a " * 100_000, '<a "' * 100_001, "<head>" + "<title>" * 50_000, "<!" * 100_000, "<script>" + "</script" * 50_000, "<svg" * 50_000]
    began = time.time()
    assert all(html_extract.extract_page(b)[2] == 0 for b in broken)
    assert time.time() - began < 20
    good = "The house of the people and the story that they were told in a long way is for all of us to be there with them, as it was. " * 3
    assert html_extract.extract_page(f"<p>{good}</p><p>{good}<a title='" + 'x="y" ' * 1000)[2] == 2
    assert html_extract.extract_page(f"<p>{good}</p><p class=x <b>{good}</b>")[2] == 2


def test_html_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "<div>" * 20_000), (4, "<!-- never closed"), (None, "<p>x"), (2, "")]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumn("text", F.lit("clash"))
    got = html_extract.extract(df).collect()
    assert len(got) == 6 and [r["text"] for r in got if r["page_id"] == 1] == [None] and all(r["text"] == "" for r in got if r["page_id"] == 2)
