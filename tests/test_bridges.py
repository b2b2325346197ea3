import datetime as dt

import numpy as np
import pytest

from asofloom import bridges as b
from asofloom.bridges.graphs import louvain, simple_edges


def edges(spark, pairs):
    return spark.createDataFrame([(*p, dt.date(2024, 1, 1)) for p in pairs], "s string, t string, ts date")


def values(df, key="node"):
    return {r[key]: r for r in df.collect()}


PATH = [("a", "b"), ("b", "c"), ("c", "d"), ("b", "a"), ("d", "b")]


def test_pagerank_is_that_of_dense_iteration(spark):
    names = sorted({x for p in PATH for x in p} | {"z"})
    pairs = [*PATH, ("a", "z")]
    m = np.zeros((5, 5))
    for s, t in pairs:
        m[names.index(s), names.index(t)] = 1
    r = np.full(5, 0.2)
    for _ in range(200):
        out = m.sum(1)
        r = 0.15 / 5 + 0.85 * (np.where(out > 0, r / np.maximum(out, 1), 0) @ m + r[out == 0].sum() / 5)
    got = values(b.PageRank("s", "t").run(edges(spark, pairs)))
    assert [got[n]["pagerank"] for n in names] == pytest.approx(r, abs=1e-6)


def test_pagerank_converges_whatever_the_size(spark):
    rng = np.random.default_rng(0)
    n = 3000
    pairs = sorted({(int(a), int(b)) for a, b in zip(rng.integers(0, n, 9000), rng.integers(0, n, 9000) ** 2 // n, strict=True) if a != b})
    s, t = np.array(pairs).T
    nodes = np.unique([s, t])
    s, t = np.searchsorted(nodes, s), np.searchsorted(nodes, t)
    out, n = np.bincount(s, minlength=len(nodes)), len(nodes)
    r = np.full(n, 1 / n)
    for _ in range(200):
        r = 0.15 / n + 0.85 * (np.bincount(t, r[s] / out[s], minlength=n) + r[out == 0].sum() / n)
    got = values(b.PageRank("s", "t").run(spark.createDataFrame(pairs, "s long, t long")))
    assert [got[x]["pagerank"] / y for x, y in zip(nodes.tolist(), r, strict=True)] == pytest.approx(np.ones(n), abs=1e-4)


def test_centrality(spark):
    line = values(b.Centrality("s", "t", directed=False, heavy=True).run(edges(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("b", "d"), ("a", "a")])))
    assert {n: r["degree"] for n, r in line.items()} == {"a": 1, "b": 3, "c": 2, "d": 3, "e": 1}
    assert {n: r["coreness"] for n, r in line.items()} == {"a": 1, "b": 2, "c": 2, "d": 2, "e": 1}
    assert line["c"]["clustering"] == 1 and line["b"]["clustering"] == pytest.approx(1 / 3)
    assert line["b"]["betweenness"] == pytest.approx(0.5) and line["c"]["betweenness"] == 0 and line["a"]["closeness"] == pytest.approx(4 / 8)
    assert line["b"]["eigenvector"] == pytest.approx(line["d"]["eigenvector"], abs=1e-4)
    with pytest.raises(ValueError, match="max_edges"):
        b.Centrality("s", "t", heavy=True, max_edges=1).run(edges(spark, PATH))


def test_eigenvector_is_the_dense_one_or_null(spark):
    pairs = [("a", "b"), ("a", "c"), ("a", "d"), ("b", "c"), ("b", "d"), ("c", "d"), ("d", "e")]
    m = np.zeros((5, 5))
    for s, t in pairs:
        m["abcde".index(s), "abcde".index(t)] = m["abcde".index(t), "abcde".index(s)] = 1
    want = np.abs(np.linalg.eigh(m)[1][:, -1])
    heavy = lambda **k: {r["n"]: r["eigenvector"] for r in b.Centrality("s", "t", directed=False, heavy=True, **k)._eigenvector(simple_edges(edges(spark, pairs), "s", "t")).collect()}
    got = heavy()
    assert [got[n] for n in "abcde"] == pytest.approx(want, abs=1e-5)
    assert heavy(rounds=2) == dict.fromkeys("abcde")


CLIQUES = [(f"{g}{i}", f"{g}{j}") for g in "xy" for i in range(4) for j in range(i)] + [("x0", "y0")]


def test_communities(spark):
    got = values(b.Community("s", "t").run(edges(spark, CLIQUES)))
    assert {got[n]["community"] for n in got if n[0] == "x"} == {"x0"} and {got[n]["community"] for n in got if n[0] == "y"} == {"y0"}
    assert got["x0"]["modularity"] == pytest.approx(12 / 13 - 2 * (13 / 26) ** 2) and len(got) == 8
    with pytest.raises(ValueError, match="max_edges"):
        b.Community("s", "t", max_edges=1).run(edges(spark, CLIQUES))
    assert louvain(3, []) == [0, 1, 2]


def test_topic_share_is_the_first_singular_vector(spark):
    texts = ["apple banana apple", "banana cherry", "apple apple cherry", "zebra lion", "lion apple"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    words = sorted({w for t in texts for w in t.split()})
    tf = np.array([[t.split().count(w) for w in words] for t in texts], float)
    a = tf * (np.log((1 + 5) / (1 + (tf > 0).sum(0))) + 1)
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    u = np.abs(a @ np.linalg.svd(a)[2][0])
    got = values(b.TfidfTopicShare("id", "text").run(df), "id")
    assert [got[i]["tfidf_topic_share"] for i in range(5)] == pytest.approx(u, abs=1e-6)


def test_topic_share_converges_on_a_small_gap(spark):
    texts = [f"apple banana {x}" for x in ("cherry", "melon", "cherry melon", "grape")] + [f"zebra lion {x}" for x in ("tiger", "bear", "tiger bear", "grape")] + ["apple zebra", "banana"]
    words = sorted({w for t in texts for w in t.split()})
    tf = np.array([[t.split().count(w) for w in words] for t in texts], float)
    a = tf * (np.log((1 + len(texts)) / (1 + (tf > 0).sum(0))) + 1)
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    u = np.abs(a @ np.linalg.svd(a)[2][0])
    got = values(b.TfidfTopicShare("id", "text").run(spark.createDataFrame(list(enumerate(texts)), "id int, text string")), "id")
    assert [got[i]["tfidf_topic_share"] for i in range(len(texts))] == pytest.approx(u, abs=1e-6)


def test_near_duplicates_and_time(spark):
    base = " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}q" for i in range(60))
    rows = [(1, base, dt.date(2024, 3, 1)), (2, base + " x", dt.date(2024, 1, 1)), (3, "something else entirely here", dt.date(2024, 1, 1)), (4, None, dt.date(2024, 1, 1)), (5, "", None)]
    got = b.NearDuplicateEdges("id", "text", "ts").compute(spark.createDataFrame(rows, "id int, text string, ts date")).collect()
    assert [tuple(r) for r in got] == [(2, 1, dt.date(2024, 3, 1))]


def test_causal_guards(spark):
    df = edges(spark, PATH)
    with pytest.raises(ValueError):
        b.assert_known(df, "2023-01-01", "ts")
    b.assert_known(df, "2024-01-01", "ts")
    with pytest.raises(ValueError):
        b.assert_vintage(b.Sentiment("id", "text"), "2024-01-01")
    assert b.PageRank("s", "t").run(df, "2023-01-01", "ts").count() == 0
    snaps = b.PageRank("s", "t").snapshots(df, ["2023-12-31", "2024-01-01"], "ts")
    assert {str(r["as_of_date"]) for r in snaps.collect()} == {"2024-01-01"}


def test_result_joins_a_configuration(spark):
    from asofloom import Loom

    bridge = b.Sentiment("id", "text", "en")
    docs = spark.createDataFrame([(1, "a", "good good bad"), (2, "a", "bad"), (3, "b", None)], "id int, src string, text string")
    table = bridge.save(docs.join(bridge.run(docs), "id"), "sentiment_rows")
    part = bridge.config(table, "id", "src", "src", "src")
    c = {"target": "src", "max_depth": 2, "intervals": [], "aggregations": ["mean"], "transformations": ["identity"], "entities": [{"alias": "src", "table": "srcs", "id": "src"}, part["entity"]], "relationships": [part["relationship"]]}
    got = values(Loom(c, spark, ["2024-01-01"], {"srcs": docs.select("src").distinct()}).to_spark(), "src")
    assert got["a"]["MEAN(sentiment.sentiment)"] == pytest.approx((1 / 3 - 1) / 2) and got["b"]["MEAN(sentiment.sentiment)"] is None


def test_models_that_are_not_installed(spark):
    docs = spark.createDataFrame([(1, "x")], "id int, text string")
    for bridge in (b.NERCounts("id", "text"), b.SentenceEmbedding("id", "text")):
        with pytest.raises(ImportError):
            bridge.run(docs)


class Entity:
    def __init__(self, label):
        self.label_ = label


class Reader:
    """A stand-in for a named-entity model: capital letters are persons, signs of money are money."""

    def pipe(self, texts):
        for t in texts:
            self.ents = [Entity("PERSON" if c.isupper() else "MONEY") for c in t if c.isupper() or c in "$€"]
            yield self


class Encoder:
    def encode(self, texts, normalize_embeddings):
        assert normalize_embeddings
        return np.array([[1.0, 0.0] if t else [0.0, 1.0] for t in texts], np.float32)


def test_models_that_are_given(spark):
    docs = spark.createDataFrame([(1, "Ann paid Bob 5$"), (2, ""), (3, None)], "id int, text string")
    got = values(b.NERCounts("id", "text", model=Reader).run(docs), "id")
    assert (got[1]["persons"], got[1]["money"], got[1]["orgs"]) == (2, 1, 0) and got[2]["persons"] == got[3]["persons"] == 0
    got = values(b.SentenceEmbedding("id", "text", model=Encoder).run(docs), "id")
    assert got[1]["embedding"] == [1, 0] and got[2]["embedding"] == got[3]["embedding"] == [0, 1]
