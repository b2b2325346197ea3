"""The vectors of the topic share in the driver and in tables."""

import numpy as np
import pytest

from asofloom import bridges as b
from asofloom.bridges import texts

WORDS = "apple banana cherry melon grape zebra lion tiger bear wolf".split()


def rows(spark):
    rng = np.random.default_rng(4)
    data = [(n, " ".join(rng.choice(WORDS[:7] if n % 2 else WORDS[3:], rng.integers(1, 9)))) for n in range(80)] + [(80, None), (81, "the of")]
    return spark.createDataFrame(data, "id int, text string")


def shares(df):
    return {r["id"]: r["tfidf_topic_share"] for r in df.collect()}


def test_both_ways_are_the_same(spark, monkeypatch):
    df = rows(spark)
    dense = shares(b.TfidfTopicShare("id", "text").run(df))
    monkeypatch.setattr(b.TfidfTopicShare, "MAX_TERMS", 5, raising=False)
    tables = shares(b.TfidfTopicShare("id", "text").run(df))
    assert len(dense) == 82 and dense[80] == dense[81] == 0
    assert [dense[n] for n in range(82)] == pytest.approx([tables[n] for n in range(82)], abs=1e-6)


def test_fitted_on_other_rows(spark, monkeypatch):
    df = rows(spark)
    bridge = b.TfidfTopicShare("id", "text")
    dense = shares(bridge.compute(df, df.where("id < 30")))
    monkeypatch.setattr(b.TfidfTopicShare, "MAX_TERMS", 0, raising=False)
    assert dense == pytest.approx(shares(bridge.compute(df, df.where("id < 30"))), abs=1e-6)


def test_rounds_move_no_documents(spark, monkeypatch):
    """Each round of a known vocabulary writes nothing; before, all rounds did."""
    tables, plain = [], texts.written

    def counted(*a, **k):
        tables.append(1)
        return plain(*a, **k)

    monkeypatch.setattr(texts, "written", counted)
    shares(b.TfidfTopicShare("id", "text").run(rows(spark)))
    assert len(tables) <= 4
