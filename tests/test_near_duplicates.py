"""Near duplicates with copies, against all pairs."""

import random

from asofloom import bridges as b
from asofloom.queries import QUERIES, SQL

from .conftest import SF, rows_of


def texts():
    r = random.Random(5)
    word = lambda: f"w{chr(97 + r.randrange(26))}{chr(97 + r.randrange(26))}"
    foot = " ".join(word() for _ in range(30))
    out = []
    for _ in range(12):
        base = [word() for _ in range(r.choice([1, 2, 3, 40, 200]))]
        for _ in range(8):
            t = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                t[r.randrange(len(t))] = word()
            out.append(" ".join(t) + (" " + foot if r.random() < 0.5 else ""))
    return [(i, t) for i, t in enumerate(out + ["", None, "A. a!", "a a"])]


def alike(x, y):
    return len(x & y) / len(x | y) >= 0.8


def test_every_link_with_and_without_copies(spark):
    rows = texts()
    df = spark.createDataFrame(rows, "id int, text string")
    import re

    sets = {}
    for i, t in rows:
        w = re.findall(r"[a-z]+", (t or "").lower())
        if w:
            sets[i] = frozenset(tuple(w[k : k + 3]) for k in range(len(w) - 2)) if len(w) >= 3 else frozenset([tuple(w)])
    edges = {(x, y) for x in sets for y in sets if x < y and alike(sets[x], sets[y])}
    bridge = b.NearDuplicateEdges("id", "text", "id")
    assert sorted(tuple(r) for r in bridge.compute(df).collect()) == sorted((x, y, y) for x, y in edges)
    first = {i: min(j for j in sets if sets[j] == s) for i, s in sets.items()}
    want = {(x, y, y, False) for x, y in edges if first[x] == x and first[y] == y and sets[x] != sets[y]} | {(first[i], i, i, True) for i in sets if first[i] != i}
    assert sorted(tuple(r) for r in bridge.condensed(df).collect()) == sorted(want)


def test_copies_are_not_compared(spark):
    """3,000 copies make a row each, not 4.5 million."""
    df = spark.range(3000).selectExpr("id", "'the same few words in each of them' as text")
    got = b.NearDuplicateEdges("id", "text", "id").condensed(df)
    assert got.count() == 2999 and got.where("src = 0 and same").count() == 2999


def test_condensed_matches_sql(spark, duck):
    name = "bridge_near_duplicate_edges"
    assert rows_of(QUERIES[name](spark, SF)) == rows_of(duck.sql(SQL[name]))
