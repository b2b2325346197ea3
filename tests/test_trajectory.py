"""Series of several blocks against all pairs."""

import numpy as np
import pytest

from asofloom import bridges as b


@pytest.mark.parametrize("rows, blocks", [(7, 2), (4096, 8)])
def test_trajectory_in_blocks(spark, monkeypatch, rows, blocks):
    monkeypatch.setattr(b.EmbeddingTrajectory, "ROWS", rows, raising=False)
    monkeypatch.setattr(b.EmbeddingTrajectory, "BLOCKS", blocks, raising=False)
    rng = np.random.default_rng(2)
    data = [(n, key, int(rng.integers(0, 40)), None if n % 17 == 3 else [0.0] * 4 if n % 23 == 5 else rng.normal(size=4).tolist()) for key in ("a", "b", None) for n in range({"a": 0, "b": 70, None: 140}[key], {"a": 70, "b": 140, None: 150}[key])]
    got = {r["id"]: r for r in b.EmbeddingTrajectory("id", "k", "o", "v").run(spark.createDataFrame(data, "id int, k string, o int, v array<double>")).collect()}
    assert len(got) == len(data)
    unit = lambda x: x / (np.linalg.norm(x) or 1)
    for key in ("a", "b", None):
        seen = []
        for n, _, _, v in sorted((r for r in data if r[1] == key), key=lambda r: (r[2], str(r[0]))):
            r = got[n]
            mine = [r["novelty"], r["drift"], r["volatility"]]
            if v is None or not seen:
                assert mine == [None] * 3
            else:
                u = unit(np.array(v))
                assert mine == pytest.approx([1 - max(u @ unit(x) for x in seen), 1 - u @ unit(np.mean(seen, axis=0)), 1 - u @ unit(seen[-1])], abs=1e-9)
            if v is not None:
                seen.append(np.array(v))


def test_no_task_has_a_whole_series(spark, monkeypatch):
    """The groups that Python is given are blocks, not series."""
    monkeypatch.setattr(b.EmbeddingTrajectory, "ROWS", 10, raising=False)
    monkeypatch.setattr(b.EmbeddingTrajectory, "BLOCKS", 2, raising=False)
    df = spark.range(100).selectExpr("id", "1 as k", "array(id + 1d, 1d) as v")
    plan = b.EmbeddingTrajectory("id", "k", "id", "v").run(df)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan
