"""Rows that share places, and entities with several places, against all pairs."""

import datetime as dt
import math
from collections import defaultdict

import pytest

from asofloom import Loom
from asofloom.operators import spatial

START = dt.date(2024, 1, 1)
WITHIN, WIDTH = 5000.0, 500.0


def metres(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6_371_000 * math.asin(math.sqrt(h))


def rows():
    """(id, lat, lon, since): 30 places of 12 rows each, some ids in two places, some twice in one, one without an id or a place."""
    out = [(i, 40 + i % 30 * 0.011, -87 + i % 30 % 7 * 0.017, START + dt.timedelta(i % 50)) for i in range(360)]
    out += [(i, 40 + i % 11 * 0.011, -87.0, START) for i in range(0, 360, 37)] + [(7, 40.077, -87.0, START), (7, *out[7][1:3], START), (None, 40.0, -87.0, START), (900, None, -87.0, START), (901, 50.0, 0.0, START), (902, 50.0, 0.0, START)]
    return out


def expected(left, right, same, at):
    found = defaultdict(list)
    for i, *p in ((r[0], r[1], r[2]) for r in left):
        for j, lat, lon, since in right:
            if None not in (p[0], lat) and since <= at and (not same or None not in (i, j) and i != j) and (d := metres(p, (lat, lon))) <= WITHIN:
                found[i].append(d)
    return {i: (len(d), min(d), sum(math.exp(-x * x / (2 * WIDTH * WIDTH)) for x in d)) for i, d in found.items()}


@pytest.mark.parametrize("same", [True, False])
def test_places_shared_by_many_rows(spark, same):
    data = rows()
    df = spark.createDataFrame(data, "id long, lat double, lon double, since date")
    where = {"table": "t", "id": "id", "spatial_ix": {"lat": "lat", "lon": "lon"}, "temporal_ix": "since"}
    entities = [{"alias": "here"} | where, {"alias": "there"} | where | {"table": "u"}]
    spec = {"name": "near", "left": "here", "right": "here" if same else "there", "within_m": WITHIN, "bandwidth_m": WIDTH}
    config = {"target": "here", "max_depth": 1, "intervals": [], "relationships": [], "transformations": ["identity"], "entities": entities, "spatial_relationships": [spec]}
    dates = [START + dt.timedelta(20), START + dt.timedelta(60)]
    got = Loom(config, spark, [str(d) for d in dates], {"t": df, "u": df.where("id % 3 = 0")}).to_spark().distinct().collect()
    right = data if same else [r for r in data if r[0] is not None and r[0] % 3 == 0]
    for at in dates:
        want = expected(data, right, same, at)
        mine = {r["id"]: r for r in got if r["as_of_date"] == at and r["id"] is not None}
        assert set(mine) >= {i for i in want if i is not None}
        for i, r in mine.items():
            n, d, k = want.get(i, (0, None, None))
            assert r["COLOCATION_COUNT(near)"] == n and (d is None) == (r["DISTANCE_TO_NEAREST(near)"] is None)
            assert d is None or (r["DISTANCE_TO_NEAREST(near)"], r["KDE_INTENSITY(near)"]) == pytest.approx((d, k), rel=1e-9, abs=1e-9)


def test_places_are_compared_once(spark, monkeypatch):
    """The join has as many rows as pairs of places, however many rows share them."""
    sizes, plain = [], spatial.near_pairs

    def counted(*a):
        pairs = plain(*a)
        sizes.append(pairs.count())
        return pairs

    monkeypatch.setattr(spatial, "near_pairs", counted)
    test_places_shared_by_many_rows(spark, False)
    assert max(sizes) <= 2 * 50 * 50
