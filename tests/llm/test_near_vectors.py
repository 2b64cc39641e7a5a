"""Near duplicates among vectors against all cosines."""

import random

import numpy as np
import pytest

from gridweave.llm import near_vectors as near
from gridweave.llm.common import Forest


def unit(v):
    if v is None or not len(v) or any(x is None or not np.isfinite(x) for x in v) or not any(v):
        return None
    x = np.array(v, np.float64)
    x = x / np.abs(x).max()
    return x / np.linalg.norm(x)


def brute(rows, least=0.95):
    u = [unit(v) for _, v in rows]
    f, links = Forest(len(rows)), [0] * len(rows)
    by_length = {}
    for k, x in enumerate(u):
        if x is not None:
            by_length.setdefault(len(x), []).append(k)
    for ks in by_length.values():
        m = np.stack([u[k] for k in ks])
        a, b = np.nonzero(np.triu(m @ m.T >= least, 1))
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            f.join(ks[i], ks[j])
            links[ks[i]] += 1
            links[ks[j]] += 1
    ids = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            ids[f.root(k)] = min(i, ids.get(f.root(k), i))
    return sorted(((i, links[k], ids.get(f.root(k)), i == ids.get(f.root(k))) for k, (i, _) in enumerate(rows)), key=repr)


def held(spark, rows, kind="double", **more):
    schema = f"vec_id long, embedding array<{kind}>, node string, key int, id string"
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "x", 1, "y") for i, v in rows], schema).repartition(5)
    if kind == "float":
        rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = near.near_vectors(df, **more)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, more.get("least", 0.95))


def clouds(seed, centers, each, dim=16, spread=0.2):
    """Vectors around centers, some near enough to link, in chains too."""
    r = np.random.RandomState(seed)
    out = []
    for _ in range(centers):
        c = r.standard_normal(dim)
        out += [c + spread * np.linalg.norm(c) / np.sqrt(dim) * r.standard_normal(dim) for _ in range(each)]
    return out


@pytest.mark.parametrize("kind", ["float", "double"])
def test_clouds_in_small_blocks(spark, monkeypatch, kind):
    monkeypatch.setattr(near, "RUN", 8)
    rows = list(enumerate(clouds(1, 40, 12)))
    random.Random(2).shuffle(rows)
    held(spark, rows, kind, block=20)


def test_one_tight_cloud_holds_most_vectors(spark, monkeypatch):
    """Whole runs and whole blocks are near each other, and are not compared."""
    monkeypatch.setattr(near, "RUN", 8)
    rows = list(enumerate([*clouds(3, 1, 600, spread=0.01), *clouds(4, 30, 4)]))
    held(spark, rows, block=32)
    held(spark, rows, block=32, least=0.3)


def test_a_third_are_copies(spark):
    v = clouds(5, 60, 5)
    rows = list(enumerate([v[0]] * 150 + v))
    held(spark, rows + rows[:3] + [(7, v[100]), (None, v[0]), (None, v[50]), (None, [0.5] * 16)])


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0] * 4), (4, [1.0, nan, 0.0, 0.0]), (5, [inf, 0.0, 0.0, 1.0]), (6, [1.0, None, 0.0, 0.0]), (None, None), (None, [0.0])]
    rows += [(10, [1e200, 0, 0, 0]), (11, [1e-300, 0, 0, 0]), (12, [5e-324, 0, 0, 0]), (13, [-1e200, 0, 0, 0]), (14, [1.0, 0, 0]), (15, [2.0, 0.1, 0]), (16, [1.0]), (17, [3.0]), (18, [-3.0])]
    held(spark, rows)
    held(spark, rows, block=1)
    assert near.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_pairs_of_blocks_are_skipped_and_taken_whole():
    r = np.random.RandomState(8)
    axis = np.eye(32, 8)
    far = [near.Levels(near.units(c + 0.01 * r.standard_normal((2000, 32))), axis) for c in (np.eye(32)[0], np.eye(32)[1])]
    assert not any(len(x) for x in near.run_pairs(*far, 0.3, False))
    some, sure = near.run_pairs(far[0], far[0], 0.9, True)
    assert not len(some) and len(sure)


def test_forest_has_no_more_edges_than_vectors():
    u = near.units(np.stack(clouds(9, 3, 900, spread=0.25)))
    links, a, b = near.joined_blocks((u, np.ones(len(u), np.int64)), None, np.eye(16, 8), 0.95)
    assert links.sum() > 10 * len(u) and len(a) < len(u) and (b < a).all()
