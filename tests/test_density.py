"""Density clusters and neighbours against brute force over all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from polisgraph.operators import density, neighbours

SF = "/root/testdata/sf0.001"


def brute(ids, points, min_size, min_samples):
    """The tree over all pairs, edges by (weight, rows), clusters by sets of rows from the top down."""
    n = len(ids)
    far = np.sqrt(np.square(points[:, None] - points[None]).sum(-1))
    core = np.sort(far, 1)[:, min(min_samples, n - 1)]
    reach = np.maximum(np.maximum(core[:, None], core[None]), far)
    edges = sorted((reach[i, j], i, j) for i in range(n) for j in range(i + 1, n))
    root, tree = list(range(n)), []

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for e in edges:
        a, b = find(e[1]), find(e[2])
        if a != b:
            root[b] = a
            tree.append(e)
    links = {i: [] for i in range(n)}
    for w, a, b in tree:
        links[a].append((w, a, b, b))
        links[b].append((w, a, b, a))

    def part(start, below):
        seen, stack = {start}, [start]
        while stack:
            for *edge, to in links[stack.pop()]:
                if tuple(edge) < below and to not in seen:
                    seen.add(to)
                    stack.append(to)
        return seen

    def condense(rows, birth):
        """(stability, rows, children) of the cluster of ``rows`` that begins at density ``birth``."""
        stability, at = 0.0, rows
        while True:
            last = max(e for e in tree if e[1] in at and e[2] in at)
            density_ = 1 / max(last[0], density.LEAST_GAP)
            big = [x for x in (part(last[1], last), part(last[2], last)) if len(x) >= min_size]
            if len(big) == 1:
                stability += (len(at) - len(big[0])) * (density_ - birth)
                at = big[0]
                continue
            return stability + len(at) * (density_ - birth), rows, [condense(x, density_) for x in big]

    def value(node):
        return max(node[0], sum(map(value, node[2])))

    def chosen_of(node):
        return [node[1]] if node[0] >= sum(map(value, node[2])) else [s for c in node[2] for s in chosen_of(c)]

    chosen = [s for c in condense(set(range(n)), 0.0)[2] for s in chosen_of(c)] if n >= min_size else []
    label = np.full(n, -1)
    for k, rows in enumerate(sorted(chosen, key=lambda r: min(ids[i] for i in r))):
        label[list(rows)] = k
    return label


def blobs(seed, n, dims=2):
    r = np.random.default_rng(seed)
    centres = r.uniform(-10, 10, (4, dims))
    return np.concatenate([centres[k % 4] + r.normal(0, 0.3 + 0.3 * (k % 3), dims) for k in range(n)] + [r.uniform(-12, 12, dims) for _ in range(n // 10)]).reshape(-1, dims)


def run(spark, ids, points, **kw):
    rows = [(int(i), [float(x) for x in p]) for i, p in zip(ids, points, strict=True)]
    found = density.clusters(spark.createDataFrame(rows, "id long, v array<double>"), **kw)
    return {r["id"]: (r["cluster"], r["distance"]) for r in found.collect()}


@pytest.mark.parametrize(("seed", "dims", "cell", "merge"), [(1, 2, 40, 100_000), (2, 2, 25, 97), (3, 5, 60, 100_000)])
def test_clusters_are_brute_force(spark, seed, dims, cell, merge):
    points = blobs(seed, 300, dims)
    ids = sorted(random.Random(seed).sample(range(10_000), len(points)))
    found = run(spark, ids, points, cell_rows=cell, merge_edges=merge)
    want = brute(ids, points, density.MIN_SIZE, density.MIN_SAMPLES)
    assert want.max() >= 1 and [found[i][0] for i in ids] == want.tolist()
    for i, p, k in zip(ids, points, want.tolist(), strict=True):
        centre = points[want == k].mean(0) if k >= 0 else points.mean(0)
        assert found[i][1] == pytest.approx(np.linalg.norm(p - centre))


def test_neighbours_are_brute_force(spark):
    points = blobs(5, 400)
    rows = [(k, [float(x) for x in p]) for k, p in enumerate(points)]
    numbered = neighbours.numbered(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v")
    placed, cells = neighbours.in_cells(numbered, 30)
    assert cells.count > 8
    lists = {r["rid"]: [e["near"] for e in r["list"]] for r in neighbours.nearest(spark, placed, cells, 7).collect()}
    rid = {r["id"]: r["rid"] for r in numbered.collect()}
    far = np.sqrt(np.square(points[:, None] - points[None]).sum(-1))
    for k in range(len(points)):
        want = sorted((far[k, j], rid[j]) for j in range(len(points)) if j != k)[:7]
        assert lists[rid[k]] == [j for _, j in want]


def test_lists_of_other_cells_are_not_written(spark, monkeypatch):
    """No cell can be ruled out here, yet each row has one list, not one for each cell that it meets."""
    points = np.random.default_rng(8).normal(0, 1, (600, 24))
    numbered = neighbours.numbered(spark.createDataFrame([(k, p.tolist()) for k, p in enumerate(points)], "id long, v array<double>"), "id", "v")
    placed, cells = neighbours.in_cells(numbered, 30)
    seen, best = [], neighbours.best_lists
    monkeypatch.setattr(neighbours, "best_lists", lambda found, k: seen.append(found.count()) or best(found, k))
    lists = {r["rid"]: [e["near"] for e in r["list"]] for r in neighbours.nearest(spark, placed, cells, 5).collect()}
    assert sum(seen) <= 600 * 5
    rid = {r["id"]: r["rid"] for r in numbered.collect()}
    far = neighbours.gaps(points, points)
    for k in range(600):
        assert lists[rid[k]] == [j for _, j in sorted((far[k, j], rid[j]) for j in range(600) if j != k)[:5]]


@pytest.mark.parametrize("scale", [1.0, 1e-25, 1e25, 1e170])
def test_products_lose_no_pair(scale):
    r = np.random.default_rng(9)
    a, b = (r.normal(0, 1, (n, 5)) * scale for n in (300, 400))
    b[:50] = a[:50] * (1 + 1e-9)
    reach, other = r.uniform(0, 2, 300) * scale, r.uniform(0, 1, 400) * scale
    with np.errstate(over="ignore"):
        far = neighbours.gaps(a, b)
        for second, most in ((None, reach[:, None]), (other, np.maximum(reach[:, None], other))):
            found = [(i, j, d) for part in neighbours.within(neighbours.Rows(a), reach, neighbours.Rows(b), second) for i, j, d in zip(*part, strict=True)]
            assert found == [(i, j, far[i, j]) for i, j in zip(*np.nonzero(far <= most), strict=True)]


def test_copies_and_what_takes_no_part(spark):
    points = np.concatenate([np.zeros((40, 2)), np.ones((3, 2)) * [[5, 5]], blobs(6, 60) + 50])
    found = run(spark, range(len(points)), points, cell_rows=20)
    assert len({found[k][0] for k in range(40)}) == 1 and found[0][0] >= 0
    rows = [(1, [0.0, 0.0], "x"), (2, None, "x"), (3, [], "x"), (4, [float("nan"), 0.0], "x"), (5, [None, 1.0], "x"), (6, [0.0, 1.0], "x")]
    few = density.clusters(spark.createDataFrame(rows, "id long, v array<double>, cluster string"))
    assert sorted((r["id"], r["cluster"]) for r in few.collect()) == [(1, -1), (6, -1)]
    assert density.clusters(spark.createDataFrame([], "id long, v array<double>")).collect() == []


def test_embeddings_of_the_tables(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    flat = table.select("vec_id", F.slice("embedding", 1, 2).alias("embedding"))
    for rows in (flat, table):
        held = [(r["vec_id"], r["embedding"]) for r in rows.collect() if r["embedding"]]
        want = brute([i for i, _ in held], np.array([v for _, v in held], np.float64), density.MIN_SIZE, density.MIN_SAMPLES)
        found = {r["id"]: r["cluster"] for r in density.clusters(rows, "vec_id", "embedding", cell_rows=100).collect()}
        assert [found[i] for i, _ in held] == want.tolist()
