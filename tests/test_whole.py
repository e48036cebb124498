"""Queries without SQL over whole tables against brute force, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from regolith.plans import fixtures as X
from tests.test_registry import DIR

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the test tables are not here")


def test_components_of_all_orders(spark):
    edges = [tuple(r) for r in X.graph(spark, DIR).collect()]
    least = {n: n for e in edges for n in e}

    def find(n):
        while least[n] != n:
            least[n] = n = least[least[n]]
        return n

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        least[b] = a
    want = {n: find(n) for n in least}
    assert {r["node"]: r["root"] for r in entry.queries()["mesh_components"](spark, DIR).collect()} == want and len(want) > 1500
    sizes: dict = {}
    for root in want.values():
        sizes[root] = sizes.get(root, 0) + 1
    top = min(sizes, key=lambda r: (-sizes[r], r))
    assert {r["node"] for r in entry.queries()["largest_component"](spark, DIR).collect()} == {n for n, r in want.items() if r == top}


def _split(points, most, path=""):
    """Leaves of the median split by plain recursion: path -> ids."""
    if len(points) <= most:
        return {path: {p[0] for p in points}}
    axis = max((1, 2, 3), key=lambda a: (max(p[a] for p in points) - min(p[a] for p in points), -a))
    rows, half = sorted(points, key=lambda p: (p[axis], p[0])), len(points) // 2
    return _split(rows[:half], most, path + "l") | _split(rows[half:], most, path + "r")


def test_split_goes_on_to_the_leaf_bound(spark):
    points = [tuple(r) for r in X.clouds(spark, DIR).select("id", "x", "y", "z").collect()]
    want = _split(points, 16)
    got: dict = {}
    for r in entry.queries()["mesh_blocks_median_split"](spark, DIR).collect():
        got.setdefault(r["path"], set()).add(r["id"])
    assert got == want and max(map(len, got.values())) <= 16
    leaves = entry.queries()["mesh_leaves"](spark, DIR).collect()
    assert {r["path"]: r["n"] for r in leaves} == {k: len(v) for k, v in want.items()} and sorted(r["leaf"] for r in leaves) == list(range(len(want)))


@pytest.mark.parametrize(("name", "key"), [("fit_slopes", "k"), ("refine", "k"), ("split_children", "parent"), ("tile_mesh", "mesh")])
def test_queries_without_sql_read_all_maplets(spark, name, key):
    rows = entry.queries()[name](spark, DIR).select(key).distinct().collect()
    assert {r[0] for r in rows} == set(range(8))
