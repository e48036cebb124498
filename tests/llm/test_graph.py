"""Components of an edge table, and how many tables and tasks they cost."""

import random

import numpy as np
import pytest

from regolith.llm import graph, ngram_join
from regolith.llm.store import Scratch


def roots(edges):
    root = {x: x for e in edges for x in e}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return {x: top(x) for x in root if top(x) != x}


def random_edges(seed, nodes=60):
    draw = random.Random(seed)
    return [(draw.randrange(nodes), draw.randrange(nodes)) for _ in range(draw.choice([0, 1, 30, 45]))] + [(200 + k, 201 + k) for k in range(seed)]


@pytest.fixture
def written(monkeypatch):
    names, keep = [], Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df, name: names.append(name) or keep(self, df, name))
    return names


@pytest.mark.parametrize("seed", range(4))
def test_components_of_random_graphs(spark, seed):
    edges = random_edges(seed) * 2
    got = graph.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()
    assert sorted((r["node"], r["root"]) for r in got) == sorted(roots(edges).items())


def test_stars_need_no_round(spark, written):
    edges = [(7, 1), (1, 3), (9, 1), (20, 10), (5, 5)]
    got = graph.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()
    assert sorted((r["node"], r["root"]) for r in got) == [(3, 1), (7, 1), (9, 1), (20, 10)] and not written


def test_stars_of_some_edges():
    for seed in range(40):
        edges = random_edges(seed)
        a, b = np.array(edges, np.int64).reshape(-1, 2).T
        assert dict(zip(*(x.tolist() for x in graph.stars(a, b)), strict=True)) == roots(edges)


def test_a_join_of_near_copies_takes_few_tables(spark, written):
    rows = [(i, " ".join(f"w{i // 4}.{j}" for j in range(40)) + " end" * (i % 4)) for i in range(40)]
    got = ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(i, i // 4 * 4) for i in range(40)}
    assert len(written) <= 14  # each one costs a task and a file a partition
