"""SetSketch near-dedup against all pairs, and the blocks of both joins with lowered bounds."""

import random

import numpy as np
import pytest

from regolith.llm import near_dedup as nd
from regolith.llm import ngram_join as nj

SCHEMA = "doc_id long, text string, node string, root string, more string"


def components(rows, shingle, threshold):
    """(doc_id, size, component) of each row, by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()
        sets.append({tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set())
    root = list(range(len(rows)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= threshold * (len(sets[i]) + len(sets[j]) - both):
                root[top(i)] = top(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(least.get(top(k), i), i)
    return sorted(str((i, len(sets[k]), least.get(top(k)))) for k, (i, _) in enumerate(rows))


def corpus(seed):
    """Families of texts at all distances around the threshold, with common passages, copies, short and empty texts."""
    draw = random.Random(seed)
    common = [f"common{i}" for i in range(40)]
    rows = []
    for _ in range(25):
        words = [f"w{draw.randrange(3000)}" for _ in range(draw.choice([4, 12, 60, 200]))] + (common if draw.random() < 0.5 else [])
        for _ in range(draw.randrange(1, 8)):
            rows.append(" ".join(words))
            for _ in range(draw.choice([0, 1, 2, 4])):
                words[draw.randrange(len(words))] = f"n{draw.randrange(10**6)}"
    rows += ["", " ", None, "one", "ONE", "one two", "one two three", rows[0], rows[3].upper(), rows[5] + "\n"]
    out = [*enumerate(rows), (0, rows[2]), (None, rows[4]), (None, "alone in the world")]
    draw.shuffle(out)
    return out


def run(spark, rows, kind, parts=3):
    df = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SCHEMA).repartition(parts)
    return sorted(str((r["doc_id"], r["n"], r["component_id"])) for r in kind(df, "doc_id", "text").run().collect())


@pytest.mark.parametrize("bounds", [{}, {"PART": 3, "SLICE": 2, "PORTION": 200, "FILTER_BITS": 8}, {"PART": 2, "TRACKED": 64, "WHOLE": 1}])
@pytest.mark.parametrize(("kind", "shingle", "threshold"), [(nd.NearCopies, 3, 85), (nj.Join, 5, 80)])
def test_against_all_pairs(spark, monkeypatch, bounds, kind, shingle, threshold):
    for name, value in bounds.items():
        monkeypatch.setattr(nj, name, value)  # read by the driver
    rows = corpus(len(bounds))
    assert run(spark, rows, kind) == components(rows, shingle, threshold)


def test_sketch_of_a_union_is_the_maximum():
    draw = np.random.default_rng(2)
    a, b = (draw.integers(0, 1 << 63, n).astype(np.uint64) for n in (300, 90))
    both = nd.sketches([np.union1d(a, b)])[0]
    assert np.array_equal(nd.merged(*nd.sketches([a, b])), both)
    assert np.array_equal(nd.sketches([a[::-1], b])[0], nd.sketches([a])[0])  # neither order nor neighbours matter


@pytest.mark.parametrize("n", [40, 900])
@pytest.mark.parametrize("similarity", [0.3, 0.85, 0.95])
def test_estimates(n, similarity):
    draw = np.random.default_rng(n)
    found, truth = [], []
    for _ in range(60):
        m = n + n // 10
        c = round((n + m) * similarity / (1 + similarity))
        pool = draw.integers(0, 1 << 63, n + m - c).astype(np.uint64)
        if c > n:
            continue
        r, s = nd.sketches([pool[:n], pool[n - c :]])
        truth.append(c / (n + m - c))
        found.append(nd.estimates(np.array([(r > s).sum()]), np.array([(r < s).sum()]), np.array([n]), m)[0])
    if truth:
        assert abs(np.mean(found) - np.mean(truth)) < 0.015 and np.abs(np.array(found) - truth).max() < nd.MARGIN * 0.0225


def test_reaching_is_having_an_estimate_above():
    draw = np.random.default_rng(7)
    above, below = draw.integers(0, 120, 400), draw.integers(0, 120, 400)
    n = draw.integers(90, 110, 400)
    for floor in (0.6, 0.755):
        guess = nd.estimates(above, below, n, 100)
        far = np.abs(guess - floor) > 1e-4
        assert np.array_equal(nd.reach(above, below, n, 100, floor)[far], (guess >= floor)[far]) and 20 < (guess < floor).sum() < 380


def test_bands_hold_equal_registers():
    r = np.zeros((2, nd.REGISTERS), np.uint16)
    r[1, nd.ROWS :] = 1
    h = nd.bands(r)
    assert h[0, 0] == h[1, 0] and (h[0, 1:] != h[1, 1:]).all() and len(np.unique(h[0])) == h.shape[1]


def test_kept_rows(spark):
    rows = [(5, "a b c d e f"), (3, "A b c d e f"), (9, None), (8, ""), (7, "x y")]
    df = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SCHEMA)
    kept = nd.keep_one_of_each(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 7, 8, 9]
    got = {r["doc_id"]: (r["component_id"], r["kept"]) for r in nd.near_copies(df).collect()}
    assert got == {5: (3, False), 3: (3, True), 9: (9, True), 8: (8, True), 7: (7, True)}
    assert nd.near_copies(df.limit(0)).count() == 0


def test_sketches_of_all_sets_are_shuffled_once(spark):
    """To fold equal sets; the comparison gets those of its own sets only."""
    rng = random.Random(5)
    rows = [(i, " ".join(str(rng.randrange(10**6)) for _ in range(60))) for i in range(400)]
    rows += [(400 + i, rows[i][1] + " end") for i in range(3)]
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway

    def stages():
        found = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (found.apply(i) for i in range(found.size()))}

    before, bound = set(stages()), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = nd.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bound)
    assert sorted((r["doc_id"], r["component_id"]) for r in got if not r["kept"]) == [(400, 0), (401, 1), (402, 2)]
    wide = [b for k, b in stages().items() if k not in before and b > 403 * nd.REGISTERS]  # of two bytes a register, not compressed
    bands = 1
    assert len(wide) == 1 + bands
