import random

import numpy as np
import pytest
from helpers import documents, odd_rows, words

from rasterflow.llm import near_dup as N
from rasterflow.llm.components import components


def word_sets(text):
    w = (text or "").encode().lower().split()
    if not w:
        return set()
    return {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    sets = [word_sets(t) for _, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, _) in enumerate(rows):
        for b, (j, _) in enumerate(rows[:a]):
            if i is not None and j is not None and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [(i, len(s), None if i is None else find(i), i is None or find(i) == i) for (i, _), s in zip(rows, sets)]


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def corpus(group=30):
    rng = random.Random(6)
    rows = odd_rows()
    base = words(rng, 120, 10**6)
    rows += [(1000 + k, edited(rng, base, rng.randint(0, 5))) for k in range(group)]
    other = words(rng, 200, 10**6)
    rows += [(5000 - k, edited(rng, other, k // 8)) for k in range(group)]
    passage = words(rng, 60, 10**6)
    rows += [(7000 + k, passage + " " + words(rng, 25, 10**6)) for k in range(group)]
    rows += [(8000 + k, words(rng, 50, 10**6)) for k in range(10)]
    return rows + [(9000 + k, base) for k in range(10)]


@pytest.mark.parametrize(("small", "block"), [(32, 512), (2, 7), (1000, 512)])
def test_against_brute_force(spark, monkeypatch, small, block):
    monkeypatch.setattr(N, "SMALL_BAND", small)
    monkeypatch.setattr(N, "BLOCK", block)
    rows = corpus()
    got = N.near_duplicates(documents(spark, rows)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(rows)))


def several_texts():
    """Ids with two texts: these join what their texts are linked with."""
    rng = random.Random(13)
    a, b, c = (words(rng, 40, 10**6) for _ in range(3))
    return [(3, a), (5, a), (5, b), (7, b), (20, c), (21, c), (21, ""), (21, None), (30, ""), (31, ""), (30, b + " x"), (None, a), (None, a), (40, "q r"), (40, "s t"), (2, "s  T")]


def test_ids_with_several_texts(spark):
    rows = several_texts()
    got = N.near_duplicates(documents(spark, rows)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(rows)))
    assert {r.doc_id: r.component_id for r in got} == {3: 3, 5: 3, 7: 3, 30: 3, 20: 20, 21: 20, 31: 31, None: None, 40: 2, 2: 2}
    by_row = N.near_duplicates(documents(spark, rows), by_row=True).collect()
    assert {(r.doc_id, r.row_component) for r in by_row if r.doc_id in (3, 5, 7)} == {(3, 3), (5, 3), (5, 5), (7, 5)}


@pytest.mark.parametrize("classes", [1, 3])
def test_large_classes_meet_their_rows_by_broadcast(spark, monkeypatch, classes):
    monkeypatch.setattr(N, "LARGE_CLASSES", classes)
    rows = corpus(6) + [(9100 + k, "one two three four five six") for k in range(80)] + several_texts()
    got = N.near_duplicates(documents(spark, rows)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(rows)))


def test_exact_threshold(spark):
    """Sets of 8 shingles of which 6 are common: 6 of 8 is linked, 6 of 9 isn't."""
    a = "a b c d e f g h i j k l"
    rows = [(1, a), (2, "a b c d e f g h i j"), (3, "a b c d e f g h i j x y z")]
    got = {r.doc_id: r.component_id for r in N.near_duplicates(documents(spark, rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 3} or got == {i: c for i, _, c, _ in brute(rows)}


def test_estimate_follows_similarity(spark):
    rng = np.random.default_rng(3)
    for share in (0.2, 0.5, 0.75, 0.95):
        common = rng.integers(0, 1 << 63, int(2000 * share), dtype=np.uint64)
        rest = 2000 - len(common)
        a, b = (np.unique(np.concatenate([common, rng.integers(0, 1 << 63, rest // 2, dtype=np.uint64)])) for _ in range(2))
        x, y = N.pack_low_bits(N.minima([a])), N.pack_low_bits(N.minima([b]))
        df = spark.createDataFrame([(x[0].tolist(), y[0].tolist())], "a array<long>, b array<long>")
        truth = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(df.select(N.estimate("a", "b")).first()[0] - truth) < 0.17


def test_empty(spark):
    assert N.near_duplicates(documents(spark, [])).count() == 0
    assert N.near_duplicates(documents(spark, [(1, None)])).collect()[0].asDict() == {"doc_id": 1, "n_shingles": 0, "component_id": 1, "kept": True}


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1040)] + [(5, 5)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
