import random
from collections import Counter, defaultdict
from itertools import combinations

import pytest

from textloom.llm import topn
from textloom.llm.cooccurrence import cooccurring_pairs
from textloom.llm.topn import top_n_per_group


def brute_top(rows, n):
    best = {}
    for g, i, s in rows:
        if g is not None and i is not None and s is not None:
            best[g, i] = max(s, best.get((g, i), s))
    groups = defaultdict(list)
    for (g, i), s in best.items():
        groups[g].append((-s, i))
    return {(g, i, -s, k) for g, v in groups.items() for k, (s, i) in enumerate(sorted(v)[:n], 1)}


@pytest.mark.parametrize("salted", [False, True])
def test_top_n_equals_brute_force(spark, monkeypatch, salted):
    if salted:
        monkeypatch.setattr(topn, "SALTS", 4)
        monkeypatch.setattr(topn, "HOT_SHARE", 0.01)
    rng = random.Random(1)
    rows = [("hot", f"i{rng.randrange(300)}", rng.randrange(4)) for _ in range(800)]
    rows += [(f"g{rng.randrange(80)}", f"i{rng.randrange(6)}", rng.randrange(4)) for _ in range(700)]
    rows += [(None, "i", 3), ("g1", None, 3), ("g1", "i9", None), ("lone", "x", 0), ("lone", "x", 0)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "g string, i string, s int, r string")
    got = top_n_per_group(df, "g", "i", "s", 3)
    assert got.columns == ["g", "i", "s", "rank"]
    assert {tuple(r) for r in got.collect()} == brute_top(rows, 3)
    assert got.count() == len(brute_top(rows, 3))


def test_top_n_of_nothing_and_of_one_score(spark):
    df = spark.createDataFrame([("a", "y", 1), ("a", "x", 1)], "g string, i string, s int")
    assert top_n_per_group(df.limit(0), "g", "i", "s", 2).count() == 0
    assert [(r.i, r["rank"]) for r in top_n_per_group(df, "g", "i", "s", 1).collect()] == [("x", 1)]


def test_pairs_equal_brute_force(spark):
    rng = random.Random(2)
    rows = [(f"c{rng.randrange(40)}", f"x{int(rng.paretovariate(0.7)) % 30}") for _ in range(600)]
    rows += [("big", f"x{k}") for k in range(200)] + [("c1", None), (None, "x1"), ("c1", "x1"), ("c1", "x1")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "c string, x string, k int")
    baskets = defaultdict(set)
    for c, x in rows:
        if c is not None and x is not None:
            baskets[c].add(x)
    k = Counter(p for b in baskets.values() for p in combinations(sorted(b), 2))
    m = Counter(x for b in baskets.values() for x in b)
    n = len(baskets)
    got = {(r.item_1, r.item_2): (r.k, r.a, r.b, r.n) for r in cooccurring_pairs(df, "c", "x").collect()}
    assert got == {p: (v, m[p[0]], m[p[1]], n) for p, v in k.items()}
    got = {(r.item_1, r.item_2) for r in cooccurring_pairs(df, "c", "x", 3, 1.5).collect()}
    assert got == {p for p, v in k.items() if v >= 3 and v * n >= 1.5 * m[p[0]] * m[p[1]]}
    assert cooccurring_pairs(df.limit(0), "c", "x", 2, 2.0).count() == 0
