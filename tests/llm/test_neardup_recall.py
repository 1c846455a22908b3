"""How many similar pairs the trees find, on pairs that share nothing with anyone else."""

import random

from catalens.llm import neardup


def similarity(a, b, size=3):
    x, y = ({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} for w in (a, b))
    return 100 * len(x & y), len(x | y)


def test_pairs_just_above_the_threshold_are_found(spark):
    rng = random.Random(12)
    rows, similar, apart = [], [], []
    k = 0
    while len(similar) < 2200:
        a = [f"p{k}w{i}" for i in range(rng.randint(60, 160))]
        b = list(a)
        for _ in range(rng.randint(1, 5)):
            b[rng.randrange(len(b))] = f"edit{rng.random()}"
        common, union = similarity(a, b)
        if 78 * union <= common <= 90 * union:
            (similar if common >= 80 * union else apart).append((2 * k, 2 * k + 1))
            rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
            k += 1
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), words=3, percent=80).collect()}
    assert sum(got[x] != got[y] for x, y in similar) <= 1  # of 2200 pairs one is lost in 45 such tests
    assert all(got[x] != got[y] for x, y in apart) and apart


def test_trees_follow_from_the_stated_loss():
    for percent in (70, 80, 85, 95):
        kept = (1 - (1 - percent / 100) ** 2) ** neardup.LEVELS
        trees = neardup.trees_for(percent)
        assert (1 - kept) ** trees <= neardup.LOSS < (1 - kept) ** (trees - 1)
    assert neardup.trees_for(100) == 1
