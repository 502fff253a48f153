import random
from collections import Counter

import pytest

from vigilark.llm import packing as B


def check(rows, sizes, capacity):
    """Every item whole, cut only if longer than the capacity, no container over it."""
    fill, parts = Counter(), {}
    for r in rows:
        fill[r.container_id] += r.size
        parts.setdefault(r.id, []).append((r.part_no, r.start, r.size))
    assert max(fill.values(), default=0) <= capacity
    assert set(parts) == set(sizes)
    for i, n in sizes.items():
        p = sorted(parts[i])
        n = max(0, n or 0)
        assert sum(x[2] for x in p) == n and [x[0] for x in p] == list(range(len(p)))
        assert all(x[1] == x[0] * capacity for x in p)
        assert len(p) == max(1, -(-n // capacity))
    return len([c for c, n in fill.items() if n])


def first_fit(sizes, capacity):
    """Containers that first fit by falling size needs."""
    parts = [p for n in sizes.values() for p in [capacity] * (n // capacity) + [n % capacity] if p]
    free = []
    for p in sorted(parts, reverse=True):
        for i, f in enumerate(free):
            if f >= p:
                free[i] -= p
                break
        else:
            free.append(capacity - p)
    return len(free)


@pytest.mark.parametrize("seed, capacity", [(1, 100), (2, 257), (3, 1000)])
def test_random_items(spark, seed, capacity):
    rnd = random.Random(seed)
    sizes = {i: rnd.choice([rnd.randint(1, capacity // 10), rnd.randint(1, capacity), 37, 0, rnd.randint(capacity, 3 * capacity)]) for i in range(1500)}
    df = spark.createDataFrame(list(sizes.items()), "id long, n long").selectExpr("*", "1 AS container_id", "2 AS space")
    boxes = check(B.pack(df, "id", "n", capacity).collect(), sizes, capacity)
    assert boxes <= 1.01 * first_fit(sizes, capacity) + 2


def test_skewed_items(spark):
    """A third of the items of one size, and sizes that only pack in pairs."""
    sizes = {i: 40 if i % 3 else 60 for i in range(900)}
    df = spark.createDataFrame(list(sizes.items()), "id long, n long")
    boxes = check(B.pack(df, "id", "n", 100).collect(), sizes, 100)
    assert boxes <= 451  # 300 of 60 + 40 and 150 of 40 + 40


@pytest.mark.parametrize("sizes", [{}, {1: 0, 2: None}, {1: 5}, {1: 1000}, {1: 100, 2: 100}, {1: 1, 2: 1, 3: 1}, {1: 250, 2: -4}])
def test_small_cases(spark, sizes):
    df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "id long, n long")
    check(B.pack(df, "id", "n", 100).collect(), sizes, 100)


def test_plans():
    assert B.linear_groups({10: 5, 9: 5, 8: 5, 7: 5}, 2) == [(9, 10, 10), (7, 8, 10)]
    configs = B.configurations([60, 40], [300, 600], 100)
    assert sum(t for _, t in configs) == 450
    held = [sum(c[g] * t for c, t in configs) for g in range(2)]
    assert held[0] >= 300 and held[1] >= 600
    moves, opened = B.best_fit({10: 4, 3: 5}, {13: 2, 10: 1}, 20)
    assert moves.groupby("size")["n"].sum().to_dict() == {10: 4, 3: 5}
    # one of size 10 fits exactly, two more fill 13 up to 3, which the threes fill
    assert opened == 1
    with pytest.raises(ValueError):
        B.pack(None, "id", "n", 0)
