from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skyloom.llm import packing


def expand(counts, caps, **how):
    runs, fit = packing.plan(counts, caps, **how)
    got, boxes = defaultdict(int), defaultdict(list)
    for size, rank, n, first, per, off in runs.tolist():
        got[size] += n
        for i in range(n):
            boxes[first + i // per].append((off + i % per * size, size))
    assert got == {s: n for s, n in counts.items() if n}
    seen = []
    for first, number, filled, cap in fit.tolist():
        for b in range(first, first + number):
            at = 0
            for o, s in sorted(boxes[b]):
                assert o == at
                at += s
            assert at == filled <= cap and not any(filled <= c < cap for c in caps)
            seen.append(b)
    assert seen == list(range(len(boxes)))
    return boxes, fit


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(0, 40), max_size=12), st.sets(st.integers(20, 60), min_size=1, max_size=4))
def test_plans_are_sound(counts, caps):
    expand(counts, tuple(sorted(caps)))


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(0, 12), max_size=10))
def test_one_capacity_is_best_fit_decreasing(counts):
    """As many containers as putting items one by one into the fullest that has room."""
    rooms = []
    for size in sorted(counts, reverse=True):
        for _ in range(counts[size]):
            fits = [r for r in rooms if r >= size]
            if fits:
                rooms.remove(min(fits))
                rooms.append(min(fits) - size)
            else:
                rooms.append(30 - size)
    boxes, _ = expand(counts, (30,))
    assert len(boxes) == len(rooms)


def test_several_capacities_beat_one():
    counts = {3: 10, 50: 4, 97: 5, 33: 7}
    unused = lambda caps: sum(int(n) * (c - f) for _, n, f, c in expand(counts, caps)[1].tolist())
    assert unused((40, 70, 100)) <= unused((100,))


def test_rejects_what_cannot_fit():
    with pytest.raises(ValueError):
        packing.plan({11: 1}, (10,))
    with pytest.raises(ValueError):
        packing.plan({1: 1}, ())


@pytest.mark.parametrize("per_part", [200_000, 7])
def test_items_find_their_places(spark, per_part):
    sizes = [0, None, -1, 25, 10, 10, 9, 1, 20, 21, *[3] * 40, 5, 5, 7]
    df = spark.createDataFrame([(i % 30, s, "x", 1) for i, s in enumerate(sizes)], "k long, n int, container_id string, piece int")
    rows = packing.pack(df, "k", "n", capacities=(5, 10), per_part=per_part).collect()
    want = [x for s in sizes for x in ([0] if not s or s < 0 else [10] * ((s - 1) // 10) + [(s - 1) % 10 + 1])]
    assert sorted(r["n_tokens"] for r in rows) == sorted(want)
    boxes = defaultdict(list)
    for r in rows:
        if r["n_tokens"] == 0:
            assert r["container_id"] is None and r["capacity"] is None
        else:
            boxes[r["container_id"]].append((r["start"], r["n_tokens"], r["capacity"]))
    for b in boxes.values():
        at = 0
        for start, n, cap in sorted(b):
            assert start == at and cap in (5, 10)
            at += n
        assert at <= b[0][2] and len({x[2] for x in b}) == 1
    per = packing.containers(packing.pack(df, "k", "n", capacities=(5, 10), per_part=per_part))
    assert per.count() == len(boxes) and per.where("unused < 0").count() == 0
    assert packing.pack(df.limit(0), "k", "n").count() == 0


def test_a_middle_capacity_wins_where_it_fits_best():
    """Three of 1366 don't fit into 4096, and two leave a third empty."""
    runs, fit = packing.plan({1366: 40}, (700, 1400, 4096))
    assert fit[:, 1].sum() == 40 and set(fit[:, 3]) == {1400}
    # Beside items that fill the largest, both are opened.
    runs, fit = packing.plan({1366: 40, 4090: 5, 6: 5}, (700, 1400, 4096))
    opened = {int(c): int(fit[fit[:, 3] == c, 1].sum()) for c in set(fit[:, 3])}
    assert opened == {1400: 40, 4096: 5}


def test_equal_keys_are_ranked_in_many_parts(spark):
    """All rows have one key, or none: no part, and so no window, holds them all."""
    df = spark.createDataFrame([(None if i % 2 else 7, 100) for i in range(5000)], "doc_id long, n int")
    packed = packing.pack(df, "doc_id", "n", per_part=250)
    assert packed.count() == 5000 and packed.select("container_id", "start").distinct().count() == 5000
    assert packing.containers(packed).agg({"filled": "sum"}).first()[0] == 500_000
