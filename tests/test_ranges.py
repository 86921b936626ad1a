"""Boxes as ranges of cells, against all cells' bounds."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pointmill.operators import quadtree as Q

BOX = Q.Box(-1.0, 2.0, 11.0, 5.0)
PLACE = st.one_of(st.floats(-3, 14), st.sampled_from([-1.0, 0.5, 2.0, 2.375, 3.5, 5.0, 11.0]))


def bounds(level):
    """Cell to bounds, by halving."""
    cells = {0: (BOX.min_x, BOX.min_y)}
    for k in range(1, level + 1):
        w, h = (BOX.max_x - BOX.min_x) / 2.0**k, (BOX.max_y - BOX.min_y) / 2.0**k
        cells = {path * 4 + q: (x + w * (q % 2), y + h * (q // 2)) for path, (x, y) in cells.items() for q in range(4)}
    return {Q.offset(level) + p: (x, x + w, y, y + h) for p, (x, y) in cells.items()}


@settings(max_examples=200, deadline=None)
@given(PLACE, PLACE, PLACE, PLACE, st.integers(1, 5), st.sampled_from([None, 3]))
def test_ranges(ax, bx, ay, by, level, most):
    (ax, bx), (ay, by) = sorted((ax, bx)), sorted((ay, by))
    found = Q.cell_ranges(Q.Box(ax, ay, bx, by), BOX, level, most)
    edge_x, edge_y = (BOX.min_x, BOX.max_x), (BOX.min_y, BOX.max_y)
    want = {
        c for c, (x0, x1, y0, y1) in bounds(level).items()
        if (x0 <= bx or x0 <= edge_x[0]) and (x1 >= ax or x1 >= edge_x[1]) and (y0 <= by or y0 <= edge_y[0]) and (y1 >= ay or y1 >= edge_y[1])
    }
    got = {c for a, b in found for c in range(a, b + 1)}
    assert all(b + 1 < c for (_, b), (c, _) in zip(found, found[1:]))
    assert got == want if most is None else got >= want and len(found) <= most


def test_few_quadrants_are_divided():
    """At 16 levels the ranges follow the border, not the area."""
    found = Q.cell_ranges(Q.Box(1.0, 2.5, 9.0, 4.0), BOX, 16)
    inside = sum(b - a + 1 for a, b in found)
    assert inside > 10**9 and len(found) < 200_000
    assert len(Q.cell_ranges(Q.Box(1.0, 2.5, 9.0, 4.0), BOX, 16, 500)) <= 500


def test_empty_and_flat_boxes():
    assert Q.cell_ranges(Q.Box(0, 0, 1, 1), Q.Box(3.0, 3.0, 3.0, 3.0), 5) == [(0, 0)]
    assert Q.cell_ranges(Q.Box(2, 3, 1, 4), BOX, 5) == []


@pytest.mark.parametrize("level", [1, 3])
def test_join(spark, level):
    """Leaf cells and cells of lower levels that meet the ranges; repeated rows stay, clashing names do no harm."""
    cells = [(c, "x") for c in bounds(level)] * 2
    ranges = Q.cell_ranges(Q.Box(0.0, 2.5, 6.0, 3.0), BOX, level)
    own = spark.createDataFrame(cells, "cell long, level string")
    want = sorted(c for c, _ in cells if any(a <= c <= b for a, b in ranges))
    assert sorted(r.cell for r in Q.meeting(own, ranges, level).collect()) == want
    assert Q.meeting(own, [], level).count() == 0
    every = [(c,) for k in range(level + 1) for c in range(Q.offset(k), Q.offset(k + 1))]
    first, last = Q.leaves_of("cell", level)
    spans = spark.createDataFrame(every, "cell long").select("cell", first.alias("first"), last.alias("last"))
    met = {r.cell for r in Q.meeting(spans, ranges, level, "first", "last").collect()}
    assert met == {r.cell for r in spans.collect() if any(a <= r.last and r.first <= b for a, b in ranges)}
    assert 0 in met and len(met) < len(every)
