"""Delineation of one site: fill, ladder, areas, cleanup, split, interior."""

import numpy as np
import pytest
from fieldloom.operators import kernel as k
from fieldloom.plans.params import params
from hypothesis import given, settings
from hypothesis import strategies as st


def field(size=21, low=4, high=16, inside=0.6, outside=0.1, windows=2):
    cube = np.full((size, size, windows), outside)
    cube[low : high + 1, low : high + 1] = inside
    return cube + 0.02 * np.arange(windows)


def open_cells(cube, mu=0.5, tol=0.05, threshold=(0.3, 0.9), least=1):
    n = cube.shape[2]
    return k.eligible(cube, np.full(n, mu), np.full(n, tol), threshold, least)


def test_match_is_strict_and_threshold_inclusive():
    cube = np.array([[[0.5], [0.25], [0.75], [0.3], [0.9]]])
    open_, _ = k.eligible(cube, np.array([0.5]), np.array([0.25]), (0.25, 0.75), 1)
    assert open_.tolist() == [[True, False, False, True, False]]
    assert k.eligible(cube, np.array([0.5]), np.array([0.3]), (0.25, 0.75), 1)[0].tolist() == [[True, True, True, True, False]]


def test_vegetated_window_needs_no_signature():
    cube = np.array([[[0.5, 0.95]]])
    assert k.eligible(cube, np.array([np.nan, 0.95]), np.array([0.1, 0.1]), (0.3, 0.7), 1)[0].all()


def test_square_field_survives_the_whole_sequence():
    site = k.Site(field(), (10, 10), params()).boundary()
    want = np.zeros((21, 21), bool)
    want[4:17, 4:17] = True
    assert (site.mask == want).all()


def test_seed_outside_gives_an_empty_mask():
    site = k.Site(field(), (0, 0), params(area_threshold=(0.5, 0.9))).area()
    assert not site.mask.any()


def test_rungs():
    assert k.rungs(34, 34) == [(11, 11), (16, 16), (24, 24), (34, 34)]
    assert k.rungs(20, 31) == [(14, 21), (20, 31)] and k.rungs(7, 9) == [(7, 9)]


@pytest.mark.parametrize("rows,columns,seed", [(34, 34, (17, 17)), (35, 35, (16, 16)), (20, 31, (2, 24)), (7, 9, (1, 7))])
def test_last_window_reaches_every_edge(rows, columns, seed):
    cube = np.full((rows, columns, 2), 0.5)
    open_, match = open_cells(cube)
    assert k.ladder(open_, match, seed, 0.0, 2).all()


def test_first_window_is_centred():
    open_ = np.ones((34, 34), bool)
    seen = []
    original = k.flood
    try:
        k.flood = lambda o, m, s, box, *rest: (seen.append(box), (np.zeros(o.shape, bool), 0))[1]
        k.ladder(open_, open_.astype(int), (17, 17), 0.0, 1)
    finally:
        k.flood = original
    assert seen == [(12, 22, 12, 22)]


def reachable(open_, seed):
    alive = np.zeros(open_.shape, bool)
    stack = [seed] if open_[seed] else []
    while stack:
        r, c = stack.pop()
        if 0 <= r < open_.shape[0] and 0 <= c < open_.shape[1] and open_[r, c] and not alive[r, c]:
            alive[r, c] = True
            stack += [(r + i, c + j) for i, j in k.EIGHT]
    return alive


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 1 << 30))
def test_without_density_the_fill_is_the_seeds_component(seed):
    rng = np.random.default_rng(seed)
    open_ = rng.random((rng.integers(5, 26), rng.integers(5, 26))) < 0.6
    at = (open_.shape[0] // 2, open_.shape[1] // 2)
    assert (k.ladder(open_, open_.astype(int), at, 0.0, 1) == reachable(open_, at)).all()


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 1 << 30))
def test_prior_and_density_only_shrink(seed):
    rng = np.random.default_rng(seed)
    open_ = rng.random((14, 14)) < 0.7
    open_[7, 7] = True
    box, prior = (0, 13, 0, 13), rng.random((14, 14)) < 0.5
    loose, _ = k.flood(open_, open_.astype(int), (7, 7), box, 0.0, 2)
    tight, _ = k.flood(open_, open_.astype(int), (7, 7), box, 0.5, 2)
    assert not (tight & ~loose).any() and not (loose & ~open_).any()
    without, _ = k.flood(open_, open_.astype(int), (7, 7), box, 0.3, 2, prior, 0.0)
    plain, _ = k.flood(open_, open_.astype(int), (7, 7), box, 0.3, 2)
    assert (without == plain).all()


def test_labels_and_ranks():
    mask = np.zeros((8, 8), bool)
    mask[6, 0] = mask[0, 1] = mask[3:5, 3:5] = True
    mask[5, 5] = True  # diagonal to the block
    found = k.areas(mask, (3, 3))
    assert [(a.label, len(a.cells), a.rank) for a in found] == [(1, 1, 2), (2, 1, 3), (3, 5, 1)]
    assert len(k.areas(mask, (3, 3), four=True)) == 4
    assert [len(a.cells) for a in sorted(k.separated(mask, (3, 3), (0, 1)), key=lambda a: a.rank)][0] == 4


def test_walk_closes_around_an_area():
    mask = np.zeros((9, 9), bool)
    mask[3:6, 3:6] = True
    own = k.walk(mask)
    assert own.trail[0] == (2, 2) and own.edges and own.scouted_empty
    assert k.walk(np.eye(2, dtype=bool)).trail == []


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 1 << 30))
def test_walk_ends_and_stays_near(seed):
    rng = np.random.default_rng(seed)
    mask = rng.random((9, 11)) < 0.5
    for area in k.areas(mask, (0, 0)):
        own = k.walk(k.only(mask, area))
        assert len(own.trail) <= 12 * len(area.cells) + 201
        assert all(-1 <= r <= 9 and -1 <= c <= 11 for r, c in own.trail)


def told_fill(open_, match, seed, box, density, windows, prior, strength):
    """The fill as it is told, cell by cell."""
    r0, r1, c0, c1 = box
    alive, visited, sides = np.zeros(open_.shape, bool), np.zeros(open_.shape, bool), set()
    if not open_[seed]:
        return alive, 0
    alive[seed] = visited[seed] = True
    queue = [seed]
    while queue:
        r, c = queue.pop(0)
        for x in range(r - 1, r + 2):
            for y in range(c - 1, c + 2):
                out = {"N": x < r0, "S": x > r1, "W": y < c0, "E": y > c1}
                if any(out.values()):
                    sides |= {s for s, o in out.items() if o}
                elif not visited[x, y]:
                    visited[x, y] = True
                    if open_[x, y]:
                        near = [(u, v) for u in range(x - 1, x + 2) for v in range(y - 1, y + 2) if (u, v) != (x, y) and r0 <= u <= r1 and c0 <= v <= c1 and visited[u, v]]
                        bar = density + (strength if prior is not None and not prior[x, y] and match[x, y] / windows < 0.75 else 0.0)
                        if sum(bool(open_[n]) for n in near) / len(near) >= bar:
                            alive[x, y] = True
                            queue.append((x, y))
    return alive, len(sides)


@pytest.mark.parametrize("seed", range(30))
def test_fill_is_as_told(seed):
    rng = np.random.default_rng(seed)
    for _ in range(10):
        rows, columns = (int(x) for x in rng.integers(3, 22, 2))
        open_, match = rng.random((rows, columns)) < 0.75, rng.integers(0, 3, (rows, columns))
        at = (int(rng.integers(rows)), int(rng.integers(columns)))
        box = (int(rng.integers(0, at[0] + 1)), int(rng.integers(at[0], rows)), int(rng.integers(0, at[1] + 1)), int(rng.integers(at[1], columns)))
        prior = rng.random((rows, columns)) < 0.5 if rng.random() < 0.5 else None
        given = (open_, match, at, box, float(rng.choice([0.0, 0.2, 0.5, 0.7])), 2, prior, 0.2)
        (mask, sides), (want, touched) = k.flood(*given), told_fill(*given)
        assert (mask == want).all() and sides == touched


@pytest.mark.parametrize("four", [False, True])
def test_areas_against_a_flood(four):
    """Labels in column order of first cells, whatever the shape."""
    rng = np.random.default_rng(four)
    for _ in range(200):
        grid = rng.random((rng.integers(1, 14), rng.integers(1, 14))) < rng.choice([0.3, 0.5, 0.7])
        found, label = np.zeros(grid.shape, int), 0
        for c in range(grid.shape[1]):
            for r in range(grid.shape[0]):
                if grid[r, c] and not found[r, c]:
                    label += 1
                    stack = [(r, c)]
                    found[r, c] = label
                    while stack:
                        x, y = stack.pop()
                        for u, v in [(x + i, y + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i or j) and (not four or not (i and j))]:
                            if 0 <= u < grid.shape[0] and 0 <= v < grid.shape[1] and grid[u, v] and not found[u, v]:
                                found[u, v] = label
                                stack.append((u, v))
        own = np.zeros(grid.shape, int)
        for area in k.areas(grid, (0, 0), four):
            own[tuple(area.at)] = area.label
        assert (own == found).all()


def told_walk(mask):
    """The walk as it is told, in one rule for a step: beside a living corner it is always taken; beside a dead one only if
    something lives around the next place, or within the reach of two places before, and within two cells to its left.
    A step that is not taken is a turn to the left, after which earlier sights are forgotten."""
    if mask.sum() < 3:
        return [], [], False
    high, wide = mask.shape
    on_board = lambda p: -1 <= p[0] <= high and -1 <= p[1] <= wide
    lives = lambda p: 0 <= p[0] < high and 0 <= p[1] < wide and bool(mask[p])
    add = lambda p, v, n=1: (p[0] + n * v[0], p[1] + n * v[1])
    to_left = lambda v: (-v[1], v[0])  # noqa: E731  of (down, right) steps

    def sight(p, v):
        cells = [add(p, to_left(v), n) for n in range(1, high + wide + 4)]
        return [lives(c) for c in cells if on_board(c)]

    corner = tuple(int(x) - 1 for x in np.argwhere(mask)[0])
    trail, v, sights = [corner], (1, 0), [sight(corner, (1, 0))]
    turns, edges, opened, living = {corner}, [], 0, False
    for _ in range(40 * mask.size + 400):
        spot, nxt = trail[-1], add(trail[-1], v)
        taken = lives(add(nxt, to_left(v)))
        if taken and not on_board(nxt):
            break
        if not taken and on_board(nxt):
            seen = sight(nxt, v)
            reach = max((n for n, x in enumerate(sights[-2], 1) if x), default=0) if len(sights) > 1 else 0
            beyond = add(nxt, v)
            around = any(map(lives, (beyond, add(beyond, to_left(v)), add(beyond, to_left(v), -1))))
            taken = (around or any(seen[:reach])) and any(seen[:2])
        if taken:
            trail.append(nxt)
            sights.append(sight(nxt, v))
            living |= lives(nxt)
            continue
        edges.append((opened, len(trail) - 1, living))
        opened, living = len(trail) - 1, False
        if spot in turns and len(edges) >= 3:
            return trail, edges, not any(sight(corner, (1, 0)))
        turns.add(spot)
        v = to_left(v)
        sights = [sight(spot, v)]
    if opened < len(trail) - 1:
        edges.append((opened, len(trail) - 1, living))
    return trail, edges, not any(sight(corner, (1, 0)))


@pytest.mark.parametrize("seed", range(40))
def test_walk_is_as_told(seed):
    rng = np.random.default_rng(seed)
    for _ in range(12):
        grid = rng.random((rng.integers(4, 16), rng.integers(4, 16))) < rng.choice([0.45, 0.6, 0.8])
        for area in k.areas(grid, (0, 0)):
            mask = k.only(grid, area)
            trail, edges, empty = told_walk(mask)
            own = k.walk(mask)
            assert (own.trail, [(e.start, e.end, e.alive) for e in own.edges]) == (trail, edges)
            assert not trail or own.scouted_empty == empty


def test_margins():
    below, above = k.margins((0.5, 0.5, 1))
    assert not below(0.5) and above(0.5)
    below, above = k.margins((0.5, 0.5, 0))
    assert below(0.5) and not above(0.5)
    below, above = k.margins((0.3, 0.9))
    assert below(0.29) and not below(0.3) and not above(0.9) and above(0.91)


def test_cleanup_marks_what_it_changes_and_removal_wins():
    mask = np.zeros((15, 15), bool)
    mask[4:11, 4:11] = True
    mask[7, 11:14] = True  # a spur
    out, decided = k.cleanup(mask, np.zeros_like(mask), (7, 7), (0.5, 0.9), 20, False)
    assert not out[7, 13] and out[4:11, 4:11].sum() >= 45 and (decided >= (out != mask)).all()


def test_bridge_needs_a_finite_signature():
    mask = np.zeros((3, 3), bool)
    mask[0, 0] = mask[2, 2] = True
    cube = np.full((3, 3, 1), 0.5)
    args = (mask, np.zeros_like(mask), k.areas(mask, (0, 0)), cube)
    assert k.bridge(*args, np.array([0.5]), 0.1, (0.2, 0.7))[1, 1]
    assert not k.bridge(*args, np.array([np.nan]), 0.1, (0.2, 0.7))[1, 1]


def lobes():
    value = np.full((40, 40), 0.1)
    mask = np.zeros((40, 40), bool)
    mask[8:20, 8:30] = mask[20:22, 18:20] = mask[22:34, 8:30] = True
    value[mask] = 0.7
    value[22:34, 8:30] = 0.2
    return mask, value


@pytest.mark.parametrize("turn", [lambda a: a, np.transpose, np.fliplr, np.flipud])
@pytest.mark.parametrize("linear", [True, False])
def test_split_keeps_the_protected_lobe(turn, linear):
    mask, value = (np.ascontiguousarray(turn(x)) for x in lobes())
    seed = tuple(int(x) for x in np.argwhere(turn(np.arange(1600).reshape(40, 40)) == 12 * 40 + 15)[0])
    out, decided = k.split(mask, np.zeros_like(mask), value, 0.7, seed, 0.05, 2, linear, False)
    keep = k.protected(mask, value, 0.7, 0.05, seed)
    assert out[seed] and not (keep & ~out).any() and not (out & ~mask).any()


def test_split_needs_sensitivity_and_a_match():
    mask, value = lobes()
    none = np.zeros_like(mask)
    assert k.split(mask, none, value, 0.7, (12, 15), None, 2, True, False)[0] is mask
    assert k.split(mask, none, value, 0.9, (12, 15), 0.05, 2, True, False)[0] is mask
    assert k.protected(mask, value, 0.65, 0.05 + 1e-12, (12, 15)) is not None  # inclusive


def test_interior_drops_a_hole_and_never_decides():
    value = np.full((15, 15), 0.5)
    value[6:8, 6:8] = 0.95
    mask = np.zeros((15, 15), bool)
    mask[3:12, 3:12] = True
    out = k.interior(mask, np.zeros_like(mask), value, 0.5, (4, 4), 0.1, (0.1, 0.9), False)
    assert not out[6:8, 6:8].any() and out.sum() == 81 - 4
    kept = k.interior(mask, np.ones_like(mask), value, 0.5, (4, 4), 0.1, (0.1, 0.9), False)
    assert (kept == mask).all()


def test_windows_subset_and_joint_fill():
    cube = field(windows=3)
    cube[:, :, 2] = np.nan
    assert k.Site(cube, (10, 10), params(search_windows=(1, 2))).area().mask.sum() == 169
    assert k.Site(cube, (10, 10), params(time_independent_windows=False, min_windows_alive=3)).area().mask.sum() == 0
    assert k.Site(cube, (10, 10), params(time_independent_windows=False, min_windows_alive=2)).area().mask.sum() == 169
