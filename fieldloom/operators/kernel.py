"""Order-dependent delineation of one site on a small grid: fill, perimeter walk, cleanup, split, interior.

Pure Python over numpy arrays; Spark runs one call for each site (delineate.py).  Cells are (row, column) from 0; trail
positions may lie one cell outside the grid.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np

EIGHT = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]
FOUR = [(-1, 0), (0, 1), (1, 0), (0, -1)]
STEP = {"N": (-1, 0), "E": (0, 1), "S": (1, 0), "W": (0, -1)}
LEFT = {"N": "W", "W": "S", "S": "E", "E": "N"}


def eligible(cube: np.ndarray, mu: np.ndarray, tol: np.ndarray, threshold: tuple[float, float], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells that may grow, and their number of matching windows (strictly within the tolerance)."""
    finite = np.isfinite(cube)
    inside = (finite & (cube >= threshold[0]) & (cube <= threshold[1])).any(axis=2)
    with np.errstate(invalid="ignore"):
        match = (finite & np.isfinite(mu) & (np.abs(cube - mu) < tol)).sum(axis=2)
    return inside & (match >= least), match


def flood(open_: np.ndarray, match: np.ndarray, seed: tuple[int, int], box: tuple[int, int, int, int], density: float, windows: int, prior: np.ndarray | None = None, strength: float = 0.0, cross: float = 0.75) -> tuple[np.ndarray, int]:
    """Breadth-first growth from the seed in box (r0, r1, c0, c1, ends in).  A neighbour joins if enough of the visited cells around it are open; it is asked once.  Returns the mask and the number of box sides touched."""
    r0, r1, c0, c1 = box
    alive = np.zeros(open_.shape, bool)
    if not open_[seed]:
        return alive, 0
    # flat bytes with a ring around the box; the ring knows its sides
    rows, width = r1 - r0 + 1, c1 - c0 + 3
    part = np.zeros((rows + 2, width), np.uint8)
    part[1:-1, 1:-1] = open_[r0 : r1 + 1, c0 : c1 + 1]
    opened, ring = part.tobytes(), np.zeros_like(part)
    ring[0] |= 1
    ring[-1] |= 2
    ring[:, 0] |= 4
    ring[:, -1] |= 8
    border, sides = ring.tobytes(), 0
    bars = None
    if prior is not None:
        bar = np.full(part.shape, density)
        bar[1:-1, 1:-1] += np.where(~prior[r0 : r1 + 1, c0 : c1 + 1] & (match[r0 : r1 + 1, c0 : c1 + 1] / windows < cross), strength, 0.0)
        bars = bar.ravel().tolist()
    visited, good, joined = bytearray(len(opened)), bytearray(len(opened)), bytearray(len(opened))
    around = [i * width + j for i, j in EIGHT]
    a, b, c, d, e, f, g, h = around
    start = (seed[0] - r0 + 1) * width + seed[1] - c0 + 1
    visited[start] = good[start] = joined[start] = 1
    queue = deque([start])
    while queue:
        p = queue.popleft()
        for o in around:
            q = p + o
            if visited[q]:
                continue
            if border[q]:
                sides |= border[q]
                continue
            visited[q] = 1
            if not opened[q]:
                continue
            seen = visited[q + a] + visited[q + b] + visited[q + c] + visited[q + d] + visited[q + e] + visited[q + f] + visited[q + g] + visited[q + h]
            fits = good[q + a] + good[q + b] + good[q + c] + good[q + d] + good[q + e] + good[q + f] + good[q + g] + good[q + h]
            good[q] = 1
            if fits / seen >= (density if bars is None else bars[q]):
                joined[q] = 1
                queue.append(q)
    alive[r0 : r1 + 1, c0 : c1 + 1] = np.frombuffer(joined, np.uint8).reshape(part.shape)[1:-1, 1:-1]
    return alive, sides.bit_count()


def rungs(rows: int, columns: int) -> list[tuple[int, int]]:
    """Window sizes from small to the full grid, each the next by the root of two, ten cells at least."""
    sizes = [(rows, columns)]
    while True:
        a, b = (int(n / 2**0.5) for n in sizes[-1])
        if a < 10 or b < 10:
            return sizes[::-1]
        sizes.append((a, b))


def ladder(open_: np.ndarray, match: np.ndarray, seed: tuple[int, int], density: float, windows: int, prior: np.ndarray | None = None, strength: float = 0.0) -> np.ndarray:
    """Floods in growing windows until one touches no side; the last window is the full grid."""
    rows, columns = open_.shape
    sizes = rungs(rows, columns)
    mask = np.zeros(open_.shape, bool)
    for k, (a, b) in enumerate(sizes):
        box = (0, rows - 1, 0, columns - 1)
        if k < len(sizes) - 1:
            low = [(n - 1) // 2 for n in (a, b)]
            high = [n - 1 - h for n, h in zip((a, b), low, strict=True)]
            box = (max(0, seed[0] - low[0]), min(rows - 1, seed[0] + high[0]), max(0, seed[1] - low[1]), min(columns - 1, seed[1] + high[1]))
        mask, sides = flood(open_, match, seed, box, density, windows, prior, strength)
        if not sides:
            break
    return mask


@dataclass
class Area:
    label: int
    at: np.ndarray  # rows and columns of its cells
    distance: int
    rank: int = 0

    @cached_property
    def cells(self) -> list[tuple[int, int]]:
        return list(zip(*self.at.tolist(), strict=True))

    @property
    def size(self) -> int:
        return self.at.shape[1]


def areas(mask: np.ndarray, seed: tuple[int, int], four: bool = False) -> list[Area]:
    """Connected areas, labelled by first cell in column order, ranked by distance to the seed, size and label.

    Cells of a column that follow each other are one run; runs of neighbouring columns that meet are united.
    """
    rows, columns = mask.shape
    flat = np.zeros((columns, rows + 1), bool)  # column by column, each ended by a dead cell
    flat[:, :-1] = mask.T
    flat = np.concatenate([[False], flat.ravel()])
    change = np.flatnonzero(flat[1:] != flat[:-1])
    low, high = change[::2], change[1::2]  # first and one past the last, in column order
    if not len(low):
        return []
    column, reach = low // (rows + 1), 0 if four else 1
    # runs of the column before that meet each run: from the first that ends above ... to the last that begins below
    above = np.searchsorted(high, low - (rows + 1) - reach, "right")
    below = np.searchsorted(low, high - (rows + 1) + reach, "left")
    edge = np.searchsorted(column, np.maximum(column - 1, 0), "left")
    own = np.searchsorted(column, column, "left")
    above, below = np.maximum(above, edge), np.minimum(below, own)
    parent = list(range(len(low)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for k in np.flatnonzero((below > above) & (column > 0)).tolist():
        for j in range(above[k], below[k]):
            x, y = find(k), find(j)
            if x != y:
                parent[max(x, y)] = min(x, y)
    roots = np.array([find(k) for k in range(len(low))])
    _, label = np.unique(roots, return_inverse=True)
    length = high - low
    of = np.repeat(label, length)
    place = np.repeat(low - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(int(length.sum()))
    c, r = np.divmod(place, rows + 1)
    order = np.argsort(of, kind="stable")
    ends = np.cumsum(np.bincount(of))
    far = np.maximum(np.abs(r - seed[0]), np.abs(c - seed[1]))
    found = [Area(k + 1, np.stack([r[own], c[own]]), int(far[own].min())) for k, own in enumerate(np.split(order, ends[:-1]))]
    for rank, area in enumerate(sorted(found, key=lambda x: (x.distance, -x.size, x.label)), 1):
        area.rank = rank
    return found


def separated(mask: np.ndarray, seed: tuple[int, int], strict) -> list[Area]:
    """False: eight neighbours; True: four; (0, n): the n nearest areas are cut again by four neighbours."""
    if strict is False or strict is True:
        return areas(mask, seed, bool(strict))
    whole = areas(mask, seed)
    if len(whole) == 1:
        return areas(mask, seed, True)
    near = np.zeros(mask.shape, bool)
    for area in whole:
        if area.rank <= strict[1]:
            near[tuple(area.at)] = True
    parts = areas(near, seed, True) + areas(mask & ~near, seed)
    for k, area in enumerate(sorted(parts, key=lambda x: (int(x.at[1, 0]), int(x.at[0, 0]))), 1):
        area.label = k
    for rank, area in enumerate(sorted(parts, key=lambda x: (x.distance, -x.size, x.label)), 1):
        area.rank = rank
    return sorted(parts, key=lambda x: x.label)


def only(mask: np.ndarray, area: Area | None) -> np.ndarray:
    out = np.zeros(mask.shape, bool)
    if area is not None:
        out[tuple(area.at)] = True
    return out


def nearest_area(mask: np.ndarray, seed: tuple[int, int], strict=False) -> np.ndarray:
    return only(mask, min(separated(mask, seed, strict), key=lambda x: x.rank, default=None))


def perimeter(cells: list[tuple[int, int]]) -> set[tuple[int, int]]:
    """First and last cell of every row and column."""
    rows, columns = {}, {}
    for r, c in cells:
        a, b = rows.get(r, (c, c))
        rows[r] = (min(a, c), max(b, c))
        a, b = columns.get(c, (r, r))
        columns[c] = (min(a, r), max(b, r))
    return {(r, c) for r, ends in rows.items() for c in ends} | {(r, c) for c, ends in columns.items() for r in ends}


def envelope(cells: list[tuple[int, int]], shape: tuple[int, int]) -> tuple[dict, dict]:
    """For each row (column) of an area the range one cell beyond it, clamped."""
    rows, columns = {}, {}
    for r, c in cells:
        a, b = rows.get(r, (c, c))
        rows[r] = (min(a, c), max(b, c))
        a, b = columns.get(c, (r, r))
        columns[c] = (min(a, r), max(b, r))
    clamp = lambda ends, n: (max(0, ends[0] - 1), min(n - 1, ends[1] + 1))
    return {r: clamp(e, shape[1]) for r, e in rows.items()}, {c: clamp(e, shape[0]) for c, e in columns.items()}


@dataclass
class Edge:
    start: int
    end: int
    alive: bool


@dataclass
class Walk:
    trail: list[tuple[int, int]] = field(default_factory=list)
    heading: list[str] = field(default_factory=list)
    edges: list[Edge] = field(default_factory=list)
    scouted_empty: bool = False


def walk(mask: np.ndarray) -> Walk:
    """Closed trail around an area, which stays on the left; empty below three cells."""
    rows, columns = mask.shape
    out = Walk()
    n = int(mask.sum())
    if n < 3:
        return out
    inside = lambda p: -1 <= p[0] <= rows and -1 <= p[1] <= columns
    alive = lambda p: 0 <= p[0] < rows and 0 <= p[1] < columns and bool(mask[p])
    move = lambda p, d: (p[0] + STEP[d][0], p[1] + STEP[d][1])

    # the line of sight by sums along rows and columns and the outermost cells of each
    along = {False: np.pad(np.cumsum(mask, axis=1), ((0, 0), (1, 0))).tolist(), True: np.pad(np.cumsum(mask, axis=0), ((1, 0), (0, 0))).T.tolist()}
    ends = {}
    for upright, grid in ((False, mask), (True, mask.T)):
        some = grid.any(axis=1)
        ends[upright] = (np.where(some, grid.argmax(axis=1), grid.shape[1]).tolist(), np.where(some, grid.shape[1] - 1 - grid[:, ::-1].argmax(axis=1), -1).tolist())

    def line(p, d) -> tuple[bool, int, int, int]:
        """Whether the sight to the left is a column, which line it is, the place in it and the direction."""
        to = LEFT[d]
        upright = to in "NS"
        return (upright, p[1], p[0], -1 if to == "N" else 1) if upright else (upright, p[0], p[1], -1 if to == "W" else 1)

    def furthest(p, d) -> int:
        """How many cells lie between p and the last alive one to its left; -1 without one."""
        upright, which, place, way = line(p, d)
        low, high = ends[upright]
        if not 0 <= which < len(low):
            return -1
        return max(-1, high[which] - place - 1 if way > 0 else place - low[which] - 1)

    def sees(p, d, n) -> bool:
        """Whether one of the first n cells to the left is alive."""
        upright, which, place, way = line(p, d)
        sums = along[upright]
        if not 0 <= which < len(sums) or n <= 0:
            return False
        size = len(sums[which]) - 1
        a, b = (place + 1, place + 1 + n) if way > 0 else (place - n, place)
        a, b = max(0, min(a, size)), max(0, min(b, size))
        return sums[which][b] > sums[which][a]

    first = tuple(int(x) for x in np.argwhere(mask)[0])
    at, way, state, before = (first[0] - 1, first[1] - 1), "S", "walk", None
    out.trail, out.heading = [at], [way]
    out.scouted_empty = furthest(at, way) < 0
    memory, pivots, edge_start, edge_alive, count = [furthest(at, way)], {at}, 0, False, 1  # the start is a pivot

    def pivot() -> bool:
        nonlocal way, memory, edge_start, edge_alive, count
        out.edges.append(Edge(edge_start, len(out.trail) - 1, edge_alive))
        edge_start, edge_alive = len(out.trail) - 1, False
        done = at in pivots and count >= 3
        pivots.add(at)
        count += 1
        way = LEFT[way]
        memory = [furthest(at, way)]  # sight begins anew along the new heading
        return done

    def accept(p) -> None:
        nonlocal edge_alive
        out.trail.append(p)
        out.heading.append(way)
        edge_alive |= alive(p)
        memory.append(furthest(p, way))

    for _ in range(12 * n + 200):
        ahead = move(at, way)
        if state == "walk":
            if not alive(move(ahead, LEFT[way])):
                if not inside(ahead):
                    if pivot():
                        return out
                    continue
                before, at, state = at, ahead, "scout"
            elif not inside(ahead):
                break
            else:
                at = ahead
                accept(at)
            continue
        if state == "scout":
            side = (ahead, move(ahead, LEFT[way]), move(ahead, LEFT[LEFT[LEFT[way]]]))
            reach = memory[-2] if len(memory) >= 2 else -1
            if any(map(alive, side)) or sees(at, way, reach + 1):
                state = "pending"
                continue
        elif sees(at, way, 2):
            accept(at)
            state = "walk"
            continue
        at, state = before, "walk"
        if pivot():
            return out
    if edge_start < len(out.trail) - 1:
        out.edges.append(Edge(edge_start, len(out.trail) - 1, edge_alive))
    return out


def margins(values: tuple[float, ...]):
    """Tests below and above: strict, but bias 0 makes below inclusive and bias 1 above."""
    low, high = values[:2]
    bias = values[2] if len(values) == 3 else None
    return (lambda x: x <= low if bias == 0 else x < low), (lambda x: x >= high if bias == 1 else x > high)


def classify(own: Walk, mask: np.ndarray, decided: np.ndarray, area: Area, below, above) -> tuple[set, set]:
    """Cells to remove and to revive along a trail; removal wins."""
    rows, columns = mask.shape
    grid = lambda p: 0 <= p[0] < rows and 0 <= p[1] < columns
    remove, revive = set(), set()
    for k, edge in enumerate(own.edges):
        part = list(own.trail[edge.start + 1 : edge.end])
        if own.edges[k - 1].alive if k else not own.scouted_empty:
            part.insert(0, own.trail[edge.start])
        if edge.alive and edge.end > edge.start:
            part.append(own.trail[edge.end])
        if not part:
            continue
        ratio = sum(grid(p) and bool(mask[p]) for p in part) / len(part)
        if below(ratio):
            remove |= {p for p in part if grid(p) and mask[p] and not decided[p]}
        elif above(ratio):
            for p in part:
                if grid(p) and not mask[p] and not decided[p]:
                    around = [(p[0] + i, p[1] + j) for i, j in FOUR]
                    if sum(grid(q) and (bool(mask[q]) or q in revive) for q in around) >= 2:
                        revive.add(p)
    trail = set(own.trail)
    row_span, column_span = np.ptp(area.at[0]) + 1, np.ptp(area.at[1]) + 1
    in_row, in_column = np.bincount(area.at[0], minlength=rows), np.bincount(area.at[1], minlength=columns)
    for r, c in perimeter(area.cells):
        if (r, c) in trail or decided[r, c]:
            continue
        block = mask[max(0, r - 1) : r + 2, max(0, c - 1) : c + 2]
        if below(min(block.mean(), in_column[c] / row_span, in_row[r] / column_span)):
            remove.add((r, c))
    return remove, revive - remove


def cleanup(mask: np.ndarray, decided: np.ndarray, seed: tuple[int, int], values: tuple[float, ...], iterations: int, multiple: bool, strict=False) -> tuple[np.ndarray, np.ndarray]:
    """Perimeter cleanup to a fixpoint or the iteration limit; one area only, before and after, unless ``multiple``."""
    mask, decided = mask.copy(), decided.copy()
    below, above = margins(values)
    if not multiple:
        mask = nearest_area(mask, seed, strict)
    for _ in range(iterations):
        changed = False
        for area in areas(mask, seed):
            if len(area.cells) < 3 or len(perimeter(area.cells)) < 3:
                continue
            remove, revive = classify(walk(only(mask, area)), mask, decided, area, below, above)
            for p in remove:
                changed |= bool(mask[p])
                mask[p], decided[p] = False, True
            for p in revive:
                changed |= not mask[p]
                mask[p], decided[p] = True, True
        if not changed:
            break
    return (mask if multiple else nearest_area(mask, seed, strict)), decided


def medians(cube: np.ndarray) -> np.ndarray:
    """Median of each cell's finite windows; NaN without one."""
    own = np.where(np.isfinite(cube), cube, np.nan)
    out = np.full(own.shape[:2], np.nan)
    some = np.isfinite(own).any(axis=2)
    out[some] = np.nanmedian(own[some], axis=1)
    return out


def protected(mask: np.ndarray, value: np.ndarray, mu: float, sensitivity: float, seed: tuple[int, int]) -> np.ndarray | None:
    """The component of matching cells (inclusive) that holds the seed."""
    with np.errstate(invalid="ignore"):
        near = mask & (np.abs(value - mu) <= sensitivity)
    if not near[seed]:
        return None
    return next(only(near, a) for a in areas(near, seed) if seed in a.cells)


def _line(ends: tuple[int, int], fixed: int, along_row: bool) -> list[tuple[int, int]]:
    return [(fixed, k) if along_row else (k, fixed) for k in range(ends[0], ends[1] + 1)]


def _curved(at, way, rows, columns, mask, value, mu, sensitivity) -> list[tuple[int, int]]:
    """Cut cells that follow the first matching cell behind the spine until the envelope."""
    move = lambda p, d: (p[0] + STEP[d][0], p[1] + STEP[d][1])
    edge = lambda p: (p[0] in rows and p[1] in rows[p[0]]) or (p[1] in columns and p[0] in columns[p[1]])
    grid = lambda p: 0 <= p[0] < mask.shape[0] and 0 <= p[1] < mask.shape[1]
    spine_way, scan_way, cut = LEFT[way], LEFT[LEFT[way]], []
    spine = move(at, spine_way)
    while grid(spine):
        q, last, hit = spine, spine, None
        while grid(q):
            if edge(q):
                hit = q
                break
            if mask[q] and abs(value[q] - mu) <= sensitivity:
                hit = last
                break
            last, q = q, move(q, scan_way)
        if hit is None:
            break
        cut.append(hit)
        if edge(spine):
            break
        spine = move(spine, spine_way)
    return cut


def split(mask: np.ndarray, decided: np.ndarray, value: np.ndarray, mu: float, seed: tuple[int, int], sensitivity: float | None, gate: int, linear: bool, multiple: bool, strict=False) -> tuple[np.ndarray, np.ndarray]:
    """Cut areas where the medians across them leave the seed's signature; an axis that would kill a protected cell is dropped."""
    if sensitivity is None or not np.isfinite(mu):
        return mask, decided
    keep = protected(mask, value, mu, sensitivity, seed)
    if keep is None:
        return mask, decided
    for area in areas(mask, seed):
        if len(area.cells) < 3 or len(perimeter(area.cells)) < 3:
            continue
        own, (rows, columns) = walk(only(mask, area)), envelope(area.cells, mask.shape)
        snapshot, accepted = mask, []
        for axis in ("y", "x"):
            cut: list[tuple[int, int]] = []

            def line(p, axis=axis):
                return _line(rows[p[0]], p[0], True) if axis == "y" and p[0] in rows else _line(columns[p[1]], p[1], False) if axis == "x" and p[1] in columns else []

            def bent(p, way):
                return _curved(p, way, rows, columns, snapshot, value, mu, sensitivity)

            streak: list[int] = []
            flags: list[list[int]] = []
            k = 1
            while k < len(own.trail):
                p, q = own.trail[k - 1], own.trail[k]
                on_axis = (p[0] != q[0]) == (axis == "y")
                cells = [x for x in line(q) if snapshot[x]] if on_axis else []
                seen = [value[x] for x in cells if np.isfinite(value[x])]
                if seen and abs(float(np.median(seen)) - mu) >= sensitivity:
                    streak.append(k)
                    if len(streak) == gate and not multiple:
                        flags.append(streak[:1])
                        k, streak = streak[0], []
                else:
                    if multiple and len(streak) >= gate:
                        flags.append(streak)
                    streak = []
                k += 1
            if multiple and len(streak) >= gate:
                flags.append(streak)
            for flag in flags:
                for end in {flag[0], flag[-1]}:
                    p = own.trail[end]
                    cut += line(p) if linear else (bent(p, own.heading[end]) or line(p))
                for middle in flag[1:-1]:
                    cut += line(own.trail[middle])
            trial = snapshot.copy()
            for x in cut:
                trial[x] = False
            if not (keep & ~trial).any():
                accepted += cut
        if accepted:
            mask, decided = mask.copy(), decided.copy()
            for x in accepted:
                mask[x], decided[x] = False, True
    return (mask if multiple else nearest_area(mask, seed, strict)), decided


def interior(mask: np.ndarray, decided: np.ndarray, value: np.ndarray, mu: float, seed: tuple[int, int], sensitivity: float | None, threshold: tuple[float, float], multiple: bool, strict=False) -> np.ndarray:
    """Drop cells inside an area that leave the threshold; where a line's median leaves the signature keep only cells that match."""
    if sensitivity is None or not np.isfinite(mu):
        return mask
    out = mask.copy()
    for area in areas(mask, seed):
        if len(area.cells) < 3:
            continue
        own = only(mask, area)
        rows, columns = envelope(area.cells, mask.shape)
        for lines, along_row in ((rows, True), (columns, False)):
            for fixed, ends in lines.items():
                cells = _line(ends, fixed, along_row)
                if len(cells) < 3:
                    continue
                seen = [value[x] for x in cells if own[x] and np.isfinite(value[x])]
                if not seen:
                    continue
                off = abs(float(np.median(seen)) - mu) > sensitivity
                for x in cells[1:-1]:
                    v = value[x]
                    if decided[x] or not np.isfinite(v):
                        continue
                    inside = threshold[0] <= v <= threshold[1]
                    new = (abs(v - mu) <= sensitivity and inside) if off else bool(mask[x]) and inside
                    if new != mask[x]:
                        out[x] = new
    return out if multiple else nearest_area(out, seed, strict)


def bridge(mask: np.ndarray, decided: np.ndarray, found: list[Area], cube: np.ndarray, mu: np.ndarray, sensitivity: float, threshold: tuple[float, float]) -> np.ndarray:
    """Dead cells that touch two areas come alive if a window with a signature matches inside the threshold."""
    label = np.zeros(mask.shape, int)
    for area in found:
        label[tuple(area.at)] = area.label
    with np.errstate(invalid="ignore"):
        fits = (np.isfinite(mu) & (cube >= threshold[0]) & (cube <= threshold[1]) & (np.abs(cube - mu) < sensitivity)).any(axis=2)
    out = mask.copy()
    for r, c in np.argwhere(~mask & ~decided & fits):
        near = {int(x) for x in label[max(0, r - 1) : r + 2, max(0, c - 1) : c + 2].ravel()} - {0}
        out[r, c] = len(near) >= 2
    return out


def learned(cube: np.ndarray, seed: tuple[int, int], sensitivity: float, threshold: tuple[float, float]) -> np.ndarray:
    """Signature of each window from the seed's block."""
    r, c = seed
    block = cube[max(0, r - 1) : r + 2, max(0, c - 1) : c + 2]
    out = np.full(cube.shape[2], np.nan)
    for w in range(cube.shape[2]):
        at = cube[r, c, w]
        if not np.isfinite(at):
            continue
        v = block[:, :, w].ravel()
        v = v[np.isfinite(v)]
        v = v[(np.abs(v - at) < sensitivity) & (v >= threshold[0]) & (v <= threshold[1])]
        out[w] = np.median(v) if len(v) >= 2 else at
    return out


class Site:
    """State of one site's delineation."""

    def __init__(self, cube: np.ndarray, seed: tuple[int, int], params, mu: np.ndarray | None = None, tol: np.ndarray | None = None, prior: np.ndarray | None = None, strength: float = 0.0):
        if params.search_windows != "all":
            own = [k - 1 for k in params.search_windows if k <= cube.shape[2]]
            cube, mu, tol = cube[:, :, own], None if mu is None else mu[own], None if tol is None else tol[own]
        self.cube, self.seed, self.params, self.prior, self.strength = cube, seed, params, prior, strength
        self.mu = learned(cube, seed, params.area_sensitivity, params.area_threshold) if mu is None else mu
        self.tol = np.full(cube.shape[2], params.area_sensitivity) if tol is None else tol
        self.value = medians(cube)
        usable = self.mu[np.isfinite(self.mu)]
        self.centre = float(np.median(usable)) if len(usable) else np.nan
        self.mask, self.decided, self.staged = None, np.zeros(cube.shape[:2], bool), None

    def trace(self, values=None, iterations: int | None = None) -> Site:
        """Cleanup now, or kept for the fill if there is no mask yet; margins and iterations are the settings' if not given."""
        p = self.params
        values = p.perimeter_margins if values is None else values
        iterations = p.trace_iter if iterations is None else iterations
        if self.mask is None:
            self.staged = (values, iterations)
        else:
            self.mask, self.decided = cleanup(self.mask, self.decided, self.seed, values, iterations, p.multiple_areas, p.area_separation_strict)
        return self

    def _grow(self, open_: np.ndarray, match: np.ndarray, windows: int) -> np.ndarray:
        """The ladder from the seed; inside a mask that is there already, one flood from each area's open cell nearest the seed."""
        p = self.params
        if self.mask is None:
            return ladder(open_, match, self.seed, p.local_alive_density, windows, self.prior, self.strength)
        out, open_ = np.zeros(open_.shape, bool), open_ & self.mask
        for area in areas(self.mask, self.seed):
            cells = [x for x in area.cells if open_[x]]
            if cells:
                start = min(cells, key=lambda x: ((x[0] - self.seed[0]) ** 2 + (x[1] - self.seed[1]) ** 2, x))
                box = (0, open_.shape[0] - 1, 0, open_.shape[1] - 1)
                out |= flood(open_, match, start, box, p.local_alive_density, windows, self.prior, self.strength)[0]
        return out

    def area(self) -> Site:
        """Fill from the seed: one flood for each window and their union, or one flood over all windows; again within a mask."""
        p, n = self.params, self.cube.shape[2]
        if p.time_independent_windows:
            mask = np.zeros(self.cube.shape[:2], bool)
            for w in range(n):
                one = self.cube[:, :, w : w + 1]
                open_, match = eligible(one, self.mu[w : w + 1], self.tol[w : w + 1], p.area_threshold, 1)
                mask |= self._grow(open_, match, 1)
        else:
            open_, match = eligible(self.cube, self.mu, self.tol, p.area_threshold, min(p.min_windows_alive, n))
            mask = self._grow(open_, match, n)
        self.mask = mask
        if self.staged is not None:
            staged, self.staged = self.staged, None
            self.trace(*staged)
        if p.merge_separate_areas:
            self.mask = bridge(self.mask, self.decided, separated(self.mask, self.seed, p.area_separation_strict), self.cube, self.mu, p.area_sensitivity, p.area_threshold)
        if not p.multiple_areas:
            self.mask = nearest_area(self.mask, self.seed, p.area_separation_strict)
        return self

    def split(self) -> Site:
        p = self.params
        self.mask, self.decided = split(self.mask, self.decided, self.value, self.centre, self.seed, p.split_sensitivity, p.split_gate, p.split_linear, p.multiple_areas, p.area_separation_strict)
        return self

    def interior(self) -> Site:
        p = self.params
        self.mask = interior(self.mask, self.decided, self.value, self.centre, self.seed, p.interior_sensitivity, p.interior_threshold, p.multiple_areas, p.area_separation_strict)
        return self

    def boundary(self, cleanups: int = 2) -> Site:
        """The fixed sequence of stages, ``cleanups`` of its middle pairs; on a mask that is there already nothing is decided or staged."""
        check_cleanups(cleanups)
        if self.mask is not None:
            self.decided, self.staged = np.zeros(self.cube.shape[:2], bool), None
        self.trace().area().trace().split().trace().interior().trace()
        for _ in range(cleanups):
            self.split().trace()
        return self.split().trace((0.3, 0.9)).split().trace((0.5, 0.5, 1))


def check_cleanups(n) -> int:
    if not isinstance(n, int) or isinstance(n, bool) or not 0 <= n <= 5:
        raise ValueError("cleanup_boundary is a whole number from 0 to 5")
    return n
