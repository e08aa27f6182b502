"""Betweenness of digraphs in which few vertices, the core, have a part in every edge.

All other vertices, the fringe, have neighbours in the core only. A search is one of the core then: an edge between two of its
vertices is one step, the fringe vertices between them are steps of two, as many as there are, so levels and paths come from
products of matrices of the core's size, many sources at a time. Fringe vertices with the same sources are reached alike, a
class of them; those with the same targets too are of one kind and are searched from once. What is left for a pair of a source
and a class is the number of paths to it, a sum of a few rows: exact for every pair, and no row for one is made.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Vertices of a core at most: its matrices have the square of that, 32 MB each.
CORE = 2048
#: Sources that are searched from at a time; classes of a block, whose paths from these are held (8 MB); rows of one step in it.
SOURCES, CLASSES, ROWS = 64, 1 << 14, 256
#: Level of what isn't reached; a number below all numbers of paths.
FAR, LEAST = 1 << 40, 2.0**-1001
#: Pairs of a fringe vertex's source and target that are listed at a time.
PAIRS = 1 << 20


@dataclass
class Lists:
    """Row i's items are items[start[i]:start[i + 1]]."""

    start: np.ndarray
    items: np.ndarray

    @classmethod
    def of(cls, rows: np.ndarray, items: np.ndarray, n: int) -> Lists:
        order = np.lexsort((items, rows))
        return cls(np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]), items[order])

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.start)

    def places(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number in rows and place in items, for each item of these rows."""
        length = self.lengths[rows]
        of = np.repeat(np.arange(len(rows)), length)
        return of, np.arange(len(of)) + np.repeat(self.start[rows] - (np.cumsum(length) - length), length)

    def picked(self, rows: np.ndarray) -> Lists:
        of, at = self.places(rows)
        return Lists(np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(rows)))]), self.items[at])


@dataclass
class Block:
    """Classes first to first + many of equal length: the core vertices that lead to them (slots by classes), how many vertices
    they stand for, and their places by core vertex."""

    first: int
    sources: np.ndarray
    size: np.ndarray
    hubs: np.ndarray
    begin: np.ndarray
    rows: np.ndarray


@dataclass
class Cover:
    """one, two: steps of one and of two between core vertices. Kinds of fringe vertices: into and out of, how many are of one,
    and the class that they are in (-1: nothing leads to them). asked: kinds that lead somewhere, those with equal targets in a row."""

    one: np.ndarray
    two: np.ndarray
    into: Lists
    out: Lists
    size: np.ndarray
    of_class: np.ndarray
    classes: Lists
    blocks: list[Block]
    asked: Lists

    @property
    def searches(self) -> int:
        return len(self.asked.lengths) + len(self.one)

    def cuts(self) -> list[int]:
        """Where the parts of sums() begin: core vertices, their pairs one and two steps apart, classes' sources, kinds'
        sources and targets."""
        n = len(self.one)
        return np.cumsum([n, n * n, n * n, len(self.classes.items), len(self.into.items)]).tolist()


def fringe(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Which of n vertices are fringe: none is another's neighbour, and no more can be added; those of few neighbours first."""
    degree = np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
    rank = np.empty(n, np.int64)
    rank[np.lexsort((np.arange(n), degree))] = np.arange(n)
    out, open_ = np.zeros(n, bool), np.ones(n, bool)
    while open_.any():
        inner = open_[a] & open_[b]
        a, b = a[inner], b[inner]
        least = open_.copy()
        least[np.where(rank[a] > rank[b], a, b)] = False
        out |= least
        open_ &= ~least
        open_[b[least[a]]] = False
        open_[a[least[b]]] = False
    return out


def _groups(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The group of each row of equal keys, and a row of each group."""
    order = np.lexsort(keys)
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], 0)
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    return group, order[new]


def covered(a: np.ndarray, b: np.ndarray, n: int, most: int = CORE) -> tuple[Cover, np.ndarray, np.ndarray, np.ndarray] | None:
    """The cover of a digraph's edges a -> b, its core vertices, the fringe vertices and their kinds; None if its core has more
    than most vertices."""
    outer = fringe(a, b, n)
    core, rest = np.flatnonzero(~outer), np.flatnonzero(outer)
    if len(core) > most:
        return None
    place = np.empty(n, np.int64)
    place[core], place[rest] = np.arange(len(core)), np.arange(len(rest))
    one = np.zeros((len(core), len(core)))
    both = ~outer[a] & ~outer[b]
    one[place[a[both]], place[b[both]]] = 1
    into, out = (Lists.of(place[x[outer[x]]], place[y[outer[x]]], len(rest)) for x, y in ((b, a), (a, b)))
    # lists are equal by their length and 128 bits of hash
    draw = np.random.default_rng(7).integers(0, 1 << 63, (2, len(core)), np.int64).astype(np.uint64)
    keys = []
    for side in (into, out):
        of = np.repeat(np.arange(len(rest)), side.lengths)
        sums = np.zeros((2, len(rest)), np.uint64)
        for i in (0, 1):
            np.add.at(sums[i], of, draw[i][side.items] * np.uint64(2) + np.uint64(1))
        keys.append([sums[0], sums[1], side.lengths])
    kind, first = _groups([*keys[0], *keys[1]])
    size = np.bincount(kind, minlength=len(first))
    into, out = into.picked(first), out.picked(first)
    # classes of equal length on end, so that blocks are matrices
    of_class, lead = _groups([x[first] for x in keys[0]])
    of_class = of_class if len(lead) == 0 or into.lengths[lead[0]] else of_class - 1
    classes = into.picked(lead[into.lengths[lead] > 0])
    many = np.bincount(of_class[of_class >= 0], size[of_class >= 0], len(classes.lengths))
    two = np.zeros((len(core), len(core)))
    for kinds in _few(into, out):
        k, i, j = _pairs(into, out, kinds)
        two += np.bincount(into.items[i] * len(core) + out.items[j], size[k], two.size).reshape(two.shape)
    to, lead = _groups([x[first] for x in keys[1]])
    some = np.flatnonzero(out.lengths > 0)
    lead = lead[out.lengths[lead] > 0]
    # in no order, so that tasks get alike: groups of few targets have many kinds
    mixed = np.random.default_rng(7).permutation(len(lead))
    asked = Lists.of(mixed[to[some] - (to.max(initial=-1) + 1 - len(lead))], some, len(lead))
    cover = Cover(one, two, into, out, size, of_class, classes, _blocks(classes, many), asked)
    return cover, core, rest, kind


def _blocks(classes: Lists, many: np.ndarray) -> list[Block]:
    length, out = classes.lengths, []
    bounds = np.flatnonzero(np.diff(length, prepend=-1)).tolist() + [len(length)]
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        for x in range(lo, hi, CLASSES):
            y = min(x + CLASSES, hi)
            sources = classes.items[classes.start[x] : classes.start[y]].reshape(y - x, -1)
            order = np.argsort(sources, axis=None, kind="stable")
            hubs, begin = np.unique(sources.ravel()[order], return_index=True)
            out.append(Block(x, np.ascontiguousarray(sources.T), many[x:y], hubs, np.append(begin, len(order)), order // sources.shape[1]))
    return out


def _few(into: Lists, out: Lists):
    """Kinds, so many at a time that they have PAIRS pairs of a source and a target, or one kind."""
    total = np.cumsum(into.lengths * out.lengths)
    lo = 0
    while lo < len(total):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + PAIRS, "right")))
        yield np.arange(lo, hi)
        lo = hi


def _pairs(into: Lists, out: Lists, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kind, place of a source and place of a target, for all pairs of these."""
    of, i = into.places(kinds)
    again, j = out.places(kinds[of])
    return kinds[of][again], i[again], j


def sums(cover: Cover, numbers: np.ndarray) -> np.ndarray:
    """What the searches of these numbers (groups of kinds with the same targets, then core vertices) add to the parts of cuts(); a
    group stands for all vertices of its kinds, but kinds' own edges are of one vertex: what it sends, and what it would get
    from itself."""
    parts = np.split(np.zeros(cover.cuts()[-1] + len(cover.out.items)), cover.cuts())
    for lo in range(0, len(numbers), SOURCES):
        _added(cover, numbers[lo : lo + SOURCES], *parts)
    return np.concatenate(parts)


def _levels(cover: Cover, start: np.ndarray, first: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Paths to the core's vertices, an array for each level, and the level of each: start is there, first after a step."""
    unseen = start == 0
    level = np.where(unseen, FAR, 0)
    one, two = cover.one.T, cover.two.T
    paths = [start]
    while len(paths) < 3 or paths[-1].any() or paths[-2].any():
        new = one @ paths[-1] + (two @ paths[-2] if len(paths) > 1 else first)
        new *= unseen
        level[new > 0] = len(paths)
        unseen &= new == 0
        paths.append(new)
    return paths, level


def _added(cover: Cover, numbers: np.ndarray, nodes, ones, twos, classes, sources, targets) -> None:
    n, k = len(cover.one), len(numbers)
    m = len(cover.asked.lengths)
    groups, roots = np.flatnonzero(numbers < m), np.flatnonzero(numbers >= m)
    group, kinds_at = cover.asked.places(numbers[groups])
    kinds = cover.asked.items[kinds_at]
    column = np.concatenate([groups[group], roots])  # of each kind's search, then of the core vertices'
    each = np.concatenate([cover.size[kinds], np.ones(len(roots))])
    weight = np.bincount(column, each, k)
    start, first = np.zeros((n, k)), np.zeros((n, k))
    start[numbers[roots] - m, roots] = 1
    of, at = cover.out.places(kinds)
    first[cover.out.items[at], groups[group[of]]] = 1
    paths, level = _levels(cover, start, first)
    total = np.sum(paths, 0)
    ends = _ended(cover, len(paths), level, total, weight, classes)
    # then a kind's or a core vertex's search by itself, without the vertex's paths to itself
    for lo in range(0, len(column), 4 * SOURCES):
        mine = column[lo : lo + 4 * SOURCES]
        some = kinds[lo : lo + len(mine)]
        on = ends[:, mine]
        of, at = cover.into.places(some)
        if len(at):
            hub = cover.into.items[at]
            begin = np.flatnonzero(np.diff(of, prepend=-1))
            spread = lambda x: np.repeat(x, np.diff(np.append(begin, len(of))))  # noqa: B023, E731
            near = level[hub, mine[of]]
            ways = total[hub, mine[of]] * (near == spread(np.minimum.reduceat(near, begin)))
            back = spread(np.maximum(np.add.reduceat(ways, begin), 0.5))
            sources[at] += ways / back
            on[hub, of] -= (ways > 0) / back
        _back(cover, [x[:, mine] for x in paths], on, each[lo : lo + len(mine)], some, nodes, ones, twos, targets)


def _back(cover: Cover, paths: list[np.ndarray], ends: np.ndarray, weight: np.ndarray, kinds: np.ndarray, nodes, ones, twos, targets) -> None:
    """From the last level to the first: what a path to a vertex is worth, the vertex included."""
    worth = [np.zeros(ends.shape)] * 2
    for i in range(len(paths) - 1, -1, -1):
        weighted = paths[i] * weight
        ones += (weighted @ worth[-1].T).ravel()
        twos += (weighted @ worth[-2].T).ravel()
        if i:
            on = ends + cover.one @ worth[-1] + cover.two @ worth[-2]
            nodes += (weighted * on).sum(1)
            here = paths[i] > 0
            worth.append(np.where(here, on + 1 / np.where(here, paths[i], 1), 0))
    column, at = cover.out.places(kinds)
    targets[at] += worth[-1][cover.out.items[at], column]


def _ended(cover: Cover, depth: int, level: np.ndarray, total: np.ndarray, weight: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """What paths from the sources to a core vertex are worth by the fringe vertices that they end at next; adds to classes what
    the edges to one vertex of each class carry.

    A class is reached from its sources of the smallest level. Where there are few levels, a further level makes numbers of
    paths smaller by so many bits that sums and shares are of the smallest one alone, in double precision to the last bit.
    """
    bits = 1000 // depth
    deep = bits < 90 + np.log2(max(total.max(initial=1), 1))
    if deep:
        value, level = total, np.minimum(level, depth).astype(np.int16)
    else:
        value = np.where(total > 0, np.ldexp(total, -bits * np.minimum(level, depth)), 0)
    k, unreached = level.shape[1], (total == 0).any()
    ends = np.zeros(total.shape)
    most = max((len(x.size) for x in cover.blocks), default=0)
    worth, near = np.empty((most, k)), np.empty((most if deep else 0, k), np.int16)
    each, weighted = np.empty((max((len(x.sources) for x in cover.blocks), default=0), ROWS, k)), np.empty((ROWS, k))
    for block in cover.blocks:
        slots, many = block.sources.shape
        several = (block.size > 1).any()
        carried = classes[cover.classes.start[block.first] :][: slots * many].reshape(many, slots)
        for lo in range(0, many, ROWS):
            rows = slice(lo, min(lo + ROWS, many))
            ways, got = worth[rows], each[:, : rows.stop - lo]
            for j, s in enumerate(block.sources):
                value.take(s[rows], 0, got[j], "clip")
            if deep:
                levels = level[block.sources[:, rows]]
                near[rows] = levels.min(0)
                got[:slots] *= levels == near[rows]
            np.add(got[0], got[1], out=ways) if slots > 1 else np.copyto(ways, got[0])
            for j in range(2, slots):
                ways += got[j]
            if unreached:  # a class that isn't reached has no ways, and its sources aren't reached either
                np.maximum(ways, LEAST, out=ways)
            np.divide(1, ways, out=ways)
            shares = np.multiply(ways, weight, out=weighted[: rows.stop - lo])
            for j in range(slots):
                carried[rows, j] += np.einsum("ij,ij->i", got[j], shares)
            if several:
                ways *= block.size[rows, None]
        for h, lo, hi in zip(block.hubs.tolist(), block.begin[:-1].tolist(), block.begin[1:].tolist(), strict=True):
            rows = block.rows[lo:hi]
            got = worth.take(rows, 0)
            if deep:
                got *= near.take(rows, 0) == level[h]
            ends[h] += got.sum(0)
    return np.where(total > 0, ends if deep else np.ldexp(ends, -bits * np.minimum(level, depth)), 0)


def assembled(cover: Cover, core: np.ndarray, rest: np.ndarray, kind: np.ndarray, got: np.ndarray, a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Values of the n vertices and of the edges a -> b from the added-up sums."""
    nodes, ones, twos, classes, sources, targets = np.split(got, cover.cuts())
    m = len(core)
    passed = np.zeros(len(cover.size))
    sources, targets = -sources, targets.copy()
    of, at = cover.into.places(np.arange(len(cover.size)))
    _, at_class = cover.classes.places(cover.of_class[cover.into.lengths > 0])
    sources[at] += classes[at_class]
    for kinds in _few(cover.into, cover.out):
        k, i, j = _pairs(cover.into, cover.out, kinds)
        through = twos[cover.into.items[i] * m + cover.out.items[j]]
        passed += np.bincount(k, through, len(passed))
        sources += np.bincount(i, through, len(sources))
        targets += np.bincount(j, through, len(targets))
    value = np.empty(n)
    value[core], value[rest] = nodes, passed[kind]
    place, outer = np.empty(n, np.int64), np.zeros(n, bool)
    place[core], place[rest], outer[rest] = np.arange(m), kind, True
    flow = np.empty(len(a))
    inner = ~outer[a] & ~outer[b]
    flow[inner] = ones[place[a[inner]] * m + place[b[inner]]]
    for mine, x, y, side, values in ((outer[b], b, a, cover.into, sources), (outer[a], a, b, cover.out, targets)):
        # a kind's items are in order, as kinds are: an edge's place by bisection
        keys = np.repeat(np.arange(len(cover.size)), side.lengths) * max(m, 1) + side.items
        flow[mine] = values[np.searchsorted(keys, place[x[mine]] * max(m, 1) + place[y[mine]])]
    return value, flow
