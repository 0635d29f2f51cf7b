"""The rounds of ``community`` over arrays, for graphs whose links are few enough for the driver.

Results are the same to the last node, since every comparison is made between the same numbers: weights are whole, gains are the
same expressions of doubles, values are rounded alike, and chance is Spark's own hash.
"""

from __future__ import annotations

import numpy as np

_P = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def _turned(x: np.ndarray, n: int) -> np.ndarray:
    return x << np.uint64(n) | x >> np.uint64(64 - n)


def _spread(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(33)) * _P[1]
    h = (h ^ h >> np.uint64(29)) * _P[2]
    return h ^ h >> np.uint64(32)


def xxhash64(ints: tuple[int, ...], longs: np.ndarray) -> np.ndarray:
    """Spark's ``xxhash64`` of integers, then a long."""
    h = np.full(len(longs), 42, np.uint64)
    for i in ints:
        h = _spread(_turned(h + _P[4] + np.uint64(4) ^ np.full(1, i & 0xFFFFFFFF, np.uint64) * _P[0], 23) * _P[1] + _P[2])
    x = longs.astype(np.int64).view(np.uint64)
    h = h + _P[4] + np.uint64(8) ^ _turned(x * _P[1], 31) * _P[0]
    return _spread(_turned(h, 27) * _P[0] + _P[3]).view(np.int64)


def summed(ends: np.ndarray, far: np.ndarray, weight: np.ndarray | None, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(end, far, sum of weights) of each pair, in order; all weights are 1 where there are none. ``far`` is below ``width``."""
    key = ends.astype(np.int64) * width + far
    if not len(key):
        return key, key, np.zeros(0)
    order = None
    if weight is None:
        key.sort()
    else:
        order = np.argsort(key)
        key = key[order]
    begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    into = np.diff(np.append(begin, len(key))).astype(float) if order is None else np.add.reduceat(weight[order], begin)
    key = key[begin]
    return key // width, key % width, into


def _largest(node: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The rows of largest value of each node; rows lie by node."""
    begin = np.append(True, node[1:] != node[:-1])
    return np.flatnonzero(value == np.maximum.reduceat(value, np.flatnonzero(begin))[np.cumsum(begin) - 1])


def choices(ends, far, weight, at, label, total, k, m, resolution: float, seed: int, turn: int, same: float, receives=None):  # noqa: ANN001, ANN201
    """(nodes that move, where to, the weight of each node's links into its own community, number of nodes that would gain elsewhere,
    or of those that move).

    ``ends`` are places of nodes in ``at``, ``k`` and ``m``; ``far``, the communities at the other ends, and ``at``, the nodes' own, are
    places in ``label`` and ``total``. Links have weight 1 where ``weight`` is None. Only links of nodes that may move to communities that
    receive are summed; the others only where no node moves, to tell whether any would.
    """
    n = len(at)
    if receives is None:
        receives = xxhash64((seed, turn // 2), label) % 2 == turn % 2
    own = far == at[ends]
    here_into = np.bincount(ends[own], None if weight is None else weight[own], n).astype(float)
    here = here_into - resolution * (total[at] - k) * k / (2 * m)

    def better(links: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        node, to, into = summed(ends[links], far[links], None if weight is None else weight[links], len(total))
        gain = into - resolution * (total[to] - 0.0) * k[node] / (2 * m[node])
        more = gain > here[node] + same
        return node[more], to[more], gain[more]

    node, to, gain = better(np.flatnonzero((~receives[at])[ends] & receives[far]))
    if not len(node):
        return node, to, here_into, len(np.unique(better(np.flatnonzero(~own))[0]))
    for value in (lambda: gain, lambda: xxhash64((turn,), label[to]), lambda: label[to]):
        best = _largest(node, value())
        node, to, gain = node[best], to[best], gain[best]
    return node, to, here_into, len(node)


def worth(into, loop, total, k, m, resolution: float) -> np.ndarray:  # noqa: ANN001
    """What each node adds to the value of a state."""
    return (into / 2 + loop) / m - resolution * k * total / (4 * m * m)


def moved(ids, m, c, a, b, w, resolution: float, seed: int, rounds: int, patience: int, least: float, same: float):  # noqa: ANN001, ANN201
    """(communities of ``ids`` after local moves from ``c``, value); links join places ``a`` and ``b`` of ids with weights w."""
    n, apart = len(ids), a != b
    k, loop = np.bincount(a, w, n) + np.bincount(b, w, n), np.bincount(a[~apart], w[~apart], n)
    ends, far, weight = np.concatenate([a[apart], b[apart]]), np.concatenate([b[apart], a[apart]]), np.concatenate([w[apart]] * 2)
    best, most, before, faded = c, -np.inf, None, 0
    for turn in range(rounds):
        label, at = np.unique(c, return_inverse=True)
        total = np.bincount(at, k)
        go, to, into, wants = choices(ends, at[far], weight, at, label, total, k, m, resolution, seed, turn, same)
        value = round(float(worth(into, loop, total[at], k, m, resolution).sum()), 12)
        if value > most:
            best, most = c, value
        if before is not None:
            faded = faded + 1 if value - before < least else 0
        if not wants or faded >= patience:
            break
        before = value if len(go) else None
        c = c.copy()
        c[go] = label[to]
    return best, most


def partition(ids, m, a, b, w, resolution: float, seed: int, passes: int, pass_gain: float, rounds: int, patience: int, least: float, same: float) -> np.ndarray:  # noqa: ANN001
    """``community.partition`` of the nodes ``ids``, in order, all of which have links."""
    rules = (resolution, seed, rounds, patience, least, same)
    place, value = ids, -np.inf
    for _ in range(passes):
        place, now = moved(ids, m, place, a, b, w, *rules)
        while True:
            label, at = np.unique(place, return_inverse=True)
            key, row = np.unique(np.minimum(at[a], at[b]) * len(label) + np.maximum(at[a], at[b]), return_inverse=True)
            most = np.zeros(len(label))
            np.maximum.at(most, at, m)
            step, found = moved(label, most, label, key // len(label), key % len(label), np.bincount(row, w), *rules)
            if found <= now + same:
                break
            fades, now, place = found - now < least, found, step[at]
            if fades:
                break
        if now - value < pass_gain:
            break
        value = now
    inside = place[a] == place[b]
    near, far, root = a[inside], b[inside], np.arange(len(ids))
    while len(near):
        low, new = np.minimum(root[near], root[far]), root.copy()
        np.minimum.at(new, near, low)
        np.minimum.at(new, far, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return ids[root]
