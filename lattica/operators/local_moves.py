"""Moves and refinement of ``communities`` as arrays, for groups of nodes that fit a task.

Nodes are numbers in the order of their ids; links (a, b, w) go both ways and hold no loops; k is a node's strength.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

_P1, _P2, _P3, _P5, _ALL = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, (1 << 64) - 1
EPS = 1e-12


def mixed(h: np.ndarray, r: int) -> np.ndarray:
    """Spark's ``xxhash64(x, r)`` from ``xxhash64(x)``, r being an int."""
    p2, p3 = np.uint64(_P2), np.uint64(_P3)
    x = h.astype("i8").view("u8") + np.uint64(_P5 + 4) ^ np.uint64((r & 0xFFFFFFFF) * _P1 & _ALL)
    x = (x << np.uint64(23) | x >> np.uint64(41)) * p2 + p3
    x = (x ^ x >> np.uint64(33)) * p2
    x = (x ^ x >> np.uint64(29)) * p3
    return (x ^ x >> np.uint64(32)).view("i8")


def _firsts(x: np.ndarray) -> np.ndarray:
    """Where a sorted array's runs begin."""
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.arange(0)


def least(c: np.ndarray) -> np.ndarray:
    """Communities named by their smallest node."""
    _, first, at = np.unique(c, return_index=True, return_inverse=True)
    return first[at]


def _best(node, to, inside, k, tot, own, total: float, resolution: float) -> tuple[np.ndarray, np.ndarray]:
    """The gains of nodes (sorted) in communities, and where in these each node's best is; of equals its own, then the smallest."""
    gain = np.round(inside - resolution * k * (tot - np.where(own, k, 0)) / total, 9)
    order = np.lexsort((to, ~own, -gain, node))
    return gain, order[_firsts(node[order])]


def best_moves(total: float, resolution: float):
    """The function for mapInArrow over (a, community, tot, weight, k, h): to each node a of a task the communities that its links lead to, and its own
    with its strength k and hash h, which are null and 0 otherwise. (id, community, k, h, to, gain, own_gain, inside, tot) of each node."""

    def run(batches):
        columns = [[] for _ in range(6)]
        for batch in batches:
            for kept, c in zip(columns, batch.columns):
                kept.append(c.to_numpy(zero_copy_only=False))
        if not columns[0]:
            return
        a, c, tot, w, k, h = map(np.concatenate, columns)
        mine = np.flatnonzero(~np.isnan(k))
        mine = mine[np.argsort(a[mine])]
        ids, width = a[mine], int(c.max()) + 1
        key, first, at = np.unique(np.searchsorted(ids, a) * width + c, return_index=True, return_inverse=True)
        node, to, inside, tot = key // width, key % width, np.bincount(at, w, len(key)), tot[first]
        own = to == c[mine][node]
        gain, first = _best(node, to, inside, k[mine][node], tot, own, total, resolution)
        for s in range(0, len(ids), 1 << 16):
            part = slice(s, s + (1 << 16))
            found = [x[part] for x in (ids, c[mine], k[mine], h[mine], to[first], gain[first], gain[own], inside[own], tot[own])]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["id", "community", "k", "h", "to", "gain", "own_gain", "inside", "tot"])

    return run


def moved(a, b, w, k, group, h, c, total: float, rounds: int = 200, resolution: float = 1.0, tolerance: float = 1e-4, finest: int = 16) -> np.ndarray:
    """The community of each node: the rounds of ``communities.partition`` from ``c`` on, in each group by itself: its own parts, and its share
    of ``tolerance``."""
    n, count = len(k), int(group.max(initial=0)) + 1
    whole = np.bincount(group, k, count)
    live, parts, best = whole > 0, np.full(count, 2), np.full(count, -np.inf)
    kept, target, able = c.copy(), c.copy(), np.zeros(n, bool)
    for r in range(rounds):
        if not live.any():
            return kept
        nodes, own_links = np.flatnonzero(live[group]), live[group[a]]
        a, b, w = a[own_links], b[own_links], w[own_links]
        key, at = np.unique(np.concatenate([a * n + c[b], nodes * n + c[nodes]]), return_inverse=True)
        inside = np.bincount(at, np.concatenate([w, np.zeros(len(nodes))]))
        node, to, tot = key // n, key % n, np.bincount(c, k, n)
        own = to == c[node]
        gain, first = _best(node, to, inside, k[node], tot[to], own, total, resolution)
        sums = lambda x: np.bincount(group[nodes], x, count)
        quality = sums(inside[own]) / total - resolution * sums(k[nodes] * tot[c[nodes]]) / total**2
        quality = np.divide(quality * total, whole, out=np.zeros(count), where=whole > 0)
        parts[live & (quality < best + tolerance)] *= 2
        better = live & ~(quality < best)
        best[better] = quality[better]
        take = better[group[nodes]]
        kept[nodes[take]], target[nodes[take]], able[nodes[take]] = c[nodes][take], to[first][take], (gain[first] > gain[own] + 1e-9)[take]
        live &= (parts <= finest) & (np.bincount(group[able], minlength=count) > 0)
        move = able & (mixed(h, r) % parts[group] == 0)
        move |= able & (np.bincount(group[move], minlength=count) == 0)[group]  # where none would move, all that gain do
        c = np.where(live[group] & move, target, kept)
    raise RuntimeError(f"the moves haven't settled in {rounds} rounds")


def refined(a, b, w, k, c, h, total: float, rounds: int = 400, resolution: float = 1.0) -> np.ndarray:
    """The part of each node: the rounds of ``communities.refinement`` in communities ``c``."""
    n = len(k)
    inner = c[a] == c[b]
    a, b, w, whole, part = a[inner], b[inner], w[inner], np.bincount(c, k, n)[c], np.arange(n)
    for r in range(rounds):
        key, at = np.unique(a * n + part[b], return_inverse=True)
        x, into, v = key // n, key % n, np.bincount(at, w, len(key))
        out = part[x] != into
        x, into, v = x[out], into[out], v[out]
        tot, size, ext = np.bincount(part, k, n), np.bincount(part, minlength=n), np.bincount(part[x], v, n)
        tight = ~(ext + EPS < resolution * tot * (whole - tot) / total)
        gain = v - resolution * k[x] * tot[into] / total
        able = (size[part[x]] == 1) & tight[part[x]] & tight[into] & (gain >= -EPS)
        x, into, v, gain = x[able], into[able], v[able], gain[able]
        if not len(x):
            return part
        order = np.lexsort((into, -np.round(gain, 9), x))
        order = order[_firsts(x[order])]
        x, into, v, gain = x[order], into[order], v[order], gain[order]
        side, chosen = mixed(h, r) % 2, np.zeros(n, bool)
        asked = (side[x] == 0) & ((size[into] > 1) | (side[into] == 1))
        chosen[into[asked]] = True
        asked |= (side[x] == 1) & (size[into] > 1) & ~chosen[x]
        order = np.flatnonzero(asked)
        order = order[np.lexsort((x[order], -gain[order], into[order]))]
        x, into, v, gain = x[order], into[order], v[order], gain[order]
        place, goes = np.full(n, -1), np.full(n, -1)
        place[x], goes[x] = np.arange(len(x)), into
        both = (place[b] >= 0) & (place[b] < place[a]) & (goes[a] == goes[b])
        among = np.bincount(place[a[both]], w[both], len(x))
        upto = lambda values: pd.Series(values).groupby(into).cumsum().to_numpy()
        d = ext[x] - 2 * v - 2 * among
        joined = upto(k[x]) - k[x]
        t, e = tot[into] + joined, ext[into] + upto(d) - d
        good = ~(e + EPS < resolution * t * (whole[x] - t) / total) & (gain + among - resolution * k[x] * joined / total >= -EPS)
        taken = upto((~good).astype(int)) == 0
        part[x[taken]] = into[taken]
    raise RuntimeError(f"the refinement hasn't settled in {rounds} rounds")


def leiden(a, b, w, group, h, c, total: float, levels: int = 64, resolution: float = 1.0, **moves) -> np.ndarray:
    """The community of each node, named by its smallest: levels of moves and refinement, in each group until one of its levels joins nothing.
    ``a``, ``b``, ``w``: each pair once, loops too."""
    nodes, at, ids, answer = np.arange(len(group)), np.arange(len(group)), np.arange(len(group)), np.arange(len(group))
    for _ in range(levels):
        if not len(nodes):
            return least(answer)
        k = np.bincount(np.concatenate([a, b]), np.concatenate([w, w]), len(ids))
        apart = a != b
        both = np.concatenate([a[apart], b[apart]]), np.concatenate([b[apart], a[apart]]), np.concatenate([w[apart], w[apart]])
        c = least(moved(*both, k, group, h[ids], c, total, resolution=resolution, **moves))
        part = least(refined(*both, k, c, h[ids], total, resolution=resolution))
        heads = part == np.arange(len(ids))
        done = (np.bincount(group) == np.bincount(group[heads], minlength=group.max() + 1))[group]
        answer[nodes] = ids[c[at]]
        on, heads = ~done[at], np.flatnonzero(heads & ~done)
        number = np.full(len(ids), -1)
        number[heads] = np.arange(len(heads))
        links = ~done[a]
        pa_, pb = number[part[a[links]]], number[part[b[links]]]
        key, of = np.unique(np.minimum(pa_, pb) * len(heads) + np.maximum(pa_, pb), return_inverse=True)
        w = np.bincount(of, w[links], len(key))
        a, b = (key // len(heads), key % len(heads)) if len(heads) else (key, key)
        nodes, at = nodes[on], number[part[at[on]]]
        ids, group, c = ids[heads], group[heads], number[c[heads]]
    raise RuntimeError(f"more than {levels} levels")


def in_tasks(total: float, **settings):
    """The function for cogrouped applyInArrow: links (a, b, weight) and nodes (id, grp, h, start) to (id, community)."""

    def run(links: pa.Table, nodes: pa.Table) -> pa.Table:
        nodes = nodes.sort_by("id")
        ids = nodes["id"].combine_chunks()
        number = lambda c: pc.index_in(links[c], value_set=ids).to_numpy().astype("i8")
        coded = lambda values: np.unique(values.to_numpy(zero_copy_only=False), return_inverse=True)[1]
        group, start = coded(nodes["grp"].combine_chunks()), coded(nodes["start"].combine_chunks())
        start = np.unique(group * (len(ids) + 1) + start, return_inverse=True)[1]  # a community of several groups is one in each
        found = leiden(number("a"), number("b"), links["weight"].to_numpy(), group, nodes["h"].to_numpy(), start, total, **settings)
        return pa.table({"id": ids, "community": ids.take(pa.array(found))})

    return run
