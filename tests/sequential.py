"""Sequential Louvain and Leiden on small graphs, to measure the parallel form against."""

from __future__ import annotations

import pandas as pd


def sequential_communities(edges: pd.DataFrame, resolution: float = 1.0, refine: bool = False) -> dict[int, int]:
    """Sequential Louvain (or Leiden, with ``refine``) over symmetric edges: node -> community, named by its least node."""
    near: dict[int, dict[int, float]] = {}
    for a, b, w in edges[["src", "dst", "weight"]].itertuples(index=False):
        near.setdefault(a, {})[b] = near.get(a, {}).get(b, 0.0) + w
    total = sum(sum(x.values()) for x in near.values())
    part = {v: v for v in near}
    start = {v: v for v in near}
    while True:
        moved = _settle(near, start, total, resolution)
        whole = {v: moved[part[v]] for v in part}
        split = _settle(near, {v: v for v in near}, total, resolution, moved) if refine else moved
        if len(set(split.values())) == len(near):
            break
        up: dict[int, dict[int, float]] = {}
        for a, x in near.items():
            row = up.setdefault(split[a], {})
            for b, w in x.items():
                row[split[b]] = row.get(split[b], 0.0) + w
        outer: dict[int, int] = {}
        for v in sorted(near):
            outer.setdefault(moved[v], split[v])
        start = {split[v]: outer[moved[v]] for v in near}
        part = {v: split[part[v]] for v in part}
        near = up
    least: dict[int, int] = {}
    for v in sorted(whole):
        least.setdefault(whole[v], v)
    return {v: least[c] for v, c in whole.items()}


def _settle(near: dict[int, dict[int, float]], label: dict[int, int], total: float, resolution: float, within: dict[int, int] | None = None) -> dict[int, int]:
    """Single nodes move to the neighbouring community of greatest gain until none gains."""
    label = dict(label)
    degree = {v: sum(x.values()) for v, x in near.items()}
    volume: dict[int, float] = {}
    for v, c in label.items():
        volume[c] = volume.get(c, 0.0) + degree[v]
    order, changed = sorted(near), True
    while changed:
        changed = False
        for v in order:
            links: dict[int, float] = {}
            for u, w in near[v].items():
                if u != v and (within is None or within[u] == within[v]):
                    links[label[u]] = links.get(label[u], 0.0) + w
            own, k = label[v], degree[v]
            volume[own] -= k
            best, value = own, links.get(own, 0.0) - resolution * k * volume[own] / total
            for c in sorted(links):
                gain = links[c] - resolution * k * volume.get(c, 0.0) / total
                if gain > value + 1e-12:
                    best, value = c, gain
            volume[best] = volume.get(best, 0.0) + k
            if best != own:
                label[v], changed = best, True
    return label


def leaf_clusters(x, min_size: int, k: int) -> tuple[list[int], list[float]]:
    """Labels and strengths of the leaves of the condensed tree over the mutual-reachability graph of each point's k nearest, top down."""
    import numpy as np

    n = len(x)
    d = np.round(np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(axis=2), 0)), 9)
    near = [sorted((j for j in range(n) if j != i), key=lambda j: (d[i, j], j))[:k] for i in range(n)]
    core = [max(d[i, j] for j in near[i][:min_size]) for i in range(n)]
    links: dict[tuple[int, int], float] = {}
    for i in range(n):
        for j in near[i]:
            links[min(i, j), max(i, j)] = max(d[i, j], core[i], core[j])
    # the whole tree of merges, from the least edge on
    top, parent, tree = list(range(n)), {i: i for i in range(n)}, {}
    size = dict.fromkeys(range(n), 1)

    def find(v: int) -> int:
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    for number, ((a, b), w) in enumerate(sorted(links.items(), key=lambda y: (y[1], y[0])), n):
        a, b = find(a), find(b)
        if a != b:
            tree[number] = (a, b, w)
            parent[number] = number
            size[number] = size[a] + size[b]
            parent[a] = parent[b] = number
    del top

    def points(v: int) -> list[int]:
        out, stack = [], [v]
        while stack:
            u = stack.pop()
            if u in tree:
                stack += tree[u][:2]
            else:
                out.append(u)
        return out

    leaves: list[dict[int, float]] = []
    stack = [v for v in {find(i) for i in range(n)} if size[v] >= min_size]
    while stack:
        v, fallen = stack.pop(), {}
        while True:
            if v not in tree:
                break
            a, b, w = tree[v]
            great = [u for u in (a, b) if size[u] >= min_size]
            if len(great) == 2:
                stack += great
                fallen = None
                break
            fallen.update({p: w for u in (a, b) if u not in great for p in points(u)})
            if not great:
                break
            v = great[0]
        if fallen:
            leaves.append(fallen)
    label, strength = [-1] * n, [0.0] * n
    if len(leaves) > 1:
        for i, leaf in enumerate(sorted(leaves, key=min)):
            for p, w in leaf.items():
                label[p], strength[p] = i, 1.0 if w == 0 else min(leaf.values()) / w
    return label, strength
