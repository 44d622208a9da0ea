"""Layered layout of one connected component, in plain Python.

Cycles are broken greedily (Eades, Lin and Smyth 1993), ranks start as longest paths
and are tightened towards short edges, long edges get a point in each rank they
cross, orders come from barycentre sweeps that keep the fewest crossings, and
coordinates from median sweeps under the separations. Everything is deterministic.
"""

from __future__ import annotations

import math
from collections import defaultdict
from heapq import heapify, heappop, heappush

from weftwork.model import CanvasOptions


def acyclic(order: list[str], edges: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The edges with those reversed that run against a greedy order of sinks and sources."""
    out, into = {v: set() for v in order}, {v: set() for v in order}
    for a, b in edges:
        out[a].add(b)
        into[b].add(a)
    at = {v: i for i, v in enumerate(order)}
    head, tail, gone = [], [], set()
    # heaps of places in the order; an entry that no longer holds is passed over
    sinks = [i for i, v in enumerate(order) if not out[v]]
    sources = [i for i, v in enumerate(order) if not into[v]]
    lead = [(len(into[v]) - len(out[v]), i) for i, v in enumerate(order)]
    heapify(lead)

    def take(v, place):
        place.append(v)
        gone.add(v)
        for near, back, free in ((out[v], into, sources), (into[v], out, sinks)):
            for w in near:
                back[w].discard(v)
                if w not in gone:
                    if not back[w]:
                        heappush(free, at[w])
                    heappush(lead, (len(into[w]) - len(out[w]), at[w]))

    while len(gone) < len(order):
        while sinks or sources:
            free, place = (sinks, tail) if sinks else (sources, head)
            if (v := order[heappop(free)]) not in gone:
                take(v, place)
        while lead:
            weight, i = heappop(lead)
            v = order[i]
            if v not in gone and weight == len(into[v]) - len(out[v]):
                take(v, head)
                break
    place = {v: i for i, v in enumerate(head + tail[::-1])}
    return list(dict.fromkeys((a, b) if place[a] < place[b] else (b, a) for a, b in edges))


def walked(order: list[str], edges: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The edges with those reversed that lead back to a node that a depth-first walk has not left."""
    out = defaultdict(list)
    for a, b in edges:
        out[a].append(b)
    state: dict[str, int] = {}  # 1 entered, 2 left
    back = set()
    for start in order:
        if start in state:
            continue
        state[start], trail = 1, [(start, iter(out[start]))]
        while trail:
            v, rest = trail[-1]
            for w in rest:
                if state.get(w) == 1:
                    back.add((v, w))
                elif w not in state:
                    state[w] = 1
                    trail.append((w, iter(out[w])))
                    break
            else:
                state[v] = 2
                trail.pop()
    return list(dict.fromkeys((b, a) if (a, b) in back else (a, b) for a, b in edges))


def ranks(order: list[str], edges: list[tuple[str, str]], tighten: bool = True) -> dict[str, int]:
    """Ranks with every edge going at least one rank on, from 0."""
    after, before = defaultdict(list), defaultdict(list)
    for a, b in edges:
        after[a].append(b)
        before[b].append(a)
    waiting = {v: len(before[v]) for v in order}
    ready, topological = [v for v in order if not waiting[v]], []
    rank = dict.fromkeys(order, 0)
    while ready:
        v = ready.pop(0)
        topological.append(v)
        for w in after[v]:
            rank[w] = max(rank[w], rank[v] + 1)
            waiting[w] -= 1
            if not waiting[w]:
                ready.append(w)
    for _ in range(10 if tighten else 0):
        moved = False
        for v in reversed(topological):
            pull = len(after[v]) - len(before[v])
            if pull > 0:
                goal = min(rank[w] for w in after[v]) - 1
            elif pull < 0:
                goal = max(rank[w] for w in before[v]) + 1
            else:
                continue
            if goal != rank[v]:
                rank[v], moved = goal, True
        if not moved:
            break
    low = min(rank.values())
    return {v: r - low for v, r in rank.items()}


def _crossings(upper: list, lower: list, links: dict) -> int:
    place = {v: i for i, v in enumerate(lower)}
    ends = [place[w] for v in upper for w in sorted(links.get(v, ()), key=place.__getitem__)]
    tree, total = [0] * (len(lower) + 1), 0
    for n, e in enumerate(ends):
        seen, i = 0, e + 1
        while i:
            seen += tree[i]
            i &= i - 1
        total += n - seen
        i = e + 1
        while i < len(tree):
            tree[i] += 1
            i += i & -i
    return total


def _spread(goals: list[float], gaps: list[float]) -> list[float]:
    """Positions nearest to the goals in order, neighbours at least the gaps apart (least squares by pooling)."""
    shift, total = [], 0.0
    for i, g in enumerate(goals):
        total += gaps[i - 1] if i else 0.0
        shift.append(g - total)
    blocks: list[list[float]] = []
    for value in shift:
        blocks.append([value, 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1]])
    flat = [value for value, n in blocks for _ in range(int(n))]
    out, total = [], 0.0
    for i, value in enumerate(flat):
        total += gaps[i - 1] if i else 0.0
        out.append(value + total)
    return out


def layered(nodes: list[tuple[str, int, int]], edges: list[tuple[str, str]], options: CanvasOptions) -> tuple[dict[str, tuple[int, int]], int, int]:
    """(corner of each node, width, height) of a component; nodes are (id, width, height) in order."""
    order = [n[0] for n in nodes]
    across = options.rankdir in ("LR", "RL")
    depth = {i: (w if across else h) for i, w, h in nodes}
    span = {i: (h if across else w) for i, w, h in nodes}
    edges = (acyclic if options.acyclicer == "greedy" else walked)(order, [(a, b) for a, b in dict.fromkeys(edges) if a != b])
    rank = ranks(order, edges, options.ranker != "longest-path")
    layers: list[list] = [[] for _ in range(max(rank.values()) + 1)]
    for v in order:
        layers[rank[v]].append(v)
    down, up = defaultdict(list), defaultdict(list)
    for a, b in edges:
        chain = [a, *((a, b, r) for r in range(rank[a] + 1, rank[b])), b]
        for r, v in enumerate(chain[1:-1], rank[a] + 1):
            layers[r].append(v)
            span[v] = 0
        for v, w in zip(chain, chain[1:], strict=False):
            down[v].append(w)
            up[w].append(v)
    best, fewest, stale = [list(x) for x in layers], math.inf, 0
    for sweep in range(8):
        pairs = range(1, len(layers)) if sweep % 2 == 0 else range(len(layers) - 2, -1, -1)
        for r in pairs:
            fixed = layers[r - 1] if sweep % 2 == 0 else layers[r + 1]
            links = up if sweep % 2 == 0 else down
            place = {v: i for i, v in enumerate(fixed)}
            old = {v: i for i, v in enumerate(layers[r])}
            weight = {v: sum(place[w] for w in links[v]) / len(links[v]) if links.get(v) else old[v] for v in layers[r]}
            layers[r].sort(key=lambda v: (weight[v], old[v]))
        n = sum(_crossings(a, b, down) for a, b in zip(layers, layers[1:], strict=False))
        stale = 0 if n < fewest else stale + 1
        if n < fewest:
            best, fewest = [list(x) for x in layers], n
        if not n or stale == 3:
            break
    layers = best
    gaps = {
        r: [(span[a] + span[b]) / 2 + (options.nodesep if isinstance(a, str) and isinstance(b, str) else options.edgesep) for a, b in zip(x, x[1:], strict=False)]
        for r, x in enumerate(layers)
    }
    middle: dict = {}
    for r, layer in enumerate(layers):
        at = 0.0
        for i, v in enumerate(layer):
            at += gaps[r][i - 1] if i else span[v] / 2
            middle[v] = at
    side = options.align[1:2].upper()
    forward = [k % 2 == 0 for k in range(6)] if options.align[:1].upper() == "D" else [k % 2 == 1 for k in range(6)]  # the last sweep decides
    for onwards in forward:
        for r in range(len(layers)) if onwards else range(len(layers) - 1, -1, -1):
            links = up if onwards else down

            def goal(v, links=links):
                near = sorted(middle[w] for w in links.get(v, ()))
                if not near:
                    return middle[v]
                low, high = near[(len(near) - 1) // 2], near[len(near) // 2]
                return {"L": low, "R": high}.get(side, (low + high) / 2)

            middle.update(zip(layers[r], _spread([goal(v) for v in layers[r]], gaps[r]), strict=True))
    low = min(middle[v] - span[v] / 2 for v in middle)
    offset, start = {}, 0.0
    for r, layer in enumerate(layers):
        deepest = max((depth[v] for v in layer if isinstance(v, str)), default=0)
        offset[r] = start + deepest / 2
        start += deepest + options.ranksep
    total = start - options.ranksep
    corners = {}
    for v, w, h in nodes:
        main = offset[rank[v]] if options.rankdir in ("LR", "TB") else total - offset[rank[v]]
        x, y = (main, middle[v] - low) if across else (middle[v] - low, main)
        corners[v] = (math.floor(x - w / 2 + 0.5), math.floor(y - h / 2 + 0.5))
    width = max(corners[v][0] + w for v, w, _ in nodes)
    height = max(corners[v][1] + h for v, _, h in nodes)
    return corners, math.ceil(width), math.ceil(height)
