"""Sequential communities in plain Python, which the distributed ones are held against."""

import random
from collections import defaultdict


def _moved(weights, degree, own, label, total, order, within=None):
    """Moves nodes to the neighbouring community of the largest gain until none moves; within: only inside the same group."""
    volume = defaultdict(float)
    for v, c in label.items():
        volume[c] += degree[v]
    queue, waiting = list(order), set(order)
    while queue:
        v = queue.pop(0)
        waiting.discard(v)
        links = defaultdict(float)
        for u, w in weights[v].items():
            if u != v and (within is None or within[u] == within[v]):
                links[label[u]] += w
        old = label[v]
        volume[old] -= degree[v]
        best, value = old, links.get(old, 0.0) - degree[v] * volume[old] / total
        for c in sorted(links):
            x = links[c] - degree[v] * volume[c] / total
            if x > value + 1e-12:
                best, value = c, x
        label[v] = best
        volume[best] += degree[v]
        if best != old:
            for u in weights[v]:
                if label[u] != best and u not in waiting:
                    waiting.add(u)
                    queue.append(u)


def quality(weights, label) -> float:
    total = sum(sum(x.values()) for x in weights.values())
    inside, volume = defaultdict(float), defaultdict(float)
    for v, near in weights.items():
        for u, w in near.items():
            volume[label[v]] += w
            if label[u] == label[v]:
                inside[label[v]] += w
    return sum(inside[c] / total - (volume[c] / total) ** 2 for c in volume) if total else 0.0


def partition(weights, seed: int, rounds: int, gain: float) -> dict[int, int]:
    rng, nodes = random.Random(seed), sorted(weights)
    member = {v: v for v in nodes}
    last = -1.0
    for _ in range(rounds):
        graph = {v: dict(x) for v, x in weights.items()}
        top = {v: v for v in nodes}
        start = dict(member)
        while True:  # one pass over the levels
            degree = {v: sum(x.values()) for v, x in graph.items()}
            total = sum(degree.values())
            order = sorted(graph)
            rng.shuffle(order)
            label = start if start is not None else {v: v for v in graph}
            _moved(graph, degree, None, label, total, order)
            fine = {v: v for v in graph}
            _moved(graph, degree, None, fine, total, order, within=label)
            new = {v: fine[top[v]] for v in nodes}
            if len(set(fine.values())) == len(graph):
                member = {v: label[top[v]] for v in nodes}
                break
            merged: dict[int, dict[int, float]] = defaultdict(lambda: defaultdict(float))
            for v, near in graph.items():
                for u, w in near.items():
                    merged[fine[v]][fine[u]] += w
            start = {fine[v]: label[v] for v in graph}
            names = {}
            for v in sorted(start):
                names.setdefault(start[v], v)
            start = {v: names[c] for v, c in start.items()}
            graph, top = {v: dict(x) for v, x in merged.items()}, new
        now = quality(weights, member)
        if now - last < gain:
            break
        last = now
    least = {}
    for v in nodes:
        least.setdefault(member[v], v)
    return {v: least[member[v]] for v in nodes}
