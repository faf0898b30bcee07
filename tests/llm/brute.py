"""Plain versions of the corpus operators, one row at a time, to hold the real ones against."""

from __future__ import annotations

import math
from collections import defaultdict


def union(n: int, pairs) -> list[int]:
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").split()


def shingles(text: str | None, k: int) -> frozenset:
    w = (text or "").encode("utf-8").lower().split()
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < k else [tuple(w[i : i + k]) for i in range(len(w) - k + 1)])


def near_documents(rows: list[tuple[int, str | None]], k: int, percent: int = 80) -> dict[int, tuple[int, int]]:
    """doc_id -> (set size, component)."""
    rows = sorted(rows, key=lambda r: r[0])
    sets = [shingles(t, k) for _, t in rows]
    holders = defaultdict(list)
    pairs = set()
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    for own in holders.values():
        pairs.update((a, b) for n, a in enumerate(own) for b in own[n + 1 :])
    links = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    comp = union(len(rows), links)
    return {rows[i][0]: (len(sets[i]), rows[comp[i]][0]) for i in range(len(rows))}


def near_vectors(rows: list[tuple[int, list | None]], threshold: float = 0.9) -> dict[int, tuple[int, int]]:
    """vec_id -> (links, component)."""
    rows = sorted(rows, key=lambda r: r[0])

    def unit(v):
        if not v or any(x is None or not math.isfinite(x) for x in v):
            return None
        n = math.sqrt(sum(x * x for x in v))
        return [x / n for x in v] if n else None

    units = [unit(v) for _, v in rows]
    links = [
        (a, b)
        for a in range(len(rows))
        for b in range(a + 1, len(rows))
        if units[a] and units[b] and len(units[a]) == len(units[b]) and sum(x * y for x, y in zip(units[a], units[b], strict=True)) >= threshold
    ]
    comp, n = union(len(rows), links), [0] * len(rows)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return {rows[i][0]: (n[i], rows[comp[i]][0]) for i in range(len(rows))}


def repeats(rows: list[tuple[int, str | None]], least: int) -> dict[int, str]:
    """doc_id -> spans of words that earlier documents have."""
    first, out = {}, {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        w, spans = words(text), []
        for p in range(len(w) - least + 1):
            if first.setdefault(tuple(w[p : p + least]), doc) < doc:
                if spans and p <= spans[-1][1]:
                    spans[-1][1] = p + least
                else:
                    spans.append([p, p + least])
        out[doc] = ",".join(f"{s}-{e}" for s, e in spans)
    return out


def water_fill(sizes: dict[str | None, int], epochs: int = 3) -> dict[str | None, float]:
    """Targets by clamping and resharing until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, open_ = {}, set(order)
    while True:
        left = sum(sizes.values()) - sum(epochs * sizes[s] for s in order if s not in open_)
        share = sum(weight[s] for s in open_)
        target = {s: left * weight[s] / share if s in open_ else float(epochs * sizes[s]) for s in order}
        above = {s for s in open_ if target[s] > epochs * sizes[s] * (1 + 1e-12)}
        if not above:
            return target
        open_ -= above
