"""Plain Python statements of what the operators must return, for small inputs."""

from __future__ import annotations

import math
from itertools import combinations


def document_graph(tokens):
    pairs = list(zip(tokens, tokens[1:]))
    kept = pairs[1:] if pairs and pairs[0][0] == pairs[0][1] else pairs
    return (set(tokens) if pairs else set()), set(kept)


def ranked(graphs, support):
    needed = math.ceil(float(len(graphs)) * support)
    df = {}
    for vertices, _ in graphs:
        for v in vertices:
            df[v] = df.get(v, 0) + 1
    frequent = sorted((v for v in df if df[v] >= needed), key=lambda v: (-df[v], v))
    return {v: i for i, v in enumerate(frequent)}, df, needed


def is_listed(edges, rank):
    """Does the declarative class hold this edge set? Edges are token pairs."""
    if len(edges) == 1:
        return True
    if any(a == b for a, b in edges):
        return False
    out = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
    root = min(out, key=rank.get)
    seen, children, back = {root}, {}, []

    def visit(v, ancestors):
        for b in sorted(out.get(v, []), key=rank.get):
            if b in seen:
                if b not in ancestors[:-2]:
                    return False
                back.append((v, b))
            else:
                seen.add(b)
                children.setdefault(v, []).append(b)
                if not visit(b, ancestors + [b]):
                    return False
        return True

    if not visit(root, [root]) or seen != {v for e in edges for v in e}:
        return False
    return all(rank[min(children[w], key=rank.get)] <= rank[u] for u, w in back)


def frequent_patterns(texts, support, max_edges):
    """``{frozenset of token edges: support}`` for one topic."""
    graphs = [document_graph(t.split()) for t in texts]
    if len(graphs) == 1:
        return {}
    rank, _, needed = ranked(graphs, support)
    all_edges = {e for _, edges in graphs for e in edges if e[0] in rank and e[1] in rank}

    def count(edges):
        return sum(1 for _, own in graphs if edges <= own)

    usable = sorted(e for e in all_edges if count({e}) >= needed)
    found = {}
    for k in range(1, max_edges + 1):
        for edges in map(frozenset, combinations(usable, k)):
            n = count(edges)
            if n >= needed and is_listed(edges, rank):
                found[edges] = n
    return found


def connected_patterns(texts, support, max_edges):
    """The same for all weakly connected sets of edges; a loop is one by itself only."""
    graphs = [document_graph(t.split()) for t in texts]
    if len(graphs) == 1:
        return {}
    needed = math.ceil(float(len(graphs)) * support)

    def count(edges):
        return sum(1 for _, own in graphs if edges <= own)

    usable = sorted(e for e in {e for _, edges in graphs for e in edges} if count({e}) >= needed)
    found = {}
    for k in range(1, max_edges + 1):
        for edges in map(frozenset, combinations(usable, k)):
            if k > 1 and any(a == b for a, b in edges):
                continue
            part = set(next(iter(edges)))
            while leaving := [e for e in edges if (e[0] in part) != (e[1] in part)]:
                part |= set(leaving[0])
            if part == {v for e in edges for v in e} and count(edges) >= needed:
                found[edges] = count(edges)
    return found


def graph_of(edges):
    """Pattern edges as vertex and edge sets; a self-loop leaves its vertex."""
    return {v for e in edges for v in e}, {e for e in edges if e[0] != e[1]}


def common_size(x, y):
    (xv, xe), (yv, ye) = x, y
    shared = xe & ye
    best = 1 if xv & yv else 0
    left = {v for e in shared for v in e}
    while left:
        part = {left.pop()}
        while True:
            more = {v for e in shared if e[0] in part or e[1] in part for v in e} - part
            if not more:
                break
            part |= more
        left -= part
        best = max(best, len(part) + sum(1 for e in shared if e[0] in part))
    return best


def graph_distance(x, y):
    size = lambda g: len(g[0]) + len(g[1])
    return 1.0 - common_size(x, y) / max(size(x), size(y))
