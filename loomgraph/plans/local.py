"""Sequential kernels for graphs of a checked, small size.

A round of a distributed plan costs a job however little it moves, so a path of a thousand steps costs a thousand jobs.
Plans that run in rounds therefore first count their stored edges, and up to ``LOCAL_ROWS`` of them finish on the driver
with the functions here; beyond that they run in rounds. Both give the same rows.
"""

from __future__ import annotations

import heapq
from collections import defaultdict, deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Edges that the driver takes at most: four longs each.
LOCAL_ROWS = 200_000
#: Work, or output values, that a kernel takes at most.
LOCAL_WORK = 5_000_000


def fetched(df: DataFrame, limit: int) -> pd.DataFrame | None:
    """The rows of a stored frame if there are ``limit`` at most."""
    return df.toPandas() if limit > 0 and df.count() <= limit else None


def followers(pairs: pd.DataFrame) -> dict[int, list[int]]:
    """Targets of each source in order of hyperedge and position, repeats included."""
    out: dict[int, list[int]] = defaultdict(list)
    for s, d in pairs.sort_values(["src", "hyperedge_id", "pos"])[["src", "dst"]].itertuples(index=False):
        out[int(s)].append(int(d))
    return out


def bfs(pairs: pd.DataFrame, start: int) -> list[tuple[int, int, int]]:
    """(vertex, level, place) in breadth-first order."""
    after, level, queue, order = followers(pairs), {start: 0}, deque([start]), []
    while queue:
        v = queue.popleft()
        order.append((v, level[v], len(order)))
        for w in after.get(v, ()):
            if w not in level:
                level[w] = level[v] + 1
                queue.append(w)
    return order


def hops(edges: pd.DataFrame, sources: list[int]) -> dict[int, int]:
    """Fewest steps to each vertex that any source reaches."""
    after: dict[int, list[int]] = defaultdict(list)
    for s, d in edges[["src", "dst"]].itertuples(index=False):
        after[int(s)].append(int(d))
    found, queue = dict.fromkeys(sources, 0), deque(sources)
    while queue:
        v = queue.popleft()
        for w in after.get(v, ()):
            if w not in found:
                found[w] = found[v] + 1
                queue.append(w)
    return found


def shortest(edges: pd.DataFrame, start: int) -> tuple[dict[int, tuple[int, int]], dict[int, int]]:
    """(cost, hops) of each vertex reached, and its predecessor on the least path by cost, hops and ids.

    Paths of equal hops compare as the ranks of the paths to their predecessors, then by vertex.
    """
    after: dict[int, list[tuple[int, int]]] = defaultdict(list)
    before: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for s, d, w in edges[["src", "dst", "w"]].itertuples(index=False):
        after[int(s)].append((int(d), int(w)))
        before[int(d)].append((int(s), int(w)))
    best, heap, done = {start: (0, 0)}, [(0, 0, start)], set()
    while heap:
        cost, n, v = heapq.heappop(heap)
        if v in done:
            continue
        done.add(v)
        for d, w in after.get(v, ()):
            if d not in done and (cost + w, n + 1) < best.get(d, (float("inf"), 0)):
                best[d] = (cost + w, n + 1)
                heapq.heappush(heap, (cost + w, n + 1, d))
    by_hops: dict[int, list[int]] = defaultdict(list)
    for v, (_, n) in best.items():
        by_hops[n].append(v)
    rank, previous = {start: 0}, {}
    for n in sorted(by_hops):
        if n:
            for v in by_hops[n]:
                previous[v] = min((rank[s], s) for s, w in before[v] if s in best and best[s] == (best[v][0] - w, n - 1))[1]
            for k, v in enumerate(sorted(by_hops[n], key=lambda v: (rank[previous[v]], v))):
                rank[v] = k
    return best, previous


def path_to(v: int, previous: dict[int, int]) -> list[int]:
    out = [v]
    while v in previous:
        v = previous[v]
        out.append(v)
    return out[::-1]


def kahn(vertices: list[int], pairs: pd.DataFrame) -> list[tuple[int, int, int]]:
    """(vertex, level, place) in the order of Kahn's queue, as far as it comes."""
    after, waiting, level = followers(pairs), dict.fromkeys(vertices, 0), dict.fromkeys(vertices, 0)
    for d in pairs["dst"]:
        waiting[int(d)] += 1
    queue, order = deque(sorted(v for v in vertices if waiting[v] == 0)), []
    while queue:
        v = queue.popleft()
        order.append((v, level[v], len(order)))
        for w in after.get(v, ()):
            waiting[w] -= 1
            level[w] = max(level[w], level[v] + 1)
            if waiting[w] == 0:
                queue.append(w)
    return order


def cut_vertices(members: pd.DataFrame) -> list[int]:
    """Cut vertices of the bipartite graph of vertices and hyperedges of two members or more."""
    sizes = members.groupby("hyperedge_id")["vertex_id"].transform("size")
    near: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
    for h, v in members.loc[sizes > 1, ["hyperedge_id", "vertex_id"]].itertuples(index=False):
        near[0, int(v)].append((1, int(h)))
        near[1, int(h)].append((0, int(v)))
    number: dict[tuple[int, int], int] = {}
    low: dict[tuple[int, int], int] = {}
    cut = set()
    for root in list(near):
        if root in number:
            continue
        number[root] = low[root] = len(number)
        stack, branches = [(root, None, iter(near[root]))], 0
        while stack:
            node, parent, rest = stack[-1]
            for other in rest:
                if other not in number:
                    number[other] = low[other] = len(number)
                    stack.append((other, node, iter(near[other])))
                    break
                if other != parent:
                    low[node] = min(low[node], number[other])
            else:
                stack.pop()
                if parent is not None:
                    low[parent] = min(low[parent], low[node])
                    if parent == root:
                        branches += 1
                    elif low[node] >= number[parent]:
                        cut.add(parent)
        if branches > 1:
            cut.add(root)
    return sorted(v for kind, v in cut if kind == 0)


def components(vertices: list[int], edges: pd.DataFrame) -> dict[int, int]:
    """The smallest vertex of each vertex's component; ``edges``: (a, b)."""
    root = {v: v for v in vertices}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in edges[["a", "b"]].itertuples(index=False):
        a, b = find(int(a)), find(int(b))
        root[max(a, b)] = min(a, b)
    return {v: find(v) for v in vertices}


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each end of the edges, and the smallest id of its component; the ends that are that id themselves are left out."""
    ids, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = list(range(len(ids)))
    for x, y in zip(codes[: len(a)].tolist(), codes[len(a) :].tolist()):
        while root[x] != x:
            root[x] = x = root[root[x]]
        while root[y] != y:
            root[y] = y = root[root[y]]
        if x < y:
            root[y] = x
        else:
            root[x] = y
    for x in range(len(ids)):  # roots are the smallest, so a root's own is known before
        root[x] = root[root[x]]
    low = np.array(root, dtype=np.int64)
    below = low != np.arange(len(ids))
    return ids[below], ids[low[below]] if len(ids) else ids


def blocks(hyperedges: np.ndarray, vertices: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(block, vertex) of distinct (hyperedge, vertex) rows: hyperedges that no single vertex's removal parts are one
    block, named by the smallest. Blocks of one vertex are left out.

    A depth-first search over vertices and hyperedges begins at hyperedges. One reached through a vertex is in the block
    of the hyperedge before that vertex if what hangs below it leads past the vertex, and begins a block otherwise.
    """
    names, h = np.unique(hyperedges, return_inverse=True)
    ids, v = np.unique(vertices, return_inverse=True)
    m, n = len(names), len(names) + len(ids)
    ends = np.concatenate([h, v + m])
    order = np.argsort(ends, kind="stable")
    to, start = np.concatenate([v + m, h])[order].tolist(), np.searchsorted(ends[order], np.arange(n + 1)).tolist()
    number, low, parent, at, found = [-1] * n, [0] * n, [-1] * n, start[:-1], []
    for root in range(m):
        if number[root] >= 0:
            continue
        number[root] = low[root] = len(found)
        found.append(root)
        node = root
        while node >= 0:
            i = at[node]
            if i < start[node + 1]:
                at[node] = i + 1
                other = to[i]
                if number[other] < 0:
                    parent[other], number[other], low[other] = node, len(found), len(found)
                    found.append(other)
                    node = other
                elif other != parent[node] and number[other] < low[node]:
                    low[node] = number[other]
            else:
                up = parent[node]
                if up >= 0 and low[node] < low[up]:
                    low[up] = low[node]
                node = up
    group = list(range(m))
    for x in found:
        if x < m and (p := parent[x]) >= 0 and low[x] < number[p]:
            group[x] = group[parent[p]]
    least = np.full(m, m)
    np.minimum.at(least, group, np.arange(m))
    rows = np.unique(least[np.array(group, dtype=np.int64)][h] * len(ids) + v)
    block, vertex = rows // max(len(ids), 1), rows % max(len(ids), 1)
    several = np.bincount(block, minlength=m)[block] > 1
    return names[block[several]], ids[vertex[several]]


def brandes(vertices: list[int], edges: pd.DataFrame, sources: list[int]) -> tuple[dict[int, tuple[int, int]], dict[int, float]]:
    """(number reached, sum of distances) of each source, and each vertex's dependencies; ``edges``: (src, dst, m)."""
    after: dict[int, list[tuple[int, float]]] = defaultdict(list)
    for s, d, m in edges[["src", "dst", "m"]].itertuples(index=False):
        after[int(s)].append((int(d), float(m)))
    reach, between = {}, dict.fromkeys(vertices, 0.0)
    for source in sources:
        dist, sigma, order, queue = {source: 0}, defaultdict(float, {source: 1.0}), [], deque([source])
        before: dict[int, list[tuple[int, float]]] = defaultdict(list)
        while queue:
            v = queue.popleft()
            order.append(v)
            for w, m in after.get(v, ()):
                if w not in dist:
                    dist[w] = dist[v] + 1
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    sigma[w] += sigma[v] * m
                    before[w].append((v, m))
        delta: dict[int, float] = defaultdict(float)
        for w in reversed(order):
            for v, m in before[w]:
                delta[v] += sigma[v] * m / sigma[w] * (1 + delta[w])
            if w != source:
                between[w] += delta[w]
        reach[source] = (len(order) - 1, sum(dist.values()))
    return reach, between


def frame(like: DataFrame, rows: list[tuple], ddl: str) -> DataFrame:
    """``rows`` as a frame of ``like``'s session."""
    names = [c.split()[0] for c in ddl.split(", ")]
    return like.sparkSession.createDataFrame(pd.DataFrame(rows, columns=names) if rows and not any(isinstance(x, (list, np.ndarray)) for x in rows[0]) else rows, ddl)
