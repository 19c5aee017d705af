"""Connected components of an edge table, and spanning forests within a task."""

from __future__ import annotations

import numpy as np

from quarry.operators.graph import components

__all__ = ["components", "spanning", "stars"]


def _union(root: np.ndarray, i: np.ndarray, j: np.ndarray, taken: list[tuple[np.ndarray, np.ndarray]] | None = None) -> np.ndarray:
    """The least node of each node's tree, root so far, once the edges i, j are in, a few at a time; taken gets those of a spanning forest."""
    while len(i):
        u, v = root[i], root[j]
        apart = u != v
        i, j, u, v = i[apart], j[apart], u[apart], v[apart]
        if not len(i):
            break
        high, low = np.maximum(u, v), np.minimum(u, v)
        _, at = np.unique(high, return_index=True)
        if taken is not None:
            taken.append((i[at], j[at]))
        root[high[at]] = low[at]
        while (root[root] != root).any():
            root = root[root]
    return root


def spanning(n: int, i: np.ndarray, j: np.ndarray) -> tuple[list[int], list[int]]:
    """Of the edges i, j among n nodes, those of a spanning forest."""
    taken: list[tuple[np.ndarray, np.ndarray]] = []
    _union(np.arange(n), i, j, taken)
    return [x for e in taken for x in e[0].tolist()], [x for e in taken for x in e[1].tolist()]


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the edges a, b connect: from each node but the least of its tree to that least one. Equal trees of several tasks give equal edges."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    root = _union(np.arange(len(nodes)), at[: len(a)], at[len(a) :])
    leaf = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[root[leaf]], nodes[leaf]
