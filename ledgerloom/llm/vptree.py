"""Vantage-point trees over 64-bit fingerprints under Hamming distance."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LEAF = 64


@dataclass(frozen=True)
class Node:
    """An inner node (``inside`` holds what is at most ``radius`` from ``point``) or a leaf, which has a number."""

    point: np.uint64 = np.uint64(0)
    radius: int = 0
    inside: Node | None = None
    outside: Node | None = None
    leaf: int = -1
    members: np.ndarray | None = None


def distances(values: np.ndarray, point: np.uint64) -> np.ndarray:
    return np.bitwise_count(values ^ point).astype(np.int64)


def build(values: np.ndarray, most: int, seed: int = 7) -> tuple[Node, int]:
    """A tree whose leaves hold at most ``most`` of the values (more where none differ), and how many leaves it has.

    Every leaf knows the positions of its values.
    """
    rng = np.random.default_rng(seed)
    leaves = 0

    def grow(members: np.ndarray) -> Node:
        nonlocal leaves
        if len(members) > most:
            for _ in range(4):
                point = values[members[rng.integers(len(members))]]
                d = distances(values[members], point)
                radius = int(np.median(d))
                if radius == d.max():
                    radius = int(d.max()) - 1
                inside = d <= radius
                if inside.any() and not inside.all():
                    return Node(point, radius, grow(members[inside]), grow(members[~inside]))
        leaves += 1
        return Node(leaf=leaves - 1, members=members)

    root = grow(np.arange(len(values)))
    return root, leaves


def home_leaves(root: Node, values: np.ndarray) -> np.ndarray:
    """The leaf that each value belongs to."""
    out = np.zeros(len(values), np.int64)
    todo = [(root, np.arange(len(values)))]
    while todo:
        node, at = todo.pop()
        if node.leaf >= 0:
            out[at] = node.leaf
            continue
        inside = distances(values[at], node.point) <= node.radius
        todo += [(node.inside, at[inside]), (node.outside, at[~inside])]
    return out


def visits(root: Node, values: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, leaf) of the other leaves that values must visit as queries.

    Where two values within ``reach`` part, one is inside and the other outside;
    the inside one visits the outside, so each pair meets exactly once.
    """
    found: list[tuple[np.ndarray, np.ndarray]] = []
    todo = [(root, np.arange(len(values)), True)]
    while todo:
        node, at, home = todo.pop()
        if not len(at):
            continue
        if node.leaf >= 0:
            if not home:
                found.append((at, np.full(len(at), node.leaf)))
            continue
        d = distances(values[at], node.point)
        near_outside = d + reach > node.radius
        if home:
            inside = d <= node.radius
            todo += [(node.inside, at[inside], True), (node.outside, at[~inside], True), (node.outside, at[inside & near_outside], False)]
        else:
            todo += [(node.inside, at[d - reach <= node.radius], False), (node.outside, at[near_outside], False)]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


def local_stars(homes: np.ndarray, queries: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(value, smallest value of its component) under all links of homes with homes and queries; no pair list is kept.

    A tree over the homes answers all values at once; triangle bounds prune its branches.
    """
    values = np.concatenate([homes, queries])
    root_of = np.arange(len(values))
    root, _ = build(homes, LEAF)
    todo = [(root, np.arange(len(values)))]
    while todo:
        node, at = todo.pop()
        if not len(at):
            continue
        if node.leaf < 0:
            d = distances(values[at], node.point)
            todo += [(node.inside, at[d - reach <= node.radius]), (node.outside, at[d + reach > node.radius])]
            continue
        step = max(1, 2_000_000 // len(node.members))
        for first in range(0, len(at), step):
            part = at[first : first + step]
            close = np.bitwise_count(values[part][:, None] ^ homes[node.members][None, :]) <= reach
            i, j = np.nonzero(close)
            a, b = root_of[part[i]], root_of[node.members[j]]
            while len(a := a[differ := a != b]):  # hook larger roots under smaller ones until no link joins two
                b = b[differ]
                low, high = np.minimum(a, b), np.maximum(a, b)
                np.minimum.at(root_of, high, low)
                while np.any((up := root_of[root_of]) != root_of):
                    root_of = up
                a, b = root_of[low], root_of[high]
    smallest = np.full(len(values), np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(smallest, root_of, values)
    label = smallest[root_of]
    linked = label != values
    return values[linked], label[linked]
