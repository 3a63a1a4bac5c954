"""K-d trees over letter-count vectors, and searches for the boxes that one edit can reach.

A point is the count of each letter in a word. Replacing a letter raises one count and lowers another, dropping one
lowers a count; so a box lies within reach if no more than one count must go up and one down to enter it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Letters A-Z never occur (words are lower-cased), so a point has a place for a-z and for each of U+00C0 to U+00FF.
LETTERS = np.array([*range(97, 123), *range(0xC0, 0x100)])
PLACE = np.full(256, 255, dtype=np.uint8)
PLACE[LETTERS] = np.arange(len(LETTERS))
NONE = -1


@dataclass(frozen=True)
class Tree:
    """``letter[i]`` and ``upto[i]`` of an inner node (counts up to it go left); a box has letter -1 and its number in ``left``."""

    letter: np.ndarray
    upto: np.ndarray
    left: np.ndarray
    right: np.ndarray
    boxes: int


def points(letters: np.ndarray) -> np.ndarray:
    """Letter counts of the rows of a matrix of letters (code points below 256, one word a row)."""
    n = len(letters)
    flat = np.arange(n)[:, None] * len(LETTERS) + PLACE[letters]
    return np.bincount(flat.ravel(), minlength=n * len(LETTERS)).reshape(n, len(LETTERS)).astype(np.int32)


def build(x: np.ndarray, weight: np.ndarray, room: float) -> tuple[Tree, np.ndarray]:
    """A tree whose boxes weigh at most ``room`` (or hold equal points only), and the box of each row of ``x``."""
    nodes: list[list[int]] = []
    box_of, boxes = np.zeros(len(x), dtype=np.int64), 0
    stack = [(np.arange(len(x)), NONE, 0)]
    while stack:
        rows, parent, side = stack.pop()
        me = len(nodes)
        if parent != NONE:
            nodes[parent][2 + side] = me
        w = weight[rows]
        split = _fairest(x[rows], w) if w.sum() > room else None
        if split is None:
            nodes.append([NONE, 0, boxes, NONE])
            box_of[rows] = boxes
            boxes += 1
            continue
        letter, upto = split
        nodes.append([letter, upto, NONE, NONE])
        low = x[rows, letter] <= upto
        stack += [(rows[~low], me, 1), (rows[low], me, 0)]
    table = np.array(nodes, dtype=np.int64).reshape(-1, 4)
    return Tree(table[:, 0], table[:, 1], table[:, 2], table[:, 3], boxes), box_of


def _fairest(x: np.ndarray, w: np.ndarray) -> tuple[int, int] | None:
    """The letter and count that cut the weight most evenly; None where all points are equal."""
    total, best, found = float(w.sum()), 0.0, None
    for letter in np.flatnonzero(x.max(axis=0) != x.min(axis=0)):
        below = np.cumsum(np.bincount(x[:, letter], weights=w))
        evenness = np.minimum(below, total - below)
        at = int(evenness.argmax())
        if evenness[at] > best:
            best, found = float(evenness[at]), (int(letter), at)
    return found


def reach(tree: Tree, x: np.ndarray, up: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, box) of every box that a point can enter by lowering one count and, with ``up``, raising another.

    Of a pair that differs by a replaced letter only one side looks for the other: the one that raises the letter of
    the lower place. A box that can be entered in the other direction only is pruned.
    """
    rows_out, boxes_out = [], []
    n = len(x)
    none = np.full(n, NONE)
    stack = [(0, np.arange(n), none, none)]
    while stack:
        node, rows, raised, lowered = stack.pop()
        if not len(rows):
            continue
        letter = tree.letter[node]
        if letter == NONE:
            rows_out.append(rows)
            boxes_out.append(np.full(len(rows), tree.left[node]))
            continue
        upto = tree.upto[node]
        count = x[rows, letter].astype(np.int64) + (raised == letter) - (lowered == letter)
        low = count <= upto
        # to the left: already there, or by lowering this letter
        lower = ~low & (count == upto + 1) & (lowered == NONE) & (raised != letter) & ((raised == NONE) | (raised < letter))
        go = low | lower
        stack.append((tree.left[node], rows[go], raised[go], np.where(lower, letter, lowered)[go]))
        go = ~low
        if up:
            higher = low & (count == upto) & (raised == NONE) & (lowered != letter) & ((lowered == NONE) | (letter < lowered))
            go = go | higher
            raised = np.where(higher, letter, raised)
        stack.append((tree.right[node], rows[go], raised[go], lowered[go]))
    if not rows_out:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(rows_out), np.concatenate(boxes_out)
