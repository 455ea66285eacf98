"""Edit distance of ordered, labelled trees (the keyroot dynamic programme of Zhang and Shasha, 1989) for records as JSON."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: A tree as (labels, leftmost): its nodes in postorder, and for each the place of the first leaf under it.
Tree = tuple[list[str], list[int]]


def tree_of(value) -> Tree:
    """A JSON value under a node `root`: keys in order are nodes, list elements are nodes `[]`, other values are leaves."""
    labels: list[str] = []
    leftmost: list[int] = []

    def put(label: str, first: int) -> None:
        labels.append(label)
        leftmost.append(first)

    def add(v, label: str) -> None:
        first = len(labels)
        for name, child in sorted(v.items()) if isinstance(v, dict) else [("[]", x) for x in v] if isinstance(v, list) else ():
            add(child, name)
        if not isinstance(v, (dict, list)):
            put(str(v), first)
        put(label, first)

    add(value, "root")
    return labels, leftmost


def edits(a: str, b: str) -> int:
    """Edit distance of two texts, a column of the table as bits of one number (Myers, 1999)."""
    if a == b or not a or not b:
        return 0 if a == b else max(len(a), len(b))
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, last, score = (1 << len(a)) - 1, 1 << len(a) - 1, len(a)
    rises, falls = full, 0
    for c in b:
        eq = where.get(c, 0)
        met = (((eq & rises) + rises) ^ rises) | eq
        level, eq = met | falls, eq | falls
        up, down = falls | ~(level | rises) & full, rises & level
        score += bool(up & last) - bool(down & last)
        up, down = up << 1 | 1, down << 1
        rises, falls = (down | ~(eq | up)) & full, up & eq & full
    return score


def tree_distance(a: Tree, b: Tree, memo: dict[tuple[str, str], float] | None = None) -> float:
    """Least cost to turn a into b: a node put in or taken out costs 1, a changed label its edits / the longer length."""
    memo = {} if memo is None else memo
    (one, low), (two, high) = a, b
    dist = [[0.0] * len(two) for _ in one]
    roots = lambda leftmost: sorted({first: i for i, first in enumerate(leftmost)}.values())
    for i in roots(low):
        for j in roots(high):
            top, side = low[i], high[j]
            table = [[float(y) for y in range(j - side + 2)]]
            for x in range(top, i + 1):
                above, row = table[-1], [table[-1][0] + 1.0]
                whole, label, mine = low[x] == top, one[x], dist[x]
                start = table[low[x] - top]
                for y in range(side, j + 1):
                    best = min(above[y - side + 1], row[-1]) + 1.0
                    if whole and high[y] == side:
                        pair = (label, two[y])
                        change = memo.get(pair)
                        if change is None:
                            change = memo[pair] = edits(*pair) / max(len(pair[0]), len(pair[1]), 1)
                        mine[y] = best = min(best, above[y - side] + change)
                    else:
                        best = min(best, start[high[y] - side] + mine[y])
                    row.append(best)
                table.append(row)
    return dist[-1][-1]


#: A node with what is under it: (label, children, number of nodes).
Node = tuple[str, tuple, int]


def node_of(value, label: str = "root") -> Node:
    """The tree of tree_of as nested nodes."""
    if isinstance(value, dict):
        under = tuple(node_of(v, k) for k, v in sorted(value.items()))
    elif isinstance(value, list):
        under = tuple(node_of(v, "[]") for v in value)
    else:
        under = ((str(value), (), 1),)
    return label, under, 1 + sum(n[2] for n in under)


def _postorder(forest) -> Tree:
    labels: list[str] = []
    leftmost: list[int] = []

    def add(node: Node) -> None:
        first = len(labels)
        for child in node[1]:
            add(child)
        labels.append(node[0])
        leftmost.append(first)

    for node in forest:
        add(node)
    return labels, leftmost


def _change(a: str, b: str, memo: dict[tuple[str, str], float]) -> float:
    if a == b:
        return 0.0
    cost = memo.get((a, b))
    if cost is None:
        cost = memo[a, b] = edits(a, b) / max(len(a), len(b), 1)
    return cost


def _in_order(a: list[str], b: list[str], most: float, memo: dict[tuple[str, str], float]) -> float:
    """The edit distance of two label sequences with the same costs, or some number over `most` if it is over `most`."""
    far = most + 1.0
    width = int(most) + 1  # cells further off the diagonal cost more than that
    if abs(len(a) - len(b)) > width:
        return far
    last = [float(j) if j <= width else far for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        low, high = max(1, i - width), min(len(b), i + width)
        row = [far] * (len(b) + 1)
        row[0] = float(i)
        for j in range(low, high + 1):
            row[j] = min(last[j] + 1.0, row[j - 1] + 1.0, last[j - 1] + _change(x, b[j - 1], memo))
        last = row
    return last[-1]


def forest_distance(a: tuple, b: tuple, memo: dict[tuple[str, str], float]) -> float:
    """The distance of two lists of nodes, that of tree_distance, with the table only where the rest doesn't decide it.

    Equal trees at either end go: a mapping that uses them otherwise leaves as many nodes unmapped. So does one equal root
    over each side. Roots that then agree pairwise bound the distance from above by their own distances; nodes in postorder
    bound it from below, as a mapping keeps that order. If the bounds meet they are the distance.
    """
    first, end = 0, 0
    short = min(len(a), len(b))
    while first < short and a[first] == b[first]:
        first += 1
    while end < short - first and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[first : len(a) - end], b[first : len(b) - end]
    if not a or not b:
        return float(sum(n[2] for n in a or b))
    if len(a) == len(b) == 1:
        (x, under, _), (y, over, _) = a[0], b[0]
        if x == y:
            return forest_distance(under, over, memo)
        if not under and not over:
            return _change(x, y, memo)
    one, two = _postorder(a), _postorder(b)
    if len(a) == len(b) and all(x[0] == y[0] for x, y in zip(a, b)):
        above = sum(0.0 if x == y else forest_distance(x[1], y[1], memo) for x, y in zip(a, b))
        if _in_order(one[0], two[0], above, memo) >= above - 1e-9:
            return above
    rooted = lambda t: (t[0] + ["root"], t[1] + [0])
    return tree_distance(rooted(one), rooted(two), memo)


def _value(text):
    try:
        return json.loads(text)
    except (TypeError, ValueError):
        return {}


@F.pandas_udf(DoubleType())
def tree_accuracy(pred: pd.Series, truth: pd.Series) -> pd.Series:
    """1 - distance of the texts' trees / that of an empty record to the truth's, not under 0; broken or null texts are empty records."""
    memo: dict[tuple[str, str], float] = {}
    out = []
    for p, t in zip(pred, truth):
        read, want = node_of(_value(p)), node_of(_value(t))
        out.append(1.0 if read == want else max(0.0, 1.0 - forest_distance((read,), (want,), memo) / max(want[2] - 1, 1e-9)))
        if len(memo) > 1_000_000:
            memo.clear()
    return pd.Series(out, dtype="float64")
