"""Consolidating pairwise matches into groups: deterministic Boruvka hooking with pointer doubling.

Every round each component picks its smallest outgoing edge (edges are ordered by their two labels, the smaller first, so
the choice is unique and the picked edges form trees plus one two-cycle per tree). The smaller end of the two-cycle becomes
the root, trees collapse onto their root by pointer doubling, and the remaining edges are relabelled and deduplicated. A
round at least halves the components that still have edges, so billions of pairs take some thirty rounds at most, of a
size that shrinks geometrically. Nothing but counts reaches the driver.

The root is the smallest label of its tree: a label with a smaller neighbour goes to its smallest neighbour; one without
goes to a neighbour, and that one goes to the same label or a smaller one. So every two steps a path does not rise above
where it was, it ends at the smaller end of a two-cycle, and no label on it is below that end. Hence the label of a
component is its smallest member in every round, and the last label is the group's.

The first round, and every other over more than TAIL edges, is a step of the cluster. Rounds over fewer are the same rounds
on arrays in one task: their cost would be the latency of jobs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.operators.pointers import climb, relabelled
from docsift.session import HOT, discard, hot_keys, join_hot, measured

#: Edges that one task contracts.
TAIL = 100_000


def _pick(edges: DataFrame) -> DataFrame:
    """(v, p): of each label its partner over the smallest incident edge."""
    ends = edges.select(F.explode(F.array("a", "b")).alias("v"), "a", "b")
    best = ends.groupBy("v").agg(F.min(F.struct("a", "b")).alias("e"))
    return best.select("v", F.when(F.col("v") == F.col("e.a"), F.col("e.b")).otherwise(F.col("e.a")).alias("p"))


def _forest(edges: DataFrame, hot: int) -> tuple[DataFrame, int]:
    """(v, p): of each label of ``edges`` the root of its tree, and the number of labels."""
    picked, got = measured(_pick(edges), n=F.count("*"))
    n = got["n"]
    back = picked.select(F.col("v").alias("p"), F.col("p").alias("pp"))
    # the smaller end of a mutual choice is the root
    root = (F.col("pp") == F.col("v")) & (F.col("v") < F.col("p"))
    first = join_hot(picked, back, ["p"], hot_keys(picked, ["p"], n, hot), "inner")
    up, got = measured(first.select("v", F.when(root, F.col("v")).otherwise(F.col("p")).alias("p"), (~root).alias("open")), open=F.count_if("open"))
    discard(picked)
    return climb(up, got["open"], hot), n


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labels of the edges ``a < b`` and their roots: all rounds of hooking and doubling on arrays."""
    labels, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    total = np.arange(len(labels))
    while len(x):
        order = np.lexsort((y, x))
        x, y = x[order], y[order]
        best = np.full(len(labels), len(x))
        rank = np.arange(len(x))
        np.minimum.at(best, x, rank)
        np.minimum.at(best, y, rank)
        own = np.flatnonzero(best < len(x))
        up = np.arange(len(labels))
        up[own] = x[best[own]] + y[best[own]] - own
        roots = own[(up[up[own]] == own) & (own < up[own])]
        up[roots] = roots
        while not np.array_equal(up, up[up]):
            up = up[up]
        total = up[total]
        x, y = up[x], up[y]
        keep = x != y
        x, y = np.unique(np.stack([np.minimum(x, y)[keep], np.maximum(x, y)[keep]]), axis=1)
    return labels, labels[total]


def _in_one_task(edges: DataFrame) -> DataFrame:
    """(v, p) of at most TAIL edges."""
    kind = edges.schema["a"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [f for f in frames if len(f)]
        if got:
            whole = pd.concat(got)
            v, p = contract(whole["a"].to_numpy(), whole["b"].to_numpy())
            yield pd.DataFrame({"v": v, "p": p})

    return edges.coalesce(1).mapInPandas(run, f"v {kind}, p {kind}")


def connected_groups(pairs: DataFrame, left: str, right: str, ident: str = "doc_ix", group: str = "group_ix", hot: int = HOT, tail: int = TAIL) -> DataFrame:
    """One row per id at an end of ``pairs``: ``(ident, group)``, the group being the smallest id linked to it.

    Pairs with a missing end are no links. A self-pair makes its id a member of a group of its own. Either order of
    the ends and repeated pairs count once. Other columns of ``pairs`` are ignored. No pairs give no rows. ``hot`` is
    the number of rows from which a label is joined apart, ``tail`` that of edges which one task contracts after the
    first round; they change no result.
    """
    ends = pairs.select(F.col(left).alias("x"), F.col(right).alias("y")).dropna()
    links, got = measured(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), n=F.count_if(F.col("a") != F.col("b")))
    members = links.select(F.explode(F.array("a", "b")).alias("v")).distinct()
    edges, steps = links.filter("a <> b"), []
    old = None
    while n := got["n"]:
        if steps and n <= tail:
            steps.append((measured(_in_one_task(edges))[0], 2 * n))
            discard(old)
            break
        roots, labels = _forest(edges, hot)
        steps.append((roots, labels))
        moved = relabelled(relabelled(edges, n, "a", roots, hot), n, "b", roots, hot).filter("a <> b")
        edges, got = measured(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), n=F.count("*"))
        discard(old)
        old = edges
    if not steps:
        return members.select(F.col("v").alias(ident), F.col("v").alias(group))
    # from the last, smallest round back to the first: every map is composed once
    whole = steps[-1][0]
    for earlier, labels in reversed(steps[:-1]):
        whole = relabelled(earlier, labels, "p", whole, hot)
    return members.join(whole, "v", "left").select(F.col("v").alias(ident), F.coalesce("p", "v").alias(group))


def match_groups(match_pairs: DataFrame) -> DataFrame:
    """``(doc_ix, group_ix)`` over the accepted rows of a table with ``left_ix, right_ix, is_match``.

    Rows whose ``is_match`` is false or null and rows with a missing end link nothing; late, repeated and reversed rows
    change nothing; null scores and keys don't matter.
    """
    return connected_groups(match_pairs.filter("is_match"), "left_ix", "right_ix")
