"""Pointer doubling over a forest, for connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.session import HOT, discard, hot_keys, join_hot, measured

#: Hops of a pointer that one job makes where so few pointers are left that none of their targets can be hot.
HOPS = 7


def climb(up: DataFrame, left: int, hot: int = HOT) -> DataFrame:
    """``(v, p)``: of each ``v`` the root that ``up (v, p, open)`` leads to; ``left`` is the number of its open rows.

    ``open`` is false where ``p`` is known to be a root; these rows are not looked up again. A job doubles the pointers,
    with targets of very many of them joined apart; once no target can be hot, a job makes HOPS hops.
    """
    while left:
        rest = up.filter("open").select("v", "p")
        target = up.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        few = hot_keys(rest, ["p"], left, hot)
        for _ in range(1 if left > hot else HOPS):
            rest = join_hot(rest.select("v", "p"), target, ["p"], few, "inner").select("v", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("open"))
        after, got = measured(up.filter("not open").unionByName(rest), open=F.count_if("open"))
        discard(up)
        up, left = after, got["open"]
    return up.select("v", "p")


def relabelled(rows: DataFrame, n: int, column: str, roots: DataFrame, hot: int = HOT) -> DataFrame:
    """``rows``, which are ``n``, with ``column`` replaced by its root in ``roots (v, p)`` where it has one."""
    lookup = roots.select(F.col("v").alias(column), F.col("p").alias("_p"))
    return join_hot(rows, lookup, [column], hot_keys(rows, [column], n, hot)).select(*(F.coalesce("_p", column).alias(c) if c == column else F.col(c) for c in rows.columns))
