"""What several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsift.session import HOT, cut, hot_keys, join_hot, measured

#: Rows of a block: a group of pairs_within() is compared block by block, so a task holds two blocks of it at a time.
BLOCK = 4_000
#: Rows from which a variant of a group has blocks of its own.
COPIES = 64


def _rows(df: DataFrame, key: str, ident: str, variant: str) -> tuple[DataFrame, int]:
    """The distinct ``(k, i, v)`` without nulls, written once, and their number."""
    rows = df.select(F.col(key).alias("k"), F.col(ident).alias("i"), F.col(variant).alias("v")).dropna().distinct()
    rows, got = measured(rows, n=F.count("*"))
    return rows, got["n"]


def cells(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` twice, for the two sides of a join of a group with itself: cell ``(x, y)``, x <= y, of a group gets its
    block x on the left and its block y on the right.

    ``rows`` has ``own``, the block of a row, ``blocks``, their number in its group, and ``lo`` and ``hi``: a row goes to
    the cells with the blocks from ``lo`` on on its right, and with the blocks up to ``hi`` on its left.
    """
    upto = lambda a, b: F.explode(F.when(a <= b, F.sequence(a, b)))
    one = rows.withColumn("x", F.col("own")).withColumn("y", upto(F.col("lo"), F.col("blocks") - 1))
    two = rows.withColumn("x", upto(F.lit(0), F.col("hi"))).withColumn("y", F.col("own"))
    return one.drop("own", "blocks", "lo", "hi"), two.drop("own", "blocks", "lo", "hi")


def _in_blocks(rows: DataFrame, n: int, block: int, hot: int) -> DataFrame:
    """The ``rows (k, i, v)`` of groups with several variants, in blocks for cells().

    A variant of COPIES rows and more has blocks of its own, which don't meet each other, as its rows form no pair. The
    other variants share blocks by a hash, so of these at most COPIES rows that form no pair with a row are beside it.
    """
    number = lambda c: F.ceil(c / F.lit(block)).cast("int")
    variants = rows.groupBy("k", "v").agg(F.count("*").alias("c")).withColumn("alone", F.col("c") >= COPIES)
    groups = variants.groupBy("k").agg(F.count("*").alias("nv"), F.sum(F.when(~F.col("alone"), F.col("c"))).alias("rest"), F.sum(F.when(F.col("alone"), number(F.col("c")))).alias("more"))
    mixing = number(F.coalesce("rest", F.lit(0)))
    groups = groups.filter("nv > 1").select("k", mixing.alias("mixing"), (mixing + F.coalesce("more", F.lit(0))).cast("int").alias("blocks"))
    placed = cut(join_hot(variants, groups, ["k"], hot_keys(variants, ["k"], n, hot), "inner"))
    before = Window.partitionBy("k").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)  # one row per large variant
    own = F.col("mixing") + F.coalesce(F.sum(number(F.col("c"))).over(before), F.lit(0)).cast("int")
    large = placed.filter("alone").select("k", "v", "blocks", "mixing", own.alias("first"), number(F.col("c")).alias("width"))
    small = placed.filter("not alone").select("k", "v", "blocks", "mixing", F.lit(None).cast("int").alias("first"), F.lit(1).alias("width"))
    each = join_hot(rows, large.unionByName(small), ["k", "v"], hot_keys(rows, ["k", "v"], n, hot), "inner")
    return each.select(
        "k", "i", "v", "blocks",
        F.when(F.col("first").isNull(), F.pmod(F.xxhash64("v"), F.col("mixing"))).otherwise(F.col("first") + F.pmod(F.xxhash64("i"), F.col("width"))).cast("int").alias("own"),
        F.col("first"), F.col("width"),
    ).withColumn("lo", F.coalesce(F.col("first") + F.col("width"), "own")).withColumn("hi", F.coalesce(F.col("first") - 1, "own")).drop("first", "width")


def pairs_within(df: DataFrame, key: str, ident: str, variant: str, left: str, right: str, block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """Pairs ``(left, right)``, smaller first, of ids with equal ``key`` and different ``variant``.

    Groups in which only one variant occurs never reach the join, so a group of exact copies costs one aggregated row,
    whatever its size. A group is cut into blocks of ``block`` rows, and every two blocks that can form a pair (and
    every block of several variants with itself) meet in a cell of their own: a cell holds about two blocks of rows,
    however large the group is, and few rows are moved for the pairs that come out. Rows with a null in any of the
    three columns are in no pair; repeated rows count once; an empty input gives no row.
    """
    rows, n = _rows(df, key, ident, variant)
    one, two = cells(_in_blocks(rows, n, block, hot))
    one = one.select("k", "x", "y", F.col("i").alias("i1"), F.col("v").alias("v1"))
    two = two.select("k", "x", "y", F.col("i").alias("i2"), F.col("v").alias("v2"))
    pairs = (
        one.join(two, ["k", "x", "y"])
        .filter("v1 <> v2 and i1 <> i2 and (x < y or i1 < i2)")
        .select(F.least("i1", "i2").alias(left), F.greatest("i1", "i2").alias(right))
    )
    # a pair can come twice only by an id with several rows
    several = not rows.groupBy("i").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
    return pairs.distinct() if several else pairs


def classes_within(df: DataFrame, key: str, ident: str, variant: str, hot: int = HOT) -> DataFrame:
    """``(ident, class_id, links)``: one row per id and group, without any pair.

    ``class_id`` is the smallest id of the group, ``links`` the number of rows of the group with another variant, which
    is the number of pairs of pairs_within() the id is in where ids have one row each. Nulls and repeated rows count as
    there.
    """
    rows, n = _rows(df, key, ident, variant)
    alike = rows.groupBy("k", "v").agg(F.count("*").alias("same"), F.min("i").alias("first"))
    whole = alike.groupBy("k").agg(F.sum("same").alias("all"), F.min("first").alias("class_id"))
    variants = cut(join_hot(alike.drop("first"), whole, ["k"], hot_keys(alike, ["k"], n, hot), "inner"))
    each = join_hot(rows, variants.select("k", "v", "class_id", (F.col("all") - F.col("same")).alias("links")), ["k", "v"], hot_keys(rows, ["k", "v"], n, hot), "inner")
    return each.select(F.col("i").alias(ident), "class_id", "links")
