"""Mixing sources to target shares by systematic sampling.

Every document of a source expects the same number of copies, copies = total * share / tokens of the source. The
expected copies are prefix-summed within the source, one random offset is added, and a document is emitted once per
integer boundary that its interval crosses: it comes out floor(copies) or ceil(copies) times, never more often than the
cap, and a source's number of emitted copies differs from its expectation by less than one.

Within a source the order is by size, so the sample is stratified by it and the tokens drawn stay close to their
expectation, not only the copies.

The prefix sum is distributed: documents fall into parts of their source, by size class and a hash; the parts' counts are
added up first, and each part numbers its own documents from there. A source of more than HASHES * PART documents has
more hash parts, so a part stays below PART documents, also where all are of one size. No task gets a whole source.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsift.llm.tokens import count_tokens
from docsift.session import cut

#: Size classes for every doubling of the number of tokens, hash parts of a class, and documents of a part.
CLASSES = 16
HASHES = 32
PART = 100_000


def offset_of(seed: int, source: str | None) -> float:
    """The random offset in [0, 1) of a source."""
    return int.from_bytes(hashlib.sha256(f"{seed}/{source}".encode()).digest()[:7], "big") / 2**56


def sized_documents(documents: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, source, n_tokens)`` of the documents that have any token: null and empty texts have no size and are
    left out of a mixture. A repeated ``doc_id`` counts once. A null source is a source that has no target."""
    sized = count_tokens(documents.select("doc_id", "source", "text"), "text", "n_tokens", path).filter("n_tokens > 0")
    return sized.dropDuplicates(["doc_id"])


def plan(sized: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """One row per source of ``targets`` or ``sized``: ``source, target_share, max_repeats, docs, tokens, total, copies``.

    Without ``total`` the mixture is as large as the caps allow: the least of max_repeats * tokens / share over the
    sources that have documents. With it, copies above a source's cap are cut to the cap, and the share falls short.
    Sources without documents, or without a target (copies 0), contribute nothing; the shares of the rest are then
    taken relative to their sum. Duplicate target rows of a source: the largest share counts.
    """
    have = sized.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"))
    wanted = targets.groupBy("source").agg(F.max_by(F.struct("target_share", "max_repeats"), "target_share").alias("t")).select("source", "t.*")
    both = have.join(wanted, have.source.eqNullSafe(wanted.source), "full").select(
        F.coalesce(have.source, wanted.source).alias("source"),
        F.coalesce("target_share", F.lit(0.0)).alias("target_share"),
        F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"),
        F.coalesce("docs", F.lit(0)).alias("docs"),
        F.coalesce("tokens", F.lit(0)).alias("tokens"),
    )
    usable = (F.col("tokens") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    everything = Window.partitionBy(F.lit(0))  # over one row per source
    shared = both.withColumn("share", F.when(usable, F.col("target_share") / F.sum(F.when(usable, F.col("target_share"))).over(everything)))
    most = F.min(F.when(usable, F.col("max_repeats") * F.col("tokens") / F.col("share"))).over(everything)
    sized_to = shared.withColumn("total", F.lit(float(total)) if total is not None else most)
    return sized_to.withColumn(
        "copies", F.when(usable, F.least(F.col("max_repeats").cast("double"), F.col("total") * F.col("share") / F.col("tokens"))).otherwise(0.0)
    ).drop("share")


def mixture(sized: DataFrame, planned: DataFrame, seed: int = 20_24) -> DataFrame:
    """``(doc_id, source, n_tokens, copy_no)``: one row per emitted copy, copies of a document counting from 1.

    ``sized`` has ``doc_id, source, n_tokens``, ``planned`` comes from plan(). The result is the same for equal input
    whatever the partitioning, as the order within a source is (size class, hash, size, doc_id).
    """
    offset = F.udf(lambda s: offset_of(seed, s), "double")  # once per source
    hashes = F.greatest(F.lit(HASHES), F.ceil(F.col("docs") / F.lit(PART))).alias("hashes")
    rates = planned.filter("copies > 0").select("source", "copies", "max_repeats", hashes).withColumn("start", offset("source"))
    size_class = F.floor(F.log2(F.col("n_tokens").cast("double")) * CLASSES)
    docs = sized.join(F.broadcast(rates), "source").withColumn("bucket", size_class * F.col("hashes") + F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("hashes")))
    parts = docs.groupBy("source", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # over the parts of a source
    offsets = parts.select("source", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("source", "bucket").orderBy("n_tokens", "doc_id")
    ranked = docs.withColumn("rank", F.row_number().over(within)).join(offsets, ["source", "bucket"])
    # the boundary a document's interval crosses: floor of its end less floor of its begin
    rank = F.col("before") + F.col("rank")
    upto = lambda k: F.floor(F.col("start") + k * F.col("copies"))
    emitted = ranked.withColumn("times", F.least(upto(rank) - upto(rank - 1), F.col("max_repeats").cast("long")).cast("int"))
    return emitted.filter("times > 0").select("doc_id", "source", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy_no"))


def shares(mixed: DataFrame, planned: DataFrame) -> DataFrame:
    """What was reached, one row per source: ``source, target_share, max_repeats, docs, tokens, mixed_docs, mixed_copies,
    mixed_tokens, most_copies, actual_share``; zeros for a source that contributes nothing."""
    per_doc = mixed.groupBy("source", "doc_id").agg(F.count("*").alias("c"), F.max("n_tokens").alias("n"))
    got = per_doc.groupBy("source").agg(
        F.count("*").alias("mixed_docs"), F.sum("c").alias("mixed_copies"), F.sum(F.col("c") * F.col("n")).alias("mixed_tokens"), F.max("c").alias("most_copies")
    )
    joined = planned.join(got.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    for c in ("mixed_docs", "mixed_copies", "mixed_tokens", "most_copies"):
        joined = joined.withColumn(c, F.coalesce(c, F.lit(0)))
    whole = F.sum("mixed_tokens").over(Window.partitionBy(F.lit(0)))  # over one row per source
    return joined.withColumn("actual_share", F.coalesce(F.try_divide("mixed_tokens", whole), F.lit(0.0))).drop("total", "copies")


def mix_documents(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 20_24, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The mixture and the shares reached. Token counts are written to the checkpoint folder once, not counted thrice."""
    sized = cut(sized_documents(documents, path))
    planned = cut(plan(sized, targets, total))
    mixed = mixture(sized, planned, seed)
    return mixed, shares(mixed, planned)
