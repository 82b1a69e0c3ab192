"""Session-level helpers: reading tables, cutting lineage, joins that no frequent key can stall."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

#: A key with more rows than this is joined apart from the others, by broadcast of its one lookup row.
HOT = 200_000
#: Such keys at most: in n rows a key is hot from n / HOT_KEYS rows on if that is more than HOT, so there cannot be more.
HOT_KEYS = 50_000
#: Spark's setting by which a query removes its shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def width(spark: SparkSession) -> int:
    """Partitions for a stage of heavy work per row."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` in enough partitions for heavy work per row.

    With ``keys`` it is hash-partitioned on them, which a following distinct or group-by reuses; a number given here is
    not coalesced afterwards. Without, it is only moved if its scan has fewer partitions than there are cores, so never
    for a large input.
    """
    n = width(df.sparkSession)
    if keys:
        return df.repartition(n, *keys)
    return df.repartition(n) if df.rdd.getNumPartitions() < df.sparkSession.sparkContext.defaultParallelism else df


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for tables between steps that all executors share.

    ``spark.checkpoint.dir`` of the session decides. Only where it is unset, and the session runs in one local JVM,
    a temporary folder is used; on a cluster a missing setting is an error, as a machine-local folder would be lost
    with its executor.
    """
    sc = spark.sparkContext
    set_already = sc._jsc.sc().getCheckpointDir()
    if set_already.isDefined():
        return set_already.get()
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="docsift-checkpoint-")
    sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """``df``, written as Parquet to the shared checkpoint folder and read again: short lineage that survives executors.

    The plan restarts at a scan, so later steps read only the columns they use and know the true size. The files are
    removed by discard(), or when the session's JVM ends.
    """
    return measured(df)[0]


def measured(df: DataFrame, **figures: Column) -> tuple[DataFrame, dict]:
    """cut() and the values of ``figures``, aggregates taken while the rows are written, without a job of their own.

    What the step shuffled is removed as soon as it is written, as nothing reads it again; Spark would keep it until the
    driver happens to collect its garbage.
    """
    spark = df.sparkSession
    schema = df.schema
    path = f"{ensure_checkpoint_dir(spark)}/docsift-{uuid.uuid4().hex}"
    seen = Observation() if figures else None
    if seen is not None:
        df = df.observe(seen, *(c.alias(n) for n, c in figures.items()))
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    out = spark.read.schema(schema).parquet(path)
    out._written_at = place
    return out, seen.get if seen is not None else {}


def discard(*tables: DataFrame | None) -> None:
    """Removes the files of tables that cut() wrote and that nothing reads any more."""
    for df in tables:
        place = getattr(df, "_written_at", None)
        if place is not None:
            place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def numbered(rows: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """``rows`` with their global position, from 0, in the order of ``keys``; only a count per partition is gathered."""
    ordered = cut(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_pid", F.spark_partition_id()).withColumn("_mono", F.monotonically_increasing_id()))
    sizes = ordered.groupBy("_pid").agg(F.count("*").alias("_n"), F.min("_mono").alias("_first"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    starts = sizes.select("_pid", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return ordered.join(F.broadcast(starts), "_pid").withColumn(name, F.col("_mono") + F.col("_shift")).drop("_pid", "_mono", "_shift")


def hot_keys(rows: DataFrame, on: Sequence[str], n: int, hot: int = HOT) -> DataFrame | None:
    """The keys of ``rows``, which are ``n``, that join_hot() joins apart; None where no key can be or is hot."""
    if n <= hot:
        return None
    least = max(hot, n // HOT_KEYS)
    found, got = measured(rows.groupBy(*on).agg(F.count("*").alias("_n")).filter(F.col("_n") > least).select(*on), n=F.count("*"))
    return found if got["n"] else None


def join_hot(rows: DataFrame, lookup: DataFrame, on: Sequence[str], hot: DataFrame | None, how: str = "left") -> DataFrame:
    """``rows`` joined with ``lookup``, in which a key occurs once; ``how`` is 'left' or 'inner'.

    Rows with a key in ``hot`` (from hot_keys(), so of bounded size) meet their lookup row by broadcast and are never
    gathered; of any other key a task gets at most max(HOT, n / HOT_KEYS) rows.
    """
    on = list(on)
    if hot is None:
        return rows.join(lookup, on, how)
    few = F.broadcast(hot)
    apart = rows.join(few, on, "left_semi").join(F.broadcast(lookup.join(few, on, "left_semi")), on, how)
    rest = rows.join(few, on, "left_anti").join(lookup, on, how)
    return apart.unionByName(rest.select(*apart.columns))
