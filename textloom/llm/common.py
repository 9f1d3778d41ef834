"""What the operators of this subpackage share: word rules, durable tables and skew-proof ranks."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: White space of the word rule: a word is a run of anything else.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Spark's own setting: a query's shuffle files are deleted when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows a ranked bucket holds on average.
BUCKET_ROWS = 8192


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row (a lambda binds it; Catalyst can't inline it)."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text in order; null and blank texts have none.

    Other white space becomes spaces by byte search, so that the split needs no regular expression.
    """
    for c in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), " "), "")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; a local one only where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        found = spark.sparkContext.getCheckpointDir()
        if not found:
            import tempfile

            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="textloom-"))
            found = spark.sparkContext.getCheckpointDir()
        folder = found
    return folder.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as a table in the shared folder and read back: a lost executor can't undo it.

    Shuffle files of the writing go as soon as it is done. The table goes by ``dropped``, or when the driver's
    JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    _path(spark, path)[1].deleteOnExit(_path(spark, path)[0])
    back = spark.read.schema(df.schema).parquet(path)
    back._saved_at = path
    return back


def _path(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of ``saved`` that nothing reads any more."""
    for t in tables:
        at, store = _path(t.sparkSession, t._saved_at)
        store.delete(at, True)


def spread_join(rows: DataFrame, table: DataFrame, key: str, how: str = "inner", over: DataFrame | None = None, n_rows: int | None = None) -> DataFrame:
    """``rows`` joined with ``table`` (a row a key, or few) on a long key that many of the rows may share.

    A key of more than its limit of rows is dealt to several tasks, and its row of the table to each of them.
    There are at most 65,536 such keys, so their list is a bounded broadcast. ``over``: a saved table of
    distinct rows whose columns ``rows`` has and whose keys it follows; without it ``rows`` is a saved table itself.
    ``n_rows``: its rows, if they are known.
    """
    known = rows if over is None else over
    limit = max(1024, (known.count() if n_rows is None else n_rows) >> 16)
    hot = known.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > limit).where(F.col(key).isNotNull())
    hot = F.broadcast(hot.select(key, F.expr(f"(_n - 1) div {limit} + 1").alias("_salts")))
    n = F.coalesce("_salts", F.lit(1).cast("long"))
    # either is the same whenever a task runs again
    draw = F.monotonically_increasing_id() if over is None else F.xxhash64(*over.columns)
    left = rows.join(hot, key, "left").withColumn("_salt", F.pmod(draw, n)).drop("_salts")
    right = table.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), n - 1))).drop("_salts")
    return left.join(right, [key, "_salt"], how).drop("_salt")


def bounded_batches(spark: SparkSession, rows: int = 1000, size: int = 16 << 20) -> None:
    """Texts reach Python in batches of at most ``rows`` and about ``size`` bytes: what a worker holds grows neither with a partition nor with long texts.

    Sets the session's limits where they are higher; plans are run later, so they stay.
    """
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        name = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(name)
        if not now.lstrip("-").isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, most)


def bucket_count(rows: int, per: int = BUCKET_ROWS) -> int:
    """Power of two: how many buckets hold about ``per`` rows each; at least 256, so that a hot group is spread."""
    return 1 << max(8, math.ceil(math.log2(max(rows, 1) / per)))


def md5_unit(*parts: Column) -> Column:
    """A 52-bit draw in (0, 1) from the MD5 of the parts joined by '/'."""
    return (md5_bits(*parts).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def md5_bits(*parts: Column) -> Column:
    """The first 52 bits of the MD5 of the parts joined by '/', as a long."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", *parts)), 1, 13), 16, 10).cast("long")


def bucket_of(bits: Column, buckets: int) -> Column:
    """Bucket of a 52-bit draw: its leading bits, so buckets in order are draws in order."""
    return F.shiftright(bits, 52 - int(math.log2(buckets))).cast("int")


def running(df: DataFrame, group: str, bits: str, order: list[str], buckets: int, totals: DataFrame, **sums: str) -> DataFrame:
    """Adds, for every ``name=column``, the sum of ``column`` over the rows of the same group that come before.

    Rows are ordered by (bits, *order). A group may hold most of the table: only a
    (group, bucket) pair, about BUCKET_ROWS rows, meets in one task. ``totals`` has for each
    (group, bucket) the bucket's sums in columns ``total_<name>``; it is small (one row a pair).
    """
    near = Window.partitionBy(group, "bucket").orderBy(bits, *order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    heads = totals.select(
        F.col(group).alias("_group"), F.col("bucket").alias("_bucket"),
        *[F.coalesce(F.sum(f"total_{n}").over(before), F.lit(0)).alias(f"_before_{n}") for n in sums],
    )
    inner = df.withColumns({f"_in_{n}": F.coalesce(F.sum(c).over(near), F.lit(0)) for n, c in sums.items()})
    out = inner.join(heads, F.col(group).eqNullSafe(F.col("_group")) & (F.col("bucket") == F.col("_bucket")), "left")
    return out.withColumns({n: F.col(f"_in_{n}") + F.col(f"_before_{n}") for n in sums}).drop(
        "_group", "_bucket", *[f"_in_{n}" for n in sums], *[f"_before_{n}" for n in sums]
    )
