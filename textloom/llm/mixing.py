"""Low-discrepancy source schedule: slots of a mix are dealt to sources by van der Corput points, the slots of a
source are ranked, and rank r plays the r-th block of the source's shuffled words.

A slot i has the point bitreverse(i); with a power of two of slots the points are a permutation of
0 .. slots - 1, so mapping them through the sources' cumulative block counts gives every source exactly its
blocks, spread evenly over the schedule. The last block of a source is cut where its target ends. A source
whose target is above its size plays its stream a second time.

What is played where is part of the result: a document's first slot and how many slots play it, and the mix itself
(``mixed``) comes in the order of the slots.

Edge cases: a null or blank text has size 0, is taken 0 times and has no slot; null sources form the last source;
repeated rows count each by itself, and of rows equal in all that orders a stream it doesn't matter which is which;
a very long text covers many slots and is cut only where its source's target ends; with no words at all every
target is 0; an empty table gives an empty result; other columns, whatever their names, are carried along by
``mixed`` and not read elsewhere. The catalogue of sources (one row each) is ordered in one task, which may spill.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bucket_count, bucket_of, md5_bits, running, saved, words

#: Words in a block.
BLOCK = 1024
WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEATS = 2


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size -> also target: SHARE of all words by weight, none above REPEATS times its size.

    Sources are filled in the order of the level at which each is full; the common level of the rest follows
    from what is left. One row a source: the windows below hold the catalogue, never documents.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    n = len(WEIGHTS)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), ((F.row_number().over(by_name) - 1) % n + 1).cast("int"))
    full = (F.col("source_size") * REPEATS).cast("double")
    rows = sizes.withColumn("_weight", weight).withColumn("_full", full).withColumn("_at", F.col("_full") / F.col("_weight"))
    every = Window.partitionBy()
    filled = Window.orderBy("_at", F.col("source").isNull(), "source")
    left = F.lit(SHARE) * F.sum("source_size").over(every) - F.coalesce(F.sum("_full").over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("_weight").over(filled.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("_level", left / rest)
    # the level is that of the first source which isn't full at it
    level = F.coalesce(F.min(F.when(F.col("_level") <= F.col("_at"), F.struct("_at", F.col("source").isNull(), "source", "_level"))).over(every)["_level"], F.lit(0.0))
    return rows.withColumn("target", F.least(level * F.col("_weight"), F.col("_full"))).select("source", "source_size", "target")


def bit_reverse(i: Column, bits: int) -> Column:
    """The lowest ``bits`` bits of i in reverse order."""
    v = i
    for shift, m in ((1, 0x55555555), (2, 0x33333333), (4, 0x0F0F0F0F), (8, 0x00FF00FF), (16, 0x0000FFFF)):
        m64 = F.lit((m << 32) | m)
        v = F.shiftright(v, shift).bitwiseAND(m64).bitwiseOR(F.shiftleft(v.bitwiseAND(m64), shift))
    v = F.shiftrightunsigned(v, 32).bitwiseOR(F.shiftleft(v, 32))
    return F.shiftrightunsigned(v, 64 - bits)


def sized(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """key, source, size (words of the text) and fp (its hash), written once: texts are read a single time."""
    return saved(docs.select(
        F.col(key).alias("key"), F.col(source).alias("source"),
        F.size(words(F.col(text))).cast("long").alias("size"), F.xxhash64(F.col(text)).alias("fp"),
    ), "sized")


def streams(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``sized`` placed on their source's shuffled word stream, and the sources with their targets.

    Adds ``at`` (words of the stream before the row) and ``nth`` (its row number in the stream). Order in a
    stream is that of a hash of the key.
    """
    k = F.coalesce(F.col("key").cast("string"), F.lit("null"))
    spread = bucket_count(rows.count())
    rows = rows.withColumn("_bits", md5_bits(F.lit("mix"), k)).withColumn("_one", F.lit(1).cast("long"))
    rows = rows.withColumn("bucket", bucket_of(F.col("_bits"), spread))
    totals = rows.groupBy("source", "bucket").agg(F.sum("size").alias("total_at"), F.sum("_one").alias("total_nth"))
    sizes = saved(targets(totals.groupBy("source").agg(F.sum("total_at").alias("source_size"))), "sources")
    placed = running(rows, "source", "_bits", ["key", "size", "fp"], spread, totals, at="size", nth="_one").drop("_bits", "_one", "bucket")
    return placed, sizes


def schedule(spark: SparkSession, sizes: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mix as rows (slot, source, rank, words): which block each slot plays, and how many of its words."""
    need = F.ceil(F.floor("target") / F.lit(float(block))).cast("long")
    before = Window.orderBy(F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    marks = sizes.withColumn("blocks", need).withColumn("first", F.coalesce(F.sum("blocks").over(before), F.lit(0)))
    total = int(marks.agg(F.sum("blocks").alias("n")).first()["n"] or 0)
    bits = max(1, (max(total, 1) - 1).bit_length())
    # a point's source by its place among the cumulative counts; points beyond the last block stay empty.
    # Each source lists its own points, so nothing is joined by range: point p is slot bitreverse(p)
    step = 1 << 16
    parts = marks.select("source", "first", "blocks", "target", F.explode(F.expr(f"sequence(0L, greatest((blocks - 1) div {step}, 0L))")).alias("part"))
    points = parts.where("blocks > 0").repartition("source", "part").select(
        "source", "first", "target",
        F.explode(F.expr(f"sequence(part * {step}L, least(part * {step}L + {step - 1}L, blocks - 1))")).alias("point"),
    )
    return points.select("source", "target", bit_reverse(F.col("point") + F.col("first"), bits).alias("slot"))


def ranked(slots: DataFrame, sizes: DataFrame, block: int = BLOCK) -> DataFrame:
    """Adds rank: the slot's place among its source's slots; a source may have most slots."""
    total = sizes.agg(F.sum(F.ceil(F.floor("target") / F.lit(float(block)))).alias("n")).first()["n"] or 0
    bits = max(1, (max(int(total), 1) - 1).bit_length())
    shift = max(0, bits - 8 - max(0, (int(total) // 65536).bit_length()))
    put = slots.withColumn("bucket", F.shiftright("slot", shift).cast("int")).withColumn("_one", F.lit(1).cast("long"))
    totals = put.groupBy("source", "bucket").agg(F.sum("_one").alias("total_rank"))
    return running(put, "source", "slot", [], 1, totals, rank="_one").select(
        "slot", "source", "rank", F.least(F.lit(block).cast("long"), F.floor("target") - F.col("rank") * block).alias("words")
    )


def mix(placed: DataFrame, sizes: DataFrame, block: int = BLOCK) -> DataFrame:
    """Joins documents with the blocks that are played: rows (source, nth, turn, slot, from_word, taken).

    A document covers blocks ``at // block`` and on, and in the second playing (turn 1) those ``source_size`` later.
    """
    slots = ranked(schedule(placed.sparkSession, sizes, block), sizes, block)
    turns = placed.where("size > 0").join(sizes, placed["source"].eqNullSafe(sizes["source"])).select(
        placed["source"], "nth", "size", F.posexplode(F.expr(f"transform(sequence(0, {REPEATS - 1}), e -> at + e * source_size)")).alias("turn", "start"), "target"
    )
    # blocks beyond the target are never played
    covers = turns.where(F.col("start") < F.floor("target")).select(
        F.col("source").alias("_s"), "nth", "turn", "size", "start",
        F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")).alias("_rank"),
    )
    # both sides grow with the words: never a broadcast
    hit = covers.join(slots.hint("merge"), F.col("_s").eqNullSafe(F.col("source")) & (F.col("_rank") == F.col("rank")))
    head = F.greatest(F.col("start"), F.col("rank") * block)
    tail = F.least(F.col("start") + F.col("size"), F.col("rank") * block + F.col("words"))
    return hit.select("source", "nth", "turn", "slot", (head - F.col("start")).alias("from_word"), (tail - head).alias("taken")).where("taken > 0")


def taken(rows: DataFrame) -> DataFrame:
    """Rows of ``sized`` plus source_size, target, taken (a row's words in the mix, repeats counted), n_slots (how many
    slots play it), first_slot, and starts (the first slot of each playing)."""
    placed, sizes = streams(rows)
    placed = saved(placed, "placed")
    played = mix(placed, sizes)
    per = played.groupBy("source", "nth").agg(
        F.sum("taken").alias("taken"), F.count("*").alias("n_slots"), F.min("slot").alias("first_slot"),
        F.array(*[F.min(F.when(F.col("turn") == t, F.col("slot"))) for t in range(REPEATS)]).alias("starts"),
    ).withColumnsRenamed({"source": "_s", "nth": "_n"})
    out = placed.join(per, F.col("source").eqNullSafe(F.col("_s")) & (F.col("nth") == F.col("_n")), "left").drop("_s", "_n")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("taken", "n_slots")})
    known = sizes.select(F.col("source").alias("_s"), "source_size", "target")
    return out.join(known, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")


def mixed(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """The mix as rows of ``docs`` in the order of the schedule: each document as often as it is played, where its
    playing begins, the last time perhaps in part (its first words)."""
    rows = taken(sized(docs, text, key, source))
    # the row travels as one value, so no column of it can clash, and its text once
    put = docs.select(F.struct(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("fp"), F.col(source).alias("source")).alias("_k"), F.struct(*docs.columns).alias("_row"))
    played = rows.where("taken > 0").select(F.struct("key", "fp", "source").alias("_k"), F.struct("size", "taken", "starts").alias("_t"))
    # rows equal in id, text and source are numbered among documents and among playings, and equal numbers meet; which is
    # which doesn't matter. Both lie together by _k from one shuffle, where a join by _k and number would deal texts again
    both = put.unionByName(played, allowMissingColumns=True).repartition("_k").withColumn("_text_side", F.col("_row").isNotNull())
    both = both.withColumn("_n", F.row_number().over(Window.partitionBy("_k", "_text_side").orderBy(F.lit(0))))
    both = both.withColumn("_t", F.max("_t").over(Window.partitionBy("_k", "_n"))).where(F.col("_text_side") & F.col("_t").isNotNull())
    put = both.withColumn("_turn", F.explode(F.expr("sequence(0L, (_t.taken - 1) div _t.size)")))
    put = put.withColumn("_text", F.col("_row").getField(text))
    left = F.col("_t.taken") - F.col("_turn") * F.col("_t.size")
    part = left < F.col("_t.size")
    put = put.withColumn("_text", F.when(part, F.array_join(F.slice(words(F.col("_text")), F.lit(1), left.cast("int")), " ")).otherwise(F.col("_text")))
    row = F.col("_row").withField(text, F.col("_text"))
    if "n_chars" in docs.columns:
        n = F.when(part, F.length("_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row.n_chars"))
        row = row.withField("n_chars", n)
    put = put.select(row.alias("_row"), F.get("_t.starts", F.col("_turn").cast("int")).alias("_slot"), "_k.key", "_k.fp")
    return put.orderBy("_slot", "key", "fp").select("_row.*")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sized(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return taken(rows).select(F.col("key").alias("doc_id"), "size", "source_size", "target", "taken", "n_slots", "first_slot")


QUERIES = {"op7_mixing": op7_mixing}
SQL = {
    "op7_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    substr(md5('mix/' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS h FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS w, CAST(2 * source_size AS DOUBLE) AS cap FROM sources),
levels AS (
  SELECT *, cap / w AS ratio, (1.5::DOUBLE * sum(source_size) OVER ()
    - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
goals AS (
  SELECT source, source_size,
    least((SELECT level FROM levels WHERE level <= ratio ORDER BY ratio, source NULLS LAST LIMIT 1) * w, cap) AS target FROM levels),
placed AS (
  SELECT doc_id, size, source_size, target, s.source, CAST(floor(target) AS BIGINT) AS t, CAST(coalesce(sum(size) OVER (
    PARTITION BY s.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS head, row_number() OVER () AS id
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source),
counts AS (
  SELECT source, CAST(ceil(floor(target) / 1024) AS BIGINT) AS n FROM goals),
firsts AS (
  SELECT source, n, CAST(coalesce(sum(n) OVER (ORDER BY source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first,
    CAST(greatest(1, length(ltrim(bin(greatest(CAST(sum(n) OVER () AS BIGINT), 1) - 1), '0'))) AS INTEGER) AS bits FROM counts),
points AS (
  SELECT source, bits, first + unnest(range(n)) AS p FROM firsts),
reversed AS (
  SELECT source, list_sum([((p >> k) & 1) << (bits - 1 - k) FOR k IN range(bits)]) AS slot FROM points),
slots AS (
  SELECT source, CAST(slot AS BIGINT) AS slot, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank FROM reversed),
turns AS (
  SELECT id, source, size, t, head + e * source_size AS start FROM placed, range(2) r(e) WHERE size > 0 AND head + e * source_size < t),
covers AS (
  SELECT id, source, unnest(range(start // 1024, (least(start + size, t) - 1) // 1024 + 1)) AS rank FROM turns),
played AS (
  SELECT id, count(*) AS n_slots, min(slot) AS first_slot FROM covers c JOIN slots s ON c.source IS NOT DISTINCT FROM s.source AND c.rank = s.rank GROUP BY id)
SELECT doc_id, size, source_size, target,
  CAST(greatest(0, least(size, t - head)) + greatest(0, least(size, t - source_size - head)) AS BIGINT) AS taken,
  coalesce(n_slots, 0) AS n_slots, first_slot FROM placed LEFT JOIN played USING (id)"""
}
