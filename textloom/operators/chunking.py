"""Overlapping word windows with page tags, hashes and ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.hashing import fnv1a, hex8
from textloom.functions.text import blank_words

MAX_WORDS, OVERLAP = 180, 30
#: Chunk ids order as (document, place): document ids are shifted by so many bits.
CHUNK_BITS = 20


def word_stream(blocks: DataFrame) -> DataFrame:
    """A row a word with its page: (doc_id, block_no, pos, word, page)."""
    return blocks.select("doc_id", "block_no", F.posexplode(blank_words(F.col("text"))).alias("pos", "word"), "page")


def window(max_words: int, overlap: int) -> tuple[int, int]:
    size = max_words if max_words > 0 else MAX_WORDS
    overlap = max(0, overlap)
    if overlap >= size:
        overlap = size // 4
    return size, size - overlap


def chunks(blocks: DataFrame, max_words: int = MAX_WORDS, overlap: int = OVERLAP, hashed: bool = True) -> DataFrame:
    """(doc_id, chunk_no, chunk_id, text, page_start, page_end, n_words, hash): the last window is the first that reaches the end.

    A document's words are gathered once as arrays, so windows are slices: no frame, one shuffle by document.
    """
    size, step = window(max_words, overlap)
    per_block = blocks.select("doc_id", "block_no", "page", blank_words(F.col("text")).alias("w")).where("size(w) > 0")
    # pages as runs: a word's page is found by its block's end
    whole = per_block.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("block_no", "page", "w"))).alias("b"))
    whole = whole.select(
        "doc_id",
        F.flatten(F.transform("b", lambda x: x["w"])).alias("w"),
        F.flatten(F.transform("b", lambda x: F.array_repeat(x["page"], F.size(x["w"])))).alias("p"),
    ).withColumn("n", F.size("w"))
    last = F.when(F.col("n") > size, F.ceil((F.col("n") - size) / step)).otherwise(0).cast("int")
    cut = whole.select("doc_id", "w", "p", "n", F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"))
    first = F.col("chunk_no") * step
    end = F.least(first + size, F.col("n"))
    out = cut.select(
        "doc_id", "chunk_no", (F.shiftleft(F.col("doc_id").cast("long"), CHUNK_BITS) + F.col("chunk_no")).alias("chunk_id"),
        F.array_join(F.slice("w", first + 1, size), " ").alias("text"),
        F.get("p", first).alias("page_start"), F.get("p", end - 1).alias("page_end"), (end - first).alias("n_words"),
    )
    return out.withColumn("hash", hex8(fnv1a("text"))) if hashed else out
