"""Minimum bin slack packing: documents are cut into windows of the capacity and a rest, and each window of
rests is the multiset of remaining lengths that a bitset subset-sum finds closest to the capacity.

The plan needs the histogram of lengths only, at most ``capacity`` rows however large the corpus: a multiset
found once is used for as many windows as the counts allow, so there are at most about ``capacity`` different
ones. Pieces then take their places by their rank among pieces of the same length; a length that a third of
all pieces share is ranked in buckets (see ``common.running``).

Edge cases: of equally good multisets the one of longer pieces is taken, and pieces of equal length take their
places in the order of a hash of their id; a null or empty text is the end mark alone; a repeated row is packed once for each time it
occurs; a text of any length is cut into whole windows first; an empty table gives an empty result. Columns
other than the id and the text are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, bucket_count, bucket_of, md5_bits, running, saved

CAPACITY = 4096
END = 2
VOCABULARY = "word_bpe_49k.json"


class Ids:
    """A tokenizer's ids of whole texts as little-endian bytes.

    The tokenizer splits a lower-cased text by rule and merges inside the pieces only, so ids of a text are
    those of its pieces in order. Pieces met before are kept, up to ``keep`` of them. Texts of characters
    beyond Latin-1, for which lower case and classes may differ between libraries, and texts with a special token
    in them go to the tokenizer whole.
    """

    #: The tokenizer's own split rule, for lower-case Latin-1.
    _SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\\sa-z0-9ªµºß-öø-ÿ²³¹¼½¾]+")

    def __init__(self, path: str, keep: int = 900_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # such texts have ids of their own wherever they stand
        self.special = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.keep = keep
        self.pieces: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def split(self, text: str) -> list[str] | None:
        """A text's pieces; None if only the tokenizer can tell."""
        # these four are white space to Python alone
        if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
            return None
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        text = text.lower()
        if any(t in text for t in self.special):
            return None
        return self._SPLIT.findall(text)

    def of(self, texts: list[str]) -> Iterator[bytes]:
        known = self.pieces
        for at in range(0, len(texts), 64):
            part = texts[at : at + 64]
            if len(known) > self.keep:
                known.clear()
            split = [self.split(t) for t in part]
            found = [None if s is None else list(map(known.get, s)) for s in split]
            gaps = {p for s, f in zip(split, found, strict=True) if s for p, ids in zip(s, f, strict=True) if ids is None}
            new = list(gaps)
            known.update(zip(new, self.whole(new), strict=True))
            for t, s, f in zip(part, split, found, strict=True):
                if s is None:
                    yield self.whole([t])[0]
                else:
                    yield b"".join(ids if ids is not None else known[p] for p, ids in zip(s, f, strict=True)) if None in f else b"".join(f)


@lru_cache(maxsize=2)
def ids_of(path: str) -> Ids:
    return Ids(path)


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """Pieces of every document (doc_id, text): windows of the whole capacity, then the rest."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = ids_of(path or vocabulary())
        mark = np.array([END], dtype="<u4").tobytes()
        for batch in batches:
            out: list[tuple] = []
            texts = [t if isinstance(t, str) else "" for t in batch["text"].tolist()]
            for doc, raw in zip(batch["doc_id"].tolist(), ids.of(texts), strict=True):
                raw += mark
                n = len(raw) // 4
                for at in range(0, n, capacity):
                    part = raw[4 * at : 4 * (at + capacity)]
                    out.append((doc, at, len(part) // 4, zlib.crc32(part), n))
            yield pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    bounded_batches(docs.sparkSession)
    # ids pass through Python as text: pandas would make nullable ones floats
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, PIECES.replace("doc_id long", "doc_id string"))
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))


def fill(counts: dict[int, int], capacity: int) -> list[int]:
    """A multiset of lengths with the largest one in it whose sum is closest to the capacity, by subset sum.

    Bit s of a set is up if some multiset sums to s. The sets after each step are kept, so the way back
    tells how often each length is used.
    """
    first = max(counts)
    room = capacity - first
    full = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left = min(counts[length] - (length == first), room // length)
        chunk = 1
        while left > 0:
            take = min(chunk, left)
            grown = (reach | reach << (take * length)) & full
            if grown != reach:
                steps.append((reach, take, length))
                reach = grown
            left -= take
            chunk *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    used = [first]
    for before, take, length in reversed(steps):
        if not before >> total & 1:
            used += [length] * take
            total -= take * length
    return used


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """(lengths of a window, number of such windows), until no piece is left."""
    counts = {k: v for k, v in histogram.items() if v > 0}
    out = []
    while counts:
        lengths = fill(counts, capacity)
        uses = {x: lengths.count(x) for x in set(lengths)}
        times = min(counts[x] // n for x, n in uses.items())
        out.append((sorted(lengths, reverse=True), times))
        for x, n in uses.items():
            counts[x] -= n * times
            if not counts[x]:
                del counts[x]
    return out


def places(windows: list[tuple[list[int], int]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, pieces a window, first window, offset in the window), by rank."""
    rank: dict[int, int] = {}
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    base = 0
    for lengths, times in windows:
        at = 0
        for x in sorted(set(lengths), reverse=True):
            n = lengths.count(x)
            found.setdefault(x, []).append((rank.get(x, 0), n, base, at))
            rank[x] = rank.get(x, 0) + n * times
            at += n * x
        base += times
    return {x: np.array(rows, dtype=np.int64) for x, rows in found.items()}


PACKED = PIECES + ", sequence_id long, offset long"


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces of at most ``capacity``; sequences are numbered from 0."""
    spark = pieces.sparkSession
    spread = bucket_count(pieces.count())
    put = pieces.withColumn("_bits", md5_bits(F.lit("pack"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("start").cast("string")))
    put = put.withColumn("bucket", bucket_of(F.col("_bits"), spread)).withColumn("_one", F.lit(1).cast("long"))
    totals = put.groupBy("length", "bucket").agg(F.sum("_one").alias("total_rank"))
    # at most ``capacity`` rows come to the driver, whatever the corpus
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    where = spark.sparkContext.broadcast(places(plan(histogram, capacity)))
    ranked = running(put, "length", "_bits", ["doc_id", "start", "ids_crc32"], spread, totals, rank="_one")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = where.value
        for b in batches:
            sequence, offset = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
            lengths, ranks = b["length"].to_numpy(np.int64), b["rank"].to_numpy(np.int64)
            order = np.argsort(lengths, kind="stable")
            for group in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(b) else []:
                rows = table[int(lengths[group[0]])]
                r = ranks[group]
                k = np.searchsorted(rows[:, 0], r, side="right") - 1
                inside = r - rows[k, 0]
                sequence[group] = rows[k, 2] + inside // rows[k, 1]
                offset[group] = rows[k, 3] + inside % rows[k, 1] * lengths[group]
            yield b.assign(sequence_id=sequence, offset=offset)[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    return ranked.select(F.col("doc_id").cast("string").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "rank").mapInPandas(run, PACKED.replace("doc_id long", "doc_id string")).withColumn("doc_id", F.col("doc_id").cast("long"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(saved(cut(docs), "pieces"))


QUERIES = {"op2_packing": op2_packing}
SQL = {}
