"""Sparse vectors and the inverted index as tables."""

from __future__ import annotations

from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from textloom.functions.hashing import fnv1a_all
from textloom.functions.text import text_is_rich, tokens

DIM = 384
K1, B = 1.2, 0.75


def grams(toks: Column) -> Column:
    """(gram, weight) of each token (1) and each pair of neighbours (0.5)."""
    one = F.transform(toks, lambda t: F.struct(t.alias("gram"), F.lit(1.0).alias("weight")))
    two = F.transform(
        F.arrays_zip(F.slice(toks, F.lit(1), F.greatest(F.size(toks) - 1, F.lit(0))).alias("a"), F.slice(toks, F.lit(2), F.size(toks)).alias("b")),
        lambda p: F.struct(F.concat_ws(" ", p["a"], p["b"]).alias("gram"), F.lit(0.5).alias("weight")),
    )
    return F.concat(one, F.when(F.size(toks) > 1, two).otherwise(F.slice(one, 1, 0)))


def vectors_of(tokens: list[list[str]], dim: int = DIM) -> np.ndarray:
    """A dense row for each list of tokens: hashed counts of tokens and pairs, dampened and scaled to length 1.

    Distinct tokens of the lists are hashed once; a pair's hash goes on from that of its first token.
    """
    sizes = np.array([len(t) for t in tokens], np.int64)
    codes, names = pd.factorize(np.array([w for t in tokens for w in t], object)) if sizes.sum() else (np.zeros(0, np.int64), [])
    rows = np.repeat(np.arange(len(tokens)), sizes)
    own = fnv1a_all(list(names))
    same = rows[1:] == rows[:-1]
    pairs, at = np.unique(codes[:-1][same] * len(names) + codes[1:][same], return_inverse=True)
    two = fnv1a_all([f" {names[k]}" for k in (pairs % max(len(names), 1)).tolist()], own[pairs // max(len(names), 1)])
    place = np.concatenate([rows * dim + own[codes] % dim, rows[1:][same] * dim + two[at] % dim]) if len(codes) else np.zeros(0, np.int64)
    weight = np.concatenate([np.ones(len(codes)), np.full(len(at), 0.5)])
    v = np.bincount(place, weight, len(tokens) * dim).reshape(len(tokens), dim)
    w = np.where(v > 0, 1 + np.log(np.where(v > 0, v, 1)), 0.0)
    norm = np.sqrt((w * w).sum(1, keepdims=True))
    return w / np.where(norm > 0, norm, 1)


@F.pandas_udf(ArrayType(DoubleType()))
def vector(toks: pd.Series) -> pd.Series:
    """A dense vector for each array of tokens."""
    return pd.Series(list(vectors_of([[] if t is None else list(t) for t in toks])))


def embed(rows: DataFrame, key: str, toks: str = "toks") -> DataFrame:
    """(key, bucket, w): the buckets of ``vector`` that something falls into."""
    return rows.select(key, F.posexplode(vector(F.col(toks))).alias("bucket", "w")).where("w <> 0")


def l2_normalize(v: Column) -> Column:
    v = v.cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(F.array(norm), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v))[0]


def cosine(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


@dataclass
class Index:
    """postings (term, chunk_id, doc_len, tf), stats (chunk_id, doc_len, valid, tok_str, page, text), corpus (n, avgdl), terms (term, df, idf).

    A chunk's place in the ranking needs nothing but its row of stats; its vector is made of the tokens there.
    """

    postings: DataFrame
    stats: DataFrame
    corpus: DataFrame
    terms: DataFrame

    @property
    def vectors(self) -> DataFrame:
        """(chunk_id, bucket, w)."""
        return embed(self.stats.select("chunk_id", stored_tokens()), "chunk_id")

    def cached(self) -> Index:
        # postings are many times the rest and ranking doesn't read them
        for t in (self.stats, self.terms, self.corpus):
            t.cache()
        return self

    def save(self, path: str) -> Index:
        """Writes the tables under a folder and reads them back: built once, asked often."""
        for f in fields(self):
            getattr(self, f.name).write.mode("overwrite").parquet(f"{path}/{f.name}")
        return Index.load(self.stats.sparkSession, path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Index:
        return Index(**{f.name: spark.read.parquet(f"{path}/{f.name}") for f in fields(Index)})


def tokenized(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("toks", tokens(F.col("text")))


def chunk_stats(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select(
        "chunk_id", F.size("toks").alias("doc_len"), text_is_rich(F.col("text"), F.size("toks")).alias("valid"),
        F.array_join("toks", " ").alias("tok_str"), F.col("page_start").alias("page"), "text", *more,
    )


def corpus_stats(stats: DataFrame) -> DataFrame:
    return stats.agg(F.count("*").alias("n"), F.greatest(F.lit(1.0), F.coalesce(F.avg("doc_len"), F.lit(0.0))).alias("avgdl"))


def postings(rows: DataFrame) -> DataFrame:
    return rows.select("chunk_id", F.size("toks").alias("doc_len"), F.explode("toks").alias("term")).groupBy("term", "chunk_id", "doc_len").agg(F.count("*").alias("tf"))


def idf(df: Column, n: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def stored_tokens() -> Column:
    return F.array_remove(F.split("tok_str", " "), "").alias("toks")


def build_index(chunks: DataFrame) -> Index:
    """Chunks are tokenised once: every table is made of the tokens in ``stats``."""
    return index_of(chunk_stats(tokenized(chunks)).cache())


def index_of(stats: DataFrame) -> Index:
    """The index of a table of stats; what only searches for scores can leave out ``page`` and ``text``."""
    post = postings(stats.select("chunk_id", stored_tokens()))
    corpus = corpus_stats(stats)
    counts = stats.select(F.explode(F.array_distinct(stored_tokens())).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    # the corpus is one row: a broadcast of it is bounded
    terms = counts.crossJoin(F.broadcast(corpus)).select("term", "df", idf(F.col("df"), F.col("n")).alias("idf"))
    return Index(post, stats, corpus, terms)
