"""Multiple-instance learning of toxicity: a document is a bag of sentences, its probability is the noisy-or of
theirs, and only documents have labels. The sentences that make a document toxic are found on the way.

A sentence's log-odds are a bias and the weights of the words and word beginnings in it, each counted once, so words
that were never seen count by how they begin. Sentences without any such feature say nothing, nor do those below
``FLOOR``. The model is fitted on a bounded sample of labelled rows (``MAX_TRAIN`` of each
label, texts up to ``MAX_TRAIN_CHARS``); scoring reads every text whole.

Edge cases: null, empty and wordless texts score 0; a very long text has the score of its telling sentences, however
many others; equal texts have equal scores; an empty table gives an empty result; rows with a null id are scored and count as not held
out; repeated rows are scored each; columns other than the id and the text are never read, labels only for
fitting. Without labelled rows of both kinds the model is the bias alone.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_batches, saved

MAX_TRAIN = 2500
MAX_TRAIN_CHARS = 20_000
THRESHOLD = 0.7
#: Sentences below it aren't evidence, so that length alone never adds up to toxicity.
FLOOR = 0.05
_SENTENCE = re.compile(r"[^.!?\n]+")
_EDGES = "\t\n\x0b\x0c\r ,;:|*&%$#!?.\"'()[]{}<>-_/\\«»“”‘’"
LENGTHS = (3, 4, 5)


def features(word: str) -> list[str]:
    """A bare lower-case word's features: itself and its beginnings."""
    return [f"={word}", *(word[:k] for k in LENGTHS if len(word) >= k)]


class Weights(dict):
    """The weighted features of a raw word, as pairs; known words are kept, up to ``keep``."""

    def __init__(self, weights: dict[str, float], keep: int = 400_000) -> None:
        super().__init__()
        self.weights, self.keep = weights, keep

    def __missing__(self, raw: str) -> tuple[tuple[str, float], ...]:
        if len(self) > self.keep:
            self.clear()
        word = raw.lower().strip(_EDGES)
        got = self[raw] = tuple((f, self.weights[f]) for f in features(word) if f in self.weights) if word else ()
        return got


def sentences(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _SENTENCE.finditer(text) if not m[0].isspace()]


def score(text: str | None, bias: float, known: Weights) -> tuple[float, int, list[tuple[int, int, float]]]:
    """Noisy-or of a text's sentences, their number, and (start, end, probability) of the offending ones."""
    if not isinstance(text, str):
        return 0.0, 0, []
    spans = sentences(text)
    left, found = 0.0, []
    for a, b in spans:
        # a feature counts once in a sentence, as in training
        own = {f: w for pairs in map(known.__getitem__, set(text[a:b].split())) if pairs for f, w in pairs}
        if own:
            p = 1 / (1 + np.exp(-max(-40.0, min(40.0, sum(own.values()) + bias))))
            if p >= FLOOR:
                left += np.log1p(-min(p, 1 - 1e-12))
            if p >= 0.5:
                found.append((a, b, float(p)))
    return float(-np.expm1(left)), len(spans), found


def fit(bags: list[list[list[str]]], labels: list[int], rounds: int = 150, rate: float = 0.15, ridge: float = 2e-3) -> tuple[float, dict[str, float]]:
    """Bias and weights by gradient ascent (Adam) on the noisy-or likelihood of the documents' labels.

    Features are kept if documents of one label have them clearly oftener: a chi-square above 9.
    """
    y = np.array(labels, np.float64)
    if not len(y) or y.min() == y.max():
        return -8.0, {}
    docs = [{f for s in bag for f in s} for bag in bags]
    of = [Counter(), Counter()]
    for d, label in zip(docs, labels, strict=True):
        of[label].update(d)
    n1, n0 = y.sum(), len(y) - y.sum()
    names = []
    for f in set(of[0]) | set(of[1]):
        a, b = of[1][f], of[0][f]
        expected = (a + b) * n1 / (n1 + n0)
        if a + b >= 3 and (a - expected) ** 2 / expected + (b - (a + b - expected)) ** 2 / (a + b - expected) > 9:
            names.append(f)
    names.sort()
    index = {f: k for k, f in enumerate(names)}
    rows, columns, bag_of = [], [], []
    for d, bag in enumerate(bags):
        for s in bag:
            got = {index[f] for f in s if f in index}
            if got:
                rows += [len(bag_of)] * len(got)
                columns += got
                bag_of.append(d)
    rows, columns, bag_of = np.array(rows, np.int64), np.array(columns, np.int64), np.array(bag_of, np.int64)
    w, bias = np.zeros(len(names)), -4.0
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for t in range(1, rounds + 1):
        z = np.clip(bias + np.bincount(rows, w[columns], len(bag_of)), -30, 30)
        p = 1 / (1 + np.exp(-z))
        # sentences without a feature say nothing
        miss = np.bincount(bag_of, np.log1p(-np.minimum(p, 1 - 1e-12)), len(bags))
        whole = np.clip(-np.expm1(miss), 1e-12, 1)
        # d log-likelihood / d z of a sentence: p of it, times (1 - P) / P in toxic documents, minus p in others
        pull = np.where(y == 1, (1 - whole) / whole, -1.0)
        g = np.zeros(len(names) + 1)
        s = pull[bag_of] * p
        g[:-1] = np.bincount(columns, s[rows], len(names)) / len(bags) - ridge * w / 10
        g[-1] = s.sum() / len(bags)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w, bias = w + step[:-1], max(-12.0, bias + float(step[-1]))
    return float(bias), {f: float(x) for f, x in zip(names, w, strict=True) if abs(x) > 0.05}


def is_held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int, chars: int) -> list[tuple[str, int]]:
    """(text, label) of at most ``most`` rows of each label: those with the smallest hashes of their ids."""
    known = labels.where(F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("y"))
    picked = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        picked = part if picked is None else picked.unionByName(part)
    picked = saved(picked, "picked")  # at most 2 * most rows: a bounded broadcast
    got = docs.where(F.length("text") <= chars).join(F.broadcast(picked), "doc_id").select("doc_id", "text", "y")
    # an id that repeats teaches once
    one = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "y")
    got = got.withColumn("r", F.row_number().over(one)).where("r = 1")
    return [(r["text"], r["y"]) for r in got.orderBy("doc_id").collect()]


def train(docs: DataFrame, labels: DataFrame) -> tuple[float, dict[str, float]]:
    rows = training_rows(docs.where(~is_held_out(F.col("doc_id"))).select("doc_id", "text"), labels.where(~is_held_out(F.col("doc_id"))), "toxic", MAX_TRAIN, MAX_TRAIN_CHARS)
    cache: dict[str, list[str]] = {}

    def bag(text: str) -> list[list[str]]:
        out = []
        for a, b in sentences(text):
            fs: list[str] = []
            for raw in set(text[a:b].split()):
                if raw not in cache:
                    word = raw.lower().strip(_EDGES)
                    cache[raw] = features(word) if word else []
                fs += cache[raw]
            out.append(fs)
        return out

    return fit([bag(t) for t, _ in rows], [y for _, y in rows])


SCORED = "doc_id string, score double, n_sentences int, offending array<struct<start:int,end:int,p:double>>"


def scored(docs: DataFrame, model: tuple[float, dict[str, float]]) -> DataFrame:
    """doc_id, score, n_sentences and the offending sentences (code point spans) of every row."""
    bias, weights = model
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # as many as fit() keeps of a bounded sample

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Weights(shared.value)
        for b in batches:
            got = [score(t, bias, known) for t in b["text"].tolist()]
            yield pd.DataFrame({
                "doc_id": b["doc_id"], "score": [g[0] for g in got], "n_sentences": [g[1] for g in got],
                "offending": [[{"start": s, "end": e, "p": p} for s, e, p in g[2]] for g in got],
            })

    bounded_batches(docs.sparkSession)
    # ids pass through Python as text: pandas would make nullable ones floats
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, SCORED)
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, model).select(
        "doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_sentences", "offending",
    )


QUERIES = {"op3_toxicity": op3_toxicity}
SQL = {}
