"""Co-training of document quality: a classifier of the text's words and one of the page's metadata teach each
other their surest unlabelled rows over some rounds; calibrated, both are combined into one score.

The text view reads words, their shapes (letters by case, digits, other marks as they are) and how they repeat. The metadata
view never looks at words: it has source, language, length, and the layout of lines. Both are logistic models
fitted on bounded samples (``MAX_TRAIN`` labelled and ``MAX_POOL`` unlabelled rows, of any length: their views are
made where they lie, and only those go to the one task that fits); every document is scored whole. A fifth of the labelled rows
teaches neither view: it calibrates them and says how much each counts in the combined score.

Edge cases: null and empty texts are scored from what they have (no words, length 0); a very long text has shares of
its words like any other; equal rows have equal scores, and a row at the threshold is kept; null sources and
languages are values like others; repeated rows and null ids are scored each, an id that repeats teaches once; a
column missing from the input counts as null, other columns aren't read; without labelled rows of both kinds every
score is 0.5; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import operator
import pickle
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_batches, saved

MAX_TRAIN = 2000
MAX_POOL = 2000
ROUNDS = 4
SURE = 100
#: Log-odds from which a view's guess may teach the other.
SURE_ODDS = 1.0
#: Documents scoring below this are rejected: those four times likelier to be bad than good.
KEEP = 0.2
DIM = 1 << 15

_SHAPE = [(re.compile(r"[a-zß-öø-ÿ]+"), "x"), (re.compile(r"[A-ZÀ-ÖØ-Þ]+"), "X"), (re.compile(r"[0-9]+"), "0")]


def _slot(name: str) -> int:
    import zlib

    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % DIM


class Slots(dict):
    """The two feature slots of a raw word: itself in lower case, and its shape."""

    def __missing__(self, raw: str) -> tuple[int, int]:
        if len(self) > 400_000:
            self.clear()
        shape = raw
        for pattern, mark in _SHAPE:
            shape = pattern.sub(mark, shape)
        got = self[raw] = (_slot("w" + raw.lower()), _slot("s" + shape))
        return got


_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_DIGITS = b"0123456789"
_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
MEASURES = ("distinct", "again", "upper", "digits", "marks", "width")


def text_view(text: str, slots: Slots) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of a text: its words and shapes (roots of their shares), then what can be measured of the words."""
    words = text.split()
    if not words:
        return np.array([_slot("none")]), np.ones(1)
    flat = np.array([slots[w] for w in words]).ravel()
    at, n = np.unique(flat, return_counts=True)
    raw = text.encode("utf-8", "surrogatepass")
    rate = lambda kind: 10 * (len(raw) - len(raw.translate(None, kind))) / len(raw)
    again = sum(map(operator.eq, words, words[1:]))
    values = (len(set(words)) / len(words), again / len(words), rate(_UPPER), rate(_DIGITS), rate(_MARKS), len(raw) / len(words) / 10)
    return np.append(at, [_slot(f"#{m}") for m in MEASURES]), np.append(np.sqrt(n / len(words)), values)


NUMBERS = 8


def metadata_view(text: str, source: str | None, lang: str | None) -> np.ndarray:
    """Numbers of a page's length and layout, then where source and language are hashed to."""
    lines = text.split("\n")
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    out = np.zeros(NUMBERS + 64)
    out[:NUMBERS] = (
        1.0, math.log1p(len(text)) / 10, math.log1p(len(lines)) / 5, math.log1p(len(text) / len(lines)) / 10, math.log1p(int(sizes.max())) / 10,
        float((sizes == 0).mean()), len(set(lines)) / len(lines), float(not text),
    )
    out[NUMBERS + _slot(f"source{source}") % 48] = 0.3
    out[NUMBERS + 48 + _slot(f"lang{lang}") % 16] = 0.3
    return out


class Logistic:
    """Logistic regression on a dense or hashed view, by full-batch Adam; rows may have weights."""

    def __init__(self, size: int) -> None:
        self.w, self.b = np.zeros(size), 0.0

    def fit(self, rows: np.ndarray, at: np.ndarray, values: np.ndarray, y: np.ndarray, steps: int = 200, rate: float = 0.2, ridge: float = 1e-5) -> Logistic:
        """rows, at, values: the view's entries; y: labels, both kinds of the same total weight."""
        weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
        m, v = np.zeros(len(self.w) + 1), np.zeros(len(self.w) + 1)
        for t in range(1, steps + 1):
            p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, values * self.w[at], len(y)) + self.b, -30, 30)))
            e = (p - y) * weight
            g = np.append(np.bincount(at, values * e[rows], len(self.w)) + ridge * self.w, e.sum())
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            self.w, self.b = self.w - step[:-1], self.b - float(step[-1])
        return self


def _entries(view: list[tuple[np.ndarray, np.ndarray]], pick: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = np.repeat(np.arange(len(pick)), [len(view[i][0]) for i in pick])
    return rows, np.concatenate([view[i][0] for i in pick]), np.concatenate([view[i][1] for i in pick])


def _logits(model: Logistic, view: list[tuple[np.ndarray, np.ndarray]], pick: np.ndarray) -> np.ndarray:
    rows, at, values = _entries(view, pick)
    return np.bincount(rows, values * model.w[at], len(pick)) + model.b


def combined(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and offset (last) that turn rows of log-odds z into the labels' odds (smoothed targets, Newton steps)."""
    n1, n0 = y.sum(), (1 - y).sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.column_stack([z, np.ones(len(z))])
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), 1e-2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (p - t) + ridge * w)
        w = w - np.clip(step, -1, 1)
        if abs(step).max() < 1e-6:
            break
    return w


class Model:
    """Both views' models, the calibration of each, and that of both together."""

    def __init__(self, text: Logistic, meta: Logistic, text_cal: np.ndarray, meta_cal: np.ndarray, both: np.ndarray) -> None:
        self.text, self.meta, self.text_cal, self.meta_cal, self.both = text, meta, text_cal, meta_cal, both
        self.slots = Slots()

    def scores(self, text: str | None, source: str | None, lang: str | None) -> list[float]:
        """Probabilities of good quality by the text, by the metadata and by both."""
        text, source, lang = (x if isinstance(x, str) else None for x in (text, source, lang))
        at, values = text_view(text or "", self.slots)
        a = float(values @ self.text.w[at]) + self.text.b
        c = float(metadata_view(text or "", source, lang) @ self.meta.w) + self.meta.b
        odds = (a * self.text_cal[0] + self.text_cal[1], c * self.meta_cal[0] + self.meta_cal[1], a * self.both[0] + c * self.both[1] + self.both[2])
        return [1 / (1 + math.exp(-max(-40.0, min(40.0, float(z))))) for z in odds]


View = list[tuple[np.ndarray, np.ndarray]]


def co_train(one: View, two: View, y: np.ndarray, rounds: int = ROUNDS, sure: int = SURE) -> Model | None:
    """one, two: the rows' text and metadata views; y: 1, 0, or -1 for unlabelled."""
    known = np.flatnonzero(y >= 0)
    if not len(known) or len(set(y[known])) < 2:
        return None
    held = known[::5] if len(set(y[known[::5]])) == 2 and len(known) >= 50 else known
    own = np.setdiff1d(known, held) if len(held) < len(known) else known
    pool = np.flatnonzero(y < 0)
    taught = [dict.fromkeys(own.tolist()) for _ in range(2)]  # rows each view learns from
    label = [{int(i): int(y[i]) for i in own} for _ in range(2)]
    share = float(np.mean(y[own]))
    models: list[Logistic] = []
    for r in range(rounds + 1):
        models = []
        for k, (view, size) in enumerate(((one, DIM), (two, NUMBERS + 64))):
            pick = np.array(list(taught[k]), np.int64)
            models.append(Logistic(size).fit(*_entries(view, pick), np.array([label[k][int(i)] for i in pick], float)))
        if r == rounds or not len(pool):
            break
        for k, view in enumerate((one, two)):
            # the surest rows of this view, in the labels' proportion, go to the other view
            left = np.array([i for i in pool.tolist() if i not in taught[1 - k]], np.int64)
            if not len(left):
                continue
            z = _logits(models[k], view, left)
            order = np.argsort(z, kind="stable")
            bad, good = order[: max(1, round(sure * (1 - share)))], order[::-1][: max(1, round(sure * share))]
            for i, v in [(i, 0) for i in bad if z[i] < -SURE_ODDS] + [(i, 1) for i in good if z[i] > SURE_ODDS]:
                taught[1 - k][int(left[i])] = None
                label[1 - k][int(left[i])] = v
    z = np.column_stack([_logits(m, v, held) for m, v in zip(models, (one, two), strict=True)])
    yes = y[held].astype(float)
    return Model(models[0], models[1], combined(z[:, :1], yes), combined(z[:, 1:], yes), combined(z, yes))


def training_rows(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """(doc_id, a1, v1, a2, v2, y): both views of labelled and unlabelled rows with the smallest hashes of their ids, at most MAX_TRAIN and MAX_POOL."""
    known = labels.where(F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("y"))
    bad = known.where("y = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TRAIN // 2)
    good = known.where("y = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TRAIN // 2)
    # every fifth hash without a label would do; the least are taken, as many as the bound allows
    free = docs.select("doc_id").join(known.select("doc_id"), "doc_id", "left_anti").orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_POOL)
    picked = saved(bad.unionByName(good).unionByName(free.withColumn("y", F.lit(-1))), "picked")
    # at most MAX_TRAIN + MAX_POOL rows: a bounded broadcast; an id that repeats teaches once
    one = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "source", "lang", "y")
    got = docs.join(F.broadcast(picked.dropDuplicates(["doc_id"])), "doc_id").withColumn("r", F.row_number().over(one)).where("r = 1")

    def views(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slots = Slots()
        every = np.arange(NUMBERS + 64)
        for b in batches:
            out = []
            for i, t, s, g, y in zip(b["doc_id"], b["text"], b["source"], b["lang"], b["y"], strict=True):
                t, s, g = (x if isinstance(x, str) else None for x in (t, s, g))
                at, values = text_view(t or "", slots)
                out.append((i, at, values, every, metadata_view(t or "", s, g), y))
            yield pd.DataFrame(out, columns=["doc_id", "a1", "v1", "a2", "v2", "y"])

    bounded_batches(docs.sparkSession)
    rows = got.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "source", "lang", "y")
    rows = rows.mapInPandas(views, "doc_id string, a1 array<long>, v1 array<double>, a2 array<long>, v2 array<double>, y long")
    return rows


def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row: the pickled model of all training rows, or none without labels of both kinds."""
    # a row has at most DIM slots, however long its text
    rows = sorted((r for b in batches for r in b.itertuples(index=False)), key=lambda r: (hash_of(r.doc_id), r.doc_id))
    one = [(np.asarray(r.a1, np.int64), np.asarray(r.v1, float)) for r in rows]
    two = [(np.asarray(r.a2, np.int64), np.asarray(r.v2, float)) for r in rows]
    model = co_train(one, two, np.array([r.y for r in rows], np.int64))
    yield pd.DataFrame({"model": [None if model is None else pickle.dumps(model)]})


def hash_of(name: str) -> int:
    """A number that orders training rows without regard to their ids' order."""
    import zlib

    return zlib.crc32(name.encode())


def _with_columns(docs: DataFrame) -> DataFrame:
    have = set(docs.columns)
    return docs.select("doc_id", "text", *[F.col(c).cast("string").alias(c) if c in have else F.lit(None).cast("string").alias(c) for c in ("source", "lang")])


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Fitted in one task, as the bounded rows are many times the model: the driver gets nothing but the model."""
    got = training_rows(_with_columns(docs), labels).repartition(1).mapInPandas(fitted, "model binary").first()
    return pickle.loads(bytes(got["model"])) if got and got["model"] is not None else None


VIEWS = "text_score double, meta_score double, score double"


def score_rows(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, text_score, meta_score and score (probability of good quality) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIM weights and a few more

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            rows = zip(b["text"].tolist(), b["source"].tolist(), b["lang"].tolist(), strict=True)
            out = np.array([m.scores(*r) if m else [0.5] * 3 for r in rows]).reshape(-1, 3)
            yield pd.DataFrame({"doc_id": b["doc_id"], "text_score": out[:, 0], "meta_score": out[:, 1], "score": out[:, 2]})

    bounded_batches(docs.sparkSession)
    # ids pass through Python as text: pandas would make nullable ones floats
    rows = _with_columns(docs).withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(run, "doc_id string, " + VIEWS)
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))


def filtered(docs: DataFrame, model: Model | None, keep: float = KEEP) -> DataFrame:
    """The rows of ``docs`` (all their columns) that score ``keep`` or more; without a model all."""
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    have = docs.columns

    @F.pandas_udf("boolean")
    def good(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for columns in batches:
            yield pd.Series([shared.value.scores(*r)[2] >= keep for r in zip(*(c.tolist() for c in columns), strict=True)], dtype=bool)

    bounded_batches(docs.sparkSession)
    arg = lambda c: F.col(c).cast("string") if c in have else F.lit(None).cast("string")
    return docs.where(good(F.col("text"), arg("source"), arg("lang")))


def op10_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_rows(docs, model).select("doc_id", "text_score", "meta_score", "score", (F.col("score") >= KEEP).alias("kept"))


QUERIES = {"op10_quality_model": op10_quality_model}
SQL = {}
