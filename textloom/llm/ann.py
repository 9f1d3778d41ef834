"""Nearest neighbours by learned partitions: the neighbour graph of a sample is cut into balanced parts, a small
classifier learns which part a vector belongs to, every vector is indexed in its likeliest part, and a query
searches its most probable parts exactly.

The sample (``SAMPLE`` vectors) only fits the classifier; every row is indexed. How many parts a query
searches is read off the sample: the fewest that find ``RECALL`` of its held-out queries' true neighbours.
Equal vectors are one entry with its smallest ids, so copies are searched once and ties still go to smaller
ids. A part is searched in blocks of at most about ``BLOCK`` vectors against blocks of queries. Parts grow with
the table up to ``MAX_PARTS``, then parts of more blocks.

Edge cases: vectors that are null, zero or with null or non-finite components take no part, nor do rows with a null
id. Vectors of another length than most have nearest neighbours among those of their length, all of which are
searched. Rows of the query's own id are no candidates; other rows with one id count each, and each row that asks is
answered. Fewer candidates than k are all returned; tables of a few dozen vectors are one part; an empty table
gives an empty result; columns other than vec_id and embedding aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import saved

K = 20
SAMPLE = 8192
RECALL = 0.95
PART_ROWS = 2048
MAX_PARTS = 256
#: A small table has parts of so many vectors, up to FEW_PARTS.
LEAST_ROWS = 64
FEW_PARTS = 16
BLOCK = 4096


def neighbours(x: np.ndarray, k: int) -> np.ndarray:
    """The k largest inner products of each row with other rows, in blocks."""
    out = np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 1024):
        s = x[at : at + 1024] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        out[at : at + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced(x: np.ndarray, graph: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """Parts of the neighbour graph of nearly equal size that cut few of its edges.

    Starts from a few rounds of nearest centres; then nodes move to the part of most of their neighbours,
    with a price on parts over their share, and finally no part keeps more than 1.1 shares.
    """
    n = len(x)
    centres = x[rng.choice(n, parts, replace=False)]
    for _ in range(6):
        label = np.argmax(x @ centres.T - 0.5 * (centres**2).sum(1), axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, label, x)
        size = np.bincount(label, minlength=parts)
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], x[rng.choice(n, parts)])
    rows = np.repeat(np.arange(n), graph.shape[1])
    share = n / parts
    for r in range(12):
        votes = np.bincount(rows * parts + label[graph.ravel()], minlength=n * parts).reshape(n, parts).astype(float)
        votes += np.bincount(graph.ravel() * parts + label[rows], minlength=n * parts).reshape(n, parts)
        size = np.bincount(label, minlength=parts)
        votes -= graph.shape[1] * 0.5 * np.maximum(size / share - 1, -0.5) * (r + 1) / 6
        move = rng.random(n) < 0.5
        label = np.where(move, np.argmax(votes, axis=1), label)
    most = int(np.ceil(1.1 * share))
    order = np.argsort(-votes.max(axis=1))
    rank = np.argsort(-votes, axis=1)
    size = np.zeros(parts, np.int64)
    for i in order:
        for p in rank[i]:
            if size[p] < most:
                label[i] = p
                size[p] += 1
                break
    return label


class Router:
    """A softmax over parts from one hidden layer."""

    def __init__(self, w1: np.ndarray, b1: np.ndarray, w2: np.ndarray, b2: np.ndarray) -> None:
        self.w = (w1, b1, w2, b2)

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.w
        return np.maximum(x @ w1 + b1, 0) @ w2 + b2

    @staticmethod
    def fit(x: np.ndarray, label: np.ndarray, parts: int, rng: np.random.Generator, hidden: int = 128, epochs: int = 20) -> Router:
        d = x.shape[1]
        p = [rng.normal(0, (2 / d) ** 0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, (1 / hidden) ** 0.5, (hidden, parts)), np.zeros(parts)]
        m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), 256):
                i = order[at : at + 256]
                h = np.maximum(x[i] @ p[0] + p[1], 0)
                z = h @ p[2] + p[3]
                z = np.exp(z - z.max(1, keepdims=True))
                z /= z.sum(1, keepdims=True)
                z[np.arange(len(i)), label[i]] -= 1
                z /= len(i)
                back = (z @ p[2].T) * (h > 0)
                grads = [x[i].T @ back, back.sum(0), h.T @ z, z.sum(0)]
                t += 1
                for k, g in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    p[k] -= 4e-3 * (1 - epoch / epochs) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        return Router(*p)


def learn(sample: np.ndarray, parts: int, seed: int = 7) -> tuple[Router | None, int]:
    """The router and the number of parts to search."""
    if parts < 2 or len(sample) < 32 * parts:
        return None, 1
    rng = np.random.default_rng(seed)
    cut = len(sample) // 10
    x, asked = sample[cut:], sample[:cut]
    label = balanced(x, neighbours(x, 10), parts, rng)
    router = Router.fit(x, label, parts, rng)
    put = np.argmax(router.logits(x), axis=1)
    true = np.argsort(-(asked @ x.T), axis=1)[:, :K]
    order = np.argsort(-router.logits(asked), axis=1)
    place = np.argsort(order, axis=1)  # rank of each part for each query
    at = np.take_along_axis(place, put[true], axis=1)
    for probes in range(1, parts + 1):
        if (at < probes).mean() >= RECALL:
            return router, min(parts, probes + 1)
    return router, parts


def search(queries: DataFrame, vectors: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: for each row (vec_id, embedding) of queries its k nearest rows of vectors."""
    spark = vectors.sparkSession
    ok = (
        F.col("embedding").isNotNull() & (F.size("embedding") > 0)
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("embedding", lambda x: x != 0)
    )
    clean = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(ok & F.col("vec_id").isNotNull())
    # rows of one id and vector are one with a count; of an id no more than k can be among the nearest
    rows = clean(vectors).groupBy("embedding", "vec_id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("times"))
    # of equal vectors the k + 1 smallest ids can be asked for (one may be the query's own); tasks cut theirs first
    few = rows.withColumn("r", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    entries = few.groupBy("embedding").agg(F.sort_array(F.collect_list(F.struct("vec_id", "times"))).alias("ids"))
    # entry: a name of the vector; only: the id if it is the only one that has the vector
    entries = entries.withColumn("entry", F.monotonically_increasing_id()).withColumn("only", F.when(F.size("ids") == 1, F.col("ids")[0]["vec_id"]))
    entries = saved(entries.withColumn("first", F.col("ids")[0]["vec_id"]).withColumn("second", F.get("ids", F.lit(1))["vec_id"]), "entries")
    width = entries.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if width is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, total = width["d"], width["count"]
    parts = max(1, min(MAX_PARTS, max(total // PART_ROWS, min(FEW_PARTS, total // LEAST_ROWS))))
    picked = entries.where(F.size("embedding") == dim).orderBy(F.xxhash64("embedding"), "first").select("embedding").limit(SAMPLE).toPandas()["embedding"]
    router, probes = learn(np.stack(picked.to_list()), parts)
    shared = spark.sparkContext.broadcast(router)  # bounded: (dim + parts) * 128 numbers

    def best(batches: Iterator[pd.DataFrame], top: int, keep: list[str]) -> Iterator[pd.DataFrame]:
        for b in batches:
            size = b["embedding"].map(len)
            # vectors of another length: a part for each length
            odd = b[size != dim]
            if len(odd):
                yield odd[keep].assign(part=-size[size != dim].astype(np.int64))
            b = b[size == dim]
            if not len(b):
                continue
            if shared.value is None:
                order = np.zeros((len(b), 1), np.int64)
            else:
                z = shared.value.logits(np.stack(b["embedding"].to_list()))
                order = np.argsort(-z, axis=1, kind="stable")[:, :top]
            for j in range(order.shape[1]):
                yield b[keep].assign(part=order[:, j].astype(np.int64))

    index = entries.select("entry", "first", F.coalesce("second", "first").alias("second"), F.col("only").isNotNull().alias("only"), "embedding").mapInPandas(lambda it: best(it, 1, ["entry", "first", "second", "only", "embedding"]), "entry long, first long, second long, only boolean, embedding array<double>, part long")
    index = saved(index, "index")
    asked = clean(queries)
    # equal rows are searched once
    once = saved(asked.groupBy("embedding", "vec_id").agg(F.count("*").alias("asked")).withColumn("q", F.monotonically_increasing_id()), "asked")
    routed = once.select("q", F.col("vec_id").alias("own"), "embedding").mapInPandas(lambda it: best(it, probes, ["q", "own", "embedding"]), "q long, own long, embedding array<double>, part long")
    sizes = index.groupBy("part").agg(F.count("*").alias("c")).select("part", (F.expr(f"(c - 1) div {BLOCK}") + 1).alias("blocks"))
    sizes = F.broadcast(sizes)  # one row a part: MAX_PARTS, and one for each odd length
    left = index.join(sizes, "part").withColumn("block", F.pmod(F.xxhash64("entry"), "blocks")).select("part", "block", "entry", "first", "second", "only", "embedding")
    turns = max(1, once.count() // (BLOCK * parts) + 1)
    left = left.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
    right = routed.join(sizes, "part").select("part", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("block"), F.pmod(F.xxhash64("q"), F.lit(turns)).cast("int").alias("turn"), "q", "own", "embedding")

    def scan(c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(c) or not len(q):
            return pd.DataFrame({"q": np.zeros(0, np.int64), "score": np.zeros(0), "entry": np.zeros(0, np.int64), "first": np.zeros(0, np.int64)})
        x, y = np.stack(c["embedding"].to_list()), np.stack(q["embedding"].to_list())
        entry, first, second = (c[x].to_numpy(np.int64) for x in ("entry", "first", "second"))
        only, names, asks, found = c["only"].to_numpy(bool), q["q"].to_numpy(np.int64), q["own"].to_numpy(np.int64), []
        wide = min(len(x), k + 20)

        def nearest(z: np.ndarray, own: np.ndarray, at: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, ...]:
            """The k best of the vectors at ``at`` for each query: places, scores, smallest ids but the query's own."""
            exact = np.einsum("qd,qkd->qk", z, x[at])  # the same sum wherever a vector stands
            exact = np.where(np.isneginf(np.take_along_axis(s, at, 1)), -np.inf, exact)
            names = np.where(first[at] == own[:, None], second[at], first[at])
            order = np.lexsort((names, -exact))[:, :k]
            return tuple(np.take_along_axis(a, order, 1) for a in (at, exact, names))

        def put(q: np.ndarray, at: np.ndarray, exact: np.ndarray, names: np.ndarray) -> None:
            ok = ~np.isneginf(exact)
            found.append(pd.DataFrame({"q": np.repeat(q, ok.sum(1)), "score": exact[ok], "entry": entry[at[ok]], "first": names[ok]}))

        for lo in range(0, len(y), 512):
            z, own, q_ = y[lo : lo + 512], asks[lo : lo + 512], names[lo : lo + 512]
            s = z @ x.T
            # a vector that only the query's own id has is no candidate
            s[only[None, :] & (first[None, :] == own[:, None])] = -np.inf
            if wide == len(x):
                put(q_, *nearest(z, own, np.broadcast_to(np.arange(len(x)), s.shape), s))
                continue
            top = np.argpartition(-s, wide - 1, axis=1)[:, :wide]
            put(q_, *nearest(z, own, top, s))
            # where more are as near as the last of them, all of those are compared
            last = np.sort(np.take_along_axis(s, top, 1), axis=1)[:, -k]
            as_near = s >= (last - 1e-9 * np.abs(last))[:, None]
            many = np.flatnonzero((as_near.sum(1) > wide) & ~np.isneginf(last))
            if len(many):
                found[-1] = found[-1][~found[-1]["q"].isin(q_[many])]
                for i in many:
                    put(q_[i : i + 1], *nearest(z[i : i + 1], own[i : i + 1], np.flatnonzero(as_near[i])[None, :], s[i : i + 1]))
        return pd.concat(found)

    hits = left.groupBy("part", "block", "turn").cogroup(right.groupBy("part", "block", "turn")).applyInPandas(scan, "q long, score double, entry long, first long")
    # every task cuts its hits to k a query before they are shuffled
    near = Window.partitionBy("q").orderBy(F.desc("score"), "first")
    hits = hits.withColumn("r", F.row_number().over(near)).where(F.col("r") <= k).drop("r", "first")
    named = hits.join(entries.select("entry", "ids"), "entry").select("q", "score", F.inline("ids"))
    named = named.join(once.select("q", F.col("vec_id").alias("own"), "asked"), "q").where("vec_id <> own")
    # an id counts as often as it has rows: those before it say where its own rows come
    before = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    named = named.withColumn("r", F.row_number().over(before)).where(F.col("r") <= k)
    named = named.withColumn("b", F.coalesce(F.sum("times").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where(F.col("b") < k)
    out = named.withColumn("rank", F.explode(F.expr(f"sequence(b + 1, least(b + times, {k}L))")))
    # each row that asked is answered
    out = out.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), "asked")))
    return out.select(F.col("own").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(rows.where("vec_id % 20 = 0"), rows)


QUERIES = {"op8_ann": op8_ann}
SQL = {}
