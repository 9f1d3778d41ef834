"""N-gram Jaccard join by filters under several global token orders.

Sets of word shingles link when their Jaccard similarity is at least NEED / 100. Equal texts become one node
first, so copies are never compared. Three orders of all tokens are used, and a pair has to pass each of them
before the sets themselves are fetched (a bitmap of each set is looked at, too):

1. rare tokens first: linked sets share a token of their prefixes, at places that leave room for the overlap
   they need. How frequent a token is, a sketch over all texts tells, of ORDER_WIDTH counters: tokens may share a
   counter, which makes the order coarser but keeps it one order for all sets, and so loses nothing;
2. by hash, upwards: linked sets share so many tokens of the longer prefixes that ``prefix(n)`` cuts;
3. by hash, downwards: likewise.

Groups of near copies are not expanded into pairs: in each bucket of a token every node is compared with the
bucket's most central one first, and only nodes of different components are compared after that.

Edge cases: null and blank texts have empty sets and link with nothing; equal texts share a node; repeated
rows and null ids are kept, and a component's id is its smallest id that isn't null, so ties between equal sets go
to the smaller id; very long texts are one sorted array each; an empty table gives an empty result; columns other
than the id and the text aren't read (``firsts`` carries them along, whatever their names). Tokens are 64-bit
hashes of shingles. Nodes are 64-bit hashes of texts; texts that share one are found by a second hash (MD5) and
get others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .arrays import among, given_away, members, merged
from .common import WORD, bounded_batches, dropped, saved, spread_join
from .components import components

NEED = 80
WORDS = 5
#: Counters of the sketch that says how frequent a token is: a fixed size, broadcast.
ORDER_WIDTH = 1 << 20
#: Tokens in more sets than this (or than a 65,536th of all tokens) are shuffled summed, never as rows by token.
OFTEN = 1024
#: Rows of a block when a bucket's rest is compared; larger buckets are cut into pairs of blocks.
BLOCK = 2048
#: Buckets of at most so many nodes are joined with themselves.
SMALL = 64


class _Words:
    """64-bit hashes of words for many bytes at once: running sums of r ** place * (a random number of the byte).

    A word's hash is what the sum grows by over it, moved back to place 0. Letters A-Z have the numbers of a-z.
    """

    STEP = 1 << 20
    #: 3 modulo 8: powers of it differ in their lowest bits.
    R = 0x9E3779B97F4A7C13
    SPACES = b" \t\n\x0b\x0c\r"

    def __init__(self) -> None:
        self.number = np.random.default_rng(20).integers(0, 1 << 64, 256, np.uint64)
        self.number[65:91] = self.number[97:123]
        self.space = np.zeros(256, bool)
        self.space[list(self.SPACES)] = True
        self.up, self.down = self.powers(self.R, self.STEP), self.powers(pow(self.R, -1, 1 << 64), self.STEP)

    @staticmethod
    def powers(r: int, n: int) -> np.ndarray:
        out = np.full(n, r, np.uint64)
        out[0] = 1
        with np.errstate(over="ignore"):
            return np.multiply.accumulate(out)

    def hashes(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of at most STEP bytes (or of one word), and where they start."""
        b = np.frombuffer(data, np.uint8)
        up, down = (self.up, self.down) if len(b) <= self.STEP else (self.powers(self.R, len(b)), self.powers(pow(self.R, -1, 1 << 64), len(b)))
        word = np.zeros(len(b) + 2, np.int8)
        word[1:-1] = ~self.space[b]
        turn = np.diff(word)
        first, past = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        sums = np.zeros(len(b) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(self.number[b] * up[: len(b)], out=sums[1:])
            return (sums[past] - sums[first]) * down[first], first

    def pieces(self, data: bytes) -> Iterator[bytes]:
        """A long text in pieces of at most STEP bytes that end at white space; a longer word is a piece."""
        at = 0
        while len(data) - at > self.STEP:
            cut = max(data.rfind(bytes([c]), at, at + self.STEP) for c in self.SPACES)
            if cut <= at:
                after = [k for c in self.SPACES if (k := data.find(bytes([c]), at + self.STEP)) >= 0]
                cut = min(after, default=len(data))
            yield data[at:cut]
            at = cut
        yield data[at:]

    def of(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The word hashes of each text, in order."""
        raw = [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]
        at = 0
        while at < len(raw):
            if len(raw[at]) > self.STEP:
                yield np.concatenate([self.hashes(p)[0] for p in self.pieces(raw[at])])
                at += 1
                continue
            past, size = at, 0
            while past < len(raw) and size + len(raw[past]) + 1 <= self.STEP:
                size += len(raw[past]) + 1
                past += 1
            past = max(past, at + 1)
            h, first = self.hashes(b"\n".join(raw[at:past]))
            ends = np.cumsum([len(r) + 1 for r in raw[at:past]])
            yield from np.split(h, np.searchsorted(first, ends[:-1]))
            at = past


_words: list[_Words] = []


def sets_of(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """The sets of texts as sorted 64-bit hashes: their word n-grams, or all their words if they are fewer."""
    if not _words:
        _words.append(_Words())
    out = []
    for h in _words[0].of(texts):
        take = min(words, len(h))
        if not take:
            out.append(np.zeros(0, np.int64))
            continue
        s = np.full(len(h) - take + 1, 0x9E3779B97F4A7C15 ^ take, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(take):
                s = (s ^ h[k : len(h) - take + 1 + k]) * np.uint64(0xFF51AFD7ED558CCD)
                s ^= s >> np.uint64(32)
            s *= np.uint64(0xC4CEB9FE1A85EC53)
            s ^= s >> np.uint64(29)
        s = s.view(np.int64)
        s.sort()
        out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
    return out


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    return sets_of([text], words)[0]


def least(n: np.ndarray | int) -> np.ndarray | int:
    """Tokens that a set of n shares with any linked set, at least."""
    return (NEED * n + 99) // 100


def spare(n: np.ndarray | int) -> np.ndarray | int:
    """By how many tokens the longer prefix of a set of n exceeds the shortest valid one, plus 1."""
    return (5 * n + 99) // 100


def prefix(n: int) -> int:
    """Length of the longer prefix: linked sets of n and m share min(spare(n), spare(m)) tokens of theirs."""
    return min(n, n - least(n) + spare(n))


def overlap(a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray | int:
    """Tokens that linked sets of a and b tokens share, at least."""
    return (NEED * (a + b) + 99 + NEED) // (100 + NEED)


def text_hash(text: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), text) if seed else F.xxhash64(text)


class Nodes:
    """The texts of a table as nodes.

    found: doc_id, node, worded (has words) of every row; mapped(): a function over node and text, once for each node.
    """

    def __init__(self, docs: DataFrame, key: str, text: str) -> None:
        bounded_batches(docs.sparkSession)
        self.docs, self.text = docs, F.col(text)
        self.key = F.col(key).cast("long")
        self.worded = F.coalesce(self.text, F.lit("")).rlike(WORD)
        self.clashes: list[list[int]] = []
        while True:
            rows = docs.select(self.key.alias("doc_id"), self.node.alias("node"), self.worded.alias("worded"), F.md5(self.text.cast("binary")).alias("other"))
            self.found = saved(rows, "found")
            two = self.found.where("worded").groupBy("node").agg(F.min("other").alias("x"), F.max("other").alias("y")).where("x <> y")
            # of n texts n * n / 2 ** 65 pairs or so: hardly ever one
            clash = [r["node"] for r in two.select("node").collect()]
            if not clash:
                break
            self.clashes.append(clash)
        self.rows = self.found.count()
        own = self.found.where("worded")
        once = own.groupBy("node", "doc_id").agg(F.count("*").alias("c"))
        self.first = once.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id")).alias("m")).select("node", "m.doc_id")
        # nodes of several rows; a filter of them lets all others by, so only these are shuffled
        self.doubt = members(own.groupBy("node").agg(F.count("*").alias("c")).where("c > 1").select("node"), self.rows)

    @property
    def node(self) -> Column:
        h = text_hash(self.text, 0)
        for k, clash in enumerate(self.clashes):
            h = F.when(h.isin(clash), text_hash(self.text, k + 1)).otherwise(h)
        return h

    def mapped(self, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, wanted: Broadcast | None = None) -> DataFrame:
        """``run`` over batches of node and text, each node once; wanted: a filter of nodes.

        Filters are asked by the worker that runs ``run``, so a task needs one Python worker, not two. A filter's
        error may repeat a node: that costs work only.
        """
        doubt = self.doubt

        def sure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                node = b["node"].to_numpy(np.int64)
                stays = np.ones(len(b), bool) if wanted is None else wanted.value.has(node)
                if doubt is not None:
                    stays &= ~doubt.value.has(node)
                if stays.any():
                    yield b[stays]

        rows = self.docs.where(self.worded).select(self.key.alias("doc_id"), self.node.alias("node"), self.text.alias("text"))
        out = rows.select("node", "text").mapInPandas(lambda batches: run(sure(batches)), schema)
        if doubt is None:
            return out
        rows = rows.where(among(doubt, F.col("node")) if wanted is None else among(doubt, F.col("node")) & among(wanted, F.col("node")))
        return out.unionByName(first_rows(rows, self.first).select("node", "text").mapInPandas(run, schema))

    def texts(self) -> DataFrame:
        """node and text."""
        return self.mapped(lambda batches: batches, "node long, text string")


def first_rows(rows: DataFrame, first: DataFrame) -> DataFrame:
    """One row of each (node, doc_id) that ``first`` has."""
    mine = first.select(F.col("node").alias("first_node"), F.col("doc_id").alias("first_id"))
    return rows.join(mine, (F.col("node") == F.col("first_node")) & F.col("doc_id").eqNullSafe(F.col("first_id")), "left_semi").dropDuplicates(["node", "doc_id"])


def counted(nodes: Nodes) -> DataFrame:
    """node, n of every text, and the frequency sketch as blocks (rows without a node)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        width = ORDER_WIDTH
        seen, any_ = np.zeros(width, np.int64), False
        for b in batches:
            found = sets_of(b["text"].tolist())
            if found:
                seen += np.bincount(np.concatenate(found) & (width - 1), minlength=width)
                any_ = True
            yield pd.DataFrame({"node": b["node"].to_numpy(np.int64), "n": np.array([len(s) for s in found], np.int64), "part": -1, "block": -1, "data": [b""] * len(b)})
        if any_:
            yield given_away(seen).assign(node=np.int64(0), n=np.int64(0))[["node", "n", "part", "block", "data"]]

    return nodes.mapped(run, "node long, n long, part int, block int, data binary")


def prefixes(nodes: Nodes, sketch: Broadcast, often: int) -> DataFrame:
    """node, n, tokens (the prefix under the first order) and cool: how many of them the sketch has fewer than ``often`` times."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = sketch.value
        for b in batches:
            ns, cool, tokens = [], [], []
            for s in sets_of(b["text"].tolist()):
                c = seen[s & (len(seen) - 1)]
                order = np.argsort(c, kind="stable")[: len(s) - least(len(s)) + 1]
                ns.append(len(s))
                cool.append(int((c[order] < often).sum()))
                tokens.append(s[order])
            yield pd.DataFrame({"node": b["node"].to_numpy(np.int64), "n": np.array(ns, np.int64), "cool": np.array(cool, np.int32), "tokens": tokens})

    return nodes.mapped(run, "node long, n long, cool int, tokens array<long>")


#: What makes a node central in a bucket: its token comes early.
HEAD = "min(struct(pos / n as p, node as b, n as m, pos as at))"


def buckets(firsts: DataFrame, any_hot: bool = True) -> DataFrame:
    """token, node, n, pos of prefix tokens that more than one node has, with c (how many) and the most central node (b, m, at).

    Tokens are shuffled once. Those that may be in very many sets are summed before they are, and their heads
    broadcast: with the limit on ``c`` at most 65,536.
    """
    cool = firsts.select("node", "n", F.posexplode(F.expr("slice(tokens, 1, cool)")).alias("pos", "token"))
    every = Window.partitionBy("token")
    near = cool.withColumn("c", F.count("*").over(every)).withColumn("t", F.expr(HEAD).over(every)).where("c > 1")
    columns = ["token", "node", "n", "pos", "c", "t"]
    out = near.select(columns)
    if any_hot:
        hot = firsts.where("cool < size(tokens)").select("node", "n", "cool", F.posexplode(F.expr("slice(tokens, cool + 1, size(tokens))")).alias("k", "token"))
        hot = saved(hot.select("node", "n", (F.col("k") + F.col("cool")).alias("pos"), "token"), "hot")
        limit = max(OFTEN, hot.count() >> 16)
        heads = saved(hot.groupBy("token").agg(F.count("*").alias("c"), F.expr(HEAD).alias("t")).where("c > 1"), "heads")
        big = F.broadcast(heads.where(F.col("c") > limit).select("token", F.lit(True).alias("big")))
        out = out.unionByName(on_token(hot.join(big, "token", "left"), heads, limit, "big").select(columns))
    return saved(out.select("token", "node", "n", F.col("pos").cast("long").alias("pos"), "c", "t.b", "t.m", "t.at"), "buckets")


def on_token(rows: DataFrame, table: DataFrame, limit: int, big: str) -> DataFrame:
    """rows joined with a table of tokens and their counts c; the few tokens of more than ``limit`` rows (at most 65,536) by broadcast."""
    few = table.where(F.col("c") > limit)
    return rows.where(big).drop(big).join(F.broadcast(few), "token").unionByName(rows.where(f"{big} is null or not {big}").drop(big).join(table.where(F.col("c") <= limit), "token"))


def _room(n: str, pos: str, m: str, at: str) -> Column:
    """Whether sets of n and m tokens that first meet at these positions can overlap enough."""
    return F.expr(f"least({n} - {pos}, {m} - {at}) >= ({NEED} * ({n} + {m}) + {99 + NEED}) div {100 + NEED}")


def stars(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of each node with the most central node of each of its buckets."""
    near = rows.where("node <> b").where(_room("n", "pos", "m", "at"))
    return near.select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()


def rests(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs of nodes of different components that meet in a bucket with room for the overlap they need."""
    named = saved(rows.select("token", "node", "n", "pos", "c").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled")
    mixed = saved(named.groupBy("token").agg(F.max("c").alias("c"), F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("token", "c"), "mixed")
    limit = max(OFTEN, named.count() >> 16)
    put = on_token(named.withColumn("big", F.col("c") > limit).drop("c"), mixed, limit, "big")
    small = put.where(f"c <= {SMALL}").select("token", "node", "n", "pos", "label")
    other = small.select("token", F.col("node").alias("b"), F.col("n").alias("m"), F.col("pos").alias("at"), F.col("label").alias("theirs"))
    meet = small.join(other, "token").where("node < b and label <> theirs").where(_room("n", "pos", "m", "at"))
    found = meet.select(F.col("node").alias("a"), "b")
    put = put.where(f"c > {SMALL}")
    # a large bucket becomes pairs of blocks; no task gets more than two blocks of it
    n = F.expr(f"((c - 1) div {BLOCK}) + 1")
    put = put.withColumn("blocks", n).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    put = put.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    put = put.select("token", "node", "n", "pos", "label", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("node")
        node, n, pos, label = (pdf[c].to_numpy(np.int64) for c in ("node", "n", "pos", "label"))
        order = np.argsort(n, kind="stable")
        node, n, pos, label = node[order], n[order], pos[order], label[order]
        left = n - pos
        out_a, out_b = [], []
        for k in range(len(node)):
            # partners of at most this size that leave room: sizes above k's come with k as the partner
            lo = np.searchsorted(n, (NEED * n[k]) // 100)
            need = overlap(n[lo:k], n[k])
            hit = np.flatnonzero((np.minimum(left[lo:k], left[k]) >= need) & (label[lo:k] != label[k])) + lo
            out_a.append(np.minimum(node[hit], node[k]))
            out_b.append(np.maximum(node[hit], node[k]))
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return pd.DataFrame({"a": join(out_a), "b": join(out_b)})

    return found.unionByName(put.groupBy("token", "i", "j").applyInPandas(run, "a long, b long")).distinct()


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()


def _fetched(pairs: DataFrame, table: DataFrame, n: int) -> DataFrame:
    """A saved table of pairs with the columns of a table of nodes, for a and for b (names end in _a, _b); a node may be in very many pairs."""
    out = pairs
    for side in ("a", "b"):
        out = spread_join(out, table.select(F.col("node").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in table.columns if c != "node"]), side, over=pairs, n_rows=n)
    return out


#: Bits of a set's bitmap, for each of its tokens (up to the next power of two).
SPREAD = 8


def digest(s: np.ndarray) -> tuple[int, bytes, bytes, bytes]:
    """What the filters need of a set: its size, both ends of the hash order (16 bits of each token) and a bitmap of it."""
    k = prefix(len(s))
    flags = np.zeros(max(1024, 1 << (SPREAD * len(s) - 1).bit_length()), bool)
    flags[s & (len(flags) - 1)] = True
    ends = [((e >> 24) & 0xFFFF).astype("<u2").tobytes() for e in (s[:k], s[len(s) - k :])]
    return len(s), ends[0], ends[1], np.packbits(flags, bitorder="little").tobytes()


def may_link(a: tuple[int, bytes, bytes, bytes], b: tuple[int, bytes, bytes, bytes], room: np.ndarray) -> bool:
    """Whether two digests can be of linked sets; never False if they link. room: 65,536 flags, all down.

    Under both directions of the hash order so many tokens of the longer prefixes have to be met (tokens of equal
    16 bits count as met). Of the bitmaps, common tokens fill common bits but for those that fall on one bit, which
    are no more than either whole set has.
    """
    few = min(spare(a[0]), spare(b[0]))
    for x, y in ((a[1], b[1]), (a[2], b[2])):
        x, y = np.frombuffer(x, "<u2"), np.frombuffer(y, "<u2")
        room[y] = True
        met = int(room[x].sum())
        room[y] = False
        if met < few:
            return False
    x, y = np.frombuffer(a[3], np.uint8), np.frombuffer(b[3], np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] | y[len(y) // 2 :]
    bits = lambda v: int(np.bitwise_count(v).sum())
    return bits(x & y) >= overlap(a[0], b[0]) - min(a[0] - bits(x), b[0] - bits(y))


def verified(pairs: DataFrame, nodes: Nodes) -> DataFrame:
    """The pairs that link: digests first (both directions of the hash order), then the sets of those that pass."""
    pairs = saved(pairs, "pairs")
    n = pairs.count()
    if not n:
        return pairs

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(k, *digest(s)) for k, s in zip(b["node"].tolist(), sets_of(b["text"].tolist()), strict=True)], columns=["node", "n", "up", "down", "bits"])

    def passing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        room = np.zeros(65536, bool)
        for p in batches:
            side = lambda x, p=p: zip(p[f"n_{x}"].tolist(), p[f"up_{x}"], p[f"down_{x}"], p[f"bits_{x}"], strict=True)
            yield p.loc[np.fromiter((may_link(x, y, room) for x, y in zip(side("a"), side("b"), strict=True)), bool, len(p)), ["a", "b"]]

    small = saved(nodes.mapped(digests, "node long, n long, up binary, down binary, bits binary", members(_ends(pairs), 2 * n)), "digests")
    passed = saved(_fetched(pairs, small, n).mapInPandas(passing, "a long, b long"), "passed")
    dropped(pairs, small)
    n = passed.count()
    if not n:
        return passed

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"node": b["node"].to_numpy(np.int64), "tokens": sets_of(b["text"].tolist())})

    full = saved(nodes.mapped(whole, "node long, tokens array<long>", members(_ends(passed), 2 * n)), "full")
    common, sizes = F.size(F.array_intersect("tokens_a", "tokens_b")), F.size("tokens_a") + F.size("tokens_b")
    links = saved(_fetched(passed, full, n).where(100 * common >= NEED * (sizes - common)).select("a", "b").distinct(), "links")
    dropped(full, passed)
    return links


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, node and component (a node) of every document; blank ones have neither."""
    return classed(Nodes(docs, key, text))


def classed(nodes: Nodes) -> DataFrame:
    counts = saved(counted(nodes), "counted")
    sizes = counts.where("part < 0").select("node", "n")
    seen = merged(counts.where("part >= 0").select("part", "block", "data"), ORDER_WIDTH, np.add)
    # a token that more than this many counted tokens share a counter with may be in very many sets
    often = max(OFTEN, int(seen.sum()) >> 16)
    sketch = nodes.docs.sparkSession.sparkContext.broadcast(np.minimum(seen, np.iinfo(np.uint32).max).astype(np.uint32))
    firsts_ = saved(prefixes(nodes, sketch, often), "prefixes")
    rows = buckets(firsts_, bool((seen >= often).any()))
    dropped(firsts_)
    near = verified(stars(rows), nodes)
    labels = components(near)
    more = verified(rests(rows, labels), nodes)
    if more.limit(1).count():
        labels = components(near.unionByName(more))
    dropped(rows)
    named = sizes.groupBy("node").agg(F.max("n").alias("n_shingles")).join(labels, "node", "left").withColumn("component", F.coalesce("label", "node")).drop("label")
    out = spread_join(nodes.found.where("worded"), named, "node", n_rows=nodes.rows)
    blank = nodes.found.where("not worded").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("node"), F.lit(None).cast("long").alias("component"))
    return saved(out.select("doc_id", "n_shingles", "node", "component").unionByName(blank), "classes")


def firsts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, one for each component (that of the smallest id); documents without words all stay.

    Only rows that may have to go are shuffled: a filter of those lets the others through.
    """
    nodes = Nodes(docs, key, text)
    named = classed(nodes)
    own = named.where("n_shingles > 0")
    first = own.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "node")).alias("m"))
    first = saved(first.select(F.col("m.doc_id").alias("doc_id"), F.col("m.node").alias("node")), "firsts")
    goes = own.select("doc_id", "node").join(first.select(F.col("node").alias("n"), F.col("doc_id").alias("i")), F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("node") == F.col("n")), "left_anti")
    again = own.groupBy("doc_id", "node").count().where("count > 1").select("doc_id", "node")
    doubt = members(goes.unionByName(again).select(F.xxhash64("node", "doc_id").alias("k")).distinct(), nodes.rows)
    # the row travels as one value, so no column of it can clash
    rows = docs.select(F.struct(*docs.columns).alias("_row"), nodes.key.alias("doc_id"), nodes.node.alias("node"), nodes.worded.alias("_worded"))
    rows = rows.withColumn("_doubt", F.col("_worded") & among(doubt, F.xxhash64("node", "doc_id")))
    return rows.where("not _doubt").select("_row").unionByName(first_rows(rows.where("_doubt"), first).select("_row")).select("_row.*")


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    ids = named.where("n_shingles > 0").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    out = spread_join(named, ids, "component", "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"))


QUERIES = {"op6_jaccard": op6_jaccard}
SQL = {
    "op6_jaccard": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)"""
}
