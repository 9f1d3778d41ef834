"""Each method against its brute-force meaning on small fixtures."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import ann, html_text, jaccard, licenses, mixing, quality_model, quality_rules, registry, sharding, toxicity
from textloom.llm.components import components


def test_movement_stays_in_changed_subtrees(spark):
    ids = spark.range(4000).select(F.col("id"))
    old = sharding.tree(2, 2, 4)
    # shard 5 weighs more: only its own subtree and what moves into or out of it may change
    def heavier(n):
        return sharding.Node(n.name, tuple(heavier(c) for c in n.children), n.shard, 2.0 if n.shard == 5 else n.own_weight)

    new = heavier(old)
    rows = ids.select(sharding.place(F.col("id"), old).alias("a"), sharding.place(F.col("id"), new).alias("b"), sharding.place(F.col("id"), sharding.with_region(old, 16)).alias("c")).collect()
    for r in rows:
        if r.a != r.b:
            # levels whose weights changed: region 0, rack 1 of it, shard 5
            assert r.b // 8 == 0 and (r.b // 4 == 1 or r.a // 8 == 1) and (r.b == 5 or r.a // 4 != 1)
        assert r.c in (r.a, 16)
    sizes = Counter(r.a for r in rows)
    assert len(sizes) == 16 and max(sizes.values()) < 1.5 * 250


def test_bit_reverse(spark):
    got = [r[0] for r in spark.range(16).select(mixing.bit_reverse(F.col("id"), 4)).collect()]
    assert got == [int(f"{i:04b}"[::-1], 2) for i in range(16)]


def test_mix_blocks_cover_targets(spark, sf_dir):
    rows = mixing.sized(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    placed, sizes = mixing.streams(rows)
    slots = mixing.ranked(mixing.schedule(spark, sizes, 64), sizes, 64).collect()
    assert len({r.slot for r in slots}) == len(slots)
    want = {r.source: r for r in sizes.collect()}
    for s, r in want.items():
        own = sorted((x for x in slots if x.source == s), key=lambda x: x.slot)
        assert [x["rank"] for x in own] == list(range(len(own))) and sum(x.words for x in own) == int(r.target)
        assert r.target <= 2 * r.source_size
    # the first half of the schedule has every source's share of it
    span = max(r.slot for r in slots) + 1
    for s, r in want.items():
        half = sum(x.source == s and x.slot < span / 2 for x in slots)
        assert abs(half - sum(x.source == s for x in slots) / 2) <= 2
    played = mixing.mix(placed, sizes, 64)
    assert played.agg(F.sum("taken")).first()[0] == sum(int(r.target) for r in want.values())


def test_mixed_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).cache()
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    want = {r.key: r.taken for r in mixing.taken(mixing.sized(docs)).collect()}
    got = Counter()
    for r in out.collect():
        got[r.doc_id] += len(r.text.split())
    assert {k: v for k, v in want.items() if v} == dict(got)


def test_mixed_keeps_repeated_rows_and_nulls(spark):
    rows = [(1, "a b c", None, "x")] * 3 + [(1, "a b c", None, "y")] * 2 + [(None, "d e", "s", "z")] * 2 + [(2, None, "s", "z"), (3, " ", "s", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, note string")
    want = {r.key: r.w for r in mixing.taken(mixing.sized(docs)).groupBy("key").agg(F.sum("taken").alias("w")).where("w > 0").collect()}
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    got = {}
    for r in out.collect():
        assert (r.doc_id, r.source, r.note) in {(k, s, n) for k, _, s, n in rows}
        got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.split())
    assert got == want and set(got) == {1, None}


def brute_components(docs, need=80):
    sets = {i: set(jaccard.shingles(t).tolist()) for i, t in docs}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= need * len(x | y):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in sets}


@pytest.mark.parametrize("seed", [1, 2])
def test_near_copies_against_brute_force(spark, seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(jaccard, "SMALL", 5)
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    monkeypatch.setattr(jaccard, "OFTEN", 1024 if seed == 1 else 6)  # the second time most shared tokens are hot
    passage = [f"p{i}" for i in range(60)]
    docs = []
    for g in range(25):
        base = [f"g{g}w{rng.randint(0, 300)}" for _ in range(rng.choice([1, 4, 6, 30, 120, 150]))]
        if g % 3 == 0:
            base += passage
        for _ in range(rng.randint(1, 40) if g < 3 else rng.randint(1, 5)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 40))):
                w[rng.randrange(len(w))] = f"x{rng.random()}"
            docs.append((len(docs), " ".join(w) if rng.random() < 0.9 else " ".join(w).upper()))
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    rows = jaccard.classes(df).collect()
    first = {}
    for r in rows:
        first[r.component] = min(first.get(r.component, r.doc_id), r.doc_id)
    assert {r.doc_id: first[r.component] for r in rows} == brute_components(docs)
    kept = jaccard.firsts(df)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(brute_components(docs).values()))


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (95, 90), (7, 3)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 90: 90, 95: 90, 100: 90}


def test_noisy_or_finds_the_sentence():
    rng = random.Random(3)
    calm = [f"word{i}" for i in range(80)]
    bags, labels = [], []
    for i in range(300):
        bag = [[f for w in rng.sample(calm, 6) for f in toxicity.features(w)] for _ in range(8)]
        if i % 3 == 0:
            bag[rng.randrange(8)] += toxicity.features(f"venom{rng.choice('abcdefgh')}{i}")
        bags.append(bag)
        labels.append(int(i % 3 == 0))
    bias, weights = toxicity.fit(bags, labels)
    known = toxicity.Weights(weights)
    text = "word1 word2 word3. This has venomous99 words. word4 word5."
    s, n, found = toxicity.score(text, bias, known)
    assert s > 0.7 and n == 3 and [text[a:b].strip() for a, b, _ in found] == ["This has venomous99 words"]
    assert toxicity.score("word1 word2. word3 word4.", bias, known)[0] < 0.3


def test_held_out_toxicity(spark):
    folder = "/root/testdata/sf0.01"
    rows = toxicity.op3_toxicity(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.toxic for r in rows) / len(rows)
    assert right > 0.9 and not any(r.predicted and not r.toxic for r in rows)


def test_quality_views_agree(spark):
    folder = "/root/testdata/sf0.01"
    rows = quality_model.op10_quality_model(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    assert sum(r.kept == bool(r.quality) for r in rows) / len(rows) > 0.95
    assert not [r for r in rows if r.kept != (r.score >= quality_model.KEEP)]
    assert all(0 <= x <= 1 for r in rows for x in (r.text_score, r.meta_score, r.score))


def test_shape_reads_the_whole_word():
    slots = quality_model.Slots()
    assert slots["a" * 45][1] == slots["b" * 60][1] != slots["a" * 45 + "9Q" * 30][1]


def brute_lis(pairs):
    best = [0] * len(pairs)
    for i, (_, j) in enumerate(pairs):
        best[i] = 1 + max((best[k] for k in range(i) if pairs[k][1] < j), default=0)
    return max(best, default=0)


def test_patience(spark):
    rng = random.Random(4)
    for _ in range(200):
        order = list(range(rng.randint(0, 9)))
        rng.shuffle(order)
        run = licenses.increasing(list(enumerate(order)))
        assert len(run) == brute_lis(list(enumerate(order))) and all(a[1] < b[1] for a, b in zip(run, run[1:], strict=False))
    a, b = "a b c d e f g".split(), "x a b q d e f y g".split()
    assert licenses.align(a, b) == [(0, 1), (1, 2), (3, 4), (4, 5), (5, 6), (6, 8)]
    text = "Intro words here. " + licenses.TEMPLATES["MIT-text"].replace("without limitation", "with no limit") + " More text."
    got = licenses.Scanner().scan(text)
    assert [g[0] for g in got] == ["MIT-text"] and text[got[0][1] : got[0][2]].startswith("Permission") and 0.9 < got[0][3] < 1
    spread = " ".join(f"{w} zzz" for w in licenses.TEMPLATES["MIT-text"].split())
    assert [g[0] for g in licenses.Scanner().scan(f"Intro {spread} end")] == ["MIT-text"]
    for name, wording in licenses.TEMPLATES.items():
        assert [g[0] for g in licenses.Scanner().scan(f"Some words before. {wording} And after.")] == [name]
    assert licenses.Scanner().scan("the general public gave permission for work on 2.0 cc of mit") == []


def test_pages_without_article():
    page = "<body><div id=menu><a href=a>Home</a> <a href=b>Other</a></div><div id=main><h2>Head line</h2><p>First paragraph with a fair number of words &eacute; in it.</p><p>Second <i>par</i>agraph, also long enough to count as text.</p></div><div class='reader-comments'><p>Nice one, thanks</p></div><div>Imprint</div></body>"
    assert html_text.main_text(page) == "Head line First paragraph with a fair number of words é in it. Second paragraph, also long enough to count as text."
    assert html_text.main_text("<article><p>x < y &amp;lt; z<script>var a='</p>'</script><form>f</form></article>") == "x < y &lt; z"


def _paragraphs(word, n):
    return "".join(f"<p>{word} paragraph {i} tells a fair number of words about the matter at hand, and then some more.</p>" for i in range(n))


def test_body_beside_a_teaser_article():
    menu = "<div id=menu><a href=a>Home</a> <a href=b>Other</a></div>"
    page = f"<body>{menu}<div id=content><h1>Title</h1>{_paragraphs('Body', 6)}</div><article class=card><a href=x>Teaser</a><p>Read on here.</p></article><div>Imprint</div></body>"
    got = html_text.main_text(page)
    assert got.startswith("Title Body paragraph 0") and got.count("Body") == 6 and "Teaser" not in got and "Imprint" not in got


@pytest.mark.parametrize("sizes", [(3, 3, 3), (3, 6, 9), (1, 1, 1)])
def test_sibling_articles(sizes):
    parts = "".join(f"<article><h2>Part {k}</h2>{_paragraphs(f'P{k}', n)}</article>" for k, n in enumerate(sizes))
    got = html_text.main_text(f"<body><div id=menu><a href=a>Home</a> <a href=b>Other</a></div><div>{parts}</div><div>Imprint</div></body>")
    assert [got.count(f"P{k} paragraph") for k in range(3)] == list(sizes) and "Home" not in got and "Imprint" not in got


def brute_neighbours(rows, queries, k=20):
    """(query_id, rank, vec_id) by comparing everything; rows: (id, vector)."""
    out = []
    for q, v in queries:
        best = sorted((-float(np.dot(np.array(v, float), np.array(x, float))), i) for i, x in rows if i != q and len(x) == len(v))[:k]
        out += [(q, r + 1, i) for r, (_, i) in enumerate(best)]
    return out


@pytest.mark.parametrize("rows,dim,least", [(3000, 16, 0.9), (600, 8, 0.9), (30, 4, 1.0)])
def test_recall_through_the_parts(spark, monkeypatch, rows, dim, least):
    monkeypatch.setattr(ann, "PART_ROWS", 100)
    rng = np.random.default_rng(rows)
    centres = rng.normal(size=(40, dim)) * 2
    data = [(i, [float(x) for x in centres[rng.integers(40)] + rng.normal(size=dim)]) for i in range(rows)]
    routed = []
    real = ann.learn
    monkeypatch.setattr(ann, "learn", lambda sample, parts: routed.append((parts, real(sample, parts))) or routed[-1][1])
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id) for r in ann.search(df.where("vec_id % 20 = 0"), df).collect()}
    want = {(q, i) for q, _, i in brute_neighbours(data, data[::20])}
    assert len(got) == len(want) and len(got & want) >= least * len(want)
    parts, (router, probes) = routed[0]
    assert rows < 100 or router is not None and parts >= 8 and probes < parts


def test_repeated_ids_and_odd_lengths(spark):
    rng = np.random.default_rng(5)
    data = [(i, [float(x) for x in rng.integers(-3, 4, 3)]) for i in range(59)]
    data = [(i, v if any(v) else [1.0, 0.0, 0.0]) for i, v in data]
    data += [(40, data[7][1]), (40, data[40][1]), (8, data[7][1]), (8, data[7][1])] + [(200 + i, [1.0, float(i)]) for i in range(4)]
    df = spark.createDataFrame([(*r, "x") for r in data], "vec_id long, embedding array<double>, rank string")
    rows = ann.search(df.where("vec_id % 20 = 0"), df).collect()
    want = Counter(brute_neighbours(data, [r for r in data if r[0] % 20 == 0]))
    assert Counter((r.query_id, r.rank, r.vec_id) for r in rows) == want


def test_many_ties_go_to_smaller_ids(spark):
    data = [(i, [1.0, float(i)]) for i in range(3000, 0, -1)]  # all as near to (1, 0)
    df = spark.createDataFrame(data + [(4000, [1.0, 0.0])], "vec_id long, embedding array<double>")
    rows = sorted(ann.search(df.where("vec_id = 4000"), df).collect(), key=lambda r: r["rank"])
    assert [r.vec_id for r in rows] == sorted(r.vec_id for r in rows) and {r.score for r in rows} == {1.0} and len(rows) == 20
    assert [r.vec_id for r in ann.search(df.where("vec_id = 4000"), df.where("vec_id < 60 or vec_id = 4000")).orderBy("rank").collect()] == list(range(1, 21))


def test_long_clean_text_stays_clean():
    known = toxicity.Weights({"=vile": 9.0, "=mild": 1.0})
    assert toxicity.score("A mild word here. " * 20_000, -6.0, known)[0] == 0
    assert toxicity.score("vile vile Vile, VILE!", -6.0, known)[0] == pytest.approx(1 / (1 + np.exp(-3)))
    bags = [["=vile"], ["=mild", "=vile"], ["=mild"]]
    brute = 1 - np.prod([1 - p for p in (1 / (1 + np.exp(6 - sum({"=vile": 9.0, "=mild": 1.0}[f] for f in b))) for b in bags) if p >= toxicity.FLOOR])
    assert toxicity.score("vile. mild vile. mild.", -6.0, known)[0] == pytest.approx(brute)


def test_quality_of_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    held = toxicity.is_held_out(F.col("doc_id"))
    rows = quality_model.score_rows(docs, quality_model.train(docs, labels.where(~held))).join(labels.where(held), "doc_id").collect()
    good, bad = [r for r in rows if r.quality], [r for r in rows if not r.quality]
    assert sum(r.score >= quality_model.KEEP for r in good) >= 0.99 * len(good)
    assert sum(r.score < quality_model.KEEP for r in bad) >= 0.9 * len(bad)


def test_metadata_never_reads_words():
    assert (quality_model.metadata_view("Ab1 cd\nef", "s", "l") == quality_model.metadata_view("xy ?zZ\n77", "s", "l")).all()


def test_a_text_that_many_share_is_one_node(spark, monkeypatch):
    # texts that share a hash are told apart
    real = jaccard.text_hash
    monkeypatch.setattr(jaccard, "text_hash", lambda t, seed: real(t, seed) if seed else F.pmod(real(t, 0), F.lit(3)))
    docs = [(i, "one two three four five six seven" if i < 40 else f"w{i} " * 3 + f"u{i} v{i} x{i} y{i}") for i in range(50)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    nodes = jaccard.Nodes(df, "doc_id", "text")
    assert nodes.texts().count() == 11 and nodes.found.select("node").distinct().count() == 11


def _density(tree):
    """The rule by plain recursion; tree: (name, children), children: texts and trees."""
    flat = lambda t: "".join(c if isinstance(c, str) else flat(c) for c in t[1])
    tags = lambda t: sum(1 + tags(c) for c in t[1] if not isinstance(c, str))
    return len(flat(tree)) / max(tags(tree), 1)


@pytest.mark.parametrize("seed", range(6))
def test_densest_subtree_against_recursion(seed):
    rng = random.Random(seed)

    def grow(depth):
        if not depth or rng.random() < 0.3:
            return ("p", [" ".join(f"w{rng.randint(0, 999)}" for _ in range(rng.randint(1, 30)))])
        return ("div", [grow(depth - 1) for _ in range(rng.randint(1, 5))])

    tree = ("body", [grow(4) for _ in range(3)])
    html = lambda t: t if isinstance(t, str) else f"<{t[0]}>" + "".join(map(html, t[1])) + f"</{t[0]}>"
    text = lambda t: t if isinstance(t, str) else " ".join(map(text, t[1]))
    nodes = [(tree, [])]
    for t, way in nodes:
        nodes += [(c, [*way, t]) for c in t[1] if not isinstance(c, str)]
    total = lambda t: sum(_density(c) for c in t[1] if not isinstance(c, str))
    best, way = max(nodes, key=lambda n: total(n[0]))
    least = min(_density(t) for t in [*way, best])

    def taken(t, k):
        if t is best:
            return [text(t)]
        return [x for c in t[1] for x in (taken(c, k + 1) if c is [*way, best][k + 1] else [text(c)] if _density(c) >= least else [])]

    assert html_text.main_text(html(tree)) == " ".join(taken(tree, 0))


@pytest.mark.parametrize("shell", ["<div class=\"content has-sidebar\">{}</div>", "<article><div class=\"entry-header\"><h1>Title</h1></div><div>{}</div></article>", "<div class=story>{}</div><article><a href=x>Teaser</a><p>Short.</p></article>"])
def test_misleading_names(shell):
    got = html_text.main_text("<body><div id=menu><a href=a>Home</a></div>" + shell.format(_paragraphs("Body", 4)) + "</body>")
    assert got.count("Body paragraph") == 4 and "Home" not in got and "Teaser" not in got and ("Title" in got) == ("Title" in shell)


def test_deep_and_long_pages():
    assert html_text.main_text("<div>" * 50_000 + "deep" + "</div>" * 50_000) == "deep"
    assert html_text.main_text("<b>" * 20_000 + "<p>x</i>" * 20_000).split() == ["x"] * 20_000
    assert html_text.main_text("<body><p>a <math><mi>b</mi></math> c</p>") == "a b c"


def test_learned_parts():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16)) * 3
    x = centres[rng.integers(0, 12, 3000)] + rng.normal(size=(3000, 16))
    router, probes = ann.learn(x, 12)
    sizes = np.bincount(np.argmax(router.logits(x), axis=1), minlength=12)
    assert probes < 12 and sizes.max() < 3 * 3000 / 12


def test_ablations(spark, sf_dir):
    led = quality_rules.ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")).cache()
    bits = [r.fail_bits for r in led.collect()]
    for r in quality_rules.ablations(led).collect():
        bit, mask = next(1 << x.bit for x in quality_rules.RULES if x.name == r.rule), quality_rules.mask(r.policy)
        assert (r.n_failed, r.n_failed_alone, r.n_kept_without) == (sum(b & bit > 0 for b in bits), sum(b & mask == bit for b in bits), sum(b & mask & ~bit == 0 for b in bits))


def test_sql_names():
    assert set(registry.SQL) <= set(registry.QUERIES) and sum(k.startswith("op") for k in registry.QUERIES) >= 10


def test_quality_model_is_not_fitted_on_the_driver(spark, sf_dir, monkeypatch):
    def fit(*_):
        raise AssertionError("fitted on the driver")

    monkeypatch.setattr(quality_model, "co_train", fit)  # workers have their own module
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    assert quality_model.train(read("documents"), read("labels")) is not None
    assert quality_model.train(read("documents"), read("labels").limit(0)) is None
    assert quality_model.train(read("documents").limit(0), read("labels")) is None
