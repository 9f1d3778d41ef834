"""The pipeline's stages against brute-force versions of their decisions."""

import os
import subprocess
import sys
from collections import Counter

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from textloom.llm import jaccard, packing, quality_rules  # noqa: E402
from textloom.llm.common import saved  # noqa: E402


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    now = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = now
        now = saved(stage(spark, before, sf_dir), "stage")
        seen[name] = now
        if name != "packing":
            assert now.schema.names == docs.columns
        if name == "quality rules":
            led = {r.doc_id: r.fail_bits for r in quality_rules.ledger(docs).collect()}
            assert {r.doc_id for r in now.collect()} == {k for k, v in led.items() if not v & quality_rules.mask(quality_rules.PRODUCTION)}
        if name == "quality classifier":
            bad = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").collect()}
            gone = {r.doc_id for r in before.collect()} - {r.doc_id for r in now.collect()}
            assert not gone & bad  # clean documents stay
        if name == "near duplicates":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            sets = {i: frozenset(jaccard.shingles(t).tolist()) for i, t in rows}
            parent = {i: i for i in sets}
            ids = sorted(sets)
            for n, a in enumerate(ids):
                for b in ids[:n]:
                    if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                        x, y = a, b
                        while parent[x] != x:
                            x = parent[x]
                        while parent[y] != y:
                            y = parent[y]
                        parent[max(x, y)] = min(x, y)
            assert {r.doc_id for r in now.collect()} == {i for i in ids if parent[i] == i}
        if name == "mixing":
            size = Counter({r.doc_id: len(r.text.split()) for r in before.collect()})
            got = Counter()
            for r in now.collect():
                got[r.doc_id] += len(r.text.split())
            assert all(got[k] <= 2 * size[k] for k in got) and abs(sum(got.values()) - 1.5 * sum(size.values())) <= 20
    pieces = seen["packing"].collect()
    assert sum(r.length for r in pieces) == sum(r.doc_tokens for r in pieces if r.start == 0)
    assert sum(r.start == 0 for r in pieces) == seen["mixing"].count()
    by = Counter()
    for r in pieces:
        by[r.sequence_id] += r.length
    assert max(by.values()) <= packing.CAPACITY


def test_odd_and_empty(spark, folder, bare):
    assert corpus_pipeline.run(spark, bare).count() == 0
    assert corpus_pipeline.run(spark, folder).count() > 0


def test_extra_columns_stay(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.schema.names == docs.schema.names
        assert out.where((F.col("bucket") != "x") | (F.col("n_words") != "y") | (F.col("size") != "z")).count() == 0, name


def test_stages_from_anywhere(folder, tmp_path):
    """A stage that is called by itself, by a driver started elsewhere, gives its workers the package."""
    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    code = f"""if True:
        import sys
        sys.path.insert(0, {root!r})
        from pyspark.sql import SparkSession
        import corpus_pipeline
        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
        docs = spark.read.parquet({folder!r} + "/documents.parquet")
        print("rows", dict(corpus_pipeline.STAGES)["quality classifier"](spark, docs, {folder!r}).count())
    """
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    ran = subprocess.run([sys.executable, "-c", code], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "rows" in ran.stdout, ran.stderr[-2000:]
