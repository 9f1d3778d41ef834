"""Null, empty, very long, repeated and clashing input through every query; empty tables too."""

import zlib
from collections import Counter

import pytest

from textloom.llm import registry

BIG = 2**60 + 1
DOCS = [k for k in registry.QUERIES if k not in ("op5_html", "op8_ann", "quality_ablations", "op2_packing")]


@pytest.mark.parametrize("name", DOCS)
def test_every_row_stays(spark, folder, odd_rows, name):
    rows = registry.QUERIES[name](spark, folder).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in odd_rows)


@pytest.mark.parametrize("name", [k for k in registry.QUERIES if k != "quality_ablations"])
def test_empty_tables(spark, bare, name):
    assert registry.QUERIES[name](spark, bare).count() == 0


def test_shards(spark, folder, odd_rows):
    rows = registry.QUERIES["op1_sharding"](spark, folder).collect()
    text = {(r[0], len((r[1] or "").encode()) + 1): r[1] or "" for r in odd_rows}
    for r in rows:
        assert r.text_crc32 == zlib.crc32(text[(r.doc_id, r.size)].encode()) and 0 <= r.shard < 16 and r.grown_shard in (r.shard, 16)
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_packing(spark, folder, odd_rows):
    rows = registry.QUERIES["op2_packing"](spark, folder).collect()
    assert sum(r.start == 0 for r in rows) == len(odd_rows)
    assert {r.doc_tokens for r in rows if r.doc_id in (1, 2, 3)} == {1}
    assert {r.doc_id for r in rows} == {r[0] for r in odd_rows}


def test_toxicity(spark, folder):
    rows = {r.doc_id: r for r in registry.QUERIES["op3_toxicity"](spark, folder).collect()}
    assert rows[1].score == rows[2].score == rows[3].score == 0
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_licenses(spark, folder):
    rows = {r.doc_id: r for r in registry.QUERIES["op4_licenses"](spark, folder).collect()}
    assert rows[9].best_license == "MIT" and rows[9].licenses == ["MIT"] and rows[1].n_notices == rows[6].n_notices == 0


def test_pages(spark, folder):
    rows = registry.QUERIES["op5_html"](spark, folder).collect()
    got = sorted((str(r.page_id), r.text, r.n_chars) for r in rows)
    assert got == [("1", "", 0), ("2", "", 0), ("3", "", 0), ("3", "T one two", 9), ("None", "a & b", 5)]


def test_near_copies(spark, folder):
    rows = registry.QUERIES["op6_jaccard"](spark, folder).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert [r.component_id for r in by[BIG]] == [4, 4] and by[4][0].component_id == 4
    assert {(r.n_shingles, r.component_id) for r in by[None]} == {(20, 4), (1, 5)}
    assert [(by[i][0].n_shingles, by[i][0].component_id) for i in (1, 2, 3)] == [(0, 1), (0, 2), (0, 3)]
    assert by[5][0].n_shingles == 1 and by[6][0].n_shingles == 30_000 - 4


def test_mix(spark, folder):
    rows = registry.QUERIES["op7_mixing"](spark, folder).collect()
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    taken = Counter()
    for r in rows:
        taken[r.source_size, r.target] += r.taken
    assert all(t == int(target) for (_, target), t in taken.items())


def test_neighbours(spark, folder):
    rows = registry.QUERIES["op8_ann"](spark, folder).collect()
    assert {r.query_id for r in rows} == {0, 20, 40}
    v = {i: (float(i % 3), 1.0, float(i % 7)) for i in range(50)}
    for q in (0, 20, 40):
        want = sorted(((-sum(a * b for a, b in zip(v[q], v[i], strict=True)), i) for i in v if i != q))[:20]
        assert [(r.rank, r.vec_id, r.score) for r in sorted(rows, key=lambda r: r.rank) if r.query_id == q] == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]


def test_rules(spark, folder):
    rows = {r.doc_id: r for r in registry.QUERIES["op9_quality_rules"](spark, folder).collect()}
    assert rows[1].n_words == rows[3].n_words == 0 and rows[1].base_failed and not rows[1].kept
    assert rows[6].kept or rows[6].n_words == 30_000
