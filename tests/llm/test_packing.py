import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from textloom.llm import packing


def brute(spark, docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return {d: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [packing.END], dtype="<u4").tobytes() for d, t in docs}


def check(rows, ids, capacity=packing.CAPACITY):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(ids)
    for d, parts in by_doc.items():
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids[d]) // 4
            assert r.ids_crc32 == zlib.crc32(ids[d][4 * at : 4 * (at + r.length)])
            at += r.length
        assert at == len(ids[d]) // 4
    padding = 0
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding, len(by_seq)


def test_whole_table(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    padding, n = check(packing.op2_packing(spark, sf_dir).collect(), brute(spark, docs))
    assert padding <= packing.CAPACITY * max(2, 0.02 * n)


def test_odd_texts(spark):
    odd = ["", None, "  \t ", "It's 5²½ fine", "ΑΣ ας Ελλάς", "a\x1cb a\x85b a\xa0b", "<|endoftext|> x", "a<|ENDOFTEXT|>b", "x <|startoftext|><|endoftext|>", "日本語 テキスト", "é é", "x" * 9000, "\x00\x01 ¼¾ß µª"]
    docs = list(enumerate(odd))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    check(packing.pack(packing.cut(df)).collect(), brute(spark, docs))
    assert packing.pack(packing.cut(df.limit(0))).count() == 0


def test_fill_is_closest():
    rng = random.Random(5)
    for _ in range(60):
        counts = {rng.randint(1, 40): rng.randint(1, 3) for _ in range(6)}
        got = packing.fill(counts, 50)
        items = [x for x, n in counts.items() for _ in range(n)]
        first = max(items)
        items.remove(first)
        sums = {0}
        for x in items:
            sums |= {s + x for s in sums}
        assert sum(got) == first + max(s for s in sums if s <= 50 - first)
        assert all(got.count(x) <= counts[x] for x in got)


@pytest.mark.parametrize("rows", [3, 400])
def test_repeated_rows(spark, rows):
    df = spark.createDataFrame([(7, "same text here", "x")] * rows, "doc_id long, text string, length string")
    out = packing.pack(packing.cut(df)).collect()
    assert len(out) == rows and len({(r.sequence_id, r.offset) for r in out}) == rows
