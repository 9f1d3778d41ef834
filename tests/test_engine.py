import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.functions import hashing
from textloom.operators import chunking, evaluation, index, nearest, package, questions, ranking, service
from textloom.plans import catalog
from textloom.sources import blocks

LONG = "Some words that make this piece of text long enough to be valid here"


def chunked(spark, texts, **k):
    b = spark.createDataFrame([(i, 0, t, 1) for i, t in enumerate(texts)], "doc_id long, block_no int, text string, page int")
    return chunking.chunks(b, **k)


def asked(spark, *qs):
    return ranking.questions_of(spark.createDataFrame(list(enumerate(qs)), "i long, t string"), "i", "t")


def test_chunk_windows(spark):
    text = " ".join(f"w{i}" for i in range(27))
    rows = chunked(spark, [text], max_words=10, overlap=2).orderBy("chunk_no").collect()
    assert [r.n_words for r in rows] == [10, 10, 10, 3] and rows[1].text.startswith("w8 ") and all(len(r.hash) == 8 for r in rows)
    assert chunked(spark, [text], max_words=10, overlap=10).count() == 4  # overlap falls to 2
    exact = chunked(spark, [" ".join(["x"] * 180)]).collect()
    assert len(exact) == 1


def test_partitioning_does_not_matter(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(40)
    out = [sorted(map(tuple, chunking.chunks(blocks.txt_blocks(docs.repartition(n))).collect())) for n in (1, 5)]
    assert out[0] == out[1]


def test_vectors(spark):
    rows = index.tokenized(chunked(spark, [LONG, "barco navega ilha barco", ""]))
    norms = index.embed(rows, "chunk_id").groupBy("chunk_id").agg(F.sum(F.col("w") * F.col("w")).alias("n")).collect()
    assert norms and all(abs(r.n - 1) < 1e-9 for r in norms)


def test_ranking_orders(spark):
    i = index.build_index(chunked(spark, ["a receita leva farinha integral bem torrada no forno lento", "a bicicleta azul ficou parada na garagem fria ontem", "a ponte antiga foi pintada durante o verão seco passado"]))
    q = asked(spark, "farinha integral", "fárinha íntegral", "ponte pintada", "a de ou")
    top = {(r.q_id, r["rank"]): r for r in ranking.top_k(i, q).collect()}
    assert top[0, 1].chunk_id == top[1, 1].chunk_id == 0 and top[2, 1].chunk_id >> chunking.CHUNK_BITS == 2
    assert top[3, 1].score == 0 and len([k for k in top if k[0] == 3]) == 3  # fillers


def test_poor_chunk_scores_zero(spark):
    i = index.build_index(chunked(spark, ["eh um", LONG]))
    got = ranking.hybrid_scores(i, asked(spark, "eh")).collect()
    assert all(r.score == 0 for r in got if r.chunk_id == 0)


def test_decisions(spark):
    i = index.build_index(chunked(spark, ["Netuno fica longe do Sol e recebe muito pouca luz durante o dia curto"]))
    q = asked(spark, "Netuno fica longe do Sol?")
    r = ranking.top_k(i, q)
    d = ranking.decide(i, q, r).first()
    assert d.confidence > 0.9 and not d.refused and d.answer.startswith("Com base no documento (p. 1): [p.1] ")
    assert ranking.decide(i, q, r, ranking.Calibration(threshold=1.0)).first().refused
    none = index.build_index(chunked(spark, ["x"]).limit(0))
    d = ranking.decide(none, q, ranking.top_k(none, q)).first()
    assert d.refused and d.confidence == 0


def test_overlay_keeps_local_on_failure(spark):
    class Broken:
        def rewrite(self, context, question):
            raise OSError

    i = index.build_index(chunked(spark, ["Netuno fica longe do Sol e recebe muito pouca luz durante o dia curto"]))
    q = asked(spark, "Netuno fica longe do Sol?")
    d = ranking.decide(i, q, ranking.top_k(i, q))
    assert ranking.overlay(d, Broken()).first().answer == d.first().answer


def test_calibration_precedence():
    p = ranking.Calibration(0.2, 16.0, 0.85)
    assert ranking.resolve_calibration((None, None, None), p) == p
    assert ranking.resolve_calibration((0.5, 20.0, 0.9), p) == ranking.Calibration(0.5, 20.0, 0.9)
    assert ranking.resolve_calibration() == ranking.Calibration()


def test_questions(spark):
    text = "O Vulcao cospe Cinza quente no vale. A chuva leva Barro grosso e Pedra solta. Depois a Lava esfria perto do Lago fundo."
    q = questions.generate(chunked(spark, [text])).collect()
    kinds = {r.type for r in q}
    assert kinds == {"noul", "choice", "score"} and all(len(r.options) == 4 for r in q if r.type == "choice")
    assert len({r.q_id for r in q}) == len(q) and sum(r.type == "score" for r in q) == 1


def test_calibrate_is_the_grid_search(spark):
    pts = [(0.45, 1), (0.31, 1), (0.22, 1), (0.08, 0), (0.15, 0), (0.25, 0)]
    got = evaluation.calibrate(spark.createDataFrame(pts, "score double, y int")).first()
    best = None
    for ci in range(12):
        for si in range(14):
            conf = [1 / (1 + math.exp(-max(-20, min(20, (s - (0.05 + 0.05 * ci)) * (4 + 2 * si))))) for s, _ in pts]
            for li in range(81):
                t = 0.10 + 0.01 * li
                yes = [c >= t for c in conf]
                tpr = sum(y and v for v, (_, y) in zip(yes, pts, strict=True)) / 3
                tnr = sum(not y and not v for v, (_, y) in zip(yes, pts, strict=True)) / 3
                acc = sum(bool(y) == v for v, (_, y) in zip(yes, pts, strict=True)) / 6
                key = (-round((tpr + tnr) / 2, 9), round(abs(sum(conf) / 6 - acc), 9), ci, si, li)
                best = min(best or key, key)
    assert (round(got.balanced, 6), round(got.gap, 6)) == (round(-best[0], 6), round(best[1], 6))
    assert (got.center, got.slope, got.threshold) == (round(0.05 + 0.05 * best[2], 6), 4.0 + 2 * best[3], round(0.10 + 0.01 * best[4], 6))


def test_package_round_trip(spark, tmp_path):
    c = chunked(spark, [LONG] * 3)
    p = package.Package(c, questions.generate(c), index.embed(index.tokenized(c), "chunk_id"), package.meta(spark, "t", calibration=ranking.Calibration(0.2, 16.0, 0.85)))
    package.save(p, str(tmp_path / "p"))
    back = package.load(spark, str(tmp_path / "p"), capped=True)
    assert back.calibration == ranking.Calibration(0.2, 16.0, 0.85) and sorted(map(tuple, back.chunks.collect())) == sorted(map(tuple, c.collect()))
    spark.createDataFrame([(1,)], "x int").write.mode("overwrite").parquet(str(tmp_path / "p/vectors"))
    with pytest.raises(ValueError, match="manifest"):
        package.load(spark, str(tmp_path / "p"))


def test_rpc():
    engine = {t: (lambda args, t=t: {"tool": t, **args}) for t in service.TOOLS}
    call = lambda line: service.handle_rpc(line, engine)
    assert '"serverInfo"' in call('{"id": 1, "method": "initialize"}') and call('{"method": "x"}') is None
    assert "-32700" in call("{bad") and "-32601" in call('{"id": 1, "method": "none"}') and "-32602" in call('{"id": 1, "method": "tools/call", "params": {"name": "no"}}')
    assert '"id": "req/7"' in call('{"id": "req/7", "method": "ping"}') and '\\"tool\\": \\"ask\\"' in call('{"id": 2, "method": "tools/call", "params": {"name": "ask"}}')


def test_evaluation_takes_every_question(spark, sf_dir):
    from textloom.plans import catalog

    ids = [r.q_id for r in catalog.questions_all(spark, sf_dir).select("q_id").collect()]
    by_hash = sorted(ids, key=lambda q: hashlib.md5(f"42/{q}".encode()).hexdigest())
    assert {r.q_id for r in catalog.QUERIES["sample_hash"](spark, sf_dir).collect()} == set(by_hash[: int(len(ids) * 0.1 + 0.5)])
    report = catalog.QUERIES["eval_report"](spark, sf_dir).first()
    assert report.n == len(ids) and report.fidelity == round(report.hits / report.n, 6)
    assert {r.y: r.n for r in catalog.QUERIES["calib_points"](spark, sf_dir).collect()} == {0: len(evaluation.PROBES), 1: len(ids)}
    spark.catalog.clearCache()


def test_blocks_of_questions_do_not_matter(spark, monkeypatch):
    texts = [f"palavra{k % 7} coisa{k % 5} lugar{k % 3} tempo{k} cidade{k % 11} livro{k % 2}" for k in range(60)]
    i = index.build_index(chunked(spark, texts))
    q = asked(spark, *[f"palavra{k % 7} tempo{k} livro1" for k in range(25)], "", "nada disso")
    rows = sorted(map(tuple, ranking.top_k(i, q).collect()))
    scored = {(r.q_id, r.chunk_id): r.score for r in ranking.hybrid_scores(i, q).collect()}
    ids = sorted(r.chunk_id for r in i.stats.collect())
    for k in range(27):
        best = sorted((-round(scored.get((k, c), 0.0), 6), c) for c in ids)[:3]
        assert [(r[2], -r[3]) for r in rows if r[0] == k] == [(c, x) for x, c in best]
    monkeypatch.setattr(ranking, "ASKED", 4)
    monkeypatch.setattr(ranking, "SCANNED", 7)
    assert sorted(map(tuple, ranking.top_k(i, q).collect())) == rows


def test_kept_index(spark, tmp_path):
    i = index.build_index(chunked(spark, [LONG, LONG + " again"]))
    q = asked(spark, "valid words here again")
    i.save(str(tmp_path / "index"))
    assert ranking.top_k(index.Index.load(spark, str(tmp_path / "index")), q).collect() == ranking.top_k(i, q).collect()


def test_pairs_are_not_shuffled(spark, tmp_path):
    i = index.build_index(chunked(spark, [LONG, LONG + " again", "eh um", ""])).save(str(tmp_path / "index"))
    q = asked(spark, "words that make this piece", "valid again", "um", "de")
    for f in (ranking.bm25, ranking.cosines, ranking.hybrid_scores, ranking.phrases):
        assert "Exchange" not in f(i, q)._jdf.queryExecution().executedPlan().toString()
    every = {(r.q_id, r.chunk_id): r for r in ranking.hybrid_scores(i, q).collect()}
    assert {k: r for k, r in every.items() if r.phrase} == {(r.q_id, r.chunk_id): r for r in ranking.phrases(i, q).collect()}
    assert set(every) == {(r.q_id, r.chunk_id) for r in ranking.cosines(i, q).collect()} >= {(r.q_id, r.chunk_id) for r in ranking.bm25(i, q).collect()}


def test_a_task_gives_its_best_chunks_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ranking, "SCANNED", 5)
    i = index.build_index(chunked(spark, [f"palavra{k % 7} coisa{k % 5} lugar tempo{k} cidade" for k in range(60)]).coalesce(1)).save(str(tmp_path / "index"))
    blocks = [ranking._Block([(1, ["lugar", "tempo9"], {"lugar": 0.1, "tempo9": 3.0})], 5.0, 2)]
    chunks = list(ranking._scanned([i.stats.toPandas()]))
    assert len(chunks) == 12
    for c in chunks:
        blocks[0].rank(c)
    best = list(blocks[0].best())
    assert len(best) == 2 and best[0].chunk_id[0] == 9 << chunking.CHUNK_BITS


def test_packages_side_by_side(spark):
    one, two = (index.build_index(chunked(spark, [f"{x} Netuno fica longe do Sol e recebe pouca luz"])) for x in ("Livro", "Caderno"))
    asks = spark.createDataFrame([(1, "a", "Netuno e luz"), (2, "b", "Netuno e luz"), (3, "", "Netuno e luz"), (4, "c", "Netuno")], "request_id long, model string, question string")
    rows = {r.q_id: r for r in service.ask([("a", one), ("b", two)], asks, "b").collect()}
    assert {k: r.package_id for k, r in rows.items()} == {1: "a", 2: "b", 3: "b"} and "Caderno" in rows[3].citation and "Livro" in rows[1].citation
    with pytest.raises(ValueError, match="one name"):
        service.ask([("a", one), ("a", two)], asks, "a")


def test_files_to_answers(spark, tmp_path):
    from textloom.sources import pdf

    (tmp_path / "a.pdf").write_bytes(pdf.synthetic(["Marte tem duas luas pequenas que giram muito depressa ao redor dele"]))
    (tmp_path / "b.txt").write_text("Saturno mostra aneis largos feitos de gelo e poeira muito fina", encoding="utf-8")
    (tmp_path / "c.csv").write_text("Venus;gira devagar;nuvens grossas cobrem todo o planeta quente", encoding="utf-8")
    (tmp_path / "d.json").write_text('{"nota": "Urano gira deitado e tem um brilho azul muito palido"}', encoding="utf-8")
    (tmp_path / "e.pdf").write_text("Plutao ficou fora da lista depois de uma longa discussao publica", encoding="utf-8")
    b = blocks.read_blocks(spark, str(tmp_path)).cache()
    names = {r.doc_id: r.path.rsplit("/", 1)[-1] for r in b.collect()}
    i = index.build_index(chunking.chunks(b.drop("path")))
    q = asked(spark, "luas de Marte", "aneis de Saturno", "nuvens de Venus", "brilho de Urano", "discussao sobre Plutao")
    top = {r.q_id: names[r.chunk_id >> chunking.CHUNK_BITS] for r in ranking.top_k(i, q).where("rank = 1").collect()}
    assert top == {0: "a.pdf", 1: "b.txt", 2: "c.csv", 3: "d.json", 4: "e.pdf"}
    assert all(not r.refused for r in ranking.decide(i, q, ranking.top_k(i, q)).collect())


def test_shuffled_sample_at_every_size(spark):
    ids = [7 * i * i - 900 for i in range(3000)]
    rows = spark.createDataFrame([(i,) for i in ids], "q_id long").repartition(5)
    order = hashing.shuffled(3000, 42)[:300]
    assert {r.nth: r.q_id for r in evaluation.sample_by_shuffle(rows, 0.1).collect()} == {i: ids[p] for i, p in enumerate(order)}
    many = evaluation.sample_by_shuffle(rows, 0.1, parity=2999).collect()
    hashed = rows.orderBy(F.xxhash64(F.lit(42), "q_id")).limit(300).collect()
    assert [r.q_id for r in sorted(many, key=lambda r: r.nth)] == [r.q_id for r in hashed] and sorted(r.nth for r in many) == list(range(300))
    assert evaluation.sample_by_shuffle(rows.limit(0), 0.1).count() == 0


def test_empty_query_reads_whole_documents(spark, tmp_path):
    from textloom.plans import catalog

    texts = [(1, "de para com o contrato foi assinado pelas partes presentes"), (2, "o de e para com"), (3, LONG), (4, "")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {(r.q_id, r.score) for r in catalog.QUERIES["empty_query"](spark, str(tmp_path)).collect()} == {(2, 0.0), (4, 0.0)}
    spark.catalog.clearCache()


def test_best_chunks(spark, sf_dir, monkeypatch):
    """The floored search finds what comparing everything finds, and leaves most pairs without a score."""
    monkeypatch.setattr(nearest, "HAY", 100)  # several blocks
    c = catalog._chunks(spark, sf_dir, True).cache()
    i = index.build_index(c)
    asked = ranking.questions_of(questions.generate(c), "q_id", "prompt", "chunk_id").withColumnRenamed("chunk_id", "made_from")
    odd = [(-1, "", None, []), (-2, "zzz", None, ["zzz"]), (-3, "x", -5, ["x", "the"]), (-4, "y", c.first()["chunk_id"], [])]
    asked = asked.unionByName(spark.createDataFrame(odd, asked.schema)).cache()
    row = lambda df: sorted((r.q_id, r.rank, r.chunk_id, r.score) for r in df.collect())
    got = row(nearest.best_chunks(i, asked))
    assert got == row(ranking.top_k(i, asked, 1)) and len(got) == asked.count()


def test_few_pairs_pass(spark, sf_dir):
    i = catalog._index(spark, sf_dir)
    (data,) = nearest._blocks(i)
    hay = nearest.Hay(data, i.corpus.first()["avgdl"])
    # each chunk asks for its own first 20 words, spelled as they are, and for a word that no chunk has
    asked = [hay.text(k).split()[:20] + ["zzzz"] for k in range(hay.n)]
    needles = nearest.Needles(hay, asked)
    every = np.repeat(np.arange(hay.n), hay.n), np.tile(np.arange(hay.n), hay.n)
    score = needles.scores(*every).reshape(hay.n, hay.n)
    floor = score.diagonal()
    q, k = needles.passing(floor)
    missed = score >= floor[:, None]
    missed[q, k] = False
    assert not missed.any() and len(q) < 0.1 * score.size
