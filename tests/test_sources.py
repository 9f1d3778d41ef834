import base64
import json
import zlib

from pyspark.sql import functions as F

from textloom.sources import blocks, config, pdf


def test_txt(spark):
    df = spark.createDataFrame([(1, "Uma linha curta\noutra linha\n\nMais abaixo\n"), (2, ""), (3, None), (4, "\n" * 60 + "x")], "doc_id long, text string")
    rows = [(r.doc_id, r.block_no, r.text, r.page) for r in blocks.txt_blocks(df).orderBy("doc_id", "block_no").collect()]
    assert rows == [(1, 0, "Uma linha curta\noutra linha", 1), (1, 1, "Mais abaixo", 1), (4, 0, "x", 2)]


def test_csv(spark):
    df = spark.createDataFrame([(1, 'a;b,"c;d"\n\n' + "x\n" * 60)], "doc_id long, text string")
    rows = blocks.csv_blocks(df).orderBy("block_no").collect()
    assert rows[0].text == "a | b | c;d" and rows[0].page == 1 and rows[-1].page == 2 and len(rows) == 61


def test_json(spark):
    docs = [(1, '{"a key here": "ab", "k": "long words here", "x": "abcdefghijklmnopqrstuvwxyz"}'), (2, "[1, 2]")]
    rows = blocks.json_blocks(spark.createDataFrame(docs, "doc_id long, text string")).orderBy("doc_id", "block_no").collect()
    assert [r.text for r in rows] == ["a key here", "long words here", "abcdefghijklmnopqrstuvwxyz", "[1, 2]"]


def test_gold(spark):
    text = json.dumps({"perguntas": [{"pagina_esperada": 7, "pergunta": "a"}, {"pergunta": "b"}]})
    rows = blocks.gold_questions(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("n").collect()
    assert [(r.question, r.page) for r in rows] == [("a", 7), ("b", -1)]


def stream(data, name=b""):
    return b"1 0 obj << /Filter " + name + b" >> stream\n" + data + b"\nendstream endobj\n" if name else b"1 0 obj << >> stream\n" + data + b"\nendstream endobj\n"


def text_of(content):
    return "\n".join(t for _, t in pdf.extract(b"%PDF-1.4\n" + content)[0])


def test_pdf_operators():
    show = lambda ops, **k: pdf.content_text(b"BT " + ops + b" ET", **k).strip()
    assert show(b"[(vento) -310 (norte)] TJ") == "vento norte" and show(b"[(ca)-35 (sa)12 (rao)] TJ") == "casarao"
    assert show(b"[(p) -80 (q)] TJ") == "pq" and show(b"[(p) -80 (q)] TJ", tj_space=-40) == "p q"
    assert show(b"[(p) 720 (q)] TJ") == "p q" and show(b"[(p) 720 (q)] TJ", tj_jump=900) == "pq"
    # a space after each string that is shown, a new line after ' and "
    assert show(b"(rio) Tj (mar) Tj (sal) Tj") == "rio mar sal" and show(b"[(rio)] TJ [(mar)] TJ") == "rio mar"
    assert show(b"(rio) Tj (mar) ' (sal) Tj") == "rio mar\nsal" and show(b'1 2 (rio) " (mar) Tj') == "rio\nmar"
    # only the last string is shown
    assert show(b"(rio) (mar) Tj") == "mar"
    assert show(b"(tres \\(t\\) \\102) Tj") == "tres (t) B" and show(b"<FEFF00FA006D> Tj <646F6973> Tj") == "úm dois"


def test_pdf_filters():
    body = b"BT (quatro ventos) Tj ET"
    for name, data in ((b"/FlateDecode", zlib.compress(body)), (b"/AHx", body.hex().encode() + b">"), (b"/A85", base64.a85encode(body) + b"~>"), (b"[/A85 /Fl]", base64.a85encode(zlib.compress(body)) + b"~>")):
        assert text_of(stream(data, name)) == "quatro ventos"
    run = bytes([len(body) - 1]) + body + b"\x80"
    assert text_of(stream(run, b"/RL")) == "quatro ventos"
    found, stats = pdf.extract(b"%PDF\n" + stream(b"broken", b"/Fl") + stream(body))
    assert stats["failed_inflate"] == 1 and found == [(1, "quatro ventos")]


def test_pdf_reader(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(pdf.synthetic(["one page", "second page"]))
    (tmp_path / "b.txt").write_text("plain text", encoding="utf-8")
    (tmp_path / "c.csv").write_text("a;b", encoding="utf-8")
    rows = {(r.path.rsplit("/", 1)[-1], r.page, r.text) for r in blocks.read_blocks(spark, str(tmp_path)).collect()}
    assert rows == {("a.pdf", 1, "one page"), ("a.pdf", 2, "second page"), ("b.txt", 1, "plain text"), ("c.csv", 1, "a | b")}


def test_config(tmp_path, monkeypatch):
    (tmp_path / "c.yaml").write_text('chunking:\n  max_words: 100 # words\n  overlap: "10"\ndecision_engine:\n  limiar_recusa: 0.4\n', encoding="utf-8")
    (tmp_path / "o.json").write_text(json.dumps({"chunking": {"overlap": 5}, "remote": {"api_key": "x"}}), encoding="utf-8")
    s = config.load_config(str(tmp_path / "c.yaml"), str(tmp_path / "o.json"), top_k=7)
    assert (s.max_words, s.overlap, s.threshold, s.top_k, s.extra) == (100, 5, 0.4, 7, {})
    for kind, t in (("choice", "Escolha: {{trecho}} (folha {{pagina}})"), ("score", '{"enunciado": "Nota de {{min}} ate {{max}}"}')):
        (tmp_path / f"question_{kind}.tpl").write_text(t, encoding="utf-8")
    t = config.load_templates(str(tmp_path))
    assert t.choice == "Escolha: {{trecho}} (folha {{pagina}})" and t.score == "Nota de {{min}} ate {{max}}" and t.noul == config.Templates().noul
    (tmp_path / "key").write_text("# c\nMY_KEY=a\nMY_KEY=b\n", encoding="utf-8")
    monkeypatch.delenv("MY_KEY", raising=False)
    assert config.resolve_secret(None, "MY_KEY", str(tmp_path / "key")) == "b" and config.resolve_secret("f", "MY_KEY") == "f"
