import io
import json
import threading
import urllib.error
import urllib.request
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from textloom import serving
from textloom.__main__ import main
from textloom.operators import evaluation, package, ranking, remote, reports, service


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """A package of two files, made by the command line."""
    folder = tmp_path_factory.mktemp("files")
    (folder / "a.txt").write_text("O Farol guia cada Barco pela costa escura durante toda a noite fria.\n\nA Mare sobe devagar e cobre a Praia inteira antes do Sol nascer.", encoding="utf-8")
    (folder / "b.csv").write_text("Moinho;gira com vento forte;produz farinha clara para o povo da vila\n", encoding="utf-8")
    out = str(folder.parent / "costa")
    assert main(["compile", "--input", str(folder), "--output", out, "--title", "Costa", "--chunk-words", "40"], spark) == 0
    return out


def test_ask_and_inspect(spark, made, capsys):
    assert main(["ask", "--package", made, "--json", "farinha do Moinho"], spark) == 0
    d = json.loads(capsys.readouterr().out)
    assert not d["recusada"] and "farinha clara" in d["resposta"] and d["pagina"] == 1 and d["backend"] == "local"
    assert main(["ask", "--package", made, "--limiar-recusa", "1.0", "farinha do Moinho"], spark) == 0
    assert "recusada]" in capsys.readouterr().out
    assert main(["inspect", "--package", made, "--chunks", "1", "--questions", "2"], spark) == 0
    said = capsys.readouterr().out
    assert "title: Costa" in said and "n_chunks: 2" in said and said.count("[chunk ") == 1
    assert main(["ask", "--package", made], spark) == 1 and main(["version"]) == 0


def test_reports(spark, made, tmp_path, capsys):
    assert main(["eval", "--package", made, "--sample", "1", "--json"], spark) == 0
    r = json.loads(capsys.readouterr().out)
    n = package.load(spark, made).questions.count()
    assert r["total_perguntas"] == r["amostradas"] == n and sum(t[1] for t in r["por_tipo"].values()) == n
    assert r["acertos"] == sum(t[0] for t in r["por_tipo"].values()) and r["lat_max_ms"] >= r["lat_media_ms"] > 0 and r["via"] == {"local": n}
    gold = tmp_path / "gold.json"
    gold.write_text(json.dumps({"perguntas": [{"pergunta": "quem guia o barco", "pagina_esperada": 1}, {"pergunta": "vento e farinha"}]}), encoding="utf-8")
    copy = str(tmp_path / "outro")
    assert main(["calibrate", "--package", made, "--validacao", str(gold), "--json", "--apply", "--output", copy], spark) == 0
    c = json.loads(capsys.readouterr().out)
    assert c["n_val"] == 2 and c["validacao"]["ok"] == 2 and c["sugerido"]["bal"] >= c["atual"]["bal"]
    assert package.load(spark, copy).calibration == reports.suggested(c) and package.load(spark, made).calibration is None
    # into the package itself
    package.apply_calibration(spark, copy, ranking.Calibration(0.3, 8.0, 0.6))
    back = serving.Engine(spark, [copy])
    assert back.calibrations["outro"] == ranking.Calibration(0.3, 8.0, 0.6)
    none = tmp_path / "none.json"
    none.write_text("{}", encoding="utf-8")
    assert main(["calibrate", "--package", made, "--validacao", str(none)], spark) == 1


def test_gold_term_of_the_objective(spark):
    # without gold a high threshold is best; gold that only a low one answers pulls it down
    pts = spark.createDataFrame([(0.9, 1), (0.5, 0)], "score double, y int")
    gold = spark.createDataFrame([(0.40, 3, 5, 5), (0.42, 9, 9, 5), (0.41, 1, 2, -1)], "score double, page1 int, page2 int, expected int")
    recall = evaluation.gold_recall_grid(gold)
    got = evaluation.calibrate(pts, recall).first()
    best = max((b + r) / 2 for b, r in brute_objective(spark, pts, gold))
    assert round((got.balanced + at(recall, spark, got)) / 2, 6) == round(best, 6)


def at(recall, spark, got):
    rows = recall.join(evaluation.grid(spark), ["ci", "si", "li"])
    for c in ("center", "slope", "threshold"):
        rows = rows.where(F.round(c, 6) == got[c])
    return rows.first()["recall"]


def brute_objective(spark, pts, gold):
    import math

    conf = lambda s, c, k: 1 / (1 + math.exp(-max(-20, min(20, (s - c) * k))))
    pts, gold = pts.collect(), gold.collect()
    for ci in range(12):
        for si in range(14):
            for li in range(81):
                c, k, t = 0.05 + 0.05 * ci, 4 + 2 * si, 0.10 + 0.01 * li
                yes = [conf(p.score, c, k) >= t for p in pts]
                ok = [conf(g.score, c, k) >= t and (g.expected < 0 or g.expected in (g.page1, g.page2)) for g in gold]
                yield (yes[0] + (not yes[1])) / 2, sum(ok) / 3


def test_service(spark, made):
    s = serving.Service(serving.Engine(spark, [made]), key="k1", eval_max=2)
    call = lambda method, path, body=None, key="Bearer k1": s.reply(method, path, key, json.dumps(body).encode() if body is not None else b"")
    code, _, data = call("GET", "/v1/models")
    assert code == 200 and [m["id"] for m in json.loads(data)["data"]] == ["costa"]
    assert call("GET", "/v1/models", key="Bearer k2")[0] == 401 and call("GET", "/v1/none")[0] == 404
    assert json.loads(call("GET", "/v1/info")[2])["n_chunks"] == 2
    chat = {"messages": [{"role": "user", "content": "x"}, {"role": "user", "content": "quem guia cada barco"}]}
    said = json.loads(call("POST", "/v1/chat/completions", chat)[2])
    assert "Farol" in said["choices"][0]["message"]["content"] and said["model"] == "costa"
    code, kind, data = call("POST", "/v1/chat/completions", chat | {"stream": True})
    assert kind == "text/event-stream" and data.endswith(b"data: [DONE]\n\n") and b"[p.1]" in data
    assert json.loads(call("POST", "/v1/decisions", {"pergunta": "farinha do moinho"})[2])["pagina"] == 1
    assert call("POST", "/v1/decisions", {"model": "outro", "pergunta": "x"})[0] == 404 and call("POST", "/v1/decisions", {})[0] == 400
    assert s.reply("POST", "/v1/decisions", "Bearer k1", b"{bad")[0] == 400
    data = json.loads(call("POST", "/v1/embeddings", {"input": ["farol claro", ""]})[2])
    assert abs(sum(x * x for x in data["data"][0]["embedding"]) - 1) < 1e-3 and set(data["data"][1]["embedding"]) == {0.0} and data["usage"]["total_tokens"] == 2
    assert call("POST", "/v1/embeddings", {})[0] == 400 and call("POST", "/v1/eval", {"sample": 1})[0] == 400
    s.max_body = 4
    assert call("POST", "/v1/decisions", {"pergunta": "x"})[0] == 413


def test_rpc_stream(spark, made):
    tools = serving.Engine(spark, [made]).tools()
    ask = json.dumps({"id": 2, "method": "tools/call", "params": {"name": "decisions", "arguments": {"pergunta": "farinha do moinho"}}})
    framed = json.dumps({"id": 3, "method": "ping"}).encode()
    lines = b'\n[1]\n{"method": "notifications/x"}\n' + ask.encode() + b"\r\nContent-Length: %d\r\nX: y\r\n\r\n" % len(framed) + framed
    lines += b'{"id": 4, "method": "tools/call", "params": {"name": "ask", "arguments": {"model": "none", "pergunta": "x"}}}\n'
    out = io.BytesIO()
    service.serve_rpc(io.BytesIO(lines), out, tools)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [g.get("id") for g in got] == [None, 2, 3, 4] and got[0]["error"]["code"] == -32700 and got[2]["result"] == {}
    assert json.loads(got[1]["result"]["content"][0]["text"])["pagina"] == 1 and got[3]["result"]["isError"]


def test_prompt_of():
    assert service.prompt_of({"messages": [{"content": "a"}, {"role": "system", "content": "b"}], "prompt": "c"}) == "b"
    assert service.prompt_of({"messages": [{"content": ""}], "input": "i", "prompt": "p"}) == "i" and service.prompt_of({"input": 3}) == ""


def test_http_server():
    class Echo:
        def refused(self, method, path, who, size):
            return (413, "too large") if size > 10 else None

        def reply(self, method, path, who, body):
            if path == "/bad":
                raise RuntimeError
            return 200, "application/json", body or b"{}"

    log = io.StringIO()
    s = serving.server(Echo(), port=0, workers=2, log=log)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{s.server_address[1]}"

    def code(path, data=None):
        try:
            return urllib.request.urlopen(url + path, data, timeout=10).status
        except urllib.error.HTTPError as e:
            return e.code

    assert [code("/x"), code("/x", b"12"), code("/x", b"1" * 11), code("/bad")] == [200, 200, 413, 500]
    # a place is free a moment after its caller has the answer
    assert all(s.room.acquire(timeout=10) for _ in range(66))
    assert code("/x") == 503
    s.room.release(66)
    assert code("/x") == 200
    s.shutdown()
    s.server_close()
    assert '"GET /x" 200 ' in log.getvalue() and '"POST /x" 413 ' in log.getvalue()


def test_remote_rewriter():
    seen = []

    class Chat(BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append((self.path, self.headers.get("Authorization"), json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
            data = json.dumps({"choices": [{"message": {"content": "sim, claro"}}]}).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args):
            pass

    s = HTTPServer(("127.0.0.1", 0), Chat)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    chat = remote.ChatRewriter(f"http://127.0.0.1:{s.server_address[1]}/v1", "m", "secret", timeout=10)
    assert chat.rewrite("trecho", "pergunta") == "sim, claro" and remote.Judge(chat).rewrite("trecho", "pergunta") == "trecho"
    s.shutdown()
    s.server_close()
    assert seen[0][0] == "/v1/chat/completions" and seen[0][1] == "Bearer secret" and seen[0][2]["messages"][1]["content"].startswith("Trecho: trecho")
    assert "Authorization" not in remote.ChatRewriter("http://far.example", "m", "secret")._headers()
