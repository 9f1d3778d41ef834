"""Request shapes around decisions: routing, prompts, streamed slices, JSON and JSON-RPC."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import BinaryIO

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.index import Index
from textloom.operators.ranking import decide, questions_of, top_k

SLICE = 6
# Error codes of JSON-RPC.
PARSE_ERROR, NO_METHOD, BAD_PARAMS = -32700, -32601, -32602
TOOLS = ("ask", "decisions", "inspect", "version")
VERSION = "1.0"


def route(requests: DataFrame, packages: DataFrame, default: str) -> DataFrame:
    """requests (request_id, model), packages (package_id) -> (request_id, package_id, found): no model asks the default."""
    name = F.when(F.col("model").isNull() | (F.col("model") == "") | (F.col("model") == "default"), F.lit(default)).otherwise(F.col("model"))
    rows = requests.select("request_id", name.alias("package_id")).join(packages.select("package_id", F.lit(True).alias("known")), "package_id", "left")
    return rows.select("request_id", "package_id", F.coalesce("known", F.lit(False)).alias("found"))


def ask(packages: list[tuple[str, Index]], requests: DataFrame, default: str) -> DataFrame:
    """requests (request_id, model, question) -> their decisions with package_id, each from the index of its package.

    A service has a handful of packages, of different names; requests for others are answered by none.
    """
    names = [n for n, _ in packages]
    if len(set(names)) < len(names):
        raise ValueError("two packages have one name")
    spark = requests.sparkSession
    routed = route(requests, spark.createDataFrame([(n,) for n in names], "package_id string"), default).where("found").join(requests.select("request_id", "question"), "request_id")
    out = None
    for name, index in packages:
        q = questions_of(routed.where(F.col("package_id") == name), "request_id", "question")
        got = decide(index, q, top_k(index, q)).withColumn("package_id", F.lit(name))
        out = got if out is None else out.unionByName(got)
    return out


def last_prompt(turns: DataFrame) -> DataFrame:
    """(conv_id, prompt): the last turn of any role."""
    return turns.groupBy("conv_id").agg(F.max_by("text", F.struct("turn", "text")).alias("prompt"))


def slices(answers: DataFrame) -> DataFrame:
    """(q_id, n, part, last): an answer in slices of six words; the first also has its page mark."""
    ws = F.array_remove(F.split("answer", " "), "")
    rows = answers.select("q_id", "page", ws.alias("w")).where("size(w) > 0")
    rows = rows.select("q_id", "page", "w", F.explode(F.sequence(F.lit(0), ((F.size("w") - 1) / SLICE).cast("int"))).alias("n"))
    text = F.array_join(F.slice("w", F.col("n") * SLICE + 1, SLICE), " ")
    mark = F.when((F.col("n") == 0) & F.col("page").isNotNull(), F.concat(F.lit(" [p."), F.col("page").cast("string"), F.lit("]"))).otherwise("")
    return rows.select("q_id", "n", F.concat(text, mark).alias("part"), ((F.col("n") + 1) * SLICE >= F.size("w")).alias("last"))


def decision_json(d: DataFrame) -> Column:
    return F.to_json(F.struct(d["q_id"], d["page"], d["refused"], d["citation"]))


def sse(events: list[str], model: str, page: int | None, confidence: float) -> list[str]:
    """Server-sent lines of a streamed answer, its metadata and the end mark."""
    out = [json.dumps({"model": model, "delta": {"content": e, **({"role": "assistant"} if k == 0 else {})}}) for k, e in enumerate(events)]
    out.append(json.dumps({"model": model, "page": page, "confidence": round(confidence, 4), "finish_reason": "stop"}))
    return [f"data: {x}\n\n" for x in out] + ["data: [DONE]\n\n"]


def handle_rpc(line: str, engine: dict[str, Callable[[dict], object]]) -> str | None:
    """One JSON-RPC line; ``engine`` has a function for each tool. Notifications get no answer."""
    try:
        request = json.loads(line)
    except ValueError:
        request = None
    if not isinstance(request, dict):
        return json.dumps({"jsonrpc": "2.0", "id": None, "error": {"code": PARSE_ERROR, "message": "parse error"}})
    if "id" not in request:
        return None
    reply: dict[str, object] = {"jsonrpc": "2.0", "id": request["id"]}
    method, params = request.get("method"), request.get("params")
    params = params if isinstance(params, dict) else {}
    if method == "initialize":
        reply["result"] = {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"version": VERSION}}
    elif method == "ping":
        reply["result"] = {}
    elif method == "tools/list":
        reply["result"] = {"tools": [{"name": t} for t in TOOLS]}
    elif method == "tools/call":
        tool = engine.get(params.get("name", "")) if params.get("name") in TOOLS else None
        if tool is None:
            reply["error"] = {"code": BAD_PARAMS, "message": "unknown tool"}
        else:
            try:
                reply["result"] = {"content": [{"type": "text", "text": json.dumps(tool(params.get("arguments") or {}))}]}
            except (KeyError, ValueError) as e:  # a package or an argument that isn't there
                reply["result"] = {"content": [{"type": "text", "text": str(e)}], "isError": True}
    else:
        reply["error"] = {"code": NO_METHOD, "message": "unknown method"}
    return json.dumps(reply)


def messages(stream: BinaryIO, most: int = 64 << 20) -> Iterator[str]:
    """The messages of a stream: a line each, or headers with Content-Length, a blank line and that many bytes."""
    while line := stream.readline():
        name, _, size = line.partition(b":")
        if name.strip().lower() != b"content-length":
            if line.strip():
                yield line.decode("utf-8", "replace").strip()
            continue
        while (header := stream.readline()) and header.strip():
            pass
        if size.strip().isdigit() and 0 < int(size) < most:
            yield stream.read(int(size)).decode("utf-8", "replace")


def serve_rpc(stream: BinaryIO, out: BinaryIO, engine: dict[str, Callable[[dict], object]]) -> None:
    """Answers every message of a stream until it ends, a line an answer."""
    for message in messages(stream):
        if (reply := handle_rpc(message, engine)) is not None:
            out.write(reply.encode() + b"\n")
            out.flush()


def _contents(body: object) -> Iterator[object]:
    for key, value in body.items() if isinstance(body, dict) else enumerate(body if isinstance(body, list) else ()):
        if key == "content" and isinstance(value, str):
            yield value
        yield from _contents(value)


def prompt_of(body: dict) -> str:
    """What a request asks: its last ``content``, whoever says it; without any, its pergunta, input or prompt."""
    last = ""
    for last in _contents(body):
        pass
    others = (body.get(k) for k in ("pergunta", "input", "prompt"))
    return last or next((o for o in others if isinstance(o, str) and o), "")


def rpc_batch(lines: DataFrame) -> DataFrame:
    """(line_id, kind, tool, code): what each line of a batch asks for, without running it."""
    shape = "struct<id:string,method:string,params:struct<name:string>>"
    r = F.from_json("line", shape)
    rows = lines.withColumn("r", r).withColumn("bad", F.col("r.method").isNull())
    kind = F.when(F.col("bad"), "invalid").when(F.col("r.id").isNull(), "notification").otherwise(F.col("r.method"))
    known = F.col("r.method").isin("initialize", "ping", "tools/list", "tools/call")
    code = F.when(F.col("bad"), PARSE_ERROR).when(F.col("r.id").isNull(), F.lit(None)).when(~known, NO_METHOD).when((F.col("r.method") == "tools/call") & ~F.coalesce(F.col("r.params.name").isin(*TOOLS), F.lit(False)), BAD_PARAMS)
    return rows.select("line_id", kind.alias("kind"), F.col("r.params.name").alias("tool"), code.cast("int").alias("code"))
