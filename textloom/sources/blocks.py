"""Text-like sources as blocks: (doc_id, block_no, text, page)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions.text import trimmed

TXT_PAGE, CSV_PAGE, JSON_PAGE = 50, 60, 20


def _numbered(parts: DataFrame) -> DataFrame:
    """Numbers the blocks that are left, within each document."""
    order = Window.partitionBy("doc_id").orderBy("part")
    return parts.select("doc_id", (F.row_number().over(order) - 1).alias("block_no"), "text", F.col("page").cast("int").alias("page"))


def txt_blocks(docs: DataFrame, text: str = "text") -> DataFrame:
    """A block ends at a line end before another one or the end of the text; its page is that of its end."""
    cut = F.col(text)
    for _ in range(2):  # neighbours overlap
        cut = F.regexp_replace(cut, "\n([\n\r])", "\n\u001e$1")
    parts = docs.select("doc_id", F.posexplode(F.split(cut, "\u001e")).alias("part", "raw"))
    lines = F.length("raw") - F.length(F.replace("raw", F.lit("\n"), F.lit("")))
    upto = Window.partitionBy("doc_id").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumn("page", 1 + F.floor(F.sum(lines).over(upto) / TXT_PAGE)).withColumn("text", trimmed(F.col("raw")))
    return _numbered(parts.where("text <> ''"))


def csv_blocks(docs: DataFrame, text: str = "text") -> DataFrame:
    """A block for each line that isn't empty: unquoted ; , and tab become ' | ', quotes go."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.col(text), "\n")).alias("part", "raw"))
    pieces = F.split(trimmed(F.col("raw")), '"')
    plain = F.transform(pieces, lambda s, i: F.when(i % 2 == 0, F.regexp_replace(s, "[;,\t]", " | ")).otherwise(s))
    lines = lines.withColumn("text", trimmed(F.array_join(plain, ""))).withColumn("page", 1 + F.floor(F.col("part") / CSV_PAGE))
    return _numbered(lines.where("text <> ''"))


def json_blocks(docs: DataFrame, text: str = "text") -> DataFrame:
    """A block for each string literal of 3 bytes or more that has a space or 24 bytes; without any, the whole text."""
    found = F.regexp_extract_all(F.col(text), F.lit(r'"((?:[^"\\]|\\.)*)"'), F.lit(1))
    plain = F.transform(found, lambda s: F.regexp_replace(F.replace(F.replace(s, F.lit("\\n"), F.lit("\n")), F.lit("\\t"), F.lit("\t")), r"\\(.)", "$1"))
    kept = F.filter(plain, lambda s: (F.octet_length(s) >= 3) & (F.contains(s, F.lit(" ")) | (F.octet_length(s) >= 24)))
    # nothing kept: the text itself is one block
    kept = F.when(F.size(kept) > 0, kept).otherwise(F.array(F.col(text)))
    rows = docs.select("doc_id", F.posexplode(kept).alias("part", "raw"))
    rows = rows.withColumn("page", 1 + F.floor(F.col("part") / JSON_PAGE)).withColumn("text", trimmed(F.col("raw")))
    return _numbered(rows.where("text <> ''"))


def full_text(blocks: DataFrame) -> DataFrame:
    """doc_id and its blocks joined by blank lines."""
    parts = F.array_sort(F.collect_list(F.struct("block_no", "text")))
    return blocks.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda b: b["text"]), "\n\n").alias("text"))


def numbered_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, doc_id): the files under a path, numbered from 0 in order of their paths; one row a file, no content."""
    files = spark.read.format("binaryFile").load(path).select("path")
    return files.withColumn("doc_id", (F.row_number().over(Window.orderBy("path")) - 1).cast("long"))


def read_blocks(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Blocks (doc_id, block_no, text, page, path) of the files under a path.

    Each file is a document with the number of ``numbered_files``; its reader is chosen by ending or first bytes, and
    a .pdf that doesn't begin like one is read as text.
    """
    from textloom.sources.pdf import pdf_blocks

    names = numbered_files(spark, path)
    files = spark.read.format("binaryFile").load(path).select("path", "content").join(names, "path")
    low, is_pdf = F.lower("path"), F.substring(F.col("content"), 1, 4) == F.lit(b"%PDF")
    kind = F.lit(fmt) if fmt else F.when(is_pdf, "pdf").when(low.endswith(".csv"), "csv").when(low.endswith(".json"), "json").otherwise("txt")
    files = files.withColumn("kind", kind).withColumn("text", F.decode("content", "UTF-8"))
    of = lambda k: files.where(F.col("kind") == k)
    out = txt_blocks(of("txt")).unionByName(csv_blocks(of("csv"))).unionByName(json_blocks(of("json")))
    out = out.unionByName(pdf_blocks(of("pdf")).select(F.col("doc_id").cast("long").alias("doc_id"), "block_no", "text", "page"))
    return out.join(names, "doc_id").select("doc_id", "block_no", "text", "page", "path")


def gold_questions(files: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n, question, page) from validation files; a missing page is -1."""
    shape = "struct<perguntas:array<struct<pagina_esperada:int,pergunta:string>>>"
    rows = files.select("doc_id", F.posexplode(F.from_json(F.col(text), shape)["perguntas"]).alias("n", "q"))
    return rows.select("doc_id", "n", F.col("q.pergunta").alias("question"), F.coalesce("q.pagina_esperada", F.lit(-1)).alias("page"))
